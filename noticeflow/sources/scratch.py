"""Working tables in the folder all executors share."""

import tempfile
import uuid


def scratch_root(spark):
    """The cluster's checkpoint folder; a local one only for a local master."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    local = spark.conf.get("spark.noticeflow.localScratch", None)
    if local is None:
        local = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.noticeflow.localScratch", local)
    return local


def scratch_path(spark, label="t"):
    return f"{scratch_root(spark)}/noticeflow/{label}-{uuid.uuid4().hex}"


def stage(df, path=None, staged=None):
    """Write `df` and read it back: later steps reuse the files instead of its lineage.

    The path is added to the list `staged`, for `drop` once nothing reads the table any more.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark)
    if staged is not None:
        staged.append(path)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hadoop_path(spark, path):
    """(file system, path, path class) of a folder on whatever storage its scheme names."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where, jvm.org.apache.hadoop.fs.Path


def exists(spark, path):
    fs, where, _ = hadoop_path(spark, path)
    return fs.exists(where)


def write_text(spark, path, text):
    """Write a small file; readers that see it complete are up to the caller."""
    fs, where, _ = hadoop_path(spark, path)
    out = fs.create(where, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark, path):
    fs, where, _ = hadoop_path(spark, path)
    stream = fs.open(where)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def drop(spark, paths):
    """Delete tables or folders; one that is already gone is no error."""
    for path in paths:
        fs, where, _ = hadoop_path(spark, path)
        fs.delete(where, True)


#: Bytes of a partition as the planner estimates them; rows in memory take some ten times as many.
PART_BYTES = 8 << 20
#: Estimates from here on are the planner's word for an unknown size, as of rows given by the driver.
_UNKNOWN = 1 << 50


def estimated_bytes(df):
    """The planner's estimate, in proportion to the files that `df` reads."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def parts_of(df):
    """Partitions for a shuffle of `df`: as many as the session sets, and more where these would grow with the input."""
    size = estimated_bytes(df)
    needed = -(-size // PART_BYTES) if size < _UNKNOWN else 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), needed)


def fits_broadcast(df):
    """Would the planner broadcast `df`?  Its size estimate against the session's threshold."""
    size = estimated_bytes(df)
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return size <= limit

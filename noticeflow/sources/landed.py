"""Scans of landed pages, documents and structured answers."""

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeflow.functions.documents import ok_status
from noticeflow.schema import DOCUMENTS, PAGES
from noticeflow.sources.scratch import exists, hadoop_path


#: Folders of a landed table, if it has any: the UTC day of the fetch.
FETCH_DATE = "fetch_date"
#: Landed files from this many bytes on stand alone, smaller ones share packs.
SMALL_BYTES = 1 << 15
#: Registered addresses that are pushed into the scan as a list; more than these are only joined.
MOST_PUSHED = 1000


def land(df, path):
    """Append landed rows (`fetched_at`) in one folder per UTC day, which the look-back prunes by."""
    day = F.date_from_unix_date(F.floor(F.unix_seconds("fetched_at") / 86400).cast("int"))
    df.withColumn(FETCH_DATE, day).write.mode("append").partitionBy(FETCH_DATE).parquet(path)


def _landed_schema(spark, path, schema):
    """The schema with the day of the fetch where the table has such folders."""
    fs, where, _ = hadoop_path(spark, path)
    names = [e.getPath().getName() for e in fs.listStatus(where)] if fs.exists(where) else []
    if any(n.startswith(FETCH_DATE + "=") for n in names):
        return T.StructType([*schema.fields, T.StructField(FETCH_DATE, T.DateType())])
    return schema


def read_pages(spark, path, schema=PAGES, streaming=False):
    """Landed listing pages; `final_url` is the address after redirects."""
    if streaming:
        return spark.readStream.schema(schema).parquet(path)
    return spark.read.schema(_landed_schema(spark, path, schema)).parquet(path)


def read_documents(spark, path, schema=DOCUMENTS):
    """Landed documents with their page texts."""
    return spark.read.schema(_landed_schema(spark, path, schema)).parquet(path)


def read_blobs(spark, path):
    """Landed files, one row each: path, modificationTime, length, content, and what their folders name.

    Contents are read only where `content` is used.  The source lists no file without bytes.
    """
    return spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path)


def pack_blobs(files, path):
    """Append small files (`path`, `content`) to packs: many files in one, as rows that `read_packs` gives back.

    A file system takes some milliseconds a file, which for millions of small files is more than all their bytes cost.
    """
    made = F.current_timestamp().alias("modificationTime")
    length = F.octet_length("content").cast("bigint").alias("length")
    files.select("path", made, length, "content").write.mode("append").parquet(path)


def read_packs(spark, path):
    """Files of packs with the columns of `read_blobs`."""
    return spark.read.schema("path string, modificationTime timestamp, length bigint, content binary").parquet(path)


def read_responses(spark, path):
    """Landed answers; `landed_at` is the time of their file, so that a later one counts."""
    kinds = "request_id string, response string"
    if not exists(spark, path):  # nothing has landed yet
        return spark.createDataFrame([], f"{kinds}, landed_at timestamp")
    lines = spark.read.schema(kinds).json(path)
    return lines.select("*", F.col("_metadata.file_modification_time").alias("landed_at"))


def in_lookback(df, ts, since, until):
    """Rows fetched within [since, until], two times or columns.

    Of a table in folders by day, only the folders of these days are read if times are given (of
    times without a zone, a day more on either side).
    """
    given = isinstance(since, datetime) and isinstance(until, datetime)
    if given and FETCH_DATE in df.columns:
        slack = [timedelta(days=t.tzinfo is None) for t in (since, until)]
        days = (since - slack[0]).astimezone(timezone.utc).date(), (until + slack[1]).astimezone(timezone.utc).date()
        df = df.filter(F.col(FETCH_DATE).between(*map(F.lit, days)))
    if given:
        since, until = (F.lit(t).cast("timestamp") for t in (since, until))
    return df.filter((F.col(ts) >= since) & (F.col(ts) <= until))


def registered_pages(pages, sources):
    """Pages of registered sources with name and order.

    The registry is a list the driver was started with, so it is broadcast and no page is shuffled; up
    to MOST_PUSHED addresses are a filter of the scan as well.
    """
    urls = [r[0] for r in sources.select("source_url").limit(MOST_PUSHED + 1).collect()]
    if len(urls) <= MOST_PUSHED:
        pages = pages.filter(F.col("request_url").isin(urls))
    registry = sources.select("source_ord", "source_name", F.col("source_url").alias("request_url"))
    return pages.join(F.broadcast(registry), "request_url")


def good_pages(pages):
    return pages.filter(ok_status(F.col("status")))

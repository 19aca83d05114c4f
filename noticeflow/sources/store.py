"""The record store: numbered versions over parts that later versions share.

Rows are dealt to parts by a hash of the fingerprint.  A version is a manifest, which names the folder
of each part's files; a merge reads and writes the parts its batch has keys of and takes the other
folders over, so its cost follows the batch and not the store.  Files are written aside first and count
once the manifest is published, a move that fails if another writer took the number: that writer's
version is then the base of another try, so no update is lost and readers see whole versions only.
"""

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeflow.operators.merge import upsert_actions
from noticeflow.schema import RECORD
from noticeflow.sources.scratch import drop, hadoop_path, read_text, write_text

_PREFIX = "version="
_MANIFEST = "manifest.json"
#: Parts of a new store: choose them so that one part is a few GB at most.
PARTS = 64
#: How often a merge starts again because another writer was faster.
TRIES = 8


class Conflict(RuntimeError):
    """Another writer published the version first."""


@dataclass
class Version:
    """What a manifest holds: parts of the store, folder of each part with rows, schema, counts of the write."""

    number: int = 0
    parts: int = PARTS
    folders: dict = field(default_factory=dict)
    schema: dict = None
    counts: dict = field(default_factory=dict)

    def paths(self, path, parts=None):
        wanted = self.folders if parts is None else [str(p) for p in parts if str(p) in self.folders]
        return [f"{path}/data/{self.folders[p]}/part={p}" for p in wanted]


def complete(spark, path, prefix, marker="_SUCCESS"):
    """Names of the subfolders `<prefix>…` that were written to the end (they hold the marker)."""
    fs, where, to_path = hadoop_path(spark, path)
    if not fs.exists(where):
        return []
    names = [entry.getPath().getName() for entry in fs.listStatus(where)]
    return sorted(
        n for n in names if n.startswith(prefix) and fs.exists(to_path(f"{path}/{n}/{marker}"))
    )


def versions(spark, path):
    """Numbers of the published versions, ascending."""
    return sorted(int(n[len(_PREFIX):]) for n in complete(spark, path, _PREFIX, _MANIFEST))


def read_version(spark, path, number=None):
    """The manifest of a version, the latest without a number; an empty one before the first."""
    if number is None:
        number = max(versions(spark, path), default=0)
    if not number:
        return Version()
    return Version(number=number, **json.loads(read_text(spark, f"{path}/{_PREFIX}{number:08d}/{_MANIFEST}")))


def _publish(spark, path, version, keep):
    """Make the version count, unless its number is taken; then older ones beyond `keep` go."""
    aside, final = f"{path}/data/manifest-{uuid.uuid4().hex}", f"{path}/{_PREFIX}{version.number:08d}"
    fs, where, to_path = hadoop_path(spark, aside)
    body = {"parts": version.parts, "folders": version.folders, "schema": version.schema, "counts": version.counts}
    write_text(spark, aside, json.dumps(body))
    fs.mkdirs(to_path(final))
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    never_replace = gateway.new_array(rename, 1)
    never_replace[0] = rename.NONE
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        files.rename(where, to_path(f"{final}/{_MANIFEST}"), never_replace)
    except Exception as e:
        drop(spark, [aside])
        if fs.exists(to_path(f"{final}/{_MANIFEST}")):
            raise Conflict(f"version {version.number} of {path} exists") from e
        raise
    if keep is not None:
        _forget(spark, path, keep)


def _forget(spark, path, keep):
    """Delete the versions before the last `keep`, and the files that only they name."""
    have = versions(spark, path)
    gone = have[: -max(keep, 1)]
    if not gone:
        return
    kept = {p for n in have[len(gone):] for p in read_version(spark, path, n).paths(path)}
    old = {p for n in gone for p in read_version(spark, path, n).paths(path)} - kept
    drop(spark, [f"{path}/{_PREFIX}{n:08d}" for n in gone])
    drop(spark, sorted(old))
    live = {p.rsplit("/", 1)[0] for p in kept}
    drop(spark, {p.rsplit("/", 1)[0] for p in old} - live)


def part_of(parts, key="fingerprint"):
    """Column: the part of a row."""
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def _write_parts(df, path, parts, metrics=None):
    """Write rows by part; the folder's name, the parts with rows, and the observed counts.

    Rows of a part meet in one task, sorted by key, so a repeated key is seen by the write itself: it
    fails before anything is published.
    """
    name, seen = uuid.uuid4().hex, Observation()
    spark, target = df.sparkSession, f"{path}/data/{name}"
    order = Window.partitionBy("part").orderBy("fingerprint")
    again = F.lag("fingerprint").over(order).eqNullSafe(F.col("fingerprint")) & (F.row_number().over(order) > 1)
    dealt = df.withColumn("part", part_of(parts)).repartition("part").withColumn("_again", again)
    counted = {"rows": F.count(F.lit(1)), "repeated": F.count_if("_again"), **(metrics or {})}
    kept = dealt.observe(seen, *[c.alias(k) for k, c in counted.items()]).drop("_again", "_action")
    kept.write.partitionBy("part").parquet(target)
    fs, where, _ = hadoop_path(spark, target)
    names = [e.getPath().getName() for e in fs.listStatus(where)]
    found = [n[len("part="):] for n in names if n.startswith("part=")]
    counts = dict(seen.get) if found else dict.fromkeys(counted, 0)
    if counts.pop("repeated"):
        drop(spark, [target])
        raise ValueError(f"a fingerprint repeats in what is written to {path}")
    return name, found, counts


def write_store(df, path, keep=None, parts=PARTS):
    """Publish `df`, one row per fingerprint, as the next version, all parts new.  Returns its number.

    `keep` is how many of the latest versions stay, all without it; a table that was read from
    one that goes can no longer be read.
    """
    spark = df.sparkSession
    number = max(versions(spark, path), default=0) + 1
    name, found, counts = _write_parts(df, path, parts)
    new = Version(number, parts, dict.fromkeys(found, name), df.schema.jsonValue(), counts)
    _publish(spark, path, new, keep)
    return number


def merge_store(batch, path, schema, keep=None, parts=PARTS, counts=None):
    """Upsert a batch, one row per fingerprint, into the store; the new `Version`.

    The batch should be a written table, as it is read several times.  Only parts with keys of the
    batch are read and written.  `counts` of the version: keys inserted, updated and replayed (older than
    the stored row), rows of the written parts, and those given.  An empty batch publishes no version.
    """
    spark = batch.sparkSession
    columns = schema.names
    actions = {k: F.count_if(F.col("_action") == a) for k, a in (("inserted", "insert"), ("updated", "update"), ("replayed", "replay"))}
    for _ in range(TRIES):
        base = _of_order(read_version(spark, path), path, schema)
        if not base.number:
            base.parts = parts
        touched = [r[0] for r in batch.select(part_of(base.parts)).distinct().collect()]
        if not touched:
            if not base.number:  # an empty store is one that can be read
                write_store(spark.createDataFrame([], schema), path, keep, parts)
                return read_version(spark, path)
            return base
        old = _read_parts(spark, base.paths(path, touched), schema)
        name, found, seen = _write_parts(upsert_actions(old, batch.select(*columns)), path, base.parts, actions)
        folders = {**base.folders, **dict.fromkeys(found, name)}
        new = Version(base.number + 1, base.parts, folders, schema.jsonValue(), {**seen, **(counts or {})})
        try:
            _publish(spark, path, new, keep)
            return new
        except Conflict:
            drop(spark, [f"{path}/data/{name}"])
    raise Conflict(f"{path} is written to all the time")


def store_schema(seq_type):
    return T.StructType(
        [
            *RECORD.fields,
            T.StructField("created_at", T.TimestampType()),
            T.StructField("updated_at", T.TimestampType()),
            T.StructField("_seq", seq_type),
            T.StructField("first_seq", seq_type),
        ]
    )


def _read_parts(spark, paths, schema):
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _of_order(version, path, schema):
    """The version, refused if its rows have another order (`_seq`), which would read as NULL."""
    if version.number:
        kinds = [s["_seq"].dataType.simpleString() for s in (T.StructType.fromJson(version.schema), schema)]
        if kinds[0] != kinds[1]:
            raise ValueError(f"rows of {path} are ordered by {kinds[0]}, not by {kinds[1]}")
    return version


def read_store(spark, path, schema=None, number=None, fingerprints=None):
    """The latest version, or that with a number; empty before the first.

    `fingerprints` reads only the parts that may hold these keys.  A version written with another order
    of rows (`_seq`) is refused.
    """
    version = read_version(spark, path, number)
    if not version.number and schema is None:
        raise FileNotFoundError(f"no complete version under {path}")
    if schema is None:
        schema = T.StructType.fromJson(version.schema)
    elif version.number:
        _of_order(version, path, schema)
    if fingerprints is None:
        return _read_parts(spark, version.paths(path), schema)
    keys = spark.createDataFrame([(k,) for k in fingerprints], "fingerprint string")
    parts = [r[0] for r in keys.select(part_of(version.parts)).distinct().collect()]
    return _read_parts(spark, version.paths(path, parts), schema).filter(F.col("fingerprint").isin(list(fingerprints)))


def store_history(spark, path):
    """(version, name, n): what each version still there counted when it was written."""
    rows = [(n, k, v) for n in versions(spark, path) for k, v in read_version(spark, path, n).counts.items()]
    return spark.createDataFrame(rows, "version int, name string, n bigint")


def record_columns(store):
    """The stored record without bookkeeping columns."""
    return store.select(*[F.col(f.name) for f in RECORD.fields])

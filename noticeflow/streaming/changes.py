"""The same operators over a stream of landed pages.

A micro-batch is stateless up to its records; it is reduced to one row per fingerprint and
written as one change set, replaced as a whole if the batch is replayed.  Change sets are
folded into the store by one merge and then deleted, so a stream of small batches does not
rewrite the store each time.  Daily runs and streams over listing pages share one order of rows
and so one store.
"""

import json
from datetime import datetime, timezone

from pyspark.sql import Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeflow.operators.documents import attach_landing, document_fields
from noticeflow.operators.merge import combine_changes, latest_in_batch
from noticeflow.plans.daily import attached_rows, candidates_of, keyed_records, working_rows
from noticeflow.schema import conform
from noticeflow.sources.landed import registered_pages
from noticeflow.sources.scratch import drop, exists, read_text, stage, write_text
from noticeflow.sources.store import complete, merge_store, store_schema, versions

_PREFIX = "changes-"
#: Counts of a change set, beside its files; readers of the table pass over names with an underscore.
_COUNTS = "_counts.json"
# order of rows within a batch
ORDER = ("source_ord", "fetched_at", "pos")


def page_records(pages, sources, fields, conf, written_at, answers=None):
    """Keyed records of landed pages, stateless, as a stream if `pages` is one.

    `fields` (one row per document) and `answers` (one row per request, see
    `plans.daily.landed_answers`) are joined by every micro-batch: pass written tables.
    """
    found = candidates_of(registered_pages(pages, sources), conf)
    rows = working_rows(found.withColumn("_seq", F.struct(*ORDER)), fields, conf, answers)
    keyed = keyed_records(rows, conf).select("*", "_seq.*").drop("_seq")
    return conform(keyed, keep=ORDER).withColumn("written_at", written_at)


def landing_records(pages, documents, sources, conf, written_at, wait="1 day", late="1 hour", answers=None):
    """`page_records` where documents are a stream too, so that one landing after its page still reaches the record.

    `wait` is how far apart page and document may be fetched, `late` how late either may land.  The record
    of a candidate takes its place in the order by the later of both fetches, so of several fetches of
    a document the last one stays.
    """
    found = candidates_of(registered_pages(pages.withWatermark("fetched_at", late), sources), conf)
    fields = document_fields(documents.withWatermark("fetched_at", late), conf.document_dir, keep=("fetched_at",))
    attached = attach_landing(found, fields, wait)
    order = F.struct("source_ord", F.col("_landed").alias("fetched_at"), "pos")
    rows = attached_rows(attached.withColumn("_seq", order), conf, answers)
    keyed = keyed_records(rows, conf).select("*", "_seq.*").drop("_seq")
    return conform(keyed, keep=ORDER).withColumn("written_at", written_at)


def row_counts():
    """What a micro-batch counts while it is written: records, and those with, without and with an unreadable document."""
    wants = F.coalesce(F.col("notification_url"), F.lit("")) != ""
    found = F.coalesce(F.col("document_hash"), F.lit("")) != ""
    conditions = {"records": F.lit(True), "documents_found": wants & found, "documents_missing": wants & ~found}
    return [F.count_if(c).alias(name) for name, c in conditions.items()]


def change_writer(changes_path, order=ORDER, stream=None):
    """`foreachBatch` function: the batch's latest records as one change set.

    The set's folder is named by stream and batch, so streams and restarts from a new checkpoint
    do not overwrite each other; `stream` defaults to the id that the checkpoint keeps.  The time
    of writing and the columns `order` make `_seq` total across batches and streams.
    """

    def write(batch, batch_id):
        name = stream or batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        now = F.lit(datetime.now(timezone.utc)).cast("timestamp").alias("run_ts")
        spark, seen = batch.sparkSession, Observation()
        ordered = batch.withColumn("_seq", F.struct(now, *order)).drop(*order).observe(seen, *row_counts())
        path = f"{changes_path}/{_PREFIX}{name or 'main'}-{batch_id}"
        latest_in_batch(ordered).write.mode("overwrite").parquet(path)
        write_text(spark, f"{path}/{_COUNTS}", json.dumps(seen.get))

    return write


def start_changes(records, changes_path, checkpoint_path, order=ORDER, trigger=None):
    """Start the stream.  `records` is keyed and has `written_at` and the `order` columns."""
    return (
        records.writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint_path)
        .foreachBatch(change_writer(changes_path, order))
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def seq_type(records, order=ORDER):
    fields = {f.name: f for f in records.schema.fields}
    return T.StructType(
        [T.StructField("run_ts", T.TimestampType()), *[fields[c] for c in order]]
    )


def change_schema(records, order=ORDER):
    return store_schema(seq_type(records, order))


def change_sets(spark, changes_path):
    """Paths of the change sets that were written to the end."""
    return [f"{changes_path}/{name}" for name in complete(spark, changes_path, _PREFIX)]


def read_changes(spark, sets, schema):
    """The rows of change sets, one per fingerprint."""
    return combine_changes(spark.read.schema(schema).parquet(*sets))


def set_counts(spark, sets):
    """Sums of the counts of change sets; a set without any adds none."""
    total = {}
    for path in sets:
        if exists(spark, f"{path}/{_COUNTS}"):
            for name, n in json.loads(read_text(spark, f"{path}/{_COUNTS}")).items():
                total[name] = total.get(name, 0) + n
    return total


def fold_changes(spark, store_path, changes_path, schema, keep=None):
    """Merge all complete change sets into the store and delete them.

    A set that is still being written waits for the next fold.  Should the fold be lost between
    the new version and the deletion, the next one merges the same rows again, which changes nothing
    but the version's counts.  The counts of the sets go to the version (`store_history`).
    Returns the latest version's number, 0 for none.
    """
    sets = change_sets(spark, changes_path)
    if not sets:
        return max(versions(spark, store_path), default=0)
    staged = []
    try:
        changes = stage(read_changes(spark, sets, schema), staged=staged)
        number = merge_store(changes, store_path, schema, keep, counts=set_counts(spark, sets)).number
        drop(spark, sets)
    finally:
        drop(spark, staged)
    return number

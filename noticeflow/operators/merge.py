"""Keyed dedup and merge of records."""

from pyspark.sql import functions as F

from noticeflow.functions.text import norm, nz
from noticeflow.operators.numbering import number_rows
from noticeflow.sources.scratch import fits_broadcast

KEY_COLUMNS = ("organisation", "advertisement_number", "post_title", "publication_date")


def fingerprint(columns=KEY_COLUMNS):
    """SHA-256 of the normalised key columns; an absent one counts as blank and keeps its place."""
    return F.sha2(F.array_join(F.array(*[norm(F.col(c)) for c in columns]), "|"), 256)


def with_key(records, columns=KEY_COLUMNS):
    """A supplied fingerprint stays, a blank one is computed."""
    return records.withColumn(
        "fingerprint", F.coalesce(nz(F.col("fingerprint")), fingerprint(columns))
    )


def latest_in_batch(batch, seq="_seq", created="written_at", updated="written_at", first="_seq"):
    """One row per fingerprint: the last one written, first and last write time, first place in the order.

    The aggregate combines before the shuffle, so a key that holds much of the batch sends
    one row per task.
    """
    payload = [c for c in batch.columns if c not in ("fingerprint", seq, created, updated, first)]
    return (
        batch.groupBy("fingerprint")
        .agg(
            F.max_by(F.struct(*payload), seq).alias("_row"),
            F.min_by(created, seq).alias("_created"),
            F.max_by(updated, seq).alias("_updated"),
            F.max(seq).alias("_last"),
            F.min(first).alias("_first"),
        )
        .select(
            "fingerprint",
            "_row.*",
            F.col("_created").alias("created_at"),
            F.col("_updated").alias("updated_at"),
            F.col("_last").alias("_seq"),
            F.col("_first").alias("first_seq"),
        )
    )


def combine_changes(changes):
    """Change sets of several batches as one: one row per fingerprint."""
    return latest_in_batch(changes, created="created_at", updated="updated_at", first="first_seq")


def classify(batch, store):
    """(fingerprint, action) for every key of the batch: update if stored, else insert."""
    keys = batch.select("fingerprint").distinct()
    known = store.select("fingerprint", F.lit("update").alias("_known"))
    return keys.join(known, "fingerprint", "left").select(
        "fingerprint", F.coalesce("_known", F.lit("insert")).alias("action")
    )


#: What the first write of a key decides.
_FIRST = ("created_at", "first_seq")


def upsert(store, batch):
    """The store after the batch: last write wins on all columns, first insert time stays.

    Both sides have one row per fingerprint (`latest_in_batch`), so no key is hot.  A batch
    that the planner may broadcast (best read from a written table, whose size is known) is
    joined to the store without a shuffle of it; a larger one meets it in one full join, so the
    store is read once.  A row older than the stored one (a replay) changes nothing.
    """
    return upsert_actions(store, batch).drop("_action")


def upsert_actions(store, batch):
    """`upsert` with `_action`: keep, insert, update or replay."""
    if fits_broadcast(batch):
        return _upsert_small(store, batch)
    names = [c for c in store.columns if c != "fingerprint"]
    old, new = (
        side.select("fingerprint", F.struct(*names).alias(name))
        for side, name in ((store, "_old"), (batch, "_new"))
    )
    stored, wins = F.col("_old").isNotNull(), F.col("_new._seq") >= F.col("_old._seq")
    take = F.coalesce(wins, F.lit(False)) | ~stored
    return old.join(new, "fingerprint", "full").select(
        "fingerprint",
        *[
            F.when(stored if c in _FIRST else ~take, F.col(f"_old.{c}"))
            .otherwise(F.col(f"_new.{c}"))
            .alias(c)
            for c in names
        ],
        _action(stored, F.col("_new").isNotNull(), wins),
    )


def _action(stored, given, wins):
    taken = F.when(wins, "update").otherwise("replay")
    return F.when(~given, "keep").when(~stored, "insert").otherwise(taken).alias("_action")


def _upsert_small(store, batch):
    names = [c for c in store.columns if c != "fingerprint"]
    new = batch.select("fingerprint", F.struct(*names).alias("_new"))
    joined = store.join(new, "fingerprint", "left")
    wins = F.col("_new._seq") >= F.col("_seq")
    merged = joined.select(
        "fingerprint",
        *[
            (
                F.col(c)
                if c in _FIRST
                else F.when(wins, F.col(f"_new.{c}")).otherwise(F.col(c))
            ).alias(c)
            for c in names
        ],
        _action(F.lit(True), F.col("_new").isNotNull(), wins),
    )
    stored = store.select("fingerprint").join(batch.select("fingerprint"), "fingerprint", "left_semi")
    inserts = batch.join(stored, "fingerprint", "left_anti").select("fingerprint", *names)
    return merged.unionByName(inserts.withColumn("_action", F.lit("insert")))


def assert_unique(store):
    """One row of totals, failing the job when a fingerprint repeats."""
    per_key = store.groupBy("fingerprint").agg(F.count("*").alias("n"))
    totals = per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_keys")
    )
    broken = F.assert_true(F.col("n_rows") == F.col("n_keys"), "a fingerprint repeats")
    return totals.filter(broken.isNull())


def encode_list(c):
    return F.to_json(F.coalesce(c, F.array().cast("array<string>")))


def decode_list(c):
    """JSON text to a list; blank or undecodable text is an empty list."""
    return F.coalesce(F.from_json(nz(c), "array<string>"), F.array().cast("array<string>"))


def to_interchange(store):
    """Dates as ISO text, flags as 0/1, lists as JSON text."""
    cols = []
    for f in store.schema.fields:
        c, kind = F.col(f.name), f.dataType.typeName()
        if kind == "date":
            c = c.cast("string")
        elif kind == "boolean":
            c = c.cast("int")
        elif kind == "array":
            c = encode_list(c)
        cols.append(c.alias(f.name))
    return store.select(*cols)


def with_id(store, order=("first_seq", "fingerprint")):
    """Optional surrogate number in the order in which keys were first written."""
    return number_rows(store, [F.col(c).asc_nulls_first() for c in order], "id")

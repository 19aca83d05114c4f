import hashlib
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeflow.operators import merge
from noticeflow.operators.numbering import number_rows
from noticeflow.schema import conform
from noticeflow.sources import store as store_io

DAY = [datetime(2024, 1, d) for d in range(1, 10)]


def batch(spark, rows):
    """(seq, key, title, day)"""
    df = spark.createDataFrame(
        rows, "_seq bigint, fingerprint string, post_title string, written_at timestamp"
    )
    return conform(df, keep=("_seq", "written_at"))


def state(store):
    return {
        r.fingerprint: (r.post_title, r.created_at, r.updated_at, r._seq)
        for r in store.collect()
    }


def latest(spark, rows):
    return merge.latest_in_batch(batch(spark, rows))


def test_fingerprint(spark):
    rows = [
        (" Org\xa0", "A|1", "T", date(2024, 1, 2)), (None, "A", None, None), ("A", None, "", None), ("", "", "", None),
    ]
    df = spark.createDataFrame(rows, "organisation string, advertisement_number string, post_title string, publication_date date")
    got = [r.f for r in df.select(merge.fingerprint().alias("f")).collect()]
    raw = ["org|a|1|t|2024-01-02", "|a||", "a|||", "|||"]
    assert got == [hashlib.sha256(x.encode()).hexdigest() for x in raw]


def test_upsert_by_rule(spark):
    store = latest(spark, [(1, "a", "a1", DAY[0]), (2, "b", "b1", DAY[0]), (3, "a", "a2", DAY[1])])
    assert state(store) == {"a": ("a2", DAY[0], DAY[1], 3), "b": ("b1", DAY[0], DAY[0], 2)}
    new = latest(spark, [(4, "b", "", DAY[2]), (5, "c", "c1", DAY[2]), (6, "c", "c2", DAY[3])])
    merged = merge.upsert(store, new)
    assert state(merged) == {
        "a": ("a2", DAY[0], DAY[1], 3), "b": ("", DAY[0], DAY[2], 4), "c": ("c2", DAY[2], DAY[3], 6),
    }
    # merging again changes nothing; an older batch changes nothing
    assert state(merge.upsert(merged, new)) == state(merged)
    assert state(merge.upsert(merged, store)) == state(merged)
    later = latest(spark, [(7, "c", "c2", DAY[5])])
    assert state(merge.upsert(merged, later))["c"] == ("c2", DAY[2], DAY[5], 7)
    assert {(r.fingerprint, r.action) for r in merge.classify(new, store).collect()} == {("b", "update"), ("c", "insert")}


def test_upsert_into_an_empty_store(spark):
    new = latest(spark, [(1, "a", "a1", DAY[0])])
    empty = new.filter("false")
    assert state(merge.upsert(empty, new)) == state(new)
    assert state(merge.upsert(new, empty)) == state(new)


def test_hot_key_is_combined_before_the_shuffle(spark):
    rows = spark.range(30000).select(
        F.col("id").alias("_seq"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("fingerprint"),
        F.col("id").cast("string").alias("post_title"), F.lit(DAY[0]).cast("timestamp").alias("written_at"),
    )
    agg = merge.latest_in_batch(conform(rows, keep=("_seq", "written_at")))
    assert agg.filter("fingerprint = 'hot'").first().post_title == "29997"
    assert agg.count() == 20001
    assert "partial_max_by" in agg._jdf.queryExecution().executedPlan().toString()


def test_small_batch_does_not_shuffle_the_store(spark, scratch):
    big = spark.range(50000).select(
        F.col("id").alias("_seq"), F.sha2(F.col("id").cast("string"), 256).alias("fingerprint"),
        F.lit("t").alias("post_title"), F.lit(DAY[0]).cast("timestamp").alias("written_at"),
    )
    merge.latest_in_batch(conform(big, keep=("_seq", "written_at"))).write.parquet(f"{scratch}/store")
    latest(spark, [(60000, "new", "n", DAY[1])]).write.parquet(f"{scratch}/batch")
    store, new = (spark.read.parquet(f"{scratch}/{n}") for n in ("store", "batch"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(1 << 20))
    try:
        merged = merge.upsert(store, new)
        plan = merged._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    head = plan.split("Union")[1].split("BroadcastHashJoin")[0]
    assert "Exchange hashpartitioning" not in head
    assert merged.count() == 50001


def test_large_batch_reads_the_store_once(spark):
    store = latest(spark, [(1, "a", "a1", DAY[0]), (2, "b", "b1", DAY[0])])
    new = latest(spark, [(3, "b", "", DAY[2]), (4, "c", "c1", DAY[2])])
    small = state(merge.upsert(store, new))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        merged = merge.upsert(store, new)
        assert state(merged) == small
        assert state(merge.upsert(merged, store)) == small
        assert {r.fingerprint: r.first_seq for r in merged.collect()} == {"a": 1, "b": 2, "c": 4}
        plan = merged._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join") == 1 and "Union" not in plan
        assert {(r.fingerprint, r.action) for r in merge.classify(new, store).collect()} == {("b", "update"), ("c", "insert")}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_uniqueness_check(spark):
    ok = spark.createDataFrame([("a",), ("b",)], "fingerprint string")
    assert tuple(merge.assert_unique(ok).first()) == (2, 2)
    assert tuple(merge.assert_unique(ok.filter("false")).first()) == (0, 0)
    with pytest.raises(Exception, match="repeats"):
        merge.assert_unique(ok.union(ok)).collect()


def test_lists_as_text(spark):
    df = spark.createDataFrame([(["é", 'q"'],), ([],), (None,)], "v array<string>")
    texts = [r.t for r in df.select(merge.encode_list(F.col("v")).alias("t")).collect()]
    assert texts == ['["é","q\\""]', "[]", "[]"]
    back = spark.createDataFrame([(t,) for t in [*texts, "", None, "[cut", '{"a":1}']], "t string")
    got = [r.v for r in back.select(merge.decode_list(F.col("t")).alias("v")).collect()]
    assert got == [["é", 'q"'], [], [], [], [], [], []]


def test_interchange(spark):
    row = merge.to_interchange(latest(spark, [(1, "a", "t", DAY[0])])).first()
    assert (row.source_verified, row.important_instructions, row.publication_date) == (0, "[]", None)


def test_numbering_is_gapless_and_ordered(spark):
    df = spark.range(10000).select((F.col("id") * 7919 % 10000).alias("v"), (F.col("id") % 2).alias("w"))
    rows = number_rows(df, [F.col("w").desc(), F.col("v").asc()]).orderBy("no").collect()
    assert [r.no for r in rows] == list(range(1, 10001))
    assert [(-r.w, r.v) for r in rows] == sorted((-r.w, r.v) for r in rows)


def test_numbering_of_nothing(spark):
    assert number_rows(spark.range(0), [F.col("id").asc()]).collect() == []


def test_ids_follow_first_insert(spark):
    store = latest(spark, [(1, "z", "", DAY[0]), (2, "a", "", DAY[1])])
    assert {(r.id, r.fingerprint) for r in merge.with_id(store).collect()} == {(1, "z"), (2, "a")}


def test_snapshots_count_once_complete(spark, scratch):
    import os

    path = f"{scratch}/store"
    schema = store_io.store_schema(T.LongType())
    assert store_io.read_store(spark, path, schema).count() == 0
    with pytest.raises(FileNotFoundError):
        store_io.read_store(spark, path)
    first = latest(spark, [(1, "a", "a1", DAY[0])]).select(*schema.names)
    assert store_io.write_store(first, path) == 1
    os.makedirs(f"{path}/version=00000002")  # a write that never finished
    assert store_io.versions(spark, path) == [1]
    again = merge.upsert(store_io.read_store(spark, path, schema), latest(spark, [(2, "b", "b", DAY[1])]))
    assert store_io.write_store(again, path) == 2
    assert set(state(store_io.read_store(spark, path, schema))) == {"a", "b"}
    assert store_io.record_columns(store_io.read_store(spark, path)).columns == schema.names[:34]

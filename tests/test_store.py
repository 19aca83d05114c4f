"""Versions of the store, partial merges, racing writers; landed tables in folders by day; the link filter."""

import hashlib
import os
import uuid
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeflow.checks import queries
from noticeflow.operators import documents as docs
from noticeflow.operators.links import discover_links
from noticeflow.operators.merge import latest_in_batch
from noticeflow.plans import daily
from noticeflow.schema import PAGES, conform
from noticeflow.sources import landed, store
from noticeflow.sources.registry import RunConfig, sources_df
from noticeflow.sources.scratch import stage
from noticeflow.streaming import changes

SCHEMA = store.store_schema(T.LongType())
AT = datetime(2024, 1, 1, tzinfo=timezone.utc)


def batch(spark, rows):
    """Rows (seq, key, title) as a staged batch of one row per key."""
    df = spark.createDataFrame(rows, "_seq bigint, fingerprint string, post_title string").withColumn("written_at", F.lit(AT))
    return stage(conform(latest_in_batch(conform(df, keep=("_seq", "written_at"))), keep=("created_at", "updated_at", "_seq", "first_seq")))


def titles(spark, path, **how):
    return {r.fingerprint: r.post_title for r in store.read_store(spark, path, **how).collect()}


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_a_merge_of_one_key_writes_one_part(spark, scratch):
    first = {f"k{i}": f"t{i}" for i in range(400)}
    store.write_store(batch(spark, [(i, k, t) for i, (k, t) in enumerate(first.items())]), scratch)
    before = files(scratch)
    assert len({f.split("part=")[1].split("/")[0] for f in before}) == store.PARTS
    version = store.merge_store(batch(spark, [(1000, "k7", "new")]), scratch, SCHEMA)
    assert len(files(scratch) - before) == 1 and before <= files(scratch)
    assert version.number == 2 and version.counts["updated"] == 1 and version.counts["inserted"] == 0
    assert 1 <= version.counts["rows"] < 40
    assert titles(spark, scratch) == {**first, "k7": "new"}
    assert titles(spark, scratch, number=1) == first
    plan = store.read_store(spark, scratch, fingerprints=["k7"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("part=") <= 1 and titles(spark, scratch, fingerprints=["k7", "no"]) == {"k7": "new"}
    # a replay of an older row changes nothing but says so
    again = store.merge_store(batch(spark, [(3, "k7", "old"), (2000, "fresh", "x")]), scratch, SCHEMA)
    assert (again.counts["replayed"], again.counts["inserted"], again.counts["updated"]) == (1, 1, 0)
    assert titles(spark, scratch) == {**first, "k7": "new", "fresh": "x"}


def test_large_and_small_batches_merge_alike(spark, scratch):
    old, new = [(i, f"k{i}", "old") for i in range(60)], [(100 + i, f"k{i}", "new") for i in range(30, 90)]
    got = []
    for limit in ("10485760", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            path = f"{scratch}/{limit}"
            store.merge_store(batch(spark, old), path, SCHEMA, parts=5)
            version = store.merge_store(batch(spark, new), path, SCHEMA)
            got.append((titles(spark, path), version.counts, version.parts))
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got[0] == got[1] and got[0][1] == {"rows": 90, "inserted": 30, "updated": 30, "replayed": 0} and got[0][2] == 5


def test_racing_writers_lose_nothing(spark, scratch, monkeypatch):
    store.merge_store(batch(spark, [(1, "a", "a1"), (2, "b", "b1")]), scratch, SCHEMA)
    publish, raced = store._publish, []

    def slow(spark_, path, version, keep):
        if not raced:  # another writer comes between our read and our publishing
            raced.append(True)
            store.merge_store(batch(spark_, [(5, "a", "theirs"), (6, "c", "theirs")]), path, SCHEMA)
        return publish(spark_, path, version, keep)

    monkeypatch.setattr(store, "_publish", slow)
    version = store.merge_store(batch(spark, [(7, "b", "ours"), (8, "d", "ours")]), scratch, SCHEMA)
    assert version.number == 3 and titles(spark, scratch) == {"a": "theirs", "c": "theirs", "b": "ours", "d": "ours"}
    raced.clear()
    with pytest.raises(store.Conflict):  # a whole snapshot doesn't know of the other's rows
        store.write_store(batch(spark, [(9, "z", "z")]), scratch)
    assert "z" not in titles(spark, scratch)


def test_a_repeated_fingerprint_is_refused(spark, scratch):
    one = batch(spark, [(1, "a", "x"), (2, "b", "y")])
    with pytest.raises(ValueError, match="repeats"):
        store.write_store(one.union(one.filter("fingerprint = 'a'")), scratch)
    assert store.versions(spark, scratch) == [] and not files(scratch)
    store.write_store(one, scratch)
    twice = stage(one.union(one.filter("fingerprint = 'b'")))
    with pytest.raises(ValueError, match="repeats"):
        store.merge_store(twice, scratch, SCHEMA)
    assert titles(spark, scratch) == {"a": "x", "b": "y"}


def test_old_versions_go_with_the_files_only_they_name(spark, scratch):
    rows = [(i, f"k{i}", "v1") for i in range(200)]
    store.merge_store(batch(spark, rows), scratch, SCHEMA, keep=2)
    for n in range(2, 6):
        store.merge_store(batch(spark, [(1000 * n, "k0", f"v{n}")]), scratch, SCHEMA, keep=2)
    assert store.versions(spark, scratch) == [4, 5]
    assert titles(spark, scratch)["k0"] == "v5" and titles(spark, scratch, number=4)["k0"] == "v4" and len(titles(spark, scratch)) == 200
    named = {p for n in (4, 5) for p in store.read_version(spark, scratch, n).paths(scratch)}
    assert {os.path.dirname(f) for f in files(scratch)} == named
    assert [(r.version, r.n) for r in store.store_history(spark, scratch).filter("name = 'updated'").orderBy("version").collect()] == [(4, 1), (5, 1)]


def test_empty_stores_and_batches(spark, scratch):
    none = stage(spark.createDataFrame([], SCHEMA))
    assert store.merge_store(none, scratch, SCHEMA).number == 1
    assert store.read_store(spark, scratch).count() == 0 == store.read_store(spark, scratch, SCHEMA).count()
    assert store.merge_store(none, scratch, SCHEMA).number == 1
    assert store.merge_store(batch(spark, [(1, None, "null key"), (2, "a", "x")]), scratch, SCHEMA).number == 2
    assert titles(spark, scratch) == {None: "null key", "a": "x"}


def test_stream_counts_reach_the_version(spark, scratch):
    rows = [(1, "a", "x", "u", "h"), (2, "a", "y", "u", ""), (3, "b", "z", "", "")]
    df = spark.createDataFrame(rows, "pos int, fingerprint string, post_title string, notification_url string, document_hash string")
    df = conform(df.withColumn("written_at", F.lit(AT)), keep=("pos", "written_at"))
    schema = changes.change_schema(df, ["pos"])
    write = changes.change_writer(f"{scratch}/changes", ["pos"], "s")
    write(df, 0)
    write(df.filter("pos = 3"), 1)
    changes.fold_changes(spark, f"{scratch}/store", f"{scratch}/changes", schema)
    counts = {r.name: r.n for r in store.store_history(spark, f"{scratch}/store").collect()}
    assert counts == {"rows": 2, "inserted": 2, "updated": 0, "replayed": 0, "records": 4, "documents_found": 1, "documents_missing": 1}


def pages(spark, n=40):
    rows = [(f"https://s{i % 5}.org/", f"https://s{i % 5}.org/", 200, "text/html", f'<a href="{i}.pdf">Notice {i}</a>', AT + timedelta(hours=7 * i)) for i in range(n)]
    return spark.createDataFrame(rows, PAGES)


SOURCES = tuple((f"S{i}", f"https://s{i}.org/", "s", ()) for i in (1, 3))


def test_landed_days_and_registry_prune_the_scan(spark, scratch):
    landed.land(pages(spark), scratch)
    conf = RunConfig(apply_lookback=True, lookback_hours=24)
    run_ts = AT + timedelta(days=5)
    read = daily.in_run(landed.registered_pages(landed.read_pages(spark, scratch), sources_df(spark, SOURCES)), conf, run_ts)
    found = discover_links(landed.good_pages(read), ("notice",))
    plan = found._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "fetch_date" in scan.split("PartitionFilters")[1].split("]")[0] and "In(request_url" in scan
    assert len(os.listdir(scratch)) > 10 and len(read.select("fetch_date").distinct().collect()) <= 2
    flat = daily.in_run(landed.registered_pages(pages(spark), sources_df(spark, SOURCES)), conf, run_ts)
    plain = lambda df: sorted((r.source_name, r.request_url, r.fetched_at) for r in df.collect())
    assert plain(read) == plain(flat) and len(plain(flat)) > 0
    # a registry that is too long to be pushed is joined all the same
    many = SOURCES + tuple((f"M{i}", f"https://m{i}.org/", "s", ()) for i in range(landed.MOST_PUSHED))
    assert plain(daily.in_run(landed.registered_pages(landed.read_pages(spark, scratch), sources_df(spark, many)), conf, run_ts)) == plain(flat)


def test_a_run_on_landed_days_equals_one_on_a_flat_table(spark, scratch):
    landed.land(pages(spark), f"{scratch}/days")
    pages(spark).write.parquet(f"{scratch}/flat")
    spark.createDataFrame([], "request_url string, final_url string, status int, content_type string, content binary, pages array<string>, fetched_at timestamp").write.parquet(f"{scratch}/docs")
    got = []
    for kind in ("days", "flat"):
        conf = RunConfig(pages_path=f"{scratch}/{kind}", documents_path=f"{scratch}/docs", store_path=f"{scratch}/store-{kind}", sources=SOURCES, keywords=("notice",), apply_lookback=True, lookback_hours=60)
        daily.update_store(spark, conf, AT + timedelta(days=6))
        got.append(titles(spark, conf.store_path))
    assert got[0] == got[1] and len(got[0]) >= 2


@pytest.mark.parametrize("n", [0, 1, 300, 5000])
def test_the_link_filter_keeps_every_linked_document(spark, n):
    links = spark.range(n).select(F.concat(F.lit("https://x.org/"), "id").alias("notification_url"))
    documents = spark.range(20_000).select(F.concat(F.lit("https://x.org/"), "id").alias("request_url")).union(spark.createDataFrame([(None,)], "request_url string"))
    kept = {r[0] for r in docs.linked_documents(documents, stage(links)).collect()}
    assert {f"https://x.org/{i}" for i in range(n)} <= kept and None not in kept
    assert len(kept) - n <= 0.075 * (20_000 - n)


def test_the_link_filter_has_a_size(spark, monkeypatch):
    monkeypatch.setattr(docs, "MOST_BITS", 1 << 16)
    links = stage(spark.range(50_000).select(F.concat(F.lit("u"), "id").alias("notification_url")))
    assert docs.link_filter(links, docs.MOST_BITS).count() == 2
    documents = spark.range(50_000).select(F.concat(F.lit("u"), "id").alias("request_url"))
    assert docs.linked_documents(documents, links).count() == 50_000


def test_observed_audit_equals_the_grouped_one(spark, scratch, monkeypatch):
    rows = [(f"https://s{i}.org/", f"https://s{i}.org/", (200, 404, None, 200)[i], "text/html", f'<a href="{i}.pdf">Notice {i}</a><a href="http://[x">y</a>' if i else "", AT) for i in range(4)]
    spark.createDataFrame(rows * 3, PAGES).write.parquet(f"{scratch}/pages")
    document = [("https://s3.org/3.pdf", "https://s3.org/3.pdf", 200, "application/pdf", b"x", None, AT)]
    spark.createDataFrame(document, "request_url string, final_url string, status int, content_type string, content binary, pages array<string>, fetched_at timestamp").write.parquet(f"{scratch}/docs")
    sources = tuple((f"S{i}", f"https://s{i}.org/", "s", ()) for i in range(6))
    got = []
    for most in (64, 0):
        monkeypatch.setattr(daily, "MOST_OBSERVED", most)
        conf = RunConfig(pages_path=f"{scratch}/pages", documents_path=f"{scratch}/docs", store_path=f"{scratch}/store{most}", sources=sources, keywords=("notice",))
        got.append({(r.source_name, r.stage, r.n) for r in daily.update_store(spark, conf, AT).collect()})
    assert got[0] == got[1] and ("S5", "sources_absent", 1) in got[0] and ("S1", "pages_failed", 3) in got[0]
    nothing = RunConfig(**{**conf.__dict__, "sources": (), "store_path": f"{scratch}/none"})
    monkeypatch.setattr(daily, "MOST_OBSERVED", 64)
    assert daily.update_store(spark, nothing, AT).count() == 0


def test_files_are_checked_against_the_manifest(spark, scratch):
    for name, body in (("a.pdf", b"one"), ("b.pdf", b"two"), ("empty.pdf", b"")):
        with open(f"{scratch}/{name}", "wb") as f:
            f.write(body)
    blobs = landed.read_blobs(spark, scratch)
    scan = blobs.select("path", "length")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in scan and "content" in blobs._jdf.queryExecution().executedPlan().toString()
    hashes = {r.file_name: (r.n_bytes, r.document_hash) for r in docs.file_hashes(blobs).collect()}
    assert {k: n for k, (n, _) in hashes.items()} == {"a.pdf": 3, "b.pdf": 3}
    rows = [("a.pdf", hashes["a.pdf"][1]), ("b.pdf", hashes["a.pdf"][1]), ("gone.pdf", "x"), ("empty.pdf", "e")]
    manifest = spark.createDataFrame(rows, "file_name string, document_hash string")
    assert {tuple(r) for r in docs.check_files(manifest, blobs).collect()} == {("a.pdf", "same"), ("b.pdf", "changed"), ("gone.pdf", "missing"), ("empty.pdf", "missing")}


def test_small_documents_share_packs_and_large_ones_are_files(spark, scratch, monkeypatch):
    size = landed.SMALL_BYTES
    texts = {i: f"text {i} \u00e9" for i in range(60)} | {60: "x" * (size - 1), 61: "y" * size, 62: "\u00e9" * size, 63: "", 64: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(2).write.parquet(f"{scratch}/documents.parquet")
    monkeypatch.setattr(queries.scratch, "scratch_path", lambda spark, label="t": f"{scratch}/work/{label}-{uuid.uuid4().hex}")
    got = {r.doc_id: (r.n_bytes, r.document_hash, r.status) for r in queries.s4_landed_files(spark, scratch).collect()}
    bodies = {i: None if t is None else (t + "\n").encode() for i, t in texts.items()}
    assert got == {i: (None, None, "same") if b is None else (len(b), hashlib.sha256(b).hexdigest(), "same") for i, b in bodies.items()}
    folders = [d for top, names, _ in os.walk(f"{scratch}/work") for d in names if d.startswith("doc_id=")]
    assert sorted(folders) == ["doc_id=61", "doc_id=62"]

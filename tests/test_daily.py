import hashlib
import json
import os
from datetime import date, datetime, timezone

import pytest
from pyspark.sql import functions as F

from noticeflow.operators import merge
from noticeflow.operators.links import discover_links
from noticeflow.plans import daily
from noticeflow.schema import DOCUMENTS, PAGES, conform
from noticeflow.sources.landed import read_documents, read_pages, registered_pages
from noticeflow.sources.registry import RunConfig, sources_df, trust_rules
from noticeflow.sources.scratch import scratch_root, stage
from noticeflow.sources.store import read_store
from noticeflow.streaming import changes

SOURCES = (
    ("Alpha", "https://alpha.gov.in/list", "a", ()),
    ("Beta", "https://beta.org/jobs", "b", ()),
    ("Down", "https://down.org/", "c", ()),
    ("Never", "https://never.org/", "d", ()),
)
AT = datetime(2024, 1, 1, tzinfo=timezone.utc)


def land(spark, base, extra_pages=()):
    pages = [
        ("https://alpha.gov.in/list", "https://www.alpha.gov.in/list/", 200, "text/html",
         '<a href="1.pdf">Notice one</a><a href="2.pdf">Notice two</a><a href="/apply">Job: apply</a><a href="/x">Other</a>', AT),
        ("https://beta.org/jobs", "https://beta.org/jobs", 200, "text/html",
         '<a href="https://www.alpha.gov.in/list/1.pdf">Notice one</a><a href="gone.pdf">Post gone</a>', AT),
        ("https://down.org/", "https://down.org/", 503, "text/html", '<a href="/1.pdf">Notice</a>', AT),
        ("https://unknown.org/", "https://unknown.org/", 200, "text/html", '<a href="/1.pdf">Notice</a>', AT),
        *extra_pages,
    ]
    docs = [
        ("https://www.alpha.gov.in/list/1.pdf", "https://www.alpha.gov.in/list/1.pdf", 200, None, b"one",
         ["Advt No. A/1, 12 posts", "Last date 01/02/2024"], AT),
        ("https://www.alpha.gov.in/list/2.pdf", "https://cdn.org/2.pdf", 200, "application/pdf", b"two", None, AT),
        ("https://beta.org/gone.pdf", "https://beta.org/gone.pdf", 404, "application/pdf", b"", ["x"], AT),
    ]
    spark.createDataFrame(pages, PAGES).write.mode("overwrite").parquet(f"{base}/pages")
    spark.createDataFrame(docs, DOCUMENTS).write.mode("overwrite").parquet(f"{base}/docs")


def config(base, **more):
    return RunConfig(
        pages_path=f"{base}/pages", documents_path=f"{base}/docs", store_path=f"{base}/store",
        report_path=f"{base}/report", document_dir="docs", sources=SOURCES, report_date="2024-01-05", **more,
    )


def fp(advert, title, org="", day=""):
    return hashlib.sha256(f"{org}|{advert}|{title}|{day}".lower().encode()).hexdigest()


def test_run_and_report(spark, scratch):
    land(spark, scratch)
    conf = config(scratch)
    result = daily.run(spark, conf, run_ts=datetime(2024, 1, 2, tzinfo=timezone.utc))
    store = {r.fingerprint: r for r in read_store(spark, conf.store_path).collect()}
    # "Notice one" of both sources shares advert and title: the later source overwrites
    assert set(store) == {fp("A/1", "notice one"), fp("", "notice two"), fp("", "job: apply"), fp("", "post gone")}
    one, two = store[fp("A/1", "notice one")], store[fp("", "notice two")]
    assert (one.source_name, one.official_domain, one.source_verified) == ("Beta", "beta.org", False)
    assert (one.vacancies_total, one.application_end_date) == (12, date(2024, 2, 1))
    assert (one.document_hash, one.source_document) == (hashlib.sha256(b"one").hexdigest(), "docs/1.pdf")
    assert (two.document_hash, two.source_document) == (hashlib.sha256(b"two").hexdigest(), "docs/2.pdf")
    assert (two.source_verified, two.official_domain, two.extraction_confidence) == (True, "www.alpha.gov.in", 0.45)
    assert store[fp("", "job: apply")].application_url == "https://www.alpha.gov.in/apply"
    assert store[fp("", "post gone")].document_hash == ""

    audit = {(r.source_name, r.stage): r.n for r in result.audit.collect()}
    assert audit[("Down", "pages_failed")] == 1 and audit[("Alpha", "candidates")] == 3
    assert audit[("Alpha", "documents_found")] == 2 and audit[("Alpha", "documents_unreadable")] == 1
    assert audit[("Beta", "documents_missing")] == 1
    assert audit[("Never", "sources_absent")] == 1 and audit[("Alpha", "pages_unparsable")] == 0
    assert result.totals.first().records == 4
    summary = result.summary.orderBy("no").collect()
    assert [r.no for r in summary] == [1, 2, 3, 4]
    assert summary[3].last_date == "2024-02-01" and summary[0].last_date == "—"
    assert result.detail.count() == 21 * 4
    assert os.path.isdir(f"{conf.report_path}/summary/report_date=2024-01-05")


def test_second_run_updates(spark, scratch):
    land(spark, scratch)
    conf = config(scratch)
    first, second = (datetime(2024, 1, d, tzinfo=timezone.utc) for d in (2, 3))
    daily.update_store(spark, conf, first)
    before = {r.fingerprint: r.asDict() for r in read_store(spark, conf.store_path).collect()}
    daily.update_store(spark, conf, second)
    after = {r.fingerprint: r.asDict() for r in read_store(spark, conf.store_path).collect()}
    assert set(before) == set(after)
    for key, row in after.items():
        assert row["created_at"] == datetime(2024, 1, 2) and row["updated_at"] == datetime(2024, 1, 3)
        changed = {"updated_at", "_seq"}
        assert {k: v for k, v in row.items() if k not in changed} == {
            k: v for k, v in before[key].items() if k not in changed
        }
    report = daily.run(spark, conf, report_only=True)
    assert report.audit is None and report.totals.first().records == 4
    assert len(spark.read.parquet(f"{conf.report_path}/detail").collect()) == 84


def test_overlay_round_trip(spark, scratch):
    land(spark, scratch)
    conf = config(scratch, overlay_enabled=True, responses_path=f"{scratch}/answers")
    asked = daily.pending_requests(spark, conf).collect()
    # both sources ask about the one document that has text
    assert len(asked) == 2 and all("--- PAGE 1 ---" in r.request for r in asked)
    os.makedirs(conf.responses_path)
    with open(f"{conf.responses_path}/a.json", "w") as f:
        for r in asked:
            good = '"source_name":"Alpha"' in r.request
            answer = '{"organisation":"Org","post_title":"Given"}' if good else '{"organisation":7}'
            f.write(json.dumps({"request_id": r.request_id, "response": answer}) + "\n")
    audit = {(r.source_name, r.stage): r.n for r in daily.update_store(spark, conf, AT).collect()}
    assert audit[("Beta", "overlay_rejected")] == 1 and audit[("Alpha", "overlay_rejected")] == 0
    rows = {(r.source_name, r.post_title): r for r in read_store(spark, conf.store_path).collect()}
    given = rows[("", "Given")]
    assert given.organisation == "Org" and given.extraction_confidence == 0.0
    assert given.notification_url.endswith("1.pdf") and given.source_verified
    assert rows[("Beta", "Notice one")].advertisement_number == "A/1"


def test_lookback_is_off_by_default(spark, scratch):
    land(spark, scratch)
    late = datetime(2024, 3, 1, tzinfo=timezone.utc)
    daily.update_store(spark, config(scratch), late)
    assert read_store(spark, f"{scratch}/store").count() == 4
    conf = config(scratch, apply_lookback=True)
    conf = RunConfig(**{**conf.__dict__, "store_path": f"{scratch}/other"})
    daily.update_store(spark, conf, late)
    assert read_store(spark, conf.store_path).count() == 0


def test_settings_without_rules():
    assert trust_rules({}) == ((), ())


def test_stream_equals_batch(spark, scratch):
    """Pages arriving in several micro-batches give the store of one batch over all of them."""
    land(spark, scratch)
    conf = config(scratch)
    fields = stage(daily.fields_by_url(read_documents(spark, conf.documents_path), conf))

    def records(pages):
        at = F.lit(AT).cast("timestamp")
        return changes.page_records(pages, sources_df(spark, SOURCES), fields, conf, at)

    landing = f"{scratch}/landing"
    pages = read_pages(spark, conf.pages_path)
    # one file per page, arriving in two steps, with a fold after each
    urls = sorted(r.request_url for r in pages.select("request_url").collect())
    for step in (urls[:2], urls[2:]):
        for url in step:
            pages.filter(F.col("request_url") == url).coalesce(1).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", 1).parquet(landing)
        batch_records = records(stream)
        schema = changes.change_schema(batch_records)
        changes.start_changes(batch_records, f"{scratch}/changes", f"{scratch}/cp").awaitTermination()
        changes.fold_changes(spark, f"{scratch}/streamed", f"{scratch}/changes", schema)
    streamed = read_store(spark, f"{scratch}/streamed", schema)
    assert streamed.select("_seq.run_ts").distinct().count() > 1
    whole = merge.latest_in_batch(
        records(read_pages(spark, conf.pages_path)).withColumn("_seq", F.struct(*changes.ORDER)).drop(*changes.ORDER)
    )
    plain = lambda df: {r.fingerprint: {k: v for k, v in r.asDict().items() if k not in ("_seq", "first_seq")} for r in df.select(*schema.names).collect()}
    assert plain(streamed) == plain(whole)
    # a replayed fold changes nothing
    changes.fold_changes(spark, f"{scratch}/streamed", f"{scratch}/changes", schema)
    assert plain(read_store(spark, f"{scratch}/streamed", schema)) == plain(whole)


def change_rows(spark, rows):
    df = spark.createDataFrame(rows, "pos int, fingerprint string, post_title string, written_at timestamp")
    return conform(df, keep=("pos", "written_at"))


def titles(spark, path, schema):
    return {r.fingerprint: r.post_title for r in read_store(spark, path, schema).collect()}


def test_replayed_batch_replaces_its_change_set(spark, scratch):
    write = changes.change_writer(f"{scratch}/changes", ["pos"])
    rows = change_rows(spark, [(1, "a", "x", AT), (2, "a", "y", AT)])
    for _ in range(2):
        write(rows, 0)
    assert len(changes.change_sets(spark, f"{scratch}/changes")) == 1
    write(rows.filter("pos = 1"), 1)
    schema = changes.change_schema(rows, ["pos"])
    got = changes.read_changes(spark, changes.change_sets(spark, f"{scratch}/changes"), schema).collect()
    # the later batch wins although its row comes first within it; the first write is kept
    assert [(r.post_title, r.first_seq.pos, r._seq.pos) for r in got] == [("x", 1, 1)]
    assert got[0].first_seq.run_ts < got[0]._seq.run_ts


def test_fold_after_restart_second_stream_and_half_written_set(spark, scratch):
    path, store = f"{scratch}/changes", f"{scratch}/store"
    schema = changes.change_schema(change_rows(spark, []), ["pos"])
    assert changes.fold_changes(spark, store, path, schema) == 0
    changes.change_writer(path, ["pos"], "one")(change_rows(spark, [(1, "a", "old", AT)]), 5)
    changes.fold_changes(spark, store, path, schema)
    # batch numbers start again; another stream uses the same numbers
    changes.change_writer(path, ["pos"], "one")(change_rows(spark, [(1, "a", "new", AT), (2, "b", "b", AT)]), 0)
    changes.change_writer(path, ["pos"], "two")(change_rows(spark, [(1, "c", "c", AT)]), 0)
    changes.change_writer(path, ["pos"], "two")(change_rows(spark, [(1, "d", "d", AT)]), 1)
    os.remove(f"{path}/changes-two-1/_SUCCESS")
    changes.fold_changes(spark, store, path, schema)
    assert titles(spark, store, schema) == {"a": "new", "b": "b", "c": "c"}
    assert changes.change_sets(spark, path) == []
    # the half-written set counts once it is complete
    open(f"{path}/changes-two-1/_SUCCESS", "w").close()
    changes.fold_changes(spark, store, path, schema, keep=2)
    assert titles(spark, store, schema)["d"] == "d"
    assert len([n for n in os.listdir(store) if n.startswith("version=")]) == 2


def test_store_of_another_order_is_refused(spark, scratch):
    schema = changes.change_schema(change_rows(spark, []), ["pos"])
    changes.change_writer(f"{scratch}/changes", ["pos"])(change_rows(spark, [(1, "a", "x", AT)]), 0)
    changes.fold_changes(spark, f"{scratch}/store", f"{scratch}/changes", schema)
    with pytest.raises(ValueError, match="ordered by"):
        read_store(spark, f"{scratch}/store", daily.store_schema(daily.SEQ))


def test_page_stream_and_daily_run_share_one_order(spark):
    rows = spark.createDataFrame([], "source_ord int, fetched_at timestamp, pos int")
    assert changes.seq_type(rows).simpleString() == daily.SEQ.simpleString()


def test_repeated_snapshots_and_answers(spark, scratch):
    land(spark, scratch)
    pages = spark.read.parquet(f"{scratch}/pages")
    again = pages.filter("request_url like '%alpha%'").withColumn("fetched_at", F.col("fetched_at") + F.expr("interval 1 hour"))
    again.write.mode("append").parquet(f"{scratch}/pages")
    conf = config(scratch, overlay_enabled=True)
    asked = daily.pending_requests(spark, conf).collect()
    assert len(asked) == len({r.request_id for r in asked}) == 2
    plain = {(r.source_name, r.stage): r.n for r in daily.update_store(spark, conf, AT).collect()}
    conf = config(scratch, overlay_enabled=True, responses_path=f"{scratch}/answers")
    os.makedirs(conf.responses_path)
    for k, title in enumerate(("First", "Second", None)):
        answer = json.dumps({"post_title": title} if title else {"post_title": 7})
        file = f"{conf.responses_path}/{k}.json"
        with open(file, "w") as f:
            f.writelines(json.dumps({"request_id": r.request_id, "response": answer}) + "\n" for r in asked)
        os.utime(file, (1700000000 + k, 1700000000 + k))
    assert daily.pending_requests(spark, conf).count() == 0
    audit = {(r.source_name, r.stage): r.n for r in daily.update_store(spark, conf, AT).collect()}
    assert all(audit[key] == n for key, n in plain.items())
    assert {r.post_title for r in read_store(spark, conf.store_path).collect()} >= {"Second"}


def test_documents_of_other_runs_are_not_read_into_fields(spark, scratch):
    land(spark, scratch)
    conf = config(scratch)
    documents = read_documents(spark, conf.documents_path)
    links = stage(spark.createDataFrame([("https://www.alpha.gov.in/list/2.pdf",)], "notification_url string"))
    assert [r.request_url for r in daily.fields_by_url(documents, conf, links).collect()] == [links.first()[0]]
    assert daily.fields_by_url(documents, conf).count() == 2
    for limit in ("-1", "10485760"):  # one plan for any number of links
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            plan = daily.fields_by_url(documents, conf, links)._jdf.queryExecution().optimizedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        # fields stand above the filter, so texts that no link names are not read into them
        assert plan.index("document_hash") < plan.index("Join LeftSemi") and "sha2" not in plan[plan.index("Join LeftSemi"):]
    assert daily.in_run(documents, config(scratch, apply_lookback=True), datetime(2024, 3, 1, tzinfo=timezone.utc)).count() == 0


def test_working_tables_are_deleted(spark, scratch):
    land(spark, scratch)
    root = f"{scratch_root(spark)}/noticeflow"
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    daily.update_store(spark, config(scratch), AT)
    assert len(set(os.listdir(root)) - before) == 1  # the audit


def test_discovery_in_a_stream_is_stateless(spark, scratch):
    land(spark, scratch)
    stream = read_pages(spark, f"{scratch}/pages", streaming=True)
    named = registered_pages(stream, sources_df(spark, SOURCES))
    assert discover_links(named).isStreaming


@pytest.mark.parametrize("n", [0, 1])
def test_report_of_few_records(spark, scratch, n):
    rows = spark.range(n).select(
        F.lit("f").alias("fingerprint"), F.lit("").alias("post_title"), F.lit(0).cast("bigint").alias("vacancies_total"),
        F.lit("S").alias("salary"), F.lit(0.125).alias("extraction_confidence"), F.lit("http://a").alias("application_url"),
    )
    result = daily.report(spark, config(scratch), conform(rows))
    detail = {r.label: (r.value, r.target, r.heading) for r in result.detail.collect()}
    assert len(detail) == 21 * n
    if n:
        assert detail["Vacancies"][0] == "Not stated" and detail["Pay"][0] == "S"
        assert detail["Extraction confidence"][0] == "12%"
        assert detail["Application website"] == ("Apply Online", "http://a", "Recruitment Notice")
        assert detail["Official notification"][:2] == ("", None)
        assert detail["Source verification"][0] == "Could not verify official government domain."

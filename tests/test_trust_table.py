"""Verdicts by a table of rules against the literal rules, and documents that land after their page."""

import os
import time
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from noticeflow.functions.trust import is_trusted_domain
from noticeflow.operators import trust
from noticeflow.plans import daily
from noticeflow.schema import DOCUMENTS, PAGES
from noticeflow.sources.landed import read_documents
from noticeflow.sources.registry import RunConfig, sources_df, trust_rules_df
from noticeflow.sources.store import read_store
from noticeflow.streaming import changes

AT = datetime(2024, 1, 1, tzinfo=timezone.utc)
HOSTS = ["", "a", "a.", ".a", "a..b", "x.gov.in", "gov.in", "xgov.in", "evil-gov.in", "www.alpha.org", "alpha.org", "alpha.org.evil.com", "é.org", "deep.er.alpha.org", "a" * 300 + ".org", None]


def test_rules_in_a_table_equal_literal_rules(spark):
    domains = ("alpha.org", "gov.in", "", "b", ".b", "é.org", "a.")
    suffixes = (".gov.in", "gov.in", "a", ".org.evil.com", "x" * 400)
    hosts = spark.createDataFrame([(i, h) for i, h in enumerate(HOSTS * 3)], "id int, domain string")
    for d, s in ((domains, suffixes), (domains, ()), ((), suffixes), ((), ()), (("alpha.org",), ("",))):
        got = trust.with_verdict(hosts, trust_rules_df(spark, d, s) if d or s else spark.createDataFrame([], "kind string, value string"), "domain", "t")
        want = hosts.withColumn("t", F.coalesce(is_trusted_domain(F.col("domain"), d, s), F.lit(False)))
        # a rule that ends every domain also ends an unknown one only in name
        assert sorted(tuple(r) for r in got.filter("domain is not null").collect()) == sorted(tuple(r) for r in want.filter("domain is not null").collect())
        assert not any(r.t for r in got.filter("domain is null").collect()) and got.count() == len(HOSTS) * 3


def test_many_rules_cost_the_same_plan(spark):
    hosts = spark.range(2000).select(F.concat(F.lit("h.d"), F.col("id") % 700, F.lit(".org")).alias("domain"))
    plans = []
    for n in (100, 100_000):
        rules = spark.range(n).select(F.lit("domain").alias("kind"), F.concat(F.lit("d"), "id", F.lit(".org")).alias("value"))
        out = trust.with_verdict(hosts, rules, "domain", "t")
        assert out.filter("t").count() == sum(i % 700 < n for i in range(2000))
        plans.append(out._jdf.queryExecution().optimizedPlan().toString().count("\n"))
    assert plans[0] == plans[1]


def test_an_ending_that_all_domains_share_is_split(spark):
    hosts = spark.range(100_000).select(F.concat(F.lit("h.d"), F.hex(F.xxhash64("id")), F.lit(".org")).alias("domain"))
    rules = spark.range(0, 200_000, 4).select(F.lit("domain").alias("kind"), F.concat(F.lit("d"), F.hex(F.xxhash64("id")), F.lit(".org")).alias("value"))
    skew = "spark.sql.adaptive.skewJoin.skewedPartition"
    before = spark.conf.get("spark.sql.shuffle.partitions")
    conf = {"spark.sql.autoBroadcastJoinThreshold": "1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k", f"{skew}ThresholdInBytes": "64k", f"{skew}Factor": "1.5"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        found = trust.trusted_domains(hosts, rules)
        assert len(found.collect()) == 25_000
        assert "skew=true" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in conf:
            spark.conf.unset(k)
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_an_ending_that_all_domains_share_is_looked_up_in_parts(spark, monkeypatch):
    """No join key has many more rows than a part holds, whatever share of the domains has an ending; verdicts stay."""
    monkeypatch.setattr(trust, "PART_ROWS", 500)
    hosts = spark.range(20_000).select(F.concat(F.lit("h.d"), F.hex(F.xxhash64("id")), F.when(F.col("id") % 4 == 0, ".gov.in").otherwise(".x.org")).alias("domain"))
    keys = hosts.select("domain", F.explode(trust.rule_keys(F.col("domain"), [4])).alias("k")).select("domain", "k.*")
    for ending in (("domain", "gov.in"), ("suffix", "v.in"), ("suffix", ".org"), ("domain", "none.org")):
        own = spark.range(0, 20_000, 40).select(F.lit("domain").alias("kind"), F.concat(F.lit("d"), F.hex(F.xxhash64("id")), F.lit(".gov.in")).alias("value"))
        rules = own.union(spark.createDataFrame([ending, ending, ("suffix", "....")], "kind string, value string"))
        dealt, looked_up = trust.spread(keys, rules.distinct())
        most = dealt.groupBy("kind", "value", "part").count().agg(F.max("count")).first()[0]
        assert keys.groupBy("kind", "value").count().agg(F.max("count")).first()[0] == 15_000 and most < 1000
        assert looked_up.select("kind", "value").distinct().count() == rules.distinct().count() < looked_up.count() + (ending[1] == "none.org")
        want = {"gov.in": 5000, "v.in": 5000, ".org": 15_500, "none.org": 500}[ending[1]]
        assert trust.trusted_domains(hosts, rules).count() == want
    assert trust.trusted_domains(hosts.limit(0), rules).count() == 0 == trust.trusted_domains(hosts, rules.limit(0)).count()


def test_domains_are_shuffled_once_for_both_uses(spark, monkeypatch):
    monkeypatch.setattr(trust, "PART_ROWS", 100)
    hosts = spark.range(2000).select(F.concat(F.lit("h.d"), F.col("id") % 700, F.lit(".org")).alias("domain"))
    rules = spark.range(100).select(F.lit("domain").alias("kind"), F.concat(F.lit("d"), "id", F.lit(".org")).alias("value"))
    out = trust.with_verdict(hosts, rules, "domain", "t")
    assert len(out.collect()) == 2000
    assert "ReusedExchange" in out._jdf.queryExecution().executedPlan().toString()


def test_a_run_with_a_long_trust_list_equals_one_with_a_short_one(spark, scratch):
    pages = [("https://a.org/", "https://a.org/", 200, "text/html", '<a href="1.pdf">Notice one</a>', AT), ("https://b.gov.in/", "https://b.gov.in/", 200, "text/html", '<a href="2.pdf">Notice two</a>', AT)]
    spark.createDataFrame(pages, PAGES).write.parquet(f"{scratch}/pages")
    spark.createDataFrame([], DOCUMENTS).write.parquet(f"{scratch}/docs")
    got = []
    for k, more in enumerate(((), tuple(f"t{i}.org" for i in range(200)))):
        conf = RunConfig(pages_path=f"{scratch}/pages", documents_path=f"{scratch}/docs", store_path=f"{scratch}/s{k}", sources=(("A", "https://a.org/", "a", ()), ("B", "https://b.gov.in/", "b", ())), trusted_domains=("x.org", *more))
        daily.update_store(spark, conf, AT)
        got.append(sorted((r.fingerprint, r.source_verified, r.official_domain) for r in read_store(spark, conf.store_path).collect()))
    assert got[0] == got[1] and [v for _, v, _ in got[0]].count(True) == 1


def land(spark, path, schema, rows):
    for row in rows:  # one file each, in this order
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.02)


def test_a_document_that_lands_after_its_page_reaches_the_record(spark, scratch):
    """Pages and documents as streams, in whatever order they land, give the store of one batch over all of them."""
    conf = RunConfig(documents_path=f"{scratch}/docs", document_dir="docs", sources=(("A", "https://a.org/", "a", ()),))

    def page(h, *links):
        body = "".join(f'<a href="{x}">{"Job" if x == "plain" else "Notice"} {x}</a>' for x in links)
        return ("https://a.org/", "https://a.org/", 200, "text/html", body, AT + timedelta(hours=h))

    def doc(h, name, text):
        return (f"https://a.org/{name}", f"https://a.org/{name}", 200, "application/pdf", text.encode(), [text], AT + timedelta(hours=h))

    def step(pages=(), docs=()):
        land(spark, f"{scratch}/pages", PAGES, pages)
        land(spark, f"{scratch}/docs", DOCUMENTS, docs)
        streams = [spark.readStream.schema(s).parquet(f"{scratch}/{n}") for n, s in (("pages", PAGES), ("docs", DOCUMENTS))]
        out = changes.landing_records(*streams, sources_df(spark, conf.sources), conf, F.lit(AT).cast("timestamp"), wait="6 hours", late="1 hour")
        changes.start_changes(out, f"{scratch}/changes", f"{scratch}/cp").awaitTermination()
        schema = changes.change_schema(out)
        changes.fold_changes(spark, f"{scratch}/store", f"{scratch}/changes", schema)
        return {r.notification_url[14:]: r for r in read_store(spark, f"{scratch}/store", schema).collect()}

    early = doc(0, "early.pdf", "Advt No. E/1, 3 posts")
    first = step([page(1, "early.pdf", "late.pdf", "never.pdf", "far.pdf", "plain")], [early])
    assert set(first) == {"early.pdf", ""} and first["early.pdf"].advertisement_number == "E/1"
    second = step(docs=[doc(4, "late.pdf", "Advt No. L/2, 7 posts"), doc(5, "early.pdf", "Advt No. E/1, 4 posts"), doc(30, "far.pdf", "Advt No. F/9, 1 posts")])
    assert second["late.pdf"].vacancies_total == 7 and second["early.pdf"].vacancies_total == 4
    # the watermark of both streams passes: what never came, or too late, is given out without a document
    third = step([page(60, "next1.pdf")], [doc(60, "other.pdf", "z")])
    third = step([page(61, "next2.pdf")], [doc(61, "another.pdf", "z")])
    assert third["never.pdf"].document_hash == "" == third["far.pdf"].document_hash and third["late.pdf"].vacancies_total == 7
    # the same rows in one batch
    documents = read_documents(spark, f"{scratch}/docs").filter("request_url not like '%far.pdf'")
    fields = daily.fields_by_url(documents, conf)
    pages = spark.read.schema(PAGES).parquet(f"{scratch}/pages")
    batch = changes.page_records(pages, sources_df(spark, conf.sources), fields, conf, F.lit(AT).cast("timestamp"))
    want = {(r.notification_url, r.advertisement_number, r.vacancies_total, r.document_hash, r.fingerprint) for r in batch.collect() if not r.notification_url.endswith(("next1.pdf", "next2.pdf"))}
    assert {(r.notification_url, r.advertisement_number, r.vacancies_total, r.document_hash, r.fingerprint) for r in third.values()} == want
    state = [d for d, _, _ in os.walk(f"{scratch}/cp/state")]
    assert state  # the join's state lives with the checkpoint, bounded by the watermark

import hashlib

from pyspark.sql import functions as F

from noticeflow.functions import documents as fn
from noticeflow.functions.trust import is_trusted
from noticeflow.operators import documents as docs
from noticeflow.operators import links
from noticeflow.operators.records import verify


def test_trust(spark):
    cases = [
        ("https://x.gov.in/a", [], [".gov.in"], True),
        ("https://x.com/a", [], [".gov.in"], False),
        ("https://gov.in/", [], [".gov.in"], False),
        ("https://evilgov.in/", ["gov.in"], [], False),
        ("https://gov.in:443/", ["gov.in"], [], True),
        ("https://a.GOV.in/", ["gov.in"], [], True),
        ("", ["gov.in"], [".gov.in"], False),
    ]
    for url, domains, suffixes, want in cases:
        df = spark.createDataFrame([(url,)], "u string")
        assert df.select(is_trusted(F.col("u"), domains, suffixes)).first()[0] is want


def test_verify_without_any_url(spark):
    df = spark.createDataFrame(
        [("", ""), ("", "https://b.gov.in/x"), ("http://c.org", "https://b.gov.in/x")],
        "official_source_url string, notification_url string",
    )
    rows = verify(df, [], ["", ".gov.in"]).collect()
    assert [(r.official_domain, r.source_verified) for r in rows] == [
        ("", False), ("b.gov.in", True), ("c.org", True),
    ]


def test_pdf_and_status(spark):
    df = spark.createDataFrame(
        [
            ("Application/PDF; q=1", "http://h/x", 200, True, True),
            (None, "http://h/X.PDF", 399, True, True),
            (None, "http://h/x.pdf?dl=1", 400, False, False),
            ("text/html", "http://h/", 599, False, False),
            ("text/html", "http://h/", 600, False, True),
        ],
        "ct string, url string, status int, pdf boolean, ok boolean",
    )
    for r in df.select(fn.is_pdf(F.col("ct"), F.col("url")).alias("p"), fn.ok_status(F.col("status")).alias("o"), "pdf", "ok").collect():
        assert (r.p, r.o) == (r.pdf, r.ok)


def test_page_assembly(spark):
    df = spark.createDataFrame([(["  a ", "", "c\n"],), (None,), ([],)], "p array<string>")
    texts = [r.t for r in df.select(fn.assembled_text(F.col("p")).alias("t")).collect()]
    whole = "--- PAGE 1 ---\n  a \n\n--- PAGE 2 ---\n\n\n--- PAGE 3 ---\nc"
    assert texts == [whole, "", ""]


def landed(spark, rows):
    return spark.createDataFrame(
        rows,
        "request_url string, final_url string, status int, content_type string, content binary, pages array<string>",
    )


def candidates(spark, urls):
    df = spark.createDataFrame(list(enumerate(urls)), "pos int, notification_url string")
    return links.with_seq(df.withColumn("source_ord", F.lit(0)))


def test_lookup_keeps_every_candidate(spark):
    found = landed(
        spark,
        [
            ("u1", "http://h/a.pdf", 200, None, b"one", ["Advt No. A/1"]),
            ("u2", "http://h/b.pdf", 404, None, b"two", ["x"]),
            ("u3", "http://h/c.html", 200, "text/html", b"three", ["x"]),
            ("u4", "http://h/d.pdf", 200, None, b"four", None),
        ],
    )
    fields = docs.document_fields(found, "docs")
    rows = docs.attach_documents(candidates(spark, ["u1", "u2", "u3", "u4", "", "zz", "u1"]), fields)
    got = [
        (r.document.document_hash, r.document.source_document, r.document.has_text, r.document.advertisement_number)
        for r in rows.orderBy("pos").collect()
    ]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    one = (sha(b"one"), "docs/a.pdf", True, "A/1")
    none = ("", "", False, None)
    assert got == [one, none, none, (sha(b"four"), "docs/d.pdf", False, ""), none, none, one]


def test_shared_link_is_split_across_tasks(spark):
    """One link in a third of all candidates, blanks in another: neither sits in one task."""
    n = 60000
    cands = spark.range(n).select(
        F.lit(0).alias("source_ord"), F.col("id").alias("pos"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 3 == 1, F.lit(""))
        .otherwise(F.col("id").cast("string")).alias("notification_url"),
        F.repeat(F.sha2(F.col("id").cast("string"), 256), 4).alias("title"),
    ).repartition(16)
    texts = spark.range(n).select(
        F.when(F.col("id") == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("request_url"),
        F.sha2(F.col("id").cast("string"), 256).alias("document_hash"),
    )
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "200k",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        # unique by an aggregate, as in the daily plan
        fields = docs.latest_documents(texts, "document_hash")
        joined = docs.attach_documents(links.with_seq(cands), fields)
        joined = joined.withColumn("part", F.spark_partition_id())
        rows = joined.groupBy("part").agg(F.count("*").alias("n"), F.count_if(F.col("document.document_hash") != "").alias("hits"), F.max("title"))
        sizes = rows.collect()
        plan = rows._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sum(r.n for r in sizes) == n
    assert sum(r.hits for r in sizes) == n // 3 * 2
    assert "skew=true" in plan
    # in one piece the shared link alone is a third
    assert max(r.n for r in sizes) < n // 3


def test_manifest_keeps_the_last_of_a_name(spark):
    df = spark.createDataFrame(
        [(1, "http://h/a.pdf", "h1"), (3, "http://g/a.pdf", "h3"), (2, "http://h/x/a.pdf", "h2"), (4, "http://h/", "h4")],
        "_seq int, final_url string, document_hash string",
    )
    got = sorted(tuple(r) for r in docs.document_manifest(df).collect())
    assert got == [("a.pdf", "http://g/a.pdf", "h3"), ("document.pdf", "http://h/", "h4")]


def test_latest_fetch_of_a_document(spark):
    df = spark.createDataFrame([("u", 1, "a"), ("u", 2, "b"), ("v", 1, "c")], "request_url string, at int, h string")
    got = sorted((r.request_url, r.h) for r in docs.latest_documents(df, "at").collect())
    assert got == [("u", "b"), ("v", "c")]

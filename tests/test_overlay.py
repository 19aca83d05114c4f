import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from noticeflow import fixed
from noticeflow.checks import derived
from noticeflow.operators import overlay
from noticeflow.operators.records import as_rows, backfill, extract, records_of
from noticeflow.schema import CANDIDATE, RECORD
from noticeflow.sources import scratch as tables

ANSWERS = [
    ('{"organisation":"Étable","vacancies_total":7,"important_instructions":["a","b"],"extra":1}', True),
    ("{}", True),
    ('{"vacancies_total":null,"application_end_date":null}', True),
    ('{"organisation":null}', False),
    ('{"organisation":5}', False),
    ('{"vacancies_total":"many"}', False),
    ('{"vacancies_total":"12"}', True),
    ('{"vacancies_total":12.0}', True),
    ('{"vacancies_total":12.5}', False),
    ('{"application_end_date":"2024-03-01"}', True),
    ('{"application_end_date":"2024-02-31"}', False),
    ('{"application_end_date":"01/03/2024"}', False),
    ('{"source_verified":"yes"}', True),
    ('{"source_verified":"maybe"}', False),
    ('{"source_verified":1}', True),
    ('{"extraction_confidence":"0.5"}', True),
    ('{"extraction_confidence":null}', False),
    ('{"important_instructions":[]}', True),
    ('{"important_instructions":["a",1]}', False),
    ('{"important_instructions":"a"}', False),
    ('{"organisation":"cut', False),
    ("[]", False),
    ('"text"', False),
    ("", False),
    (None, False),
]


@pytest.fixture(scope="module")
def ingested(spark):
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(ANSWERS)], "id int, response string")
    return overlay.ingest_responses(df, ["id"])


def test_validation(ingested):
    rows = ingested.orderBy("id").collect()
    assert [(ANSWERS[r.id][0], r.valid) for r in rows] == ANSWERS


def test_values_and_defaults(ingested):
    assert ingested.schema["record"].dataType.names == RECORD.names
    rows = {r.id: r.record for r in ingested.collect()}
    assert (rows[0].organisation, rows[0].vacancies_total, rows[0].important_instructions) == ("Étable", 7, ["a", "b"])
    empty = rows[1].asDict()
    assert empty.pop("important_instructions") == [] and empty.pop("extraction_confidence") == 0.0
    assert empty.pop("source_verified") is False
    assert {v for v in empty.values()} == {"", None}
    assert rows[6].vacancies_total == rows[7].vacancies_total == 12
    assert rows[9].application_end_date == date(2024, 3, 1)
    assert rows[12].source_verified is True and rows[14].source_verified is True


def working(spark, keys):
    cands = spark.createDataFrame(
        [(i, "S", "http://h.gov.in/list", "Title", "", f"http://h/{i}.pdf", "") for i in keys],
        "id int, source_name string, source_url string, title string, post string, notification_url string, application_url string",
    )
    doc = F.struct(
        (F.col("id") != 3).alias("has_text"), F.lit("hash").alias("document_hash"), F.lit("docs/x").alias("source_document"),
        F.lit("A/1").alias("advertisement_number"), F.lit(9).cast("bigint").alias("vacancies_total"),
        F.lit(None).cast("date").alias("application_start_date"), F.lit(None).cast("date").alias("application_end_date"),
        *[F.lit("").alias(n) for n in fixed.SNIPPETS],
    )
    return extract(as_rows(cands.withColumn("document", doc), ("id",)))


def test_overlay_replaces_whole_records(spark, ingested):
    rows = working(spark, [0, 1, 3, 5, 99])
    got = {r.id: r for r in records_of(backfill(overlay.overlay(rows, ingested, ["id"])), ("id",)).collect()}
    assert len(got) == 5
    kept = [5, 99, 3]  # not valid, no answer, no text (answer 2 of none)
    for i in kept:
        assert (got[i].source_name, got[i].post_title, got[i].extraction_confidence) == ("S", "Title", 0.45)
    for i in (0, 1):
        assert (got[i].source_name, got[i].post_title, got[i].advertisement_number) == ("", "", "")
        assert got[i].notification_url == f"http://h/{i}.pdf"
        assert got[i].official_source_url == "http://h.gov.in/list"
        assert (got[i].document_hash, got[i].source_document) == ("hash", "docs/x")
    off = records_of(overlay.overlay(rows, ingested, ["id"], enabled=False), ("id",)).collect()
    assert {r.source_name for r in off} == {"S"}


def test_requests(spark):
    text = "x" * 120001
    df = working(spark, [1]).withColumn("text", F.lit(text))
    request = overlay.extraction_requests(df, ["id"]).first().request
    head, rest = request.split("\nDISCOVERY:\n")
    candidate, document = rest.split("\nDOCUMENT:\n")
    assert head == fixed.REQUEST_INSTRUCTION and document == "x" * 120000
    parsed = json.loads(candidate)
    assert list(parsed) == CANDIDATE.names
    assert parsed["published_date"] is None and parsed["title"] == "Title"
    none = df.withColumn("candidate", F.lit(None).cast(CANDIDATE))
    assert "\nDISCOVERY:\n{}\nDOCUMENT:\n" in overlay.extraction_requests(none, ["id"]).first().request


def test_partitions_of_answers_grow_with_their_bytes(spark, sf_dir, scratch, monkeypatch):
    """Answers of a few partitions are dealt to more where a partition would grow; rows stay the same."""
    rows = spark.range(4000).selectExpr("id % 2000 as k", "cast(id as int) as at", "concat('{\"organisation\":\"', id, if(id % 3 = 0, '', '\"}')) as response")
    rows.write.parquet(f"{scratch}/answers")
    given = overlay.ingest_responses(spark.read.parquet(f"{scratch}/answers"), ["k", "at"])
    got = []
    for size in (1 << 40, 1 << 12):
        monkeypatch.setattr(tables, "PART_BYTES", size)
        out = overlay.latest_answers(given, ["k"], ["at"])
        got.append((out.rdd.getNumPartitions(), sorted((r.k, r.valid, r.record.organisation) for r in out.collect())))
    assert got[0][0] == 8 < got[1][0] == tables.parts_of(given) and got[0][1] == got[1][1] and len(got[0][1]) == 2000
    assert got[0][1][:3] == [(0, True, "2000"), (1, True, "1"), (2, True, "2002")]
    monkeypatch.setattr(derived, "PART_ROWS", 100)
    n = derived.table(spark, sf_dir, "orders").count()
    assert derived.derived(spark, sf_dir, "overlay_rows").rdd.getNumPartitions() == -(-n // 100)

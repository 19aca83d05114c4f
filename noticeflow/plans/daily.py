"""The daily run: landed pages and documents to store and report."""

from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeflow.operators.audit import (
    MOST_OBSERVED, absent_sources, link_audit, link_stages, observed, observed_audit, page_audit, page_stages, row_audit,
    row_stages, run_audit,
)
from noticeflow.operators.documents import (
    attach_documents, document_fields, document_texts, has_notification, latest_documents, linked_documents,
)
from noticeflow.operators.links import discover_links, link_candidates, linked_pages, with_seq
from noticeflow.operators.merge import latest_in_batch, with_key
from noticeflow.operators.overlay import (
    extraction_requests, ingest_responses, latest_answers, overlay,
)
from noticeflow.operators.records import as_rows, backfill, extract, records_of, verify, verify_by_rules
from noticeflow.operators.report import (
    report_detail, report_summary, run_totals, with_number, with_report_date,
)
from noticeflow.operators.trust import MOST_LITERAL
from noticeflow.schema import CANDIDATE
from noticeflow.sources.landed import (
    good_pages, in_lookback, read_documents, read_pages, read_responses, registered_pages,
)
from noticeflow.sources.registry import sources_df, trust_rules_df
from noticeflow.sources.scratch import drop, stage
from noticeflow.sources.store import merge_store, read_store, read_version, store_schema

SEQ = T.StructType(
    [
        T.StructField("run_ts", T.TimestampType()),
        T.StructField("source_ord", T.IntegerType()),
        T.StructField("fetched_at", T.TimestampType()),
        T.StructField("pos", T.IntegerType()),
    ]
)


@dataclass
class RunResult:
    summary: DataFrame
    detail: DataFrame
    totals: DataFrame
    audit: Any = None
    # keys inserted, updated and replayed by the merge that made the stored version
    counts: Any = None


CARRIED = ("source_ord", "fetched_at")


def candidates_of(pages, conf):
    """Candidates of the good pages of registered sources."""
    return discover_links(good_pages(pages), conf.keywords, conf.links_per_page, keep=CARRIED)


def request_id():
    """Name of a (document, candidate) pair, the same wherever it is computed."""
    return F.sha2(
        F.concat(F.col("document.document_hash"), F.lit("\n"), F.to_json("candidate")), 256
    )


def fields_by_url(documents, conf, links=None):
    """Fields of the last usable fetch of every document.

    With a table of `links` (`notification_url`), of any size, other documents are left out before
    their texts are read into fields, but for a few that the filter lets through.
    """
    if links is not None:
        documents = linked_documents(documents, links)
    fields = document_fields(documents, conf.document_dir, keep=("fetched_at",))
    return latest_documents(fields, F.struct("fetched_at", "document_hash")).drop("fetched_at")


def landed_answers(spark, conf):
    """One answer per request: the last valid one that landed."""
    answers = ingest_responses(
        read_responses(spark, conf.responses_path), ["request_id", "landed_at", "response"]
    )
    return latest_answers(answers, ["request_id"], ["landed_at", "response"])


def working_rows(candidates, fields, conf, answers=None, keys=("_seq",)):
    """Candidates with document and record, overlaid and back-filled."""
    return attached_rows(attach_documents(candidates, fields), conf, answers, keys)


def attached_rows(attached, conf, answers=None, keys=("_seq",)):
    """`working_rows` of candidates that have their document."""
    rows = extract(as_rows(attached, keys))
    if answers is not None:
        rows = overlay(rows.withColumn("request_id", request_id()), answers, ["request_id"],
                       conf.overlay_enabled)
    return backfill(rows)


def keyed_records(rows, conf, keys=("_seq",)):
    records = records_of(rows, keys)
    if len(conf.trusted_domains) + len(conf.trusted_suffixes) > MOST_LITERAL and not rows.isStreaming:
        rules = trust_rules_df(rows.sparkSession, conf.trusted_domains, conf.trusted_suffixes)
        return with_key(verify_by_rules(records, rules))
    return with_key(verify(records, conf.trusted_domains, conf.trusted_suffixes))


def in_run(df, conf, run_ts):
    """With the look-back on, the rows fetched within it."""
    if not conf.apply_lookback:
        return df
    since = run_ts - timedelta(hours=conf.lookback_hours)
    return in_lookback(df, "fetched_at", since, run_ts)


def pending_requests(spark, conf, run_ts=None):
    """(request_id, request), one for every candidate whose document has text and that has no answer yet."""
    run_ts = run_ts or datetime.now(timezone.utc)
    pages = registered_pages(read_pages(spark, conf.pages_path), sources_df(spark, conf.sources))
    documents = in_run(read_documents(spark, conf.documents_path), conf, run_ts)
    texts = document_texts(documents, conf.document_dir, ("fetched_at",))
    texts = latest_documents(texts, F.struct("fetched_at", "document_hash"))
    found = candidates_of(in_run(pages, conf, run_ts), conf)
    # equal candidates of repeated fetches are one question; they are made one before texts are joined
    once = with_seq(found.dropDuplicates(CANDIDATE.names), SEQ.names[1:])
    rows = as_rows(attach_documents(once, texts.drop("fetched_at")))
    wanted = rows.filter(F.col("document.text") != "").withColumn("request_id", request_id())
    if conf.responses_path:
        answered = read_responses(spark, conf.responses_path).select("request_id").distinct()
        wanted = wanted.join(answered, "request_id", "left_anti")
    return extraction_requests(
        wanted.withColumn("text", F.col("document.text")), ["request_id"]
    )


def update_store(spark, conf, run_ts):
    """Discover, extract, merge; returns the run's audit."""
    now = F.lit(run_ts).cast("timestamp")
    staged = []
    try:
        return _update_store(spark, conf, run_ts, now, staged)
    finally:
        drop(spark, staged)


def _update_store(spark, conf, run_ts, now, staged):
    sources = sources_df(spark, conf.sources)
    names = list(dict.fromkeys(s[0] for s in conf.sources))
    watched = names if len(names) <= MOST_OBSERVED else []
    pages = in_run(registered_pages(read_pages(spark, conf.pages_path), sources), conf, run_ts)
    seen, page_counts = observed(pages, watched, F.col("source_name"), page_stages())
    # read by discovery and by the document filter: pages are parsed once
    linked = linked_pages(good_pages(seen), conf.keywords, conf.links_per_page, CARRIED)
    linked, link_counts = observed(linked, watched, F.col("source_name"), link_stages())
    linked = stage(linked, staged=staged)
    found = with_seq(link_candidates(linked, CARRIED), SEQ.names[1:], now)
    links = stage(has_notification(found).select("notification_url").distinct(), staged=staged)
    fields = fields_by_url(in_run(read_documents(spark, conf.documents_path), conf, run_ts), conf, links)
    answers = landed_answers(spark, conf) if conf.overlay_enabled and conf.responses_path else None
    rows = working_rows(found, fields, conf, answers)
    rows, row_counts = observed(rows, watched, F.col("candidate.source_name"), row_stages(rows.columns))
    # written as they are: counts are taken by the tasks that write, so a lost shuffle counts no row twice
    rows = stage(rows, staged=staged)
    records = keyed_records(rows, conf).withColumn("written_at", now)
    # joined to the store, with a known size
    batch = stage(latest_in_batch(records), staged=staged)
    merge_store(batch, conf.store_path, store_schema(SEQ), conf.snapshots_kept, conf.store_parts)
    if watched:
        counts = observed_audit(names, page_counts(), link_counts(), row_counts())
        return stage(spark.createDataFrame(counts, "source_name string, stage string, n bigint"))
    return stage(
        run_audit(page_audit(pages), absent_sources(sources, pages), link_audit(linked), row_audit(rows))
    )


def report(spark, conf, store=None):
    """Summary, detail and totals of all stored records."""
    store = read_store(spark, conf.store_path, store_schema(SEQ)) if store is None else store
    numbered = with_number(store)
    return RunResult(report_summary(numbered), report_detail(numbered), run_totals(store))


def write_report(result, conf):
    """Summary and detail under the report date, replaced when the date is written again."""
    day = conf.report_date or None
    for name, df in (("summary", result.summary), ("detail", result.detail)):
        (
            with_report_date(df, day)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("report_date")
            .format(conf.report_format)
            .save(f"{conf.report_path}/{name}")
        )


def run(spark, conf, report_only=False, run_ts=None):
    """One daily run, or only the report on what is stored."""
    audit = None
    if not report_only:
        audit = update_store(spark, conf, run_ts or datetime.now(timezone.utc))
    result = report(spark, conf)
    result.audit = audit
    result.counts = read_version(spark, conf.store_path).counts
    write_report(result, conf)
    return result

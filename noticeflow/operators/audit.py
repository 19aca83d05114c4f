"""Run audit: rows per source and stage."""

from pyspark.sql import Observation
from pyspark.sql import functions as F

from noticeflow.functions.documents import ok_status


def stage_counts(df, source, stages):
    """(source_name, stage, n) of named conditions, one aggregation over `df`."""
    sums = df.groupBy(source.alias("source_name")).agg(
        *[F.count_if(cond).alias(name) for name, cond in stages.items()]
    )
    pairs = F.array(
        *[F.struct(F.lit(n).alias("stage"), F.col(n).alias("n")) for n in stages]
    )
    return sums.select("source_name", F.explode(pairs).alias("p")).select("source_name", "p.*")


#: Registered sources whose counts a write observes, one counter per source and stage; more are counted by grouping.
MOST_OBSERVED = 64


def page_stages():
    """Pages read and pages dropped for an error status, or for none: the fetch was never answered."""
    ok = F.coalesce(ok_status(F.col("status")), F.lit(False))
    return {"pages_ok": ok, "pages_failed": ~ok}


def link_stages():
    """Pages with a link that cannot be parsed, which yield no candidate."""
    return {"pages_linked": F.lit(True), "pages_unparsable": F.col("_links").isNull()}


def observed(df, names, source, stages):
    """`df`, and a function that gives {(source, stage): n} once a write of it has ended: no job reads it for its counts.

    The write should not shuffle `df` first, as a shuffle that is repeated may count rows twice.
    """
    seen = Observation()
    places = [(name, stage) for name in names for stage in stages]
    counters = [F.count_if((source == name) & stages[stage]).alias(f"c{i}") for i, (name, stage) in enumerate(places)]
    if not counters:
        return df, dict
    return df.observe(seen, *counters), lambda: {place: seen.get.get(f"c{i}", 0) for i, place in enumerate(places)}


def observed_audit(names, pages, linked, rows):
    """The rows of `run_audit` from observed counts; a source has the stages that it reached."""
    out = []
    for name in names:
        at = lambda counts, stage: counts.get((name, stage), 0)  # noqa: B023, E731 - called at once
        if at(pages, "pages_ok") + at(pages, "pages_failed") == 0:
            out.append((name, "sources_absent", 1))
        for counts, reached in ((pages, ("pages_ok", "pages_failed")), (linked, ("pages_linked",)), (rows, ("candidates",))):
            if sum(at(counts, stage) for stage in reached):
                out += [(n, stage, k) for (n, stage), k in counts.items() if n == name and stage != "pages_linked"]
    return out


def page_audit(pages):
    return stage_counts(pages, F.col("source_name"), page_stages())


def link_audit(linked):
    stages = {k: v for k, v in link_stages().items() if k != "pages_linked"}
    return stage_counts(linked, F.col("source_name"), stages)


def absent_sources(sources, pages):
    """Registered sources without any landed page."""
    landed = pages.select("source_name").distinct()
    absent = sources.select("source_name").join(landed, "source_name", "left_anti")
    return absent.select("source_name", F.lit("sources_absent").alias("stage"), F.lit(1).cast("bigint").alias("n"))


def row_stages(columns):
    """Candidates, their documents, and rejected answers where an overlay was applied."""
    wants = F.coalesce(F.col("candidate.notification_url"), F.lit("")) != ""
    found = F.col("document.document_hash") != ""
    stages = {
        "candidates": F.lit(True),
        "documents_found": wants & found,
        "documents_missing": wants & ~found,
        "documents_unreadable": found & ~F.col("document.has_text"),
    }
    if "answer_valid" in columns:
        stages["overlay_rejected"] = F.col("answer_valid") == F.lit(False)
    return stages


def row_audit(rows):
    return stage_counts(rows, F.col("candidate.source_name"), row_stages(rows.columns))


def run_audit(*audits):
    """Audits of all parts of a run as one table."""
    whole = audits[0]
    for part in audits[1:]:
        whole = whole.unionByName(part)
    return whole.groupBy("source_name", "stage").agg(F.sum("n").alias("n"))

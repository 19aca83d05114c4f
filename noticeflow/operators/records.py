"""Records from candidates and documents: extraction, back-fill, verification.

Working rows carry the struct columns `candidate`, `document` and `record`.
"""

from pyspark.sql import functions as F

from noticeflow.functions.fields import confidence
from noticeflow.functions.text import nz
from noticeflow.functions.trust import is_trusted_domain
from noticeflow.functions.urls import domain_of
from noticeflow.operators.trust import with_verdict
from noticeflow.schema import CANDIDATE, RECORD, default

# blank instead of NULL when the candidate has no document
_TEXT_FIELDS = (
    "advertisement_number", "age_limit", "qualification", "experience", "application_fee",
)
_OTHER_FIELDS = ("vacancies_total", "application_start_date", "application_end_date")


def as_rows(attached, keys=("_seq",)):
    """Attached candidates as working rows without a record yet."""
    have = set(attached.columns)
    cols = [
        (F.col(f.name) if f.name in have else F.lit("" if f.dataType.typeName() == "string" else None))
        .cast(f.dataType)
        .alias(f.name)
        for f in CANDIDATE.fields
    ]
    return attached.select(*keys, F.struct(*cols).alias("candidate"), "document")


def seed():
    """Record fields a candidate supplies, by name."""
    c = lambda name: F.coalesce(F.col(f"candidate.{name}"), F.lit(""))
    return {
        "source_name": c("source_name"),
        "official_source_url": c("source_url"),
        "organisation": c("organisation"),
        "post_title": F.coalesce(nz(F.col("candidate.post")), c("title")),
        "notification_url": c("notification_url"),
        "application_url": c("application_url"),
    }


def extract(rows):
    """Add `record`: the candidate's seed, the document's fields and the fixed confidence."""
    fields = {
        **seed(),
        **{n: F.coalesce(F.col(f"document.{n}"), F.lit("")) for n in _TEXT_FIELDS},
        **{n: F.col(f"document.{n}") for n in _OTHER_FIELDS},
        "extraction_confidence": confidence(),
    }
    record = F.struct(
        *[fields.get(f.name, default(f)).cast(f.dataType).alias(f.name) for f in RECORD.fields]
    )
    return rows.withColumn("record", record)


def backfill(rows):
    """Fill three blank URLs from the candidate; hash and file always come from the document."""
    r = lambda name: F.col(f"record.{name}")
    c = lambda name: F.coalesce(F.col(f"candidate.{name}"), F.lit(""))
    fields = {
        "notification_url": F.coalesce(nz(r("notification_url")), c("notification_url")),
        "application_url": F.coalesce(nz(r("application_url")), c("application_url")),
        "official_source_url": F.coalesce(nz(r("official_source_url")), c("source_url")),
        "source_document": F.coalesce(F.col("document.source_document"), F.lit("")),
        "document_hash": F.coalesce(F.col("document.document_hash"), F.lit("")),
    }
    return rows.withColumn(
        "record",
        F.struct(*[fields.get(f.name, r(f.name)).alias(f.name) for f in RECORD.fields]),
    )


def records_of(rows, keys=("_seq",)):
    return rows.select(*keys, "record.*")


def verify(records, domains, suffixes):
    """Verdict and domain of the official source, or of the notification where there is none."""
    url, judged = _judged(records)
    verdict = is_trusted_domain(F.col("official_domain"), domains, suffixes)
    return judged.withColumn("source_verified", F.when(url != "", verdict).otherwise(F.lit(False)))


def verify_by_rules(records, rules):
    """`verify` by a table of rules (`kind`, `value`) of any number."""
    url, judged = _judged(records)
    ruled = with_verdict(judged, rules)
    return ruled.withColumn("source_verified", (url != "") & F.col("source_verified"))


def _judged(records):
    url = F.coalesce(nz(F.col("official_source_url")), nz(F.col("notification_url")), F.lit(""))
    return url, records.withColumn("official_domain", domain_of(url))

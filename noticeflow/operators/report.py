"""Report tables: ordered summary and label/value detail."""

from pyspark.sql import functions as F

from noticeflow import fixed
from noticeflow.functions.text import nz
from noticeflow.operators.numbering import number_rows

_USED = (
    "organisation", "ministry_department", "post_title", "vacancies_total", "advertisement_number",
    "notification_number", "publication_date", "application_start_date", "application_end_date",
    "qualification", "experience", "age_limit", "age_relaxation", "pay_level", "pay_scale",
    "salary", "application_fee", "selection_process", "job_location", "application_url",
    "notification_url", "source_verified", "extraction_confidence", "fingerprint",
)


def order_columns():
    """End date (none first), organisation by bytes, fingerprint to make the order total."""
    return [
        F.col("application_end_date").asc_nulls_first(),
        F.col("organisation").asc_nulls_first(),
        F.col("fingerprint").asc_nulls_first(),
    ]


def report_order(store):
    return store.orderBy(*order_columns())


def with_number(store):
    """`no` from 1 in report order, with the columns a report needs."""
    used = [c for c in _USED if c in store.columns]
    return number_rows(store.select(*used), order_columns())


def dash(c):
    return F.coalesce(nz(c.cast("string")), F.lit(fixed.BLANK_CELL))


def status_text(verified):
    return F.when(verified, F.lit(fixed.VERIFIED)).otherwise(F.lit(fixed.UNVERIFIED))


def report_summary(numbered):
    return numbered.select(
        "no",
        dash(F.col("organisation")).alias("organisation"),
        dash(F.col("post_title")).alias("post"),
        dash(F.col("application_end_date")).alias("last_date"),
        status_text(F.col("source_verified")).alias("status"),
    )


def not_stated(c, numeric=False):
    """Blank, absent or zero reads as not stated."""
    text = nz(c.cast("string"))
    if numeric:
        text = F.when(c != 0, text)
    return F.coalesce(text, F.lit(fixed.NOT_STATED))


def pay(level, scale, salary):
    return F.coalesce(nz(level), nz(scale), nz(salary))


def link_target(url):
    return nz(url)


def link_field(text, url):
    """Display text and target; nothing without a target."""
    return F.when(
        link_target(url).isNotNull(), F.struct(F.lit(text).alias("text"), url.alias("url"))
    )


def verification_text(verified):
    return F.when(verified, F.lit(fixed.VERIFIED_TEXT)).otherwise(F.lit(fixed.UNVERIFIED_TEXT))


def percent(confidence):
    """Whole percent, halves to even."""
    whole = F.bround(F.coalesce(confidence, F.lit(0.0)) * 100, 0).cast("bigint")
    return F.concat(whole.cast("string"), F.lit("%"))


def heading(title):
    return F.coalesce(nz(title), F.lit(fixed.DEFAULT_HEADING))


def report_detail(numbered):
    """(no, heading, ord, label, value, target): the labelled fields of every record, unpivoted in the row."""
    app = link_field(fixed.APPLICATION_LINK_TEXT, F.col("application_url"))
    notif = link_field(fixed.NOTIFICATION_LINK_TEXT, F.col("notification_url"))
    computed = {
        "#pay": not_stated(pay(F.col("pay_level"), F.col("pay_scale"), F.col("salary"))),
        "#application_link": F.coalesce(app["text"], F.lit("")),
        "#notification_link": F.coalesce(notif["text"], F.lit("")),
        "#verification": verification_text(F.col("source_verified")),
        "#confidence": percent(F.col("extraction_confidence")),
    }
    targets = {"#application_link": app["url"], "#notification_link": notif["url"]}
    entries = [
        F.struct(
            F.lit(label).alias("label"),
            (computed[c] if c in computed else not_stated(F.col(c), c == "vacancies_total"))
            .alias("value"),
            targets.get(c, F.lit(None).cast("string")).alias("target"),
        )
        for label, c in fixed.DETAIL_LABELS
    ]
    return numbered.select(
        "no", heading(F.col("post_title")).alias("heading"), F.posexplode(F.array(*entries)).alias("i", "e")
    ).select("no", "heading", (F.col("i") + 1).cast("bigint").alias("ord"), "e.label", "e.value", "e.target")


def with_report_date(df, report_date=None):
    day = F.current_date() if report_date is None else F.lit(report_date).cast("date")
    return df.withColumn("report_date", day)


def run_totals(store):
    return store.agg(F.count("*").alias("records"))

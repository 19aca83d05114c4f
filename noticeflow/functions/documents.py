"""Document columns: status, type, hash and page assembly."""

from pyspark.sql import functions as F

from noticeflow import fixed
from noticeflow.functions.text import strip


def ok_status(status):
    return ~status.between(400, 599)


def is_pdf(content_type, final_url):
    by_type = F.contains(
        F.lower(F.coalesce(content_type, F.lit(""))), F.lit(fixed.PDF_CONTENT_TYPE)
    )
    return by_type | F.lower(final_url).endswith(fixed.PDF_SUFFIX)


def content_hash(content):
    return F.sha2(content, 256)


def assembled_text(pages):
    """Page texts in order, each under its marker; '' when the pages could not be read."""
    head, tail = fixed.PAGE_MARKER
    marked = F.transform(
        pages,
        lambda text, i: F.concat(
            F.lit(head), (i + 1).cast("string"), F.lit(tail), F.coalesce(text, F.lit(""))
        ),
    )
    return F.coalesce(strip(F.array_join(marked, "\n")), F.lit(""))

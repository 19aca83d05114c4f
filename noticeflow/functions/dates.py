"""Day-first dates."""

from pyspark.sql import functions as F

from noticeflow.functions.text import ascii_digits

_DAY_MONTH = r"(3[0-1]|[1-2]\d|0[1-9]|[1-9])([/-])(1[0-2]|0[1-9]|[1-9])\2"
_ANY_DIGITS = rf"(?U)^{_DAY_MONTH}(?:\d{{4}}|\d{{2}})$"
# year pattern and century of each form; year 0 has none
_FORMS = ((r"(?!0000)\d{4}", ""), (r"[0-5]\d|6[0-8]", "20"), (r"69|[7-9]\d", "19"))


def parse_day_first(raw):
    """d/m/Y, d-m-Y, d/m/y or d-m-y to a date; anything else, and year 0, to NULL.

    Two-digit years up to 68 belong to the 2000s, the others to the 1900s.  Each form is
    rewritten to year-month-day; what is left as it was is no date in that order.
    """
    plain = F.octet_length(raw) == F.length(raw)
    text = F.when(plain, raw).when(raw.rlike(_ANY_DIGITS), ascii_digits(raw))
    for year, century in _FORMS:
        text = F.regexp_replace(text, rf"^{_DAY_MONTH}({year})$", rf"{century}$4-$3-$1")
    return text.try_cast("date")

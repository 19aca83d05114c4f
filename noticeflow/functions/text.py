"""Text column helpers with Unicode whitespace semantics."""

import sys
import unicodedata

from pyspark.sql import functions as F

# `\s` of the JVM's Unicode mode lacks the four separator controls that count as blank in text
BLANK = r"[\s\x1c-\x1f]"


def java(pattern, dot_all=False):
    """A plain case-blind pattern in the JVM dialect (Unicode classes and case)."""
    return ("(?isU)" if dot_all else "(?iU)") + pattern.replace(r"\s", BLANK)


def let(value, body):
    """`body` over a value that is evaluated once and named by the lambda variable."""
    return F.transform(F.array(value), body)[0]


def nz(c):
    """NULL for blank text, so that `coalesce` picks the next non-blank value."""
    return F.nullif(c, F.lit(""))


def non_blank(c):
    return F.coalesce(c, F.lit("")) != ""


# what collapsing changes: runs of two or more and single blanks other than a space
_RUNS = rf"(?U)[{BLANK}&&[^ ]]{BLANK}*+| {BLANK}++"


def collapse(c):
    """Runs of whitespace to one space, none at either end."""
    return F.trim(F.regexp_replace(c, _RUNS, " "))


def strip(c):
    return F.regexp_replace(c, rf"(?U)\A{BLANK}++|(?<!{BLANK}){BLANK}++\z", "")


def norm(c):
    """Key part: absent as '', outer whitespace removed, lower case."""
    return F.lower(strip(F.coalesce(c.cast("string"), F.lit(""))))


def has_keyword(text, keywords):
    """Lower-cased text contains any of the keywords (substring, not word)."""
    low = F.lower(text)
    hit = F.lit(False)
    for word in keywords:
        hit = hit | F.contains(low, F.lit(word))
    return hit


def _decimal_digits():
    pairs = [
        (chr(i), str(unicodedata.decimal(chr(i))))
        for i in range(128, sys.maxunicode + 1)
        if chr(i).isdecimal()
    ]
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


_DIGITS = _decimal_digits()


def ascii_digits(c):
    """Decimal digits of any script as 0-9."""
    plain = F.octet_length(c) == F.length(c)
    return F.when(plain, c).otherwise(F.translate(c, *_DIGITS))

"""Field extraction from a document's text."""

from functools import reduce
from operator import or_

from pyspark.sql import functions as F

from noticeflow import fixed
from noticeflow.functions.dates import parse_day_first
from noticeflow.functions.text import ascii_digits, collapse, java, let, nz

# Letters whose case folds onto an ASCII letter without lower-casing to it: a text that
# holds one is always handed to the patterns.
_FOLDING = ("ſ", "ı", "İ")


def _contains_any(c, words):
    return reduce(or_, [F.contains(c, F.lit(w)) for w in words])


class Text:
    """A text column with what allows a cheap test before a pattern runs.

    A byte search for a word every match must contain costs far less than a pattern
    over a long text, and most texts have only a few of the words.
    """

    def __init__(self, text, low, odd):
        self.text, self.low, self.odd = text, low, odd

    def capture(self, pattern, group, words):
        """The group of the first match, '' without one."""
        return F.when(
            self.odd | _contains_any(self.low, words),
            F.regexp_extract(self.text, pattern, group),
        ).otherwise(F.lit(""))


def as_text(c):
    return Text(c, F.lower(c), _contains_any(c, _FOLDING))


def advert_number(text):
    # what follows a gap is never a blank, so gaps needn't give any back
    pattern = java(fixed.ADVERT_NUMBER.replace(r"\s*", r"\s*+"))
    return text.capture(pattern, 1, ("adv", "notification"))


def vacancies_text(text):
    # a run of digits and commas never needs to give anything back to the blank after it
    # and a later digit of a run matches only where its first one does
    pattern = java(r"(?<!\d)(?<!\d,)" + fixed.VACANCIES.replace(r"[\d,]*", r"[\d,]*+").replace(r"\s+", r"\s++"))
    return text.capture(pattern, 1, ("vacancies", "posts", "positions"))


def parse_count(raw):
    """Digits and commas to a 64-bit integer; no digits or a larger number to NULL."""
    return ascii_digits(F.replace(raw, F.lit(","), F.lit(""))).try_cast("bigint")


def labelled_date_text(text, labels, words):
    """The date token after the first label that has one within 100 characters.

    That label decides even if its token is no valid date.
    """
    tokens = [
        nz(text.capture(java(label + fixed.DATE_GAP + fixed.DATE, dot_all=True), 1, [word]))
        for label, word in zip(labels, words)
    ]
    return F.coalesce(*tokens, F.lit(""))


def start_text(text):
    # the first label also matches wherever the second does
    return labelled_date_text(text, fixed.START_LABELS[:1], ("application",))


def end_text(text):
    return labelled_date_text(text, fixed.END_LABELS, ("last", "closing", "application"))


_SNIPPET_WORDS = {
    "age_limit": ("age",),
    "qualification": ("qualification",),
    "experience": ("experience",),
    "application_fee": ("fee",),
}


def snippet_text(text, name):
    return text.capture(java(fixed.SNIPPETS[name][0], dot_all=True), 0, _SNIPPET_WORDS[name])


def clean(found, cap):
    """Whitespace collapsed, capped."""
    return F.substring(collapse(found), 1, cap)


def vacancies(text):
    return parse_count(vacancies_text(text))


def start_date(text):
    return parse_day_first(start_text(text))


def end_date(text):
    return parse_day_first(end_text(text))


def snippet(text, name):
    """A label and what follows it, whitespace collapsed, capped."""
    return clean(snippet_text(text, name), fixed.SNIPPETS[name][1])


def confidence():
    return F.lit(fixed.CONFIDENCE)


def with_text_fields(df, text="text"):
    """Replace a text column by `has_text` and all fields the text yields.

    Taken in steps, so that each pattern runs once.  `let` ends the fused code before the
    last step: fused with the captures it would outgrow what the JVM compiles.
    """
    others = [c for c in df.columns if c != text]
    t = as_text(F.col(text))
    lowered = df.select(*others, F.col(text).alias("_text"), t.low.alias("_low"), t.odd.alias("_odd"))
    t = Text(F.col("_text"), F.col("_low"), F.col("_odd"))
    found = lowered.select(
        *others,
        (F.col("_text") != "").alias("has_text"),
        advert_number(t).alias("advertisement_number"),
        vacancies_text(t).alias("_vacancies"),
        start_text(t).alias("_start"),
        end_text(t).alias("_end"),
        *[snippet_text(t, name).alias(f"_{name}") for name in fixed.SNIPPETS],
    )
    return found.select(
        *others,
        "has_text",
        "advertisement_number",
        parse_count(F.col("_vacancies")).alias("vacancies_total"),
        let(F.col("_start"), parse_day_first).alias("application_start_date"),
        let(F.col("_end"), parse_day_first).alias("application_end_date"),
        *[clean(F.col(f"_{n}"), cap).alias(n) for n, (_, cap) in fixed.SNIPPETS.items()],
    )

import re
import time
from datetime import date

import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from noticeflow import fixed
from noticeflow.functions import fields
from noticeflow.functions.dates import parse_day_first
from noticeflow.functions.text import collapse, norm, strip


def apply(spark, values, fn):
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r.v for r in df.select("i", fn(F.col("t")).alias("v")).orderBy("i").collect()]


def field(fn):
    return lambda c: fn(fields.as_text(c))


DATES = [
    ("31-12-69", date(1969, 12, 31)),
    ("31-12-68", date(2068, 12, 31)),
    ("1/2-2024", None),
    ("1/1/202", None),
    ("29/02/2023", None),
    ("29/02/2024", date(2024, 2, 29)),
    ("01/01/0000", None),
    ("01/01/0001", date(1, 1, 1)),
    ("00/01/2024", None),
    ("1/2/24", date(2024, 2, 1)),
    ("32/01/2024", None),
    ("12/01/२०२४", date(2024, 1, 12)),
    ("१२/01/2024", None),
    ("", None),
]


def test_dates(spark):
    assert apply(spark, [d for d, _ in DATES], parse_day_first) == [v for _, v in DATES]


ADVERTS = [
    ("Advt No. 5", "No."), ("Notification for recruitment", "for"), ("Notification Number 5", "Number"),
    ("Advt No 5", ""), ("ADVT. NO.: 12/2024-R(II)", "12/2024-R(II)"), ("Advertisement No\xa0ABC-1", "ABC-1"),
    ("nothing here", ""), ("", ""), ("Notıfıcatıon No. X/12", "X/12"), ("ADVERTİSEMENT No. Q/77", "Q/77"),
]
COUNTS = [
    ("1 post", None), ("A-2024 Positions", 2024), ("5,, posts", 5), ("1,234 vacancies", 1234),
    ("१२ posts", 12), ("12\xa0POSTS", 12), ("99999999999999999999 posts", None), ("12 poſts", 12),
    ("12\x1cposts", 12), ("1" * 50000, None),
]
ENDS = [
    ("Last date 31/02/2024. Closing date 01/03/2024", None),
    ("Closing date 01/03/2024 then last date " + "x" * 120 + "02/03/2024", date(2024, 3, 1)),
    ("closing date 01/03/2024 last\n date: 05-04-24", date(2024, 4, 5)),
    ("applications end 7/8/2024", date(2024, 8, 7)),
    ("Last date " + "x" * 99 + "1/1/2024", date(2024, 1, 1)),
    ("Last date " + "x" * 100 + "1/1/2024", None),
    ("laſt date 1/1/2024", date(2024, 1, 1)),
    ("Last date given. Last date 2/1/2024", date(2024, 1, 2)),
]


def test_known_answers(spark):
    assert apply(spark, [t for t, _ in ADVERTS], field(fields.advert_number)) == [v for _, v in ADVERTS]
    assert apply(spark, [t for t, _ in COUNTS], field(fields.vacancies)) == [v for _, v in COUNTS]
    assert apply(spark, [t for t, _ in ENDS], field(fields.end_date)) == [v for _, v in ENDS]


def test_snippets(spark):
    texts = ["Age  limit\n18 " + "y" * 200, "x EDUCATIONAL\tQualification " + "z " * 2000, "none", "😀age limit " + "😀" * 200]
    age = apply(spark, texts, field(lambda t: fields.snippet(t, "age_limit")))
    assert age == ["Age limit 18 " + "y" * 96, "", "", "age limit " + "😀" * 99]
    qual = apply(spark, texts, field(lambda t: fields.snippet(t, "qualification")))
    assert qual[1] == "EDUCATIONAL Qualification " + "z " * 599 + "z"


def test_whitespace(spark):
    values = ["\xa0 a \x1c\x1d b \n", " ", "", "a b", "a  b", "\ta", "a\x85b"]
    assert apply(spark, values, collapse) == [" ".join(v.split()) for v in values]
    assert apply(spark, values, strip) == [v.strip() for v in values]
    assert apply(spark, ["  ÀB\xa0", None], norm) == ["àb", ""]


def day_first(token):
    found = re.fullmatch(r"(\d+)([/-])(\d+)\2(\d{4}|\d{2})", token)
    if found is None:
        return None
    day, month, year = (int(found[i]) for i in (1, 3, 4))
    if len(found[4]) == 2:
        year += 2000 if year <= 68 else 1900
    try:
        return date(year, month, day)
    except ValueError:
        return None


def expected(text):
    """What the patterns give for one text, found with the standard library."""

    def find(pattern, group, flags="(?is)"):
        hit = re.compile(flags + pattern).search(text)
        return hit.group(group) if hit else ""

    def labelled(labels):
        tokens = [find(label + fixed.DATE_GAP + fixed.DATE, 1) for label in labels]
        return day_first(next(filter(None, tokens), ""))

    digits = find(fixed.VACANCIES, 1, "(?i)").replace(",", "")
    snippets = {
        name: " ".join(find(pattern, 0).split())[:cap]
        for name, (pattern, cap) in fixed.SNIPPETS.items()
    }
    return snippets | {
        "has_text": bool(text),
        "advertisement_number": find(fixed.ADVERT_NUMBER, 1, "(?i)"),
        "vacancies_total": int(digits) if digits else None,
        "application_start_date": labelled(fixed.START_LABELS),
        "application_end_date": labelled(fixed.END_LABELS),
    }


word = st.sampled_from(
    "Advt Advt. Advertisement Notification No. No Number : - 12/2024 A-7 1,200 45 १२ vacancies POSTS positions post "
    "application applications will start online close end last closing date 01/02/2024 31-02-24 5/6/99 7-8-2001 1/2-2020 "
    "age limit maximum educational essential qualification work experience fee for laſt poſts ıf".split()
)
gap = st.sampled_from([" ", " ", " ", "\n", "  ", "\xa0", "", "\x1c", " " + "x" * 95 + " "])


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck), phases=[Phase.generate])
@given(st.lists(st.lists(st.tuples(word, gap), max_size=25).map(lambda p: "".join(a + b for a, b in p)),
                min_size=150, max_size=250))
def test_random_texts_follow_the_rules(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    rows = fields.with_text_fields(df).orderBy("i").collect()
    bad = [
        (t, k, got[k], v)
        for t, got in zip(texts, rows)
        for k, v in expected(t).items()
        if got[k] != v
    ]
    assert not bad


@pytest.mark.parametrize("table", ["notices", "bulletins"])
def test_derived_texts_follow_the_rules(spark, sf_dir, table):
    from noticeflow.checks.derived import derived

    texts = derived(spark, sf_dir, table)
    want = {r.doc_id: expected(r.text) for r in texts.collect()}
    got = {r.doc_id: r.asDict() for r in fields.with_text_fields(texts).collect()}
    assert {k: {**v, "doc_id": k} for k, v in want.items()} == got


def test_long_runs_take_linear_time(spark):
    texts = ["Notification" + " " * 100_000 + "!", "a" + " " * 100_000 + "b", "1" * 100_000, "1," * 50_000]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    start = time.time()
    got = fields.with_text_fields(df).collect()
    sizes = [r[0] for r in df.select(F.length(strip(F.col("text")))).collect()]
    assert time.time() - start < 30 and len(got) == 4
    assert sizes == [100_013, 100_002, 100_000, 100_000]

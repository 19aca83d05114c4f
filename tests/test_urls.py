import re
from pathlib import PurePosixPath
from urllib.parse import urljoin, urlparse

import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from noticeflow.functions.urls import domain_of, malformed, resolve_url, safe_file_name

DOMAINS = [
    ("http://u:p@h.gov.in/a", "u"),
    ("http://u@h.gov.in:80/", "u@h.gov.in"),
    ("//x.gov.in/a", "x.gov.in"),
    ("x.gov.in/a", ""),
    ("http://a b.gov.in/x", "a b.gov.in"),
    ("HTTPS://WWW.X.org:8443/j?x=1", "www.x.org"),
    (" \thttps://x.gov.in", "x.gov.in"),
    ("https://x.gov.in?q", "x.gov.in"),
    ("", ""),
    ("mailto:a@b", ""),
]

FILES = [
    ("http://h/a/b/", "b"),
    ("http://h", "document.pdf"),
    ("http://h/", "document.pdf"),
    ("http://h/a/b.pdf;x=1?q#f", "b.pdf"),
    ("http://h/a é क्ष%20.pdf", "a_é_क_ष_20.pdf"),
    ("http://h/a/.", "a"),
    ("http://h/a/..", ".."),
    ("http://h/.hidden", ".hidden"),
    ("http://h/x;y/b", "b"),
    ("http://h/a/b;x/", "b_x"),
    ("http://h/²½.pdf", "²½.pdf"),
]


def column(spark, values, fn):
    df = spark.createDataFrame(
        [(i, *v) for i, v in enumerate(values)],
        "i int, " + ", ".join(f"c{k} string" for k in range(len(values[0]))),
    )
    cols = [F.col(f"c{k}") for k in range(len(values[0]))]
    return [r.v for r in df.select("i", fn(*cols).alias("v")).orderBy("i").collect()]


def test_domains(spark):
    got = column(spark, [(u,) for u, _ in DOMAINS], domain_of)
    assert got == [d for _, d in DOMAINS]


def test_file_names(spark):
    assert column(spark, [(u,) for u, _ in FILES], safe_file_name) == [n for _, n in FILES]


BASES = [
    "https://h.org/a/b/c.html?x=1#t",
    "http://h.org",
    "HTTP://H.org/a//b/;p?x",
    "gamma.example.com/jobs",
    "https://h.org/d;par?q",
    "jobs",
]
HREFS = [
    "", "#", "#f", "?", "?y=2", "x.pdf", "./x.pdf", "../x.pdf", "../../../x", "/x/../y", "/./x",
    "/x/y/", "/", "//other.org/z", "///z", "https://o.org/q?w#e", "HTTP://O.org/A", "http://o.org?",
    "mailto:a@b.c", "javascript:void(0)", "http:rel", "https:rel/./x", " /lead", "/trail ", "a\tb",
    ";p", "x;p", "x;", "/a;b/c", "..", ".", "a/..", "a/.", "/a/b/..", "x?a;b", "/x#", "/x?#", "a//b",
    "//", "tel:+1", "http://o.org", "/a//b/./c", "1:x", "é/ü.pdf", "/x.y/.z", "/..z",
]


def test_resolution(spark):
    pairs = [(b, h) for b in BASES for h in HREFS]
    got = column(spark, pairs, resolve_url)
    bad = [(p, g, urljoin(*p)) for p, g in zip(pairs, got) if g != urljoin(*p)]
    assert not bad


RANDOM = {
    "suppress_health_check": list(HealthCheck),
    "phases": [Phase.explicit, Phase.generate],
}
piece = st.sampled_from(list("ab./;?#: %") + ["..", "//", "http:", "https://h", "file:", "x:", "é"])


@settings(max_examples=8, deadline=None, **RANDOM)
@given(st.lists(st.tuples(st.sampled_from(BASES), st.lists(piece, max_size=9).map("".join)),
                min_size=50, max_size=120))
def test_resolution_of_random_links(spark, pairs):
    got = column(spark, pairs, resolve_url)
    bad = [(p, g, urljoin(*p)) for p, g in zip(pairs, got) if g != urljoin(*p)]
    assert not bad


@settings(max_examples=5, deadline=None, **RANDOM)
@given(st.lists(st.lists(piece, max_size=9).map("".join), min_size=50, max_size=120))
def test_file_names_of_random_links(spark, urls):
    def name(u):
        last = PurePosixPath(urlparse(u).path).name
        return re.sub(r"[^\w.-]", "_", last) if last else "document.pdf"

    got = column(spark, [(u,) for u in urls], safe_file_name)
    assert [(u, g) for u, g in zip(urls, got) if g != name(u)] == []


@pytest.mark.parametrize("url,bad", [("http://[x", True), ("http://x]/", True), ("http://[::1]/", False)])
def test_malformed(spark, url, bad):
    assert column(spark, [(url,)], malformed) == [bad]

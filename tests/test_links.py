from pyspark.sql import functions as F

from noticeflow.operators import links

PAGE = """
<a href="Notice 1.pdf">Notice 1</a> <a href="./Notice 1.pdf">Notice  1</a> <a href="/apply">Apply Online</a>
<a href="/job">Job: apply here</a> <a href="/job">Job: apply here</a> <a href="x.PDF?d=1">Career</a> <a href="#f">  </a>
<a href="/post">Post list</a> <a>Vacancy without link</a> <a href="mailto:a@b.in">Employment advert</a>
"""


def discover(spark, html, **options):
    df = spark.createDataFrame([("S", "https://h.gov.in/list/", html)], "source_name string, final_url string, html string")
    return links.discover_links(df, **options).orderBy("pos").collect()


def test_candidates(spark):
    got = [(r.pos, r.title, r.notification_url, r.application_url) for r in discover(spark, PAGE)]
    base = "https://h.gov.in"
    assert got == [
        (0, "Notice 1", base + "/list/Notice 1.pdf", ""),
        (1, "Job: apply here", "", base + "/job"),
        (2, "Career", base + "/list/x.PDF?d=1", ""),
        (3, "Post list", "", ""),
        (4, "Employment advert", "mailto:a@b.in", ""),
    ]
    row = discover(spark, PAGE)[0]
    assert (row.source_name, row.source_url, row.discovery_text) == ("S", base + "/list/", "Notice 1")
    assert (row.organisation, row.post, row.published_date, row.last_date) == ("", "", None, None)


def test_limit_counts_kept_links(spark):
    html = "".join(f'<a href="/x{i % 300}">other</a><a href="/{i % 250}">post</a>' for i in range(1000))
    rows = discover(spark, html)
    assert [r.pos for r in rows] == list(range(200))
    assert len(discover(spark, html, limit=1000)) == 250


def test_unparsable_link_fails_its_page_only(spark):
    df = spark.createDataFrame(
        [("A", "http://a.in/", '<a href="http://[x/">post</a><a href="/1">post</a>'),
         ("B", "http://b.in/", '<a href="http://[x/">other</a><a href="/1">post</a>')],
        "source_name string, final_url string, html string",
    )
    assert [r.source_url for r in links.discover_links(df).collect()] == ["http://b.in/"]


def test_discovery_does_not_shuffle(spark):
    df = spark.createDataFrame([("S", "http://h/", PAGE)], "source_name string, final_url string, html string")
    plan = links.discover_links(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_pages_without_links(spark):
    assert discover(spark, "") == []
    assert discover(spark, "<a href='/x'>nothing</a>") == []

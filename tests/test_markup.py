from pyspark.sql import functions as F

from noticeflow.functions.markup import anchors, decode_entities

CASES = [
    ('<a href="/x">One</a>', [("One", "/x")]),
    ("<A HREF='/x' class=c>One\n <b>two</b>three</A>", [("One two three", "/x")]),
    ("<a class=c href=/x>t</a><a name=n>no</a>", [("t", "/x")]),
    ('<a data-href="/n">no</a><a data-href="/n" href="/y">y</a>', [("y", "/y")]),
    ("<a href>t</a>", [("t", "")]),
    ('<a href="">t</a>', [("t", "")]),
    ('<!-- <a href="/c">c</a> --><a href="/x">a<!-- b -->c</a>', [("a c", "/x")]),
    ('<script>var t="<a href=/s>s</a>";</script><a href=/x>q</a>', [("q", "/x")]),
    ('<a href="/1">one <a href="/2">two</a>', [("one", "/1"), ("two", "/2")]),
    ('<a href="/1">open', [("open", "/1")]),
    ('<a title="x > y" href="/1">t</a>', [("t", "/1")]),
    ('<a href="/p?a=1&amp;b=2">A &amp; B&nbsp;&#65;&#x42; &lt;i&gt; &amp;lt; &nope; &</a>',
     [("A & B AB <i> &lt; &nope; &", "/p?a=1&b=2")]),
    ("<article href=/z>no</article><abbr>n</abbr><a\nhref = '/nl'>nl</a>", [("nl", "/nl")]),
    ('<a href="/1">x<script>hidden</script>y</a>', [("x y", "/1")]),
    ('<a href="/1">  </a>', [("", "/1")]),
    ('<a href="/1" href="/2">t</a>', [("t", "/1")]),
    ("<a href=/1/>t</a>", [("t", "/1/")]),
    ('<a href="/1">a\xa0  b\x1cc</a>', [("a b c", "/1")]),
    ("no anchors at all", []),
    ("", []),
]


def test_anchor_cases(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, html string")
    rows = df.select("i", anchors(F.col("html")).alias("a")).orderBy("i").collect()
    got = [[(x.text, x.href) for x in r.a] for r in rows]
    assert got == [c[1] for c in CASES]


def test_large_pages_stay_off_the_stack(spark):
    html = "<p>" + "x & y <b>z</b> " * 20000 + "".join(
        f'<a class="c{i}" href="/p{i}">item {i}</a>' for i in range(20000)
    ) + '<a href="/last">' + "<i>w</i>" * 20000 + "</a>"
    df = spark.createDataFrame([(html,)], "html string")
    a = df.select(anchors(F.col("html")).alias("a")).first().a
    assert len(a) == 20001
    assert a[20000].text == " ".join(["w"] * 20000)


def test_entities(spark):
    df = spark.createDataFrame([("&eacute;&#233;&#xE9;&#x1F600;&apos;&#0;&#xD800;&;&amp;amp;",)], "t string")
    got = df.select(decode_entities(F.col("t")).alias("v")).first().v
    assert got == "ééé😀'&#0;&#xD800;&;&amp;"


def test_references_of_any_length(spark):
    from noticeflow.functions.markup import decode_entities

    df = spark.createDataFrame([("&#00000065;&#x0000000041;&#99999999999999999999;",)], "t string")
    assert df.select(decode_entities(df.t)).first()[0] == "AA&#99999999999999999999;"

"""Link discovery: listing pages to candidates."""

from pyspark.sql import functions as F

from noticeflow import fixed
from noticeflow.functions.markup import anchor_elements, anchor_href, anchor_text
from noticeflow.functions.text import has_keyword, let
from noticeflow.functions.urls import malformed, resolve_link, url_parts
from noticeflow.schema import CANDIDATE


def matching_links(base, html, keywords):
    """array<string> of `text \\n link` for every anchor whose text holds a keyword.

    One string per link lets `array_distinct` hash instead of comparing pairs; collapsed
    text holds no newline.  A link that cannot be parsed is NULL.
    """
    kept = F.filter(
        F.transform(
            anchor_elements(html),
            lambda e: F.struct(e.alias("element"), anchor_text(e).alias("text")),
        ),
        lambda a: (a["text"] != "") & has_keyword(a["text"], keywords),
    )

    def key(parts, text, href):
        return F.when(
            ~((F.contains(href, F.lit("[")) | F.contains(href, F.lit("]"))) & malformed(href)),
            F.concat(text, F.lit("\n"), resolve_link(base, parts, href)),
        )

    return let(
        url_parts(base),
        lambda parts: F.transform(
            kept, lambda a: let(anchor_href(a["element"]), lambda h: key(parts, a["text"], h))
        ),
    )


def as_link(key):
    text = F.substring_index(key, "\n", 1)
    return F.struct(
        text.alias("text"), F.substring(key, F.length(text) + 2, F.length(key)).alias("href")
    )


def first_seen(keys):
    """Distinct links in order of first appearance."""
    return F.array_distinct(keys)


def first_n(keys, limit):
    return F.slice(keys, 1, limit)


def page_links(base, html, keywords=fixed.KEYWORDS, limit=fixed.LINKS_PER_PAGE):
    """array<struct<text, href>>: keyword links of a page, distinct, the first `limit`.

    The whole step stays within the row, so no page is ever shuffled.  A page with a link
    that cannot be parsed fails as a whole and yields NULL.
    """
    return let(
        matching_links(base, html, keywords),
        lambda keys: F.when(
            ~F.exists(keys, lambda k: k.isNull()),
            F.transform(first_n(first_seen(keys), limit), as_link),
        ),
    )


def notification_link(text, href):
    low = F.lower(text)
    hit = F.contains(F.lower(href), F.lit(fixed.NOTIFICATION_HREF_PART))
    for part in fixed.NOTIFICATION_TEXT_PARTS:
        hit = hit | F.contains(low, F.lit(part))
    return F.when(hit, href).otherwise(F.lit(""))


def application_link(text, href):
    return F.when(
        F.contains(F.lower(text), F.lit(fixed.APPLICATION_TEXT_PART)), href
    ).otherwise(F.lit(""))


def exploded(df, column, *keep):
    """One row per array element as (pos, l).

    The outer form, because the inner one makes the optimizer test the array's size below
    the projection that computes it, which would parse every page again.
    """
    rows = df.select(*keep, F.posexplode_outer(column).alias("pos", "l"))
    return rows.filter(F.col("pos").isNotNull())


def linked_pages(pages, keywords=fixed.KEYWORDS, limit=fixed.LINKS_PER_PAGE, keep=()):
    """Pages with their links as `_links` instead of their HTML; NULL for a page that cannot be parsed."""
    return pages.select(
        *keep, "source_name", "final_url",
        page_links(F.col("final_url"), F.col("html"), keywords, limit).alias("_links"),
    )


def discover_links(pages, keywords=fixed.KEYWORDS, limit=fixed.LINKS_PER_PAGE, keep=()):
    """Candidates of every page, in document order (`pos` from 0).

    `pages` has `source_name`, `final_url` and `html`; `keep` names further columns to carry.
    """
    return link_candidates(linked_pages(pages, keywords, limit, keep), keep)


def link_candidates(linked, keep=()):
    """Candidates of pages whose links were taken."""
    links = exploded(linked, "_links", *keep, "source_name", "final_url")
    text, href = F.col("l.text"), F.col("l.href")
    filled = {
        "source_name": F.col("source_name"),
        "source_url": F.col("final_url"),
        "title": text,
        "notification_url": notification_link(text, href),
        "application_url": application_link(text, href),
        "discovery_text": text,
    }
    blanks = {
        f.name: F.lit("" if f.dataType.typeName() == "string" else None).cast(f.dataType)
        for f in CANDIDATE.fields
    }
    return links.select(
        *keep, "pos", *[c.alias(n) for n, c in {**blanks, **filled}.items()]
    )


def with_seq(candidates, order=("source_ord", "pos"), run_ts=None):
    """`_seq`: the order in which candidates are written, later runs after earlier ones."""
    first = [] if run_ts is None else [run_ts.alias("run_ts")]
    return candidates.withColumn("_seq", F.struct(*first, *[F.col(c) for c in order]))

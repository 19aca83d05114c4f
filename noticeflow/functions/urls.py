"""URL columns: parts, domain, file name and relative resolution (RFC 3986)."""

from pyspark.sql import functions as F

from noticeflow import fixed
from noticeflow.functions.text import let

_PARTS = (
    r"(?s)^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
)
_PATH_PARAMS = r"(?s)^((?:.*/)?[^/;]*)(?:;([^/]*))?$"

# forms that need no normalisation; everything else takes the general path
_PLAIN_ROOTED = (
    r"^/(?![/.])(?:[^?#;/\t\r\n]++|/(?!\.))*+(?:\?[^#\t\r\n]+)?(?:#[^\t\r\n]+)?$"
)
_PLAIN_ABSOLUTE = (
    r"^https?://[^/?#\t\r\n]+(?:/[^?#;\t\r\n]*)?(?:\?[^#\t\r\n]+)?(?:#[^\t\r\n]+)?$"
)


def _clean(url):
    return F.regexp_replace(url, r"^[\x00-\x20]+|[\t\r\n]", "")


def _part(url, group):
    return F.regexp_extract(url, _PARTS, group)


def netloc_of(url):
    return _part(_clean(url), 2)


def domain_of(url):
    """Lower-cased authority up to its first colon ('' when there is none)."""
    return F.split_part(F.lower(netloc_of(url)), F.lit(":"), F.lit(1))


def malformed(url):
    """The authority opens a bracket it does not close, or the reverse."""
    return let(
        netloc_of(url), lambda n: F.contains(n, F.lit("[")) != F.contains(n, F.lit("]"))
    )


def url_parts(url, scheme=None):
    """struct<scheme, netloc, path, params, query, fragment>; `scheme` is the inherited one."""
    inherited = F.lit("") if scheme is None else scheme

    def split(u):
        own = F.lower(_part(u, 1))
        return F.struct(
            F.when(own == "", inherited).otherwise(own).alias("scheme"),
            _part(u, 2).alias("netloc"),
            _part(u, 3).alias("path"),
            _part(u, 4).alias("query"),
            _part(u, 5).alias("fragment"),
        )

    def with_params(p):
        has = p["scheme"].isin(*fixed.PARAMETER_SCHEMES)
        return F.struct(
            p["scheme"].alias("scheme"),
            p["netloc"].alias("netloc"),
            F.when(has, F.regexp_extract(p["path"], _PATH_PARAMS, 1))
            .otherwise(p["path"]).alias("path"),
            F.when(has, F.regexp_extract(p["path"], _PATH_PARAMS, 2))
            .otherwise(F.lit("")).alias("params"),
            p["query"].alias("query"),
            p["fragment"].alias("fragment"),
        )

    return let(_clean(url), lambda u: let(split(u), with_params))


def safe_file_name(url):
    """Last path segment with every character outside letters, digits and `._-` as `_`."""

    def name(p):
        # trailing slashes and `.` segments do not name anything
        trimmed = F.regexp_replace(p["path"], r"(?:/+\.?)+$", "")
        return F.regexp_extract(trimmed, r"([^/]*)$", 1)

    found = let(url_parts(url), name)
    named = let(
        found, lambda n: F.when(n.isin("", "."), F.lit(fixed.DEFAULT_FILE_NAME)).otherwise(n)
    )
    return F.regexp_replace(named, r"[^\p{L}\p{N}._-]", "_")


def _unsplit(scheme, netloc, path, params, query, fragment):
    def hierarchy(tail):
        return (
            F.when(
                netloc != "",
                F.concat(
                    F.lit("//"),
                    netloc,
                    F.when((tail != "") & ~tail.startswith("/"), F.lit("/")).otherwise(F.lit("")),
                    tail,
                ),
            )
            .when(
                tail.startswith("//") | ((scheme != "") & ((tail == "") | tail.startswith("/"))),
                F.concat(F.lit("//"), tail),
            )
            .otherwise(tail)
        )

    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(F.lit("")),
        let(F.concat(path, F.when(params != "", F.concat(F.lit(";"), params))
                      .otherwise(F.lit(""))), hierarchy),
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")),
        F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(F.lit("")),
    )


def _all_but_last(steps):
    return F.slice(steps, F.lit(1), F.greatest(F.size(steps) - 1, F.lit(0)))


def _merged_path(base_path, path):
    """The path of a reference merged with the page's path, dot segments removed."""

    def without_inner_blanks(s):
        inner = F.slice(s, F.lit(2), F.greatest(F.size(s) - 2, F.lit(0)))
        return F.when(
            F.size(s) > 1,
            F.concat(F.slice(s, 1, 1), F.filter(inner, lambda x: x != ""), F.slice(s, -1, 1)),
        ).otherwise(s)

    def walk(segments):
        walked = F.aggregate(
            segments,
            F.array().cast("array<string>"),
            lambda acc, s: F.when(s == "..", _all_but_last(acc))
            .when(s == ".", acc)
            .otherwise(F.concat(acc, F.array(s))),
        )
        last = F.element_at(segments, -1)
        closing = F.when(last.isin(".", ".."), F.array(F.lit(""))).otherwise(
            F.array().cast("array<string>")
        )
        return F.array_join(F.concat(walked, closing), "/")

    folder = let(
        F.split(base_path, "/"),
        lambda s: F.when(F.element_at(s, -1) != "", _all_but_last(s)).otherwise(s),
    )
    segments = F.when(path.startswith("/"), F.split(path, "/")).otherwise(
        let(F.concat(folder, F.split(path, "/")), without_inner_blanks)
    )
    return let(
        let(segments, walk), lambda t: F.when(t == "", F.lit("/")).otherwise(t)
    )


def resolve_link(base, parts, href):
    """A link as seen on the page at `base`, whose `url_parts` are given."""

    def general(h):
        same_document = _unsplit(
            h["scheme"], parts["netloc"], parts["path"], parts["params"],
            F.when(h["query"] != "", h["query"]).otherwise(parts["query"]), h["fragment"],
        )
        own_authority = _unsplit(
            h["scheme"], h["netloc"], h["path"], h["params"], h["query"], h["fragment"]
        )
        merged = _unsplit(
            h["scheme"], parts["netloc"], _merged_path(parts["path"], h["path"]),
            h["params"], h["query"], h["fragment"],
        )
        return (
            F.when((h["scheme"] != parts["scheme"]) | ~h["scheme"].isin(*fixed.RELATIVE_SCHEMES), href)
            .when(h["netloc"] != "", own_authority)
            .when((h["path"] == "") & (h["params"] == ""), same_document)
            .otherwise(merged)
        )

    origin = F.concat(
        F.when(parts["scheme"] != "", F.concat(parts["scheme"], F.lit(":")))
        .otherwise(F.lit("")),
        F.lit("//"),
        parts["netloc"],
    )
    return (
        F.when(base == "", href)
        .when(href == "", base)
        .when((parts["netloc"] != "") & href.rlike(_PLAIN_ROOTED), F.concat(origin, href))
        .when(href.rlike(_PLAIN_ABSOLUTE), href)
        .otherwise(let(url_parts(href, parts["scheme"]), general))
    )


def resolve_url(base, href):
    return let(url_parts(base), lambda p: resolve_link(base, p, href))

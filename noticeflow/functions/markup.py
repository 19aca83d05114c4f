"""Anchors of an HTML text, as column expressions."""

from html.entities import name2codepoint

from pyspark.sql import functions as F

from noticeflow.functions.text import collapse, let

# One attribute value counts as quoted only right after `=`.  Possessive
# quantifiers keep every loop linear and off the JVM's stack.
_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)"""
_OTHER_ATTRIBUTES = rf"(?:[\s/]++(?!href[\s=/>])[^\s=/>]++(?:\s*+=\s*+{_VALUE})?+|=)*+"
_REST_OF_TAG = r"""(?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|[="'])*+"""
# what follows `<`: comments and raw text to skip, and the start of an anchor with a link
_SKIPPED = (
    r"!--.*?(?:-->|\z)"
    r"|script(?=[\s/>])[^>]*+>.*?(?:</script[^>]*+>|\z)"
    r"|style(?=[\s/>])[^>]*+>.*?(?:</style[^>]*+>|\z)"
)
_OPEN = rf"a{_OTHER_ATTRIBUTES}[\s/]++href(?=[\s=/>])"
# an anchor ends at its end tag, at the next anchor or with the text
_INNER = rf"(?:[^<]++|<(?:{_SKIPPED}|(?!/?a[\s/>])))*+"

_ANCHOR = rf"(?is)<(?:{_SKIPPED}|{_OPEN}{_REST_OF_TAG}>{_INNER})"
_HREF = rf"""(?is)^<{_OPEN}(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]*+))?"""
_START_TAG = rf"(?is)^<{_OPEN}{_REST_OF_TAG}>"
_TAG = rf"(?is)<(?:{_SKIPPED}|/?[a-z!?]{_REST_OF_TAG}(?:>|\z))"
_ENTITY = r"&(?:#[0-9]++|#[xX][0-9a-fA-F]++|[A-Za-z][A-Za-z0-9]*);"

_NAMED = "\n".join(f"{n}\t{chr(c)}" for n, c in {**name2codepoint, "apos": 39}.items())


def _decoded(entity):
    """The character an entity stands for; an unknown one stays as written."""
    named = F.str_to_map(F.lit(_NAMED), F.lit("\n"), F.lit("\t"))
    name = F.substring(entity, F.lit(2), F.length(entity) - 2)
    hexa = F.regexp_extract(name, r"^#[xX]([0-9a-fA-F]+)$", 1)
    code = F.when(hexa != "", F.conv(hexa, 16, 10)).otherwise(
        F.regexp_extract(name, r"^#([0-9]+)$", 1)
    ).try_cast("bigint")
    valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return (
        F.when(~name.startswith("#"), F.coalesce(F.try_element_at(named, name), entity))
        .when(valid, char)
        .otherwise(entity)
    )


def _woven(text):
    literals = F.split(text, _ENTITY, -1)
    entities = F.regexp_extract_all(text, F.lit(_ENTITY), F.lit(0))
    pieces = F.zip_with(
        literals,
        entities,
        lambda lit, ent: F.concat(lit, F.when(ent.isNull(), F.lit("")).otherwise(_decoded(ent))),
    )
    return F.array_join(pieces, "")


def decode_entities(text):
    """Character references to characters, once, left to right."""
    return let(text, lambda t: F.when(F.contains(t, F.lit("&")), _woven(t)).otherwise(t))


def anchor_elements(html):
    """Every `<a>` that has an `href`, start tag and content, in document order."""
    found = F.regexp_extract_all(html, F.lit(_ANCHOR), F.lit(0))
    return F.filter(found, lambda m: F.substring(m, 2, 1).isin("a", "A"))


def anchor_text(element):
    """Text nodes of an element joined by a space, entities decoded, whitespace collapsed."""
    inner = F.regexp_replace(element, _START_TAG, " ")
    return collapse(decode_entities(F.regexp_replace(inner, _TAG, " ")))


def anchor_href(element):
    """The first `href` as written, without its quotes, entities decoded."""

    def unquoted(raw):
        quoted = F.substring(raw, 1, 1).isin('"', "'")
        return F.when(quoted, F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)

    return decode_entities(let(F.regexp_extract(element, _HREF, 1), unquoted))


def anchors(html):
    """array<struct<text, href>> with the link as written."""
    return F.transform(
        anchor_elements(html),
        lambda e: F.struct(anchor_text(e).alias("text"), anchor_href(e).alias("href")),
    )

"""Expressions of the oracle's SQL dialect, written independently of the Spark columns; patterns are the fixed values."""

from noticeflow import fixed


def collapse(x):
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def norm(x):
    return rf"lower(regexp_replace(coalesce(cast({x} as varchar), ''), '^\s+|\s+$', '', 'g'))"


def netloc(u):
    return rf"regexp_extract({u}, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)', 1)"


def domain(u):
    return f"split_part(lower({netloc(u)}), ':', 1)"


def trusted(d, domains=("example.org",), suffixes=(".example.net",)):
    tests = [f"{d} = '{x}' or {d} like '%.{x}'" for x in domains]
    tests += [f"{d} like '%{x}'" for x in suffixes]
    return "(" + " or ".join(tests) + ")"


def file_name(u):
    path = rf"regexp_extract({u}, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"
    last = rf"regexp_extract({path}, '([^/;]+)(?:;[^/]*)?/*$', 1)"
    return rf"regexp_replace(coalesce(nullif({last}, ''), 'document.pdf'), '[^\p{{L}}\p{{N}}._-]', '_', 'g')"


def labelled(text, labels):
    tokens = [
        f"nullif(regexp_extract({text}, '(?is){label}{fixed.DATE_GAP}{fixed.DATE}', 1), '')" for label in labels
    ]
    return f"coalesce({', '.join(tokens)}, '')"


def day_first(raw):
    shape = r"^(3[01]|[12]\d|0[1-9]|[1-9])[/-](1[0-2]|0[1-9]|[1-9])[/-](\d{4}|\d{2})$"
    part = [f"regexp_extract({raw}, '{shape}', {i})" for i in (1, 2, 3)]
    year = (
        f"case when length({part[2]}) = 4 then {part[2]} when {part[2]} <= '68' "
        f"then '20' || {part[2]} else '19' || {part[2]} end"
    )
    iso = f"({year}) || '-' || lpad({part[1]}, 2, '0') || '-' || lpad({part[0]}, 2, '0')"
    return (
        f"case when {part[2]} <> '' and ({raw} like '%/%/%' or {raw} like '%-%-%') "
        f"then try_cast({iso} as date) end"
    )


def advert(t):
    return f"regexp_extract({t}, '(?i){fixed.ADVERT_NUMBER}', 1)"


def vacancies(t):
    return f"try_cast(replace(regexp_extract({t}, '(?i){fixed.VACANCIES}', 1), ',', '') as bigint)"


def start(t):
    return day_first(labelled(t, fixed.START_LABELS))


def end(t):
    return day_first(labelled(t, fixed.END_LABELS))


def snippet(t, name):
    """The label and what follows, cut by length: the engine is slow on long bounded repeats."""
    pattern, cap = fixed.SNIPPETS[name]
    label, _, most = pattern.rpartition(".{0,")
    rest = f"regexp_extract({t}, '(?is){label}.*', 0)"
    length = f"length(regexp_extract({t}, '(?is){label}', 0)) + {most.rstrip('}')}"
    return f"substr({collapse(f'substr({rest}, 1, {length})')}, 1, {cap})"


def text_fields(t):
    return {
        "advertisement_number": advert(t),
        "vacancies_total": vacancies(t),
        "application_start_date": start(t),
        "application_end_date": end(t),
        **{n: snippet(t, n) for n in ("age_limit", "qualification", "experience", "application_fee")},
    }


def select_fields(t):
    return ", ".join(f"{sql} as {name}" for name, sql in text_fields(t).items())


def fingerprint(*cols):
    return "sha256(" + " || '|' || ".join(norm(c) for c in cols) + ")"


# anchors of `pages` in document order, text collapsed; its anchors hold no markup or entities
ANCHORS = r"""links as (
  select page_id, url, generate_subscripts(a, 1) - 1 as pos, unnest(a) as el
  from (select page_id, url, regexp_extract_all(
      regexp_replace(html, '(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>', ' ', 'g'),
      '(?is)<a\s[^>]*>.*?</a>', 0) as a from pages) p
), anchors as (
  select page_id, url, pos,
    trim(regexp_replace(regexp_replace(el, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) as text,
    regexp_extract(el, 'href="([^"]*)"', 1) as href
  from links
), resolved as (
  select page_id, url, pos, text,
    case when href like '/%' then regexp_extract(url, '^[a-z]+://[^/?#]*', 0) || href else href end as href
  from anchors
)"""


def kept(cond, cap=None):
    """Distinct matching links per page in order of first appearance, renumbered from 0."""
    sql = f"""kept as (
  select page_id, url, text, href, row_number() over (partition by page_id order by min(pos)) - 1 as pos
  from resolved where text <> '' and {cond} group by page_id, url, text, href
)"""
    if cap is not None:
        sql += f", capped as (select * from kept where pos < {cap})"
    return sql


def any_word(x, words):
    return "(" + " or ".join(f"contains(lower({x}), '{w}')" for w in words) + ")"

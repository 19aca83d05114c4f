"""Input tables derived from the given ones by one SQL text, for Spark and for the oracle.

Every table covers its source table whole and grows with it.
"""


NOTICES = r"""
select o_orderkey as doc_id, concat(
  case o_orderkey % 4 when 0 then 'Advt. No. ' when 1 then 'Advertisement Number: ' when 2 then 'NOTIFICATION - ' else 'Vacancy circular ' end,
  cast(o_orderkey % 700 as string), '/', cast(extract(year from o_orderdate) as string), chr(10),
  case when o_orderkey % 7 = 0 then '1,' else '' end, cast(100 + o_orderkey % 897 as string),
  case o_orderkey % 3 when 0 then ' Posts' when 1 then '  vacancies' else ' post' end,
  '. Online  applications will start on ', d0, '/', m0, '/', y0, chr(10),
  case o_orderkey % 5
    when 0 then concat('Last date for receipt: ', d1, '-', m1, '-', y1)
    when 1 then concat('Closing   date ', d1, '/', m1, '/', substr(y1, 3, 2))
    when 2 then concat('applications close ', d1, '-', m1, '-', y1)
    when 3 then 'Last date 31/02/2024. Closing date 01/03/2024'
    else '' end,
  chr(10), 'Age limit:  18 to ', cast(25 + o_orderkey % 15 as string), ' years', chr(10),
  case when o_orderkey % 2 = 0 then 'Essential   Qualification: degree in ' else 'qualification ' end, o_orderpriority,
  case when o_orderkey % 6 = 0 then concat(chr(10), 'Work experience of ', cast(o_orderkey % 9 as string), ' years') else '' end,
  case when o_orderkey % 8 = 0 then concat(chr(10), 'Application fee Rs. ', cast(o_orderkey % 500 as string)) else '' end) as text
from (
  select o_orderkey, o_orderpriority, o_orderdate,
    lpad(cast(extract(day from o_orderdate) as string), 2, '0') as d0,
    lpad(cast(extract(month from o_orderdate) as string), 2, '0') as m0,
    cast(extract(year from o_orderdate) as string) as y0,
    lpad(cast(extract(day from o_orderdate + interval 30 day) as string), 2, '0') as d1,
    lpad(cast(extract(month from o_orderdate + interval 30 day) as string), 2, '0') as m1,
    cast(extract(year from o_orderdate + interval 30 day) as string) as y1
  from {orders}) o
"""

# whole document texts between a head and a foot, so that matches sit at both ends
BULLETINS = r"""
select doc_id, concat('Advertisement No. ', upper(lang), '-', cast(doc_id as string), '/', source, chr(10),
  cast(n_chars as string), ' positions', chr(10), text, chr(10),
  'Last date: ', lpad(cast(1 + doc_id % 28 as string), 2, '0'), '/', cast(1 + doc_id % 12 as string), '/', cast(1960 + doc_id % 80 as string),
  chr(10), 'Maximum age ', cast(20 + doc_id % 30 as string), chr(10), 'Fee for application ', cast(doc_id % 900 as string)) as text
from {documents}
"""

CANDIDATES = r"""
select o_orderkey as doc_id, cast(o_orderkey % 4 as int) as source_ord, o_orderkey as pos,
  concat('source ', cast(o_orderkey % 4 as string)) as source_name,
  case o_orderkey % 4 when 0 then 'https://portal.gov.in/list' when 1 then 'HTTPS://WWW.Alpha.example.org:8443/jobs?x=1'
    when 2 then 'http://u@beta.example.net/x' else 'gamma.example.com/jobs' end as source_url,
  concat('Recruitment notice ', cast(o_orderkey % 50 as string)) as title,
  case when o_orderkey % 5 = 0 then ''
    when o_orderkey % 5 = 1 then 'https://files.example.net/docs/4.pdf'
    else concat('https://files.example.net/docs/', cast(o_orderkey - o_orderkey % 3 as string), '.pdf') end as notification_url,
  case when o_orderkey % 3 = 0 then concat('https://apply.gov.in/', cast(o_orderkey as string)) else '' end as application_url
from {orders}
"""

RESPONSES = r"""
select o_orderkey as seq, concat('https://files.example.net/docs/', cast(o_orderkey as string), '.pdf') as request_url,
  case o_orderkey % 5 when 0 then concat('https://files.example.net/docs/', cast(o_orderkey as string), '.pdf')
    when 1 then concat('https://files.example.net/get/', cast(o_orderkey % 40 as string), '.PDF?dl=1')
    when 2 then 'https://files.example.net/' when 3 then concat('https://files.example.net/a/no tice%20', cast(o_orderkey % 30 as string), '/')
    else concat('https://files.example.net/docs/', cast(o_orderkey as string), '.pdf;v=1#p') end as final_url,
  cast(case when o_orderkey % 11 = 0 then 404 when o_orderkey % 13 = 0 then 500 else 200 end as int) as status,
  case o_orderkey % 4 when 0 then 'Application/PDF; charset=binary' when 1 then 'text/html' when 2 then null else 'application/octet-stream' end as content_type,
  concat('body ', cast(o_orderkey as string)) as body,
  case when o_orderkey % 17 = 0 then null else concat(' page text ', cast(o_orderkey as string), chr(10)) end as page_1,
  case when o_orderkey % 6 = 0 then '' else concat('Advt No. Z/', cast(o_orderkey % 600 as string), ' ', cast(1 + o_orderkey % 90 as string), ' posts ') end as page_2
from {orders}
"""

STORE_ROWS = r"""
select case when o_orderkey % 3 = 0 then 1 else 0 end as batch,
  o_orderkey + case when o_orderkey % 3 = 0 then 1000000000000 else 0 end as seq,
  case o_orderkey % 3 when 0 then ' Org A' when 1 then 'ORG A ' else 'org a' end as organisation,
  case when o_orderkey % 4 = 0 then '' else concat('CEN-', cast(o_orderkey % 300 as string)) end as advertisement_number,
  concat('Post ', cast(o_custkey % 20 as string)) as post_title,
  case when o_orderkey % 5 = 0 then null else cast(o_orderdate as date) end as publication_date,
  case when o_orderkey % 2 = 0 then '' else 'Level 7' end as pay_level,
  case when o_orderkey % 3 = 0 then '' else '9300-34800' end as pay_scale,
  case when o_orderkey % 7 = 0 then '' else cast(o_orderkey as string) end as salary,
  cast(o_orderdate as timestamp) as written_at
from {orders}
"""

# odd keys point outside the notices, so half of them have no answer
OVERLAY = r"""
select case when o_orderkey % 2 = 0 then o_orderkey else -1 - o_orderkey end as doc_id, case o_orderkey % 5
    when 0 then concat('{{"organisation":"Étable ', cast(o_orderkey as string), '","vacancies_total":', cast(o_orderkey as string), ',"important_instructions":["a","b"]}}')
    when 1 then '{{}}' when 2 then '{{"vacancies_total":"many"}}' when 3 then '{{"organisation":"cut' else '{{"application_end_date":"2024-03-01","extraction_confidence":0.9}}' end as response
from {orders}
"""

# fetches of listing pages over twenty days, of which some addresses are registered
LANDINGS = r"""
select o_orderkey as seq, concat('https://list', cast(o_orderkey % 6 as string), '.example.org/jobs') as request_url,
  1704067200 + 3600 * (o_orderkey % 480) as fetched_s, cast(case when o_orderkey % 11 = 0 then 404 else 200 end as int) as status,
  concat('<a href="/', cast(o_orderkey as string), '.pdf">Job ', cast(o_orderkey as string), '</a>') as html
from {orders}
"""

ALL = {
    "landings": LANDINGS,
    "notices": NOTICES,
    "bulletins": BULLETINS,
    "candidates": CANDIDATES,
    "responses": RESPONSES,
    "store_rows": STORE_ROWS,
    "overlay_rows": OVERLAY,
}
_TABLE = {"bulletins": "documents"}
_TEXTS = ("notices", "bulletins", "overlay_rows")
#: Rows of a partition at most where texts are derived from them.
PART_ROWS = 100_000


def table(spark, sf_dir, name):
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derive(spark, name, source):
    """A derived table over a given one (batch or stream)."""
    return spark.sql(ALL[name].strip(), **{_TABLE.get(name, "orders"): source})


def derived(spark, sf_dir, name):
    source = table(spark, sf_dir, _TABLE.get(name, "orders"))
    if name in _TEXTS:
        source = source.repartition(max(spark.sparkContext.defaultParallelism, -(-source.count() // PART_ROWS)))
    return derive(spark, name, source)


def cte(*names):
    """`with` clause of derived tables for the oracle."""
    parts = []
    for name in names:
        sql = ALL[name].strip()
        for given in ("orders", "documents"):
            sql = sql.replace("{" + given + "}", given)
        parts.append(f"{name} as ({sql.replace('{{', '{').replace('}}', '}')})")
    return "with " + ", ".join(parts)

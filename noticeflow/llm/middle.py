"""Fill-in-middle transformation by an indexable skip list.

A text is a row of units: single code points, or what a pattern matches from left to right.  The list
holds one node before every unit and one at the end; express lanes link ever fewer nodes, and every
link carries how many units and how many code points it skips.  A cut before the r-th unit is found by
descending from the highest lane, taking each link whose units still fit into r: the code points gone
by are the place to cut.  Which nodes rise to a lane is decided by a hash of their rank, so results
hold whatever is recomputed.
"""

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from noticeflow.llm.common import slices, small_batches

#: Marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_MARK = re.compile("<[PSM]>")
#: One node of 2^RISE rises to the next lane.
RISE = 2


def unit_widths(text, pattern=None):
    """Code points of each unit of the text; what `pattern` leaves out between its matches is cut into single code points."""
    if pattern is None:
        return np.ones(len(text), np.int32)
    widths, at = [], 0
    for m in re.finditer(pattern, text):
        if m.end() > m.start():
            widths += [1] * (m.start() - at) + [m.end() - m.start()]
            at = m.end()
    return np.array(widths + [1] * (len(text) - at), np.int32)


class SkipList:
    """Units with their widths, indexed by rank."""

    def __init__(self, widths):
        self.size = len(widths)
        # A lane: units and code points that each link skips, and the place of its nodes in the lane below.
        self.lanes = [(None, widths, None)]
        at = np.arange(self.size + 1)
        before = np.concatenate([[0], np.cumsum(widths, dtype=np.int64)])
        with np.errstate(over="ignore"):
            coins = (at.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            coins = (coins ^ (coins >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        while len(at) > 1 << RISE:
            coins >>= np.uint64(RISE)
            risen = (coins & np.uint64((1 << RISE) - 1)) == 0
            risen[0] = True
            down = np.flatnonzero(risen)
            at, before, coins = at[down], before[down], coins[down]
            self.lanes.append((np.diff(at), np.diff(before), down))
            if len(self.lanes) > 16:
                break

    def offset(self, rank):
        """Code points before the unit of this rank; `rank` may be the number of units."""
        if not 0 <= rank <= self.size:
            raise IndexError(rank)
        node = units = points = 0
        for skipped, width, down in reversed(self.lanes):
            while node < len(width):
                step = 1 if skipped is None else int(skipped[node])
                if units + step > rank:
                    break
                units += step
                points += int(width[node])
                node += 1
            if down is not None:
                node = int(down[node])
        return points


def draws(doc_id, seed=1):
    """Four numbers below 2^32 that the document's id decides; a null id is written as nothing."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[i : i + 8], 16) for i in (0, 8, 16, 24)]


def arrange(text, doc_id, pattern=None, percent=90, spm_percent=20, seed=1):
    """(units, form, code points of the prefix, of the middle, output)."""
    cuts = SkipList(unit_widths(text, pattern))
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or h3 % 100 >= percent or _MARK.search(text):
        return cuts.size, "plain", None, None, text
    a, b = sorted((h1 % (cuts.size + 1), h2 % (cuts.size + 1)))
    i, j = cuts.offset(a), cuts.offset(b)
    prefix, middle, suffix = text[:i], text[i:j], text[j:]
    if h4 % 100 < spm_percent:
        return cuts.size, "spm", i, j - i, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return cuts.size, "psm", i, j - i, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def transform(docs, pattern=None, percent=90, spm_percent=20, seed=1):
    """`doc_id`, `n` (units), `form`, `prefix_chars`, `middle_chars`, `output`, a row for every row.

    Cuts lie between units of `pattern` (None: code points) and depend on doc_id and `seed` only, so
    repeated rows give repeated results.  A null text counts as empty; empty texts and such as hold one
    of the marks stay as they are (`plain`, no sizes), and so do `100 - percent` of a hundred others.
    Other columns are ignored.  Rows pass in slices of a few MB: memory follows the longest text.
    """
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())]
    )

    def work(batches):
        for batch in slices(batches):
            ids = batch.column("doc_id").to_pylist()
            made = [arrange(t or "", i, pattern, percent, spm_percent, seed) for i, t in zip(ids, batch.column("text").to_pylist())]
            columns = [pa.array(c, schema.field(k + 1).type) for k, c in enumerate(zip(*made))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], schema=schema)

    small_batches(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(work, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output, form):
    """Column: the text that `output` was made of.  Marks occur in it only where they were set."""
    part = F.split(output, "<[PSM]>")
    return (
        F.when(form == "psm", F.concat(part[1], part[3], part[2]))
        .when(form == "spm", F.concat(part[2], part[3], part[1]))
        .otherwise(output)
    )


def op12_fill_middle(spark, sf_dir):
    made = transform(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        sha(F.col("output")).alias("output_sha256"),
        sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


OP12_SQL = """
with hashed as (
  select doc_id, coalesce(text, '') as text, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
drawn as (
  select doc_id, text, length(text) as n, cast('0x' || h[1:8] as bigint) as h1, cast('0x' || h[9:16] as bigint) as h2,
    cast('0x' || h[17:24] as bigint) as h3, cast('0x' || h[25:32] as bigint) as h4
  from hashed),
cut as (
  select doc_id, text, n, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when n = 0 or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain'
      when h4 % 100 < 20 then 'spm' else 'psm' end as form
  from drawn),
made as (
  select doc_id, n, form, a, b, text, substring(text, 1, a) as p, substring(text, a + 1, b - a) as m, substring(text, b + 1) as s from cut)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(case form when 'plain' then text else p || m || s end) as restored_sha256
from made
"""

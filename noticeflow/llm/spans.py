"""Substring dedup by sliding sentence spans.

From every sentence the shortest run of two or more consecutive sentences that reaches `LEAST_WORDS`
words is hashed, so every two sentences of that many words are a run, and short sentences make longer
ones; a single sentence counts as a run from `ALONE_WORDS` words on.  Equal hashes meet in one global
aggregation that keeps the first place of each repeated run; every sentence covered by a repeated run
elsewhere is removed.  Sentences end after a run of `.!?` followed by white space, or with the line.
"""

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from noticeflow.llm.common import slices, small_batches, stage

#: Sentences in a run at least.  Two, as passages of 50 words may hold no more.
RUN = 2
#: Words a run needs: shorter runs recur by chance.
LEAST_WORDS = 10
#: Words a single sentence needs to be a run.
ALONE_WORDS = 50
_BREAK = re.compile(r"[.!?]+[ \t\r\n]+|\n+")


def sentences(text):
    """The text in pieces, each with its closing marks and white space; joined they are the text."""
    ends = [0, *(m.end() for m in _BREAK.finditer(text))]
    if ends[-1] < len(text):
        ends.append(len(text))
    return [text[i:j] for i, j in zip(ends, ends[1:])]


def passages(text, run=RUN, least_words=LEAST_WORDS, alone_words=ALONE_WORDS):
    """(first sentence, sentences, normalised text) of the runs; white space counts as one space.

    Of every sentence: the shortest run of `run` or more sentences from it that has `least_words` words,
    if the text goes on for that long, and the sentence alone if it has `alone_words`.
    """
    words = [s.encode().split() for s in sentences(text)]
    plain = [b" ".join(w) for w in words]
    upto = np.cumsum([0] + [len(w) for w in words])
    ends = np.maximum(np.searchsorted(upto, upto[:-1] + least_words), np.arange(run, len(words) + run))
    out = [(i, end - i, b"\n".join(plain[i:end])) for i, end in enumerate(ends.tolist()) if end < len(upto)]
    return out + [(i, 1, plain[i]) for i, w in enumerate(words) if len(w) >= alone_words]


def _key(docs):
    """The row's document: rows with equal doc_id and text are one document, each of which keeps its text."""
    text = F.col("text").cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("digest")
    )


def span_hashes(keyed, run=RUN, least_words=LEAST_WORDS, alone_words=ALONE_WORDS):
    """doc_id, digest, first sentence `at`, sentences `size` and a 128-bit hash of every run."""
    fields = [("doc_id", pa.int64()), ("digest", pa.int64()), ("at", pa.int32()), ("size", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())]
    schema = pa.schema(fields)

    def work(batches):
        for batch in slices(batches):
            row, at, size, h = [], [], [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                for i, n, s in passages(text or "", run, least_words, alone_words):
                    row.append(k)
                    at.append(i)
                    size.append(n)
                    h.append(xxhash.xxh3_128_digest(s))
            take = pa.array(row, pa.int64())
            halves = np.frombuffer(b"".join(h), ">i8").reshape(-1, 2).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(take), batch.column("digest").take(take), pa.array(at, pa.int32()), pa.array(size, pa.int32())]
                + [pa.array(np.ascontiguousarray(halves[:, i])) for i in (0, 1)],
                schema=schema,
            )

    return keyed.mapInArrow(work, "doc_id long, digest long, at int, size int, h1 long, h2 long")


def repeated(spans):
    """doc_id, digest, at, size of every run that is found before, by (doc_id, digest, at) with null ids first."""
    place = F.struct("doc_id", "digest", "at")
    first = stage(
        spans.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter(F.col("first") != F.col("last"))
        .select("h1", "h2", "first")
    )
    # Both sides are plain tables, so a run found very often is split by the skew rule.
    return spans.join(first, ["h1", "h2"]).filter(~place.eqNullSafe(F.col("first"))).select("doc_id", "digest", "at", "size")


def _rewrite(text, at):
    out = {r["at"] + k for r in at for k in range(r["size"])}
    return "".join(s for i, s in enumerate(sentences(text)) if i not in out), len(out)


def _joined(docs, run, least_words, alone_words):
    """The rows with all their columns and `_at`: start and size of the repeated runs of the row's text, null if there is none."""
    small_batches(docs.sparkSession)
    digest = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    spans = stage(span_hashes(_key(docs), run, least_words, alone_words))
    gone = repeated(spans).groupBy("doc_id", "digest").agg(F.collect_set(F.struct("at", "size")).alias("_at"))
    right = gone.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), "_at")
    left = docs.withColumn("_own", digest)
    on = left["doc_id"].cast("long").eqNullSafe(right["_id"]) & (left["_own"] == right["_digest"])
    return left.join(right, on, "left").select(*docs.columns, "_at")


def deduplicate(docs, run=RUN, least_words=LEAST_WORDS, alone_words=ALONE_WORDS):
    """`doc_id`, `text` without repeated sentences, and `removed` (their number), a row for every row.

    The first place of a repeated run stays: that of the smallest doc_id (null before all).  Rows with
    equal doc_id and text count as one document and get equal results.  A null text stays null; texts
    that consist of repeated runs only become empty.  Runs as in `passages`.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("removed", pa.int32())])

    def work(batches):
        for batch in slices(batches):
            texts, ats = batch.column("text").to_pylist(), batch.column("_at").to_pylist()
            new = [_rewrite(t, at) if at else (t, 0) for t, at in zip(texts, ats)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([t for t, _ in new], pa.string()), pa.array([n for _, n in new], pa.int32())], schema=schema
            )

    return _joined(slim, run, least_words, alone_words).mapInArrow(work, "doc_id long, text string, removed int")


def rewritten(docs, run=RUN, least_words=LEAST_WORDS, alone_words=ALONE_WORDS):
    """The rows of documents with repeated sentences removed and `n_chars` of the new text; rows whose text becomes empty go."""

    def work(batches):
        for batch in slices(batches):
            texts, ats = batch.column("text").to_pylist(), batch.column("_at").to_pylist()
            new = [_rewrite(t, at)[0] if at else t for t, at in zip(texts, ats)]
            stay = pa.array([not at or bool(t.strip()) for t, at in zip(new, ats)], pa.bool_())
            sizes = [None if t is None else len(t) if at else n for t, at, n in zip(new, ats, batch.column("n_chars").to_pylist())]
            out = batch.select([n for n in batch.schema.names if n != "_at"])
            for name, col in (("text", pa.array(new, pa.string())), ("n_chars", pa.array(sizes, pa.int64()))):
                out = out.set_column(out.schema.get_field_index(name), name, col)
            yield out.filter(stay)

    return _joined(docs, run, least_words, alone_words).mapInArrow(work, docs.schema)


def op10_spans(spark, sf_dir):
    return deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP10_SQL = rf"""
with cut as (
  select doc_id, text,
    list_filter(string_split(regexp_replace(text, '([.!?]+[ \t\r\n]+|\n+)', '\1' || chr(1), 'g'), chr(1)), lambda s : s <> '') as parts
  from documents),
sentence as (
  select doc_id, i - 1 as pos, parts[i] as raw,
    list_filter(regexp_split_to_array(parts[i], '[ \t\r\n\f\v]+'), lambda w : w <> '') as words
  from cut, lateral (select unnest(generate_series(1, len(parts))) as i)),
counted as (
  select doc_id, pos, array_to_string(words, ' ') as plain, len(words) as n, sum(len(words)) over (partition by doc_id order by pos) as upto,
    max(pos) over (partition by doc_id) as last
  from sentence),
plains as (select doc_id, list(plain order by pos) as plain from counted group by doc_id),
reached as (select doc_id, upto, min(pos) as pos from counted group by doc_id, upto),
ended as (
  select c.doc_id, c.pos, c.last, greatest(r.pos, c.pos + {RUN - 1}) as stop
  from counted c asof join reached r on c.doc_id = r.doc_id and c.upto - c.n + {LEAST_WORDS} <= r.upto),
run as (
  select e.doc_id, e.pos, e.stop, array_to_string(p.plain[e.pos + 1 : e.stop + 1], chr(10)) as span
  from ended e join plains p using (doc_id) where e.stop <= e.last
  union all select doc_id, pos, pos, plain from counted where n >= {ALONE_WORDS}),
later as (
  select doc_id, pos, stop from run
  qualify row_number() over (partition by span order by doc_id, pos) > 1),
gone as (select distinct doc_id, unnest(generate_series(pos, stop)) as pos from later),
left_over as (
  select s.doc_id, string_agg(s.raw, '' order by s.pos) filter (where g.pos is null) as text, cast(count(g.pos) as integer) as removed
  from sentence s left join gone g using (doc_id, pos) group by s.doc_id)
select d.doc_id, case when d.text is null then null else coalesce(l.text, '') end as text, coalesce(l.removed, cast(0 as integer)) as removed
from documents d left join left_over l using (doc_id)
"""

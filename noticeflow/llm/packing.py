"""Pattern packing by non-negative least squares.

Only the histogram of lengths (at most `capacity` numbers) is looked at by one process.  Lengths are
put in coarse classes; patterns of up to three classes that fill a sequence are enumerated; repeat
counts that reproduce the histogram best are fitted with non-negative least squares, rounded down
and taken from the histogram.  What remains goes, longest first, into the tightest opened sequence
it fits, counted in groups of alike sequences.  The plan is then applied to all rows through their
rank within their length.
"""

import functools
import re
from array import array
from bisect import bisect_left, insort
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import functions as F

from noticeflow.llm.common import ranked, slices
from noticeflow.llm.vocab import library, vocab

CAPACITY = 4096
CLASSES = 128
VOCABULARY = "word_bpe_49k.json"
END_ID = 1

_OTHER = re.compile("[^\x00-\x1b\x20-ɏ]")
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
_CACHE = 600_000


class WordCoder:
    """Ids of texts in a vocabulary whose pieces never reach over white space: words met before are looked up."""

    def __init__(self, path):
        self.vocab, self.library, self.known = vocab(path), library(path), {}

    def word(self, word):
        merge, end = self.vocab.merge, self.vocab.END
        if word.isalpha():  # one piece, by far the most common case
            return array("i", merge(word.encode() + end)).tobytes()
        if word[-1] in ".,!?" and word[:-1].isalpha():
            core = self.known.get(word[:-1])
            return (self.word(word[:-1]) if core is None else core) + array("i", merge(word[-1].encode() + end)).tobytes()
        return array("i", chain.from_iterable(merge(p.encode() + end) for p in _PIECE.findall(word))).tobytes()

    def encode(self, text):
        """Ids as bytes of little-endian 32-bit numbers."""
        if not text.isascii() and _OTHER.search(text) or re.search(r"[\x1c-\x1f]", text) or any(t in text for t in self.vocab.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words, known = text.lower().split(), self.known
        new = set(words).difference(known)
        if len(known) + len(new) > _CACHE:
            known.clear()
            new = set(words)
        known.update((w, self.word(w)) for w in new)
        return b"".join(map(known.__getitem__, words))


@functools.lru_cache(maxsize=2)
def coder(path):
    return WordCoder(path)


def token_pieces(docs, path, capacity=CAPACITY):
    """`doc_id`, `piece`, `start`, `length`, `ids` (binary, little-endian uint32) of every document.

    A document's ids are those of its whole text (null: empty) and the end id; only documents over
    `capacity` are cut.  Repeated rows are documents of their own.
    """
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())]
    schema, end = pa.schema(fields), np.array([END_ID], "<u4").tobytes()

    def run(batches):
        c = coder(path)
        for batch in slices(batches):
            cols = [[], [], [], [], []]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = c.encode(text or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for col, v in zip(cols, (doc_id, k, at // 4, len(part) // 4, part)):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def nnls(a, b, most=600):
    """Non-negative least squares by an active set: x >= 0 that minimises |a x - b|."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    gradient = a.T @ b
    tol = 1e-9 * max(1.0, float(np.abs(gradient).max(initial=0)))
    for _ in range(most):
        open_ = np.where(passive, -np.inf, gradient)
        j = int(open_.argmax())
        if open_[j] <= tol:
            break
        passive[j] = True
        while True:
            at = np.flatnonzero(passive)
            z = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[at] = z
                break
            low = z <= 0
            step = (x[at][low] / np.maximum(x[at][low] - z[low], 1e-300)).min()
            x[at] += step * (z - x[at])
            passive[at[x[at] <= 1e-12]] = False
            x[~passive] = 0
            if not passive.any():
                break
        gradient = a.T @ (b - a @ x)
    return x


def patterns(classes):
    """All non-increasing triples, pairs and singles of classes that sum up to `classes`."""
    out = [(classes,)]
    out += [(i, classes - i) for i in range((classes + 1) // 2, classes)]
    out += [
        (i, j, classes - i - j)
        for i in range((classes + 2) // 3, classes - 1)
        for j in range((classes - i + 1) // 2, min(i, classes - i - 1) + 1)
    ]
    return out


def fitted(hist, capacity, classes):
    """Groups [(length, times), ...] with the number of sequences in each, from the fitted patterns; takes them from `hist`."""
    width = -(-capacity // classes)
    classes = -(-capacity // width)
    lengths = np.flatnonzero(hist)
    cls = -(-lengths // width)
    target = np.bincount(cls, hist[lengths], classes + 1)[1:]
    shapes = patterns(classes)
    a = np.zeros((classes, len(shapes)))
    for k, shape in enumerate(shapes):
        for c in shape:
            a[c - 1, k] += 1
    repeat = np.floor(nnls(a, target) + 1e-6).astype(np.int64)
    pool = {int(c): [int(n) for n in lengths[cls == c][::-1]] for c in np.unique(cls)}
    left = {c: int(hist[pool[c]].sum()) for c in pool}
    groups = []
    for k in np.flatnonzero(repeat):
        shape = shapes[k]
        count = min([int(repeat[k]), *(left.get(c, 0) // shape.count(c) for c in set(shape))])
        for c in shape:
            if c in left:
                left[c] -= count
        while count > 0:  # split where the longest remaining length of a class runs out
            now = []
            for c in shape:
                while not hist[pool[c][0]] - now.count(pool[c][0]) > 0:
                    if hist[pool[c][0]] > 0:
                        break
                    pool[c].pop(0)
                pick = next(n for n in pool[c] if hist[n] - now.count(n) > 0)
                now.append(pick)
            times = min(count, *(int(hist[n]) // now.count(n) for n in now))
            for n in now:
                hist[n] -= times
            groups.append(([(n, now.count(n)) for n in dict.fromkeys(now)], times))
            count -= times
    return groups


def plan(hist, capacity=CAPACITY, classes=CLASSES):
    """Groups of alike sequences: ([(length, times), ...], number of sequences).  `hist[n]`: rows of length n."""
    hist = np.array(hist, np.int64)
    done = [([(capacity, 1)], int(hist[capacity]))] if hist[capacity] else []
    hist[capacity] = 0
    opened = {}  # free space to groups
    spaces = []

    def free(space, group):
        if space == 0:
            done.append(group)
            return
        if space not in opened:
            opened[space] = []
            insort(spaces, space)
        opened[space].append(group)

    if hist.any():
        for parts, times in fitted(hist, capacity, classes):
            free(capacity - sum(n * m for n, m in parts), (parts, times))
    for n in np.flatnonzero(hist)[::-1].tolist():
        rows = int(hist[n])
        while rows:
            k = bisect_left(spaces, n)
            if k == len(spaces):
                per = capacity // n
                full, rest = divmod(rows, per)
                if full:
                    free(capacity - per * n, ([(n, per)], full))
                if rest:
                    free(capacity - rest * n, ([(n, rest)], 1))
                break
            space = spaces[k]
            parts, times = opened[space].pop()
            if not opened[space]:
                del opened[space], spaces[k]
            per = space // n
            filled = min(times, rows // per)
            part = 1 if filled < times and rows - filled * per else 0
            rest = min(rows - filled * per, per) if part else 0
            if filled:
                free(space - per * n, (parts + [(n, per)], filled))
            if part:
                free(space - rest * n, (parts + [(n, rest)], 1))
            if times - filled - part:
                free(space, (parts, times - filled - part))
            rows -= filled * per + rest
    return done + [g for groups in opened.values() for g in groups]


def pack(pieces, capacity=CAPACITY, classes=CLASSES):
    """Adds `sequence_id` and `offset` to rows with a `length` from 1 to `capacity`.

    Every row lands in exactly one sequence, whose rows lie gapless from 0.  Rows of one length are
    alike to the plan; ties are settled by their written order.  An empty table gives an empty result.
    """
    base = pieces.drop("sequence_id", "offset", "_rank")
    rows = ranked(base, "length", "_rank")
    hist = np.zeros(capacity + 1, np.int64)
    for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect():  # one row per length at most
        hist[r["length"]] = r["n"]
    table, sequence, used = [], 0, np.zeros(capacity + 1, np.int64)
    for parts, times in plan(hist, capacity, classes):
        at = 0
        for n, m in parts:
            table.append((n, int(used[n]), sequence, m, at))
            used[n] += times * m
            at += n * m
        sequence += times
    if not (used == hist).all():
        raise AssertionError("the plan must take every row once")
    table.sort()
    slots = np.array(table, np.int64).reshape(-1, 5)
    shared = rows.sparkSession.sparkContext.broadcast(slots)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        s, length, rank = shared.value, length.to_numpy(), rank.to_numpy()
        at = np.searchsorted((s[:, 0] << 44) | s[:, 1], (length << 44) | rank, side="right") - 1
        q, r = np.divmod(rank - s[at, 1], s[at, 3])
        return pd.DataFrame({"sequence_id": s[at, 2] + q, "offset": s[at, 4] + r * length})

    out = rows.withColumn("_at", place("length", "_rank"))
    return out.select(*base.columns, "_at.sequence_id", "_at.offset")


def op6_packing(spark, sf_dir):
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = token_pieces(docs, public_tokenizers.path(VOCABULARY))
    slim = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(slim)

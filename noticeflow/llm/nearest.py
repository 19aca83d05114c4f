"""Approximate nearest neighbours by collision-counting hashing.

Every vector is projected on `PROJECTIONS` random lines, taken from random rotations so that the lines of
one rotation are at right angles; each line's projections are kept as a sorted array.  A query opens a
window around its own projection on every line; virtual rehashing widens all windows together, step by
step.  A vector seen in at least `THRESHOLD` of the windows is verified by its distance; the search stops when ten verified vectors lie within the
radius that the windows stand for.

Data are worked on in blocks of a bounded number of vectors, queries in blocks of a bounded number;
each block of data returns its nearest vectors, and these are merged by query.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from noticeflow.llm.common import stage

PROJECTIONS = 128
#: Collisions from which a vector is verified.
THRESHOLD = 106
#: Half width of a window in units of the radius; first radius in units of a sample's; growth of the radius per step.
HALF_WIDTH, START, GROWTH = 1.4, 0.8, 1.06
BLOCK, QUERIES = 32_768, 1024
#: Vectors whose mutual distances give the first radius: a bounded sample, as every vector is indexed anyway.
SAMPLE = 512
_SEED = 11


def lines(dim, n=PROJECTIONS):
    """n directions of the length of standard normal ones, in rotations of `dim` directions each."""
    rng = np.random.default_rng(_SEED)
    turns = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-n // dim))]
    return np.concatenate(turns, axis=1)[:, :n] * np.sqrt(dim)


class Block:
    """The sorted arrays of one block of vectors."""

    def __init__(self, rows, ids, vectors, a):
        self.rows, self.ids, self.vectors = rows, ids, vectors
        p = vectors @ a
        order = np.argsort(p, axis=0, kind="stable").T
        self.sorted = np.take_along_axis(p.T, order, axis=1)
        # Place of every vector on every line: it is in a window of places if it is in one of projections.
        self.place = np.empty(order.shape, np.uint16)
        np.put_along_axis(self.place, order, np.arange(len(ids), dtype=np.uint16)[None, :], axis=1)

    def search(self, own, query, projected, radius, k, threshold):
        """The k nearest verified vectors for one query, whose row is `own`: (squared distances, places), and how many were verified."""
        m = len(projected)
        checked = self.rows == own
        before = int(checked.sum())
        rows, dist = np.zeros(0, np.int64), np.zeros(0)
        while True:
            width = HALF_WIDTH * radius
            seen = np.zeros(len(self.ids), np.uint8 if m < 256 else np.uint16)
            for i in range(m):
                lo, hi = self.sorted[i].searchsorted(projected[i] - width), self.sorted[i].searchsorted(projected[i] + width, "right")
                if hi > lo:
                    # below lo the difference wraps round to a large number
                    seen += (self.place[i] - np.uint16(lo)) <= np.uint16(hi - lo - 1)
            fresh = np.flatnonzero((seen >= threshold) & ~checked)
            checked[fresh] = True
            d = self.vectors[fresh] - query
            rows, dist = np.concatenate([rows, fresh]), np.concatenate([dist, np.einsum("ij,ij->i", d, d)])
            if len(rows) > k:  # keep the nearest, ties to the smaller id
                best = np.lexsort((self.ids[rows], dist))[:k]
                rows, dist = rows[best], dist[best]
            if checked.all() or len(rows) >= k and dist.max() <= radius * radius:
                return dist, rows, int(checked.sum()) - before
            radius *= GROWTH


def _valid(v):
    """A vector takes part if it is there, not zero, and has finite components only."""
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)


def search(rows, every=100, k=10, threshold=THRESHOLD):
    """query_id, rank, vec_id, score for every row whose vec_id is divisible by `every`, against all rows.

    Vectors that are null, empty, zero or hold null or non-finite components take no part; nor do null
    ids, and vectors of another length than the query's.  Of several rows with a query's id that of the
    least vector asks, and the others are candidates, as every row but the query's own is; so repeated rows
    can be found repeatedly.  Of equal distances the smaller vec_id comes first.  Fewer than k candidates
    are all returned; an empty table gives an empty result.
    """
    spark = rows.sparkSession
    vector = F.col("embedding").cast("array<double>")
    base = rows.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("v")).filter(F.col("vec_id").isNotNull() & _valid(F.col("v")))
    base = stage(base.withColumn("row", F.monotonically_increasing_id()))  # written, so that the numbers hold
    queries = base.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("v", "row")).alias("q")).select("vec_id", "q.*")
    blocks = -(-queries.count() // QUERIES)
    queries = stage(queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(max(blocks, 1))).cast("int")))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
    sample = base.orderBy(F.xxhash64("vec_id")).limit(SAMPLE).select("v").collect()
    found = None
    for b in range(blocks):  # a block has about QUERIES vectors, so what is sent out is bounded
        asked = [(r["vec_id"], r["row"], np.array(r["v"])) for r in queries.filter(F.col("block") == b).collect()]
        shared = spark.sparkContext.broadcast((asked, [np.array(r["v"]) for r in sample]))
        part = stage(base.mapInArrow(_task(shared, schema, k, threshold), "query_id long, vec_id long, score double"))
        found = part if found is None else found.union(part)
    if found is None:
        found = spark.createDataFrame([], "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def start_radius(near, query, k):
    """Where the windows begin: START times the distance to the k-th of a sample of vectors."""
    d = np.sqrt(((near - query) ** 2).sum(axis=1))
    d = np.sort(d[d > 0])
    return float(d[min(len(d) - 1, k)]) * START if len(d) else 1.0


def _task(shared, schema, k, threshold):
    def answer(held, asked, sample):
        rows, ids, vectors = (np.array(x) for x in held)
        dim = vectors.shape[1]
        mine = [(i, own, q) for i, own, q in asked if len(q) == dim]
        if not mine:
            return
        a = lines(dim)
        block = Block(rows, ids, vectors, a)
        near = np.stack([s for s in sample if len(s) == dim] or [vectors[0]])
        out = []
        for i, own, q in mine:
            dist, at, _ = block.search(own, q, q @ a, start_radius(near, q, k), k, threshold)
            out += zip([i] * len(at), ids[at].tolist(), np.sqrt(dist).tolist())
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], schema.field(c).type) for c in range(3)], schema=schema)

    def run(batches):
        asked, sample = shared.value
        held = {}
        for batch in batches:
            for r, i, v in zip(*(batch.column(c).to_pylist() for c in ("row", "vec_id", "v"))):
                parts = held.setdefault(len(v), ([], [], []))
                for part, value in zip(parts, (r, i, v)):
                    part.append(value)
                if len(parts[0]) == BLOCK:
                    yield from answer(parts, asked, sample)
                    del held[len(v)]
        for parts in held.values():
            yield from answer(parts, asked, sample)

    return run


def op4_nearest(spark, sf_dir):
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

"""Consistent-hash ring with virtual nodes and bounded loads.

Every shard owns `vnodes` points of a ring of 64-bit hashes.  A key belongs to the first point
clockwise of its own hash.  No shard takes more than its bound; keys over it walk on clockwise to
the next point whose shard has room.  Keys that share an arc of the ring are alike, so the walk is
computed once for the counts of the arcs (at most shards x vnodes numbers) and then applied to all
rows through their rank within the arc.
"""

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import functions as F

from noticeflow.llm.common import ranked

SHARDS = 16
VNODES = 128


def ring(shards=SHARDS, vnodes=VNODES):
    """Sorted positions (signed 64-bit) of all virtual nodes and the shard of each."""
    at = [(xxhash.xxh3_64_intdigest(f"{s}/{v}".encode()) - (1 << 63), s) for s in range(shards) for v in range(vnodes)]
    at.sort()
    return np.array([p for p, _ in at], np.int64), np.array([s for _, s in at], np.int32)


def bounds(total, shards, headroom=0.0):
    """Most keys each shard may hold: with no headroom, counts at most one apart."""
    most = max(total, math.floor(total * (1 + headroom)))
    return np.array([most // shards + (s < most % shards) for s in range(shards)], np.int64)


def place(counts, owners, bound):
    """Segments (arc, first rank, end rank, shard) of the keys of all arcs.

    All pending keys ask at the point they have reached, in rounds; a point's shard admits them in
    ring order up to its bound, the rest ask at the next point.  The bounds sum up to at least the
    number of keys, so it ends after one turn of the ring at most.
    """
    room = np.array(bound, np.int64)
    pending = [(a, 0, int(n)) for a, n in enumerate(counts) if n]
    out, n_arcs = [], len(owners)
    for step in range(n_arcs):
        rest = []
        for arc, lo, hi in pending:
            shard = int(owners[(arc + step) % n_arcs])
            take = int(min(hi - lo, room[shard]))
            if take:
                out.append((arc, lo, lo + take, shard))
                room[shard] -= take
            if lo + take < hi:
                rest.append((arc, lo + take, hi))
        pending = rest
        if not pending:
            break
    return out


def assign_shards(rows, key="doc_id", shards=SHARDS, vnodes=VNODES, headroom=0.0):
    """Adds `shard` and `slot` (gapless from 0 within the shard) to every row.

    Keys are hashed as they are; null keys share one point of the ring.  Rows with equal keys are
    spread like any others when their shard is full.  An empty table gives an empty result.
    Columns named `shard`, `slot`, or starting with `_ring_`, are replaced.
    """
    points, owners = ring(shards, vnodes)

    @F.pandas_udf("int")
    def arc_of(pos: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(points, pos.to_numpy()) % len(points)).astype("int32")

    base = rows.drop("shard", "slot", "_ring_arc", "_ring_rank")
    arcs = ranked(base.withColumn("_ring_arc", arc_of(F.xxhash64(F.lit("key"), F.col(key)))), "_ring_arc", "_ring_rank")
    counts = np.zeros(len(points), np.int64)
    for r in arcs.groupBy("_ring_arc").agg(F.count("*").alias("n")).collect():  # one row per arc at most
        counts[r["_ring_arc"]] = r["n"]
    placed = place(counts, owners, bounds(int(counts.sum()), shards, headroom))
    used, table = [0] * shards, []
    for arc, lo, hi, shard in placed:
        table.append((arc, lo, hi, shard, used[shard] - lo))
        used[shard] += hi - lo
    spark = rows.sparkSession
    segments = spark.createDataFrame(
        table, "_ring_arc int, _ring_lo long, _ring_hi long, shard int, _ring_shift long"
    )
    inside = (F.col("_ring_rank") >= F.col("_ring_lo")) & (F.col("_ring_rank") < F.col("_ring_hi"))
    out = arcs.join(F.broadcast(segments), "_ring_arc").filter(inside)
    return out.select(*base.columns, "shard", (F.col("_ring_rank") + F.col("_ring_shift")).alias("slot"))


def op2_hash_ring(spark, sf_dir):
    """All documents in 16 shards; law `rows`: counts at most one apart (no headroom)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
    )
    return assign_shards(slim).withColumn("grown_shard", F.lit(None).cast("int"))

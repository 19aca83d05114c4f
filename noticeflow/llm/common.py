"""Small helpers that several operators share."""

import contextlib
import contextvars

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Window
from pyspark.sql import functions as F

from noticeflow.sources import scratch

#: Rows handed to Python code at a time stay under this many bytes of text.
SLICE_BYTES = 4 << 20


_AT_WORK = contextvars.ContextVar("working tables", default=None)


def stage(df, keep=False):
    """Write `df` and read it back.  Within `working` the table is deleted at the end, unless `keep`: what a result reads stays."""
    return scratch.stage(df, staged=None if keep else _AT_WORK.get())


@contextlib.contextmanager
def working(spark):
    """Deletes the tables that `stage` wrote within, also when the work fails."""
    paths = []
    token = _AT_WORK.set(paths)
    try:
        yield
    finally:
        _AT_WORK.reset(token)
        scratch.drop(spark, paths)


def maybe_in(df, key, some, bits=1 << 20):
    """Rows of `df` whose non-null `key` may be in the column `key` of `some`: all that are, and some more as `some` grows.

    Only a bit map of `bits` bits is broadcast.
    """
    place = F.pmod(F.xxhash64(key), F.lit(bits)) + 1
    number, at = F.bitmap_bucket_number(place), F.bitmap_bit_position(place)
    maps = some.groupBy(number.alias("_number")).agg(F.bitmap_construct_agg(at).alias("_map"))
    byte = F.substring("_map", F.floor(at / 8).cast("int") + 1, F.lit(1))
    is_set = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), (at % 8).cast("int")) == 1
    return df.filter(F.col(key).isNotNull()).join(F.broadcast(maps), (number == F.col("_number")) & is_set, "left_semi")


class HashOf(dict):
    """Word (bytes) to a stable 64-bit hash; forgets everything once `limit` words are known."""

    def __init__(self, limit=400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word):
        if len(self) >= self.limit:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        self[word] = value
        return value


_HASHES = HashOf()


def word_hashes(words):
    """One uint64 per word."""
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def rolling(hashes, n):
    """Hash of every window of `n` hashes; one hash of all of them when there are fewer."""
    if len(hashes) == 0:
        return hashes
    n = min(n, len(hashes))
    with np.errstate(over="ignore"):
        out = np.zeros(len(hashes) - n + 1, np.uint64)
        for i in range(n):
            out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + len(out)]
            out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(32))


def slices(batches, column="text", most=SLICE_BYTES):
    """Arrow batches cut so that the values of `column` in each stay under `most` bytes; a single longer row stands alone."""
    for batch in batches:
        col = batch.column(column)
        if batch.num_rows == 0:
            continue
        size = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, n in enumerate(size):
            if total + n > most and i > start:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)
    # Workers are kept for the next task; what they hold counts against the executor until then.
    _HASHES.clear()
    pa.default_memory_pool().release_unused()


def small_batches(spark):
    """Rows with whole texts go to Python in batches bounded by bytes, unless the session sets a bound itself."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.sparkContext.getConf().toDebugString():
        spark.conf.set(key, str(2 * SLICE_BYTES))


def whole_groups(batches, key):
    """Pandas frames from key-sorted Arrow batches, each with whole runs of equal `key` columns."""
    import pandas as pd

    rest = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        frame = batch.to_pandas()
        if rest is not None:
            frame = pd.concat([rest, frame], ignore_index=True)
        last = frame[key].iloc[-1]
        same = (frame[key] == last).all(axis=1).to_numpy()
        cut = len(frame) - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            yield frame.iloc[:cut].reset_index(drop=True)
        rest = frame.iloc[cut:].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest


def ranked(df, key, name="rank", salts=64):
    """Adds a rank, gapless from 0 within each value of the non-null column `key`.

    The rows are written once, so that their numbers hold whatever is recomputed.  A hot key is
    ranked in `salts` parts by different tasks; only counts per part are summed up per key.
    """
    # The rows travel as one value, so that their column names can't clash with those used here.
    own = stage(df.select(F.struct(*df.columns).alias("_rows"), F.col(key).alias("_key"), F.monotonically_increasing_id().alias("_row")))
    salted = own.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("_key", "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_key").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_key", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_key", "_salt").orderBy("_row")) - 1
    out = salted.withColumn("_within", within).join(starts, ["_key", "_salt"])
    return out.select("_rows.*", (F.col("_start") + F.col("_within")).alias(name))

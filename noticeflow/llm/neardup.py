"""Near-duplicate classes by improved consistent weighted sampling.

A text is the set of its five-word shingles, weighted by term frequency times inverse document
frequency.  Consistent weighted samples agree with the probability of the weighted Jaccard
similarity; texts that agree in all samples of a band meet in a bucket.  In a bucket each text is
held against leaders, texts of the bucket that are unlike each other, so a bucket of alike texts gives
one link per text and not one per pair.  Links are verified on the whole texts, and the texts they
connect form classes.  Buckets whose texts are of several classes then are settled exactly: the sets of
those outside the bucket's largest class meet all sets of the bucket in cells of bounded size, every
similarity is worked out there, and only links that join classes leave the cell.
"""

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from noticeflow.llm.common import maybe_in, rolling, slices, small_batches, stage, whole_groups, word_hashes, working
from noticeflow.llm.components import components

WIDTH = 5
SIMILARITY = 0.8
BANDS, ROWS = 12, 4
#: Texts are counted per hash bucket first; a bucket that fewer texts than LEAST_SHARE meet holds no frequent shingle.
DF_BITS = 20
#: Shingles of fewer texts than this share count as in none.  The sum of all shares is the mean number of
#: shingles of a text, so at most that mean over LEAST_SHARE shingles have a count of their own.
LEAST_SHARE = 0.002
#: idf = ln((1 + 2 SMOOTH) / (share of texts + SMOOTH)): smoothed, so that a passage that many copies share
#: still counts when the copies are compared.
SMOOTH = 0.05
#: Shares are of this many texts at least, so that in a small table no passage counts as common.
LEAST_TEXTS = 10_000
CHUNK = 512
#: Share of agreeing samples with a leader from which a text leads no others.
LEADING = 0.78
SPARE = 2
LINKS_PER_PART = 64
_PARTS = 64
_ENTRIES = 16


def shingles(text, width=WIDTH):
    """Sorted distinct shingle hashes of a text and how often each occurs."""
    words = text.encode().split()
    return np.unique(rolling(word_hashes(words), width), return_counts=True)


def _buckets(hashes):
    return (hashes >> np.uint64(64 - DF_BITS)).astype(np.int64)


def _bucket_counts(texts):
    """Number of texts and, for each hash bucket, of texts with a shingle in it.

    Each task adds up one bounded array and hands it on in parts, which are summed part by part.
    """
    size = 1 << DF_BITS
    schema = pa.schema([("part", pa.int32()), ("counts", pa.binary())])

    def count(batches):
        total, n = np.zeros(size, np.uint32), 0
        for batch in slices(batches):
            for t in batch.column("text").to_pylist():
                if t is not None:
                    n += 1
                    total[np.unique(_buckets(shingles(t)[0]))] += np.uint32(1)
        rows = [p.tobytes() for p in np.split(total, _PARTS)] + [np.array([n], np.uint32).tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array(range(_PARTS + 1), pa.int32()), pa.array(rows, pa.binary())], schema=schema)

    def add(batches):
        sums = {}
        for batch in batches:
            for part, counts in zip(*(c.to_pylist() for c in batch.columns)):
                counts = np.frombuffer(counts, np.uint32).astype(np.int64)
                sums[part] = sums[part] + counts if part in sums else counts
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], schema=schema)

    kind = "part int, counts binary"
    parts = texts.select("text").mapInArrow(count, kind).repartition("part").mapInArrow(add, kind).collect()  # 8 MB in all
    sums = {r["part"]: np.frombuffer(r["counts"], np.int64) for r in parts}
    if not sums:
        return 0, np.zeros(size, np.int64)
    return int(sums[_PARTS][0]), np.concatenate([sums[p] for p in range(_PARTS)])


def document_frequencies(texts):
    """Number of texts, and the shingles that LEAST_SHARE of them or more hold: hashes in order, and how many texts; null texts don't count.

    Counts are exact: a second pass counts every shingle of the buckets that are met often enough.
    """
    n, buckets = _bucket_counts(texts)
    least = LEAST_SHARE * max(n, LEAST_TEXTS)
    often = texts.sparkSession.sparkContext.broadcast(np.packbits(buckets >= least))
    schema = pa.schema([("shingle", pa.int64()), ("n", pa.int64())])

    def count(batches):
        flags, held, size = np.unpackbits(often.value).astype(bool), [], 0
        for batch in slices(batches):
            for t in batch.column("text").to_pylist():
                if t:
                    h = rolling(word_hashes(t.encode().split()), WIDTH)
                    own = np.unique(h[flags[_buckets(h)]])
                    held.append(own)
                    size += len(own)
            if size > 2_000_000:
                yield _counted(held, schema)
                held, size = [], 0
        if held:
            yield _counted(held, schema)

    if not n or not (buckets >= least).any():
        return n, (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    found = texts.select("text").mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    found = found.toArrow()
    keys, counts = found.column("shingle").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(keys)
    return n, (keys[order], counts[order])


def _counted(held, schema):
    found, n = np.unique(np.concatenate(held), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], schema=schema)


class Weights:
    """Inverse document frequency of shingles: of the frequent ones by their count, of all others one value."""

    def __init__(self, n, frequent):
        self.keys, counts = frequent
        self.values = np.log((1 + 2 * SMOOTH) / (counts / max(n, LEAST_TEXTS) + SMOOTH)).astype(np.float32)
        self.rare = np.float32(np.log((1 + 2 * SMOOTH) / SMOOTH))
        self.flags = np.zeros(1 << DF_BITS, bool)
        self.flags[_buckets(self.keys)] = True

    def of(self, hashes):
        out = np.full(len(hashes), self.rare, np.float32)
        at = np.flatnonzero(self.flags[_buckets(hashes)])
        if len(at):
            place = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
            same = self.keys[place] == hashes[at]
            out[at[same]] = self.values[place[same]]
        return out


def inverse_frequencies(n, frequent):
    return Weights(n, frequent)


def weighted(text, idf):
    found, times = shingles(text)
    return found, times * idf.of(found)


def weighted_jaccard(a, b):
    (ha, wa), (hb, wb) = a, b
    _, i, j = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    both = np.minimum(wa[i], wb[j]).sum(dtype=np.float64)
    union = wa.sum(dtype=np.float64) + wb.sum(dtype=np.float64) - both
    return both / union if union else 0.0


@functools.lru_cache(maxsize=1)
def _draws(k):
    """For each sample: an odd multiplier and tables of gamma, log-gamma and uniform draws, one entry per hash of a shingle."""
    rng = np.random.default_rng(20240229)
    shape = (k, 1 << _ENTRIES)
    r = rng.gamma(2.0, 1.0, shape).astype(np.float32)
    log_c = np.log(rng.gamma(2.0, 1.0, shape)).astype(np.float32)
    beta = rng.random(shape, np.float32)
    odd = rng.integers(0, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return odd, r, log_c, beta


def samples(sets, k=BANDS * ROWS):
    """uint32 matrix: the `k` consistent weighted samples of each non-empty weighted set."""
    odd, r_of, c_of, b_of = _draws(k)
    h = np.concatenate([s[0] for s in sets])
    log_w = np.log(np.concatenate([s[1] for s in sets])).astype(np.float32)
    starts = np.cumsum([0] + [len(s[0]) for s in sets[:-1]])
    out = np.empty((len(sets), k), np.uint32)
    low = (h ^ (h >> np.uint64(32))) & np.uint64(0xFFFFFFFF)
    with np.errstate(over="ignore"):
        for i in range(k):
            at = ((h * odd[i]) >> np.uint64(64 - _ENTRIES)).astype(np.int64)
            r = r_of[i][at]
            b = b_of[i][at]
            t = np.floor(log_w / r + b)
            log_a = c_of[i][at] - r * (t - b) - r
            bits = log_a.view(np.uint32)
            bits = np.where(bits >> 31, ~bits, bits | np.uint32(0x80000000))
            name = (low + t.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B1)) & np.uint64(0xFFFFFFFF)
            out[:, i] = np.minimum.reduceat((bits.astype(np.uint64) << np.uint64(32)) | name, starts) & np.uint64(0xFFFFFFFF)
    return out


def signatures(texts, idf, most=60_000):
    """doc_id, node, `bands` (null for texts without words), `sketch` (one byte per sample) and `size`, its number of shingles."""
    fields = [("doc_id", pa.int64()), ("node", pa.binary()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary()), ("size", pa.int32())]
    schema = pa.schema(fields)

    def run(batches):
        for batch in slices(batches):
            sets = [weighted(t, idf.value) if t else None for t in batch.column("text").to_pylist()]
            some = [i for i, s in enumerate(sets) if s is not None and len(s[0])]
            bands, sketch = [None] * len(sets), [None] * len(sets)
            sizes = [0 if s is None else len(s[0]) for s in sets]
            while some:
                size = np.cumsum([len(sets[i][0]) for i in some])
                n = max(1, int(np.searchsorted(size, most)))
                sig = samples([sets[i] for i in some[:n]])
                wide = np.zeros((len(sig), BANDS), np.uint64)
                with np.errstate(over="ignore"):
                    for j in range(ROWS):
                        wide = (wide ^ sig[:, j::ROWS]) * np.uint64(0x9E3779B97F4A7C15)
                        wide ^= wide >> np.uint64(31)
                for i, w, s in zip(some[:n], wide.view(np.int64).tolist(), (sig & 0xFF).astype(np.uint8)):
                    bands[i], sketch[i] = w, s.tobytes()
                some = some[n:]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("node"), pa.array(bands, fields[2][1]), pa.array(sketch, pa.binary()), pa.array(sizes, pa.int32())], schema=schema
            )
        _draws.cache_clear()  # 38 MB that later stages don't need

    return texts.mapInArrow(run, "doc_id long, node binary, bands array<long>, sketch binary, size int")


def _agreement():
    """Fewest agreeing samples at which a link is verified: 2.5 deviations below the expectation."""
    k = BANDS * ROWS
    return int(k * SIMILARITY - 2.5 * (k * SIMILARITY * (1 - SIMILARITY)) ** 0.5)


def lead(sketches, least, enough):
    """Leaders of a block and the links of its maximum spanning forest.

    Rows joined by links of any least agreement are joined by spanning links of that agreement, so
    the forest keeps the classes with fewer links than rows; as samples only estimate, each row also
    gets links to the SPARE rows it agrees with most.  The row that most others agree with
    leads first; rows that agree with a leader in `enough` samples don't lead.
    """
    agree = np.zeros((len(sketches), len(sketches)), np.int16)
    for column in sketches.T:
        agree += column[:, None] == column[None, :]
    np.fill_diagonal(agree, -1)
    alike = agree >= enough
    leaders, open_ = [], np.ones(len(sketches), bool)
    for i in np.argsort(-alike.sum(axis=1), kind="stable"):
        if open_[i]:
            leaders.append(int(i))
            open_ &= ~alike[i]
    links, near, to = [], agree[0].copy(), np.zeros(len(sketches), np.int64)
    near[0] = -2
    for _ in range(len(sketches) - 1):
        j = int(near.argmax())
        if near[j] >= least:
            links.append((int(to[j]), j))
        near[j] = -2
        closer = (agree[j] > near) & (near > -2)
        near[closer], to[closer] = agree[j][closer], j
    if len(sketches) > 2:
        for j in np.argsort(-agree, axis=1, kind="stable")[:, :SPARE].T:
            links += [(int(b), a) for a, b in enumerate(j) if agree[a, b] >= least]
    return leaders, links


_KEY = ["band", "bucket", "chunk"]


def _in_chunks(rows, turn=0):
    """Rows of buckets with two or more of them, in chunks of about CHUNK; `chunks` of the bucket.

    The chunk depends on band, bucket and `turn` as well, so texts apart in one bucket may meet in another.
    """
    sizes = stage(rows.groupBy("band", "bucket").agg(F.count("*").alias("n")).filter("n > 1"))
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    rows = rows.join(sizes, ["band", "bucket"]).withColumn("chunks", chunks)
    return rows.withColumn("chunk", F.pmod(F.xxhash64(F.lit(turn), "band", "bucket", "node"), F.col("chunks")).cast("int")).drop("n")


def _lead_chunks(rows):
    """One row per leader (`member` null) and per link of each chunk."""
    least, enough = _agreement(), int(BANDS * ROWS * LEADING)
    schema = pa.schema([("band", pa.int32()), ("bucket", pa.int64()), ("chunks", pa.int32()), ("node", pa.binary()), ("sketch", pa.binary()), ("member", pa.binary())])

    def run(batches):
        for frame in whole_groups(batches, _KEY):
            sketches = np.frombuffer(b"".join(frame["sketch"]), np.uint8).reshape(len(frame), -1)
            fresh = (frame[_KEY] != frame[_KEY].shift()).any(axis=1).to_numpy()
            ends = [*np.flatnonzero(fresh), len(frame)]
            nodes, own, members = frame["node"].tolist(), [], []
            for lo, hi in zip(ends, ends[1:]):
                # Even bands prefer small node numbers as leaders, odd ones large: two texts that miss each other under one leader meet under another.
                order = np.arange(lo, hi)
                if frame["band"].iat[lo] % 2:
                    order = order[::-1]
                leaders, links = lead(sketches[order], least, enough)
                own += [order[i] for i in leaders] + [order[i] for i, _ in links]
                members += [None] * len(leaders) + [nodes[order[j]] for _, j in links]
            part = frame.iloc[own]
            cols = [pa.array(part[c], schema.field(c).type) for c in schema.names[:-1]] + [pa.array(members, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    dealt = rows.select(*_KEY, "chunks", "node", "sketch").repartition(*_KEY).sortWithinPartitions(*_KEY, "node")
    return dealt.mapInArrow(run, "band int, bucket long, chunks int, node binary, sketch binary, member binary")


def _across(rows, leaders):
    """A link from each member of a bucket of several chunks to the leader, of any chunk, that it agrees with most.

    Leaders pass by in a stream after the members of the chunk, which alone are held.
    """
    least = _agreement()
    spread = leaders.select("band", "bucket", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(1).alias("role"), "node", "sketch")
    members = rows.filter("chunks > 1").select(*_KEY, F.lit(0).alias("role"), "node", "sketch")
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def best(held, score, leader):
        out = [(leader[j], held[j]) for j in np.flatnonzero(score >= least)]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.binary()) for i in (0, 1)], schema=schema)

    def run(batches):
        key, held, sketches = None, [], []
        score = leader = None
        for batch in batches:
            for r in batch.to_pandas().itertuples(index=False):
                if (now := (r.band, r.bucket, r.chunk)) != key:
                    if score is not None:
                        yield best(held, score, leader)
                    key, held, sketches, score = now, [], [], None
                row = np.frombuffer(r.sketch, np.uint8)
                if r.role == 0:
                    held.append(r.node)
                    sketches.append(row)
                elif held:
                    if score is None:
                        full, score, leader = np.stack(sketches), np.zeros(len(held), np.int64), [None] * len(held)
                    agree = (full == row).sum(axis=1)
                    for j in np.flatnonzero(agree > score):
                        if held[j] != r.node:
                            score[j], leader[j] = agree[j], r.node
        if score is not None:
            yield best(held, score, leader)

    dealt = members.union(spread).repartition(*_KEY).sortWithinPartitions(*_KEY, "role", "node")
    return dealt.mapInArrow(run, "a binary, b binary")


def candidates(sketched):
    """Distinct links (a: leader, b: member) to verify, from rows (node, bands, sketch) with distinct nodes; and the rows of the buckets."""
    # Most texts are alone in their buckets: sketches join the rest only.
    met = sketched.filter("bands is not null").select("node", F.posexplode("bands").alias("band", "bucket"))
    met = stage(_in_chunks(met.select("band", "bucket", "node")))
    rows = stage(met.join(sketched.select("node", "sketch", "size"), "node"))
    found = stage(_lead_chunks(rows))
    links = [found.filter("member is not null").select(F.col("node").alias("a"), F.col("member").alias("b"))]
    # Leaders of different chunks are led in turn, as long as that leaves clearly fewer of them.
    several = found.filter("member is null and chunks > 1").select("band", "bucket", "chunks", "node", "sketch")
    whole = stage(several.select("band", "bucket", "chunks").distinct())
    several, final = several.drop("chunks"), []
    n, turn = several.count(), 0
    while n:
        turn += 1
        led = stage(_lead_chunks(_in_chunks(several, turn)))
        links.append(led.filter("member is not null").select(F.col("node").alias("a"), F.col("member").alias("b")))
        fewer = led.filter("member is null").select("band", "bucket", "chunks", "node", "sketch")
        several = fewer.filter("chunks > 1").drop("chunks")
        before, n = n, several.count()
        final.append(fewer.filter("chunks = 1").drop("chunks"))
        if n > 0.9 * before:
            final.append(several)
            break
    if final:
        leaders = functools.reduce(lambda x, y: x.union(y), final).join(whole, ["band", "bucket"])
        links.append(_across(rows, leaders))
    return stage(_once(functools.reduce(lambda x, y: x.union(y), links))), rows


def _once(pair):
    """Every pair (a, b) once, whichever way round it came."""
    low, high = F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")
    once = pair.select(low, high, "a").groupBy("low", "high").agg(F.min("a").alias("a"))
    return once.select("a", F.when(F.col("a") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("b"))


# Exact similarities in cells -----------------------------------------------------------------------------

#: Rows and bytes of sets on either side of a cell.
CELL, CELL_BYTES = 1024, 24 << 20
_CELL_KEY = ["band", "bucket", "i", "j"]
_ELEMENT_BYTES = 12


def _cells(rows, labels):
    """Rows of the buckets with several classes, dealt to the cells of a grid: role 1, outside the bucket's largest class (i), meets role 0, all rows (j)."""
    own = rows.select("band", "bucket", "node", "size").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    own = stage(own)
    sizes = own.groupBy("band", "bucket", "label").agg(F.count("*").alias("n"), F.sum(F.col("size") * _ELEMENT_BYTES).alias("bytes"))
    total = F.struct(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).alias("all")
    mixed = sizes.groupBy("band", "bucket").agg(F.max(F.struct("n", "label", "bytes")).alias("main"), total, F.count("*").alias("classes")).filter("classes > 1")
    parts = lambda n, size: F.greatest(F.ceil(n / CELL), F.ceil(size / CELL_BYTES), F.lit(1)).cast("int")
    mixed = stage(
        mixed.select(
            "band", "bucket", F.col("main.label").alias("main"), parts(F.col("all.n"), F.col("all.bytes")).alias("columns"),
            parts(F.col("all.n") - F.col("main.n"), F.col("all.bytes") - F.col("main.bytes")).alias("lines"),
        )
    )
    own = stage(own.join(mixed, ["band", "bucket"]))
    place = lambda n: F.pmod(F.xxhash64("band", "bucket", "node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = own.select("band", "bucket", every("lines").alias("i"), place("columns").alias("j"), F.lit(0).alias("role"), "node", "label")
    others = own.filter("label != main").select("band", "bucket", place("lines").alias("i"), every("columns").alias("j"), F.lit(1).alias("role"), "node", "label")
    return stage(members.union(others))


def _sets(cells, texts, nodes):
    """node, `hashes` and `times` of its shingles, once for every node of the cells."""
    asked = cells.select("node").distinct()
    schema = pa.schema([("node", pa.binary()), ("hashes", pa.binary()), ("times", pa.binary())])

    def run(batches):
        for batch in slices(batches):
            made = [shingles(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array([h.tobytes() for h, _ in made], pa.binary()), pa.array([n.astype(np.uint32).tobytes() for _, n in made], pa.binary())], schema=schema
            )

    return stage(_with_texts(asked, texts, nodes).select("node", "text").mapInArrow(run, "node binary, hashes binary, times binary"))


class _Side:
    """The sets of one side of a cell, each occurrence of a shingle an element of its own weight."""

    def __init__(self, sets, idf):
        sizes = [len(h) for h, _ in sets]
        hashes, times = (np.concatenate([s[k] for s in sets]) for k in (0, 1))
        weight = idf.of(hashes).astype(np.float64)
        row = np.repeat(np.arange(len(sets)), sizes)
        self.total = np.bincount(row, weight * times, minlength=len(sets))
        nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        with np.errstate(over="ignore"):
            element = np.repeat(hashes, times) + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        order = np.argsort(element, kind="stable")
        self.element, self.row, self.weight = element[order], np.repeat(row, times)[order], np.repeat(weight, times)[order]


def similarities(lines, columns, idf, dense=1 / 64, most=4_000_000):
    """Matrix of the weighted Jaccard similarities of two lists of sets (hashes, times).

    Elements that many pairs share are multiplied as matrices, the others are added pair by pair.
    """
    a, b = _Side(lines, idf), _Side(columns, idf)
    both = np.zeros((len(lines), len(columns)))
    found, at, n = np.unique(a.element, return_index=True, return_counts=True)
    low, high = np.searchsorted(b.element, found), np.searchsorted(b.element, found, side="right")
    shared = high > low
    at, n, low, m = at[shared], n[shared], low[shared], (high - low)[shared]
    weight = a.weight[at]
    often = n * m >= dense * both.size
    for k in range(0, int(often.sum()), 1024):
        i, x, j, y, w = (v[often][k : k + 1024] for v in (at, n, low, m, weight))
        left, right = np.zeros((len(lines), len(i)), np.float32), np.zeros((len(columns), len(i)), np.float32)
        left[a.row[_ranges(i, x)], np.repeat(np.arange(len(i)), x)] = np.repeat(w, x)
        right[b.row[_ranges(j, y)], np.repeat(np.arange(len(i)), y)] = 1
        both += left @ right.T
    i, x, j, y, w = (v[~often] for v in (at, n, low, m, weight))
    cuts = np.searchsorted(np.cumsum(x * y), np.arange(0, int((x * y).sum()) + most, most))
    for lo, hi in zip(cuts, [*cuts[1:], len(i)]):
        if lo < hi:
            u, v = x[lo:hi], y[lo:hi]
            line = np.repeat(a.row[_ranges(i[lo:hi], u)], np.repeat(v, u))
            column = b.row[_ranges(np.repeat(j[lo:hi], u), np.repeat(v, u))]
            both += np.bincount(line * len(columns) + column, np.repeat(w[lo:hi], u * v), minlength=both.size).reshape(both.shape)
    return both / np.maximum(a.total[:, None] + b.total[None, :] - both, 1e-30)


def _ranges(starts, sizes):
    """start, start + 1, ... of every range, one after the other."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def _joining(lines, columns, idf, similarity):
    """Pairs of indices whose similarity is enough, as few as join all classes that such pairs connect.  Sides: lists of (label, set)."""
    near = similarities([s for _, s in lines], [s for _, s in columns], idf)
    names = {x: k for k, x in enumerate(dict.fromkeys(x for x, _ in lines + columns))}
    line, column = (np.array([names[x] for x, _ in side]) for side in (lines, columns))
    root = list(range(len(names)))

    def top(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    at = np.argwhere((near >= similarity - 1e-4) & (line[:, None] != column[None, :]))
    at = at[np.argsort(-near[at[:, 0], at[:, 1]], kind="stable")]
    sure = near[at[:, 0], at[:, 1]] >= similarity + 1e-4
    # Of the pairs that are well over the bound one for each two classes is enough.
    _, first = np.unique(line[at[sure, 0]] * len(names) + column[at[sure, 1]], return_index=True)
    out = []
    for i, j, safe in [(*at[sure][k], True) for k in np.sort(first)] + [(*x, False) for x in at[~sure]]:
        x, y = top(line[i]), top(column[j])
        if x != y and (safe or _exact(lines[i][1], columns[j][1], idf) >= similarity):
            root[x] = y
            out.append((int(i), int(j)))
    return out


def _exact(a, b, idf):
    """As `verified` works it out, for similarities that rounding might take across the bound."""
    return weighted_jaccard(*((h, n * idf.of(h)) for h, n in (a, b)))


def joined_in_cells(cells, sets, idf, similarity=SIMILARITY):
    """Links (a, b) that join the classes of a cell, at most one fewer than its classes."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(batches):
        for frame in whole_groups(batches, _CELL_KEY):
            a, b = [], []
            for _, cell in frame.groupby(_CELL_KEY, sort=False):
                sides = []
                for role in (1, 0):
                    part = cell[cell["role"] == role]
                    made = [(np.frombuffer(h, np.uint64), np.frombuffer(n, np.uint32).astype(np.int64)) for h, n in zip(part["hashes"], part["times"])]
                    sides.append((part["node"].tolist(), list(zip(part["label"], made))))
                if sides[0][0] and sides[1][0]:
                    for i, j in _joining(sides[0][1], sides[1][1], idf.value, similarity):
                        a.append(sides[0][0][i])
                        b.append(sides[1][0][j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], schema=schema)

    small_batches(cells.sparkSession)
    dealt = cells.join(sets, "node").select(*_CELL_KEY, "role", "node", "label", "hashes", "times").repartition(*_CELL_KEY).sortWithinPartitions(*_CELL_KEY, "role", "node")
    return dealt.mapInArrow(run, "a binary, b binary")


def settled(links, rows, texts, nodes, idf):
    """`node` and `label` of the classes: by verified links, and then by all similar pairs of the buckets that these leave in several classes."""
    near = stage(verified(links, texts, nodes, idf).select("a", "b"))
    labels = components(near)
    cells = _cells(rows, labels)
    if cells.isEmpty():
        return labels
    more = stage(joined_in_cells(cells, _sets(cells, texts, nodes), idf))
    return labels if more.isEmpty() else components(near.union(more))


def _with_texts(asked, texts, nodes):
    """The rows of `asked` (column `node`, which may repeat) with the text of the node."""
    some = maybe_in(texts, "node", asked).select(F.col("node").alias("_node"), F.col("doc_id").alias("_id"), "text")
    placed = stage(asked.join(nodes.select("node", "first"), "node"))
    # Joined on the id as well, so that very many copies of one text don't meet in one task.
    return some.join(placed, (some["_node"] == placed["node"]) & some["_id"].eqNullSafe(placed["first"])).drop("_node", "_id", "first")


def verified(links, texts, nodes, idf, similarity=SIMILARITY):
    """The links whose texts have a weighted Jaccard similarity of `similarity` or more.

    `texts`: doc_id, node, text; `nodes`: the `first` doc_id of each node, whose text is read.  The members of a leader are dealt out in parts,
    each with a copy of the leader; one leader's weights are held at a time.
    """
    per = links.groupBy("a").agg(F.ceil(F.count("*") / LINKS_PER_PART).cast("int").alias("parts"))
    per = stage(per)
    links = stage(links.join(per, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")))
    asked = (
        links.select(F.col("b").alias("node"), "a", "part", F.lit(1).alias("role"))
        .union(links.select(F.col("a").alias("node"), "a", "part", F.lit(0).alias("role")).distinct())
    )
    dealt = _with_texts(asked, texts, nodes).select("a", "part", "role", "node", "text").repartition("a", "part").sortWithinPartitions("a", "part", "role")
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("similarity", pa.float64())])

    def run(batches):
        key = leader = None
        for batch in slices(batches):
            out = []
            for a, part, role, node, text in zip(*(batch.column(c).to_pylist() for c in ("a", "part", "role", "node", "text"))):
                if role == 0:
                    if key != (a, part):
                        key, leader = (a, part), weighted(text, idf.value)
                    continue
                s = weighted_jaccard(leader, weighted(text, idf.value))
                if s >= similarity:
                    out.append((a, node, s))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], schema.field(i).type) for i in range(3)], schema=schema)

    return dealt.mapInArrow(run, "a binary, b binary, similarity double")


def keyed(docs):
    """doc_id, text and node: the text's digest, so that equal texts are one node."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.md5(text)).alias("node"))


def classify(docs):
    """`doc_id`, `node`, `class_id` and `copies` for every row; and the table of nodes they come from.

    `class_id` is the smallest doc_id of the class, `copies` the number of rows with exactly this text.
    Equal texts, also empty ones, are always one class.  A null text has a null node, a class of its own
    and its doc_id as class.  Texts of fewer than five words are one shingle; texts without words are like
    equal texts only.  Null ids sort last: a class has a null id only if all of its rows do.
    """
    with working(docs.sparkSession):
        return _classified(docs)


def _classified(docs):
    small_batches(docs.sparkSession)
    rows = keyed(docs)
    idf = docs.sparkSession.sparkContext.broadcast(inverse_frequencies(*document_frequencies(rows)))
    sketched = stage(signatures(rows, idf), keep=True)
    known = sketched.filter("node is not null")
    # Rows of a text per id first: `same` of them have the text's smallest id.
    per_id = known.groupBy("node", "doc_id").agg(F.count("*").alias("n"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "n"))
    nodes = per_id.groupBy("node").agg(least.alias("m"), F.sum("n").alias("copies"))
    nodes = stage(nodes.select("node", F.col("m.doc_id").alias("first"), F.col("m.n").alias("same"), "copies"))
    distinct = stage(known.select("node", "bands", "sketch", "size").dropDuplicates(["node"]))
    links, met = candidates(distinct)
    joined = settled(links, met, rows.filter("node is not null"), nodes, idf)
    labelled = nodes.join(joined, "node", "left").withColumn("label", F.coalesce("label", "node"))
    labelled = stage(labelled)
    classes = stage(labelled.groupBy("label").agg(F.min("first").alias("class_id")))
    table = stage(labelled.join(classes, "label").select("node", "label", "first", "same", "copies", "class_id"), keep=True)
    out = sketched.select("doc_id", "node").join(table.select("node", "copies", "class_id"), "node", "left")
    return out.select("doc_id", "node", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("copies", F.lit(1)).alias("copies")), table


def first_of_class(docs):
    """The rows, with all their columns, that stay: of each class one with the smallest doc_id; rows with null texts all stay.

    Rows repeated with the same id and text are told apart only where there are any.
    """
    _, nodes = classify(docs)
    best = nodes.filter(F.col("first").eqNullSafe(F.col("class_id")))
    # Two texts of a class may share the smallest id: the lesser digest stays.
    owners = best.groupBy("label").agg(F.min(F.struct("node", "first", "same")).alias("_o")).select("_o.*")
    owners = stage(owners.withColumnRenamed("node", "_node").withColumnRenamed("first", "_first"))
    text = F.col("text").cast("string")
    rows = docs.withColumn("_own", F.unhex(F.md5(text)))

    def of(part):
        on = (rows["_own"] == part["_node"]) & rows["doc_id"].cast("long").eqNullSafe(part["_first"])
        return rows.join(part, on).select(*docs.columns, "_node")

    single, repeated = of(owners.filter("same = 1")), of(owners.filter("same > 1"))
    return single.drop("_node").union(repeated.dropDuplicates(["_node"]).drop("_node")).union(docs.filter(text.isNull()))


def op7_neardup(spark, sf_dir):
    rows, _ = classify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "class_id", "copies", (F.col("doc_id") == F.col("class_id")).alias("first"))

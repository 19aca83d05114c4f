"""Language-model score by masked pseudo-likelihood.

A small network predicts every word of a text from the two words before and the two after it; the sum of
the conditional log-probabilities scores the text.  Frequent words have numbers of their own, all
others share hash buckets.  The prediction is in two steps, the word's class and the word within it,
so a word costs a few dozen exponentials.  A word of a bucket has the bucket's probability times its
share of the bucket's words in all texts: the shares of up to `KNOWN` of the more frequent of these words
are sent to the tasks, those of all others are joined by word.

Texts are split and numbered once.  Training runs on all of them: they are dealt by a hash of the text to parts
of about PART_WORDS words, a copy of the network is trained on every part, and the copies of a round are
averaged, weighted by their words.  The rounds grow with the number of parts.  Parts, their order and the
batches in them depend on the texts only, so the files a table lies in make no difference.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import functions as F

from noticeflow.llm.common import slices, stage

WORDS, BUCKETS = 1536, 511
CLASSES, PER_CLASS = 64, 32
SIZE = CLASSES * PER_CLASS
#: The number that stands before the first and after the last word.
EDGE = SIZE - 1
AROUND = (-2, -1, 1, 2)
WIDTH = 24
#: Words of a part, and of the pieces it is trained on one after the other.
PART_WORDS, PIECE_WORDS = 2_000_000, 1 << 18
BATCH, RATE = 8192, 0.15
#: Shares that are sent to the tasks at most, some 16 MB of words and numbers.
KNOWN = 1 << 18
_PARTS = 64
#: Bytes of words and counts that a task holds before it hands them on, about a million words.
_COUNTED = 24 << 20
#: Bound of an exponent: sums of exponentials stay positive and finite without a maximum taken for each.
_MOST = np.float32(80.0)


def words_of(texts):
    """All words of a column of texts as one column of bytes, and the place in it where each text's words begin, with its end."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words = split.flatten()
    filled = pc.not_equal(words, "")  # blanks at either end leave empty words
    ends = np.concatenate([[0], np.cumsum(filled.to_numpy(zero_copy_only=False))])
    return words.filter(filled).cast(pa.binary()), ends[split.offsets.to_numpy()]


def word_counts(texts):
    """`word`, `n` over all texts, summed per task first."""

    def run(batches):
        held, size = [], 0

        def summed():
            return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"}).select(["word", "n"])

        for batch in slices(batches):
            counts = words_of(batch.column("text"))[0].value_counts()
            held.append(pa.table({"word": counts.field("values"), "n": counts.field("counts")}))
            size += held[-1].nbytes
            if size > 2 * _COUNTED:
                held = [summed()]
                size = held[0].nbytes
                if size > _COUNTED:
                    yield from held[0].to_batches()
                    held, size = [], 0
        if held:
            yield from summed().to_batches()

    return texts.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def bucket(word):
    return xxhash.xxh3_64_intdigest(word) % BUCKETS


def shares(counts, words):
    """`word`, `n` and `log_share` of every word of `counts` but `words`: its share of all words of its bucket."""
    shared = counts.sparkSession.sparkContext.broadcast(words)
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64()), ("bucket", pa.int32())])

    def hashed(batches):
        own = pa.array(shared.value, pa.binary())
        for batch in batches:
            word = batch.column("word").cast(pa.binary())
            rare = pc.invert(pc.is_in(word, own))
            word = word.filter(rare)
            at = np.fromiter(map(bucket, word.to_pylist()), np.int32, len(word))
            yield pa.RecordBatch.from_arrays([word, batch.column("n").filter(rare), pa.array(at)], schema=schema)

    # Written once, so that words are hashed once.
    rare = stage(counts.select("word", "n").mapInArrow(hashed, "word binary, n long, bucket int"))
    totals = rare.groupBy("bucket").agg(F.sum("n").alias("total"))  # BUCKETS rows
    return rare.join(F.broadcast(totals), "bucket").select("word", "n", F.log(F.col("n") / F.col("total")).alias("log_share"))


def split_shares(rare, most=KNOWN):
    """(shares of the more frequent words as two lists, table of all others): the first has at most `most` words, by a least count."""
    sizes = sorted(((r["n"], r["words"]) for r in rare.groupBy("n").agg(F.count("*").alias("words")).collect()), reverse=True)
    least, total = None, 0
    for n, words in sizes:  # one row per different count
        total += words
        if total > most:
            break
        least = n
    if least is None:
        return ([], []), rare
    known = rare.filter(F.col("n") >= least).select("word", "n", "log_share").toArrow().sort_by([("n", "descending")])  # what is read often lies together
    return (known.column("word").to_pylist(), known.column("log_share").to_pylist()), rare.filter(F.col("n") < least)


class Coder(dict):
    """Numbers of words: the most frequent WORDS by rank, others by hash bucket (kept for a while)."""

    def __init__(self, words):
        super().__init__((w, i) for i, w in enumerate(words))
        self.own = dict(self)

    def __missing__(self, word):
        if len(self) > 400_000:
            self.clear()
            self.update(self.own)
        self[word] = out = self.own[word] if word in self.own else WORDS + bucket(word)
        return out

    def numbers(self, words):
        return np.fromiter(map(self.__getitem__, words), np.int16, len(words))


def in_line(parts):
    """Numbers of several texts in one line with edges between them; places of the words, and the text of each."""
    edge = np.full(2, EDGE, np.int16)
    sizes = np.array([len(p) for p in parts], np.int64)
    line = np.concatenate([edge, *(x for p in parts for x in (p, edge))])
    owner = np.repeat(np.arange(len(parts)), sizes)
    at = np.arange(len(owner)) + 2 * (owner + 1)
    return line, at, owner


class Shares(dict):
    """Words to places of two arrays: the word's number, and its share of a bucket, `open_share` where it is to be joined.

    Named words are found together; the dictionary holds the places of others for a while.
    """

    open_share = 1.0  # no logarithm of a share is positive

    @classmethod
    def arrays(cls, words, known):
        """All named words with their places' numbers and shares, buckets last; made once and sent to the tasks."""
        rare, shares = known
        ids = np.array([*range(len(words)), *(WORDS + bucket(w) for w in rare), *range(WORDS, WORDS + BUCKETS)], np.int16)
        return [*words, *rare], ids, np.array([*[0.0] * len(words), *shares, *[cls.open_share] * BUCKETS])

    def __init__(self, named, ids, shares):
        super().__init__()
        self.named = pa.array(named, pa.binary())
        self.first = len(named)  # places of the buckets
        self.ids, self.shares = ids, shares

    def __missing__(self, word):
        if len(self) >= 400_000:
            self.clear()
        self[word] = out = self.first + bucket(word)
        return out

    def read(self, words):
        """Numbers and shares of words, a list or a column of bytes."""
        words = words if isinstance(words, pa.Array) else pa.array(words, pa.binary())
        at = np.array(pc.fill_null(pc.index_in(words, self.named), -1))
        others = np.flatnonzero(at < 0)
        at[others] = np.fromiter(map(self.__getitem__, words.take(pa.array(others)).to_pylist()), np.int32, len(others))
        return self.ids[at], self.shares[at]


class Network:
    """Parameters in one flat array: embeddings per place around the word, class weights, word weights."""

    SHAPES = ((len(AROUND), SIZE, WIDTH), (WIDTH,), (WIDTH, CLASSES), (CLASSES,), (CLASSES, WIDTH, PER_CLASS), (CLASSES, PER_CLASS))

    def __init__(self, flat=None):
        sizes = [int(np.prod(s)) for s in self.SHAPES]
        if flat is None:
            flat = np.random.default_rng(5).normal(0, 0.1, sum(sizes)).astype(np.float32)
        self.flat = np.array(flat, np.float32)
        self.parts, i = [], 0
        for shape, n in zip(self.SHAPES, sizes):
            self.parts.append(self.flat[i : i + n].reshape(shape))
            i += n

    def near(self, line, at):
        """Numbers of the words around each place, one list per place around."""
        return [line[at + off].astype(np.intp) for off in AROUND]

    @staticmethod
    def room(n):
        """Arrays that all batches of up to `n` places use: memory fresh from the system costs more than the work in it."""
        return [np.ones((n, width), np.float32) for width in (WIDTH, WIDTH, WIDTH + 1, CLASSES, PER_CLASS)]

    def hidden(self, near, plain, taken, h):
        """tanh of the summed embeddings in `plain`, and in `h` before a last column of ones that carries the weights' bias."""
        emb, bias = self.parts[:2]
        emb[0].take(near[0], axis=0, out=plain, mode="clip")
        for own, words in zip(emb[1:], near[1:]):
            own.take(words, axis=0, out=taken, mode="clip")
            plain += taken
        plain += bias
        np.tanh(plain, out=plain)
        h[:, :WIDTH] = plain

    def class_weights(self):
        """Class weights with their bias as the last line."""
        _, _, wc, bc, _, _ = self.parts
        return np.concatenate([wc, bc[None]])

    def word_weights(self):
        """Word weights of each class with their bias as the last line."""
        _, _, _, _, ww, bw = self.parts
        return np.concatenate([ww, bw[:, None]], axis=1)

    @staticmethod
    def _by_class(words):
        """Order of the words by class; class, place in it, and the classes that occur with their stretch of the order."""
        words = words.astype(np.int16, copy=False)  # short numbers are sorted by radix
        order = np.argsort(words, kind="stable")
        cls, rest = np.divmod(words[order], np.int16(PER_CLASS))
        ends = np.searchsorted(cls, np.arange(CLASSES + 1, dtype=np.int16)).tolist()
        return order, cls, rest, [(c, slice(ends[c], ends[c + 1])) for c in range(CLASSES) if ends[c] < ends[c + 1]]

    @staticmethod
    def _within(h, weights, classes, z):
        """Scores of the words of each row's class, class by class, in `z`."""
        for c, rows in classes:
            np.matmul(h[rows], weights[c], out=z[rows])
        return z

    @staticmethod
    def _exp(z, weights):
        """Exponentials in place, and the sum of each row."""
        # No input exceeds one, so no score exceeds the sizes of its weights together.
        if not np.abs(weights).sum(axis=-2).max() < _MOST:
            np.clip(z, -_MOST, _MOST, out=z)
        np.exp(z, out=z)
        return z @ np.ones(z.shape[1], np.float32)

    @classmethod
    def _log_of(cls, z, chosen, weights):
        """Log of the softmax of each row at its chosen column."""
        own = np.clip(z[np.arange(len(z)), chosen], -_MOST, _MOST)
        return own - np.log(cls._exp(z, weights))

    @classmethod
    def _error(cls, z, chosen, weights, scale):
        """Softmax of each row less one at its chosen column, times `scale`."""
        z *= (scale / cls._exp(z, weights))[:, None]
        z[np.arange(len(z)), chosen] -= scale
        return z

    def log_probs(self, line, at):
        """Log-probability of the word at each place, given the words around it."""
        class_weights, word_weights = self.class_weights(), self.word_weights()
        line = line.astype(np.int16, copy=False)
        out = np.empty(len(at), np.float64)
        room = self.room(min(BATCH, len(at)))
        for i in range(0, len(at), BATCH):
            a = at[i : i + BATCH]
            order, cls, rest, classes = self._by_class(line[a])
            plain, taken, h, z, e = (x[: len(a)] for x in room)
            self.hidden(self.near(line, a[order]), plain, taken, h)
            lp = self._log_of(np.matmul(h, class_weights, out=z), cls, class_weights).astype(np.float64)
            out[i + order] = lp + self._log_of(self._within(h, word_weights, classes, e), rest, word_weights)
        return out

    def train(self, line, at, squares):
        """One pass over the places in the given order; steps scaled by past squared gradients.

        The places of a batch are put in order of their words, so that each class is one stretch of rows.
        The embeddings' gradients are summed column by column.
        """
        emb, bias, wc, bc, ww, bw = self.parts
        se, sb, sc, sbc, sw, sbw = squares.parts
        line = line.astype(np.int16, copy=False)
        most = min(BATCH, len(at))
        room = self.room(most)
        wide, total = np.empty((WIDTH, most)), np.empty((len(AROUND), WIDTH, SIZE), np.float32)
        moved, root = np.empty_like(emb), np.empty_like(emb)

        def step(w, s, g, root=None):
            root = np.multiply(g, g, out=root)
            s += root
            np.add(s, np.float32(1e-6), out=root)
            np.sqrt(root, out=root)
            np.divide(g, root, out=root)
            root *= np.float32(RATE)
            w -= root

        for i in range(0, len(at), BATCH):
            a = at[i : i + BATCH]
            order, cls, rest, classes = self._by_class(line[a])
            plain, dh, h, z, e = (x[: len(a)] for x in room)
            near = self.near(line, a[order])
            self.hidden(near, plain, dh, h)
            scale = np.float32(1 / len(a))
            class_weights, word_weights = self.class_weights(), self.word_weights()
            d = self._error(np.matmul(h, class_weights, out=z), cls, class_weights, scale)
            e = self._error(self._within(h, word_weights, classes, e), rest, word_weights, scale)
            np.matmul(d, wc.T, out=dh)
            g = np.zeros_like(word_weights)
            for c, rows in classes:
                dh[rows] += e[rows] @ ww[c].T
                np.matmul(h[rows].T, e[rows], out=g[c])
            step(ww, sw, g[:, :WIDTH])
            step(bw, sbw, g[:, WIDTH])
            g = h.T @ d
            step(wc, sc, g[:WIDTH])
            step(bc, sbc, g[WIDTH])
            plain *= plain
            dh *= np.subtract(1, plain, out=plain)
            step(bias, sb, dh.sum(axis=0))
            each = wide[:, : len(a)]
            each[:] = dh.T
            for words, sums in zip(near, total):
                for x, out in zip(each, sums):
                    out[:] = np.bincount(words, x, SIZE)
            moved[:] = total.transpose(0, 2, 1)
            step(emb, se, moved, root)


def numbered(texts, words, known):
    """doc_id, row, `h` (a hash of the text), n_tokens, `share` (sum of the logarithms known), `ids` and the words whose share is `open`."""
    shared = texts.sparkSession.sparkContext.broadcast(Shares.arrays(words, known))
    names = [("doc_id", pa.int64()), ("row", pa.int64()), ("h", pa.int64()), ("n_tokens", pa.int64()), ("share", pa.float64()), ("ids", pa.binary()), ("open", pa.list_(pa.binary()))]
    schema = pa.schema(names)

    def run(batches):
        coder = Shares(*shared.value)
        for batch in slices(batches):
            words, ends = words_of(batch.column("text"))
            sizes = np.diff(ends)
            own, part = coder.read(words)
            away = part == Shares.open_share
            share = np.bincount(np.repeat(np.arange(len(sizes)), sizes), np.where(away, 0.0, part), len(sizes))
            ids = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((own.itemsize * ends).astype(np.int32)), pa.py_buffer(own)])
            far = np.concatenate([[0], np.cumsum(away)])[ends].astype(np.int32)
            far = pa.ListArray.from_arrays(pa.array(far), words.filter(pa.array(away)))
            made = [pa.array(sizes, pa.int64()), pa.array(share, pa.float64()), ids, far]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "row", "h")] + made, schema=schema)

    # Written once, so that the rows' numbers hold.
    slim = texts.select("doc_id", F.monotonically_increasing_id().alias("row"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "text")
    return stage(slim.mapInArrow(run, "doc_id long, row long, h long, n_tokens long, share double, ids binary, open array<binary>"))


def train(lines):
    """The network trained on all rows (`h`, `n_tokens`, `ids`)."""
    sc = lines.sparkSession.sparkContext
    net = Network()
    schema = pa.schema([("part", pa.int32()), ("n", pa.int64()), ("total", pa.binary())])
    total = lines.agg(F.sum("n_tokens")).first()[0] or 0
    parts = -(-total // PART_WORDS)
    rounds = min(parts, max(2, parts.bit_length() // 2))

    def learn(shared):
        def run(batches):
            key, held, size, state = None, [], 0, None

            def work():
                net, squares, rng, n = state
                line, at, _ = in_line(held)
                net.train(line, rng.permutation(at), squares)
                return net, squares, rng, n + len(at)

            def out():
                sums = np.array_split(state[0].flat.astype(np.float64) * state[3], _PARTS)
                return pa.RecordBatch.from_arrays([pa.array(range(_PARTS), pa.int32()), pa.array([state[3]] * _PARTS, pa.int64()), pa.array([t.tobytes() for t in sums], pa.binary())], schema=schema)

            for batch in batches:
                for p, ids in zip(batch.column("p").to_pylist(), batch.column("ids").to_pylist()):
                    if p != key:
                        if key is not None:
                            state = work() if held else state
                            yield out()
                        key, held, size = p, [], 0
                        state = Network(shared.value), Network(np.zeros_like(shared.value)), np.random.default_rng(3), 0
                    held.append(np.frombuffer(ids, np.int16))
                    size += len(held[-1])
                    if size >= PIECE_WORDS:
                        state, held, size = work(), [], 0
            if key is not None:
                state = work() if held else state
                yield out()

        return run

    def add(batches):
        sums = {}
        for batch in batches:
            for part, n, total in zip(*(c.to_pylist() for c in batch.columns)):
                m, t = sums.get(part, (0, 0.0))
                sums[part] = m + n, t + np.frombuffer(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([m for m, _ in sums.values()], pa.int64()), pa.array([t.tobytes() for _, t in sums.values()], pa.binary())], schema=schema
        )

    kind = "part int, n long, total binary"
    dealt = lines.filter("n_tokens > 0").select(F.pmod("h", F.lit(max(parts, 1))).alias("p"), "h", "ids")
    for k in range(rounds):
        shared = sc.broadcast(net.flat)
        mine = dealt.filter(F.col("p") % rounds == k).repartition(-(-parts // rounds), "p").sortWithinPartitions("p", "h")
        sums = mine.mapInArrow(learn(shared), kind).repartition("part").mapInArrow(add, kind).collect()  # one network
        if sums:
            sums.sort(key=lambda r: r["part"])
            net = Network(np.concatenate([np.frombuffer(r["total"]) / r["n"] for r in sums]))
    return net


def score(docs):
    """doc_id, n_tokens, log_prob (summed) and mean_log_prob of every row.

    A null or empty text has no words: log_prob 0 and no mean.  Equal texts get equal scores up to rounding;
    an empty table gives an empty result; other columns are ignored.
    """
    text = F.col("text").cast("string").alias("text")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text)
    counts = stage(word_counts(texts))
    words = [bytes(r["word"]) for r in counts.orderBy(F.desc("n"), "word").limit(WORDS).collect()]
    known, others = split_shares(shares(counts, words))
    lines = numbered(texts, words, known)
    shared = docs.sparkSession.sparkContext.broadcast(train(lines).flat)
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n_tokens", pa.int64()), ("log_prob", pa.float64())])

    def run(batches):
        net = Network(shared.value)
        for batch in slices(batches, "ids"):
            line, at, owner = in_line([np.frombuffer(x, np.int16) for x in batch.column("ids").to_pylist()])
            total = np.bincount(owner, net.log_probs(line, at), batch.num_rows) + batch.column("share").to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "row", "n_tokens")] + [pa.array(total.astype(np.float64))], schema=schema)

    # Written before the join, so that texts are scored once.
    out = stage(lines.select("doc_id", "row", "n_tokens", "share", "ids").mapInArrow(run, "doc_id long, row long, n_tokens long, log_prob double"))
    far = lines.select("row", F.explode("open").alias("word"))
    more = far.join(others, "word").groupBy("row").agg(F.sum("log_share").alias("more"))
    out = out.join(more, "row", "left").withColumn("log_prob", F.col("log_prob") + F.coalesce("more", F.lit(0.0)))
    return out.select("doc_id", "n_tokens", "log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")).alias("mean_log_prob"))


def op9_pseudo_likelihood(spark, sf_dir):
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))

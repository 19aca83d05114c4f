"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every text.  Expectation-maximisation estimates how
often each labeller is right, from the counts of vote patterns over all texts (their number is
bounded, whatever the number of texts), and gives every pattern a posterior probability.  A linear
scorer over hashed words is trained on a bounded sample with these posteriors as soft labels, and
scores every text.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from noticeflow.llm.common import slices, word_hashes

#: Texts the scorer is trained on at most: those with the smallest hash of doc_id and text.
SAMPLE = 6000
BITS = 18
#: Below one half: a clean text lost costs more than a poor one kept.
THRESHOLD = 0.35
_SYMBOLS = b"#*$%&|<>"
LABELLERS = ("symbols", "capitals", "stutter", "variety", "sentences", "markers", "word_length")


def votes(text):
    """One vote per labeller: 1 good, -1 bad, 0 none.  Texts under 5 words get no votes."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    if n < 5:
        return (0,) * len(LABELLERS)
    symbols = (len(raw) - len(raw.translate(None, _SYMBOLS))) / n
    capitals = sum(w.isupper() and len(w) > 1 for w in words) / n
    stutter = sum(a == b for a, b in zip(words, words[1:])) / n
    parts = [words[i : i + 400] for i in range(0, n, 400)]  # long texts repeat words by nature
    variety = sum(len(set(p)) for p in parts) / n
    ends = sum(w[-1] in b".,;:!?" for w in words) / n
    marked = sum(w[-1] in b"!*#$%&|" for w in words) / n
    length = sum(map(len, words)) / n

    def vote(x, good, bad):
        return 1 if x <= good else -1 if x >= bad else 0

    return (
        vote(symbols, 0.05, 0.3), vote(capitals, 0.1, 0.5), vote(stutter, 0.08, 0.3), vote(-variety, -0.45, -0.3),
        1 if 0.05 <= ends <= 0.35 else -1 if ends > 0.8 else 0, vote(marked, 0.05, 0.3), vote(abs(length - 5.5), 1.2, 3.0),
    )


def _slim(docs):
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def vote_patterns(texts):
    """Counts of vote patterns over all texts: `pattern` (base 3) and `n`."""
    schema = pa.schema([("pattern", pa.int32()), ("n", pa.int64())])

    def run(batches):
        seen = {}
        for batch in slices(batches):
            for t in batch.column("text").to_pylist():
                p = 0
                for v in votes(t):
                    p = 3 * p + v + 1
                seen[p] = seen.get(p, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), pa.array(list(seen.values()), pa.int64())], schema=schema)

    return texts.select("text").mapInArrow(run, "pattern int, n long").groupBy("pattern").agg(F.sum("n").alias("n"))


class LabelModel:
    """Share of good texts and, for each labeller, the probability of each vote given good or bad."""

    def __init__(self, table, rounds=100):
        m = len(LABELLERS)
        self.patterns = np.array([p for p, _ in table], np.int64).reshape(-1)
        n = np.array([c for _, c in table], np.float64)
        v = self.patterns[:, None] // 3 ** np.arange(m - 1, -1, -1) % 3  # 0 bad, 1 none, 2 good
        self.rows = int(n.sum())
        one_hot = (v[:, :, None] == np.arange(3)).astype(np.float64)
        good = 1 / (1 + np.exp(-(v - 1.0).sum(axis=1)))  # start: majority
        for _ in range(rounds):
            self.share = float(((n * good).sum() + 1) / (n.sum() + 2))
            self.p = []
            for q in (good, 1 - good):
                w = np.einsum("i,ijk->jk", n * q, one_hot) + 1.0
                self.p.append(w / w.sum(axis=1, keepdims=True))
            odds = np.log(self.share / (1 - self.share)) + np.einsum("ijk,jk->i", one_hot, np.log(self.p[0]) - np.log(self.p[1]))
            good = 1 / (1 + np.exp(-odds.clip(-30, 30)))
        self.posterior = dict(zip(self.patterns.tolist(), good.tolist()))

    def accuracies(self):
        """Probability that a vote is right, given that there is one."""
        right = self.share * self.p[0][:, 2] + (1 - self.share) * self.p[1][:, 0]
        wrong = self.share * self.p[0][:, 0] + (1 - self.share) * self.p[1][:, 2]
        return dict(zip(LABELLERS, right / (right + wrong)))

    def of(self, text):
        p = 0
        for v in votes(text):
            p = 3 * p + v + 1
        return self.posterior.get(p, self.share)


_MIX = np.uint64(0x9E3779B97F4A7C15)


def features(text):
    """Hashed indices and weights: the text's words and their forms, square roots of counts, of length 1."""
    words = (text or "").encode().split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    forms = [_form(w) for w in words]
    with np.errstate(over="ignore"):
        h = word_hashes(forms)
        h = np.concatenate([h, (h[:-1] * _MIX) ^ h[1:], word_hashes(words) * _MIX])
    at, n = np.unique((h >> np.uint64(64 - BITS)).astype(np.int64), return_counts=True)
    w = np.sqrt(n).astype(np.float32)
    return at, w / np.sqrt((w * w).sum())


class _Forms(dict):
    """A word's form: the kind of its characters, runs as one, and a mark for repetition-prone lengths."""

    def __missing__(self, word):
        kinds = []
        for c in word:
            k = b"A" if 65 <= c <= 90 else b"a" if 97 <= c <= 122 or c > 127 else b"0" if 48 <= c <= 57 else bytes([c])
            if not kinds or kinds[-1] != k:
                kinds.append(k)
        if len(self) > 300_000:
            self.clear()
        self[word] = out = b"form:" + b"".join(kinds)
        return out


_FORM = _Forms()
_form = _FORM.__getitem__


def train(samples, labels, epochs=6, rate=4.0, l2=1e-5):
    """Logistic regression on soft labels by stochastic gradient steps in a fixed order; classes weigh the same."""
    w, bias = np.zeros(1 << BITS, np.float64), 0.0
    if not samples:
        return w, bias
    labels = np.asarray(labels)
    share = min(max(float(labels.mean()), 1e-3), 1 - 1e-3)
    rng = np.random.default_rng(7)
    for e in range(epochs):
        step = rate / (1 + e)
        for i in rng.permutation(len(samples)):
            at, x = samples[i]
            p = 1 / (1 + np.exp(-np.clip(w[at] @ x + bias, -30, 30)))
            y = labels[i]
            g = y * (1 - p) / (2 * share) - (1 - y) * p / (2 * (1 - share))
            w[at] += step * (g * x - l2 * w[at])
            bias += 0.05 * step * g
    return w, bias


def fit(docs, sample=SAMPLE):
    """The label model over all texts, and the scorer trained on at most `sample` of them."""
    texts = _slim(docs)
    model = LabelModel([(r["pattern"], r["n"]) for r in vote_patterns(texts).collect()])  # 3^7 patterns at most
    order = F.xxhash64(F.lit("sample"), "doc_id", F.xxhash64("text"))
    # A hash threshold draws a little less than `sample` rows; take() only guards against bad luck.
    share = min(1.0, 0.95 * sample / max(model.rows, 1))
    limit = min((1 << 63) - 1, int(-(1 << 63) + share * (1 << 64)))
    rows = texts.filter(order <= F.lit(limit)).mapInArrow(_featured(model), "at array<int>, w array<float>, label double").take(sample)
    samples = [(np.array(r["at"], np.int64), np.array(r["w"], np.float32)) for r in rows]
    return model, train(samples, [r["label"] for r in rows])


def _featured(model):
    schema = pa.schema([("at", pa.list_(pa.int32())), ("w", pa.list_(pa.float32())), ("label", pa.float64())])

    def run(batches):
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            f = [features(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array([a for a, _ in f], schema.field(0).type), pa.array([w for _, w in f], schema.field(1).type), pa.array([model.of(t) for t in texts])],
                schema=schema,
            )

    return run


def classify(docs, sample=SAMPLE, threshold=THRESHOLD):
    """doc_id, `weak` (posterior of the label model), `score` and `good` of every row.

    Null texts count as empty: they get no votes and the scorer's bias.  Repeated rows get equal
    results; an empty table gives an empty result; other columns are ignored.
    """
    model, (w, bias) = fit(docs, sample)
    shared = docs.sparkSession.sparkContext.broadcast((model, w.astype(np.float32), bias))
    schema = pa.schema([("doc_id", pa.int64()), ("weak", pa.float64()), ("score", pa.float64())])

    def run(batches):
        model, w, bias = shared.value
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            z = np.array([float(w[at] @ x) for at, x in map(features, texts)]) + bias
            weak = [model.of(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(weak, pa.float64()), pa.array(1 / (1 + np.exp(-z.clip(-30, 30))))], schema=schema)

    out = _slim(docs).mapInArrow(run, "doc_id long, weak double, score double")
    return out.withColumn("good", F.col("score") >= threshold)


def kept(docs, **how):
    """The rows, with all their columns, that the classifier accepts; scored row by row, so nothing is joined."""
    model, (w, bias) = fit(docs, **how)
    shared = docs.sparkSession.sparkContext.broadcast((w.astype(np.float32), bias))
    line = np.log(THRESHOLD / (1 - THRESHOLD))

    def run(batches):
        w, bias = shared.value
        for batch in slices(batches):
            z = np.array([float(w[at] @ x) for at, x in map(features, batch.column("text").to_pylist())]) + bias
            yield batch.filter(pa.array(z >= line))

    return docs.mapInArrow(run, docs.schema)


def op8_quality(spark, sf_dir):
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"))

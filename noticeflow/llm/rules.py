"""Quality rules with robust multivariate outliers.

Five statistics of every text are transformed and compared with the minimum-covariance-determinant
estimate of the text's language and source: mean and covariance of those `SHARE` of the rows whose
covariance has the least determinant.  The search takes concentration steps from several starts, one of
medians and spreads and others of random subsets: each step adds up counts, sums and products per
distance class of a group, so one aggregation gives the moments of the closest rows without collecting
any group.  After two steps the best starts go on until they stand still, and the least determinant wins.
Equal vectors of statistics count once in an estimate, so copies don't outweigh other texts.
"""

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeflow.llm.common import slices, stage, word_hashes

SHARE = 0.75
#: Starts per group, those that go on after the first two steps (start 0 always does), and steps at most.
STARTS, FINALISTS, STEPS = 5, 3, 25
#: Rows of the random subset a start is taken from, about.
SUBSET = 40
#: Groups with fewer rows, or fewer different ones, take the estimate of their language, then of all rows.
LEAST_ROWS, LEAST_DIFFERENT = 30, 15
#: Squared Mahalanobis distance beyond which a text is rejected, in the scale of a chi-square value with 5
#: degrees of freedom.  Normal statistics would never exceed it; those of clean texts have longer tails.
CUTOFF = 70.0
#: Variance added in every direction: numerical size, far under the spread of any statistic.
FLOOR = 1e-6

FEATURES = ("f_words", "f_length", "f_marks", "f_distinct", "f_lines")
#: Distance classes per doubling of the squared distance.
_FINE = 16
#: What stays of a text are its ASCII digits and marks.
_NO_MARKS = bytes(b for b in range(256) if b >= 128 or chr(b).isalpha() or chr(b).isspace())
_SYMBOLS = b"#*$%&|<>"
_BLANKS = " \t\n\v\f\r"


def repeated_words(words, width=8):
    """Words that lie in a `width`-word window found twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    with np.errstate(over="ignore"):
        h = word_hashes(words)
        step = 1
        while step < width:  # windows of 2, 4, 8 words
            h = h[:-step] * np.uint64(0x9E3779B97F4A7C15 + 2 * step) + (h[step:] ^ (h[step:] >> np.uint64(31)))
            step *= 2
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    hit = np.zeros(n, bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    at = np.flatnonzero(hit)
    counts = {}
    windows = [tuple(words[i : i + width]) for i in at]  # equal hashes are checked word by word
    for w in windows:
        counts[w] = counts.get(w, 0) + 1
    cover = np.zeros(len(words) + 1, np.int64)
    for i, w in zip(at, windows):
        if counts[w] > 1:
            cover[i] += 1
            cover[i + width] -= 1
    return int((np.cumsum(cover) > 0).sum())


def statistics(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    raw = (text or "").encode()
    words = raw.split()  # bytes split at exactly these six blanks
    chars = len(text or "") - (len(raw) - sum(map(len, words)))
    lines = [x for x in (text or "").split("\n") if x.strip(_BLANKS)]
    return (
        len(words), chars, len(raw) - len(raw.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words),
    )


def _shape(text):
    """n_lines, n_distinct (words), n_marks of one text."""
    raw = (text or "").encode()
    return raw.count(b"\n") + 1, len(set(raw.split())), len(raw.translate(None, _NO_MARKS))


def text_statistics(docs):
    """doc_id, lang, source, the base statistics and those of shape of every whole text (null: no words)."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_marks"]
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("source", pa.string())] + [(n, pa.int64()) for n in names])

    def run(batches):
        for batch in slices(batches):
            rows = [(*statistics(t), *_shape(t)) for t in batch.column("text").to_pylist()]
            cols = [batch.column(c) for c in ("doc_id", "lang", "source")]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in ("text", "lang", "source")])
    return slim.mapInArrow(run, "doc_id long, lang string, source string, " + ", ".join(f"{n} long" for n in names))


def transformed(stats):
    """Adds the statistics in a scale on which clean texts are near normal and none is constant in most texts.

    Words, their mean length, the odds of digits and marks (which symbols raise), different words (which
    repeated lines and windows lower, given the words), and words per line.
    """
    return (
        stats.withColumn("f_words", F.log1p("n_words"))
        .withColumn("f_length", F.log((F.col("word_chars") + 30.0) / (F.col("n_words") + 6.0)))
        .withColumn("f_marks", F.log((F.col("n_marks") + 1.0) / (F.col("word_chars") - F.col("n_marks") + 20.0)))
        .withColumn("f_distinct", F.log1p("n_distinct"))
        .withColumn("f_lines", F.log((F.col("n_words") + 1.0) / F.col("n_lines")))
    )


_D = len(FEATURES)
_MOMENTS = [f"s_{i}" for i in range(_D)] + [f"p_{i}_{j}" for i in range(_D) for j in range(i + 1)]


def _distance(prefix=""):
    """Squared Mahalanobis distance from columns m_i (mean) and w_i_j (lower half of the inverse covariance)."""
    x = [F.col(f) - F.col(f"m_{i}") for i, f in enumerate(FEATURES)]
    terms = [F.col(f"w_{i}_{j}") * x[i] * x[j] * (1 if i == j else 2) for i in range(_D) for j in range(i + 1)]
    return F.greatest(sum(terms[1:], terms[0]), F.lit(0.0))


_MODEL = T.StructType(
    [T.StructField(f"m_{i}", T.DoubleType()) for i in range(_D)]
    + [T.StructField(f"w_{i}_{j}", T.DoubleType()) for i in range(_D) for j in range(i + 1)]
    + [T.StructField("log_det", T.DoubleType())]
)


def _model(mean, cov):
    """Mean and inverse covariance as columns, and the logarithm of the determinant."""
    cov = cov + FLOOR * np.eye(_D)
    inverse = np.linalg.inv(cov)
    return [*map(float, mean), *(float(inverse[i, j]) for i in range(_D) for j in range(i + 1)), float(np.linalg.slogdet(cov)[1])]


def _moments(n, sums):
    """Mean and covariance from a count and the sums named in _MOMENTS."""
    mean, cov = np.array(sums[:_D]) / n, np.zeros((_D, _D))
    at = _D
    for i in range(_D):
        for j in range(i + 1):
            cov[i, j] = cov[j, i] = sums[at] / n - mean[i] * mean[j]
            at += 1
    return mean, cov


def kept_variance(share, most=60.0, cells=600_000):
    """What the closest `share` of normal rows in _D dimensions keep of their variance: the factor of consistency."""
    x = (np.arange(cells) + 0.5) * (most / cells)
    density = x ** (_D / 2 - 1) * np.exp(-x / 2)
    below = np.cumsum(density) / density.sum()
    inner = below <= share
    return float((x[inner] * density[inner]).sum() / density.sum() / _D / share)


def _estimate(share):
    """Function from the distance classes of one start of a group to its next model; the classes are few, whatever the group's size.

    The class in which the share is reached counts in part, so every step keeps the same number of rows.
    """

    def run(key, frame):
        frame = frame.sort_values("cls")
        n = frame["n"].to_numpy(np.float64)
        before = np.cumsum(n) - n
        part = np.clip((share * n.sum() - before) / n, 0.0, 1.0)
        sums = (frame[_MOMENTS].to_numpy(np.float64) * part[:, None]).sum(axis=0)
        model = _model(*_moments((part * n).sum(), sums))
        return pd.DataFrame([[*key, *model, not abs(model[-1] - float(frame["old"].iloc[0])) < 1e-4]])

    return run


def _levels(rows):
    """Rows with the group each level puts them in: all rows, language, language and source; null is a value of its own."""
    lang = F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))
    source = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    sizes = lambda c: F.concat_ws("\x00", *c)
    return rows.withColumn("g0", F.lit("")).withColumn("g1", sizes([lang])).withColumn("g2", sizes([lang, source]))


def _sums():
    out = [F.sum(f).alias(f"s_{i}") for i, f in enumerate(FEATURES)]
    return out + [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"p_{i}_{j}") for i in range(_D) for j in range(i + 1)]


def _starts(base, starts):
    """First models of every group `k`: start 0 of medians and quartiles, the others of random subsets."""
    middle = base.groupBy("k").agg(*[F.percentile_approx(f, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 1000).alias(f) for f in FEATURES])
    sizes = base.groupBy("k").agg(F.count("*").alias("size"))
    drawn = [F.when(F.pmod(F.xxhash64(F.lit(s), *FEATURES), F.ceil(F.col("size") / SUBSET)) == 0, F.lit(s)) for s in range(1, starts)]
    subsets = base.join(sizes, "k").withColumn("start", F.explode(F.array_compact(F.array(F.lit(None).cast("int"), *drawn))))
    # Written, so that the sums of all tasks meet before a subset is turned into a model.
    subsets = stage(subsets.groupBy("k", "start").agg(F.count("*").alias("n"), *_sums()))

    def from_quartiles(frames):
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                q = np.array([getattr(r, f) for f in FEATURES], np.float64)
                out.append([r.k, 0, *_model(q[:, 1], np.diag(np.square((q[:, 2] - q[:, 0]) / 1.349)))])
            yield pd.DataFrame(out, columns=["k", "start", *_MODEL.names])

    def from_subsets(frames):
        for frame in frames:
            out = [[r["k"], r["start"], *_model(*_moments(r["n"], [r[c] for c in _MOMENTS]))] for r in frame.to_dict("records")]
            yield pd.DataFrame(out, columns=["k", "start", *_MODEL.names])

    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("start", T.IntegerType()), *_MODEL.fields])
    return stage(middle.mapInPandas(from_quartiles, schema).union(subsets.mapInPandas(from_subsets, schema)))


def _step(base, models, share):
    """The models after one concentration step, with `moved`."""
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("start", T.IntegerType()), *_MODEL.fields, T.StructField("moved", T.BooleanType())])
    cls = F.floor(F.log2(_distance() + 1e-3) * _FINE).cast("int")
    # Written by group and class, so that the sums of all tasks meet before a group does.
    classes = base.join(models, "k").groupBy("k", "start", cls.alias("cls")).agg(F.count("*").alias("n"), F.first("log_det").alias("old"), *_sums())
    return stage(stage(classes).groupBy("k", "start").applyInPandas(_estimate(share), schema))


def fit(rows, share=SHARE, steps=STEPS, least_rows=LEAST_ROWS, starts=STARTS):
    """Rows with their group `g`, its model columns and `log_det`: the finest of three levels with enough rows."""
    rows = _levels(rows)
    counted = stage(rows.groupBy("g0", "g1", "g2", *FEATURES).agg(F.count("*").alias("n")))
    vectors = counted.drop("n")
    sizes = counted.groupBy("g1", "g2").agg(F.sum("n").alias("n2"), F.count("*").alias("d2"))
    per_lang = sizes.groupBy("g1").agg(F.sum("n2").alias("n1"), F.sum("d2").alias("d1"))
    enough = lambda k: (F.col(f"n{k}") >= least_rows) & (F.col(f"d{k}") >= min(LEAST_DIFFERENT, least_rows))
    level = F.when(enough(2), F.col("g2")).when(enough(1), F.col("g1")).otherwise(F.lit(""))
    groups = stage(sizes.join(per_lang, "g1").select("g2", level.alias("g")))
    rows = stage(rows.join(groups, "g2"))  # skewed sources are split: both sides are plain tables

    # The rows a group's estimate rests on: its own, for coarse groups those of all finer ones as well.
    spread = F.explode(F.array_distinct(F.array("g2", "g1", "g0")))
    wanted = groups.select(F.col("g").alias("k")).distinct()
    base = stage(vectors.select(*FEATURES, spread.alias("k")).join(wanted, "k", "left_semi"))
    models = _starts(base, starts)
    best = F.row_number().over(Window.partitionBy("k").orderBy("log_det", "start"))
    done = []
    for n in range(steps):
        models = _step(base, models, share)
        if n == 1:
            models = stage(models.withColumn("_best", best).filter((F.col("_best") <= FINALISTS) | (F.col("start") == 0)).drop("_best"))
        if n >= 1:
            done.append(models.filter("not moved"))
            models = models.filter("moved")
            if models.isEmpty():
                break
    every = functools.reduce(lambda x, y: x.union(y), [*done, models])
    chosen = every.withColumn("_best", best).filter("_best = 1").drop("_best", "start", "moved")
    return rows.join(stage(chosen).withColumnRenamed("k", "g"), "g")


def judge(docs, cutoff=CUTOFF, **how):
    """doc_id, the base statistics, `base_failed`, `distance` (squared) and `kept` of every document.

    A null or empty text has no words and fails; null languages and sources are groups of their own;
    repeated rows give repeated results; an empty table gives an empty result.
    """
    stats = stage(transformed(text_statistics(docs)))
    consistent = kept_variance(how.get("share", SHARE))
    scored = fit(stats, **how).withColumn("distance", _distance() * consistent)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return scored.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (F.col("distance") <= cutoff)).alias("kept"), "distance", "lang", "source",
    )


def op5_rules(spark, sf_dir):
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("lang", "source")

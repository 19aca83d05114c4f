"""The minimum covariance determinant of the quality rules against a plain search on every group."""

import numpy as np
import pytest
from llm_cases import prose

from noticeflow.llm import rules

KIND = "doc_id long, " + ", ".join(f"{f} double" for f in rules.FEATURES) + ", lang string, source string"


def groups(spark, sizes, seed=0, copies=0):
    """Rows of statistics in groups of the given sizes, a twentieth far off, a twentieth only of the wrong correlation."""
    rng, rows = np.random.default_rng(seed), []
    for g, n in enumerate(sizes):
        mix = rng.normal(size=(5, 5)) * [1, 0.5, 0.3, 0.1, 0.05]
        x = rng.normal(size=(n, 5)) @ mix.T + rng.normal(size=5)
        x[: n // 20] += rng.normal(size=(n // 20, 5)) * 4 + 5
        for c in range(5):  # usual values that don't go together
            x[n // 20 : n // 10, c] = rng.choice(x[n // 10 :, c], n // 10 - n // 20)
        first = len(rows)
        rows += [(first + i, *map(float, v), "en", f"s{g}") for i, v in enumerate(x)]
        rows += [(first + n + i, *map(float, x[-1]), "en", f"s{g}") for i in range(copies)]
    return spark.createDataFrame(rows, KIND), rows


def plain_mcd(x, share, starts=200, seed=1):
    """Least determinant over many random starts of concentration steps on exact subsets: (log determinant, mean, covariance)."""
    rng, h, best = np.random.default_rng(seed), int(share * len(x)), None
    for _ in range(starts):
        at = rng.choice(len(x), 8, replace=False)
        last = None
        for _ in range(100):
            mean, cov = x[at].mean(axis=0), np.cov(x[at].T, bias=True) + rules.FLOOR * np.eye(5)
            det = np.linalg.slogdet(cov)[1]
            if last is not None and abs(det - last) < 1e-9:
                break
            last = det
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            at = np.argsort(d)[:h]
        if best is None or det < best[0]:
            best = det, mean, cov
    return best


@pytest.mark.parametrize("copies", [0, 300])
def test_estimates_are_those_of_a_plain_search(spark, copies):
    df, rows = groups(spark, (60, 150, 400), copies=copies)
    got = rules.fit(df).withColumn("distance", rules._distance()).collect()
    assert len(got) == len(rows)
    changed = 0
    for g in range(3):
        mine = sorted((r for r in got if r["source"] == f"s{g}"), key=lambda r: r["doc_id"])
        x = np.array([[r[f] for f in rules.FEATURES] for r in mine])
        det, mean, cov = plain_mcd(np.unique(x, axis=0), rules.SHARE)
        assert {r["g"] for r in mine} == {mine[0]["g2"]}
        assert abs(mine[0]["log_det"] - det) < 0.1  # classes of distances, and a share that ends within a class
        want = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean) * rules.kept_variance(rules.SHARE)
        have = np.array([r["distance"] for r in mine]) * rules.kept_variance(rules.SHARE)
        assert np.corrcoef(np.log(want), np.log(have))[0, 1] > 0.99
        assert ((want > 25) == (have > 25)).mean() > 0.985
        diagonal = (((x - mean) ** 2 / np.diag(cov)).sum(axis=1) * rules.kept_variance(rules.SHARE)) > 25
        changed += (diagonal != (have > 25)).sum()
        assert (have > 25)[: (60, 150, 400)[g] // 20].mean() > 0.8
    assert changed > 5  # correlations decide some verdicts


def test_factor_of_consistency():
    """Normal rows: the closest three quarters scaled by the factor have the covariance of all."""
    x = np.random.default_rng(0).normal(size=(200_000, 5))
    d = (x**2).sum(axis=1)
    inner = x[d <= np.quantile(d, 0.75)]
    assert abs(inner.var(axis=0).mean() / rules.kept_variance(0.75) - 1) < 0.01
    assert abs(rules.kept_variance(1.0) - 1) < 0.01


def test_more_starts_give_no_larger_determinant(spark):
    df, _ = groups(spark, (40, 80), seed=3)
    of = lambda n: {r["g"]: r["log_det"] for r in rules.fit(df, starts=n).select("g", "log_det").distinct().collect()}
    one, many = of(1), of(8)
    assert one.keys() == many.keys() and all(many[g] <= one[g] + 0.05 for g in one)


def test_copies_of_one_text_do_not_make_others_outliers(spark):
    texts = [prose(i, 4 + i % 9) for i in range(80)] + [prose(1, 6)] * 400
    df = spark.createDataFrame([(i, t, "en", "hot") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r["kept"] for r in rules.judge(df).collect()}
    assert sum(got[i] for i in range(80)) >= 76 and all(got[i] for i in range(80, 480))


def test_marks_and_shape():
    assert rules._shape("a# b\na# b\n\n \né*\x85|\n") == (6, 3, 4)
    assert rules._shape(None) == (1, 0, 0) and rules._shape("naïve 東京 12,5") == (1, 3, 4)

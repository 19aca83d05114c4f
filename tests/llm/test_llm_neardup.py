"""Weights and exact cells of the near-duplicate operator against plain versions."""

import collections
import random

import numpy as np
import pytest
from llm_cases import documents, prose

from noticeflow.llm import common, neardup


def edited(text, edits, seed):
    rng, words = random.Random(seed), text.split()
    for i in rng.sample(range(len(words)), edits):
        words[i] = f"e{seed}x{i}"
    return " ".join(words)


def brute_classes(texts, idf):
    sets, of = [neardup.weighted(t, idf) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if of[i] != of[j] and neardup.weighted_jaccard(sets[i], sets[j]) >= neardup.SIMILARITY:
                low, high = sorted((of[i], of[j]))
                of = [low if c == high else c for c in of]
    return of


def test_weights_are_the_stated_inverse_frequencies(spark, monkeypatch):
    """Every shingle has exactly the weight of its number of texts, those under the least share that of none."""
    monkeypatch.setattr(neardup, "LEAST_TEXTS", 1)
    monkeypatch.setattr(neardup, "LEAST_SHARE", 0.02)
    texts = [prose(i % 90, 3) + " " + prose(500 + i % 4, 2) + (" " + prose(600, 2) if i % 3 == 0 else "") for i in range(300)] + [None, "", "two words"]
    n, frequent = neardup.document_frequencies(documents(spark, texts))
    some = [t for t in texts if t is not None]
    assert n == len(some)
    counts = collections.Counter(h for t in some for h in neardup.shingles(t)[0].tolist())
    hashes = np.array(sorted(counts), np.uint64)
    share = np.array([counts[h] / n for h in hashes.tolist()])
    share[share < 0.02] = 0
    want = np.log((1 + 2 * neardup.SMOOTH) / (share + neardup.SMOOTH))
    got = neardup.inverse_frequencies(n, frequent).of(hashes)
    assert np.allclose(got, want, rtol=1e-6) and len(np.unique(got)) > 3
    assert np.corrcoef(got, want)[0, 1] > 0.999999


def test_frequent_shingles_are_bounded(spark):
    n, (keys, counts) = neardup.document_frequencies(documents(spark, [prose(i, 5) for i in range(50)]))
    assert n == 50 and len(keys) == 0  # of few texts none counts as common
    assert neardup.document_frequencies(documents(spark, []))[0] == 0


@pytest.mark.parametrize("dense,most", [(0.0, 50), (1 / 64, 200), (9.0, 7), (9.0, 10**6)])
def test_cell_similarities_equal_pairs(dense, most):
    rng = np.random.default_rng(3)
    idf = neardup.Weights(10**5, (np.array([5, 7, 11], np.uint64), np.array([9000, 50_000, 400])))

    def sets(n):
        out = []
        for _ in range(n):
            h = np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64))
            out.append((h, rng.integers(1, 4, len(h))))
        return out

    lines, columns = sets(23), sets(31)
    got = neardup.similarities(lines, columns, idf, dense, most)
    for i, a in enumerate(lines):
        for j, b in enumerate(columns):
            want = neardup.weighted_jaccard(*((h, n * idf.of(h)) for h, n in (a, b)))
            assert abs(got[i, j] - want) < 1e-5


def test_links_of_a_cell_join_what_pairs_join():
    rng = np.random.default_rng(5)
    idf = neardup.Weights(10, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    bases = [np.arange(100 * k, 100 * k + 60) for k in range(5)]
    nodes = []
    for i in range(60):
        h = bases[i % 5].copy()
        h[rng.choice(60, rng.integers(0, 9), replace=False)] = rng.integers(10_000, 10**6, 1)
        h = np.unique(h).astype(np.uint64)
        nodes.append((f"label{i if i % 7 else 0}", (h, np.ones(len(h), np.int64))))
    links = neardup._joining(nodes, nodes, idf, 0.8)
    labels = sorted({x for x, _ in nodes})

    def classes(pairs):
        of = dict(zip(labels, labels))
        for x, y in pairs:
            of = {k: of[x] if v == of[y] else v for k, v in of.items()}
        return {frozenset(k for k in labels if of[k] == v) for v in of.values()}

    all_pairs = [(nodes[i][0], nodes[j][0]) for i in range(60) for j in range(60) if neardup._exact(nodes[i][1], nodes[j][1], idf) >= 0.8]
    assert classes((nodes[i][0], nodes[j][0]) for i, j in links) == classes(all_pairs)
    assert len(links) == len(labels) - len(classes(all_pairs))


@pytest.mark.parametrize("cell", [5, 64])
def test_a_group_of_pairs_near_the_bound_in_a_grid_of_cells(spark, monkeypatch, cell):
    """One bucket of texts of 0.6 to 0.9 to each other, dealt over many cells: classes as by brute force over all pairs."""
    monkeypatch.setattr(neardup, "CHUNK", 8)
    monkeypatch.setattr(neardup, "CELL", cell)
    base = prose(1, 30)
    texts = [edited(base, 3 + s % 9, s) for s in range(70)]
    texts += [edited(t, 4, 100 + s) for s, t in enumerate(texts[:30])]
    idf = neardup.inverse_frequencies(*neardup.document_frequencies(documents(spark, texts)))
    want = brute_classes(texts, idf)
    assert 5 < len(set(want)) < 70
    got = {r["doc_id"]: r["class_id"] for r in neardup.classify(documents(spark, texts))[0].collect()}
    assert got == dict(enumerate(want))


def test_cells_are_bounded_and_cover_every_pair(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CELL", 10)
    rows = [(0, 1, f"n{i:03d}".encode(), 5) for i in range(95)] + [(1, 2, b"n000", 5), (1, 2, b"n001", 5)]
    met = spark.createDataFrame(rows, "band int, bucket long, node binary, size int")
    labels = spark.createDataFrame([(f"n{i:03d}".encode(), b"n000" if i < 60 else f"n{i:03d}".encode()) for i in range(95)], "node binary, label binary")
    cells = [r.asDict() for r in neardup._cells(met, labels).collect()]
    assert {r["band"] for r in cells} == {0}  # the other bucket is of one class
    per = collections.defaultdict(lambda: ([], []))
    for r in cells:
        per[r["i"], r["j"]][r["role"]].append(bytes(r["node"]))
    assert len(per) == 4 * 10 and all(max(len(a), len(b)) < 26 for a, b in per.values())
    pairs = {(x, y) for every, outside in per.values() for x in outside for y in every}
    nodes = [f"n{i:03d}".encode() for i in range(95)]
    assert pairs == {(x, y) for x in nodes[60:] for y in nodes}


def test_working_tables_are_deleted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common.scratch, "scratch_root", lambda _: str(tmp_path))
    rows, table = neardup.classify(documents(spark, [prose(1), prose(1), prose(2)]))
    assert len(list((tmp_path / "noticeflow").iterdir())) == 2  # what the two results read
    assert rows.count() == 3 and table.count() == 2


def test_maybe_in_keeps_all_that_are_in(spark):
    some, every = spark.range(0, 5000, 10).selectExpr("cast(id as string) as k"), spark.range(20_000).selectExpr("cast(id as string) as k").union(spark.sql("select cast(null as string)"))
    for bits in (1 << 15, 1 << 18):
        kept = {r[0] for r in common.maybe_in(every, "k", some, bits).collect()}
        assert {str(i) for i in range(0, 5000, 10)} <= kept and None not in kept and len(kept) < 1500

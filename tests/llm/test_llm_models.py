import cProfile
import collections
import functools
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from llm_cases import documents, prose, rows, tables
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from noticeflow.checks.compare import oracle_rows, rows_of
from noticeflow.llm import masked, neardup, nearest, quality, spans
from noticeflow.llm.components import components
from noticeflow.llm.masked import split_shares
from noticeflow.llm.queries import QUERIES


def test_samples_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    h = np.unique(rng.integers(0, 1 << 63, 700, dtype=np.uint64))
    w = rng.random(len(h)) + 0.5
    a, b = (h[:500], w[:500]), (h[100:600], w[100:600] * 1.3)
    s = neardup.samples([a, b], 1200)
    assert abs((s[0] == s[1]).mean() - neardup.weighted_jaccard(a, b)) < 0.05


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40) if i != 20] + [(7, 3), (5, 5), (50, 60)], "a long, b long")
    label = {r["node"]: r["label"] for r in components(links).collect()}
    assert label == {**{i: 0 if i <= 20 else 21 for i in range(41)}, 50: 50, 60: 50}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def edited(text, n, seed):
    words, rng = text.split(), random.Random(seed)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


def test_near_duplicates_equal_brute_force(spark):
    texts = [prose(i, 12) for i in range(30)] + [edited(prose(i, 12), 1 + i % 3, i) for i in range(20)] + [prose(3, 12)] * 3
    classes, _ = neardup.classify(documents(spark, texts))
    got = {r["doc_id"]: r["class_id"] for r in classes.collect()}
    idf = np.ones(1 << neardup.DF_BITS, np.float32)
    n, counts = neardup.document_frequencies(documents(spark, texts))
    assert n == len(texts)
    idf = neardup.inverse_frequencies(n, counts)
    sets, want = [neardup.weighted(t, idf) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if texts[i] == texts[j] or neardup.weighted_jaccard(sets[i], sets[j]) >= 0.8:
                low, high = sorted((want[i], want[j]))
                want = [low if c == high else c for c in want]
    assert got == dict(enumerate(want))


def test_near_duplicates_of_odd_rows(spark):
    full, empty = tables(spark)
    got = neardup.classify(full)[0].collect()
    assert len(got) == len(rows())
    by = {r["doc_id"]: r["class_id"] for r in got}
    assert by[6] == 5 and by[0] == 0 and by[1] == 1
    assert neardup.classify(empty)[0].count() == 0
    assert neardup.first_of_class(empty).count() == 0
    kept = [r["doc_id"] for r in neardup.first_of_class(full).select("doc_id").collect()]
    assert kept.count(5) == 1 and 6 not in kept and 0 in kept


def test_chunks_of_one_bucket(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CHUNK", 4)
    base = prose(1, 30)
    texts = [base] + [edited(base, 1, s) for s in range(40)]
    classes, _ = neardup.classify(documents(spark, texts))
    assert {r["class_id"] for r in classes.collect()} == {0}


def test_chunks_differ_by_band_bucket_and_turn(spark):
    """Two texts apart in one band are together in another."""
    rows = spark.range(40).selectExpr("encode(cast(id as string), 'utf-8') as node").crossJoin(spark.range(12).selectExpr("cast(id as int) as band", "cast(5 as long) as bucket"))
    old, neardup.CHUNK = neardup.CHUNK, 10
    try:
        chunk = {t: {(r["band"], bytes(r["node"])): r["chunk"] for r in neardup._in_chunks(rows, t).collect()} for t in (0, 1)}
    finally:
        neardup.CHUNK = old
    apart = [sum(chunk[0][b, b"1"] != chunk[0][b, b"%d" % i] for b in range(12)) for i in range(2, 40)]
    assert all(apart) and sum(n < 12 for n in apart) > 30 and chunk[0] != chunk[1]


def test_chunked_group_of_pairs_just_over_the_bound(spark, monkeypatch):
    """Texts of 0.75 to each other, each with a partner of 0.80 to 0.85, in buckets of many chunks: classes as by brute force."""
    monkeypatch.setattr(neardup, "CHUNK", 4)
    base = prose(1, 30)
    ones = [edited(base, 5, s) for s in range(40)]
    texts = ones + [edited(t, 7, 100 + s) for s, t in enumerate(ones)]
    n, counts = neardup.document_frequencies(documents(spark, texts))
    sets = [neardup.weighted(t, neardup.inverse_frequencies(n, counts)) for t in texts]
    want, found = list(range(len(texts))), []
    for i in range(len(texts)):
        for j in range(i):
            s = neardup.weighted_jaccard(sets[i], sets[j])
            if s >= 0.8:
                found.append(s)
                low, high = sorted((want[i], want[j]))
                want = [low if c == high else c for c in want]
    assert sum(s < 0.85 for s in found) >= 20 and len(set(want)) > 5
    classes, _ = neardup.classify(documents(spark, texts))
    got = {r["doc_id"]: r["class_id"] for r in classes.collect()}
    assert got == dict(enumerate(want))


def test_label_model_learns_accuracies():
    rng = np.random.default_rng(0)
    right = [0.95, 0.9, 0.9, 0.85, 0.8, 0.75, 0.7]
    counts = {}
    for _ in range(20_000):
        good, p = rng.random() < 0.7, 0
        for r in right:
            p = 3 * p + (1 if rng.random() < 0.2 else 2 if (rng.random() < r) == good else 0)
        counts[p] = counts.get(p, 0) + 1
    model = quality.LabelModel(list(counts.items()))
    assert abs(model.share - 0.7) < 0.02
    assert np.allclose(list(model.accuracies().values()), right, atol=0.03)


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    scored = quality.classify(spark.read.parquet(f"{sf}/documents.parquet"))
    both = scored.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    share = {r["quality"]: r["g"] for r in both.groupBy("quality").agg(F.avg(F.col("good").cast("int")).alias("g")).collect()}
    assert share[1] > 0.99 and share[0] < 0.2


def test_quality_of_odd_rows(spark):
    full, empty = tables(spark)
    assert quality.classify(full).count() == len(rows())
    assert quality.classify(empty).count() == 0
    assert quality.kept(empty).count() == 0


def test_nearest_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 16))
    data = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(3100, None), (3200, []), (3300, [0.0] * 16), (3400, [float("nan")] + [1.0] * 15), (3500, [None] + [1.0] * 15), (None, [1.0] * 16), (5, x[5].tolist())]
    got = nearest.search(spark.createDataFrame(data + odd, "vec_id long, embedding array<float>")).collect()
    x = x.astype(np.float32).astype(np.float64)
    hit = 0
    for q in range(0, 3000, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        best = set(np.argsort(d)[:10].tolist())
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [m[0] for m in mine] == list(range(1, 11)) and all(abs(m[2] - d[m[1]]) < 1e-12 for m in mine)
        hit += len(best & {m[1] for m in mine})
    assert len(got) == 300 and hit >= 270
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r["rank"], r["vec_id"]) for r in nearest.search(few).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert nearest.search(few.limit(0)).count() == 0


def test_few_vectors_are_verified():
    """Random directions, the hardest case: nine of ten true neighbours are found and under a twentieth of the vectors verified."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, a = np.arange(len(x)), nearest.lines(64)
    assert np.allclose(a[:, :64].T @ a[:, :64], 64 * np.eye(64)) and a.shape == (64, nearest.PROJECTIONS)
    block, found, verified = nearest.Block(ids, ids, x, a), 0, 0
    for q in range(0, 6000, 300):
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        _, rows, n = block.search(q, x[q], x[q] @ a, nearest.start_radius(x[:512], x[q], 10), 10, nearest.THRESHOLD)
        found += len(set(np.argsort(d)[:10].tolist()) & set(rows.tolist()))
        verified += n
    assert found >= 0.9 * 200 and verified < 0.05 * 20 * 6000


def test_rows_that_repeat_the_query_are_candidates(spark):
    data = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 2.0]), (1, [1.0, 0.1]), (1, [1.0, 0.1])]
    got = nearest.search(spark.createDataFrame(data, "vec_id long, embedding array<double>")).orderBy("rank").collect()
    # the least vector of id 0, (0, 2), asks; every other row is found, also the two of its id
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(0, 1, 1), (0, 2, 1), (0, 3, 0), (0, 4, 0)]


def test_masked_probabilities_sum_to_one_and_training_helps():
    rng = np.random.default_rng(0)
    net = masked.Network()
    line = np.array([masked.EDGE] * 2 + [5, 9] * 400 + [masked.EDGE] * 2, np.int32)
    at = np.arange(2, 802)
    total = 0.0
    for w in range(masked.SIZE):
        line2 = line.copy()
        line2[10] = w
        total += np.exp(net.log_probs(line2, np.array([10])))[0]
    assert abs(total - 1) < 1e-3
    before = net.log_probs(line, at).sum()
    squares = masked.Network(np.zeros_like(net.flat))
    for _ in range(20):
        net.train(line, rng.permutation(at), squares)
    assert net.log_probs(line, at).sum() > before / 3


def test_a_training_step_equals_plain_loops():
    """One batch against a loop word by word in double precision, in few calls whatever the number of classes."""
    rng = np.random.default_rng(4)
    words = np.minimum(rng.zipf(1.3, 3000) - 1, masked.SIZE - 2).astype(np.int16)
    line, at, _ = masked.in_line([words[:1000], words[1000:]])
    net, squares = masked.Network(), masked.Network(np.zeros_like(masked.Network().flat))
    old = masked.Network(net.flat.astype(np.float32))
    emb, bias, wc, bc, ww, bw = (p.astype(float) for p in old.parts)
    grads = [np.zeros(p.shape) for p in old.parts]
    total = []
    for i in at:
        near = [line[i + off] for off in masked.AROUND]
        h = np.tanh(bias + sum(emb[j, w] for j, w in enumerate(near)))
        c, k = divmod(int(line[i]), masked.PER_CLASS)
        d, e = (np.exp(z) / np.exp(z).sum() for z in (h @ wc + bc, h @ ww[c] + bw[c]))
        total.append(np.log(d[c]) + np.log(e[k]))
        d[c], e[k] = d[c] - 1, e[k] - 1
        back = (wc @ d + ww[c] @ e) * (1 - h * h)
        for g, value in zip(grads[1:4], (back, np.outer(h, d), d)):
            g += value / len(at)
        grads[4][c] += np.outer(h, e) / len(at)
        grads[5][c] += e / len(at)
        for j, w in enumerate(near):
            grads[0][j, w] += back / len(at)
    assert np.abs(net.log_probs(line, at) - total).max() < 1e-4
    profile = cProfile.Profile()
    profile.runcall(net.train, line, rng.permutation(at), squares)
    for now, before, square, g in zip(net.parts, old.parts, squares.parts, grads):
        assert np.abs(square - g * g).max() < 1e-6 and np.abs(now - (before - masked.RATE * g / np.sqrt(g * g + 1e-6))).max() < 1e-3
    assert sum(f.callcount for f in profile.getstats()) < 300


def test_named_words_stay_when_others_are_forgotten():
    named, ids, shares = masked.Shares.arrays([b"a", b"b"], ([b"c"], [-2.0]))
    coder = masked.Shares(named, ids, shares)
    for start in range(0, 410_000, 1000):
        coder.read([b"w%d" % i for i in range(start, start + 1000)])
    assert len(coder) < 400_010
    got, part = coder.read([b"a", b"b", b"c", b"w7"])
    assert got.tolist() == [0, 1, masked.WORDS + masked.bucket(b"c"), masked.WORDS + masked.bucket(b"w7")]
    assert part.tolist() == [0.0, 0.0, -2.0, masked.Shares.open_share]


def test_words_of_a_column_are_those_of_split():
    texts = ["", None, " \t\n", "a  b", "\x0b a\r\nb\x0c", "\x1ca\x1d \x85\xa0é c\u3000d", "x" * 50_000, "a"]
    for column in (pa.array(texts), pa.array(["cut off", *texts, "cut off"]).slice(1, len(texts))):
        words, ends = masked.words_of(column)
        got = [words.slice(i, j - i).to_pylist() for i, j in zip(ends[:-1], ends[1:])]
        assert got == [(t or "").encode().split() for t in texts]


def test_named_words_are_read_as_a_column(monkeypatch):
    """Named words of a column are found together: only others are hashed, one by one."""
    named, ids, shares = masked.Shares.arrays([b"w%d" % i for i in range(1000)], ([b"r%d" % i for i in range(1000)], [-float(i) for i in range(1000)]))
    coder, hashed = masked.Shares(named, ids, shares), []
    assert len(coder) == 0
    monkeypatch.setattr(masked, "bucket", lambda word: hashed.append(word) or 3)
    words = [*named, b"", b"other", b"other"]
    got, part = coder.read(pa.array(words, pa.binary()))
    assert hashed == [b"", b"other"] and got.tolist() == [*ids[: len(named)], *[masked.WORDS + 3] * 3]
    assert part.tolist() == [*shares[: len(named)], *[masked.Shares.open_share] * 3]


def test_word_counts_are_handed_on_in_parts(spark, monkeypatch):
    """Tasks that hold a few hundred bytes of counts give the same sums."""
    monkeypatch.setattr(masked, "_COUNTED", 300)
    monkeypatch.setattr(masked, "slices", lambda batches: (b.slice(i, 1) for b in batches for i in range(b.num_rows)))
    texts = [prose(i, 2) for i in range(30)] + [None, "", "a a  b"]
    got = {bytes(r["word"]): r["n"] for r in masked.word_counts(documents(spark, texts)).collect()}
    assert got == collections.Counter(w for t in texts for w in (t or "").encode().split())


def test_large_weights_keep_scores_finite():
    """Exponents are cut only where the weights could give more than the bound: sums stay finite either way."""
    net = masked.Network()
    line, at, _ = masked.in_line([np.arange(300, dtype=np.int16) * 5])
    for factor in (1, 1e4):
        net.flat *= np.float32(factor)
        z, own = np.full((2, 3), 1000, np.float32) * np.float32([1, -1, 0]), np.full((2, 3), 1000, np.float32)
        assert np.isfinite(net._exp(z, own)).all() and np.isfinite(net.log_probs(line, at)).all()
        squares = masked.Network(np.zeros_like(net.flat))
        net.train(line, at, squares)
        assert np.isfinite(net.flat).all() and np.isfinite(squares.flat).all()


def test_scores(spark):
    full, empty = tables(spark)
    got = masked.score(full).collect()
    assert len(got) == len(rows())
    assert all((r["n_tokens"] == 0) == (r["mean_log_prob"] is None) and np.isfinite(r["log_prob"]) for r in got)
    assert masked.score(empty).count() == 0


def test_scores_do_not_depend_on_which_shares_are_sent(spark, monkeypatch):
    """Shares sent to the tasks or joined by word give the same score, and it is the sum word by word."""
    texts = [prose(i, 4) for i in range(40)] + ["w1 w2 rare1 rare2 rare2", None, ""]
    docs = documents(spark, texts)
    got = []
    for most in (1 << 18, 30, 0):
        monkeypatch.setattr(masked, "KNOWN", most)
        monkeypatch.setattr(masked, "split_shares", functools.partial(split_shares, most=most))
        got.append({r["doc_id"]: r["log_prob"] for r in masked.score(docs).collect()})
    for other in got[1:]:
        assert other.keys() == got[0].keys() and all(abs(other[k] - got[0][k]) < 1e-6 for k in other)
    counts = masked.word_counts(docs)
    words = [bytes(r["word"]) for r in counts.orderBy(masked.F.desc("n"), "word").limit(masked.WORDS).collect()]
    share = {bytes(r["word"]): r["log_share"] for r in masked.shares(counts, words).collect()}
    lines = masked.numbered(docs.select("doc_id", "text"), words, ([], []))
    net = masked.train(lines)
    line, at, _ = masked.in_line([masked.Coder(words).numbers(texts[40].encode().split())])
    want = sum(net.log_probs(line, at[i : i + 1])[0] for i in range(len(at))) + sum(share.get(w.encode(), 0.0) for w in texts[40].split())
    assert abs(want - got[0][40]) < 1e-3


def test_scores_do_not_depend_on_files(spark, monkeypatch, tmp_path):
    """The same rows in one file or in many, in any order, with training in several parts and rounds."""
    monkeypatch.setattr(masked, "PART_WORDS", 1500)
    monkeypatch.setattr(masked, "PIECE_WORDS", 400)
    docs = documents(spark, [prose(i, 5) for i in range(120)])
    docs.coalesce(1).write.parquet(f"{tmp_path}/one")
    docs.orderBy(masked.F.rand(3)).repartition(7).write.parquet(f"{tmp_path}/many")
    one, many = ({r["doc_id"]: r["log_prob"] for r in masked.score(spark.read.parquet(f"{tmp_path}/{n}")).collect()} for n in ("one", "many"))
    assert one.keys() == many.keys() and all(abs(one[k] - many[k]) < 1e-3 for k in one)


def test_words_stand_between_edges():
    line, at, owner = masked.in_line([np.array([5, 6], np.int16), np.array([], np.int16), np.array([7], np.int16)])
    e = masked.EDGE
    assert line.tolist() == [e, e, 5, 6, e, e, e, e, 7, e, e] and line[at].tolist() == [5, 6, 7] and owner.tolist() == [0, 0, 2]


def test_rare_words_have_their_share_of_the_bucket(spark):
    """Bucket by bucket the shares sum to one, and of two words of a bucket the rarer one scores less."""
    words = [f"w{i}" for i in range(4000)]
    same = [w.encode() for w in words if masked.bucket(w.encode()) == 7]
    counts = {w.encode(): 1 + i % 5 for i, w in enumerate(words)}
    got = {bytes(r["word"]): r["log_share"] for r in masked.shares(spark.createDataFrame(list(counts.items()), "word binary, n long"), same[:1]).collect()}
    assert set(got) == set(counts) - {same[0]}
    for b in range(masked.BUCKETS):
        assert abs(sum(np.exp(v) for w, v in got.items() if masked.bucket(w) == b) - 1) < 1e-9
    often, seldom = (w.decode() for w in same[:2])
    frequent = " ".join(f"f{i} f{i} f{i} f{i} f{i} f{i} f{i} f{i} f{i}" for i in range(masked.WORDS))
    docs = documents(spark, [f"{often} a", f"{seldom} a", " ".join([often] * 7), frequent, f"{often} a"])
    score = {r["doc_id"]: r["log_prob"] for r in masked.score(docs).collect()}
    assert abs(score[0] - score[1] - np.log(9)) < 1e-6 and score[0] == score[4]


def test_span_query_equals_sql(spark, sf_dir):
    df = spans.op10_spans(spark, sf_dir)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == oracle_rows(sf_dir, spans.OP10_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_return_their_rows(spark, sf_dir, name):
    assert name in __spark_entry__.queries()
    df = QUERIES[name](spark, sf_dir)
    if name in __spark_entry__.oracle_sql():
        assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == oracle_rows(sf_dir, __spark_entry__.oracle_sql()[name])
    n = duckdb.sql(f"select count(*) from '{sf_dir}/documents.parquet'").limit(1).fetchall()[0][0]
    assert df.count() >= n if not name.startswith(("op4", "op11")) else df.count() > 0


def test_pipeline_stages_equal_the_operators(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = list(corpus_pipeline.COLUMNS)
    good = {r["doc_id"] for r in quality.classify(docs).filter("good").collect()}
    first = corpus_pipeline.keep_good(spark, docs, sf_dir)
    assert first.columns == names and {r["doc_id"] for r in first.collect()} == good
    second = corpus_pipeline.keep_first(spark, docs, sf_dir)
    classes = {r["class_id"] for r in neardup.classify(docs)[0].collect()}
    assert second.columns == names and sorted(r["doc_id"] for r in second.collect()) == sorted(classes)
    third = {r["doc_id"]: r for r in corpus_pipeline.drop_repeated_spans(spark, docs, sf_dir).collect()}
    for r in spans.deduplicate(docs).collect():
        assert r["text"] == third[r["doc_id"]]["text"] if r["doc_id"] in third else not r["text"].strip()
    assert all(r["n_chars"] == len(r["text"]) for r in third.values())
    assert corpus_pipeline.hide_persons(spark, docs, sf_dir).columns == names


def test_pipeline_takes_odd_and_empty_tables(spark):
    for docs in tables(spark):
        for _, f in corpus_pipeline.STAGES:
            docs = f(spark, docs, None)
        docs.count()

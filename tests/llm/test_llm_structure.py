"""Conversation repair, fill-in-middle and language identification against plain versions of each."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from llm_cases import documents, prose, rows, tables

from noticeflow.checks.compare import oracle_rows, rows_of
from noticeflow.llm import language, middle, repair

KIND = "conv_id long, turn long, role string, text string, node string, at int, block string, n long"
BLANK = " \t\n\x0b\x0c\r"


# Conversation repair


def damage(conv_rows):
    out = []
    for conv, turn, role, text in conv_rows:
        role, text = (" " if v is None else v for v in (role, text))
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def cheapest(kinds):
    """The least audit of least cost by search over every edit, of long rows one way per state; kinds are (initial, fault)."""
    step = repair.STEP
    ways = {0: {(0, "")}}

    def insert(ways):
        out = {q: set(v) for q, v in ways.items()}
        for _ in range(3):
            for (q, c), to in step.items():
                if c in "ua":
                    out.setdefault(to, set()).update({(cost + 2, a + "I") for cost, a in out.get(q, ())})
        return out

    for initial, fault in kinds:
        new = collections.defaultdict(set)
        for q, v in insert(ways).items():
            for cost, audit in v:
                new[q].add((cost + 3, audit + "D"))
                if fault not in ("blank", "duplicate"):
                    cut = fault == "truncated"
                    if (q, initial) in step:
                        new[step[q, initial]].add((cost + cut, audit + "K"))
                    for c in "ua":
                        if (q, c) in step:
                            new[step[q, c]].add((cost + cut + 2, audit + "R"))
        near = lambda v: {w for w in v if w[0] <= min(x[0] for x in v) + 4}
        ways = {q: near(v) if len(kinds) <= 8 else {min(v)} for q, v in new.items()}
    ways = insert(ways)
    return min(w for q in (0, 3) for w in ways.get(q, ()))


def plain_repair(conv_rows):
    """One result row per original conversation."""
    out = {}
    for conv in {r[0] for r in conv_rows}:
        mine = sorted((r for r in damage(conv_rows) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, kinds, counts = set(), [], collections.Counter()
        for _, _, role, text in mine:
            bare = text.rstrip(BLANK)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else None if bare[-1] in ".!?" else "truncated"
            seen.add((role, text))
            kinds.append((role[:1], fault))
            counts[fault] += 1
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:]))
        cost, audit = cheapest(kinds)
        lines, left = [], list(mine)
        for edit in audit:
            want = "assistant" if lines and lines[-1].startswith("u") else "user"
            row = None if edit == "I" else left.pop(0)
            if edit == "K":
                lines.append(f"{row[2]}:{row[3]}")
            elif edit == "R":
                lines.append(f"{want}:{row[3]}")
            elif edit == "I":
                lines.append(f"{want}:")
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, digest)
    return out


def found(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def odd_conversations():
    rng = random.Random(5)
    out = []
    for conv in range(110):
        for turn in range(rng.randint(1, 8)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "u", None, "sys"])
            text = rng.choice(["Yes.", "no", " ", "", None, "a.b", "Why?\n", "é…", "Long " * 30 + "!", "x."])
            out.append((conv if conv else None, rng.choice([turn, turn, turn, None]), role, text))
            if rng.random() < 0.2:
                out.append(out[-1])
    return out + [(999, t, "user" if t % 2 else "assistant", f"{t}." if t % 7 else "cut") for t in range(600)]


def test_repair_equals_search(spark, tmp_path):
    data = odd_conversations()
    with_more = [r + ("n", 1, "b", 2) for r in data]
    spark.createDataFrame(with_more, KIND).repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    got = found(repair.op11_repair(spark, str(tmp_path)))
    want = plain_repair(data)
    assert got == want


def test_repair_query_equals_search(spark, sf_dir):
    data = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(repair.op11_repair(spark, sf_dir)) == plain_repair(data)


def test_a_conversation_in_many_ranges(spark):
    """One conversation of most rows is cut into blocks; its audit and rows equal those of one block."""
    rng = random.Random(1)
    data = [(1, t // 2, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", f"{t}!"])) for t in range(4000)] + [(2, 1, "user", "Hi.")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    rows_ = repair.ordered(df, partitions=6)
    whole = repair.sequences(repair.with_faults(rows_)).collect()
    big = next(r for r in whole if r["conv_id"] == 1)
    assert len(big["sizes"]) > 2 and sum(big["sizes"]) == 4000 == len(big["symbols"])
    one = repair.sequences(repair.with_faults(repair.ordered(df, partitions=1))).filter("conv_id = 1").collect()[0]
    assert (one["symbols"], one["initials"]) == (big["symbols"], big["initials"])
    fixed, report = repair.repair(df)
    lines = fixed.filter("conv_id = 1").orderBy("at", "part").collect()
    assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][0] for r in lines))
    audit = report.filter("conv_id = 1").collect()[0]["audit"]
    assert [r["edit"] for r in lines] == list(audit.replace("D", ""))


def test_grammar_gives_what_terminals_give(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("suaoSUAOxuauaua") for _ in range(rng.randint(0, 9))) for _ in range(700)]
    grammar = repair.fit_grammar(spark.createDataFrame([(t,) for t in texts], "symbols string"), rounds=4, rules_each=5)
    plain = repair.Grammar()
    assert 5 <= len(grammar.rules) <= 20
    assert all(grammar.solve(t) == plain.solve(t) for t in texts)
    assert sum(len(grammar.compressed(t)) for t in texts) < 0.75 * sum(map(len, texts))
    kind = {c: (c.lower(), "truncated" if c.isupper() else "blank" if c == "x" else None) for c in "suaoSUAOx"}
    for t in texts[:300]:
        assert grammar.solve(t) == cheapest([kind[c] for c in t])


def test_ropes_compare_like_strings():
    rng = random.Random(4)
    made = []
    for _ in range(300):
        rope = repair.EMPTY
        for _ in range(rng.randint(0, 12)):
            rope = repair.joined(*rng.sample([rope, rng.choice(made) if made and rng.random() < 0.4 else repair.LETTERS[rng.choice("DI")]], 2))
        made.append(rope)
    for _ in range(3000):
        a, b = rng.choice(made), rng.choice(made)
        assert repair.before(a, b) == (str(a) < str(b)) and len(str(a)) == a.size


def test_repair_of_no_rows(spark, tmp_path):
    spark.createDataFrame([], KIND).write.parquet(f"{tmp_path}/conversations.parquet")
    assert repair.op11_repair(spark, str(tmp_path)).count() == 0


# Fill in the middle


@pytest.mark.parametrize("pattern", [None, r"\S+\s*", r"\w+|\s+", r"(?s).{1,3}", "x*"])
def test_cuts_lie_before_their_unit(pattern):
    rng = random.Random(7)
    for n in (0, 1, 2, 3, 4, 5, 9, 40, 700, 20_000):
        text = "".join(rng.choice("ab x\n é\U0001f600,") for _ in range(n))
        widths = middle.unit_widths(text, pattern)
        assert widths.sum() == len(text) and (widths > 0).all()
        index = middle.SkipList(widths)
        at = [0, *np.cumsum(widths).tolist()]
        ranks = range(len(at)) if n < 1000 else rng.sample(range(len(at)), 300)
        assert all(index.offset(r) == at[r] for r in ranks)
        for rank in (-1, len(at)):
            with pytest.raises(IndexError):
                index.offset(rank)


def test_descent_is_short():
    index = middle.SkipList(np.ones(1 << 18, np.int32))
    assert 7 <= len(index.lanes) <= 12 and all(len(b[1]) < 0.3 * len(a[1]) + 9 for a, b in zip(index.lanes, index.lanes[1:]))


def test_middle_query_equals_sql(spark, sf_dir):
    df = middle.op12_fill_middle(spark, sf_dir)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == oracle_rows(sf_dir, middle.OP12_SQL)


def test_middle_of_odd_rows(spark, tmp_path):
    full, empty = tables(spark)
    marked = [prose(3) + m for m in ("<P>", "<S>", "<M>", "<", "<P", "P>", "<<S", "<M")] + ["<" * k for k in range(1, 30)]
    kinds = [full, documents(spark, marked, start=100).withColumn("node", middle.F.lit(None)), empty]
    for k, df in enumerate(kinds):
        df.write.parquet(f"{tmp_path}/{k}/documents.parquet")
        got = middle.op12_fill_middle(spark, f"{tmp_path}/{k}")
        want = {}
        for r in df.select("doc_id", "text").collect():
            text = r["text"] or ""
            h = hashlib.sha256(f"1:{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()
            h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
            a, b = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
            p, m, s = text[:a], text[a:b], text[b:]
            form = "plain" if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90 else "spm" if h4 % 100 < 20 else "psm"
            out = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
            sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
            sizes = (None, None) if form == "plain" else (a, b - a)
            want.setdefault((r["doc_id"], len(text), form, *sizes, sha(out), sha(text)), 0)
            want[r["doc_id"], len(text), form, *sizes, sha(out), sha(text)] += 1
        assert collections.Counter(tuple(r) for r in got.collect()) == want


def test_middle_by_words_is_undone(spark):
    df = documents(spark, [prose(i) for i in range(60)])
    made = middle.transform(df, pattern=r"\S+\s*", percent=100)
    back = made.select("doc_id", "form", "prefix_chars", "middle_chars", middle.restored(made["output"], made["form"]).alias("text")).collect()
    assert {r["form"] for r in back} == {"psm", "spm"}
    for r in back:
        assert r["text"] == prose(r["doc_id"])
        assert all(k == 0 or r["text"][k - 1].isspace() or k == len(r["text"]) for k in (r["prefix_chars"], r["prefix_chars"] + r["middle_chars"]))


# Language


def plain_grams(text):
    fold = lambda c: (c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " "
    s = re.sub(" +", " ", " " + "".join(map(fold, text)) + " ")
    return [s[i : i + k] for k in language.LENGTHS for i in range(len(s) - k + 1) if s[i : i + k].strip() and " " not in s[i + 1 : i + k - 1]]


def plain_languages(pairs, texts):
    """Prediction and score with sets of n-grams in place of the filter."""
    by = collections.defaultdict(list)
    for lang, text in pairs:
        by[lang].append(set(plain_grams(text)))
    langs = sorted(by, key=lambda x: (-len(by[x]), x))
    share = {x: {g: c / len(by[x]) for g, c in collections.Counter(g for s in by[x] for g in s).items()} for x in langs}
    top = collections.defaultdict(float)
    for x in langs:
        for g, v in share[x].items():
            top[g] = max(top[g], v)
    keep = {x: {g for g, v in share[x].items() if v >= language.LEAST_SHARE and v >= language.RATIO * top[g]} for x in langs}
    out = []
    for text in texts:
        g = plain_grams(text or "")
        shares = [sum(x in keep[lang] for x in g) / len(g) for lang in langs] if g else []
        out.append((langs[int(np.argmax(shares))], max(shares)) if g else ("und", 0.0))
    return out


@pytest.mark.parametrize("piece", [1, 3, 7, 1 << 18])
def test_grams_of_pieces(monkeypatch, piece):
    monkeypatch.setattr(language, "PIECE", piece)
    for text in ["", " ", "a", "Hello,  wörld! Éa 3a ß x İstanbul 東京 ..." * 3, "x" * 20, "..a..b"]:
        got = np.concatenate(list(language.grams(text)))
        want = plain_grams(text)
        names = dict(zip(want, want))
        assert len(got) == len(want) and len(set(got.tolist())) == len(names)


def test_language_equals_sets_of_ngrams(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text").collect()
    out = {r["doc_id"] for r in docs if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2}
    want = plain_languages([(r["lang"], r["text"]) for r in docs if r["doc_id"] not in out and r["lang"]], [r["text"] for r in docs])
    got = {r["doc_id"]: r for r in language.op13_language(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    same = 0
    for r, (lang, score) in zip(docs, want):
        g = got[r["doc_id"]]
        assert g["held_out"] == (r["doc_id"] in out) and abs(g["score"] - score) < 0.02
        same += g["lang_pred"] == lang
    assert same >= len(docs) - 1
    right = [got[r["doc_id"]]["lang_pred"] == r["lang"] for r in docs if r["doc_id"] in out and r["lang"]]
    assert sum(right) >= 0.97 * len(right)


def test_filter_returns_the_languages_of_every_ngram(spark):
    words = {"aa": ["kala", "puna"], "bb": ["strom", "glanz"], "cc": ["strom", "kala"]}
    df = spark.createDataFrame([(lang, " ".join(w)) for lang, w in words.items() for _ in range(3)] + [(None, "nurso"), ("aa", None)], "lang string, text string")
    known = language.learn(df)
    assert known.langs == ["aa", "bb", "cc"]
    for lang, w in words.items():
        bits = known.languages(np.concatenate(list(language.grams(" ".join(w)))))[:, 0]
        assert ((bits >> known.langs.index(lang)) & 1).all()
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(documents(spark, ["puna puna", "glanz", "strom", None, "12 %", "東京", ""]), known).collect()}
    assert [got[i][0] for i in range(7)] == ["aa", "bb", "bb", "und", "und", "aa", "und"]
    assert got[0][1] > 0.99 and got[5][1] < 0.01 and got[3] == got[4] == got[6] == ("und", 0.0)
    many = spark.createDataFrame([(f"l{i:02d}", f"w{chr(97 + i)}{chr(97 + i)}q") for i in range(20)], "lang string, text string")
    twenty = language.learn(many)
    assert twenty.table.shape[1] == 3
    guesses = language.identify(documents(spark, [f"w{chr(97 + i)}{chr(97 + i)}q" for i in range(20)]), twenty).collect()
    assert all(r["lang_pred"] == f"l{r['doc_id']:02d}" for r in guesses)


def test_language_of_odd_rows(spark):
    full, empty = tables(spark)
    known = language.learn(full)
    got = language.identify(full, known).collect()
    assert len(got) == len(rows()) and all(0 <= r["score"] <= 1 for r in got)
    assert collections.Counter(r["lang_pred"] for r in got)["und"] == sum(not re.search("[a-zé東]", r[1] or "") for r in rows())
    assert language.identify(empty, known).count() == 0
    none = language.learn(empty)
    assert none.langs == [] and {r["lang_pred"] for r in language.identify(full, none).collect()} == {"und"}

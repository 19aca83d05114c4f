"""Conversation structure repair by a grammar-compressed dynamic program.

A conversation becomes a sequence of terminals, one per row: the initial of its role and whether it is
sound, truncated or must go.  Edits cost; the initials that remain must read `(s?(ua)+)?`, a machine of
four states.  A terminal is a matrix over (cost, audit) pairs: entry (i, j) is the cheapest way, and of
equally cheap ones the ASCII-least audit, to consume the row from state i to j, insertions before it
included.  Joining sequences is the product of their matrices in which costs add, audits are joined and
the least pair wins.

Pairs of symbols that are frequent over all conversations become rules of a grammar (Re-Pair), counted on
Spark round by round.  Each rule's matrix is worked out once from those of its two symbols; its audits
are ropes that share the ropes of these.  Conversations are rewritten by the rules and multiply only what
symbols remain.
"""

import functools
import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from noticeflow.llm.common import small_batches, stage

BLANKS = "\x20\t\n\x0b\x0c\r"
MARKS = ".!?"
#: Rounds of rule making and rules of one round: these bound the grammar, and so what is broadcast.
ROUNDS, RULES_EACH = 8, 32
#: Terminals: sound rows by initial (o: any other), the same truncated, and rows that must go.
SOUND, TRUNCATED, MUST_GO = "suao", "SUAO", "x"
DELETE, REROLE, INSERT, CUT = 3, 2, 2, 1
#: The machine: before anything, behind the system row, behind a user row, behind an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
STEP = {(START, "s"): SYSTEM} | {(q, "u"): USER for q in (START, SYSTEM, ASSISTANT)} | {(USER, "a"): ASSISTANT}
ENDS = (START, ASSISTANT)
ROLES = {"u": "user", "a": "assistant"}


# Rows and their faults ---------------------------------------------------------------------------------


def damaged(rows):
    """The rows after damage by crc32(`conv_id:turn`) % 20: 0 drops, 1 empties, 2 takes `.!?` out, 3 repeats, 4 sets the role user.

    Columns `conv_id`, `turn`, `role`, `text`; a null role or text, or a null in the damage key, is one space.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    key = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(F.col("_key") == 1, "").when(F.col("_key") == 2, F.translate("_text", MARKS, "")).otherwise(F.col("_text"))
    copies = F.array_repeat(F.lit(0), F.when(F.col("_key") == 3, 2).otherwise(1))
    own = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), blank("role").alias("_role"), blank("text").alias("_text"), key.alias("_key"))
    return (
        own.filter("_key != 0")
        .select("conv_id", "turn", F.when(F.col("_key") == 4, "user").otherwise(F.col("_role")).alias("role"), text.alias("text"), copies.alias("_copies"))
        .withColumn("_copy", F.explode("_copies"))
        .drop("_copies", "_copy")
    )


def ordered(rows, partitions=None):
    """The rows written in the order of conversations and turns, with `at` (ascending, not gapless) and the initial, ending and digest of each.

    Order: conv_id, turn (nulls first), role, text.  Rows are cut into ranges of this order, so a
    conversation of any size is spread over tasks.
    """
    own = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")],
    )
    keys = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role")]
    n = [partitions] if partitions else []
    spread = own.repartitionByRange(*n, *keys, F.substring("text", 1, 32).asc()).sortWithinPartitions(*keys, "text")
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = F.when(bare == "", "blank").when(~F.substring(bare, -1, 1).isin(*MARKS), "truncated")
    return stage(
        spread.select(
            F.monotonically_increasing_id().alias("at"), "conv_id", "turn", "role", "text", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"),
            F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))).alias("digest"),
        )
    )


def with_faults(rows):
    """at, conv_id, turn, initial, fault of the rows of `ordered`: the first of blank, duplicate, truncated; null if there is none."""
    slim = rows.drop("role", "text")
    known = slim.filter("fault is null or fault != 'blank'")
    first = known.groupBy("conv_id", "digest").agg(F.min("at").alias("first"), F.count("*").alias("n")).filter("n > 1")
    first = first.select(F.col("conv_id").alias("_conv"), F.col("digest").alias("_digest"), "first")
    same = slim["conv_id"].eqNullSafe(first["_conv"]) & (slim["digest"] == first["_digest"])
    again = (F.col("first") < F.col("at")) & ~F.coalesce(F.col("fault") == "blank", F.lit(False))
    return slim.join(first, same, "left").select("at", "conv_id", "turn", "initial", F.when(again, "duplicate").otherwise(F.col("fault")).alias("fault"))


def sequences(faulty):
    """One row per conversation: `starts` and `sizes` of its blocks of neighbouring rows, and `symbols` and `initials`, one character a row.

    Rows first meet per block, the part of a conversation one range holds, and then one character of each
    per conversation, as long as the audit that the result holds anyway.
    """
    initial = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), MUST_GO).when(F.col("fault") == "truncated", F.upper(initial)).otherwise(initial)
    row = F.sort_array(F.collect_list(F.struct("at", initial.alias("initial"), symbol.alias("symbol"))))
    blocks = faulty.groupBy("conv_id", F.shiftright("at", 33).alias("block")).agg(row.alias("row"))
    blocks = blocks.select(
        "conv_id", F.struct(F.col("row")[0]["at"].alias("start"), F.size("row").alias("size"), F.array_join("row.initial", "").alias("initials"), F.array_join("row.symbol", "").alias("symbols")).alias("block")
    )
    whole = blocks.groupBy("conv_id").agg(F.sort_array(F.collect_list("block")).alias("block"))
    return whole.select(
        "conv_id", F.col("block.start").alias("starts"), F.col("block.size").alias("sizes"), F.array_join("block.initials", "").alias("initials"), F.array_join("block.symbols", "").alias("symbols")
    )


# Ropes and matrices ------------------------------------------------------------------------------------

_PRIME, _BASE = (1 << 61) - 1, 1_000_003


class Rope:
    """A string in two parts, each a rope or plain; joined without copying and compared by hashes of prefixes."""

    __slots__ = ("left", "right", "size", "hash", "power")

    def __init__(self, left, right):
        self.left, self.right = left, right
        self.size = left.size + right.size
        self.power = left.power * right.power % _PRIME
        self.hash = (left.hash * right.power + right.hash) % _PRIME

    def prefix_hash(self, n):
        h, node = 0, self
        while n:
            if n == node.size:
                return (h * node.power + node.hash) % _PRIME
            if n <= node.left.size:
                node = node.left
            else:
                h = (h * node.left.power + node.left.hash) % _PRIME
                n -= node.left.size
                node = node.right
        return h

    def letter(self, i):
        node = self
        while isinstance(node, Rope):
            if i < node.left.size:
                node = node.left
            else:
                i -= node.left.size
                node = node.right
        return node.text

    def __str__(self):
        out, todo = [], [self]
        while todo:
            node = todo.pop()
            if isinstance(node, Rope):
                todo += (node.right, node.left)
            else:
                out.append(node.text)
        return "".join(out)


class Letter:
    """A rope of one letter, or of none."""

    __slots__ = ("text", "size", "hash", "power")

    def __init__(self, text):
        self.text, self.size = text, len(text)
        self.hash, self.power = (ord(text), _BASE) if text else (0, 1)

    def prefix_hash(self, n):
        return self.hash if n else 0

    def letter(self, i):
        return self.text

    def __str__(self):
        return self.text


EMPTY = Letter("")
LETTERS = {c: Letter(c) for c in "DIKR"}


def joined(a, b):
    return b if not a.size else a if not b.size else Rope(a, b)


def before(a, b):
    """Is rope `a` ASCII-less than `b`?"""
    if a is b:
        return False
    low, high = 0, min(a.size, b.size)
    if a.prefix_hash(high) == b.prefix_hash(high):
        return a.size < b.size
    while high - low > 1:  # prefixes of length low are equal, of length high not
        mid = (low + high) // 2
        if a.prefix_hash(mid) == b.prefix_hash(mid):
            low = mid
        else:
            high = mid
    return a.letter(low) < b.letter(low)


def better(new, old):
    return old is None or new[0] < old[0] or (new[0] == old[0] and before(new[1], old[1]))


def product(a, b):
    """The matrix of a's sequence and then b's; an entry without a way is None."""
    out = [[None] * 4 for _ in range(4)]
    for i in range(4):
        for k in range(4):
            left = a[i][k]
            if left is None:
                continue
            for j in range(4):
                right = b[k][j]
                if right is None:
                    continue
                cost, old = left[0] + right[0], out[i][j]
                if old is None or cost <= old[0]:
                    new = (cost, joined(left[1], right[1]))
                    if better(new, old):
                        out[i][j] = new
    return out


def _matrix(ways):
    out = [[None] * 4 for _ in range(4)]
    for i, j, way in ways:
        if better(way, out[i][j]):
            out[i][j] = way
    return out


@functools.cache
def inserted():
    """Any number of insertions; more than three lead to no state that fewer don't."""
    one = _matrix([(i, j, (INSERT, LETTERS["I"])) for (i, c), j in STEP.items() if c in ROLES])
    none = [(i, i, (0, EMPTY)) for i in range(4)]
    upto = _matrix(none)
    for _ in range(3):
        more = product(upto, one)
        upto = _matrix(none + [(i, j, more[i][j]) for i in range(4) for j in range(4) if more[i][j]])
    return upto


def terminal(symbol):
    """The matrix of one row, with the insertions before it."""
    ways = [(i, i, (DELETE, LETTERS["D"])) for i in range(4)]
    if symbol != MUST_GO:
        extra = CUT if symbol in TRUNCATED else 0
        for (i, c), j in STEP.items():
            if c == symbol.lower():
                ways.append((i, j, (extra, LETTERS["K"])))
            if c in ROLES:
                ways.append((i, j, (REROLE + extra, LETTERS["R"])))
    return product(inserted(), _matrix(ways))


# Grammar -----------------------------------------------------------------------------------------------


class Grammar:
    """Rules `pair of symbols -> new symbol` in the order they were made, and the matrix of every symbol."""

    def __init__(self):
        self.rules = []
        self.matrices = {t: terminal(t) for t in SOUND + TRUNCATED + MUST_GO}
        self._solved = {}

    def add(self, pair):
        """New rules get the symbols from U+0100 on; the matrix comes from those of the pair."""
        symbol = chr(0x100 + len(self.rules))
        self.rules.append((pair, symbol))
        self.matrices[symbol] = product(self.matrices[pair[0]], self.matrices[pair[1]])

    def compressed(self, symbols):
        for pair, symbol in self.rules:
            symbols = symbols.replace(pair, symbol)
        return symbols

    def solve(self, symbols):
        """(cost, audit) of the cheapest repair of a sequence of terminals."""
        known = self._solved.get(symbols)
        if known is None:
            left = [self.matrices[s] for s in self.compressed(symbols)]
            while len(left) > 1:  # neighbours first, so ropes stay shallow
                left = [product(*left[i : i + 2]) if i + 1 < len(left) else left[i] for i in range(0, len(left), 2)]
            total = product(left[0], inserted()) if left else inserted()
            best = None
            for j in ENDS:
                if total[START][j] is not None and better(total[START][j], best):
                    best = total[START][j]
            known = best[0], str(best[1])
            if len(symbols) <= 64:
                if len(self._solved) > 100_000:
                    self._solved.clear()
                self._solved[symbols] = known
        return known


def fit_grammar(sequences, rounds=ROUNDS, rules_each=RULES_EACH):
    """Re-Pair over the column `symbols` of all rows.

    A round counts neighbouring symbols over all sequences, equal sequences once with their number, and
    makes rules of the most frequent pairs (ties: by symbols) that can't overlap with one made before them in
    the round, as a rule leaves the counts of such pairs as they are.  To the driver come the counts of
    pairs, at most the square of `rounds * rules_each` plus nine symbols.
    """
    shapes = stage(sequences.groupBy("symbols").agg(F.count("*").alias("n")))
    grammar = Grammar()
    schema = pa.schema([("pair", pa.string()), ("n", pa.int64())])
    for _ in range(rounds):

        def pairs(batches, grammar=grammar):
            counts = {}
            for batch in batches:
                for symbols, n in zip(batch.column("symbols").to_pylist(), batch.column("n").to_pylist()):
                    short, last = grammar.compressed(symbols), None
                    for i in range(len(short) - 1):
                        pair = short[i : i + 2]
                        if pair == last and pair[0] == pair[1]:  # aaa holds aa once
                            last = None
                            continue
                        counts[pair] = counts.get(pair, 0) + n
                        last = pair
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], schema=schema)

        found = shapes.mapInArrow(pairs, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")).filter("n > 1").collect()
        made = []
        for r in sorted(found, key=lambda r: (-r["n"], r["pair"])):
            a, b = r["pair"]
            if len(made) < rules_each and all(a != p[1] and b != p[0] for p in made):
                grammar.add(r["pair"])
                made.append(r["pair"])
        if not made:
            break
    return grammar


# Repair ------------------------------------------------------------------------------------------------


def instructions(symbols, initials, audit):
    """For every row: roles inserted before it, its edit, its new role or None, roles inserted behind it (last row only)."""
    held, waiting, row, state = None, [], 0, START
    for edit in audit:
        role = None
        if edit != "D":
            c = initials[row] if edit == "K" else "a" if state == USER else "u"
            state = STEP[state, c]
            role = None if edit == "K" else ROLES[c]
        if edit == "I":
            waiting.append(role)
            continue
        if held:
            yield held
        held, waiting, row = (waiting, edit, role, []), [], row + 1
    if held:
        yield (*held[:3], waiting)


def solved(whole, grammar):
    """The rows of `sequences` with `cost`, `audit` and `illegal`, pairs of neighbours that are not su, ua or au."""
    schema = pa.schema([("conv_id", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("illegal", pa.int64())])
    fine = [a + b for a, b in ("su", "ua", "au")]

    def work(batches):
        for batch in batches:
            cost, audit, illegal = [], [], []
            for symbols, initials in zip(batch.column("symbols").to_pylist(), batch.column("initials").to_pylist()):
                c, a = grammar.solve(symbols)
                cost.append(c)
                audit.append(a)
                illegal.append(sum(initials[i : i + 2] not in fine for i in range(len(initials) - 1)))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(cost, pa.int64()), pa.array(audit, pa.string()), pa.array(illegal, pa.int64())], schema=schema)

    return whole.select("conv_id", "symbols", "initials").mapInArrow(work, "conv_id long, cost long, audit string, illegal long")


def edits(whole, grammar):
    """One row per row of the conversations: `at`, `edit`, `new_role`, and `inserted` and `behind`, the roles of rows put before and after it."""
    kind = "at long, edit string, new_role string, inserted array<string>, behind array<string>"
    roles = pa.list_(pa.string())
    schema = pa.schema([("at", pa.int64()), ("edit", pa.string()), ("new_role", pa.string()), ("inserted", roles), ("behind", roles)])

    def work(batches):
        for batch in batches:
            for r in batch.to_pylist():
                at = np.concatenate([s + np.arange(n) for s, n in zip(r["starts"], r["sizes"])])
                made, done = instructions(r["symbols"], r["initials"], grammar.solve(r["symbols"])[1]), 0
                while part := list(itertools.islice(made, 1 << 16)):
                    put, edit, role, behind = zip(*part)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(at[done : done + len(part)]), pa.array(edit), pa.array(role, pa.string()), pa.array(put, roles), pa.array(behind, roles)], schema=schema
                    )
                    done += len(part)

    return whole.mapInArrow(work, kind)


def repair(conversations):
    """(repaired rows, report), two tables, of rows with `conv_id`, `turn`, `role`, `text`.

    Repaired rows: `conv_id`, `at`, `part` (their order), `role`, `text`, `edit` (K, R or I); deleted rows are
    left out.  Report, one row per conv_id: `gaps`, `blank`, `duplicate`, `truncated`, `illegal`, `cost`, `audit`.
    Rows stand in the order of `ordered`, ties and repeated rows included, and a repeated row is a
    duplicate.  A null role or text counts as one space, a null conv_id is a conversation of its own, a
    role that is empty or begins with anything but s, u or a can't be kept.  An empty table gives none.
    """
    small_batches(conversations.sparkSession)
    rows = ordered(conversations)
    faulty = stage(with_faults(rows))
    whole = stage(sequences(faulty))
    grammar = fit_grammar(whole)
    one = lambda f: F.count(F.when(F.col("fault") == f, 1)).alias(f)
    span = F.max("turn") - F.min("turn") + 1
    turns = faulty.filter("turn is not null").groupBy("conv_id", "turn").agg(F.lit(1).alias("n"))
    gaps = turns.groupBy("conv_id").agg((span - F.count("*")).alias("gaps"))
    counts = faulty.groupBy("conv_id").agg(*[one(f) for f in ("blank", "duplicate", "truncated")])
    report = beside(beside(counts, gaps), solved(whole, grammar)).withColumn("gaps", F.coalesce("gaps", F.lit(0).cast("long")))
    told = rows.select("at", "conv_id", "role", "text").join(edits(whole, grammar), "at")
    put = lambda roles, part: F.transform(roles, lambda r, i: F.struct((i + part).alias("part"), r.alias("role"), F.lit("").alias("text"), F.lit("I").alias("edit")))
    own = F.struct(F.lit(1000).alias("part"), F.coalesce("new_role", "role").alias("role"), F.col("text"), F.col("edit"))
    pieces = F.concat(put(F.col("inserted"), 0), F.when(F.col("edit") != "D", F.array(own)).otherwise(F.array().cast("array<struct<part:int,role:string,text:string,edit:string>>")), put(F.col("behind"), 2000))
    fixed = told.select("conv_id", "at", F.explode(pieces).alias("_p")).select("conv_id", "at", "_p.*")
    return fixed, report


def beside(left, right):
    """Left join of two tables by `conv_id`, where null equals null."""
    other = right.withColumnRenamed("conv_id", "_conv")
    return left.join(other, left["conv_id"].eqNullSafe(other["_conv"]), "left").drop("_conv")


def fingerprints(fixed):
    """conv_id and the sha256 of its repaired `role:text` lines.  A hash takes its bytes in order, so the sorted rows of a conversation stream through one task; none is held."""
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])

    def work(batches):
        current, state, started = None, None, False
        for batch in batches:
            out = []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if not started or conv != current:
                    if started:
                        out.append((current, state.hexdigest()))
                    current, state, started = conv, hashlib.sha256(), True
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.string())], schema=schema)
        if started:
            yield pa.RecordBatch.from_arrays([pa.array([current], pa.int64()), pa.array([state.hexdigest()])], schema=schema)

    lines = fixed.select("conv_id", "at", "part", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "at", "part")
    return lines.select("conv_id", "role", "text").mapInArrow(work, "conv_id long, repaired_sha256 string")


def op11_repair(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    fixed, report = repair(damaged(rows))
    every = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    out = beside(beside(every, report), fingerprints(fixed))
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select(
        "conv_id",
        *[number(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )

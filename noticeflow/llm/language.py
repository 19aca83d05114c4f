"""Language identification with a bit-sliced Bloom filter of n-grams.

Learning counts, over all labelled texts, in how many texts of each language an n-gram occurs.  A
language contains an n-gram that at least `LEAST_SHARE` of its texts hold, unless its share is under
`RATIO` of the largest share of any language.  As the sum of all shares is the mean number of n-grams of
a text, at most that mean over LEAST_SHARE n-grams remain per language, whatever the corpus: this
bounds the filter.

The filter is one table of slots with one bit per language: an n-gram sets the bits of its languages in
`HASHES` slots, and the bitwise AND of these slots answers at once which languages contain it.  A text is
judged by the number of its n-grams per language, corrected by the share that the language's bits
would return for n-grams it does not contain.
"""

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from noticeflow.llm.common import slices, small_batches, stage

#: Lengths of n-grams, the blank on either side of a word included.
LENGTHS = (1, 2, 3, 4)
LEAST_SHARE = 0.001
RATIO = 0.3
HASHES = 3
#: Slots of the filter per n-gram that it holds; the table is the next power of two.
SLOTS_EACH = 8
#: Code points looked at together, and slots of one block of the filter.
PIECE = 1 << 18
BLOCK = 1 << 16
UNKNOWN = "und"


@functools.cache
def _folded():
    """For every code point: 0 if it is no letter, else its lower case where that is one code point."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if chr(c).isalpha():
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def _mixed(x):
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def grams(text, lengths=LENGTHS):
    """Hashes of the n-grams of a text, piece by piece.

    Words are runs of letters in lower case; between them and at the ends stands one blank.  An n-gram
    may begin and end with a blank but holds none inside, and holds a letter.
    """
    most = max(lengths)
    codes = np.zeros(1, np.uint32)  # the blank before the text
    for at in range(0, len(text) + 1, PIECE):
        seen = len(codes)  # n-grams within these codes were given with the piece before
        piece = np.frombuffer(text[at : at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        last = [0] if at + PIECE > len(text) else []
        codes = np.concatenate([codes, _folded()[piece], np.array(last, np.uint32)])
        blank = codes == 0
        codes = codes[~blank | np.append(True, ~blank[:-1])]
        blanks = np.append(0, np.cumsum(codes == 0))
        rolled, out = np.zeros(len(codes), np.uint64), []
        for k in range(1, min(most, len(codes)) + 1):
            with np.errstate(over="ignore"):
                rolled = rolled[: len(codes) - k + 1] * np.uint64(0x100000001B3) + codes[k - 1 :] + np.uint64(1)
            if k in lengths:
                start = np.arange(max(0, seen - k + 1), len(rolled))
                inside = blanks[start + k - 1] - blanks[start + 1] if k > 1 else codes[start] == 0
                out.append(_mixed(rolled[start[inside == 0]] ^ np.uint64(k << 56)))
        yield np.concatenate(out) if out else np.zeros(0, np.uint64)
        codes = codes[max(0, len(codes) - most + 1) :]


def _counted(labelled, lengths):
    """gram, lang, n: texts of the language that hold the n-gram, summed within tasks."""
    schema = pa.schema([("gram", pa.int64()), ("lang", pa.string()), ("n", pa.int64())])

    def flush(held):
        for lang, parts in held.items():
            found, n = np.unique(np.concatenate(parts), return_counts=True)
            for i in range(0, len(found), 1 << 17):
                take = slice(i, i + (1 << 17))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found[take].view(np.int64)), pa.array([lang] * len(found[take]), pa.string()), pa.array(n[take])], schema=schema
                )
        held.clear()

    def work(batches):
        held, size = {}, 0
        for batch in slices(batches):
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                own = np.zeros(0, np.uint64)
                for part in grams(text, lengths):
                    own = np.unique(np.concatenate([own, part]))
                held.setdefault(lang, []).append(own)
                size += len(own)
                if size > 4_000_000:
                    yield from flush(held)
                    size = 0
        yield from flush(held)

    return labelled.mapInArrow(work, "gram long, lang string, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))


class Filter:
    """Slots with one bit per language, and the share of slots in which each bit is set."""

    def __init__(self, langs, table, lengths=LENGTHS):
        self.langs, self.table, self.lengths = langs, table, lengths
        self.bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
        used = np.zeros(table.shape[1] * 8)
        for i in range(table.shape[1]):
            used[8 * i : 8 * i + 8] = np.bincount(table[:, i], minlength=256) @ self.bits / len(table)
        self.false_share = used[: len(langs)] ** HASHES

    def languages(self, hashes):
        """One row of language bits for every n-gram."""
        out = None
        for slot in slots(hashes, len(self.table)):
            out = self.table[slot] if out is None else out & self.table[slot]
        return out

    def judge(self, text):
        """(language, score): the corrected share of n-grams that the best language contains; the first language of equal ones."""
        if text is None or not self.langs:
            return UNKNOWN, 0.0
        hits, n = np.zeros(self.table.shape[1] * 8, np.int64), 0
        for part in grams(text, self.lengths):
            n += len(part)
            found = self.languages(part)
            for i in range(found.shape[1]):
                hits[8 * i : 8 * i + 8] += np.bincount(found[:, i], minlength=256) @ self.bits
        if n == 0:
            return UNKNOWN, 0.0
        share = (hits[: len(self.langs)] / n - self.false_share) / np.maximum(1 - self.false_share, 1e-9)
        best = int(np.argmax(share))
        return self.langs[best], float(min(max(share[best], 0.0), 1.0))


def slots(hashes, size):
    """HASHES slots for every hash; `size` is a power of two."""
    with np.errstate(over="ignore"):
        step = (hashes >> np.uint64(32)) | np.uint64(1)
        for i in range(HASHES):
            yield ((hashes + np.uint64(i) * step) & np.uint64(size - 1)).astype(np.int64)


def learn(labelled, lengths=LENGTHS, least_share=LEAST_SHARE, ratio=RATIO):
    """The filter of rows with `text` and `lang`; rows where one is null are left out.

    Languages are ordered by their number of texts, most first, then by name: of equal scores the first
    wins.  Without rows the filter has no language.  To the driver come the languages with their
    counts and the table itself, `SLOTS_EACH` slots of one bit per language for every n-gram.
    """
    spark = labelled.sparkSession
    small_batches(spark)
    slim = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).dropna()
    totals = slim.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    langs = [r["lang"] for r in totals]
    width = max(1, (len(langs) + 7) // 8)
    if not langs:
        return Filter([], np.zeros((1, 1), np.uint8), lengths)
    sizes = spark.createDataFrame([(r["lang"], i, r["count"]) for i, r in enumerate(totals)], "lang string, bit int, texts long")
    counts = stage(_counted(slim, lengths)).join(F.broadcast(sizes), "lang").withColumn("share", F.col("n") / F.col("texts"))
    top = counts.groupBy("gram").agg(F.collect_list(F.struct("bit", "share")).alias("by"), F.max("share").alias("top"))
    enough = lambda r: (r["share"] >= least_share) & (r["share"] >= ratio * F.col("top"))
    kept = stage(top.select("gram", F.transform(F.filter("by", enough), lambda r: r["bit"]).alias("bits")).filter(F.size("bits") > 0))
    n = kept.count()
    size = 1 << max(BLOCK.bit_length() - 1, (SLOTS_EACH * n - 1).bit_length())

    def place(batches):
        schema = pa.schema([("block", pa.int32()), ("slot", pa.int32()), ("bits", pa.list_(pa.int32()))])
        for batch in batches:
            hashes = batch.column("gram").to_numpy().view(np.uint64)
            for slot in slots(hashes, size):
                yield pa.RecordBatch.from_arrays(
                    [pa.array((slot // BLOCK).astype(np.int32)), pa.array((slot % BLOCK).astype(np.int32)), batch.column("bits").cast(pa.list_(pa.int32()))], schema=schema
                )

    def block(key, table):
        part = np.zeros((BLOCK, width), np.uint8)
        bits = table.column("bits").combine_chunks()
        row = np.repeat(table.column("slot").to_numpy(), np.diff(bits.offsets.to_numpy()))
        bit = bits.flatten().to_numpy()
        np.bitwise_or.at(part, (row, bit // 8), (1 << (bit % 8)).astype(np.uint8))
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "data": [part.tobytes()]})

    placed = kept.mapInArrow(place, "block int, slot int, bits array<int>")
    table = np.zeros((size // BLOCK, BLOCK, width), np.uint8)
    for r in placed.groupBy("block").applyInArrow(block, "block int, data binary").collect():
        table[r["block"]] = np.frombuffer(r["data"], np.uint8).reshape(BLOCK, width)
    return Filter(langs, table.reshape(size, width), lengths)


def identify(docs, known):
    """`doc_id`, `lang_pred`, `score` of every whole text by the filter `known`, a row for every row.

    A null text and one without a letter is `und` with score 0; a text of letters always gets a learned
    language, with score 0 where nothing of it is known.  Without a learned language all are `und`.
    Nothing but the text decides, so equal texts get equal results; other columns are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def work(batches):
        judge = shared.value.judge
        for batch in slices(batches):
            made = [judge(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())], schema=schema
            )

    small_batches(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(work, "doc_id long, lang_pred string, score double")


def held_out(doc_id):
    """Column: is the row kept from learning?  A null id is written as nothing."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def op13_language(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    known = learn(docs.filter(~held_out(F.col("doc_id"))))
    found = identify(docs, known)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")

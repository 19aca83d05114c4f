"""BPE encoding with forced-boundary splitting, and decoding.

A pair of adjacent bytes that occurs inside no vocabulary token can never be merged over: it is a
certain cut.  Each piece of text is cut there, the fragments are encoded independently, and their
ids are put together; the result is that of merging the whole piece.
"""

import functools
import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import functions as F

from noticeflow.llm.common import slices
from noticeflow.llm.vocab import library, vocab

VOCABULARY = "byte_bpe_50k.json"
_PIECE = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: Latin letters and common punctuation, for which all Unicode versions agree; the rest is cut by the library's splitter.
_OTHER = re.compile(r"[^\x00-ɏ‐-‧]")
_BLANKS = "\t\n\v\f\r\x85\xa0"
_CACHE = 600_000


class Splitter:
    """Encodes with one vocabulary; fragments and chunks met before are looked up."""

    def __init__(self, path):
        self.vocab, self.library, self.known = vocab(path), library(path), {}
        self.inside = {p for token in self.vocab.bytes_of.values() for p in zip(token, token[1:])}
        self.special = regex.compile("|".join(map(regex.escape, self.vocab.special)) or r"(?!)")

    def fragments(self, piece):
        """The piece (bytes) cut at every pair of bytes that no token holds."""
        if self.inside.issuperset(zip(piece, piece[1:])):
            return [piece]
        ends = [0, *(i for i, p in enumerate(zip(piece, piece[1:]), 1) if p not in self.inside), len(piece)]
        return [piece[i:j] for i, j in zip(ends, ends[1:])]

    @staticmethod
    def even(text):
        """Whether every space stands alone between two characters that are no white space."""
        if text[0] == " " or text[-1].isspace() or "  " in text:
            return False
        return not any(f" {c}" in text or f"{c} " in text for c in _BLANKS if c in text)

    def pieces(self, text):
        if _OTHER.search(text):
            return [text[i:j] for _, (i, j) in self.library.pre_tokenizer.pre_tokenize_str(text)]
        return _PIECE.findall(text)

    def chunk(self, text):
        """Ids, as bytes of int32, of text whose ends are ends of pieces."""
        merge = self.vocab.merge
        if text[1:].isalpha() and text[0] == " ":  # one piece, by far the most common case
            return array("i", chain.from_iterable(map(merge, self.fragments(text.encode())))).tobytes()
        if text[-1] in ".,!?" and text[1:-1].isalpha() and text[0] == " ":
            core = self.known.get(text[1:-1])
            return (self.chunk(text[:-1]) if core is None else core) + array("i", merge(text[-1].encode())).tobytes()
        ids = [merge(f) for p in self.pieces(text) for f in self.fragments(p.encode())]
        return array("i", chain.from_iterable(ids)).tobytes()

    def _plain(self, text):
        # A single space between two other characters always starts a piece: such texts are cut
        # there first, and chunks that occur again need no work.
        if not text:
            return b""
        if not self.even(text) or not text.isascii() and _OTHER.search(text):
            return self.chunk(text)
        first, *rest = text.split(" ")
        known = self.known
        new = set(rest).difference(known)
        if len(known) + len(new) > _CACHE:
            known.clear()
            new = set(rest)
        known.update((word, self.chunk(" " + word)) for word in new)
        return self.chunk(first) + b"".join(map(known.__getitem__, rest))

    def encode(self, text):
        """Ids of a whole text as an int32 array; special tokens in it become their own ids."""
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [self._plain(text[at : m.start()]), np.int32(self.vocab.special[m[0]]).tobytes()]
            at = m.end()
        out.append(self._plain(text[at:]))
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids):
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")

    @functools.cached_property
    def token_bytes(self):
        return self.vocab.bytes_of | {i: t.encode() for t, i in self.vocab.special.items()}


@functools.lru_cache(maxsize=2)
def splitter(path):
    return Splitter(path)


def encode_documents(docs, path):
    """`doc_id`, `ids` (array<int>) and `decoded` of every whole text.

    A null text counts as empty and has no ids; repeated rows give repeated results; other columns
    are ignored.  Rows pass in slices of a few MB, so the memory follows the longest text.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batches):
        s = splitter(path)
        for batch in slices(batches):
            ids = [s.encode(t or "") for t in batch.column("text").to_pylist()]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            decoded = [s.decode(i.tolist()) for i in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.ListArray.from_arrays(ends, flat), pa.array(decoded, pa.string())], schema=schema
            )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def op3_bpe(spark, sf_dir):
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    coded = encode_documents(docs, public_tokenizers.path(VOCABULARY))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )

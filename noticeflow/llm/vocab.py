"""Byte-level BPE vocabularies of tokenizer files, read once per Python worker."""

import functools
import json

import tiktoken


def _alphabet():
    """The character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocab:
    """Bytes of each token, the merge ranks, and the merge of one piece of bytes.

    A token's id is its merge rank in these files, which `__init__` checks; so a piece is merged
    by rank alone.  The end-of-word mark counts as one more byte, 0xFF, which UTF-8 never has.
    """

    END = b"\xff"

    def __init__(self, path):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, alphabet = spec["model"], _alphabet()
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        merged = [a + b for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
        ids = [model["vocab"][m] for m in merged]
        if any(b <= a for a, b in zip(ids, ids[1:])):
            raise ValueError("token ids must follow the order of the merges")
        self.bytes_of = {}
        for token, i in model["vocab"].items():
            ended = self.suffix and token.endswith(self.suffix)
            body = token[: -len(self.suffix)] if ended else token
            if token not in self.special:
                self.bytes_of[i] = bytes(alphabet[c] for c in body) + (self.END if ended else b"")
        self.ranks = {b: i for i, b in self.bytes_of.items()}
        if self.suffix:
            self.ranks[self.END] = max(self.ranks.values()) + len(self.special) + 1
        for b in range(256):
            self.ranks.setdefault(bytes([b]), max(self.ranks.values()) + 1)
        self._core = tiktoken.Encoding("ranks", pat_str=r"(?s).+", mergeable_ranks=self.ranks, special_tokens={})._core_bpe
        self.merge = self._core.encode_single_piece


@functools.lru_cache(maxsize=4)
def vocab(path):
    return Vocab(path)


@functools.lru_cache(maxsize=4)
def library(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t

"""Format-preserving pseudonyms by a Feistel network.

Personal values are found by their form, validated (check digits, value ranges, real calendar
days) and permuted by a keyed Feistel network within their own format: a card number becomes
another valid card number, a day another day written the same way.  The permutation depends on the
key, the kind and the format only, so equal values stay equal across documents and tables, and
whoever holds the key can undo it.  Ten-digit phone numbers and addresses of irregular ranges are permuted
among their like; other numbers that fail validation stay as they are.
"""

import datetime
import functools
import hashlib
import re
import struct

import pyarrow as pa
from pyspark.sql import functions as F

from noticeflow.llm.common import slices

ROUNDS = 10
KINDS = ("email", "card", "phone", "ssn", "ip", "iban", "date", "secret")
#: Only a demonstration: callers give their own.
DEMO_KEY = b"pseudonym key of the registered query"

_FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
_DAYS = datetime.date(2100, 1, 1).toordinal() - _FIRST_DAY

_FORMS = re.compile(
    r"(?P<email>(?<![\w.%+\-])[A-Za-z0-9][A-Za-z0-9._%+\-]{0,63}@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63}){1,8}\b)"
    r"|(?P<secret>\bAKIA[A-Z0-9]{16}\b|(?<=[\"'=])(?=[A-Fa-f]{0,15}\d)[0-9A-Fa-f]{16,64}\b|\bghp_[A-Za-z0-9]{36}\b)"
    r"|(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b)"
    r"|(?P<date>(?<![\w/.\-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}[./\-]\d{1,2}[./\-]\d{4})(?![\w/\-])(?!\.\d))"
    r"|(?P<ip>(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d))"
    r"|(?P<ssn>(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-]))"
    r"|(?P<phone>(?<![\w+])(?:\+?1[ .\-]?)?(?:\(\d{3}\) ?|\d{3}[ .\-])\d{3}[ .\-]\d{4}(?!\w)|(?<![\w+])\+[2-9]\d(?:[ .\-]?\d){7,12}(?!\w))"
    r"|(?P<card>(?<![\w\-])\d(?:[ \-]?\d){12,18}(?![\w\-]))",
    re.ASCII,
)


class Feistel:
    """A keyed permutation of the integers below any n, by an unbalanced network with cycle walking."""

    def __init__(self, key):
        self.key = key if len(key) <= 64 else hashlib.sha256(key).digest()

    def _round(self, tweak, i, x):
        h = hashlib.blake2b(tweak + struct.pack(">B", i) + x.to_bytes(40, "big"), key=self.key, digest_size=48)
        return int.from_bytes(h.digest(), "big")

    @staticmethod
    def _sides(n):
        a = max(2, int(n**0.5)) if n < 1 << 52 else 1 << (n.bit_length() // 2)
        return a, -(-n // a)

    def permute(self, x, n, tweak, undo=False):
        """The place of x among the integers below n."""
        if n < 2:
            return x
        a, b = self._sides(n)
        while True:
            left, right = divmod(x, b)  # left < a, right < b
            for i in range(ROUNDS - 1, -1, -1) if undo else range(ROUNDS):
                move = (-1 if undo else 1) * self._round(tweak, i, right if i % 2 == 0 else left)
                if i % 2 == 0:
                    left = (left + move) % a
                else:
                    right = (right + move) % b
            x = left * b + right
            if x < n:
                return x


def _luhn(digits):
    """The check digit that follows `digits`."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return str(-total % 10)


def _refill(shape, digits):
    """`shape` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c in "0123456789" else c for c in shape)


def _digits(s):
    return re.sub(r"[^0-9]", "", s)


class Pseudonyms:
    """Replaces the personal values of texts; `undo` turns pseudonyms back."""

    def __init__(self, key, undo=False, kinds=KINDS):
        self.net, self.undo, self.kinds = Feistel(key), undo, frozenset(kinds)
        self.known = functools.lru_cache(maxsize=100_000)(self._value)

    def _walk(self, x, n, tweak, good):
        """Permutes within the good integers below n: bad ones are walked over, so it stays one to one."""
        while True:
            x = self.net.permute(x, n, tweak, self.undo)
            if good(x):
                return x

    def _characters(self, s, tweak):
        """Digits, small and capital letters each keep their place."""
        sizes = [10 if c.isdigit() else 26 if c.isalpha() else 1 for c in s]
        zero = ["0" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else c for c in s]
        n = x = 0
        n = 1
        for c, z, m in zip(s, zero, sizes):
            x, n = x * m + ord(c) - ord(z), n * m
        shape = "".join(zero).encode()
        x = self.net.permute(x, n, tweak + shape, self.undo)
        out = []
        for z, m in zip(reversed(zero), reversed(sizes)):
            x, r = divmod(x, m)
            out.append(chr(ord(z) + r))
        return "".join(reversed(out))

    def _email(self, s):
        local, _, domain = s.partition("@")
        return f"{self._characters(local, b'email' + domain.lower().encode())}@{domain}"

    def _secret(self, s):
        if s.startswith("AKIA"):
            return "AKIA" + self._base(s[4:], "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", b"secret36")
        if s.startswith("ghp_"):
            return "ghp_" + self._characters(s[4:], b"secret62")
        # Without capitals, with capitals only and with both: each class keeps its letters, and a digit near the start.
        case = lambda t: (re.search("[a-f]", t) is not None, re.search("[A-F]", t) is not None)
        near = lambda t: re.search(r"\d", t[:16]) is not None
        small, large = case(s)
        if not large:
            return self._base(s, "0123456789abcdef", b"secret16", near)
        alphabet, tweak = ("0123456789abcdefABCDEF", b"secret22") if small else ("0123456789ABCDEF", b"secret16-capitals")
        return self._base(s, alphabet, tweak, lambda t: near(t) and case(t) == (small, large))

    def _base(self, s, alphabet, tweak, good=lambda t: True):
        """Permutes within the good strings over the alphabet."""
        while True:
            x = 0
            for c in s:
                x = x * len(alphabet) + alphabet.index(c)
            x = self.net.permute(x, len(alphabet) ** len(s), tweak + bytes([len(s)]), self.undo)
            out = ""
            for _ in s:
                x, r = divmod(x, len(alphabet))
                out = alphabet[r] + out
            if good(out):
                return out
            s = out

    def _card(self, s):
        d = _digits(s)
        if not 13 <= len(d) <= 19 or len(set(d)) == 1 or _luhn(d[:-1]) != d[-1]:
            return None
        body = d[1:-1]  # the first digit names the network
        body = str(self.net.permute(int(body), 10 ** len(body), b"card" + d[:1].encode() + bytes([len(d)]), self.undo)).zfill(len(body))
        return _refill(s, d[0] + body + _luhn(d[0] + body))

    def _phone(self, s):
        d = _digits(s)
        if s.startswith("+") and not s.startswith("+1"):
            head, body = d[:2], d[2:]
            body = str(self.net.permute(int(body), 10 ** len(body), b"phone" + head.encode() + bytes([len(d)]), self.undo)).zfill(len(body))
            return _refill(s, head + body)
        head, body = d[:-10], d[-10:]
        # Regular and irregular codes are permuted among their like.
        regular = lambda x: 2_000_000_000 <= x and x // 1_000_000 % 10 >= 2
        own = regular(int(body))
        x = self._walk(int(body), 10**10, b"phone" if own else b"phone-irregular", lambda x: regular(x) == own)
        return _refill(s, head + str(x).zfill(10))

    def _ssn(self, s):
        good = lambda x: 0 < x // 1_000_000 < 900 and x // 1_000_000 != 666 and x // 10_000 % 100 and x % 10_000
        x = int(_digits(s))
        if not good(x):
            return None
        return _refill(s, str(self._walk(x, 10**9, b"ssn", good)).zfill(9))

    def _ip(self, s):
        parts = s.split(".")
        if any(int(p) > 255 or p != str(int(p)) for p in parts):
            return None
        good = lambda x: 0 < x >> 24 < 224 and x >> 24 not in (10, 127)
        x = int.from_bytes(bytes(map(int, parts)), "big")
        if good(x):
            x = self._walk(x, 1 << 32, b"ip", good)
        else:  # 0, 10 and 127 keep their first part, 224 to 255 are permuted among each other
            low, n = (224 << 24, 32 << 24) if x >> 24 >= 224 else (x >> 24 << 24, 1 << 24)
            x = low + self.net.permute(x - low, n, b"ip-irregular" + bytes([low >> 24]), self.undo)
        return ".".join(map(str, x.to_bytes(4, "big")))

    def _iban(self, s):
        flat = s.replace(" ", "")
        number = lambda t: int("".join(str(int(c, 36)) for c in t))
        if not 15 <= len(flat) <= 34 or number(flat[4:] + flat[:4]) % 97 != 1:
            return None
        body = self._characters(flat[4:], b"iban" + flat[:2].encode())
        new = flat[:2] + f"{98 - number(body + flat[:2] + '00') % 97:02d}" + body
        it = iter(new)
        return "".join(c if c == " " else next(it) for c in s)

    def _date(self, s):
        a, b, c = map(int, re.split(r"[./\-]", s))
        marks = re.findall(r"[./\-]", s)
        if marks[0] != marks[1]:
            return None
        # One order per format, so that the format alone says how to read the pseudonym.
        order = "ymd" if a > 31 or len(re.split(r"[./\-]", s)[0]) == 4 else "mdy" if marks[0] == "/" else "dmy"
        year, month, day = {"ymd": (a, b, c), "dmy": (c, b, a), "mdy": (c, a, b)}[order]
        if order == "mdy" and month > 12:  # day first after all; these have their own days
            return self._day_first(s, a, b, c)
        try:
            x = datetime.date(year, month, day).toordinal() - _FIRST_DAY
        except ValueError:
            return None
        if not 0 <= x < _DAYS:
            return None
        pad = all(len(p) >= 2 for p in re.split(r"[./\-]", s))
        fits = lambda x: self._fits(x, s, pad)
        if not fits(x):
            return None
        t = datetime.date.fromordinal(self._walk(x, _DAYS, b"date" + self._shape(s, pad), fits) + _FIRST_DAY)
        return self._written({"y": t.year, "m": t.month, "d": t.day}, order, marks[0], pad)

    def _day_first(self, s, day, month, year):
        """d/m/y with a day over 12: permuted among such days, so that it can't be read the other way."""
        try:
            x = datetime.date(year, month, day).toordinal() - _FIRST_DAY
        except ValueError:
            return None
        if not 0 <= x < _DAYS:
            return None
        pad = all(len(p) >= 2 for p in s.split("/"))
        on = lambda x: datetime.date.fromordinal(x + _FIRST_DAY)
        good = lambda x: on(x).day > 12 and (pad or on(x).month < 10)
        if not good(x):
            return None
        t = on(self._walk(x, _DAYS, b"date-day-first" + bytes([pad]), good))
        return self._written({"y": t.year, "m": t.month, "d": t.day}, "dmy", "/", pad)

    @staticmethod
    def _written(parts, order, mark, pad):
        return mark.join(f"{parts[k]:04d}" if k == "y" else f"{parts[k]:02d}" if pad else str(parts[k]) for k in order)

    @staticmethod
    def _shape(s, pad):
        return re.sub(r"\d", "", s).encode() + bytes([pad, s[:4].isdigit()])

    @staticmethod
    def _fits(x, s, pad):
        """Without padding some part has one digit; only such days can be told from the padded format."""
        t = datetime.date.fromordinal(x + _FIRST_DAY)
        return pad or t.day < 10 or t.month < 10

    def _value(self, kind, s):
        return getattr(self, f"_{kind}")(s) or s

    def replace(self, text):
        """The new text and how many values of each kind were replaced."""
        counts = {}

        def new(m):
            kind = m.lastgroup
            if kind not in self.kinds:
                return m[0]
            out = self.known(kind, m[0])
            if out != m[0]:
                counts[kind] = counts.get(kind, 0) + 1
            return out

        return _FORMS.sub(new, text), counts


#: What every form holds at least one of.
_SIGN = re.compile(r"[0-9@]|AKIA|ghp_")


def pseudonymise(docs, key, kinds=KINDS, undo=False):
    """`doc_id`, the new `text`, and `replaced` (map of kind to number of values replaced).

    Null texts stay null and empty ones empty; texts without personal values come back unchanged,
    repeated rows alike; other columns are ignored.  Overlapping forms are read in the order of `KINDS`
    as the pattern has them, from the left.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("replaced", pa.map_(pa.string(), pa.int32()))])

    def run(batches):
        names = Pseudonyms(key, undo, kinds)
        for batch in slices(batches):
            texts, counts = [], []
            for t in batch.column("text").to_pylist():
                t, n = names.replace(t) if t and _SIGN.search(t) else (t, {})
                texts.append(t)
                counts.append(list(n.items()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(counts, schema.field("replaced").type)], schema=schema
            )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, text string, replaced map<string,int>")


def rewritten(docs, key, kinds=KINDS):
    """The rows with all their columns, `text` with pseudonyms; they keep its length, and so `n_chars`."""
    def run(batches):
        names = Pseudonyms(key, kinds=kinds)
        for batch in slices(batches):
            texts = [names.replace(t)[0] if t and _SIGN.search(t) else t for t in batch.column("text").to_pylist()]
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))

    return docs.mapInArrow(run, docs.schema)


def op1_pseudonyms(spark, sf_dir):
    """Every document with its personal values replaced."""
    out = pseudonymise(spark.read.parquet(f"{sf_dir}/documents.parquet"), DEMO_KEY)
    counts = [F.coalesce(F.element_at("replaced", k), F.lit(0)).alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", "text", *counts)

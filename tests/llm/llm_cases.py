"""Rows every text operator must take: nulls, empty and long texts, ties, repeated rows, clashing columns."""

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, node string, at int, _at string, "
    "_row long, k string, shard string, length string, label string, first string"
)


def sentence(i, n=12):
    return " ".join(f"w{(i * 31 + j * 7) % 997}x{i % 13}" for j in range(n)) + "."


def prose(i, sentences=9):
    return " ".join(sentence(i * 100 + k) for k in range(sentences))


def rows():
    texts = [
        None, "", "   \n", "one", "a b c", prose(1), prose(1), prose(2), prose(2) + " tail", prose(3),
        "word " * 30_000, "!!! ### $$$ " * 40, "née café 東京 \U0001f600 <|endoftext|> it's", prose(4) + "\n" + prose(5),
    ]
    out = [(i, t, "en" if i % 2 else None, "src0" if i % 3 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    out += [out[5], (None, prose(6), None, None, None), (None, None, None, None, None)]
    return [r + ("x", 1, "y", 2, "z", "s", "n", "l", "f") for r in out]


def tables(spark):
    full = spark.createDataFrame(rows(), SCHEMA)
    return full, spark.createDataFrame([], SCHEMA)


def documents(spark, texts, start=0):
    data = [(start + i, t, "en", "src0", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")

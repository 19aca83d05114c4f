"""From documents to packed training sequences: each stage works on what the one before kept."""

from pyspark.sql import functions as F

from noticeflow.llm import neardup, packing, pseudonyms, quality, spans
from noticeflow.llm.common import stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(docs):
    """The columns of documents; what is missing is null, what is more is left out."""
    kinds = dict(zip(COLUMNS, ("long", "string", "string", "string", "long")))
    have = set(docs.columns)
    return docs.select(*[(F.col(c) if c in have else F.lit(None)).cast(kinds[c]).alias(c) for c in COLUMNS])


def keep_good(spark, docs, sf_dir):
    """Documents that the quality classifier accepts."""
    return quality.kept(_columns(docs))


def keep_first(spark, docs, sf_dir):
    """One row of every class of near-duplicates, the one with the smallest doc_id; null texts all stay."""
    return neardup.first_of_class(_columns(docs))


def drop_repeated_spans(spark, docs, sf_dir):
    """Texts without sentences of repeated runs; documents left without text go, null texts stay."""
    return spans.rewritten(_columns(docs))


def hide_persons(spark, docs, sf_dir):
    """Texts with pseudonyms in place of personal values."""
    return pseudonyms.rewritten(_columns(docs), pseudonyms.DEMO_KEY)


def pack(spark, docs, sf_dir):
    """Pieces of at most 4096 tokens with their sequence and offset."""
    import public_tokenizers

    path = public_tokenizers.path(packing.VOCABULARY)
    return packing.pack(packing.token_pieces(_columns(docs), path))


STAGES = [
    ("quality classifier", keep_good),
    ("near-duplicates", keep_first),
    ("substring dedup", drop_repeated_spans),
    ("personal data", hide_persons),
    ("packing", pack),
]


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, f) in enumerate(STAGES):
        docs = f(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs)
    return docs


#: Not expressible in SQL: trained scorer, weighted samples, keyed permutation.
ORACLE_SQL = None

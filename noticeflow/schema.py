"""Table schemas, declared rather than inferred."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeflow import fixed

_S, _D = T.StringType(), T.DateType()

CANDIDATE = T.StructType(
    [
        T.StructField("source_name", _S),
        T.StructField("source_url", _S),
        T.StructField("title", _S),
        T.StructField("organisation", _S),
        T.StructField("post", _S),
        T.StructField("published_date", _D),
        T.StructField("last_date", _D),
        T.StructField("notification_url", _S),
        T.StructField("application_url", _S),
        T.StructField("discovery_text", _S),
    ]
)


_KINDS = {
    "string": _S,
    "bigint": T.LongType(),
    "date": _D,
    "array<string>": T.ArrayType(_S),
    "boolean": T.BooleanType(),
    "double": T.DoubleType(),
}

RECORD = T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in fixed.RECORD_FIELDS])

PAGES = T.StructType(
    [
        T.StructField("request_url", _S),
        T.StructField("final_url", _S),
        T.StructField("status", T.IntegerType()),
        T.StructField("content_type", _S),
        T.StructField("html", _S),
        T.StructField("fetched_at", T.TimestampType()),
    ]
)

DOCUMENTS = T.StructType(
    [
        T.StructField("request_url", _S),
        T.StructField("final_url", _S),
        T.StructField("status", T.IntegerType()),
        T.StructField("content_type", _S),
        T.StructField("content", T.BinaryType()),
        T.StructField("pages", T.ArrayType(_S)),
        T.StructField("fetched_at", T.TimestampType()),
    ]
)

STORE_EXTRA = ("created_at", "updated_at", "_seq", "first_seq")


def default(field):
    """The value a record has when nothing was supplied: blank text, empty list, NULL for the rest."""
    if field.name == "source_verified":
        return F.lit(False)
    if field.name == "extraction_confidence":
        return F.lit(0.0)
    if isinstance(field.dataType, T.ArrayType):
        return F.array().cast(field.dataType)
    if isinstance(field.dataType, T.StringType):
        return F.lit("")
    return F.lit(None).cast(field.dataType)


def conform(df, keep=()):
    """Select the 34 record columns in order, adding the missing ones at their default."""
    have = set(df.columns)
    cols = [
        (F.col(f.name).cast(f.dataType) if f.name in have else default(f)).alias(f.name)
        for f in RECORD.fields
    ]
    return df.select(*keep, *cols)

"""Structured answers from outside: requests out, validated answers in."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeflow import fixed
from noticeflow.schema import CANDIDATE, RECORD, default
from noticeflow.sources.scratch import parts_of


def extraction_requests(rows, keys, max_chars=fixed.REQUEST_MAX_CHARS):
    """(keys, request): instruction, candidate as JSON, leading part of the text.

    `rows` has the struct `candidate` (NULL for none) and `text`.
    """
    candidate = F.coalesce(
        F.to_json(
            F.struct(*[F.col(f"candidate.{f.name}").alias(f.name) for f in CANDIDATE.fields]),
            {"ignoreNullFields": "false"},
        ),
        F.lit("{}"),
    )
    candidate = F.when(F.col("candidate").isNull(), F.lit("{}")).otherwise(candidate)
    return rows.select(
        *keys,
        F.concat(
            F.lit(fixed.REQUEST_INSTRUCTION),
            F.lit(fixed.REQUEST_CANDIDATE_HEAD),
            candidate,
            F.lit(fixed.REQUEST_DOCUMENT_HEAD),
            F.substring("text", 1, max_chars),
        ).alias("request"),
    )


_WHOLE = r"^\s*[+-]?[0-9]+(_[0-9]+)*(\.0+)?\s*$"
_NOT_DIGITS = r"_|\.0+\s*$"
_NUMBER = r"(?i)^\s*[+-]?([0-9]+\.?[0-9]*(e[+-]?[0-9]+)?|\.[0-9]+(e[+-]?[0-9]+)?|nan|inf|infinity)\s*$"
# a date, or the start of that day
_DAY = r"^\d{4}-\d{2}-\d{2}([Tt ]00:00(:00(\.0+)?)?)?$"
_TRUE = ("1", "t", "true", "y", "yes", "on")
_FALSE = ("0", "f", "false", "n", "no", "off")


def _field(field, answer):
    """(value, fits) of one record field of a variant answer.

    A missing key takes the default; an explicit null is refused except where the field is
    nullable, as is text for a number that does not read as one, and anything but text
    for text.
    """
    path = f"$.{field.name}"
    raw = F.try_variant_get(answer, path, "variant")
    kind = F.schema_of_variant(raw)
    text = F.try_variant_get(answer, path, "string")
    missing, null = raw.isNull(), kind == "VOID"
    is_text, is_flag = kind == "STRING", kind == "BOOLEAN"
    is_number = kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    dt = field.dataType
    if isinstance(dt, T.LongType):
        number = text.try_cast("double")
        value = (
            F.when(is_flag, F.try_variant_get(answer, path, "boolean").cast("bigint"))
            .when(is_text, F.trim(F.regexp_replace(text, _NOT_DIGITS, "")).try_cast("bigint"))
            .otherwise(F.coalesce(text.try_cast("bigint"), number.try_cast("bigint")))
        )
        fits = null | is_flag | (is_text & text.rlike(_WHOLE)) | (is_number & (number == F.floor(number)))
    elif isinstance(dt, T.DateType):
        value = F.when(text.rlike(_DAY), F.substring(text, 1, 10).try_cast("date"))
        fits = null | (is_text & value.isNotNull())
    elif isinstance(dt, T.DoubleType):
        value = F.when(is_flag, F.try_variant_get(answer, path, "boolean").cast("double")).otherwise(
            text.try_cast("double")
        )
        fits = is_number | is_flag | (is_text & text.rlike(_NUMBER))
    elif isinstance(dt, T.BooleanType):
        low = F.lower(text)
        value = low.isin(*_TRUE)
        fits = is_flag | ((is_text | is_number) & low.isin(*_TRUE, *_FALSE))
    elif isinstance(dt, T.ArrayType):
        value = F.try_variant_get(answer, path, "array<string>")
        fits = kind.isin("ARRAY<STRING>", "ARRAY<VOID>") & F.coalesce(
            ~F.exists(value, lambda x: x.isNull()), F.lit(False)
        )
    else:
        value, fits = text, is_text
    return (
        F.when(missing, default(field)).otherwise(value).cast(dt).alias(field.name),
        missing | F.coalesce(fits, F.lit(False)),
    )


def ingest_responses(responses, keys):
    """(keys, valid, record): JSON answers as records; those that do not fit are not valid."""
    parsed = responses.select(*keys, F.try_parse_json("response").alias("_answer"))
    fields = [_field(f, F.col("_answer")) for f in RECORD.fields]
    valid = F.col("_answer").isNotNull() & F.coalesce(
        F.schema_of_variant("_answer").startswith("OBJECT"), F.lit(False)
    )
    for _, fits in fields:
        valid = valid & fits
    return parsed.select(
        *keys, valid.alias("valid"), F.struct(*[value for value, _ in fields]).alias("record")
    )


def latest_answers(answers, on, order):
    """One answer per key: the last valid one by `order`, else the last one.

    Whole records are sorted by key, so the partitions are as many as the answers need.
    """
    kept = F.struct("valid", "record")
    return (
        answers.repartition(parts_of(answers), *on)
        .groupBy(*on)
        .agg(F.max_by(kept, F.struct("valid", *order)).alias("a"))
        .select(*on, "a.*")
    )


def overlay_applies(has_text, enabled):
    """Only documents with text are overlaid, and only when the overlay is switched on."""
    return has_text & F.lit(bool(enabled))


def overlay(rows, answers, on, enabled=True):
    """A valid answer replaces the whole record; without one the extracted record stays.

    `answers` has at most one row per key.  Adds `answer_valid` (NULL without an answer).
    """
    if not enabled:
        return rows
    known = answers.select(
        *on, F.col("valid").alias("answer_valid"), F.when(F.col("valid"), F.col("record")).alias("_answer")
    )
    joined = rows.join(known, list(on), "left")
    take = F.col("_answer").isNotNull() & overlay_applies(F.col("document.has_text"), enabled)
    return joined.withColumn(
        "record", F.when(take, F.col("_answer")).otherwise(F.col("record"))
    ).drop("_answer")

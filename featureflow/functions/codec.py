"""JSON codec between topic records ``(topic, key, value)`` and typed rows.

Decoding and encoding are plain column expressions (``from_json`` /
``to_json``), so they run JVM-side on batch and streaming frames alike and
keep the transport (Kafka, files) separate from the format.
"""

from __future__ import annotations

from typing import Any, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featureflow.functions.schema import quote, to_struct

# Timestamp formats with microseconds.  The default JSON
# formats keep milliseconds only, so a round trip would change timestamps.
JSON_OPTIONS: dict[str, str] = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}

CORRUPT = "_corrupt_record"
BAD = "_is_bad"
REASON = "_bad_reason"


def output_topic(app_name: str, code_version: int) -> str:
    """Name of an app's published topic for one code version."""
    return f"{app_name}_v{code_version}"


def decode(raw: DataFrame, schema: Any, value_col: str = "value",
           keep: Sequence[str] = ()) -> DataFrame:
    """Parse ``value_col`` (bytes or text) as JSON with the declared schema.

    Returns ``keep`` columns followed by the declared fields.  Malformed text
    gives nulls; use :func:`decode_checked` to keep it apart.
    """
    struct = to_struct(schema)
    parsed = F.from_json(F.col(value_col).cast("string"), struct, JSON_OPTIONS)
    return raw.select(*[F.col(quote(k)) for k in keep], parsed.alias("_v")).select(
        *[F.col(quote(k)) for k in keep], "_v.*"
    )


def decode_checked(raw: DataFrame, schema: Any, value_col: str = "value",
                   keep: Sequence[str] = ()) -> DataFrame:
    """Decode and flag bad records instead of silently nulling them.

    A record is bad when its value is null, is not a JSON object, or holds a
    value of the wrong type.  Bad rows keep all declared fields null and get
    ``_is_bad = true`` with a reason (``null value`` / ``malformed``) and the
    raw text in ``_corrupt_record``.  A missing field is not an error: it
    decodes to null, as in the declared (nullable) schema.
    """
    struct = to_struct(schema)
    with_corrupt = T.StructType(struct.fields + [T.StructField(CORRUPT, T.StringType())])
    opts = {**JSON_OPTIONS, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    text = F.col(value_col).cast("string")
    v = F.from_json(text, with_corrupt, opts)
    staged = raw.select(*[F.col(quote(k)) for k in keep], text.alias("_text"), v.alias("_v"))
    is_null = F.col("_text").isNull()
    malformed = F.col("_v").isNull() | F.col(f"_v.{CORRUPT}").isNotNull()
    bad = is_null | malformed
    reason = F.when(is_null, F.lit("null value")).when(malformed, F.lit("malformed"))
    fields = [F.when(~bad, F.col("_v")[f.name]).alias(f.name) for f in struct.fields]
    return staged.select(
        *[F.col(quote(k)) for k in keep],
        *fields,
        bad.alias(BAD),
        reason.alias(REASON),
        F.when(malformed & ~is_null, F.col("_text")).alias(CORRUPT),
    )


def split_bad(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows without flag columns, quarantined rows) of a checked decode."""
    good = decoded.filter(~F.col(BAD)).drop(BAD, REASON, CORRUPT)
    return good, decoded.filter(F.col(BAD))


def key_json(key_cols: Sequence[str]) -> Column:
    """Message key: the primary-key values as a JSON object."""
    return F.to_json(F.struct(*[F.col(quote(k)) for k in key_cols]), JSON_OPTIONS)


def encode(df: DataFrame, key_cols: Sequence[str], topic: str) -> DataFrame:
    """Typed rows -> ``(topic, key, value)`` with JSON key and value."""
    value = F.to_json(F.struct(*[F.col(quote(c)) for c in df.columns]), JSON_OPTIONS)
    key = key_json(key_cols) if key_cols else F.lit(None).cast("string")
    return df.select(F.lit(topic).alias("topic"), key.alias("key"), value.alias("value"))

"""Declared schemas: validation, conversion to Spark types, conformance.

Schemas are declared per code version and never inferred.  Two shapes are
accepted: a list of ``{"name", "type"}`` fields, and the record form
``{"fields": [...]}``.  Type names are Spark DDL types plus the Avro
primitive names below.
"""

from __future__ import annotations

import re
from typing import Any, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Avro primitive type names mapped to Spark types.  Other names
# go through Spark's DDL parser; "null" is refused.
AVRO_PRIMITIVES: dict[str, T.DataType] = {
    "string": T.StringType(),
    "boolean": T.BooleanType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "float": T.FloatType(),
    "double": T.DoubleType(),
    "bytes": T.BinaryType(),
}

_SIMPLE_NAME = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")


def unwrap_record(schema: Any) -> list:
    """Record form ``{"fields": [...]}`` -> field list; a list passes through."""
    if isinstance(schema, dict):
        if "fields" not in schema:
            raise ValueError("record schema needs a 'fields' list")
        schema = schema["fields"]
    if not isinstance(schema, (list, tuple)):
        raise ValueError(f"schema must be a field list, got {type(schema).__name__}")
    return list(schema)


def validate_fields(schema: Any) -> list[dict]:
    """Every field is a dict with a string ``name`` and a string ``type``."""
    fields = unwrap_record(schema)
    seen: set[str] = set()
    for i, f in enumerate(fields):
        if not isinstance(f, dict):
            raise ValueError(f"field {i} is not an object")
        for attr in ("name", "type"):
            if attr not in f:
                raise ValueError(f"field {i} has no '{attr}'")
            if not isinstance(f[attr], str):
                raise ValueError(f"field {i}: '{attr}' must be a string")
        if f["name"] in seen:
            raise ValueError(f"duplicate field name {f['name']!r}")
        seen.add(f["name"])
    return fields


def parse_type(type_name: str) -> T.DataType:
    """Avro primitive names directly; any other name with Spark's DDL parser
    (needs an active session, as every job has)."""
    name = type_name.strip()
    low = name.lower()
    if low in AVRO_PRIMITIVES:
        return AVRO_PRIMITIVES[low]
    if low == "null":
        raise ValueError("type 'null' is not supported for a field")
    try:
        parsed = T.DataType.fromDDL(f"v {name}")
    except Exception as exc:  # the DDL parser raises a parse exception
        raise ValueError(f"unknown type {type_name!r}") from exc
    return parsed.fields[0].dataType


def to_struct(schema: Any) -> T.StructType:
    """Field list or record form -> ``StructType`` (all fields nullable)."""
    if isinstance(schema, T.StructType):
        return schema
    return T.StructType(
        [T.StructField(f["name"], parse_type(f["type"]), True)
         for f in validate_fields(schema)]
    )


def field_list(struct: T.StructType) -> list[dict]:
    """``StructType`` -> ``[{"name", "type"}]`` using Spark type names."""
    return [{"name": f.name, "type": f.dataType.simpleString()} for f in struct.fields]


def check_primary_keys(primary_keys: Iterable[str], columns: Any) -> list[str]:
    """Primary keys must be a non-empty subset of the output fields."""
    keys = list(primary_keys)
    if isinstance(columns, T.StructType):
        names = columns.fieldNames()
    elif columns and isinstance(columns[0], dict):
        names = [f["name"] for f in validate_fields(columns)]
    else:
        names = list(columns)
    if not keys:
        raise ValueError("at least one primary key is required")
    missing = [k for k in keys if k not in names]
    if missing:
        raise ValueError(f"primary keys {missing} are not output fields {names}")
    return keys


def quote(name: str) -> str:
    """Backtick-quote a column name unless it is a plain identifier."""
    if _SIMPLE_NAME.match(name):
        return name
    return "`" + name.replace("`", "``") + "`"


def conform(df: DataFrame, schema: Any) -> DataFrame:
    """Select the declared fields in declared order, cast to declared types.

    A declared field missing from ``df`` is an error; extra columns are
    dropped.  A fraction that a whole-number field cannot hold fails the job
    instead of being cut off.  Casting is JVM-side and keeps the plan in
    codegen.
    """
    struct = to_struct(schema)
    have = set(df.columns)
    missing = [f.name for f in struct.fields if f.name not in have]
    if missing:
        raise ValueError(f"output is missing declared fields {missing}")
    current = {f.name: f.dataType for f in df.schema.fields}
    cols = []
    for f in struct.fields:
        c = F.col(quote(f.name))
        have = current[f.name]
        if have != f.dataType:
            whole = c.cast(f.dataType)
            if isinstance(have, T.FractionalType) and isinstance(f.dataType, T.IntegralType):
                lost = F.concat(F.lit(f"{f.name}: no whole number: "), c.cast("string"))
                whole = F.when(c.isNull() | (whole.cast(have) == c), whole).otherwise(F.raise_error(lost).cast(f.dataType))
            c = whole
        cols.append(c.alias(f.name))
    return df.select(*cols)

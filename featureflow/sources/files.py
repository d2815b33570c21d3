"""File sources: archived topics, JSON-lines folders, inline samples, tables.

All of them are Spark readers with a declared schema; nothing is parsed on
the driver except inline samples, which are small by contract.
"""

from __future__ import annotations

import base64
import json
import posixpath
from datetime import datetime
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featureflow.config import InputSpec
from featureflow.functions.codec import JSON_OPTIONS, REASON
from featureflow.functions.schema import quote, to_struct
from featureflow.session import ensure_dir, is_file


def folder_location(base: str, app_name: str, topic: str) -> str:
    """Folder of one app's topic under a base folder: ``base/app/topic``."""
    return f"{base.rstrip('/')}/{app_name}/{topic}"


def archive_streams(spark: SparkSession, base: str, app_name: str,
                    inputs: Sequence[InputSpec], max_file_age: str,
                    max_files_per_trigger: int | None = None) -> list[DataFrame]:
    """Stream each topic's Parquet archive, ignoring files older than
    ``max_file_age`` (after the first batch, as Spark's file source does).
    Records that did not decode are kept in the archive with their raw text
    and left out here."""
    out = []
    for inp in inputs:
        struct = to_struct(inp.topic_schema)
        reader = (spark.readStream.schema(T.StructType([*struct.fields, T.StructField(REASON, T.StringType())]))
                  .option("maxFileAge", max_file_age))
        if max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
        rows = reader.parquet(ensure_dir(spark, folder_location(base, app_name, inp.topic)))
        out.append(rows.filter(F.col(REASON).isNull()).drop(REASON))
    return out


def json_line_streams(spark: SparkSession, base: str, app_name: str,
                      inputs: Sequence[InputSpec], max_file_age: str,
                      max_files_per_trigger: int | None = None) -> list[DataFrame]:
    """Stream each topic's JSON-lines folder with its declared schema."""
    out = []
    for inp in inputs:
        reader = (spark.readStream.schema(to_struct(inp.topic_schema))
                  .options(**JSON_OPTIONS).option("maxFileAge", max_file_age))
        if max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
        out.append(reader.json(ensure_dir(spark, folder_location(base, app_name, inp.topic))))
    return out


def read_json_lines(spark: SparkSession, path: str, schema) -> DataFrame:
    """JSON-lines files as typed rows; a bad line fails the read."""
    return (spark.read.schema(to_struct(schema)).options(**JSON_OPTIONS)
            .option("mode", "FAILFAST").json(path))


def _json_value(value):
    """What ``json.dumps`` has no form for, as text."""
    if isinstance(value, datetime):
        return value.isoformat(timespec="microseconds")
    if isinstance(value, (bytes, bytearray)):
        return base64.b64encode(value).decode("ascii")
    return str(value)


def json_frame(spark: SparkSession, rows: list[dict] | str, schema) -> DataFrame:
    """JSON objects, inline or as a folder of JSON lines, as rows of the
    declared schema.  Times are read in any ISO form; a value that is not of
    its field's type fails the read."""
    struct, options = to_struct(schema), {"mode": "FAILFAST"}
    if isinstance(rows, str):
        return spark.read.schema(struct).options(**options).json(rows).select(*map(quote, struct.fieldNames()))
    texts = spark.createDataFrame([(json.dumps(r, default=_json_value),) for r in rows], "value string")
    return texts.select(F.from_json("value", struct, options).alias("_v")).select("_v.*")


def sample_frame(spark: SparkSession, inp: InputSpec) -> DataFrame:
    """Sample rows of a topic (inline, or a folder of JSON lines)."""
    return json_frame(spark, inp.sample, inp.topic_schema)


def table_stream(spark: SparkSession, path: str,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """Stream a Parquet table that is either one file or a folder of files.

    The schema is the table's own (read from Parquet footers, not inferred
    from data); a single file is streamed from its folder with a file-name
    filter, so nothing is copied."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    if is_file(spark, path):
        parent, name = posixpath.split(path.rstrip("/"))
        return reader.option("pathGlobFilter", name).parquet(parent)
    return reader.parquet(path)

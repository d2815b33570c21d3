"""Job-status documents flattened to a table.

A status document is nested (metadata, status).  Flattening is a single
projection, row order and duplicates preserved: nothing is grouped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

def status_schema(id_type: str = "long") -> T.StructType:
    """Schema of a status document; application ids are whole numbers in some
    deployments and text in others."""
    fields = [f if f.name != "status" else T.StructField("status", T.StructType([
        T.StructField(g.name, T.DataType.fromDDL(f"v {id_type}").fields[0].dataType if g.name == "sparkApplicationId" else g.dataType)
        for g in f.dataType.fields])) for f in STATUS_SCHEMA.fields]
    return T.StructType(fields)


STATUS_SCHEMA = T.StructType([
    T.StructField("metadata", T.StructType([
        T.StructField("creationTimestamp", T.StringType()),
        T.StructField("labels", T.StructType([T.StructField("app", T.StringType())])),
        T.StructField("name", T.StringType()),
    ])),
    T.StructField("status", T.StructType([
        T.StructField("applicationState", T.StructType([T.StructField("state", T.StringType())])),
        T.StructField("sparkApplicationId", T.LongType()),
        T.StructField("lastSubmissionAttemptTime", T.StringType()),
        T.StructField("terminationTime", T.StringType()),
        T.StructField("executionAttempts", T.LongType()),
        T.StructField("submissionAttempts", T.LongType()),
    ])),
])

# Output column <- path in the status document.
STATUS_COLUMNS = [
    ("job_name", "metadata.labels.app"),
    ("spark_name", "metadata.name"),
    ("state", "status.applicationState.state"),
    ("id", "status.sparkApplicationId"),
    ("start_time", "status.lastSubmissionAttemptTime"),
    ("container_start_time", "metadata.creationTimestamp"),
    ("stop_time", "status.terminationTime"),
    ("execution_attempts", "status.executionAttempts"),
    ("submission_attempts", "status.submissionAttempts"),
]


def flatten_status(docs: DataFrame) -> DataFrame:
    """Nested status documents (``metadata``, ``status`` structs) -> nine flat
    columns.  A null value stays null."""
    return docs.select(*[F.col(path).alias(name) for name, path in STATUS_COLUMNS])


def _levels() -> list[str]:
    """Objects on the way to a column, outer ones first; "" is the document."""
    found = {".".join(path.split(".")[:n]) for _, path in STATUS_COLUMNS for n in range(path.count(".") + 1)}
    return sorted(found, key=lambda p: (p != "", p.count("."), p))


def parse_status(texts: DataFrame, column: str = "document", strict: bool = False,
                 id_type: str = "long") -> DataFrame:
    """JSON status documents -> flat table.

    ``id_type`` is the type of application ids ("long", or "string" where
    they are text).  By default a missing key gives null, like a null value,
    and so does a value that is not of its column's type.  With
    ``strict=True`` a document missing any key on the way to a column, or
    holding a value of another type, fails the job with the path, as plain
    indexing would.
    """
    schema = status_schema(id_type)
    text = F.col(column).cast("string")
    parsed = texts.select(F.from_json(text, schema).alias("_d"), text.alias("_t"))
    if strict:
        # Each object on the way is parsed once, into its keys and values.
        names = {path: f"_o{n}" for n, path in enumerate(_levels())}
        for path, name in names.items():
            parent, _, key = path.rpartition(".")
            source = F.col("_t") if not path else F.col(names[parent])[key]
            parsed = parsed.withColumn(name, F.from_json(source, "map<string,string>"))
        problem = F.lit(None).cast("string")
        for path in reversed([p for p in [*names, *(p for _, p in STATUS_COLUMNS)] if p]):
            parent, _, key = path.rpartition(".")
            holder = F.col(names[parent])
            if path not in names:
                problem = F.when(holder[key].isNotNull() & F.col(f"_d.{path}").isNull(),
                                 F.lit(f"cannot read {path}")).otherwise(problem)
            present = F.coalesce(F.map_contains_key(holder, key), F.lit(False))
            problem = F.when(~present, F.lit(f"has no key {path}")).otherwise(problem)
        parsed = parsed.withColumn(
            "_d", F.when(problem.isNull(), F.col("_d")).otherwise(
                F.raise_error(F.concat(F.lit("status document "), problem)).cast(schema)))
    return flatten_status(parsed.select("_d.*"))

"""Schema registry: every registration of an app's output schema gets the
next code version, kept as history; the current version is derived.

Registrations are a table of requests ``(org, app, request_id, requested_at,
primary_keys, fields)``.  Version = the app's current version + the
request's rank among that app's new requests.  The rank comes from
``count_preceding``, so one app with a huge number of requests does not land
in one task.

The history is a sequence of commits, each a folder of Parquet that counts once
the marker with its number names it.  A marker is created only if absent, so of
several writers that worked from the same state one takes the number; the others
assign their versions again, from the state with its commit.  So any number of
writers give versions without gap or repeat.

Every ``FOLD_EVERY`` commits the one who made the last folds them: all history by
app bucket, and a summary of every app's newest version.  Readers take the newest
fold and the commits after it, at most about ``FOLD_EVERY`` folders however many
registrations there were; current versions come from the summary alone.  What the
newest two folds have replaced is deleted.
"""

from __future__ import annotations

import datetime as _dt
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featureflow.functions.schema import check_primary_keys, validate_fields
from featureflow.operators.ranking import count_preceding
from featureflow.session import create_marker, delete_dir, is_missing_path, list_dirs, list_files, read_marker

KEYS = ["org", "app"]
# The history is kept in folders by app, so that one app's rows are found.
APP_BUCKET = "app_bucket"
APP_BUCKETS = 64
# Commits that are folded together, and attempts to commit beside other writers.
FOLD_EVERY = 64
ATTEMPTS = 100
FIELD = T.StructType([T.StructField("name", T.StringType()), T.StructField("type", T.StringType())])
REQUEST_SCHEMA = T.StructType([
    T.StructField("org", T.StringType()),
    T.StructField("app", T.StringType()),
    T.StructField("request_id", T.LongType()),
    T.StructField("requested_at", T.TimestampNTZType()),
    T.StructField("primary_keys", T.ArrayType(T.StringType())),
    T.StructField("fields", T.ArrayType(FIELD)),
])
HISTORY_SCHEMA = T.StructType([
    T.StructField("org", T.StringType()),
    T.StructField("app", T.StringType()),
    T.StructField("code_version", T.IntegerType()),
    T.StructField("request_id", T.LongType()),
    T.StructField("requested_at", T.TimestampNTZType()),
    T.StructField("primary_keys", T.ArrayType(T.StringType())),
    T.StructField("avro_schema", T.StringType()),
])


def schema_text(fields: Column) -> Column:
    """Field list as JSON text, laid out as Python's ``json.dumps`` does:
    ``[{"name": "a", "type": "string"}, ...]``.

    ``to_json`` writes the compact form; the three literal replacements add
    the spaces.  They can only match between values, because inside a JSON
    string every quote is escaped.  Names are compared as written by
    ``to_json`` (non-ASCII characters are not turned into ``\\u`` escapes;
    ``register_schema``, which has the schema as a Python value, writes
    ``json.dumps`` of it).
    """
    compact = F.to_json(fields)
    spaced = F.replace(compact, F.lit('"},{"name":'), F.lit('"}, {"name":'))
    spaced = F.replace(spaced, F.lit('{"name":"'), F.lit('{"name": "'))
    return F.replace(spaced, F.lit('","type":"'), F.lit('", "type": "'))


def request_errors(requests: DataFrame) -> Column:
    """Null for a valid request, else why it is refused: every field needs a
    name and a type, names are unique, primary keys are output fields."""
    fields = F.col("fields")
    names = F.col("fields.name")
    return (
        F.when(fields.isNull() | (F.size(fields) == 0), F.lit("schema has no fields"))
        .when(F.exists(fields, lambda f: f["name"].isNull() | f["type"].isNull()),
              F.lit("every field needs a string name and type"))
        .when(F.size(F.array_distinct(names)) != F.size(names), F.lit("duplicate field names"))
        .when(F.col("primary_keys").isNull() | (F.size("primary_keys") == 0),
              F.lit("at least one primary key is required"))
        .when(F.size(F.array_except("primary_keys", names)) > 0,
              F.lit("primary keys are not a subset of the output fields"))
    )


SUMMARY_SCHEMA = T.StructType([f for f in HISTORY_SCHEMA.fields if f.name in (*KEYS, "code_version")])
PART = "part"


def _app_bucket() -> Column:
    return F.pmod(F.xxhash64(*KEYS), F.lit(APP_BUCKETS)).cast("int")


def _folder(root: str, name: str) -> str:
    return f"{root}/data/{PART}={name}"


@dataclass(frozen=True)
class _State:
    """The newest fold and the commits after it, by number and name."""

    root: str
    fold: tuple[int, str] | None
    commits: tuple[tuple[int, str], ...]

    @property
    def number(self) -> int:
        return self.commits[-1][0] if self.commits else self.fold[0] if self.fold else 0

    def folders(self, kind: str = "history") -> list[str]:
        folded = [_folder(self.root, f"{kind}-{self.fold[1]}")] if self.fold else []
        return folded + [_folder(self.root, f"commit-{name}") for _, name in self.commits]


def _state(spark: SparkSession, root: str) -> _State:
    """From file names and the markers after the newest fold; no Spark job."""
    folds = max((int(n) for n in list_files(spark, f"{root}/folds")), default=0)
    fold = (folds, read_marker(spark, f"{root}/folds/{folds:09d}")) if folds else None
    numbers = sorted(int(n) for n in list_files(spark, f"{root}/commits") if int(n) > folds)
    return _State(root, fold, tuple((n, read_marker(spark, f"{root}/commits/{n:09d}")) for n in numbers))


def _rows(spark: SparkSession, root: str, folders: list[str], schema: T.StructType) -> DataFrame:
    """Rows of folders, with the app bucket; none if nothing is registered."""
    schema = T.StructType([*schema.fields, T.StructField(APP_BUCKET, T.IntegerType())])
    try:
        stored = spark.read.schema(T.StructType([*schema.fields, T.StructField(PART, T.StringType())]))
        return stored.option("basePath", f"{root}/data").parquet(*(folders or [_folder(root, "none")])).drop(PART)
    except AnalysisException as exc:
        if not is_missing_path(exc):
            raise
        return spark.createDataFrame([], schema)


def _write(rows: DataFrame, path: str) -> None:
    """History rows in folders by app bucket.  Rows are ranged by bucket, so a
    task writes few files, and a bucket with a hot app is split by version."""
    (rows.withColumn(APP_BUCKET, _app_bucket()).repartitionByRange(APP_BUCKET, "code_version")
     .write.partitionBy(APP_BUCKET).parquet(path))


def _commit(spark: SparkSession, registry_root: str, build: Callable[[_State], DataFrame]) -> str:
    """Append the rows that ``build`` makes from a state, if that is still the
    newest one, else again; the folder of the commit."""
    root = registry_root.rstrip("/")
    for _ in range(ATTEMPTS):
        state = _state(spark, root)
        name = f"{state.number + 1:09d}-{uuid.uuid4().hex[:12]}"
        folder = _folder(root, f"commit-{name}")
        _write(build(state), folder)
        if create_marker(spark, f"{root}/commits/{state.number + 1:09d}", name):
            if len(state.commits) + 1 >= FOLD_EVERY:
                fold_history(spark, root)
            return folder
        delete_dir(spark, folder, f"{root}/data")
    raise RuntimeError(f"{root}: {ATTEMPTS} attempts to commit met other writers")


def fold_history(spark: SparkSession, registry_root: str) -> int:
    """Fold all commits so far; the number of the newest fold."""
    root = registry_root.rstrip("/")
    state = _state(spark, root)
    if not state.commits:
        return state.number
    name = f"{state.number:09d}-{uuid.uuid4().hex[:12]}"
    made = [_folder(root, f"{kind}-{name}") for kind in ("history", "current")]
    _write(_rows(spark, root, state.folders(), HISTORY_SCHEMA).drop(APP_BUCKET), made[0])
    _write(current_versions(_rows(spark, root, made[:1], HISTORY_SCHEMA)), made[1])
    if not create_marker(spark, f"{root}/folds/{state.number:09d}", name):
        for folder in made:  # another one folded the same
            delete_dir(spark, folder, f"{root}/data")
        return state.number
    # Readers may still be on the fold before this one: what that one has
    # replaced goes.
    previous = state.fold[0] if state.fold else 0
    for own in list_dirs(spark, f"{root}/data"):
        kind, number, _ = own.removeprefix(f"{PART}=").split("-")
        if int(number) < previous or (kind == "commit" and int(number) == previous):
            delete_dir(spark, f"{root}/data/{own}", f"{root}/data")
    for n in list_files(spark, f"{root}/commits"):
        if int(n) <= previous:
            delete_dir(spark, f"{root}/commits/{n}", f"{root}/commits")
    for n in list_files(spark, f"{root}/folds"):
        if int(n) < previous:
            delete_dir(spark, f"{root}/folds/{n}", f"{root}/folds")
    return state.number


def read_history(spark: SparkSession, registry_root: str) -> DataFrame:
    state = _state(spark, registry_root.rstrip("/"))
    return _rows(spark, state.root, state.folders(), HISTORY_SCHEMA).drop(APP_BUCKET)


def read_current(spark: SparkSession, registry_root: str) -> DataFrame:
    """``(org, app, code_version)``: the newest version of every app, from the
    summary of the newest fold and the commits after it."""
    state = _state(spark, registry_root.rstrip("/"))
    return current_versions(_rows(spark, state.root, state.folders("current"), SUMMARY_SCHEMA))


def history_of(spark: SparkSession, registry_root: str, org: str, app: str) -> DataFrame:
    """The history of one app; only the folders of its bucket are read."""
    return _history_of(spark, _state(spark, registry_root.rstrip("/")), org, app)


def _history_of(spark: SparkSession, state: _State, org: str, app: str) -> DataFrame:
    one = spark.range(1).select(F.lit(org).alias("org"), F.lit(app).alias("app"))
    bucket = one.select(_app_bucket()).first()[0]
    mine = (F.col(APP_BUCKET) == bucket) & (F.col("org") == org) & (F.col("app") == app)
    return _rows(spark, state.root, state.folders(), HISTORY_SCHEMA).filter(mine).drop(APP_BUCKET)


def current_versions(history: DataFrame) -> DataFrame:
    """``(org, app, code_version)``: the newest version of every app."""
    return history.groupBy(*KEYS).agg(F.max("code_version").alias("code_version"))


def current_records(history: DataFrame) -> DataFrame:
    """The newest history row of every app (its current schema record)."""
    cols = [c for c in HISTORY_SCHEMA.fieldNames() if c not in KEYS]
    newest = history.groupBy(*KEYS).agg(
        F.max_by(F.struct(*cols), F.col("code_version")).alias("_r"))
    return newest.select(*KEYS, *[F.col("_r")[c].alias(c) for c in cols])


def current_for(history: DataFrame, apps: DataFrame) -> DataFrame:
    """Current version for each requested ``(org, app)``, 0 when unknown."""
    cur = current_versions(history.join(apps.select(*KEYS).distinct(), KEYS, "left_semi"))
    return apps.select(*KEYS).join(cur, KEYS, "left").select(
        *KEYS, F.coalesce(F.col("code_version"), F.lit(0)).cast("int").alias("code_version"))


def assign_versions(requests: DataFrame, history: DataFrame) -> DataFrame:
    """History rows for the valid requests: previous version + rank of the
    request among the app's requests by ``(requested_at, request_id)``."""
    checked = requests.withColumn("_error", request_errors(requests))
    valid = (checked.filter(F.col("_error").isNull())
             .select(*KEYS, "request_id", "requested_at", "primary_keys",
                     schema_text(F.col("fields")).alias("avro_schema"),
                     F.lit(1).cast("long").alias("_one")))
    ranks = count_preceding(valid, KEYS, ["requested_at", "request_id"], "_one", ["request_id"],
                            out="_rank", carry=["requested_at", "primary_keys", "avro_schema"])
    # Only the histories of the apps that ask are grouped.
    asked = valid.select(*KEYS).distinct()
    cur = current_versions(history.join(asked, KEYS, "left_semi")).withColumnRenamed("code_version", "_prev")
    ranked = ranks.join(cur, KEYS, "left")
    return ranked.select(
        "org", "app",
        (F.coalesce(F.col("_prev"), F.lit(0)) + F.col("_rank") + 1).cast("int").alias("code_version"),
        "request_id", "requested_at", "primary_keys", "avro_schema")


def rejected(requests: DataFrame) -> DataFrame:
    """Requests that are refused, with the reason."""
    return requests.withColumn("error", request_errors(requests)).filter(F.col("error").isNotNull())


def register(spark: SparkSession, registry_root: str, requests: DataFrame) -> DataFrame:
    """Assign versions, commit them to the history and return the written rows
    (read back, so later reads see exactly what was stored).  Only the apps'
    current versions are read, not their histories."""
    def build(state: _State) -> DataFrame:
        return assign_versions(requests, _rows(spark, state.root, state.folders("current"), SUMMARY_SCHEMA))

    folder = _commit(spark, registry_root, build)
    return _rows(spark, registry_root.rstrip("/"), [folder], HISTORY_SCHEMA).drop(APP_BUCKET)


def register_schema(spark: SparkSession, registry_root: str, org: str, app: str,
                    primary_keys: list[str], schema) -> int:
    """Register one schema and return its new code version.

    A new version is assigned on every call, also when the schema is
    unchanged.  Invalid schemas raise ``ValueError``.
    """
    fields = validate_fields(schema)
    check_primary_keys(primary_keys, fields)
    now = _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
    given = 0

    def build(state: _State) -> DataFrame:
        # One request: its version is simply the current one plus one.
        nonlocal given
        given = (_history_of(spark, state, org, app).agg(F.max("code_version")).first()[0] or 0) + 1
        return spark.createDataFrame([(org, app, given, 0, now, list(primary_keys), json.dumps(fields))], HISTORY_SCHEMA)

    _commit(spark, registry_root, build)
    return given

"""The registered queries: each runs a library job over the driver's tables
and returns the result as a batch DataFrame (read back from what the job
wrote under the shared scratch folder).  Streams are run with an
``availableNow`` trigger, so each query processes all of its input."""

from __future__ import annotations

from dataclasses import replace

from pyspark.errors import AnalysisException, StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featureflow.config import InputSpec, JobConfig, OutputSpec, TableSpec
from featureflow.functions.codec import CORRUPT, JSON_OPTIONS, REASON, decode, encode, key_json, output_topic
from featureflow.functions.schema import to_struct
from featureflow.functions.time import epoch_micros, to_wall_clock
from featureflow.operators.checks import compare_rows
from featureflow.operators.features import interval_join, trailing_count, windowed_count
from featureflow.operators.registry import current_for, fold_history, read_current, register
from featureflow.operators.status import parse_status
from featureflow.operators.store import FeatureStore
from featureflow.operators.trailing import STATE_SETTINGS, stream_trailing_count
from featureflow.plans.jobs import (
    archive_base,
    archive_job,
    feature_store,
    fold_archive_job,
    live_job,
    ordered_replay_job,
    replay_job,
)
from featureflow.plans.tables import EVENTS_SCHEMA, ORDERS_SCHEMA, table_path
from featureflow.session import is_missing_path, scratch_dir
from featureflow.sources.files import folder_location, json_line_streams, read_json_lines, table_stream
from featureflow.sources.topics import FileTransport, publish, read_topic_checked, read_topics
from featureflow.streaming.late import CLOSED, late_split
from featureflow.streaming.outbox import read_published
from featureflow.streaming.runner import run_bounded
from featureflow.streaming.sinks import write_batch_folder

RUN = "run0"
VERSION = 1
EVENTS = InputSpec("events", EVENTS_SCHEMA)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def _run_to_table(spark: SparkSession, df: DataFrame, root: str, mode: str = "append",
                  final_no_data_batch: bool = True) -> DataFrame:
    """Run a stream to the end of its input into Parquet; read it back."""
    out = f"{root}/out"

    def write(batch_df: DataFrame, batch_id: int) -> None:
        write_batch_folder(batch_df, out, {"run_id": RUN, "batch_id": batch_id})

    run_bounded(df, write, OutputSpec(mode), f"{root}/checkpoint", final_no_data_batch)
    return _read_or_empty(spark, out, df.schema)


def _read_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    """Parquet written by a stream; an input without rows writes nothing."""
    try:
        return spark.read.schema(schema).parquet(path).select(*schema.fieldNames())
    except AnalysisException as exc:
        if not is_missing_path(exc):
            raise
        return spark.createDataFrame([], schema)


def _store_from_table(spark: SparkSession, sf_dir: str, table: str, spec: TableSpec,
                      label: str) -> FeatureStore:
    """Stream a table through the store writer (append mode) and return the store."""
    root = scratch_dir(spark, label)
    store = FeatureStore(f"{root}/store", spec)
    stream = table_stream(spark, table_path(sf_dir, table))
    run_bounded(stream, store.writer(VERSION, RUN), OutputSpec("append"), f"{root}/checkpoint")
    return store


def _events_topic(spark: SparkSession, sf_dir: str, root: str) -> FileTransport:
    transport = FileTransport(f"{root}/topics")
    publish(_read(spark, sf_dir, "events"), transport, "events", ["event_id"])
    return transport


# ---------------------------------------------------------------- sources

def topic_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events published as JSON records, decoded by the declared schema."""
    root = scratch_dir(spark, "topic_decode")
    transport = _events_topic(spark, sf_dir, root)
    return decode(transport.read_batch(spark, "events"), EVENTS_SCHEMA)


def _damaged(ev: DataFrame) -> DataFrame:
    """Events as topic records, four in ten damaged, each in another way: cut
    short, wrong type, null value, missing field."""
    def record(**other) -> Column:
        own = [other.get(c, F.col(c)) for c in ev.columns]
        return F.to_json(F.struct(*[v.alias(c) for c, v in zip(ev.columns, own) if v is not None]), JSON_OPTIONS)

    full, no_user = record(), record(user_id=None)
    fault = F.col("event_id") % 10
    value = (F.when(fault == 0, F.left(full, F.floor(F.length(full) / 2).cast("int")))
             .when(fault == 1, record(value=F.lit("not a number")))
             .when(fault == 2, F.lit(None).cast("string"))
             .when(fault == 3, no_user)
             .otherwise(full))
    return ev.select(F.lit("events").alias("topic"), key_json(["event_id"]).alias("key"), value.alias("value"))


def topic_decode_bad_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a topic record, four in ten damaged, streamed and
    decoded with bad records flagged, and their raw text kept."""
    root = scratch_dir(spark, "topic_decode_bad_rows")
    transport = FileTransport(f"{root}/topics")
    transport.write_batch(_damaged(_read(spark, sf_dir, "events")))
    checked = read_topic_checked(spark, EVENTS, transport).drop("timestamp")
    return _run_to_table(spark, checked, root)


def archive_bad_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged and whole events through the archive job: every record is in
    the archive, the damaged ones with their raw text and the reason."""
    root = scratch_dir(spark, "archive_bad_rows")
    transport = FileTransport(f"{root}/topics")
    transport.write_batch(_damaged(_read(spark, sf_dir, "events")))
    cfg = JobConfig(app_name="events_app", bucket=root, inputs=[EVENTS], run_id=RUN)
    archive_job(spark, cfg, EVENTS, transport, bounded=True).awaitTermination()
    kept = T.StructType([T.StructField("_key", T.StringType()), *to_struct(EVENTS_SCHEMA).fields,
                         T.StructField(REASON, T.StringType()), T.StructField(CORRUPT, T.StringType())])
    rows = _read_or_empty(spark, folder_location(archive_base(cfg), cfg.app_name, "events"), kept)
    return rows.withColumnRenamed("_key", "key")


def json_files_failfast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as JSON lines, read as a batch; a bad line would fail."""
    path = f"{scratch_dir(spark, 'json_files_failfast')}/events"
    _read(spark, sf_dir, "events").write.options(**JSON_OPTIONS).json(path)
    return read_json_lines(spark, path, EVENTS_SCHEMA)


def json_files_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as JSON lines into a topic folder, streamed back."""
    root = scratch_dir(spark, "json_files_stream")
    base, app = f"{root}/dev", "events_app"
    (_read(spark, sf_dir, "events").write.options(**JSON_OPTIONS)
     .json(folder_location(base, app, "events")))
    [stream] = json_line_streams(spark, base, app, [EVENTS], "7d")
    return _run_to_table(spark, stream, root)


# ---------------------------------------------------------- archive, replay

def _archived(spark: SparkSession, sf_dir: str, label: str) -> tuple[JobConfig, str]:
    root = scratch_dir(spark, label)
    transport = _events_topic(spark, sf_dir, root)
    cfg = JobConfig(app_name="events_app", bucket=root, inputs=[EVENTS], run_id=RUN)
    archive_job(spark, cfg, EVENTS, transport, bounded=True).awaitTermination()
    return cfg, root


def stream_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events topic -> archive job (identity) -> Parquet archive, read back."""
    cfg, _ = _archived(spark, sf_dir, "stream_identity")
    path = folder_location(archive_base(cfg), cfg.app_name, "events")
    return _read_or_empty(spark, path, to_struct(EVENTS_SCHEMA))


def _totals_by_type(dfs: list[DataFrame]) -> DataFrame:
    return dfs[0].groupBy("event_type").agg(
        F.sum(F.col("value").cast("decimal(18,2)")).alias("total_value"),
        F.count(F.lit(1)).alias("n_events"))


TOTALS_TABLE = TableSpec(["event_type"], [
    {"name": "event_type", "type": "string"},
    {"name": "total_value", "type": "decimal(28,2)"},
    {"name": "n_events", "type": "long"},
])


def archive_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive the events topic, replay the archive through a totals-per-type
    function in update mode into the feature table, read the latest rows."""
    cfg, _ = _archived(spark, sf_dir, "archive_replay")
    rcfg = replace(cfg, run_id="replay0", output=OutputSpec("update"), table=TOTALS_TABLE)
    replay_job(spark, rcfg, _totals_by_type, bounded=True).awaitTermination()
    latest = feature_store(rcfg).latest(spark, VERSION, run_id="replay0")
    return latest.select("event_type", F.col("total_value").cast("double").alias("total_value"),
                         "n_events")


def archive_folded_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive's totals per type, replayed before it is folded, beside the
    folding (half of the batches come after it) and from the folded files."""
    root = scratch_dir(spark, "archive_folded_replay")
    transport = FileTransport(f"{root}/topics", max_files_per_trigger=2)
    ev = _read(spark, sf_dir, "events")
    late = F.coalesce(F.col("event_id") % 2 == 1, F.lit(True))
    cfg = JobConfig(app_name="events_app", bucket=root, inputs=[EVENTS], run_id=RUN, output=OutputSpec("update"), table=TOTALS_TABLE)

    def archive(part: DataFrame) -> None:
        publish(part.repartition(8), transport, "events", ["event_id"])
        archive_job(spark, replace(cfg, output=OutputSpec("append")), EVENTS, transport, bounded=True).awaitTermination()

    def replay(name: str) -> DataFrame:
        # A replay has a checkpoint per code version.
        own = replace(cfg, run_id=name, code_version=PHASES.index(name) + 1)
        replay_job(spark, own, _totals_by_type, bounded=True).awaitTermination()
        latest = feature_store(own).latest(spark, own.code_version, run_id=name)
        return latest.select(F.lit(name).alias("phase"), "event_type", F.col("total_value").cast("double").alias("total_value"), "n_events")

    archive(ev.filter(~late))
    replay("during")
    archive(ev.filter(late))
    before = replay("before")
    fold_archive_job(spark, cfg, "ts")
    during = replay("during")
    fold_archive_job(spark, cfg, "ts", expire=True, ended=[RUN])
    return before.unionByName(during).unionByName(replay("after"))


PHASES = ("before", "during", "after")


def archive_ordered_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events archived in any order, folded by date and replayed in time order
    into counts per user and day, with no tolerance for late rows."""
    root = scratch_dir(spark, "archive_ordered_windows")
    transport = FileTransport(f"{root}/topics", max_files_per_trigger=2)
    publish(_read(spark, sf_dir, "events").repartition(6, F.xxhash64("event_id")), transport, "events", ["event_id"])
    cfg = JobConfig(app_name="events_app", bucket=root, inputs=[EVENTS], run_id=RUN)
    archive_job(spark, cfg, EVENTS, transport, bounded=True).awaitTermination()
    fold_archive_job(spark, cfg, "ts", ended=[RUN])
    rcfg = replace(cfg, run_id="ordered0", output=OutputSpec("update"), table=WINDOW_TABLE)
    ordered_replay_job(spark, rcfg, lambda dfs: windowed_count(dfs[0], ["user_id"], "ts", "1 day", watermark="0 seconds"), "ts",
                       slice_rows=max(1, _read(spark, sf_dir, "events").count() // 4))
    return feature_store(rcfg).latest(spark, VERSION, run_id="ordered0")


# ------------------------------------------------------------------- sinks

def dual_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live job: events topic -> identity -> versioned topic + feature table;
    the rows of each sink."""
    root = scratch_dir(spark, "dual_fanout")
    transport = _events_topic(spark, sf_dir, root)
    cfg = JobConfig(app_name="fanout", bucket=root, inputs=[EVENTS], table=LATEST_EVENT, run_id=RUN)
    live_job(spark, cfg, lambda dfs: dfs[0], transport, bounded=True).awaitTermination()
    store = feature_store(cfg)

    def of(df: DataFrame, sink: str) -> DataFrame:
        return df.select(F.lit(sink).alias("sink"), *[f["name"] for f in EVENTS_SCHEMA])

    topic = transport.read_batch(spark, output_topic(cfg.app_name, cfg.code_version))
    return (of(decode(topic, EVENTS_SCHEMA), "topic")
            .unionByName(of(store.changelog(spark, VERSION), "changelog"))
            .unionByName(of(store.latest(spark, VERSION), "latest")))


class _Failing(FileTransport):
    """A transport that fails once after it has written."""

    def __init__(self, root: str):
        super().__init__(root, max_files_per_trigger=2)
        self.failures = 1

    def write_batch(self, records: DataFrame) -> None:
        super().write_batch(records)
        if self.failures:
            self.failures -= 1
            raise ConnectionError("the topic is not reachable")


def dual_fanout_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live job with an outbox whose topic fails once after it was written; the
    job is started again.  The rows of each sink, the topic's read once each."""
    root = scratch_dir(spark, "dual_fanout_outbox")
    publish(_read(spark, sf_dir, "events").repartition(4), FileTransport(f"{root}/topics"), "events", ["event_id"])
    transport = _Failing(f"{root}/topics")
    cfg = JobConfig(app_name="fanout", bucket=root, inputs=[EVENTS], table=LATEST_EVENT, run_id=RUN)
    try:
        live_job(spark, cfg, lambda dfs: dfs[0], transport, bounded=True, outbox=True).awaitTermination()
    except StreamingQueryException:
        live_job(spark, cfg, lambda dfs: dfs[0], transport, bounded=True, outbox=True).awaitTermination()
    topic = read_published(spark, transport, output_topic(cfg.app_name, cfg.code_version), EVENTS_SCHEMA)
    rows = [topic.withColumn("sink", F.lit("topic")), feature_store(cfg).changelog(spark, VERSION).withColumn("sink", F.lit("table"))]
    return rows[0].unionByName(rows[1].select(*rows[0].columns)).select("sink", *[f["name"] for f in EVENTS_SCHEMA])


def topic_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest row per user published to the app's versioned topic as JSON
    key/value records, then read and decoded again."""
    store = _store_from_table(spark, sf_dir, "events", LATEST_EVENT, "topic_encode")
    topic = output_topic("events_latest", VERSION)
    transport = FileTransport(f"{store.root}/topics")
    transport.write_batch(encode(store.latest(spark, VERSION), ["user_id"], topic))
    return decode(transport.read_batch(spark, topic), EVENTS_SCHEMA, keep=("topic", "key"))


# ------------------------------------------------------------ feature table

LATEST_EVENT = TableSpec(["user_id"], EVENTS_SCHEMA, order_by=["ts", "event_id"])
LATEST_ORDER = TableSpec(["o_custkey"], ORDERS_SCHEMA, order_by=["o_orderdate", "o_orderkey"])


def feature_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest event per user, newest by (ts, event_id)."""
    store = _store_from_table(spark, sf_dir, "events", LATEST_EVENT, "feature_latest")
    return store.latest(spark, VERSION)


def feature_latest_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events arrive in two halves (split at the median time), each as
    several micro-batches of one stream restarted on its checkpoint; the
    table is compacted between the halves.  The latest view must not change."""
    root = scratch_dir(spark, "feature_latest_compacted")
    ev = _read(spark, sf_dir, "events")
    us = epoch_micros(F.col("ts"), ev.schema["ts"].dataType)
    [median] = ev.select(us.alias("_us")).approxQuantile("_us", [0.5], 0.001)
    src = f"{root}/src"
    store = FeatureStore(f"{root}/store", LATEST_EVENT)
    early = F.coalesce(us < F.lit(median), F.lit(True))  # and rows without a time
    for half in (early, ~early):
        ev.filter(half).repartitionByRange(2, "ts").write.mode("append").parquet(src)
        stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", "1").parquet(src)
        run_bounded(stream, store.writer(VERSION, RUN), OutputSpec("append"), f"{root}/checkpoint")
        store.compact(spark, VERSION)
    return store.latest(spark, VERSION)


def feature_latest_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest event per (user, event type)."""
    spec = TableSpec(["user_id", "event_type"], EVENTS_SCHEMA, order_by=["ts", "event_id"])
    store = _store_from_table(spark, sf_dir, "events", spec, "feature_latest_composite")
    return store.latest(spark, VERSION)


def feature_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest order of every customer, read as a full scan of the table."""
    store = _store_from_table(spark, sf_dir, "orders", LATEST_ORDER, "feature_scan")
    return store.scan(spark, VERSION)


def feature_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest order for the customers of one market segment; the request's
    key column is matched to the table's key by position."""
    store = _store_from_table(spark, sf_dir, "orders", LATEST_ORDER, "feature_lookup")
    keys = (_read(spark, sf_dir, "customer")
            .filter(F.col("c_mktsegment") == "BUILDING").select("c_custkey"))
    return store.lookup(spark, VERSION, keys)


def feature_lookup_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest order for the customers of one nation, from a table whose older
    half is folded into a snapshot: only the buckets of the keys are read."""
    root = scratch_dir(spark, "feature_lookup_compacted")
    store = FeatureStore(f"{root}/store", LATEST_ORDER)
    orders = _read(spark, sf_dir, "orders")
    half = F.pmod(F.xxhash64("o_orderkey"), F.lit(2))
    for n in range(2):  # a micro-batch each, of as many files as the scan has tasks
        orders.filter(half == n).write.mode("append").parquet(f"{root}/src")
        stream = spark.readStream.schema(orders.schema).parquet(f"{root}/src")
        run_bounded(stream, store.writer(VERSION, RUN), OutputSpec("append"), f"{root}/checkpoint")
    store.compact(spark, VERSION)
    keys = _read(spark, sf_dir, "customer").filter(F.col("c_nationkey") == 7).select("c_custkey")
    return store.lookup(spark, VERSION, keys)


def feature_lookup_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest order for every customer key and for as many unknown keys
    (negative), which come back with null features."""
    store = _store_from_table(spark, sf_dir, "orders", LATEST_ORDER, "feature_lookup_missing")
    cust = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    keys = cust.unionByName(cust.select((-F.col("k") - 1).alias("k")))
    return store.lookup(spark, VERSION, keys)


def feature_lookup_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest order for a list of keys, given as text: the first customers of
    one nation and market segment, and one unknown key.  A list is for requests
    of a bounded size (``LIST_KEYS``); larger ones are key frames."""
    store = _store_from_table(spark, sf_dir, "orders", LATEST_ORDER, "feature_lookup_list")
    asked = (_read(spark, sf_dir, "customer")
             .filter((F.col("c_mktsegment") == "MACHINERY") & (F.col("c_nationkey") == 3))
             .select("c_custkey").orderBy("c_custkey").limit(LIST_KEYS).collect())
    return store.lookup(spark, VERSION, [(str(r[0]),) for r in asked] + [("-1",)])


#: Keys of the largest list request.
LIST_KEYS = 1_000
EVENT_VALUES = TableSpec(["event_id"], EVENTS_SCHEMA)


def feature_last_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table without ``order_by``: a live run writes all events, a replay of
    the archive then writes purchases again with another value.  Read over
    both runs, the last write of every key wins."""
    cfg, root = _archived(spark, sf_dir, "feature_last_write")
    live = replace(cfg, table=EVENT_VALUES, run_id="live0")
    live_job(spark, live, lambda dfs: dfs[0], FileTransport(f"{root}/topics"), bounded=True).awaitTermination()

    def corrected(dfs: list[DataFrame]) -> DataFrame:
        return dfs[0].filter(F.col("event_type") == "purchase").withColumn("value", -F.col("value"))

    replay_job(spark, replace(live, run_id="replay0"), corrected, bounded=True).awaitTermination()
    return feature_store(live).latest(spark, VERSION)


# ----------------------------------------------------------------- features

def rolling_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with its user's event count over the trailing 7 days."""
    ev = _read(spark, sf_dir, "events")
    counted = trailing_count(ev, ["user_id"], "ts", "7 days", "event_id", out="n_events_7d")
    return counted.select("event_id", "user_id", "ts", "n_events_7d")


def _time_slices(ev: DataFrame, n: int = 4) -> list[DataFrame]:
    """Events in ``n`` parts by time (rows without a time in the first), as
    they would arrive in micro-batches."""
    us = epoch_micros(F.col("ts"), ev.schema["ts"].dataType)
    cuts = ev.select(us.alias("_us")).approxQuantile("_us", [k / n for k in range(1, n)], 0.001)
    part = sum(((us >= F.lit(c)).cast("int") for c in cuts), F.lit(0))
    part = F.coalesce(part, F.lit(0))
    return [ev.filter(part == k) for k in range(n)]


WINDOW_TABLE = TableSpec(["window_start", "user_id"], [
    {"name": "window_start", "type": "timestamp_ntz"},
    {"name": "window_end", "type": "timestamp_ntz"},
    {"name": "user_id", "type": "long"},
    {"name": "n_events", "type": "long"},
])


def windowed_count_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per user and UTC day, kept by a streaming aggregation in update
    mode and folded into the feature table; the events arrive in four parts,
    each a micro-batch of the stream restarted on its checkpoint."""
    root = scratch_dir(spark, "windowed_count_stream")
    store = FeatureStore(f"{root}/store", WINDOW_TABLE)
    ev = _read(spark, sf_dir, "events")
    for part in _time_slices(ev):
        part.write.mode("append").parquet(f"{root}/src")
        stream = spark.readStream.schema(ev.schema).parquet(f"{root}/src")
        counts = windowed_count(stream, ["user_id"], "ts", "1 day", watermark="1 day")
        # Update mode emits each change as it happens; the watermark-only batch
        # after the data would only drop expired state.
        run_bounded(counts, store.writer(VERSION, RUN), OutputSpec("update"), f"{root}/checkpoint",
                    final_no_data_batch=False)
    return store.latest(spark, VERSION, run_id=RUN)


TRAILING_TABLE = TableSpec(["event_id"], [
    {"name": "event_id", "type": "long"},
    {"name": "user_id", "type": "long"},
    {"name": "ts", "type": "timestamp_ntz"},
    {"name": "n_events_7d", "type": "long"},
], order_by=["n_events_7d"])


def rolling_count_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with its user's event count over the trailing 7 days, kept
    live: the events arrive in four parts, each a micro-batch of a stateful
    stream restarted on its checkpoint."""
    root = scratch_dir(spark, "rolling_count_stream")
    store = FeatureStore(f"{root}/store", TRAILING_TABLE)
    ev = _read(spark, sf_dir, "events")
    for part in _time_slices(ev):
        part.write.mode("append").parquet(f"{root}/src")
        stream = spark.readStream.schema(ev.schema).parquet(f"{root}/src")
        counts = stream_trailing_count(stream, ["user_id"], "ts", "7 days", "event_id", watermark="1 day", out="n_events_7d")
        run_bounded(counts, store.writer(VERSION, RUN), OutputSpec("update"), f"{root}/checkpoint",
                    final_no_data_batch=False, settings=STATE_SETTINGS)
    return store.latest(spark, VERSION, run_id=RUN)


def late_rows_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per user and day where the newest ten days arrive first: what the
    aggregation counted, and what came too late for it and was kept aside."""
    root = scratch_dir(spark, "late_rows_stream")
    store = FeatureStore(f"{root}/store", WINDOW_TABLE)
    ev = _read(spark, sf_dir, "events")
    newest = F.date_trunc("day", F.lit(ev.agg(F.max("ts")).first()[0]).cast("timestamp_ntz")) - F.expr("INTERVAL 9 DAYS")
    recent = F.coalesce(F.col("ts") >= newest, F.lit(True))

    def write_late(batch_df: DataFrame, batch_id: int) -> None:
        write_batch_folder(batch_df, f"{root}/late", {"run_id": RUN, "batch_id": batch_id})

    for part in (ev.filter(recent), ev.filter(~recent)):
        part.write.mode("append").parquet(f"{root}/src")
        stream = spark.readStream.schema(ev.schema).parquet(f"{root}/src")
        both, write = late_split(
            stream, lambda df: windowed_count(df, ["user_id"], "ts", "1 day", watermark="1 day"), "ts", "1 day", "1 day",
            f"{root}/watermarks", store.writer(VERSION, RUN), write_late)
        run_bounded(both, write, OutputSpec("update"), f"{root}/checkpoint")
    late_schema = T.StructType([*ev.schema.fields, T.StructField(CLOSED, T.LongType())])
    late = _read_or_empty(spark, f"{root}/late", late_schema).groupBy(
        to_wall_clock(F.timestamp_micros(CLOSED)).alias("window_start"), "user_id").agg(F.count(F.lit(1)).alias("n_late"))
    counted = store.latest(spark, VERSION, run_id=RUN).select("window_start", "user_id", F.col("n_events").alias("n_counted"))
    rows = counted.withColumn("n_late", F.lit(0).cast("long")).unionByName(late.withColumn("n_counted", F.lit(0).cast("long")))
    return rows.groupBy("window_start", "user_id").agg(F.sum("n_counted").alias("n_counted"), F.sum("n_late").alias("n_late"))


INTERACTIONS = ("click", "view")


def multi_input_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two topics (interactions, others) into one function that unions them."""
    root = scratch_dir(spark, "multi_input_union")
    ev = _read(spark, sf_dir, "events")
    inter = F.coalesce(F.col("event_type").isin(*INTERACTIONS), F.lit(False))
    transport = FileTransport(f"{root}/topics")
    publish(ev.filter(inter), transport, "interactions", ["event_id"])
    publish(ev.filter(~inter), transport, "others", ["event_id"])
    inputs = [InputSpec("interactions", EVENTS_SCHEMA), InputSpec("others", EVENTS_SCHEMA)]

    def process(dfs: list[DataFrame]) -> DataFrame:
        return (dfs[0].withColumn("source", F.lit("interactions"))
                .unionByName(dfs[1].withColumn("source", F.lit("others"))))

    return _run_to_table(spark, read_topics(spark, inputs, transport, process), root)


def multi_input_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two topics (signups, purchases) into a stream-stream interval join:
    purchases within one day after a signup of the same user.  The records
    arrive in four parts, each a micro-batch of the stream restarted on its
    checkpoint, so pairs meet through the join's state."""
    root = scratch_dir(spark, "multi_input_join")
    ev = _read(spark, sf_dir, "events")
    transport = FileTransport(f"{root}/topics")
    inputs = [InputSpec("signups", EVENTS_SCHEMA), InputSpec("purchases", EVENTS_SCHEMA)]

    def process(dfs: list[DataFrame]) -> DataFrame:
        s = dfs[0].select("user_id", F.col("event_id").alias("signup_id"),
                          F.col("ts").alias("signup_ts"))
        p = dfs[1].select("user_id", F.col("event_id").alias("purchase_id"),
                          F.col("ts").alias("purchase_ts"))
        return interval_join(s, p, ["user_id"], "signup_ts", "purchase_ts",
                             lower="0 seconds", upper="1 day", watermark="1 day")

    for part in _time_slices(ev):
        publish(part.filter(F.col("event_type") == "signup"), transport, "signups", ["event_id"])
        publish(part.filter(F.col("event_type") == "purchase"), transport, "purchases", ["event_id"])
        # An inner join emits nothing on the watermark-only batch after the data.
        joined = _run_to_table(spark, read_topics(spark, inputs, transport, process), root,
                               final_no_data_batch=False)
    return joined


# ------------------------------------------------------- registry, status

ORG = "acme"


def _schema_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as schema registrations: app = customer, one request per order."""
    o = _read(spark, sf_dir, "orders")
    fields = F.array(
        F.struct(F.lit("o_orderkey").alias("name"), F.lit("long").alias("type")),
        F.struct(F.lit("o_orderstatus").alias("name"), F.lit("string").alias("type")),
        F.struct(F.concat(F.lit("priority_"), F.substring("o_orderpriority", 1, 1)).alias("name"),
                 F.lit("string").alias("type")))
    return o.select(F.lit(ORG).alias("org"), F.col("o_custkey").cast("string").alias("app"),
                    F.col("o_orderkey").alias("request_id"),
                    F.col("o_orderdate").alias("requested_at"),
                    F.array(F.lit("o_orderkey")).alias("primary_keys"), fields.alias("fields"))


def registry_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every request gets the next code version of its app.  The requests come
    in two waves (by time), so the second continues a history."""
    root = scratch_dir(spark, "registry_assign")
    requests = _schema_requests(spark, sf_dir)
    us = epoch_micros(F.col("requested_at"), requests.schema["requested_at"].dataType)
    [median] = requests.select(us.alias("_us")).approxQuantile("_us", [0.5], 0.001)
    early = F.coalesce(us < F.lit(median), F.lit(True))
    written = register(spark, f"{root}/registry", requests.filter(early)).unionByName(
        register(spark, f"{root}/registry", requests.filter(~early)))
    return written.select("org", "app", "request_id", "code_version", "avro_schema")


def registry_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current version of every customer's app and of as many unknown apps (0),
    from the summary of a folded history."""
    root = scratch_dir(spark, "registry_current")
    register(spark, f"{root}/registry", _schema_requests(spark, sf_dir))
    fold_history(spark, f"{root}/registry")
    cust = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    keys = cust.unionByName(cust.select((-F.col("k") - 1).alias("k")))
    apps = keys.select(F.lit(ORG).alias("org"), F.col("k").cast("string").alias("app"))
    return current_for(read_current(spark, f"{root}/registry"), apps)


STATES = {"F": "COMPLETED", "O": "RUNNING", "P": "SUBMITTED"}
STAMP = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def job_status_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders packed as nested JSON status documents, then flattened."""
    o = _read(spark, sf_dir, "orders")
    state = F.coalesce(*[F.when(F.col("o_orderstatus") == k, F.lit(v)) for k, v in STATES.items()])
    doc = F.struct(
        F.struct(F.date_format("o_orderdate", STAMP).alias("creationTimestamp"),
                 F.struct(F.concat(F.lit("app_"), F.col("o_custkey").cast("string")).alias("app"))
                 .alias("labels"),
                 F.concat(F.lit("spark_"), F.col("o_orderkey").cast("string")).alias("name"))
        .alias("metadata"),
        F.struct(F.struct(state.alias("state")).alias("applicationState"),
                 F.col("o_orderkey").alias("sparkApplicationId"),
                 F.date_format(F.col("o_orderdate") + F.expr("INTERVAL 1 HOUR"), STAMP)
                 .alias("lastSubmissionAttemptTime"),
                 F.when(F.col("o_orderstatus") == "F",
                        F.date_format(F.col("o_orderdate") + F.expr("INTERVAL 1 DAY"), STAMP))
                 .alias("terminationTime"),
                 F.substring("o_orderpriority", 1, 1).cast("long").alias("executionAttempts"),
                 F.lit(1).cast("long").alias("submissionAttempts"))
        .alias("status"))
    texts = o.select(F.to_json(doc).alias("document"))
    return parse_status(texts)


def assertion_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers against a faulty copy: automobile names lower-cased,
    negative balances dropped, machinery rows duplicated, keys as text (the
    same values) and nation keys with a fraction in one segment."""
    expected = _read(spark, sf_dir, "customer")
    kept = expected.filter(F.col("c_acctbal") >= 0)
    faulty = kept.withColumn("c_name", F.when(F.col("c_mktsegment") == "AUTOMOBILE",
                                              F.lower("c_name")).otherwise(F.col("c_name")))
    actual = faulty.unionByName(kept.filter(F.col("c_mktsegment") == "MACHINERY"))
    nation = F.col("c_nationkey").cast("double")
    actual = actual.withColumns({
        "c_custkey": F.col("c_custkey").cast("string"),
        "c_nationkey": F.when(F.col("c_mktsegment") == "FURNITURE", nation + 0.5).otherwise(nation)})
    return compare_rows(actual, expected)


def assertion_report_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers against a copy whose balances are a little off, within the
    tolerance; in one segment by more, and one nation's rows are twice there."""
    expected = _read(spark, sf_dir, "customer")
    off = (F.col("c_custkey") % 3 - 1) * 1e-7
    balance = F.when(F.col("c_mktsegment") == "AUTOMOBILE", F.col("c_acctbal") + 0.25).otherwise(F.col("c_acctbal") + off)
    actual = expected.withColumn("c_acctbal", balance)
    report = compare_rows(actual.unionByName(expected.filter(F.col("c_nationkey") == 3)), expected, tolerance=1e-6)
    # The surplus of a nation's rows is either of two values within the tolerance.
    return report.withColumns({"c_acctbal": F.round("c_acctbal", 2), "differs": F.array_join("differs", ",")})


REGISTRY = {
    "topic_decode": topic_decode,
    "topic_decode_bad_rows": topic_decode_bad_rows,
    "json_files_stream": json_files_stream,
    "json_files_failfast": json_files_failfast,
    "archive_bad_rows": archive_bad_rows,
    "stream_identity": stream_identity,
    "archive_replay": archive_replay,
    "archive_folded_replay": archive_folded_replay,
    "archive_ordered_windows": archive_ordered_windows,
    "dual_fanout": dual_fanout,
    "dual_fanout_outbox": dual_fanout_outbox,
    "topic_encode": topic_encode,
    "feature_latest": feature_latest,
    "feature_latest_composite": feature_latest_composite,
    "feature_latest_compacted": feature_latest_compacted,
    "feature_scan": feature_scan,
    "feature_lookup": feature_lookup,
    "feature_lookup_compacted": feature_lookup_compacted,
    "feature_lookup_missing": feature_lookup_missing,
    "feature_lookup_list": feature_lookup_list,
    "feature_last_write": feature_last_write,
    "rolling_count": rolling_count,
    "rolling_count_stream": rolling_count_stream,
    "windowed_count_stream": windowed_count_stream,
    "late_rows_stream": late_rows_stream,
    "multi_input_union": multi_input_union,
    "multi_input_join": multi_input_join,
    "registry_assign": registry_assign,
    "registry_current": registry_current,
    "job_status_project": job_status_project,
    "assertion_report": assertion_report,
    "assertion_report_tolerance": assertion_report_tolerance,
}

"""End-to-end jobs composed from sources, the user's ``process`` and sinks.

* live:    topics -> process -> publish to the versioned topic + feature table
* archive: one topic -> identity -> Parquet archive
* quarantine: one topic -> records that do not decode -> Parquet
* replay:  archive files -> process -> feature table (publishing optional)
* fold:    archive batches -> files by date (scheduled maintenance)
* dev:     JSON-lines folders -> process -> console
* fixture: JSON-lines folders -> process -> expected rows + inputs with samples
* check:   inline samples -> process -> compared with the expected rows
* compact: feature table changelog -> snapshot (scheduled maintenance)
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Collection
from dataclasses import replace
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from featureflow.config import InputSpec, JobConfig, OutputSpec
from featureflow.functions.codec import BAD, CORRUPT, JSON_OPTIONS, REASON, output_topic
from featureflow.functions.schema import conform
from featureflow.operators.archive import TIME, Manifest, TopicArchive
from featureflow.operators.checks import assert_rows, compare_rows, expected_frame
from featureflow.operators.store import FeatureStore
from featureflow.session import create_marker, ensure_dir, read_marker, scratch_dir
from featureflow.sources.files import (
    folder_location,
    json_frame,
    json_line_streams,
    sample_frame,
)
from featureflow.sources.topics import read_topic_checked, read_topics
from featureflow.streaming.outbox import outbox_writer
from featureflow.streaming.runner import BatchWriter, checkpoint_path, claim_run, run_bounded, start_stream
from featureflow.streaming.sinks import (
    archive_writer,
    fan_out,
    run_console,
    topic_writer,
)

Process = Callable[[list[DataFrame]], DataFrame]


def identity(dfs: list[DataFrame]) -> DataFrame:
    return dfs[0]


def feature_store(cfg: JobConfig) -> FeatureStore:
    """The app's feature table, keyed by organization and app."""
    if cfg.table is None:
        raise ValueError("the job config has no table")
    return FeatureStore(f"{cfg.bucket.rstrip('/')}/features/{cfg.org}/{cfg.app_name}", cfg.table)


def archive_base(cfg: JobConfig) -> str:
    return f"{cfg.bucket.rstrip('/')}/archive"


def _runs_root(cfg: JobConfig, kind: str) -> str:
    return f"{cfg.bucket.rstrip('/')}/runs/{cfg.org}/{cfg.app_name}/{kind}"


def live_job(spark: SparkSession, cfg: JobConfig, process: Process, transport,
             bounded: bool = False, drop_bad: bool = True, outbox: bool = False) -> StreamingQuery:
    """Topics -> process -> (versioned output topic, feature table).

    Each micro-batch is cached once and written to both sinks; the topic is
    at-least-once, the feature table idempotent per batch id.  With ``outbox``
    the batch is committed to the table and the topic published from there, with
    record ids by which ``outbox.read_published`` drops repeats.  Undecodable
    records do not reach ``process`` (the archive and ``quarantine_job`` keep
    them with their raw text), so they never become rows with null keys;
    ``drop_bad=False`` lets them through as all-null rows.
    """
    df = read_topics(spark, cfg.inputs, transport, process, drop_bad=drop_bad)
    store = feature_store(cfg)
    df = conform(df, store.schema)  # fail at start; both sinks get the declared columns
    topic = output_topic(cfg.app_name, cfg.code_version)
    if outbox:
        write = outbox_writer(store, transport, topic, cfg.code_version, cfg.run_id)
    else:
        write = fan_out(topic_writer(transport, topic, store.keys),
                        store.writer(cfg.code_version, cfg.run_id))
    cp = checkpoint_path(cfg.bucket, cfg.checkpoint_location, cfg.app_name,
                         cfg.code_version, "live")
    claim_run(spark, _runs_root(cfg, f"v{cfg.code_version}"), cfg.run_id, cp)
    return start_stream(df, write, cfg.output, cp, bounded)


def archive_job(spark: SparkSession, cfg: JobConfig, inp: InputSpec, transport,
                bounded: bool = False) -> StreamingQuery:
    """One raw topic, decoded with its schema, appended to its Parquet archive
    with each record's key and time.  Nothing is lost: a record that does not
    decode keeps its raw text and the reason beside its null fields."""
    checked = read_topic_checked(spark, inp, transport)
    df = checked.drop(BAD).withColumnsRenamed({"key": "_key", "timestamp": "_timestamp"})
    cp = checkpoint_path(cfg.bucket, cfg.checkpoint_location, cfg.app_name,
                         cfg.code_version, f"archive-{inp.topic}")
    claim_run(spark, _runs_root(cfg, f"archive-{inp.topic}"), cfg.run_id, cp)
    write = archive_writer(archive_base(cfg), cfg.app_name, inp.topic, cfg.run_id)
    return start_stream(df, write, cfg.output, cp, bounded)


def quarantine_job(spark: SparkSession, cfg: JobConfig, inp: InputSpec, transport,
                   bounded: bool = False) -> StreamingQuery:
    """A topic's records that do not decode (null value, malformed JSON,
    wrong types), with the raw text and the reason, appended per batch to
    ``bucket/quarantine/app/topic``."""
    checked = read_topic_checked(spark, inp, transport)
    bad = checked.filter(F.col(BAD)).select("key", "timestamp", REASON, CORRUPT)
    cp = checkpoint_path(cfg.bucket, cfg.checkpoint_location, cfg.app_name,
                         cfg.code_version, f"quarantine-{inp.topic}")
    claim_run(spark, _runs_root(cfg, f"quarantine-{inp.topic}"), cfg.run_id, cp)
    write = archive_writer(quarantine_base(cfg), cfg.app_name, inp.topic, cfg.run_id)
    return start_stream(bad, write, OutputSpec("append", cfg.output.processing_time), cp, bounded)


def quarantine_base(cfg: JobConfig) -> str:
    return f"{cfg.bucket.rstrip('/')}/quarantine"


def topic_archive(cfg: JobConfig, inp: InputSpec, time_column: str = TIME, **options) -> TopicArchive:
    """The archive of one of the app's topics."""
    return TopicArchive(archive_base(cfg), cfg.app_name, inp, time_column, **options)


def fold_archive_job(spark: SparkSession, cfg: JobConfig, time_column: str = TIME, expire: bool = False,
                     ended: Collection[str] = ()) -> dict[str, int]:
    """Fold the new batches of every topic's archive into files by date; the
    number of each topic's manifest.  Meant to run on a schedule beside archive
    and replay jobs; with ``expire`` it then deletes what no reader needs."""
    done = {}
    for inp in cfg.inputs:
        archive = topic_archive(cfg, inp, time_column)
        done[inp.topic] = archive.compact(spark, ended).number
        if expire:
            archive.expire(spark)
    return done


def _replay_writer(spark: SparkSession, cfg: JobConfig, publish: bool, transport) -> tuple[FeatureStore, BatchWriter]:
    store = feature_store(cfg)
    writers = [store.writer(cfg.code_version, cfg.run_id)]
    if publish:
        if transport is None:
            raise ValueError("publishing a replay needs a transport")
        topic = output_topic(cfg.app_name, cfg.code_version)
        writers.insert(0, topic_writer(transport, topic, store.keys))
    return store, fan_out(*writers)


def _pins(cp: str) -> str:
    """Name by which a replay pins manifests: that of its checkpoint."""
    return hashlib.sha256(cp.encode()).hexdigest()[:24]


def replay_job(spark: SparkSession, cfg: JobConfig, process: Process,
               bounded: bool = True, publish: bool = False, transport=None,
               max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Archived topics -> process -> feature table (and the topic if asked).

    Uses its own checkpoint and run id, so it never overwrites batches of the
    live run in the shared feature table.  It is bound to the manifests that it
    started with (``end_replay`` sets them free), so it may run, stop and go on
    while its archive is folded.
    """
    cp = checkpoint_path(cfg.bucket, cfg.checkpoint_location, cfg.app_name,
                         cfg.code_version, "replay")
    options = {"maxFileAge": cfg.files.max_file_age}
    if max_files_per_trigger:
        options["maxFilesPerTrigger"] = str(max_files_per_trigger)
    archives = [topic_archive(cfg, inp) for inp in cfg.inputs]
    df = process([a.stream(spark, a.pin(spark, _pins(cp)), options) for a in archives])
    store, write = _replay_writer(spark, cfg, publish, transport)
    df = conform(df, store.schema)  # fail at start; both sinks get the declared columns
    claim_run(spark, _runs_root(cfg, f"v{cfg.code_version}"), cfg.run_id, cp)
    return start_stream(df, write, cfg.output, cp, bounded)


def ordered_replay_job(spark: SparkSession, cfg: JobConfig, process: Process, time_column: str = TIME,
                       slice_rows: int = 50_000_000, publish: bool = False, transport=None) -> list[StreamingQuery]:
    """Replay a folded archive in time order on one checkpoint: dates, of which
    as many make a micro-batch as have ``slice_rows`` rows together, and at last
    the batches that are not folded yet.  Whatever the order of files, no row
    is behind the watermark of an earlier slice.  It runs to the end of what the
    archive has; the queries that ran."""
    cp = checkpoint_path(cfg.bucket, cfg.checkpoint_location, cfg.app_name,
                         cfg.code_version, "ordered-replay")
    claim_run(spark, _runs_root(cfg, f"v{cfg.code_version}"), cfg.run_id, cp)
    archives = [topic_archive(cfg, inp, time_column) for inp in cfg.inputs]
    pinned = [a.pin(spark, _pins(cp)) for a in archives]
    rows: dict[str, int] = {}
    for m in pinned:
        for d, held in m.dates.items():
            rows[d] = rows.get(d, 0) + sum(n for _, n in held)
    # The slices of all topics together: the same dates at the same time.
    together = Manifest(dates={d: [("", n)] for d, n in rows.items()})
    store, write = _replay_writer(spark, cfg, publish, transport)
    done = []
    for dates in archives[0].slices(together, slice_rows):
        marker = f"{cp}_slices/{dates[-1]}" if dates else ""
        if marker and read_marker(spark, marker) is not None:
            continue  # done before a restart
        # The first batch of a start takes all files of the slice, also old ones.
        df = process([a.stream_slice(spark, m, dates, {"maxFileAge": "36500d"}) for a, m in zip(archives, pinned)])
        done.append(run_bounded(conform(df, store.schema), write, cfg.output, cp))
        if marker:
            create_marker(spark, marker, cfg.run_id)
    return done


def end_replay(spark: SparkSession, cfg: JobConfig) -> None:
    """Set free the manifests that the app's replays are bound to."""
    for job in ("replay", "ordered-replay"):
        cp = checkpoint_path(cfg.bucket, cfg.checkpoint_location, cfg.app_name, cfg.code_version, job)
        for inp in cfg.inputs:
            topic_archive(cfg, inp).unpin(spark, _pins(cp))


def dev_job(spark: SparkSession, cfg: JobConfig, process: Process, base_folder: str,
            checkpoint: str) -> StreamingQuery:
    """JSON-lines folders ``base/app/topic`` -> process -> console."""
    dfs = json_line_streams(spark, base_folder, cfg.app_name, cfg.inputs, cfg.files.max_file_age)
    return run_console(process(dfs), checkpoint, cfg.output)


def write_fixture(spark: SparkSession, cfg: JobConfig, process: Process,
                  base_folder: str, out: str) -> JobConfig:
    """Run ``process`` over the JSON-lines folders and write its output rows to
    ``out/assertions`` as JSON lines.  Returns the job with these assertions
    and with its inputs' own folders as samples, for ``check_on_samples``."""
    dfs = json_line_streams(spark, base_folder, cfg.app_name, cfg.inputs, cfg.files.max_file_age)
    result = process(dfs)
    mode = cfg.output.mode.lower()

    def write(batch_df: DataFrame, batch_id: int) -> None:
        # In complete mode a batch holds the whole result and replaces it.
        at = 0 if mode == "complete" else batch_id
        batch_df.write.mode("overwrite").options(**JSON_OPTIONS).json(f"{out}/assertions/batch_id={at}")

    run_bounded(result, write, cfg.output, f"{out}/checkpoint")
    inputs = [InputSpec(i.topic, i.topic_schema, folder_location(base_folder, cfg.app_name, i.topic))
              for i in cfg.inputs]
    return replace(cfg, inputs=inputs, assertions=ensure_dir(spark, f"{out}/assertions"))


def build_fixture(spark: SparkSession, cfg: JobConfig, process: Process,
                  base_folder: str, max_rows: int = 10_000) -> dict:
    """``{"assertions": output rows, "inputs": inputs with their rows as
    samples}`` as Python values, for a request body.  A tool for small sample
    files: more than ``max_rows`` rows are refused (use ``write_fixture``)."""
    made = write_fixture(spark, cfg, process, base_folder, scratch_dir(spark, "fixture"))
    dfs = json_line_streams(spark, base_folder, cfg.app_name, cfg.inputs, cfg.files.max_file_age)
    schema = process(dfs).schema

    def read(path: str, schema) -> list[dict]:
        df = json_frame(spark, path, schema)
        text = df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), JSON_OPTIONS))
        found = [json.loads(r[0]) for r in text.limit(max_rows + 1).collect()]
        if len(found) > max_rows:
            raise ValueError(f"more than {max_rows} rows in {path}: use write_fixture")
        return found

    inputs = [InputSpec(i.topic, i.topic_schema, read(i.sample, i.topic_schema)) for i in made.inputs]
    return {"assertions": read(made.assertions, schema), "inputs": inputs}


def sample_output(spark: SparkSession, cfg: JobConfig, process: Process) -> DataFrame:
    """``process`` applied to the inline samples of every input topic."""
    return process([sample_frame(spark, inp) for inp in cfg.inputs])


def check_on_samples(spark: SparkSession, cfg: JobConfig, process: Process,
                     raise_on_diff: bool = True, tolerance: float | None = None) -> DataFrame:
    """Run ``process`` on the samples and compare with ``cfg.assertions``
    typed by the table's output schema (or the output's own schema), floating-point
    values within ``tolerance``.  Returns the difference report (empty when the function is right)."""
    out = sample_output(spark, cfg, process)
    schema = cfg.table.output_schema if cfg.table is not None else out.schema
    expected = expected_frame(spark, cfg.assertions, schema)
    if raise_on_diff:
        assert_rows(out, expected, tolerance=tolerance)
    return compare_rows(out, expected, tolerance)


def compaction_job(spark: SparkSession, cfg: JobConfig, expire: bool = False) -> int:
    """Fold the app's feature table (this code version) into a new snapshot.

    Meant to run on a schedule beside the live job (single writer of
    snapshots); reads then cost keys + batches since the last compaction.
    With ``expire`` it then deletes what no reader can need any more
    (``FeatureStore.expire``).
    """
    store = feature_store(cfg)
    snap_id = store.compact(spark, cfg.code_version)
    if expire:
        store.expire(spark, cfg.code_version)
    return snap_id

"""Running a stream: output mode, trigger, checkpoint, run identity.

Every sink here is a ``foreachBatch`` function ``(batch_df, batch_id)``, so a
micro-batch is written with the batch writers (Parquet, Kafka) and a
re-executed batch id overwrites instead of duplicating.  A writer must compute
the whole batch: for stateful queries (aggregations, joins) that is when the
state of the batch is committed, and Spark checks it.
"""

from __future__ import annotations

import threading
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from featureflow.config import OutputSpec
from featureflow.session import create_marker, read_marker

BatchWriter = Callable[[DataFrame, int], None]

OUTPUT_MODES = ("append", "update", "complete")


def checkpoint_path(bucket: str, checkpoint_location: str, app_name: str,
                    code_version: int, job: str) -> str:
    """One checkpoint per app, code version and job kind (live, replay, ...),
    so live and replay of one app, or two versions, never share state."""
    return f"{bucket.rstrip('/')}/{checkpoint_location}/{app_name}/v{code_version}/{job}"


def validate_output(output: OutputSpec) -> str:
    mode = output.mode.lower()
    if mode not in OUTPUT_MODES:
        raise ValueError(f"output mode must be one of {OUTPUT_MODES}, got {output.mode!r}")
    return mode


NO_DATA_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
_START_LOCK = threading.RLock()


def start_stream(df: DataFrame, write: BatchWriter, output: OutputSpec,
                 checkpoint: str, bounded: bool = False,
                 query_name: str | None = None) -> StreamingQuery:
    """Start ``df`` with ``write`` called once per micro-batch.

    ``bounded=True`` processes what is available now and stops (replays,
    tests); otherwise the trigger interval from ``output`` applies.
    """
    mode = validate_output(output)
    w = (df.writeStream.outputMode(mode)
         .option("checkpointLocation", checkpoint)
         .foreachBatch(write))
    w = w.trigger(availableNow=True) if bounded else w.trigger(processingTime=output.processing_time)
    if query_name:
        w = w.queryName(query_name)
    # Every start takes the lock, so none picks up a setting that another
    # thread holds changed while its own query starts.
    with _START_LOCK:
        try:
            return w.start()
        except AnalysisException as exc:
            raise ValueError(f"stream cannot run in {mode!r} mode: {exc}") from exc


def dropped_rows(query: StreamingQuery) -> int:
    """Rows that the watermark dropped as late, over the recent progress of a
    query (Spark keeps the last 100 batches).  For a whole run add a
    ``streaming.late.DroppedRows`` listener; to keep the rows, ``late_split``."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])


def run_bounded(df: DataFrame, write: BatchWriter, output: OutputSpec,
                checkpoint: str, final_no_data_batch: bool = True,
                settings: dict[str, str] | None = None) -> StreamingQuery:
    """Run over all available input, wait for the end, raise on failure.

    After the last data, Spark runs one more batch to advance the watermark.
    It emits closed windows and outer-join rows; for queries that emit
    nothing on it (inner joins, update mode) ``final_no_data_batch=False``
    skips it.  That and other ``settings`` are applied only while this query
    starts (a query keeps its own copy of the session settings).
    """
    settings = dict(settings or {})
    if not final_no_data_batch:
        settings[NO_DATA_BATCHES] = "false"
    with held_settings(df.sparkSession, settings):
        q = start_stream(df, write, output, checkpoint, bounded=True)
    q.awaitTermination()
    return q


@contextmanager
def held_settings(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Session settings for a query that starts within; no other query of this
    module starts meanwhile."""
    with _START_LOCK:
        before = {k: spark.conf.get(k, None) for k in settings}
        try:
            for k, v in settings.items():
                spark.conf.set(k, v)
            yield
        finally:
            for k, v in before.items():
                if v is None:
                    spark.conf.unset(k)
                else:
                    spark.conf.set(k, v)


def claim_run(spark: SparkSession, runs_root: str, run_id: str, checkpoint: str) -> None:
    """Tie ``run_id`` to ``checkpoint`` for good.

    Each run counts batch ids from 0, and sinks are partitioned by run id, so
    a run id may only ever belong to one checkpoint: reusing it with a new
    checkpoint would overwrite the earlier run's batches.  Resuming the same
    checkpoint with the same run id is allowed.  The two markers are created
    with create-if-absent, so two jobs racing for one run id cannot both win.
    """
    by_run = f"{runs_root.rstrip('/')}/run_id={run_id}"
    by_checkpoint = f"{checkpoint.rstrip('/')}_run"
    owner = read_marker(spark, by_checkpoint)
    if owner is not None and owner != run_id:
        raise ValueError(f"checkpoint {checkpoint} belongs to run {owner!r}")
    create_marker(spark, by_run, checkpoint)
    known = read_marker(spark, by_run)
    if known != checkpoint:
        raise ValueError(f"run id {run_id!r} already belongs to checkpoint {known}")
    create_marker(spark, by_checkpoint, run_id)
    owner = read_marker(spark, by_checkpoint)
    if owner != run_id:
        raise ValueError(f"checkpoint {checkpoint} belongs to run {owner!r}")

"""Micro-batch sinks: fan-out, topic archive, topic publish, console, memory."""

from __future__ import annotations

import re
import uuid
from typing import Sequence

from pyspark.sql import DataFrame

from featureflow.config import OutputSpec
from featureflow.functions.codec import encode
from featureflow.sources.files import folder_location
from featureflow.streaming.runner import BatchWriter, validate_output


def fan_out(*writers: BatchWriter) -> BatchWriter:
    """Cache one micro-batch and hand it to several writers in order.

    The batch is computed once; it is always released afterwards, also when a
    writer fails.  Writers get the batch id so they can be idempotent.
    """
    def write(batch_df: DataFrame, batch_id: int) -> None:
        batch_df.persist()
        try:
            for w in writers:
                w(batch_df, batch_id)
        finally:
            batch_df.unpersist()
    return write


_PARTITION_VALUE = re.compile(r"^[A-Za-z0-9][A-Za-z0-9._-]*$")


def write_batch_folder(df: DataFrame, path: str, partition: dict[str, str | int], file_rows: int | None = None) -> None:
    """Replace one partition folder ``path/name=value/...`` by the rows of
    ``df``: writing the same batch again replaces it instead of adding rows,
    and writing no rows empties it.  ``file_rows`` bounds the rows of a file."""
    bad = [v for v in partition.values() if not _PARTITION_VALUE.match(str(v))]
    if bad:
        raise ValueError(f"{bad} cannot name a folder: use letters, digits, '.', '_' and '-'")
    folder = "/".join([path.rstrip("/"), *(f"{k}={v}" for k, v in partition.items())])
    writer = df.drop(*partition).write.mode("overwrite")
    (writer.option("maxRecordsPerFile", file_rows) if file_rows else writer).parquet(folder)


def archive_writer(base: str, app_name: str, topic: str, run_id: str) -> BatchWriter:
    """Append a raw topic to its Parquet archive, one partition per batch."""
    path = folder_location(base, app_name, topic)

    def write(batch_df: DataFrame, batch_id: int) -> None:
        write_batch_folder(batch_df, path, {"run_id": run_id, "batch_id": batch_id})
    return write


def topic_writer(transport, topic: str, key_cols: Sequence[str]) -> BatchWriter:
    """Publish each batch to ``topic``: JSON key from the primary keys, JSON
    value from all columns.  At-least-once, like the transport."""
    def write(batch_df: DataFrame, batch_id: int) -> None:
        transport.write_batch(encode(batch_df, key_cols, topic))
    return write


def console_writer(num_rows: int = 20) -> BatchWriter:
    """Show each micro-batch (development).

    The whole batch is computed first: ``show`` alone reads only a few
    partitions, and a stateful query must run every partition of a batch
    for its state to be committed."""
    def write(batch_df: DataFrame, batch_id: int) -> None:
        batch_df.persist()
        try:
            n = batch_df.count()
            print(f"-------- batch {batch_id}: {n} rows --------")
            batch_df.show(num_rows, truncate=False)
        finally:
            batch_df.unpersist()
    return write


def run_console(df: DataFrame, checkpoint: str, output: OutputSpec = OutputSpec()):
    """Stream to the console sink (development runs)."""
    return (df.writeStream.format("console").outputMode(validate_output(output))
            .option("checkpointLocation", checkpoint).option("truncate", "false")
            .trigger(processingTime=output.processing_time).start())


def collect_to_memory(df: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream to the end of its input into a memory table and return it
    as a batch frame.  For fixtures and tests only: the memory sink lives on
    the driver."""
    name = f"featureflow_{uuid.uuid4().hex}"  # always a valid identifier
    q = (df.writeStream.format("memory").queryName(name).outputMode(mode)
         .trigger(availableNow=True).start())
    try:
        q.awaitTermination()
    finally:
        q.stop()
    return df.sparkSession.table(name)

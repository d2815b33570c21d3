"""One commit for two sinks: the feature table and the topic published from it.

A live job that writes a topic and a table may fail between the two, and its
batch then runs again: the topic would get its rows twice.  Here a batch is
committed once, to the feature table; what the topic gets is read from that
committed folder, never from a batch that runs again, so both have the same rows
even if the function gives other rows the second time.  A marker says that a
batch is committed, another one that it is published; a batch that runs again
does what its markers say is left.  Batches are published in order.

Between the last record and the marker a failure still repeats records.  Each one
carries an id, made of run, batch, file and row, which is the same when the
folder is published again; ``read_published`` drops repeats by it, on a stream
within a watermark, so that state stays bounded.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featureflow.functions.codec import decode, encode
from featureflow.functions.schema import quote, to_struct
from featureflow.operators.store import FeatureStore
from featureflow.session import create_marker, read_marker
from featureflow.streaming.runner import BatchWriter

RECORD_ID = "_record_id"


def outbox_writer(store: FeatureStore, transport, topic: str, code_version: int, run_id: str) -> BatchWriter:
    """``foreachBatch`` writer: commit the batch to the table, then publish it."""
    root = f"{store.root}/outbox/code_version={code_version}/run_id={run_id}"

    def write(batch_df: DataFrame, batch_id: int) -> None:
        spark = batch_df.sparkSession
        if read_marker(spark, f"{root}/committed/{batch_id}") is None:
            store.write_batch(batch_df, code_version, run_id, batch_id)
            create_marker(spark, f"{root}/committed/{batch_id}", "")
        else:
            # Committed by an earlier attempt; a stateful query must still
            # compute its batch for its state to be committed.
            batch_df.write.format("noop").mode("overwrite").save()
        if read_marker(spark, f"{root}/published/{batch_id}") is None:
            rows = committed_rows(spark, store, code_version, run_id, batch_id)
            transport.write_batch(encode(rows, store.keys, topic))
            create_marker(spark, f"{root}/published/{batch_id}", "")
    return write


def committed_rows(spark: SparkSession, store: FeatureStore, code_version: int, run_id: str, batch_id: int) -> DataFrame:
    """Rows of one committed batch with their ids."""
    folder = f"{store.changelog_path}/code_version={code_version}/run_id={run_id}/batch_id={batch_id}"
    rows = spark.read.schema(store.schema).parquet(folder)
    name = F.concat_ws("/", F.lit(run_id), F.lit(batch_id), F.col("_metadata.file_name"), F.col("_metadata.row_index"))
    return rows.select(*(F.col(quote(c)) for c in store.schema.fieldNames()), F.sha1(name.cast("binary")).alias(RECORD_ID))


def read_published(spark: SparkSession, transport, topic: str, schema: Any, streaming: bool = False,
                   watermark: str = "1 day") -> DataFrame:
    """Decoded rows of a topic that an outbox publishes, each once."""
    struct = to_struct(schema)
    with_id = T.StructType([*struct.fields, T.StructField(RECORD_ID, T.StringType())])
    raw = transport.read_stream(spark, topic) if streaming else transport.read_batch(spark, topic)
    rows = decode(raw, with_id, keep=("timestamp",))
    if streaming:
        once = rows.withWatermark("timestamp", watermark).dropDuplicatesWithinWatermark([RECORD_ID])
    else:
        once = rows.dropDuplicates([RECORD_ID])
    return once.select(*(F.col(quote(c)) for c in struct.fieldNames()))

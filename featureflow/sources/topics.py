"""Topic transports and the multi-topic source.

A transport moves raw records ``(topic, key, value, timestamp)``; the codec
turns them into typed rows.  ``KafkaTransport`` is the production transport;
``FileTransport`` keeps the same columns in Parquet folders, for development,
tests and offline runs.
"""

from __future__ import annotations

from typing import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featureflow.config import InputSpec, KafkaSpec
from featureflow.functions.codec import decode, decode_checked, encode, split_bad
from featureflow.session import ensure_dir

RAW_SCHEMA = "key string, value string, timestamp timestamp"

Process = Callable[[list[DataFrame]], DataFrame]


def kafka_options(kafka: KafkaSpec) -> dict[str, str]:
    """Connection options; SASL/PLAIN over TLS when a key and secret are given."""
    opts = {"kafka.bootstrap.servers": kafka.brokers}
    if kafka.confluent_api_key and kafka.confluent_secret:
        user = kafka.confluent_api_key.replace('"', '\\"')
        secret = kafka.confluent_secret.replace('"', '\\"')
        opts.update({
            "kafka.security.protocol": "SASL_SSL",
            "kafka.sasl.mechanism": "PLAIN",
            "kafka.sasl.jaas.config": (
                "org.apache.kafka.common.security.plain.PlainLoginModule required "
                f'username="{user}" password="{secret}";'
            ),
        })
    return opts


def kafka_source_options(kafka: KafkaSpec, topic: str, starting_offsets: str = "latest",
                         max_offsets_per_trigger: int | None = None) -> dict[str, str]:
    """Options of one topic subscription.  ``max_offsets_per_trigger`` bounds
    a micro-batch, so catching up after downtime runs as many sized batches
    instead of one huge one."""
    opts = {**kafka_options(kafka), "subscribe": topic, "startingOffsets": starting_offsets}
    if max_offsets_per_trigger:
        opts["maxOffsetsPerTrigger"] = str(max_offsets_per_trigger)
    return opts


class KafkaTransport:
    """Topics on a Kafka cluster (needs the Spark Kafka connector)."""

    def __init__(self, kafka: KafkaSpec, starting_offsets: str = "latest",
                 max_offsets_per_trigger: int | None = None):
        self.kafka = kafka
        self.starting_offsets = starting_offsets
        self.max_offsets_per_trigger = max_offsets_per_trigger

    def read_stream(self, spark: SparkSession, topic: str) -> DataFrame:
        raw = (spark.readStream.format("kafka")
               .options(**kafka_source_options(self.kafka, topic, self.starting_offsets,
                                               self.max_offsets_per_trigger))
               .load())
        return raw.select(
            F.col("topic"), F.col("key").cast("string").alias("key"),
            F.col("value").cast("string").alias("value"), F.col("timestamp"))

    def write_batch(self, records: DataFrame) -> None:
        """Write ``(topic, key, value)`` rows; at-least-once, like any Kafka sink."""
        records.write.format("kafka").options(**kafka_options(self.kafka)).save()


class FileTransport:
    """Topics as Parquet folders ``root/topic=<name>/`` with the raw columns."""

    def __init__(self, root: str, max_files_per_trigger: int | None = None):
        self.root = root.rstrip("/")
        self.max_files_per_trigger = max_files_per_trigger

    def folder(self, topic: str) -> str:
        return f"{self.root}/topic={topic}"

    def read_stream(self, spark: SparkSession, topic: str) -> DataFrame:
        reader = spark.readStream.schema(RAW_SCHEMA)
        if self.max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", str(self.max_files_per_trigger))
        raw = reader.parquet(ensure_dir(spark, self.folder(topic)))
        return raw.select(F.lit(topic).alias("topic"), "key", "value", "timestamp")

    def read_batch(self, spark: SparkSession, topic: str) -> DataFrame:
        raw = spark.read.schema(RAW_SCHEMA).parquet(self.folder(topic))
        return raw.select(F.lit(topic).alias("topic"), "key", "value", "timestamp")

    def write_batch(self, records: DataFrame) -> None:
        """Append ``(topic, key, value)`` rows, one folder per topic."""
        (records.withColumn("timestamp", F.current_timestamp())
         .select("topic", "key", "value", "timestamp")
         .write.mode("append").partitionBy("topic").parquet(self.root))


def publish(df: DataFrame, transport, topic: str, key_cols: Sequence[str]) -> None:
    """Encode typed rows and write them to ``topic`` (SNK-3 codec + transport)."""
    transport.write_batch(encode(df, key_cols, topic))


def read_topics(spark: SparkSession, inputs: Sequence[InputSpec], transport,
                process: Process | None = None, drop_bad: bool = False):
    """Subscribe to every input topic, decode each with its own schema and
    hand the list, in input order, to ``process``.  Without ``process`` the
    decoded list itself is returned.  With ``drop_bad`` records that do not
    decode (see ``quarantine_job``) are left out instead of arriving as
    all-null rows."""
    if drop_bad:
        dfs = [split_bad(decode_checked(transport.read_stream(spark, i.topic),
                                        i.topic_schema))[0] for i in inputs]
    else:
        dfs = [decode(transport.read_stream(spark, i.topic), i.topic_schema) for i in inputs]
    return process(dfs) if process is not None else dfs


def read_topic_checked(spark: SparkSession, inp: InputSpec, transport) -> DataFrame:
    """One topic decoded with bad-record flags (see codec.decode_checked)."""
    return decode_checked(transport.read_stream(spark, inp.topic), inp.topic_schema,
                          keep=("key", "timestamp"))

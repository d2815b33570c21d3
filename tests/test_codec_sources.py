from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from featureflow.config import InputSpec, KafkaSpec
from featureflow.functions.codec import (
    BAD,
    REASON,
    decode,
    decode_checked,
    encode,
    output_topic,
    split_bad,
)
from featureflow.plans.tables import EVENTS_SCHEMA, table_path
from featureflow.sources.files import read_json_lines, sample_frame, table_stream
from featureflow.sources.topics import (
    FileTransport,
    kafka_options,
    kafka_source_options,
    publish,
    read_topics,
)
from featureflow.streaming.sinks import collect_to_memory

from conftest import SF01, rows


def test_round_trip_is_exact(spark):
    """Encode then decode gives back every event unchanged (µs timestamps)."""
    ev = spark.read.parquet(table_path(SF01, "events"))
    back = decode(encode(ev, ["event_id"], "t"), EVENTS_SCHEMA)
    assert back.exceptAll(ev).count() == 0
    assert ev.exceptAll(back).count() == 0


def test_encode_key_and_topic(spark):
    df = spark.createDataFrame([(1, "a", "x")], "k1 long, k2 string, v string")
    rec = encode(df, ["k1", "k2"], output_topic("app", 3)).first()
    assert rec.topic == "app_v3"
    assert json.loads(rec.key) == {"k1": 1, "k2": "a"}
    assert json.loads(rec.value) == {"k1": 1, "k2": "a", "v": "x"}


def test_quarantine(spark):
    schema = [{"name": "a", "type": "long"}, {"name": "b", "type": "string"}]
    raw = spark.createDataFrame(
        [("1", '{"a": 1, "b": "x"}'), ("2", '{"a": 2, "b"'), ("3", '{"a": "zz", "b": "y"}'),
         ("4", None), ("5", '{"b": "only b"}'), ("6", "[1, 2]")],
        "key string, value string")
    out = decode_checked(raw, schema, keep=("key",))
    got = {r.key: r for r in out.collect()}
    assert got["1"][BAD] is False and got["1"].a == 1
    assert got["2"][BAD] and got["2"][REASON] == "malformed" and got["2"].a is None
    assert got["3"][BAD] and got["3"].b is None
    assert got["4"][BAD] and got["4"][REASON] == "null value"
    assert got["5"][BAD] is False and got["5"].a is None and got["5"].b == "only b"
    assert got["6"][BAD]
    good, bad = split_bad(out)
    assert good.count() == 2 and bad.count() == 4
    assert good.columns == ["key", "a", "b"]


def test_kafka_options_plain_and_sasl():
    assert kafka_options(KafkaSpec("broker1,broker2")) == {
        "kafka.bootstrap.servers": "broker1,broker2"}
    opts = kafka_source_options(KafkaSpec("b:9092", "key", "secret"), "topic1", "earliest")
    assert opts == {
        "kafka.bootstrap.servers": "b:9092",
        "kafka.security.protocol": "SASL_SSL",
        "kafka.sasl.mechanism": "PLAIN",
        "kafka.sasl.jaas.config": (
            "org.apache.kafka.common.security.plain.PlainLoginModule required "
            'username="key" password="secret";'),
        "subscribe": "topic1",
        "startingOffsets": "earliest",
    }


def test_sample_source_uses_the_codec(spark):
    inp = InputSpec("topic1", [{"name": "field1", "type": "string"}], [{"field1": "somevalue"}])
    assert [r.asDict() for r in sample_frame(spark, inp).collect()] == [{"field1": "somevalue"}]


def test_json_lines_failfast(spark, tmp):
    path = os.path.join(tmp, "lines")
    os.makedirs(path)
    with open(os.path.join(path, "a.json"), "w") as fh:
        fh.write('{"first_name": "a", "last_name": "b"}\n{"first_name": "c", "last_name": "d"}\n')
    schema = {"fields": [{"name": "first_name", "type": "string"},
                         {"name": "last_name", "type": "string"}]}
    assert read_json_lines(spark, path, schema).count() == 2
    with open(os.path.join(path, "b.json"), "w") as fh:
        fh.write('{"first_name": "e", "last_name"\n')
    with pytest.raises(Exception):
        read_json_lines(spark, path, schema).count()


def test_file_topics_to_process(spark, tmp):
    """Two topics, each decoded by its own schema, reach process in order."""
    t = FileTransport(f"{tmp}/topics")
    publish(spark.createDataFrame([(1, "a")], "id long, s string"), t, "first", ["id"])
    publish(spark.createDataFrame([(2.5,)], "x double"), t, "second", [])
    inputs = [InputSpec("first", [{"name": "id", "type": "long"}, {"name": "s", "type": "string"}]),
              InputSpec("second", [{"name": "x", "type": "double"}])]
    seen = {}

    def process(dfs):
        seen["cols"] = [d.columns for d in dfs]
        return dfs[0]

    out = collect_to_memory(read_topics(spark, inputs, t, process))
    assert seen["cols"] == [["id", "s"], ["x"]]
    assert rows(out) == [{"id": 1, "s": "a"}]


def test_table_stream_single_file(spark):
    out = collect_to_memory(table_stream(spark, table_path(SF01, "nation")))
    assert out.count() == 25


def test_batch_equals_stream(spark):
    """The same process on the batch table and on its stream agrees."""
    def process(dfs):
        return dfs[0].filter(F.col("value") > 10).select("event_id", "user_id", "value")

    batch = process([spark.read.parquet(table_path(SF01, "events"))])
    stream = collect_to_memory(process([table_stream(spark, table_path(SF01, "events"))]))
    assert batch.exceptAll(stream).count() == 0 and stream.exceptAll(batch).count() == 0


def test_kafka_batch_bound():
    opts = kafka_source_options(KafkaSpec("b"), "t", max_offsets_per_trigger=500000)
    assert opts["maxOffsetsPerTrigger"] == "500000" and opts["subscribe"] == "t"

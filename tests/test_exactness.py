"""Exactness of checks, archives, status documents, registry and sessions."""

from __future__ import annotations

import json
from dataclasses import replace
from datetime import datetime
from types import SimpleNamespace

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from featureflow import session
from featureflow.config import InputSpec, JobConfig, KafkaSpec, TableSpec
from featureflow.functions.codec import JSON_OPTIONS, output_topic
from featureflow.operators import registry
from featureflow.operators.checks import compare_rows, expected_frame
from featureflow.operators.features import trailing_count, windowed_count
from featureflow.operators.status import parse_status
from featureflow.plans.jobs import (
    archive_base, archive_job, build_fixture, check_on_samples, feature_store, live_job, replay_job, write_fixture)
from featureflow.plans.tables import EVENTS_SCHEMA, table_path
from featureflow.sources.files import folder_location, sample_frame
from featureflow.sources.topics import FileTransport, publish
from featureflow.streaming.runner import dropped_rows, run_bounded
from featureflow.config import OutputSpec

from conftest import SF001, rows


# ------------------------------------------------------------------ checks

def test_a_cast_that_changes_a_value_is_reported(spark):
    expected = spark.createDataFrame([(1,), (2,)], "x int")
    actual = spark.createDataFrame([(1.9,), (2.0,)], "x double")
    assert sorted((r.x, r.side) for r in compare_rows(actual, expected).collect()) == [(1, "extra"), (1, "missing")]
    texts = spark.createDataFrame([("1",), ("two",)], "x string")
    assert sorted(((r.x, r.side) for r in compare_rows(texts, expected).collect()), key=str) == [(2, "missing"), (None, "extra")]


def test_other_columns_are_refused(spark):
    one = spark.createDataFrame([(1,)], "x int")
    for actual in (one.withColumn("y", F.lit(1)), one.withColumnRenamed("x", "y")):
        with pytest.raises(ValueError, match="columns"):
            compare_rows(actual, one)


def test_maps_are_equal_in_any_order_at_any_depth(spark):
    make = "SELECT named_struct('m', array(map('a', map('x', 1, 'y', 2), 'b', map()))) AS s"
    other = "SELECT named_struct('m', array(map('b', map(), 'a', map('y', 2, 'x', 1)))) AS s"
    wrong = "SELECT named_struct('m', array(map('b', map(), 'a', map('y', 2, 'x', 3)))) AS s"
    expected = spark.sql(make)
    assert compare_rows(spark.sql(other), expected).count() == 0
    assert compare_rows(spark.sql(wrong), expected).count() == 2


def test_expected_rows_are_json_scalars(spark):
    schema = [{"name": "d", "type": "double"}, {"name": "t", "type": "timestamp_ntz"}, {"name": "b", "type": "boolean"}]
    got = expected_frame(spark, [{"d": 1, "t": "2024-01-02T03:04:05", "b": True}, {"t": datetime(2024, 1, 2, 3, 4, 5, 60)}], schema)
    assert [tuple(r) for r in got.collect()] == [
        (1.0, datetime(2024, 1, 2, 3, 4, 5), True), (None, datetime(2024, 1, 2, 3, 4, 5, 60), None)]
    for bad in ({"d": "oops"}, {"b": "maybe"}, {"t": "yesterday"}):
        with pytest.raises(Exception, match="(?i)malformed|parse"):
            expected_frame(spark, [bad], schema).collect()
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        sample_frame(spark, InputSpec("t", [{"name": "a", "type": "long"}], [{"a": "oops"}])).collect()


def test_fixture_of_events_checks_clean(spark, tmp):
    """Times and JSON text survive the way into a fixture and back."""
    events = spark.read.parquet(table_path(SF001, "events"))
    events.write.options(**JSON_OPTIONS).json(folder_location(f"{tmp}/dev", "app", "events"))
    cfg = JobConfig("app", tmp, [InputSpec("events", EVENTS_SCHEMA)], table=TableSpec(["event_id"], EVENTS_SCHEMA))

    def process(dfs):
        return dfs[0].filter("value > 10")

    fixture = write_fixture(spark, cfg, process, f"{tmp}/dev", f"{tmp}/fixture")
    assert check_on_samples(spark, fixture, process).count() == 0
    with pytest.raises(AssertionError):
        check_on_samples(spark, fixture, lambda dfs: dfs[0])
    with pytest.raises(ValueError, match="write_fixture"):
        build_fixture(spark, cfg, process, f"{tmp}/dev", max_rows=10)


# ------------------------------------------------------- archive, publishing

def damaged_topic(spark, tmp):
    transport = FileTransport(f"{tmp}/topics")
    records = [("events", "k1", '{"a": 1, "b": "x"}'), ("events", "k2", '{"a": 1, "b'), ("events", "k3", '{"a": "no"}'), ("events", "k4", None)]
    transport.write_batch(spark.createDataFrame(records, "topic string, key string, value string"))
    return transport, InputSpec("events", [{"name": "a", "type": "long"}, {"name": "b", "type": "string"}])


def test_the_archive_keeps_every_record(spark, tmp):
    transport, inp = damaged_topic(spark, tmp)
    cfg = JobConfig("app", tmp, [inp], run_id="a", table=TableSpec(["a"], inp.topic_schema))
    archive_job(spark, cfg, inp, transport, bounded=True).awaitTermination()
    kept = spark.read.parquet(folder_location(archive_base(cfg), "app", "events"))
    got = {r["_key"]: (r["a"], r["_bad_reason"], r["_corrupt_record"]) for r in kept.collect()}
    assert got == {"k1": (1, None, None), "k2": (None, "malformed", '{"a": 1, "b'), "k3": (None, "malformed", '{"a": "no"}'),
                   "k4": (None, "null value", None)}
    assert kept.filter("_timestamp is null").count() == 0
    # A replay sees the records that decode.
    replay = replace(cfg, run_id="r")
    replay_job(spark, replay, lambda dfs: dfs[0], bounded=True).awaitTermination()
    assert rows(feature_store(replay).latest(spark, 1)) == [{"a": 1, "b": "x"}]


def test_topic_and_table_get_the_declared_columns(spark, tmp):
    transport = FileTransport(f"{tmp}/topics")
    inp = InputSpec("in", [{"name": "a", "type": "long"}, {"name": "b", "type": "string"}])
    publish(spark.createDataFrame([(1, "x")], "a long, b string"), transport, "in", ["a"])
    cfg = JobConfig("app", tmp, [inp], table=TableSpec(["a"], [{"name": "a", "type": "long"}]))
    live_job(spark, cfg, lambda dfs: dfs[0].withColumn("extra", F.lit(1)), transport, bounded=True).awaitTermination()
    published = transport.read_batch(spark, output_topic("app", 1)).select("value").collect()
    assert [json.loads(r[0]) for r in published] == [{"a": 1}]


@pytest.mark.parametrize("rocksdb", [False, True])
def test_late_rows_are_counted(spark, tmp, rocksdb):
    """A file that arrives after the watermark has passed it; the same with
    either state store."""
    if rocksdb:
        spark.conf.set(session.STATE_STORE_CONF, session.ROCKSDB)
    try:
        check_late_rows(spark, tmp)
    finally:
        spark.conf.unset(session.STATE_STORE_CONF)


def check_late_rows(spark, tmp):
    ts = "timestamp_ntz"
    for k, day in enumerate((20, 21, 1)):
        spark.createDataFrame([(1, datetime(2024, 1, day))], f"u long, ts {ts}").write.mode("append").parquet(f"{tmp}/src")
        stream = spark.readStream.schema(f"u long, ts {ts}").parquet(f"{tmp}/src")
        query = run_bounded(windowed_count(stream, ["u"], "ts", "1 day", "1 day"), lambda b, i: b.collect(),
                            OutputSpec("update"), f"{tmp}/cp")
        assert dropped_rows(query) == (k == 2)


# ------------------------------------------------- trailing counts, status

def test_trailing_count_with_repeated_and_null_ids(spark):
    t = datetime(2024, 1, 1)
    data = [(1, "u", t, {"m": 1}), (1, "u", t.replace(hour=1), None), (None, "u", t.replace(hour=2), {}), (2, "u", None, None), (3, None, t, None)]
    df = spark.createDataFrame(data, "id long, u string, ts timestamp_ntz, m map<string,int>")
    got = trailing_count(df, ["u"], "ts", "1 day", out="n")
    assert got.columns == ["id", "u", "ts", "m", "n"]
    assert sorted(((r.id, r.ts, r.m, r.n) for r in got.collect()), key=str) == sorted(
        [(1, t, {"m": 1}, 1), (1, t.replace(hour=1), None, 2), (None, t.replace(hour=2), {}, 3), (2, None, None, None), (3, t, None, 1)], key=str)


def test_trailing_count_reads_its_input_once(spark, tmp):
    spark.createDataFrame([(1, datetime(2024, 1, 1))], "u long, ts timestamp_ntz").write.parquet(f"{tmp}/in")
    plan = trailing_count(spark.read.parquet(f"{tmp}/in"), ["u"], "ts", "1 day")._jdf.queryExecution().optimizedPlan().toString()
    assert f"{tmp}/in" not in plan and plan.count("Join") == 1  # the join with the partitions' offsets


def status(app_id):
    return {"metadata": {"creationTimestamp": "c", "labels": {"app": "a"}, "name": "n"},
            "status": {"applicationState": {"state": "S"}, "sparkApplicationId": app_id, "lastSubmissionAttemptTime": None,
                       "terminationTime": None, "executionAttempts": 1, "submissionAttempts": 2}}


@pytest.mark.parametrize("strict", [False, True])
def test_status_ids_may_be_text(spark, strict):
    docs = spark.createDataFrame([(json.dumps(status("spark-7f")),), (json.dumps(status(7)),)], "document string")
    got = parse_status(docs, strict=strict, id_type="string").collect()
    assert [r.id for r in got] == ["spark-7f", "7"] and got[0].job_name == "a" and got[0].submission_attempts == 2


def test_strict_status_refuses_what_it_cannot_read(spark):
    text = spark.createDataFrame([(json.dumps(status("spark-7f")),)], "document string")
    assert parse_status(text).first().id is None
    with pytest.raises(Exception, match="sparkApplicationId"):
        parse_status(text, strict=True).collect()
    for path in ("metadata.labels.app", "metadata", "status.applicationState", "status.terminationTime"):
        doc = status(1)
        *way, last = path.split(".")
        holder = doc
        for p in way:
            holder = holder[p]
        del holder[last]
        with pytest.raises(Exception, match=f"no key {path}"):
            parse_status(spark.createDataFrame([(json.dumps(doc),)], "document string"), strict=True).collect()


# ----------------------------------------------------- registry and session

def test_registered_text_is_json_dumps(spark, tmp):
    fields = [{"name": "é", "type": "string", "doc": "d"}]
    assert [registry.register_schema(spark, tmp, "o", "a", ["é"], fields) for _ in range(2)] == [1, 2]
    assert registry.register_schema(spark, tmp, "o", "b", ["é"], fields) == 1
    history = registry.read_history(spark, tmp)
    assert {r.avro_schema for r in history.collect()} == {json.dumps(fields)}
    assert registry.history_of(spark, tmp, "o", "a").count() == 2


def test_only_a_missing_path_is_an_empty_history(spark, tmp, monkeypatch):
    assert registry.read_history(spark, tmp).count() == 0
    monkeypatch.setattr(registry, "is_missing_path", lambda exc: False)
    with pytest.raises(AnalysisException):
        registry.read_history(spark, tmp)


def test_scratch_needs_a_shared_folder_on_a_cluster(monkeypatch):
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    unset = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=context)
    with pytest.raises(ValueError, match="shared folder"):
        session.scratch_dir(unset, "x")
    context.master = "local-cluster[2,1,1024]"
    with pytest.raises(ValueError, match="shared folder"):
        session.scratch_dir(unset, "x")


def test_scratch_is_cleared(spark):
    df = spark.createDataFrame([(k % 3, datetime(2024, 1, 1)) for k in range(9)], "u long, ts timestamp_ntz")
    assert trailing_count(df, ["u"], "ts", "1 day").count() == 9
    made = [p for p in session._SCRATCH[id(spark.sparkContext)] if "/ranking-" in p]
    assert made and session.clear_scratch(spark) >= 1
    assert not any(session.list_dirs(spark, p) or session.is_file(spark, p) for p in made)
    assert session.clear_scratch(spark) == 0


def test_markers_are_whole_and_written_once(spark, tmp):
    assert session.create_marker(spark, f"{tmp}/m/x", "one") and not session.create_marker(spark, f"{tmp}/m/x", "two")
    assert session.read_marker(spark, f"{tmp}/m/x") == "one"
    assert session.read_marker(spark, f"{tmp}/m/y") is None


def test_secrets_do_not_show():
    assert "hush" not in repr(KafkaSpec("b", "hush", "hush"))

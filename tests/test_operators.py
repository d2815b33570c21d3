from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from featureflow.operators.checks import compare_rows
from featureflow.operators.features import interval_join, interval_micros, trailing_count, windowed_count
from featureflow.operators.ranking import count_preceding
from featureflow.operators.registry import (
    REQUEST_SCHEMA,
    assign_versions,
    current_for,
    read_history,
    register,
    register_schema,
    rejected,
)
from featureflow.operators.status import flatten_status, parse_status, STATUS_SCHEMA

from conftest import rows


# ------------------------------------------------------------------ ranking

@pytest.mark.parametrize("parts,seed", [(1, 1), (3, 2), (8, 3), (16, 4)])
def test_count_preceding_matches_brute_force(spark, parts, seed):
    rnd = random.Random(seed)
    data = []
    for i in range(3000):
        # one key holds about half the rows; some keys are null
        k = 7 if rnd.random() < 0.5 else rnd.choice([None, 1, 2, 3, 4])
        data.append((k, rnd.choice(["a", "b"]), rnd.randint(0, 50), i, rnd.randint(0, 3)))
    df = spark.createDataFrame(data, "k long, k2 string, o long, id long, w long")
    got = {r.id: r.n_before for r in
           count_preceding(df, ["k", "k2"], ["o", "id"], "w", ["id"], num_partitions=parts).collect()}
    want = {}
    for k, k2, o, i, _ in data:
        want[i] = sum(w for kk, kk2, oo, ii, w in data
                      if kk == k and kk2 == k2 and (oo, ii) < (o, i))
    assert got == want


def test_count_preceding_emit(spark):
    df = spark.createDataFrame([(1, i, i % 2 == 0) for i in range(10)], "k long, o long, e boolean")
    out = count_preceding(df.withColumn("w", F.lit(1).cast("long")), ["k"], ["o"], "w", ["o"],
                          emit="e", num_partitions=3)
    assert sorted((r.o, r.n_before) for r in out.collect()) == [(i, i) for i in range(0, 10, 2)]


# ----------------------------------------------------------------- features

def test_interval_micros():
    assert interval_micros("7 days") == 7 * 86_400_000_000
    assert interval_micros("1 hour") == 3_600_000_000
    with pytest.raises(ValueError):
        interval_micros("1 month")


def _ts(d, h=0, m=0):
    return dt.datetime(2024, 1, d, h, m)


def test_trailing_count_ties_and_edges(spark):
    data = [(1, 1, _ts(1)), (2, 1, _ts(1)), (3, 1, _ts(8)), (4, 1, _ts(8, 0, 1)),
            (5, 2, _ts(3)), (6, 1, None), (7, None, _ts(2))]
    df = spark.createDataFrame(data, "id long, u long, ts timestamp_ntz")
    got = {r.id: r.n for r in trailing_count(df, ["u"], "ts", "7 days", "id", out="n").collect()}
    # day 8 00:00 includes day 1 00:00 (inclusive bound); 00:01 does not.
    assert got == {1: 2, 2: 2, 3: 3, 4: 2, 5: 1, 6: None, 7: 1}


def test_interval_join_matches_brute_force(spark):
    rnd = random.Random(5)
    left = [(i, rnd.randint(1, 3), _ts(1) + dt.timedelta(minutes=rnd.randint(0, 6000)))
            for i in range(200)]
    right = [(i, rnd.randint(1, 3), _ts(1) + dt.timedelta(minutes=rnd.randint(0, 6000)))
             for i in range(200)]
    L = spark.createDataFrame(left, "lid long, u long, lt timestamp_ntz")
    R = spark.createDataFrame(right, "rid long, u long, rt timestamp_ntz")
    got = sorted((r.lid, r.rid) for r in interval_join(L, R, ["u"], "lt", "rt", "0 seconds",
                                                          "1 day").collect())
    want = sorted((a, b) for a, u1, t1 in left for b, u2, t2 in right
                  if u1 == u2 and t1 <= t2 <= t1 + dt.timedelta(days=1))
    assert got == want
    # a narrower bucket gives the same result
    got2 = sorted((r.lid, r.rid) for r in interval_join(L, R, ["u"], "lt", "rt", "0 seconds",
                                                           "1 day", bucket="2 hours").collect())
    assert got2 == want


def test_windowed_count_stream_drops_late_rows(spark, tmp):
    """Two micro-batches; a row older than the watermark is dropped."""
    src = f"{tmp}/src"
    schema = "u long, ts timestamp_ntz"
    spark.createDataFrame([(1, _ts(1, 1)), (1, _ts(1, 2)), (2, _ts(5))], schema) \
        .coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(src)
    counts = windowed_count(stream, ["u"], "ts", "1 day", watermark="1 hour")
    q = (counts.writeStream.outputMode("update").format("memory").queryName("wc_late")
         .option("checkpointLocation", f"{tmp}/cp").start())
    try:
        q.processAllAvailable()
        spark.createDataFrame([(1, _ts(1, 3)), (2, _ts(5, 1))], schema) \
            .coalesce(1).write.mode("append").parquet(src)
        q.processAllAvailable()
    finally:
        q.stop()
    got = spark.table("wc_late").groupBy("window_start", "u").agg(F.max("n_events").alias("n"))
    assert rows(got, "u") == [
        {"window_start": _ts(1), "u": 1, "n": 2},  # the late row of day 1 was dropped
        {"window_start": _ts(5), "u": 2, "n": 2},
    ]


# ----------------------------------------------------------------- registry

def _req(spark, data):
    return spark.createDataFrame(data, REQUEST_SCHEMA)


def test_register_schema_versions_every_call(spark, tmp):
    schema = [{"name": "field1", "type": "string"}]
    assert register_schema(spark, tmp, "org", "app", ["field1"], schema) == 1
    assert register_schema(spark, tmp, "org", "app", ["field1"], schema) == 2
    assert register_schema(spark, tmp, "org", "other", ["field1"], schema) == 1
    hist = read_history(spark, tmp).filter("app = 'app'").orderBy("code_version").collect()
    assert [h.avro_schema for h in hist] == ['[{"name": "field1", "type": "string"}]'] * 2


def test_register_schema_validation(spark, tmp):
    with pytest.raises(ValueError):
        register_schema(spark, tmp, "org", "app", ["missing"], [{"name": "a", "type": "string"}])
    with pytest.raises(ValueError):
        register_schema(spark, tmp, "org", "app", ["a"], [{"name": "a"}])


def test_ambiguous_names_stay_apart(spark, tmp):
    f = [("a", "string")]
    t = _ts(1)
    out = register(spark, tmp, _req(spark, [("a_b", "c", 1, t, ["a"], f),
                                             ("a", "b_c", 2, t, ["a"], f)]))
    assert sorted((r.org, r.app, r.code_version) for r in out.collect()) == [
        ("a", "b_c", 1), ("a_b", "c", 1)]


def test_versions_continue_and_hot_app(spark, tmp):
    f = [("a", "string")]
    first = [("o", "hot", i, _ts(1) + dt.timedelta(seconds=i), ["a"], f) for i in range(500)]
    register(spark, tmp, _req(spark, first))
    more = [("o", "hot", 1000 + i, _ts(2), ["a"], f) for i in range(3)] + \
           [("o", "cold", 2000, _ts(2), ["a"], f)]
    out = {r.request_id: r.code_version for r in register(spark, tmp, _req(spark, more)).collect()}
    assert out == {1000: 501, 1001: 502, 1002: 503, 2000: 1}
    hist = read_history(spark, tmp)
    assert sorted(r.code_version for r in hist.filter("app = 'hot'").collect()) == list(range(1, 504))
    apps = spark.createDataFrame([("o", "hot"), ("o", "cold"), ("o", "none")], "org string, app string")
    assert rows(current_for(hist, apps), "app") == [
        {"org": "o", "app": "cold", "code_version": 1},
        {"org": "o", "app": "hot", "code_version": 503},
        {"org": "o", "app": "none", "code_version": 0}]


def test_rejected_requests(spark):
    t = _ts(1)
    reqs = _req(spark, [("o", "a", 1, t, ["x"], [("x", "string")]),
                        ("o", "a", 2, t, ["y"], [("x", "string")]),
                        ("o", "a", 3, t, ["x"], [("x", "string"), ("x", "long")]),
                        ("o", "a", 4, t, ["x"], [("x", None)]),
                        ("o", "a", 5, t, [], [("x", "string")])])
    assert sorted(r.request_id for r in rejected(reqs).collect()) == [2, 3, 4, 5]
    out = assign_versions(reqs, read_history(spark, "/nonexistent/registry")).collect()
    assert [(r.request_id, r.code_version) for r in out] == [(1, 1)]


# ------------------------------------------------------------------- status

DOCS = [
    {"metadata": {"creationTimestamp": "2021-07-04T14:58:34Z", "labels": {"app": app},
                  "name": name},
     "status": {"applicationState": {"state": "RUNNING"}, "sparkApplicationId": 1,
                "lastSubmissionAttemptTime": "2021-07-04T14:58:46Z", "terminationTime": None,
                "executionAttempts": 1, "submissionAttempts": 1}}
    for app, name in [("app1", "spark1"), ("app2", "spark1"), ("app1", "spark2")]
]
EXPECTED = [
    {"job_name": app, "spark_name": name, "state": "RUNNING", "id": 1,
     "start_time": "2021-07-04T14:58:46Z", "container_start_time": "2021-07-04T14:58:34Z",
     "stop_time": None, "execution_attempts": 1, "submission_attempts": 1}
    for app, name in [("app1", "spark1"), ("app2", "spark1"), ("app1", "spark2")]
]


def _struct_rows(d):
    m, s = d["metadata"], d["status"]
    return ((m["creationTimestamp"], (m["labels"]["app"],), m["name"]),
            ((s["applicationState"]["state"],), s["sparkApplicationId"],
             s["lastSubmissionAttemptTime"], s["terminationTime"], s["executionAttempts"],
             s["submissionAttempts"]))


def test_status_projection_reference_cases(spark):
    docs = spark.createDataFrame([_struct_rows(d) for d in DOCS], STATUS_SCHEMA).coalesce(1)
    assert [r.asDict() for r in flatten_status(docs).collect()] == EXPECTED
    assert flatten_status(spark.createDataFrame([], STATUS_SCHEMA)).count() == 0


def test_status_from_json_and_strict(spark):
    import json
    texts = spark.createDataFrame([(json.dumps(d),) for d in DOCS], "document string").coalesce(1)
    assert [r.asDict() for r in parse_status(texts).collect()] == EXPECTED
    assert [r.asDict() for r in parse_status(texts, strict=True).collect()] == EXPECTED
    broken = dict(DOCS[0], status={k: v for k, v in DOCS[0]["status"].items()
                                   if k != "executionAttempts"})
    bad = spark.createDataFrame([(json.dumps(broken),)], "document string")
    assert parse_status(bad).first().execution_attempts is None
    with pytest.raises(Exception, match="status.executionAttempts"):
        parse_status(bad, strict=True).collect()


# ------------------------------------------------------------------- checks

def test_compare_rows_counts_duplicates(spark):
    exp = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k long, v string")
    act = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (3, "c")], "k long, v string")
    assert rows(compare_rows(act, exp), "k") == [
        {"k": 2, "v": "b", "side": "missing", "n_rows": 1},
        {"k": 3, "v": "c", "side": "extra", "n_rows": 2}]


def test_compare_rows_with_maps(spark):
    exp = spark.createDataFrame([(1, {"a": 1})], "k long, m map<string,int>")
    act = spark.createDataFrame([(1, {"a": 2})], "k long, m map<string,int>")
    assert sorted(r.side for r in compare_rows(act, exp).collect()) == ["extra", "missing"]
    assert compare_rows(exp, exp).count() == 0


def test_count_preceding_nested_key(spark):
    df = spark.createDataFrame([((1, "a"), i) for i in range(6)] + [((2, "b"), i) for i in range(3)],
                               "k struct<x:long,y:string>, o long").withColumn("w", F.lit(1).cast("long"))
    out = count_preceding(df, ["k"], ["o"], "w", ["o"], num_partitions=3)
    got = sorted((r.k.x, r.o, r.n_before) for r in out.collect())
    assert got == sorted([(1, i, i) for i in range(6)] + [(2, i, i) for i in range(3)])


@pytest.mark.parametrize("seed", [11, 12])
def test_trailing_count_random_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    base = dt.datetime(2024, 1, 1)
    data = []
    for i in range(1500):
        u = 0 if rnd.random() < 0.4 else rnd.randint(1, 6)   # a hot user
        t = base + dt.timedelta(minutes=rnd.randint(0, 600) * 5)  # many ties
        data.append((i, u, t))
    df = spark.createDataFrame(data, "id long, u long, ts timestamp_ntz")
    got = {r.id: r.n for r in trailing_count(df, ["u"], "ts", "2 hours", "id", out="n").collect()}
    width = dt.timedelta(hours=2)
    by_user = {}
    for _, u, t in data:
        by_user.setdefault(u, []).append(t)
    want = {i: sum(1 for s in by_user[u] if t - width <= s <= t) for i, u, t in data}
    assert got == want


def test_hot_key_is_spread_over_partitions(spark):
    """The pass table of count_preceding: a key with half of all rows lands
    in several partitions and no partition is much larger than the mean."""
    import glob
    import os

    from featureflow.session import _checkpoint_root
    df = spark.range(0, 40000).select(
        F.when(F.col("id") % 2 == 0, F.lit(0)).otherwise(F.col("id") % 97).alias("k"),
        F.col("id").alias("o"), F.lit(1).cast("long").alias("w"))
    before = set(glob.glob(f"{_checkpoint_root(spark)}/featureflow/ranking-*"))
    count_preceding(df, ["k"], ["o"], "w", ["o"], num_partitions=8)
    [path] = set(glob.glob(f"{_checkpoint_root(spark)}/featureflow/ranking-*")) - before
    sizes = {r["_pid"]: r["n"] for r in spark.read.parquet(path).filter("_tag = 0")
             .groupBy("_pid").agg(F.count(F.lit(1)).alias("n")).collect()}
    hot = {r["_pid"] for r in spark.read.parquet(path).filter("_tag = 0 and k = 0")
           .select("_pid").distinct().collect()}
    assert len(hot) >= 3
    assert max(sizes.values()) <= 2 * (sum(sizes.values()) / len(sizes))
    assert os.path.isdir(path)


def test_interval_join_around_the_left_time(spark):
    rnd = random.Random(9)
    left = [(i, rnd.randint(1, 2), _ts(1) + dt.timedelta(minutes=rnd.randint(0, 600))) for i in range(80)]
    right = [(i, rnd.randint(1, 2), _ts(1) + dt.timedelta(minutes=rnd.randint(0, 600))) for i in range(80)]
    L = spark.createDataFrame(left, "lid long, u long, lt timestamp_ntz")
    R = spark.createDataFrame(right, "rid long, u long, rt timestamp_ntz")
    got = sorted((r.lid, r.rid) for r in interval_join(L, R, ["u"], "lt", "rt", "-1 hour", "30 minutes").collect())
    want = sorted((a, b) for a, u1, t1 in left for b, u2, t2 in right
                  if u1 == u2 and t1 - dt.timedelta(hours=1) <= t2 <= t1 + dt.timedelta(minutes=30))
    assert got == want
    assert interval_micros("-1 hour") == -3_600_000_000
    with pytest.raises(ValueError):
        interval_join(L, R, ["u"], "lt", "rt", "1 hour", "0 seconds")


def test_sliding_windowed_count_in_append_mode(spark, tmp):
    from featureflow.streaming.sinks import collect_to_memory
    src = f"{tmp}/src"
    schema = "u long, ts timestamp_ntz"
    spark.createDataFrame([(1, _ts(1, 1)), (1, _ts(2, 1)), (1, _ts(3, 1))], schema).write.parquet(src)
    stream = spark.readStream.schema(schema).parquet(src)
    counts = windowed_count(stream, ["u"], "ts", "2 days", watermark="0 seconds", slide="1 day")
    got = collect_to_memory(counts, mode="append")
    # the watermark ends at the last event (Jan 3 01:00): only windows that
    # end by then are closed and emitted in append mode
    assert rows(got, "window_start") == [
        {"window_start": dt.datetime(2023, 12, 31), "window_end": _ts(2), "u": 1, "n_events": 1},
        {"window_start": _ts(1), "window_end": _ts(3), "u": 1, "n_events": 2},
    ]
    with pytest.raises(ValueError):
        trailing_count(spark.createDataFrame([(1, 1, _ts(1))], "id long, u long, ts timestamp_ntz"),
                       ["u"], "ts", "-1 day", "id")


def test_trailing_count_several_widths_in_one_pass(spark):
    rnd = random.Random(21)
    data = [(i, rnd.randint(0, 3), _ts(1) + dt.timedelta(hours=rnd.randint(0, 400)))
            for i in range(800)]
    df = spark.createDataFrame(data, "id long, u long, ts timestamp_ntz")
    got = {r.id: (r.n1, r.n7) for r in
           trailing_count(df, ["u"], "ts", ["1 day", "7 days"], "id", out=["n1", "n7"]).collect()}
    def count(u, t, days):
        return sum(1 for _, uu, s in data if uu == u and t - dt.timedelta(days=days) <= s <= t)
    assert got == {i: (count(u, t, 1), count(u, t, 7)) for i, u, t in data}
    with pytest.raises(ValueError):
        trailing_count(df, ["u"], "ts", ["1 day", "7 days"], "id", out="n")


def test_current_records(spark, tmp):
    from featureflow.operators.registry import current_records
    register_schema(spark, tmp, "o", "a", ["x"], [{"name": "x", "type": "string"}])
    register_schema(spark, tmp, "o", "a", ["x"], [{"name": "x", "type": "string"},
                                                  {"name": "y", "type": "long"}])
    [rec] = current_records(read_history(spark, tmp)).collect()
    assert (rec.org, rec.app, rec.code_version, rec.primary_keys) == ("o", "a", 2, ["x"])
    assert rec.avro_schema == '[{"name": "x", "type": "string"}, {"name": "y", "type": "long"}]'


def test_count_preceding_nan_keys_group_together(spark):
    nan = float("nan")
    data = [(nan if i % 3 == 0 else float(i % 2), i) for i in range(60)]
    df = spark.createDataFrame(data, "k double, o long").withColumn("w", F.lit(1).cast("long"))
    got = {r.o: r.n_before for r in
           count_preceding(df, ["k"], ["o"], "w", ["o"], num_partitions=4).collect()}
    def key(k):
        return "nan" if k != k else k
    want = {o: sum(1 for kk, oo in data if key(kk) == key(k) and oo < o) for k, o in data}
    assert got == want

"""Counts kept live: exact trailing counts, and rows behind the watermark."""

from __future__ import annotations

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from featureflow import OutputSpec
from featureflow.operators import trailing
from featureflow.operators.features import windowed_count
from featureflow.operators.trailing import STATE_SETTINGS, stream_trailing_count
from featureflow.streaming.late import CLOSED, DroppedRows, late_split
from featureflow.streaming.runner import run_bounded

START = datetime(2024, 5, 1)
SCHEMA = "id long, who string, at timestamp"


def plain_counts(rows, width):
    out = []
    for i, who, at in rows:
        n = None if at is None else sum(w == who and t is not None and at - width <= t <= at for _, w, t in rows)
        out.append((i, who, at, n))
    return out


def run_parts(spark, tmp, parts, build, write, settings=None, **kw):
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp}/src")
        out = build(spark.readStream.schema(SCHEMA).parquet(f"{tmp}/src"))
        run_bounded(*(out if isinstance(out, tuple) else (out, write)), OutputSpec("update"), f"{tmp}/checkpoint", settings=settings, **kw)


def test_trailing_counts_of_shuffled_arrivals(spark, tmp):
    """Events in any order: the largest count of each is the exact one."""
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "b", None]), START + timedelta(minutes=rng.randint(0, 3000))) for i in range(150)]
    rows += [(900, "a", START), (901, "a", START), (902, "b", None), (None, "b", START + timedelta(days=1)), (903, "c", START)]
    # The same row twice is two events.
    rows += [(904, "a", START + timedelta(minutes=7))] * 2
    rng.shuffle(rows)
    got = []
    run_parts(spark, tmp, [rows[:60], rows[60:61], rows[61:]],
              lambda df: stream_trailing_count(df, ["who"], "at", "8 hours", "id", watermark="30 days", out="n"),
              lambda df, batch: got.extend(tuple(r) for r in df.select("id", "who", "at", "n").collect()), STATE_SETTINGS)
    largest = {}
    for i, who, at, n in got:
        largest[i, who, at] = max(n or 0, largest.get((i, who, at), 0))
    assert largest == {(i, who, at): n or 0 for i, who, at, n in plain_counts(rows, timedelta(hours=8))}
    # Nothing is emitted that has not changed: an event per arrival it can see.
    assert len(got) < len(rows) * 3


def test_trailing_state_expires(spark, tmp):
    """Panes out of reach are dropped: the state does not grow with the stream."""
    parts = [[(100 * d + k, "a", START + timedelta(days=d, minutes=k)) for k in range(5)] for d in range(8)]
    got, sizes = {}, []

    def write(df, batch):
        got.update({r["id"]: r["n"] for r in df.collect()})

    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp}/src")
        df = stream_trailing_count(spark.readStream.schema(SCHEMA).parquet(f"{tmp}/src"), ["who"], "at", "1 day", "id", watermark="1 hour", out="n")
        q = run_bounded(df, write, OutputSpec("update"), f"{tmp}/checkpoint", settings=STATE_SETTINGS)
        sizes.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    rows = [r for p in parts for r in p]
    assert got == {i: n for i, _, _, n in plain_counts(rows, timedelta(days=1))}
    assert max(sizes[4:]) <= max(sizes[:4])


def test_trailing_state_is_taken_by_bucket(spark, tmp):
    """One read and write of the state per bucket that has rows, whatever the
    number of its keys and their spans; keys of any type come back."""
    rows = [(2**60 + i, i % 40, START + timedelta(days=i // 40)) for i in range(400)]
    rows += [(None, None, START), (1, 7, None)]
    schema, at = "id long, who long, at timestamp", "timestamp_micros(1000000 * who)"
    spark.createDataFrame(rows, schema).coalesce(1).selectExpr("*", f"{at} AS seen", "cast(cast(who AS string) AS binary) AS raw", "who / 3.0D AS part", "struct(who, id * 0 AS z) AS both").write.parquet(f"{tmp}/src")
    source, got = spark.read.parquet(f"{tmp}/src"), []
    keys = ["who", "seen", "raw", "part", "both"]
    df = stream_trailing_count(spark.readStream.schema(source.schema).parquet(f"{tmp}/src"), keys, "at", "2 days", "id", watermark="1 day", out="n")
    q = run_bounded(df, lambda d, b: got.extend(d.collect()), OutputSpec("update"), f"{tmp}/checkpoint",
                    settings=STATE_SETTINGS, final_no_data_batch=False)
    [state] = q.lastProgress["stateOperators"]
    # The null id's and the null time's row change the struct: 40 + 1 keys have events.
    assert state["numRowsUpdated"] <= 41
    want = source.selectExpr(*keys, "id", "at", "if(at is null, null, count(at) over (partition by who, both order by at range between interval 2 days preceding and current row)) AS n")
    assert sorted(map(repr, got)) == sorted(map(repr, want.collect()))


def test_trailing_buckets_of_many_keys(spark, tmp, monkeypatch):
    """Keys that share a bucket are counted apart, over several batches."""
    monkeypatch.setattr(trailing, "BUCKETS", 3)
    rng, got = random.Random(3), {}
    rows = [(i, rng.choice(["a", "b", "c", "d", 'e"', "f,", "", None]), START + timedelta(minutes=rng.randint(0, 900))) for i in range(300)]

    def write(df, batch):
        for r in df.collect():
            got[r["id"]] = r["who"], max(r["n"], got.get(r["id"], ("", 0))[1])

    run_parts(spark, tmp, [rows[:100], rows[100:110], rows[110:]],
              lambda df: stream_trailing_count(df, ["who"], "at", "2 hours", "id", watermark="30 days", out="n"), write, STATE_SETTINGS)
    assert got == {i: (who, n) for i, who, _, n in plain_counts(rows, timedelta(hours=2))}


def test_trailing_ids_are_checked(spark):
    df = spark.range(1).select(F.lit(1.5).alias("x"), F.lit(START).alias("at"))
    with pytest.raises(ValueError, match="whole numbers"):
        stream_trailing_count(df, [], "at", "1 day", "x", "1 day")
    with pytest.raises(ValueError, match="negative"):
        stream_trailing_count(df, [], "at", "-1 day", "x", "1 day")


@pytest.mark.parametrize("slide", [None, "1 hour"])
def test_counted_and_late_rows_are_all_rows(spark, tmp, slide):
    """Newest first, in several runs: each row is counted or late, in each of
    its windows; what Spark reports as dropped is what the late table has."""
    rng = random.Random(2)
    rows = [(i, rng.choice("ab"), START + timedelta(minutes=rng.randint(0, 60 * 24 * 4))) for i in range(400)]
    rows.sort(key=lambda r: r[2], reverse=True)
    parts = [rows[:100], [(1000, "a", None)], rows[100:250], rows[250:]]
    window, counted, late = "2 hours", {}, Counter()

    def write(df, batch):
        counted.update({(r["who"], r["window_start"]): r["n"] for r in df.collect()})

    def write_late(df, batch):
        for r in df.select("who", F.timestamp_micros(CLOSED).alias("start")).collect():
            late[r["who"], r["start"]] += 1

    def build(df):
        return late_split(df, lambda x: windowed_count(x, ["who"], "at", window, "3 hours", "n", slide), "at", window, "3 hours",
                          f"{tmp}/marks", write, write_late, slide)

    dropped = DroppedRows()
    spark.streams.addListener(dropped)
    try:
        run_parts(spark, tmp, parts, build, None)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    finally:
        spark.streams.removeListener(dropped)
    step = timedelta(hours=1 if slide else 2)
    want = Counter()
    for _, who, at in rows:
        start = START + (at - START) // step * step
        while start + timedelta(hours=2) > at:
            want[who, start] += 1
            start -= step
    total = Counter(counted)
    total.update(late)
    assert total == want and late
    # Spark counts groups after its partial aggregation; there is one task.
    [n] = dropped.by_query.values()
    assert 0 < n <= sum(late.values())


def test_listener_counts_beyond_recent_progress(spark, tmp):
    """Five batches drop rows, Spark keeps the progress of two."""
    spark.createDataFrame([(0, "a", START + timedelta(days=9))], SCHEMA).write.parquet(f"{tmp}/src")
    dropped = DroppedRows()
    spark.streams.addListener(dropped)
    before = spark.conf.get("spark.sql.streaming.numRecentProgressUpdates")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    try:
        for k in range(6):
            if k:
                part = [(10 * k + j, "abcdefgh"[j], START + timedelta(hours=j)) for j in range(3)]
                spark.createDataFrame(part, SCHEMA).repartition(3).write.mode("append").parquet(f"{tmp}/src")
            df = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", "1").parquet(f"{tmp}/src")
            q = run_bounded(windowed_count(df, ["who"], "at", "1 day", "1 hour"), lambda d, b: d.collect(), OutputSpec("update"), f"{tmp}/checkpoint")
            assert len(q.recentProgress) <= 2
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        assert list(dropped.by_query.values()) == [15] and dropped.batches[str(q.id)] >= 16
    finally:
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", before)
        spark.streams.removeListener(dropped)

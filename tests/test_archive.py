"""The folded archive: bounded files, one meaning before, during and after."""

from __future__ import annotations

import json
import os
import random
from dataclasses import replace
from datetime import date, datetime, timedelta

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from featureflow import InputSpec, JobConfig, OutputSpec, TableSpec
from featureflow.operators.archive import NO_DATE, Manifest, TopicArchive
from featureflow.operators.features import windowed_count
from featureflow.plans.jobs import (
    archive_base, end_replay, feature_store, fold_archive_job, ordered_replay_job, replay_job, topic_archive)
from featureflow.session import list_dirs
from featureflow.streaming.runner import dropped_rows

INP = InputSpec("clicks", [{"name": "id", "type": "long"}, {"name": "who", "type": "string"}, {"name": "at", "type": "timestamp"}])
START = datetime(2024, 3, 1)
TABLE = TableSpec(["who"], [{"name": "who", "type": "string"}, {"name": "n", "type": "long"}])


def write_batch(tmp, run, batch, rows, bad=()):
    """A raw batch as the archive job leaves it."""
    folder = f"{tmp}/archive/app/clicks/run_id={run}/batch_id={batch}"
    os.makedirs(folder, exist_ok=True)
    out = [{"id": i, "who": w, "at": t, "_bad_reason": None, "_corrupt_record": None, "_key": f"k{i}", "_timestamp": START} for i, w, t in rows]
    out += [{"id": None, "who": None, "at": None, "_bad_reason": "malformed", "_corrupt_record": x, "_key": None, "_timestamp": START} for x in bad]
    schema = pa.schema([("id", pa.int64()), ("who", pa.string()), ("at", pa.timestamp("us", tz="UTC")), ("_bad_reason", pa.string()),
                        ("_corrupt_record", pa.string()), ("_key", pa.string()), ("_timestamp", pa.timestamp("us", tz="UTC"))])
    pq.write_table(pa.Table.from_pylist(out, schema), f"{folder}/part-0-{run}-{batch}.parquet")


def row(i, days=10):
    return i, f"u{i % 7}", None if i % 50 == 0 else START + timedelta(minutes=(i * 7919) % (days * 1440))


def config(tmp, **kw):
    return JobConfig(app_name="app", bucket=str(tmp), inputs=[INP], table=TABLE, output=OutputSpec("update"), **{"run_id": "r", **kw})


def files(tmp, m):
    held = {(g, d) for d, own in m.dates.items() for g, _ in own}
    return [f for g, d in held for f in os.listdir(f"{tmp}/archive/app/_folded/clicks/data/generation={g}/date={d}") if f.endswith(".parquet")]


def totals(dfs):
    return dfs[0].groupBy("who").agg(F.count(F.lit(1)).alias("n"))


def latest(spark, cfg, run):
    return {r["who"]: r["n"] for r in feature_store(cfg).latest(spark, 1, run_id=run).collect()}


def expected(ids):
    out = {}
    for i in ids:
        out[f"u{i % 7}"] = out.get(f"u{i % 7}", 0) + 1
    return out


def test_a_thousand_batches_fold_to_few_files(spark, tmp):
    archive = TopicArchive(f"{tmp}/archive", "app", INP, "at", fold_rows=3_000)
    for b in range(1000):
        write_batch(tmp, "live0", b, [row(5 * b + k) for k in range(5)], [f"bad{b}"] if b % 100 == 0 else ())
        if b % 500 == 499:
            archive.compact(spark, ended=["live0"] if b == 999 else ())
    m = archive.manifest(spark)
    assert m.number == 2 and m.folded == {"live0": 999}
    assert set(m.dates) == {NO_DATE, *(f"2024-03-{d:02d}" for d in range(1, 11))}
    assert sum(n for held in m.dates.values() for _, n in held) == 5010
    assert all(len(held) == 1 for held in m.dates.values()) and len(files(tmp, m)) <= 2 * len(m.dates)
    every = archive.read(spark).collect()
    assert sorted(r["id"] for r in every if r["id"] is not None) == list(range(5000))
    assert sorted(r["_corrupt_record"] for r in every if r["_bad_reason"]) == sorted(f"bad{b}" for b in range(0, 1000, 100))
    # Dates are read by themselves: files of others may be unreadable.
    data = f"{tmp}/archive/app/_folded/clicks/data"
    for folder in [f"{data}/{g}/{d}" for g in os.listdir(data) if g.startswith("gen") for d in os.listdir(f"{data}/{g}") if d == "date=2024-03-06"]:
        for name in os.listdir(folder):
            with open(f"{folder}/{name}", "wb"):
                pass
    some = archive.read(spark, date(2024, 3, 4), date(2024, 3, 5))
    want = [i for i in range(5000) if (t := row(i)[2]) and t.date() in (date(2024, 3, 4), date(2024, 3, 5))]
    assert sorted(r["id"] for r in some.collect()) == want


def test_fold_rows_bounds_what_is_written_again(spark, tmp):
    archive = TopicArchive(f"{tmp}/archive", "app", INP, "at", fold_rows=40)
    for b in range(6):
        write_batch(tmp, "live0", b, [(30 * b + k, "u", START) for k in range(30)])
        archive.compact(spark, ended=["live0"])
    [held] = archive.manifest(spark).dates.values()
    assert [n for _, n in held] == [60, 60, 60]
    assert archive.read(spark).count() == 180


def test_newest_batch_is_not_folded_and_may_be_written_again(spark, tmp):
    archive = TopicArchive(f"{tmp}/archive", "app", INP, "at")
    write_batch(tmp, "live0", 0, [row(1)])
    assert archive.compact(spark) == Manifest()
    write_batch(tmp, "live0", 1, [row(2)])
    assert archive.compact(spark).folded == {"live0": 0}
    write_batch(tmp, "live0", 1, [row(3)])
    assert sorted(r["id"] for r in archive.read(spark).collect()) == [1, 3]
    assert archive.compact(spark, ended=["live0"]).folded == {"live0": 1}
    assert sorted(r["id"] for r in archive.read(spark).collect()) == [1, 3]
    assert archive.compact(spark, ended=["live0"]).number == 2  # nothing new


def test_replay_before_during_and_after(spark, tmp):
    cfg = config(tmp)
    for b in range(20):
        write_batch(tmp, "live0", b, [row(10 * b + k) for k in range(10)], ["x"])
    before, during = replace(cfg, run_id="before", code_version=1), replace(cfg, run_id="during", code_version=2)
    replay_job(spark, before, totals).awaitTermination()
    replay_job(spark, during, totals).awaitTermination()
    assert latest(spark, before, "before") == expected(range(200))
    fold_archive_job(spark, cfg, "at")
    for b in range(20, 30):
        write_batch(tmp, "live0", b, [row(10 * b + k) for k in range(10)])
    fold_archive_job(spark, cfg, "at", expire=True)
    # The replay that began before goes on with what came since, and no more.
    replay_job(spark, during, totals).awaitTermination()
    got = {r["who"]: r["n"] for r in feature_store(during).latest(spark, 2, run_id="during").collect()}
    assert got == expected(range(300))
    after = replace(cfg, run_id="after", code_version=3)
    replay_job(spark, after, totals, max_files_per_trigger=3).awaitTermination()
    assert {r["who"]: r["n"] for r in feature_store(after).latest(spark, 3, run_id="after").collect()} == expected(range(300))


def test_expire_keeps_what_a_pin_needs(spark, tmp):
    cfg = config(tmp)
    archive = topic_archive(cfg, INP, "at")
    for b in range(4):
        write_batch(tmp, "live0", b, [row(b)])
    assert archive.pin(spark, "reader").number == 0
    for last in (2, 3, 4):
        archive.compact(spark, ended=["live0"])
        write_batch(tmp, "live0", 2 + last, [row(2 + last)])
    assert archive.expire(spark) == (0, 0)  # the pinned reader needs every raw batch
    archive.unpin(spark, "reader")
    first = archive.pin(spark, "later").number
    assert archive.expire(spark)[0] == 5
    assert sorted(r["id"] for r in archive.read(spark, manifest=archive.manifest(spark, first)).collect()) == list(range(7))
    archive.compact(spark, ended=["live0"])
    assert sorted(r["id"] for r in archive.read(spark).collect()) == list(range(7))
    write_batch(tmp, "live0", 9, [row(9)])
    archive.compact(spark, ended=["live0"])
    archive.expire(spark)
    assert archive.manifest(spark, first).number == first and archive.pin(spark, "later").number == first
    assert sorted(r["id"] for r in archive.read(spark, manifest=archive.manifest(spark, first)).collect())[:7] == list(range(7))
    end_replay(spark, cfg)


def test_two_compactions_at_once(spark, tmp, monkeypatch):
    """The second one loses the manifest; its folder is deleted later."""
    archive = TopicArchive(f"{tmp}/archive", "app", INP, "at")
    for b in range(3):
        write_batch(tmp, "live0", b, [row(b)])
    import featureflow.operators.archive as A

    plain = A.create_marker

    def late(spark_, path, text):
        if "/manifests/" in path and not list(p for p in os.listdir(f"{tmp}/archive/app/_folded/clicks") if p == "manifests"):
            monkeypatch.setattr(A, "create_marker", plain)
            archive.compact(spark)  # the other one, first to finish
        return plain(spark_, path, text)

    monkeypatch.setattr(A, "create_marker", late)
    m = archive.compact(spark)
    assert m.number == 1 and sorted(r["id"] for r in archive.read(spark).collect()) == [0, 1, 2]
    data = f"{tmp}/archive/app/_folded/clicks/data"
    assert len(list_dirs(spark, data)) == 2
    for b in (3, 4):
        write_batch(tmp, "live0", b, [row(b)])
        archive.compact(spark)
    archive.expire(spark)
    assert {d.removeprefix("generation=") for d in list_dirs(spark, data)} >= archive.manifest(spark).generations
    assert sorted(r["id"] for r in archive.read(spark).collect()) == [0, 1, 2, 3, 4]


def test_a_manifest_that_is_cut_off_is_an_error(spark, tmp):
    archive = TopicArchive(f"{tmp}/archive", "app", INP)
    os.makedirs(f"{tmp}/archive/app/_folded/clicks/manifests")
    with open(f"{tmp}/archive/app/_folded/clicks/manifests/00000001", "w") as f:
        f.write('{"number": 1')
    with pytest.raises(json.JSONDecodeError):
        archive.read(spark)
    with pytest.raises(ValueError, match="no column"):
        TopicArchive(f"{tmp}/archive", "app", INP, "unknown")


def test_empty_archive(spark, tmp):
    archive = TopicArchive(f"{tmp}/archive", "app", INP)
    assert archive.read(spark).collect() == [] and archive.compact(spark) == Manifest() and archive.expire(spark) == (0, 0)
    cfg = config(tmp)
    assert len(ordered_replay_job(spark, cfg, totals)) == 1
    assert feature_store(cfg).latest(spark, 1).collect() == []


WINDOWS = TableSpec(["window_start", "who"], [
    {"name": "window_start", "type": "timestamp"}, {"name": "window_end", "type": "timestamp"},
    {"name": "who", "type": "string"}, {"name": "n", "type": "long"}])


def test_ordered_replay_drops_nothing(spark, tmp):
    """Batches in any order: without a tolerance for late rows, every one is
    counted, in the slices of the dates and in the tail."""
    rng = random.Random(4)
    ids = [i for i in range(1, 600) if i % 50]
    rng.shuffle(ids)
    for b, at in enumerate(range(0, len(ids), 20)):
        write_batch(tmp, "live0", b, [row(i) for i in ids[at:at + 20]])
    cfg = config(tmp, run_id="ordered")
    cfg = replace(cfg, table=WINDOWS)
    fold_archive_job(spark, cfg, "at", ended=["live0"])
    late = START + timedelta(days=10)
    tail = [(1000 + k, "u0", late + timedelta(hours=k)) for k in range(30)]
    write_batch(tmp, "live1", 0, tail)

    def process(dfs):
        return windowed_count(dfs[0], ["who"], "at", "1 day", watermark="0 seconds", out="n")

    done = ordered_replay_job(spark, cfg, process, "at", slice_rows=150)
    assert len(done) == 6 and sum(map(dropped_rows, done)) == 0
    got = {(r["window_start"].date(), r["who"]): r["n"] for r in feature_store(cfg).latest(spark, 1, run_id="ordered").collect()}
    want = {}
    for _, who, at in [row(i) for i in ids] + tail:
        want[at.date(), who] = want.get((at.date(), who), 0) + 1
    assert got == want
    assert len(ordered_replay_job(spark, cfg, process, "at", slice_rows=150)) == 1  # again: only what is not folded is looked at
    got = {(r["window_start"].date(), r["who"]): r["n"] for r in feature_store(cfg).latest(spark, 1, run_id="ordered").collect()}
    assert got == want
    assert archive_base(cfg).endswith("/archive")

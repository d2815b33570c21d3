"""The registry with several writers, and its folds."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

import pytest

from featureflow.operators import registry
from featureflow.session import create_marker, list_dirs, list_files

FIELDS = [{"name": "a", "type": "long"}]


def requests(spark, apps):
    rows = [("o", app, k, datetime(2024, 1, 1), ["a"], [("a", "long")]) for k, app in enumerate(apps)]
    return spark.createDataFrame(rows, registry.REQUEST_SCHEMA)


def versions(spark, root, app):
    return sorted(r["code_version"] for r in registry.history_of(spark, root, "o", app).collect())


def test_writers_at_the_same_time(spark, tmp):
    """Four writers, each with single registrations and a table of requests."""
    def write(k):
        got = [registry.register_schema(spark, tmp, "o", "x", ["a"], FIELDS) for _ in range(3)]
        rows = registry.register(spark, tmp, requests(spark, ["x", f"own{k}", "x"])).collect()
        return got + [r["code_version"] for r in rows if r["app"] == "x"]

    with ThreadPoolExecutor(4) as pool:
        given = [v for own in pool.map(write, range(4)) for v in own]
    assert sorted(given) == list(range(1, 21)) == versions(spark, tmp, "x")
    assert all(versions(spark, tmp, f"own{k}") == [1] for k in range(4))
    assert len(list_dirs(spark, f"{tmp}/data")) == 16  # lost attempts are gone


def test_a_lost_race_is_assigned_again(spark, tmp, monkeypatch):
    plain, lost = registry.create_marker, []

    def late(spark_, path, text):
        if not lost:
            lost.append(path)
            monkeypatch.setattr(registry, "create_marker", plain)
            registry.register(spark, tmp, requests(spark, ["x", "x"]))
        return plain(spark_, path, text)

    monkeypatch.setattr(registry, "create_marker", late)
    assert registry.register_schema(spark, tmp, "o", "x", ["a"], FIELDS) == 3
    assert versions(spark, tmp, "x") == [1, 2, 3]


def test_folds_keep_the_history_small(spark, tmp, monkeypatch):
    monkeypatch.setattr(registry, "FOLD_EVERY", 6)
    apps = ["x", "y", "x", "z"]
    for k in range(32):
        assert registry.register_schema(spark, tmp, "o", apps[k % 4], ["a"], FIELDS) == sum(a == apps[k % 4] for a in (apps * 8)[:k + 1])
    # Two folds and what came since the first of them, whatever came before.
    assert len(list_dirs(spark, f"{tmp}/data")) <= 2 * 2 + 2 * 6 and len(list_files(spark, f"{tmp}/folds")) <= 2
    assert versions(spark, tmp, "x") == list(range(1, 17))
    assert registry.read_history(spark, tmp).count() == 32
    current = {r["app"]: r["code_version"] for r in registry.read_current(spark, tmp).collect()}
    assert current == {"x": 16, "y": 8, "z": 8}
    # The summary holds a row per app, whatever their histories.
    registry.fold_history(spark, tmp)
    files = registry._state(spark, tmp).folders("current")
    assert len(files) == 1 and spark.read.parquet(*files).count() == 3
    assert registry.fold_history(spark, tmp) == 32


def test_a_reader_of_the_previous_fold_still_finds_its_rows(spark, tmp):
    registry.register(spark, tmp, requests(spark, ["x", "y"]))
    registry.fold_history(spark, tmp)
    registry.register(spark, tmp, requests(spark, ["x"]))
    before = registry.read_history(spark, tmp)  # lists its folders now
    registry.fold_history(spark, tmp)
    assert before.count() == 3 == registry.read_history(spark, tmp).count()


def test_writers_give_up(spark, tmp, monkeypatch):
    monkeypatch.setattr(registry, "ATTEMPTS", 2)
    monkeypatch.setattr(registry, "create_marker", lambda *a: False)
    with pytest.raises(RuntimeError, match="other writers"):
        registry.register_schema(spark, tmp, "o", "x", ["a"], FIELDS)
    assert list_dirs(spark, f"{tmp}/data") == []


def test_markers_have_one_winner(spark, tmp):
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda k: create_marker(spark, f"{tmp}/m/one", str(k)), range(40)))
    assert sum(won) == 1

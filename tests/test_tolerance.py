"""Comparing floating-point results within a tolerance."""

from __future__ import annotations

import random

import pytest

from featureflow.operators.checks import assert_rows, compare_rows

SCHEMA = "k string, x double, y float, n long"


def report(spark, actual, expected, tolerance=1e-9):
    a, e = (spark.createDataFrame(rows, SCHEMA) for rows in (actual, expected))
    return sorted((tuple(r) for r in compare_rows(a, e, tolerance).collect()), key=str)


def test_within_and_beyond(spark):
    expected = [("a", 0.3, 1.5, 1), ("a", 0.3, 1.5, 1), ("b", 1.0, None, 2), ("c", float("nan"), 0.0, 3), ("d", float("inf"), 0.0, 4)]
    actual = [("a", 0.1 + 0.2, 1.5, 1), ("a", 0.3, 1.5, 1), ("b", 1.0 + 1e-8, None, 2), ("c", float("nan"), -0.0, 3), ("d", float("inf"), 0.0, 4)]
    assert report(spark, actual, expected) == sorted(
        [("b", 1.0 + 1e-8, None, 2, "extra", 1, ["x"]), ("b", 1.0, None, 2, "missing", 1, ["x"])], key=str)
    assert len(report(spark, actual, expected, None)) >= 4
    assert report(spark, actual, expected, 1e-6) == []


def test_other_columns_must_be_equal(spark):
    assert [r[4:] for r in report(spark, [("a", 1.0, 1.0, 1)], [("a", 1.0, 1.0, 2)], 10.0)] == [("extra", 1, None), ("missing", 1, None)]


def test_surplus_rows_and_counts(spark):
    expected = [("a", 1.0, 2.0, 1)] * 5
    actual = [("a", 1.0 + 1e-10, 2.0, 1)] * 3 + [("a", 1.0 - 1e-10, 2.0, 1)] * 4
    [row] = report(spark, actual, expected)
    assert row[0] == "a" and row[4:] == ("extra", 2, None)


@pytest.mark.parametrize("seed", range(4))
def test_noise_is_no_difference_and_changes_are(spark, seed):
    """Rows moved by noise cancel, whatever the ties; planted ones are reported."""
    rng = random.Random(seed)
    rows = [(rng.choice("abc"), float(rng.randint(0, 5)), float(rng.randint(0, 3)), rng.randint(0, 2)) for _ in range(300)]
    noisy = [(k, x + rng.uniform(-1e-10, 1e-10), y, n) for k, x, y, n in rows]
    rng.shuffle(noisy)
    assert report(spark, noisy, rows) == []
    assert_rows(*(spark.createDataFrame(r, SCHEMA) for r in (noisy, rows)), tolerance=1e-9)
    moved = [(k, x + 100 * (i < 7), y, n) for i, (k, x, y, n) in enumerate(noisy)]
    got = report(spark, moved, rows)
    assert sum(r[5] for r in got if r[4] == "missing") == 7 == sum(r[5] for r in got if r[4] == "extra")
    assert all(round(r[1]) >= 100 for r in got if r[4] == "extra")
    # A row that stands for several is paired once.
    assert all(r[6] is None or "x" in r[6] for r in got) and any(r[6] for r in got)
    with pytest.raises(AssertionError, match="differs"):
        assert_rows(*(spark.createDataFrame(r, SCHEMA) for r in (moved, rows)), tolerance=1e-9)

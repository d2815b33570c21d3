"""Checking a function's output against expected rows.

The comparison is a multiset difference done as one aggregation: expected
rows count +1, actual rows -1, grouped on all columns.  Duplicates of one
row, however many, are combined map-side before the shuffle, and the report
has one line per distinct differing row with its surplus count.

Expected values come as JSON numbers, so floating-point results may be compared
within a tolerance.  What differs exactly is sorted by each floating-point column
in turn, within rows that are equal in all others; neighbours within the tolerance
are one cluster, and a cluster's rows cancel however they are paired (a chain of
values, each near the next, counts as near).  Only differing rows are sorted.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featureflow.functions.schema import quote
from featureflow.sources.files import json_frame


def _groupable(value: Column, dtype: T.DataType) -> Column:
    """A value that can be grouped: maps, at any depth, as entries sorted by
    key, so equal maps are equal whatever the order of their entries."""
    if isinstance(dtype, T.MapType):
        entries = F.transform(F.map_entries(value), lambda e: F.struct(
            _groupable(e["key"], dtype.keyType).alias("key"), _groupable(e["value"], dtype.valueType).alias("value")))
        return F.array_sort(entries)
    if isinstance(dtype, T.ArrayType) and _has_map(dtype):
        return F.transform(value, lambda e: _groupable(e, dtype.elementType))
    if isinstance(dtype, T.StructType) and _has_map(dtype):
        fields = [_groupable(value[f.name], f.dataType).alias(f.name) for f in dtype.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def _has_map(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.MapType):
        return True
    if isinstance(dtype, T.ArrayType):
        return _has_map(dtype.elementType)
    return isinstance(dtype, T.StructType) and any(_has_map(f.dataType) for f in dtype.fields)


def _comparable(df: DataFrame) -> DataFrame:
    return df.select(*[_groupable(F.col(quote(f.name)), f.dataType).alias(f.name) for f in df.schema.fields])


def _aligned(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """``actual`` in ``expected``'s column order and types, with ``_exact``:
    false for rows of which a value does not survive the change of type."""
    if set(actual.columns) != set(expected.columns) or len(actual.columns) != len(expected.columns):
        raise ValueError(f"output columns {actual.columns} are not the expected {expected.columns}")
    exact, cols = F.lit(True), []
    for f in expected.schema.fields:
        value, have = F.col(quote(f.name)), actual.schema[f.name].dataType
        if have != f.dataType:
            there = value.try_cast(f.dataType)
            if isinstance(have, T.AtomicType) and isinstance(f.dataType, T.AtomicType):
                exact = exact & there.try_cast(have).eqNullSafe(value)
            value = there
        cols.append(value.alias(f.name))
    return actual.select(*cols, exact.alias(EXACT))


EXACT = "_exact"


def compare_rows(actual: DataFrame, expected: DataFrame, tolerance: float | None = None) -> DataFrame:
    """Rows of ``expected`` missing from ``actual`` (``side = 'missing'``) and
    rows of ``actual`` not expected (``side = 'extra'``), with ``n_rows``.

    Both must have the same columns.  ``actual`` is cast to ``expected``'s
    types; a row with a value that the cast changes (1.9 to a whole number)
    equals no expected row.  Maps are reported as sorted entries.  With a
    ``tolerance`` floating-point columns may differ by that much; rows that are
    still unmatched but equal in all other columns are paired in their order,
    and ``differs`` names the columns in which the two of a pair differ."""
    cols = expected.columns
    exp = _comparable(expected).withColumn(EXACT, F.lit(True))
    aligned = _aligned(actual, expected)
    act = _comparable(aligned)
    tagged = exp.withColumn("_d", F.lit(1).cast("long")).unionByName(
        act.withColumn("_d", F.lit(-1).cast("long")))
    net = tagged.groupBy(*[F.col(quote(c)) for c in cols], EXACT).agg(F.sum("_d").alias("_net"))
    net = net.filter(F.col("_net") != 0)
    more = []
    if tolerance is not None:
        floats = [f.name for f in expected.schema.fields if isinstance(f.dataType, T.FloatType | T.DoubleType)]
        net = _differences(_beyond(net, floats, tolerance), floats, tolerance)
        more = [F.col("differs")]
    return net.select(
        *[F.col(quote(c)) for c in cols],
        F.when(F.col("_net") > 0, F.lit("missing")).otherwise(F.lit("extra")).alias("side"),
        F.abs(F.col("_net")).alias("n_rows"), *more)


def _near(a: Column, b: Column, tolerance: float) -> Column:
    return F.coalesce(a.eqNullSafe(b) | (F.abs(a - b) <= tolerance), F.lit(False))


def _beyond(net: DataFrame, floats: list[str], tolerance: float) -> DataFrame:
    """What is left when rows within the tolerance have cancelled."""
    group = [F.col(quote(c)) for c in net.columns if c not in (*floats, "_net")]
    for k, c in enumerate(floats):
        value = F.col(quote(c))
        order = W.partitionBy(*group).orderBy(value)
        net = net.withColumn("_new", (~_near(value, F.lag(value).over(order), tolerance)).cast("int"))
        net = net.withColumn(f"_cluster{k}", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
        group.append(F.col(f"_cluster{k}"))
    side = F.signum("_net")
    held = W.partitionBy(*group, side).orderBy(*(F.col(quote(c)) for c in floats)).rowsBetween(W.unboundedPreceding, 0)
    net = net.withColumns({"_sum": F.sum("_net").over(W.partitionBy(*group)), "_upto": F.sum(F.abs("_net")).over(held)})
    # The first rows of the side that has more of them stay.
    left = F.least(F.abs("_net"), F.abs("_sum") - F.col("_upto") + F.abs("_net"))
    net = net.where((side == F.signum("_sum")) & (left > 0)).withColumn("_net", (side * left).cast("long"))
    return net.drop("_new", "_sum", "_upto", *(f"_cluster{k}" for k in range(len(floats))))


def _differences(net: DataFrame, floats: list[str], tolerance: float) -> DataFrame:
    """``differs``: the floating-point columns in which a row differs from the
    one it is paired with, null if there is none."""
    group = [c for c in net.columns if c not in (*floats, "_net")]
    side = (F.col("_net") > 0).alias("_side")
    order = W.partitionBy(*(F.col(quote(c)) for c in group), F.col("_side")).orderBy(*(F.col(quote(c)) for c in floats))
    rows = net.withColumn("_side", side).withColumn("_place", F.row_number().over(order))
    key = F.struct(*(F.col(quote(c)) for c in group if c != EXACT), F.col("_place"))
    both = W.partitionBy(key)
    one, other = (F.first(F.when(F.col("_side") == F.lit(s), F.struct(F.lit(1).alias("_is"), *(F.col(quote(c)) for c in floats))),
                          ignorenulls=True).over(both) for s in (True, False))
    rows = rows.withColumns({"_one": one, "_other": other})
    differs = F.filter(F.array(*(F.when(~_near(F.col("_one")[c], F.col("_other")[c], tolerance), F.lit(c)) for c in floats)),
                       lambda c: c.isNotNull()) if floats else F.lit(None).cast("array<string>")
    return rows.withColumn("differs", F.when(F.col("_one").isNotNull() & F.col("_other").isNotNull(), differs)).drop(
        "_side", "_place", "_one", "_other")


def expected_frame(spark: SparkSession, rows: list[dict] | str, schema: Any) -> DataFrame:
    """Expected rows, as JSON objects or a folder of JSON lines, typed by the
    output schema.  A value that is not of its field's type fails."""
    return json_frame(spark, rows, schema)


def assert_rows(actual: DataFrame, expected: DataFrame, show: int = 20, tolerance: float | None = None) -> None:
    """Raise ``AssertionError`` listing differing rows (``show`` of them in the
    message; the comparison covers all)."""
    report = compare_rows(actual, expected, tolerance)
    sample = report.limit(show).collect()
    if sample:
        lines = "\n".join(str(r.asDict()) for r in sample)
        raise AssertionError(f"output differs from the expected rows:\n{lines}")

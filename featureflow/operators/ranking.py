"""Per-key running counts that stay balanced when one key is huge.

``count_preceding`` gives every row the (weighted) number of rows with the
same key that sort strictly before it.  A window partitioned by the key
would put a hot key, possibly a third of all rows, into one task.  Instead:

1. range-partition on (key, order): Spark samples the sort keys, so a hot
   key is spread over many partitions, each holding a contiguous slice;
2. inside each partition, count locally over the sorted Arrow batches;
3. summarise each partition by its first key, its last key and the last
   key's local total (one row per partition), derive for each partition the
   count its first key already has in earlier partitions, and add that
   offset.

The offsets table has at most one row per partition, a size fixed by the
partition count, so broadcasting it is safe.  Rows and summaries come from
one pass over one shuffle, written once as a table in the shared checkpoint
folder.
"""

from __future__ import annotations

import sys
from typing import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featureflow.functions.schema import quote
from featureflow.session import scratch_dir

PID = "_pid"

# The per-partition functions below run in Python workers; shipping this
# module's code with them means executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _same_as_previous(batch: pa.RecordBatch, keys: Sequence[str]) -> np.ndarray:
    """Row i equals row i-1 on all keys (nulls equal); entry 0 is False."""
    n = batch.num_rows
    same = np.ones(n, dtype=bool)
    same[0] = False
    if n < 2:
        return same
    for k in keys:
        col = batch.column(k)
        cur, prev = col.slice(1), col.slice(0, n - 1)
        try:
            eq = pc.fill_null(pc.equal(cur, prev), False)
        except pa.ArrowNotImplementedError:  # nested keys: compare as values
            a, b = cur.to_pylist(), prev.to_pylist()
            same[1:] &= np.fromiter((x == y for x, y in zip(a, b)), dtype=bool, count=n - 1)
            continue
        both_null = pc.and_(pc.is_null(cur), pc.is_null(prev))
        equal = pc.or_(eq, both_null)
        if pa.types.is_floating(col.type):  # Spark groups NaN with NaN
            both_nan = pc.fill_null(pc.and_(pc.is_nan(cur), pc.is_nan(prev)), False)
            equal = pc.or_(equal, both_nan)
        same[1:] &= equal.to_numpy(zero_copy_only=False)
    return same


def _same_key(a: tuple, b: tuple) -> bool:
    """Key tuples equal as Spark groups them (None == None, NaN == NaN)."""
    return len(a) == len(b) and all(
        x == y or (x is None and y is None)
        or (isinstance(x, float) and isinstance(y, float) and x != x and y != y)
        for x, y in zip(a, b))


def _key_at(batch: pa.RecordBatch, keys: Sequence[str], i: int) -> tuple:
    return tuple(batch.column(k)[i].as_py() for k in keys)


def _scan(batches: Iterator[pa.RecordBatch], keys: Sequence[str], weight: str):
    """Yield (batch, before, state) with counts carried across batches.

    ``before[i]`` is the weight of earlier rows of row i's key within this
    partition.  ``state`` ends with the partition's first key, its last key
    and the last key's total weight in the partition.
    """
    state = {"key": None, "run": 0, "first_key": None, "seen": False}
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        w = batch.column(weight).to_numpy(zero_copy_only=False).astype(np.int64)
        new = ~_same_as_previous(batch, keys)
        first = _key_at(batch, keys, 0)
        new[0] = not (state["seen"] and _same_key(first, state["key"]))
        pre = np.cumsum(w) - w
        start = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        before = np.where(start >= 0, pre - pre[np.maximum(start, 0)], pre + state["run"])
        if not state["seen"]:
            state["first_key"] = first
            state["seen"] = True
        state["key"] = _key_at(batch, keys, n - 1)
        state["run"] = int(before[-1] + w[-1])
        yield batch, before, state


def count_preceding(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                    weight: str, id_cols: Sequence[str], out: str = "n_before",
                    emit: str | None = None, num_partitions: int | None = None,
                    carry: Sequence[str] = ()) -> DataFrame:
    """``(keys..., id_cols..., carry..., out)``: per row, the sum of ``weight``
    over rows of the same ``keys`` that sort strictly before it by ``order``
    (ascending, nulls first).  Rows equal on keys and order are ordered
    arbitrarily among themselves, so give ``order`` a unique tail where that
    matters.  With ``emit`` (a boolean column) only those rows are returned.
    ``carry`` columns ride along unchanged, which saves joining back.
    """
    spark = df.sparkSession
    keys, order, id_cols = list(keys), list(order), list(id_cols)
    sort_cols = [*keys, *order]
    carried = [*dict.fromkeys([*keys, *order, *id_cols, *carry, weight] + ([emit] if emit else []))]
    base = df.select(*[F.col(quote(c)) for c in carried])
    # Without an explicit count the shuffle uses spark.sql.shuffle.partitions
    # and AQE may merge small neighbouring partitions; merging keeps the key
    # order, which is all the offsets below rely on.
    range_cols = [F.col(quote(c)) for c in sort_cols]
    parted = (base.repartitionByRange(num_partitions, *range_cols) if num_partitions
              else base.repartitionByRange(*range_cols))
    ranged = parted.sortWithinPartitions(*range_cols)
    fields = {f.name: f for f in base.schema.fields}

    key_fields = [fields[k] for k in keys]
    ids_only = [c for c in dict.fromkeys([*id_cols, *carry]) if c not in keys]
    # One pass emits the rows (_tag 0) and, last, one summary row per
    # partition (_tag 1): first key in the key columns, last key and its
    # local total in the _l columns.
    all_schema = T.StructType(
        [T.StructField(PID, T.IntegerType(), False), T.StructField("_tag", T.IntegerType(), False)]
        + [T.StructField(f.name, f.dataType, True) for f in key_fields]
        + [T.StructField(c, fields[c].dataType, True) for c in ids_only]
        + [T.StructField(out, T.LongType(), True)]
        + [T.StructField(f"_l_{i}", f.dataType, True) for i, f in enumerate(key_fields)]
        + [T.StructField("_l_w", T.LongType(), True)])
    arrow_schema = pa.schema([pa.field(f.name, _arrow_type(f.dataType)) for f in all_schema.fields])

    def one_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        state = None
        for batch, before, state in _scan(batches, keys, weight):
            n = batch.num_rows
            cols = {PID: pa.array(np.full(n, pid, dtype=np.int32)),
                    "_tag": pa.array(np.zeros(n, dtype=np.int32))}
            for c in [*keys, *ids_only]:
                column, want = batch.column(c), arrow_schema.field(c).type
                cols[c] = column if column.type == want else column.cast(want)
            cols[out] = pa.array(before, type=pa.int64())
            for i, f in enumerate(key_fields):
                cols[f"_l_{i}"] = pa.nulls(n, type=arrow_schema.field(f"_l_{i}").type)
            cols["_l_w"] = pa.nulls(n, type=pa.int64())
            res = pa.RecordBatch.from_pydict(cols, schema=arrow_schema)
            if emit:
                res = res.filter(pc.fill_null(batch.column(emit), False))
            if res.num_rows:
                yield res
        if state is None or not state["seen"]:
            return
        row = {PID: [pid], "_tag": [1]}
        for k, v in zip(keys, state["first_key"]):
            row[k] = [v]
        for c in ids_only:
            row[c] = [None]
        row[out] = [None]
        for i, v in enumerate(state["key"]):
            row[f"_l_{i}"] = [v]
        row["_l_w"] = [state["run"]]
        yield pa.RecordBatch.from_pydict(row, schema=arrow_schema)

    # Range bounds are sampled per shuffle, so the rows and the summary must
    # come from the same shuffle: write the pass once as a table in the
    # shared checkpoint folder and read it back (this also cuts the lineage,
    # so lost executors never re-sample).
    path = scratch_dir(spark, "ranking")
    ranged.mapInArrow(one_pass, all_schema).write.parquet(path)
    passed = spark.read.schema(all_schema).parquet(path)

    summ = passed.filter(F.col("_tag") == 1)
    kcols = [f"_k{i}" for i in range(len(keys))]
    # Offsets: for partition p, the weight its first key has in partitions
    # before p.  Contributions come from each partition's last key; requests
    # (weight 0) sort before contributions of the same partition.
    sides = F.explode(F.array(
        F.struct(*[F.col(f"_l_{i}").alias(kcols[i]) for i in range(len(keys))],
                 F.col("_l_w").alias("_c"), F.lit(1).alias("_kind")),
        F.struct(*[F.col(quote(k)).alias(kcols[i]) for i, k in enumerate(keys)],
                 F.lit(0).cast("long").alias("_c"), F.lit(0).alias("_kind"))))
    win = (Window.partitionBy(*kcols).orderBy(PID, "_kind")
           .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    offsets = (summ.select(F.col(PID), sides.alias("_s")).select(PID, "_s.*")
               .withColumn("_off", F.sum("_c").over(win))
               .filter((F.col("_kind") == 0) & (F.col("_off") > 0))
               .select(F.col(PID).alias("_opid"), *kcols, "_off"))

    counted = passed.filter(F.col("_tag") == 0)
    cond = F.col(PID) == F.col("_opid")
    for i, k in enumerate(keys):
        cond = cond & F.col(quote(k)).eqNullSafe(F.col(kcols[i]))
    # At most one offset row per partition: a size bound, so broadcast.
    joined = counted.join(F.broadcast(offsets), cond, "left")
    return joined.select(*[F.col(quote(c)) for c in [*keys, *ids_only]],
                         (F.col(out) + F.coalesce(F.col("_off"), F.lit(0))).alias(out))


def _arrow_type(dtype: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(dtype)

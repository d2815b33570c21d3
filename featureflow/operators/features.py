"""Feature operators: trailing counts, windowed stream counts, interval joins.

"count of logins in the last 30 days per account" has two forms: on a batch
frame every row gets its trailing count; on a stream, counts are kept per
event-time window and key, emitted as they change.
"""

from __future__ import annotations

import re
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featureflow.functions.schema import quote
from featureflow.functions.time import epoch_micros, to_instant, to_wall_clock
from featureflow.operators.ranking import count_preceding

# Microseconds per interval unit.
_UNIT_MICROS = {
    "microsecond": 1,
    "millisecond": 1_000,
    "second": 1_000_000,
    "minute": 60_000_000,
    "hour": 3_600_000_000,
    "day": 86_400_000_000,
    "week": 604_800_000_000,
}
_INTERVAL = re.compile(r"^\s*(-?\d+)\s*([a-z]+?)s?\s*$")


def interval_micros(text: str) -> int:
    """``"7 days"`` -> microseconds (fixed-length units only; may be negative)."""
    m = _INTERVAL.match(text.lower())
    if not m or m.group(2) not in _UNIT_MICROS:
        raise ValueError(f"unsupported interval {text!r}")
    return int(m.group(1)) * _UNIT_MICROS[m.group(2)]


def _micros_interval(us: int) -> Column:
    return F.expr(f"INTERVAL '{us / 1_000_000:.6f}' SECOND")


def trailing_count(df: DataFrame, keys: Sequence[str], ts: str, width: str | Sequence[str],
                   id_col: str | None = None, out: str | Sequence[str] = "n_events") -> DataFrame:
    """Every row of ``df`` plus ``out``: rows of the same key with time in
    ``[ts - width, ts]`` (the row itself and ties included), as a SQL range
    window would give.  Several widths (with as many output names) are
    computed in the same pass.  Rows are told apart by a number of their own,
    so repeated rows, repeated ids and null ids are counted like any other
    (``id_col`` is not needed and kept for callers that name it).

    For each row one probe is placed at ``ts`` (after ties) and one at
    ``ts - width`` (before ties) per width; each count is the difference of
    the running counts at two probes.  Running counts come from
    ``count_preceding``, which splits hot keys across partitions, so one sort
    serves every width.  The row itself rides on its probe after ties, so the
    input is read once and nothing is joined back.  Rows with a null time get
    null counts.
    """
    widths = [width] if isinstance(width, str) else list(width)
    outs = [out] if isinstance(out, str) else list(out)
    if len(widths) != len(outs):
        raise ValueError("give one output name per width")
    w_us = [interval_micros(w) for w in widths]
    if any(w < 0 for w in w_us):
        raise ValueError("width must not be negative")
    names = [f"_key{i}" for i in range(len(keys))]
    t = F.col(quote(ts))
    last = F.struct(t.alias("_t"), F.lit(2).alias("_kind"), F.lit(-1).alias("_idx"))
    probes = F.array(
        *[F.struct((t - _micros_interval(us)).alias("_t"), F.lit(0).alias("_kind"),
                   F.lit(i).alias("_idx")) for i, us in enumerate(w_us)],
        F.struct(t.alias("_t"), F.lit(1).alias("_kind"), F.lit(-1).alias("_idx")),
        last,
    )
    # Numbered before the probes are made: all probes of a row share its number.
    rows = (df.withColumn("_row", F.monotonically_increasing_id())
            .select(*[F.col(quote(k)).alias(n) for k, n in zip(keys, names)], "_row",
                    F.struct(*[F.col(quote(c)) for c in df.columns]).alias("_all"),
                    F.explode(F.when(t.isNotNull(), probes).otherwise(F.array(last))).alias("_p"))
            .select(*names, "_row", "_p._t", "_p._kind", "_p._idx",
                    F.when(F.col("_p._kind") == 2, F.col("_all")).alias("_all"))
            .withColumn("_w", (F.col("_kind") == 1).cast("long"))
            .withColumn("_emit", F.col("_kind") != 1))
    counted = count_preceding(rows, names, ["_t", "_kind"], "_w", ["_row", "_kind", "_idx"],
                              out="_n", emit="_emit", carry=["_all"])
    upper = F.max(F.when(F.col("_kind") == 2, F.col("_n")))
    per_row = counted.groupBy("_row").agg(F.first("_all", ignorenulls=True).alias("_all"), *[
        (upper - F.max(F.when((F.col("_kind") == 0) & (F.col("_idx") == i), F.col("_n"))))
        .alias(f"_out{i}") for i in range(len(outs))])
    return per_row.select(*[F.col("_all")[c].alias(c) for c in df.columns],
                          *[F.col(f"_out{i}").alias(o) for i, o in enumerate(outs)])


def windowed_count(stream: DataFrame, keys: Sequence[str], ts: str, window: str,
                   watermark: str, out: str = "n_events", slide: str | None = None) -> DataFrame:
    """Counts per event-time window and key (tumbling, or sliding by
    ``slide``: "30 days" windows every "1 day" give a daily-refreshed
    30-day count).  Use update mode to see counts as they change, append
    mode to get each window once it is closed by the watermark.

    ``ts`` may be wall-clock ``timestamp_ntz``; it is turned into an instant
    for the watermark and the window, and window bounds come back as
    ``timestamp_ntz``.  Rows later than the watermark are dropped.
    """
    dtype = stream.schema[ts].dataType
    timed = stream.withColumn("_et", to_instant(F.col(quote(ts)), dtype)).withWatermark("_et", watermark)
    win = F.window("_et", window, slide) if slide else F.window("_et", window)
    agg = timed.groupBy(win.alias("_win"),
                        *[F.col(quote(k)) for k in keys]).agg(F.count(F.lit(1)).alias(out))
    start = F.col("_win.start")
    end = F.col("_win.end")
    if isinstance(dtype, T.TimestampNTZType):
        start, end = to_wall_clock(start), to_wall_clock(end)
    return agg.select(start.alias("window_start"), end.alias("window_end"),
                      *[F.col(quote(k)) for k in keys], F.col(out))


#: Left rows of one (key, bucket) that are dealt out: more than this share of
#: all.  There are fewer than 1 / HOT_SHARE of them, so they may be broadcast.
HOT_SHARE = 1 / 256
#: Parts that a hot (key, bucket) is dealt into.
SALTS = 32


def interval_join(left: DataFrame, right: DataFrame, keys: Sequence[str],
                  left_time: str, right_time: str, lower: str = "0 seconds",
                  upper: str = "1 day", bucket: str | None = None,
                  watermark: str | None = None, hot_keys: Sequence[tuple] = (),
                  salts: int = SALTS) -> DataFrame:
    """Inner join on ``keys`` where
    ``left_time + lower <= right_time <= left_time + upper``.

    Works on batch and streaming frames (give ``watermark`` for streams so
    state is dropped).  Rows are also matched on a time bucket of width
    ``bucket`` (default ``upper - lower``): each left row sits in one bucket,
    each right row is copied to the few buckets its range can reach.  A hot
    key is thereby split by time instead of landing in one task.

    A key that is hot within one bucket is dealt into ``salts`` parts: its left
    rows go to one part each, its right rows to all of them, so that no task has
    all of it.  On batch frames the hot (key, bucket) pairs are counted first
    (those with more than ``HOT_SHARE`` of the left rows).  A stream's state must
    be dealt alike in every batch, so there ``hot_keys`` names the keys, for the
    life of its checkpoint; with few rows for so many parts nothing is lost.
    """
    lo, hi = interval_micros(lower), interval_micros(upper)
    if hi < lo:
        raise ValueError(f"upper bound {upper!r} is below lower bound {lower!r}")
    width = interval_micros(bucket) if bucket else max(hi - lo, 1)
    if width <= 0:
        raise ValueError("bucket width must be positive")
    lt_type, rt_type = left.schema[left_time].dataType, right.schema[right_time].dataType
    L = left.withColumn("_lt", to_instant(F.col(quote(left_time)), lt_type))
    R = right.withColumn("_rt", to_instant(F.col(quote(right_time)), rt_type))
    if watermark:
        L, R = L.withWatermark("_lt", watermark), R.withWatermark("_rt", watermark)
    L = L.withColumn("_lb", F.floor(epoch_micros(F.col("_lt"), T.TimestampType()) / width))
    r_us = epoch_micros(F.col("_rt"), T.TimestampType())
    R = R.withColumn("_rb", F.explode(F.sequence(F.floor((r_us - hi) / width),
                                                 F.floor((r_us - lo) / width))))
    L, R = _dealt(L, R, keys, hot_keys, salts)
    Ls, Rs = L.alias("_l"), R.alias("_r")
    cond = [F.col(f"_l.{quote(k)}") == F.col(f"_r.{quote(k)}") for k in keys]
    cond += [F.col("_l._lb") == F.col("_r._rb"), F.col("_l._ls") == F.col("_r._rs"),
             F.col("_r._rt") >= F.col("_l._lt") + _micros_interval(lo),
             F.col("_r._rt") <= F.col("_l._lt") + _micros_interval(hi)]
    joined = Ls.join(Rs, cond, "inner")
    left_cols = [F.col(f"_l.{quote(c)}") for c in left.columns]
    right_cols = [F.col(f"_r.{quote(c)}") for c in right.columns if c not in keys]
    return joined.select(*left_cols, *right_cols)


def _dealt(L: DataFrame, R: DataFrame, keys: Sequence[str], hot_keys: Sequence[tuple], salts: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with the part that a row is dealt to (``_ls``, ``_rs``)."""
    if any(len(k) != len(keys) for k in hot_keys):
        raise ValueError(f"a hot key has {len(keys)} values")
    of_key = [F.col(quote(k)) for k in keys]
    part = F.pmod(F.xxhash64("_lt", *(F.col(quote(c)) for c in L.columns if not isinstance(L.schema[c].dataType, T.MapType))), F.lit(salts)).cast("int")
    parts = F.sequence(F.lit(0), F.lit(salts - 1))
    if L.isStreaming or R.isStreaming or hot_keys:
        hot = F.lit(False)
        for values in hot_keys:
            own = F.lit(True)
            for c, v in zip(of_key, values):
                own = own & (c == F.lit(v))
            hot = hot | F.coalesce(own, F.lit(False))
        return (L.withColumn("_ls", F.when(hot, part).otherwise(0)),
                R.withColumn("_rs", F.explode(F.when(hot, parts).otherwise(F.array(F.lit(0))))))
    counts = L.groupBy(*of_key, "_lb").agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    hot = counts.where(F.col("_n") > max(total * HOT_SHARE, salts)).select(*of_key, "_lb", F.lit(True).alias("_hot"))
    listed = hot.collect()  # fewer than 1 / HOT_SHARE
    if not listed:
        return L.withColumn("_ls", F.lit(0)), R.withColumn("_rs", F.lit(0))
    hot = F.broadcast(L.sparkSession.createDataFrame(listed, hot.schema))
    L = L.join(hot, [*keys, "_lb"], "left").withColumn("_ls", F.when(F.col("_hot"), part).otherwise(0)).drop("_hot")
    R = R.join(hot.withColumnRenamed("_lb", "_rb"), [*keys, "_rb"], "left").withColumn(
        "_rs", F.explode(F.when(F.col("_hot"), parts).otherwise(F.array(F.lit(0))))).drop("_hot")
    return L, R

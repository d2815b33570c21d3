"""Exact trailing counts on a stream, in keyed state.

``stream_trailing_count`` gives every event the number of events of its key in
``[time - width, time]``, as the batch operator ``trailing_count`` does.  Keys are
hashed into buckets; a bucket's state is one value, the times and ids of the events
of its keys, and its counts are arrays' work for all its keys at once.  So Python is
called once per bucket and micro-batch, not per key, event or read of the state.
An event that arrives after later ones (within the watermark) changes their counts,
so these are emitted again: counts only grow, and the largest is the newest.  Events
that none can reach back to any more, those a width behind the watermark, are
dropped whenever their bucket has new rows, and by a timeout of the bucket, which is
set to the end of a span (``SPANS`` of them make a width) so that a quiet bucket is
not called for each event.

State of a key is its events of the last width and the watermark's delay.

Defined results: rows without a time have a null count; rows repeated or with a
repeated or null id are counted each; a null key is a key of its own.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from featureflow.functions.schema import quote
from featureflow.functions.time import epoch_micros, to_instant, to_wall_clock
from featureflow.operators.features import interval_micros
from featureflow.session import ROCKSDB, STATE_STORE_CONF

# Executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Spans in a width; a quiet bucket's timeouts are as far apart.
SPANS = 8
#: Buckets of the keys; a checkpoint keeps the number it began with.
BUCKETS = 4096
#: Session settings that a query with such state starts with.
STATE_SETTINGS = {STATE_STORE_CONF: ROCKSDB}
#: Keys in any order, with the number of events of each; the events' times (64-bit
#: numbers, as ``events`` are) by key and time, and their ids in that order.
STATE = "keys string, events binary, times binary, ids string"
RESULT = "_key string, _id string, _us long, _n long"


class _Counts:
    """Counts of a bucket's keys; see the module."""

    def __init__(self, width: int):
        self.width, self.span = width, max(1, -(-width // SPANS))

    def __call__(self, bucket: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        watermark = state.getCurrentWatermarkMs()
        keys, of, times, ids = [], np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, object)
        if state.exists:
            names, events, at, held = state.get
            keys, times, ids = json.loads(names), np.frombuffer(at, np.int64), np.array(json.loads(held), object)
            of = np.repeat(np.arange(len(keys)), np.frombuffer(events, np.int64))
            left = times >= watermark * 1000 - self.width
            of, times, ids = of[left], times[left], ids[left]
        old, number = len(times), {k: n for n, k in enumerate(keys)}
        for df in () if state.hasTimedOut else rows:
            known = df["_known"].to_numpy(bool)
            if not known.all():
                yield _out(df.loc[~known, "_key"], df.loc[~known, "_id"], None, None)
            place, found = pd.factorize(df["_key"].to_numpy(object)[known])
            place = np.array([number.setdefault(k, len(number)) for k in found], np.int64)[place]
            of, times = np.concatenate([of, place]), np.concatenate([times, df["_us"].to_numpy(np.int64)[known]])
            ids = np.concatenate([ids, df["_id"].to_numpy(object)[known]])
        keys = np.array(list(number), object)
        if len(times) > old:
            order = np.lexsort([times, of])
            new, of, times, ids = order >= old, of[order], times[order], ids[order]
            # Key and time, and key and start of the span, as numbers in one order.
            every = np.unique(np.concatenate([times, times - self.width]))
            end = of * len(every) + np.searchsorted(every, times)
            start = of * len(every) + np.searchsorted(every, times - self.width)
            # Whoever has a new event in its span: the new ones, and later ones.
            reached = np.searchsorted(end[new], end, side="right") > np.searchsorted(end[new], start, side="left")
            counts = np.searchsorted(end, end[reached], side="right") - np.searchsorted(end, start[reached], side="left")
            yield _out(keys[of[reached]], ids[reached], times[reached], counts)
        if len(times):
            events = np.bincount(of, minlength=len(keys))
            state.update((json.dumps(keys[events > 0].tolist()), events[events > 0].astype(np.int64).tobytes(),
                          times.tobytes(), json.dumps(ids.tolist())))
            useless = (int(times.min()) // self.span + 1) * self.span + self.width
            state.setTimeoutTimestamp(max(-(-useless // 1000) + 1, watermark + 1, 1))
        elif state.exists:
            state.remove()


def _out(keys, ids, times: np.ndarray | None, counts: np.ndarray | None) -> pd.DataFrame:
    numbers = {"_us": times, "_n": counts}
    return pd.DataFrame({"_key": np.asarray(keys, object), "_id": np.asarray(ids, object),
                         **{c: pd.array([pd.NA] * len(ids) if v is None else v, dtype="Int64") for c, v in numbers.items()}})


def _to_text(value: Column, dtype: T.DataType) -> Column:
    """A key's value as text, the same for equal values; see ``_from_text``."""
    if isinstance(dtype, T.TimestampType):  # in local time some have the same text
        return F.unix_micros(value).cast("string")
    if isinstance(dtype, T.BinaryType):
        return F.base64(value)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return (value + F.lit(0.0).cast(dtype)).cast("string")  # one zero
    if isinstance(dtype, (T.StructType, T.ArrayType)):
        return F.to_json(F.struct(value.alias("v")), _NESTED)
    return value.cast("string")


def _from_text(text: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.TimestampType):
        return F.timestamp_micros(text.cast("long"))
    if isinstance(dtype, T.BinaryType):
        return F.unbase64(text)
    if isinstance(dtype, (T.StructType, T.ArrayType)):
        return F.from_json(text, T.StructType([T.StructField("v", dtype)]), _NESTED)["v"]
    return text.cast(dtype)


_NESTED = {"timeZone": "UTC", "timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}


def stream_trailing_count(stream: DataFrame, keys: Sequence[str], ts: str, width: str, id_col: str,
                          watermark: str, out: str = "n_events") -> DataFrame:
    """``keys``, ``id_col``, ``ts`` and ``out`` of every event, and again of those
    whose count an event that came after them has raised (update mode; the
    largest count of an id is the newest).  Start it with ``STATE_SETTINGS``."""
    us = interval_micros(width)
    if us < 0:
        raise ValueError("width must not be negative")
    dtype = stream.schema[ts].dataType
    if not isinstance(stream.schema[id_col].dataType, (T.StringType, T.IntegralType)):
        raise ValueError(f"ids are text or whole numbers, {id_col!r} is not")
    fields = [stream.schema[k].dataType for k in keys]
    texts = [_to_text(F.col(quote(k)), t) for k, t in zip(keys, fields)]
    time = epoch_micros(F.col("_et"), T.TimestampType())
    # Text, and times without nulls, so that pandas makes no floats of them.
    rows = stream.withColumn("_et", to_instant(F.col(quote(ts)), dtype)).withWatermark("_et", watermark).select(
        (F.to_json(F.array(*texts)) if texts else F.lit("[]")).alias("_key"), F.col(quote(id_col)).cast("string").alias("_id"),
        F.coalesce(time, F.lit(0)).alias("_us"), time.isNotNull().alias("_known"), "_et")
    bucket = F.pmod(F.xxhash64("_key"), F.lit(BUCKETS)).cast("int").alias("_bucket")
    counted = rows.select(bucket, "*").groupBy("_bucket").applyInPandasWithState(
        _Counts(us), RESULT, STATE, "update", GroupStateTimeout.EventTimeTimeout)
    time = F.timestamp_micros("_us")
    time = to_wall_clock(time) if isinstance(dtype, T.TimestampNTZType) else time
    parts = F.from_json("_key", "array<string>")
    return counted.select(*(_from_text(parts[n], t).alias(k) for n, (k, t) in enumerate(zip(keys, fields))),
                          F.col("_id").cast(stream.schema[id_col].dataType).alias(id_col), time.alias(ts), F.col("_n").alias(out))

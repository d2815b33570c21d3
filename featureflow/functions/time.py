"""Time columns that do not depend on the session time zone.

Tables store wall-clock ``timestamp_ntz`` values meant as UTC.  Watermarks and
``window`` need instants (``timestamp``).  A bare cast would read the wall
clock in the session zone, so every conversion goes through epoch
microseconds instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _epoch_ntz() -> Column:
    return F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")


def epoch_micros(c: Column, dtype: T.DataType) -> Column:
    """Microseconds since the epoch of a ``timestamp`` or ``timestamp_ntz``."""
    if isinstance(dtype, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", _epoch_ntz(), c)
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(c)
    raise TypeError(f"not a timestamp type: {dtype.simpleString()}")


def to_instant(c: Column, dtype: T.DataType) -> Column:
    """Wall-clock UTC ``timestamp_ntz`` -> the same instant as ``timestamp``."""
    if isinstance(dtype, T.TimestampType):
        return c
    return F.timestamp_micros(epoch_micros(c, dtype))


def to_wall_clock(c: Column) -> Column:
    """Instant (``timestamp``) -> UTC wall clock as ``timestamp_ntz``."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(c), _epoch_ntz())

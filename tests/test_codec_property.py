"""Encode then decode returns every value unchanged, for generated rows."""

from __future__ import annotations

import datetime as dt
import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from featureflow.functions.codec import decode, encode

SCHEMA = [
    {"name": "k", "type": "long"},
    {"name": "s", "type": "string"},
    {"name": "d", "type": "double"},
    {"name": "b", "type": "boolean"},
    {"name": "t", "type": "timestamp_ntz"},
    {"name": "raw", "type": "bytes"},
    {"name": "tags", "type": "array<string>"},
]
DDL = "k long, s string, d double, b boolean, t timestamp_ntz, raw binary, tags array<string>"

row = st.tuples(
    st.one_of(st.none(), st.integers(-2**63, 2**63 - 1)),
    st.one_of(st.none(), st.text(max_size=30)),
    st.one_of(st.none(), st.floats(allow_nan=True, allow_infinity=True)),
    st.one_of(st.none(), st.booleans()),
    st.one_of(st.none(), st.datetimes(min_value=dt.datetime(1900, 1, 1),
                                      max_value=dt.datetime(2200, 1, 1))),
    st.one_of(st.none(), st.binary(max_size=16)),
    st.one_of(st.none(), st.lists(st.one_of(st.none(), st.text(max_size=5)), max_size=4)),
)


def _same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return (math.isnan(a) and math.isnan(b)) or a == b
    if isinstance(a, (bytes, bytearray)) and isinstance(b, (bytes, bytearray)):
        return bytes(a) == bytes(b)
    return a == b


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(row, min_size=1, max_size=20))
def test_round_trip(spark, rows):
    df = spark.createDataFrame(rows, DDL)
    back = decode(encode(df, ["k"], "t"), SCHEMA).collect()
    assert len(back) == len(rows)
    for src, got in zip(rows, back):
        for i, v in enumerate(src):
            assert _same(v, got[i]), (i, v, got[i])

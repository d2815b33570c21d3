"""Declared schemas of the driver's tables, as a user would declare topics."""

from __future__ import annotations

EVENTS_SCHEMA = [
    {"name": "event_id", "type": "long"},
    {"name": "ts", "type": "timestamp_ntz"},
    {"name": "user_id", "type": "long"},
    {"name": "event_type", "type": "string"},
    {"name": "value", "type": "double"},
    {"name": "props", "type": "string"},
]

ORDERS_SCHEMA = [
    {"name": "o_orderkey", "type": "long"},
    {"name": "o_custkey", "type": "long"},
    {"name": "o_orderstatus", "type": "string"},
    {"name": "o_totalprice", "type": "double"},
    {"name": "o_orderdate", "type": "timestamp_ntz"},
    {"name": "o_orderpriority", "type": "string"},
]


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"

"""WARC round trips."""

from __future__ import annotations

import gzip
import hashlib
import io
import zlib

import duckdb
import pytest

from featureflow.llm import common, warc
from featureflow.llm.queries import OP10_SQL, op10_warc

from .conftest import SF

BIG = "é" * 600
PAGES = [
    (1, "http://a/ü?x=1\r\nX: y", BIG), (2, None, BIG), (2, None, BIG), (None, "u", BIG), (5, "u", "z"), (6, "u", "z"), (7, "u", None),
    (8, "u", ""), (9, "u", "a\r\n\r\nWARC/1.1\r\n\r\n" * 300), (10, "u", "x" * 3_000_000), (None, "u", "n" * 2000), (None, "u", "n" * 2000),
    (11, "u", "m" * 999), (12, "u", "m" * 999),
]


def expected(pages):
    largest = {}
    for i, _, html in pages:
        if len((html or "").encode()) >= 1000 and i is not None:
            largest[html] = max(i, largest.get(html, i))
    out = []
    for i, _, html in pages:
        raw, lead = (html or "").encode(), largest.get(html)
        again = lead is not None and lead != i
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", lead if again else None))
    return sorted(out, key=str)


def test_query_equals_sql(spark):
    duckdb.sql(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    want = sorted(duckdb.sql(OP10_SQL).fetchall(), key=str)
    assert sorted((tuple(r) for r in op10_warc(spark, SF).collect()), key=str) == want


def test_edge_cases(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS bytes", "3 AS largest")
    assert sorted((tuple(r) for r in warc.archive(df).collect()), key=str) == expected(PAGES)
    assert warc.archive(df.limit(0)).collect() == []


def records():
    return [warc.record_bytes(k, f"http://x/{k}", bytes([65 + k]) * (k * 100_000), hashlib.sha1(bytes([65 + k]) * (k * 100_000)).hexdigest(),
                              None, "2020-01-01T00:00:00Z") for k in range(6)]


@pytest.mark.parametrize("members", [1, 2, 6])
def test_normalised_members_are_the_records(members):
    """One stream, or any number of members: each record becomes a member."""
    own = records()
    cut = [b"".join(own[k::members]) for k in range(members)]
    order = [r for k in range(members) for r in own[k::members]]
    out = io.BytesIO()
    index = list(warc.normalise_stream(io.BytesIO(b"".join(map(gzip.compress, cut))), out))
    data = out.getvalue()
    assert [gzip.decompress(data[a:a + n]) for a, n, _ in index] == order
    assert sum(n for _, n, _ in index) == len(data) and gzip.decompress(data) == b"".join(order)


def test_cut_streams_are_refused():
    whole = gzip.compress(b"".join(records()))
    for data in (whole[:-20], whole[:len(whole) // 2], gzip.compress(b"".join(records())[:-5])):
        with pytest.raises((EOFError, zlib.error)):
            list(warc.normalise_stream(io.BytesIO(data), io.BytesIO()))
    with pytest.raises(ValueError):
        list(warc.normalise_stream(io.BytesIO(gzip.compress(b"HTTP/1.1 200\r\n\r\n")), io.BytesIO()))


def test_files_appear_whole_or_not_at_all(spark):
    folder = common.shared_folder(spark, "test-atomic")
    fs, root = common.file_system(folder)
    file = common.AtomicFile(fs, f"{root}/x")
    file.write(b"abc")
    assert fs.get_file_info(f"{root}/x").type.name == "NotFound"
    file.commit()
    assert fs.open_input_stream(f"{root}/x").read() == b"abc"

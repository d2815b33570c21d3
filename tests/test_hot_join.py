"""The interval join with a key that is hot within one bucket, and lookups
that read what they ask for."""

from __future__ import annotations

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from featureflow import OutputSpec, TableSpec
from featureflow.operators.features import interval_join
from featureflow.operators.store import FeatureStore
from featureflow.streaming.runner import run_bounded

DAY = datetime(2024, 2, 1)


def sides(seed, hot=400, others=400):
    """Half of all rows on one user within one day."""
    rng = random.Random(seed)
    def rows(n, user):
        return [(user or rng.randint(2, 60), DAY + timedelta(seconds=rng.randint(0, 86_399)), k) for k in range(n)]
    left = rows(hot, 1) + rows(others, None) + [(None, DAY, -1), (3, None, -2)]
    right = rows(hot, 1) + rows(others, None) + [(None, DAY, -1), (3, None, -2)]
    return left, right


def plain(left, right, width):
    return sorted((u, t, i, t2, j) for u, t, i in left for u2, t2, j in right
                  if u is not None and u == u2 and t is not None and t2 is not None and t <= t2 <= t + width)


def frames(spark, left, right):
    return (spark.createDataFrame(left, "user long, at timestamp, id long"),
            spark.createDataFrame(right, "user long, then timestamp, other long"))


@pytest.mark.parametrize("width,hours", [("1 day", 24), ("2 hours", 2)])
def test_same_rows_and_even_tasks(spark, width, hours):
    left, right = sides(1)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = interval_join(*frames(spark, left, right), ["user"], "at", "then", upper=width)
        got = sorted((r["user"], r["at"], r["id"], r["then"], r["other"]) for r in joined.collect())
        assert got == plain(left, right, timedelta(hours=hours))
        tasks = [r["n"] for r in joined.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
        if hours == 24:
            # One task would have nearly all pairs; none has over a few times its share.
            assert len(tasks) == 16 and max(tasks) <= 2.5 * sum(tasks) / 16
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_named_hot_keys_on_a_stream(spark, tmp):
    left, right = sides(2, 60, 60)
    left, right = ([r for r in rows if r[1] is not None] for rows in (left, right))
    got = []
    for k in range(2):
        a, b = frames(spark, left[k::2], right[k::2])
        a.write.mode("append").parquet(f"{tmp}/a")
        b.write.mode("append").parquet(f"{tmp}/b")
        streams = [spark.readStream.schema(d.schema).parquet(p) for d, p in ((a, f"{tmp}/a"), (b, f"{tmp}/b"))]
        joined = interval_join(*streams, ["user"], "at", "then", upper="1 day", watermark="2 days", hot_keys=[(1,), (None,)], salts=5)
        run_bounded(joined, lambda df, i: got.extend(tuple(r) for r in df.select("user", "at", "id", "then", "other").collect()),
                    OutputSpec("append"), f"{tmp}/checkpoint")
    assert sorted(got) == plain(left, right, timedelta(days=1))
    with pytest.raises(ValueError, match="hot key"):
        interval_join(a, b, ["user"], "at", "then", hot_keys=[(1, 2)])


SPEC = TableSpec(["k", "name"], [{"name": "k", "type": "long"}, {"name": "name", "type": "string"}, {"name": "v", "type": "long"}], order_by=["v"])


def test_lookup_reads_the_buckets_of_its_keys(spark, tmp):
    store = FeatureStore(f"{tmp}/store", SPEC)
    df = spark.range(3000).select(F.col("id").alias("k"), F.concat(F.lit("n"), "id").alias("name"), (F.col("id") * 2).alias("v"))
    store.write_batch(df, 1, "r", 0)
    store.write_batch(df.where("k = 5").withColumn("v", F.lit(99)).select("k", "name", "v"), 1, "r", 1)
    store.compact(spark, 1)
    store.expire(spark, 1)
    request = [(7, "n7"), (11, "n11"), (-1, "none")]
    asked = spark.createDataFrame(request, "a long, b string")
    of = {r[0] for r in asked.select(F.col("a").alias("k"), F.col("b").alias("name")).select(store._bucket(64)).collect()}
    # All other buckets are unreadable now, and the folded batch is gone.
    for folder, _, names in os.walk(f"{tmp}/store"):
        bucket = folder.rpartition("_bucket=")[2]
        if ("/rows/" in folder and int(bucket) not in of) or folder.endswith("batch_id=0"):
            for name in names:
                with open(f"{folder}/{name}", "wb"):
                    pass
    want = {(7, "n7", 14), (11, "n11", 22), (-1, "none", None)}
    assert {tuple(r) for r in store.lookup(spark, 1, asked).collect()} == want
    assert {tuple(r) for r in store.lookup(spark, 1, request).collect()} == want
    many = spark.range(5000).select(F.lit(7).alias("a"), F.lit("n7").alias("b"))
    assert store.lookup(spark, 1, many).count() == 5000
    assert store.lookup(spark, 1, asked.limit(0)).collect() == []


def test_snapshots_have_bloom_filters(spark, tmp):
    store = FeatureStore(f"{tmp}/store", SPEC)
    df = spark.range(20_000).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("name"), F.col("id").alias("v"))
    store.write_batch(df, 1, "r", 0)
    store.write_batch(df.limit(0), 1, "r", 1)
    store.compact(spark, 1)
    import pyarrow.parquet as pq

    files = [f"{d}/{n}" for d, _, ns in os.walk(f"{tmp}/store/snapshots") for n in ns if n.endswith(".parquet")]
    raw = b"".join(open(f, "rb").read() for f in files[:1])
    meta = pq.read_metadata(files[0])
    column = {meta.schema.column(i).name: meta.row_group(0).column(i) for i in range(meta.num_columns)}["name"]
    # The filter's bytes stand beside the column chunks: the file is larger than these.
    assert meta.num_rows and len(raw) > sum(meta.row_group(0).column(i).total_compressed_size for i in range(meta.num_columns)) + 1024 * 16
    assert column.total_compressed_size > 0

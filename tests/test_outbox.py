"""Both sinks or neither: one commit, published from there."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from featureflow import InputSpec, JobConfig, TableSpec
from featureflow.functions.codec import output_topic
from featureflow.plans.jobs import feature_store, live_job
from featureflow.sources.topics import FileTransport, publish
from featureflow.streaming.outbox import RECORD_ID, read_published
from featureflow.streaming.sinks import collect_to_memory

SCHEMA = [{"name": "k", "type": "long"}, {"name": "v", "type": "double"}]


class Flaky(FileTransport):
    """Fails before or after it writes, as told by ``plan``."""

    plan: list[str] = []

    def write_batch(self, records):
        how = self.plan.pop(0) if self.plan else ""
        if how == "before":
            raise ConnectionError
        super().write_batch(records)
        if how == "after":
            raise ConnectionError


@pytest.mark.parametrize("plan", [[], ["before"], ["after"], ["", "after", "after", "before", ""]])
def test_topic_and_table_have_equal_rows(spark, tmp, plan):
    """Also with a function that gives other rows each time it runs."""
    transport = Flaky(f"{tmp}/topics", max_files_per_trigger=1)
    Flaky.plan = []
    for k in range(3):
        publish(spark.range(5 * k, 5 * k + 5).select(F.col("id").alias("k"), F.lit(0.5).alias("v")).coalesce(1), transport, "in", ["k"])
    cfg = JobConfig(app_name="app", bucket=tmp, inputs=[InputSpec("in", SCHEMA)], table=TableSpec(["k"], SCHEMA), run_id="r")
    Flaky.plan = list(plan)

    def process(dfs):
        return dfs[0].withColumn("v", F.rand())

    for _ in range(10):
        try:
            live_job(spark, cfg, process, transport, bounded=True, outbox=True).awaitTermination()
            break
        except StreamingQueryException:
            pass
    table = Counter(map(tuple, feature_store(cfg).changelog(spark, 1).select("k", "v").collect()))
    topic = output_topic("app", 1)
    raw = transport.read_batch(spark, topic).select(F.get_json_object("value", f"$.{RECORD_ID}").alias("i")).collect()
    assert len({r["i"] for r in raw}) == 15 == sum(table.values()) and len(raw) == 15 + 5 * plan.count("after")
    assert Counter(map(tuple, read_published(spark, transport, topic, SCHEMA).collect())) == table
    streamed = collect_to_memory(read_published(spark, transport, topic, SCHEMA, streaming=True))
    assert Counter(map(tuple, streamed.collect())) == table

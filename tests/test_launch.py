"""Every job started from a request file."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from featureflow.config import JobConfig
from featureflow.launch import main
from featureflow.plans.jobs import archive_base, feature_store, quarantine_base
from featureflow.sources.files import folder_location
from featureflow.sources.topics import FileTransport

from conftest import rows

FIELDS = [{"name": "k", "type": "long"}, {"name": "v", "type": "string"}]
REQUEST = {
    "appname": "app", "kafka": {"brokers": "none"}, "outputs": {"mode": "append", "processing_time": "1 second"},
    "inputs": [{"topic": "t", "topic_schema": FIELDS, "sample": [{"k": 1, "v": "a"}]}],
    "table": {"primary_keys": ["k"], "output_schema": FIELDS}, "assertions": [{"k": 1, "v": "A"}],
}


def upper(dfs):
    return dfs[0].withColumn("v", F.upper("v"))


def test_jobs_from_a_request(spark, tmp, monkeypatch):
    monkeypatch.syspath_prepend(__file__.rsplit("/", 1)[0])
    with open(f"{tmp}/request.json", "w") as f:
        json.dump(REQUEST, f)

    def launch(job, run_id, *more):
        main([job, f"{tmp}/request.json", "--bucket", f"{tmp}/b", "--run-id", run_id, "--topics", f"{tmp}/topics",
              "--bounded", "--process", "test_launch:upper", *more], spark)

    cfg = JobConfig.from_request(REQUEST, f"{tmp}/b")
    texts = ['{"k": 1, "v": "a"}', '{"k": 2, "v": "b"}', "broken"]
    FileTransport(f"{tmp}/topics").write_batch(spark.createDataFrame([("t", None, x) for x in texts], "topic string, key string, value string"))
    launch("check", "c")
    launch("archive", "arch")
    launch("quarantine", "bad")
    launch("replay", "replay")
    assert spark.read.parquet(folder_location(archive_base(cfg), "app", "t")).count() == 3
    assert spark.read.parquet(folder_location(quarantine_base(cfg), "app", "t")).count() == 1
    assert [r["v"] for r in rows(feature_store(cfg).latest(spark, 1), "k")] == ["A", "B"]
    launch("live", "live")
    launch("compact", "x", "--expire")
    assert {r["v"] for r in feature_store(cfg).latest(spark, 1).where("k is not null").collect()} == {"A", "B"}


def test_a_failing_check_fails_the_start(spark, tmp):
    with open(f"{tmp}/request.json", "w") as f:
        json.dump(REQUEST, f)
    with pytest.raises(AssertionError):
        main(["check", f"{tmp}/request.json", "--bucket", tmp], spark)  # without the function
    with pytest.raises(SystemExit):
        main(["other", f"{tmp}/request.json", "--bucket", tmp], spark)

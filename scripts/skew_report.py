"""Measure task balance under a hot key from Spark's event log.

Moves half of all rows to one key and runs each hot-key path of the library
next to the plain formulation: the 7-day trailing count (vs a window by
user), schema-version assignment (vs row_number by app), the latest-row view
and the interval join (day buckets vs one bucket per user).  The event log (written to a
fresh scratch folder) gives, per approach, the largest share of shuffle
records that a single task read.  A development tool; prints one JSON line.
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile
from collections import defaultdict

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession, Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from featureflow.functions.time import epoch_micros  # noqa: E402
from featureflow.config import TableSpec  # noqa: E402
from featureflow.operators.features import interval_join, trailing_count  # noqa: E402
from featureflow.operators.registry import HISTORY_SCHEMA, assign_versions  # noqa: E402
from featureflow.operators.store import FeatureStore  # noqa: E402
from featureflow.plans.tables import EVENTS_SCHEMA  # noqa: E402


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    log_dir = tempfile.mkdtemp(prefix="skew-eventlog-")
    spark = (SparkSession.builder.master("local[8]")
             .config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", "16")
             # keep 16 reducers: at this size AQE would merge every shuffle
             # into one task and hide how the work is split
             .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
             # and the join sides would be broadcast, with no shuffle to look at
             .config("spark.sql.autoBroadcastJoinThreshold", "-1")
             .config("spark.eventLog.enabled", "true")
             .config("spark.eventLog.dir", log_dir)
             .config("spark.eventLog.compress", "false")
             .config("spark.eventLog.rolling.enabled", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    # Half of all rows on one key (every other event goes to user -1).
    hot = ev.withColumn("user_id", F.when(F.col("event_id") % 2 == 0, F.lit(-1))
                        .otherwise(F.col("user_id")))
    us = epoch_micros(F.col("ts"), hot.schema["ts"].dataType)
    by_key = (Window.partitionBy("user_id").orderBy(us)
              .rangeBetween(-7 * 86_400_000_000, 0))
    store = FeatureStore("unused", TableSpec(["user_id"], EVENTS_SCHEMA, order_by=["ts", "event_id"]))
    signups = hot.filter(F.col("event_type") == "signup").select(
        "user_id", F.col("event_id").alias("s_id"), F.col("ts").alias("s_ts"))
    buys = hot.filter(F.col("event_type") == "purchase").select(
        "user_id", F.col("event_id").alias("p_id"), F.col("ts").alias("p_ts"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    requests = orders.select(
        F.lit("acme").alias("org"),
        F.when(F.col("o_orderkey") % 2 == 0, F.lit("hot")).otherwise(
            F.col("o_custkey").cast("string")).alias("app"),
        F.col("o_orderkey").alias("request_id"), F.col("o_orderdate").alias("requested_at"),
        F.array(F.lit("k")).alias("primary_keys"),
        F.array(F.struct(F.lit("k").alias("name"), F.lit("long").alias("type"))).alias("fields"))
    no_history = spark.createDataFrame([], HISTORY_SCHEMA)
    per_app = Window.partitionBy("org", "app").orderBy("requested_at", "request_id")
    runs = {
        "registry_versions": lambda: assign_versions(requests, no_history),
        "registry_window_by_app": lambda: requests.withColumn("v", F.row_number().over(per_app)),
        "trailing_count": lambda: trailing_count(hot, ["user_id"], "ts", "7 days", "event_id",
                                                 out="n"),
        "trailing_window_by_key": lambda: hot.withColumn("n", F.count(F.lit(1)).over(by_key)),
        "latest_max_by": lambda: store._newest(hot.withColumn("batch_id", F.lit(0).cast("long"))),
        "interval_join_day_buckets": lambda: interval_join(
            signups, buys, ["user_id"], "s_ts", "p_ts", upper="1 day"),
        "interval_join_one_bucket": lambda: interval_join(
            signups, buys, ["user_id"], "s_ts", "p_ts", upper="1 day", bucket="3650 days"),
    }
    sc = spark.sparkContext
    for name, build in runs.items():
        sc.setJobGroup(name, name)
        build().write.format("noop").mode("overwrite").save()
    sc.setJobGroup("done", "done")
    spark.stop()

    [log] = glob.glob(f"{log_dir}/*")
    parts = sorted(glob.glob(f"{log}/events_*")) if os.path.isdir(log) else [log]
    stage_group: dict[int, str] = {}
    records: dict[int, list[int]] = defaultdict(list)
    for part in parts:
        with open(part) as fh:
            for line in fh:
                e = json.loads(line)
                kind = e.get("Event")
                if kind == "SparkListenerJobStart":
                    group = (e.get("Properties") or {}).get("spark.jobGroup.id")
                    for sid in e.get("Stage IDs", []):
                        stage_group[sid] = group
                elif kind == "SparkListenerTaskEnd":
                    m = e.get("Task Metrics") or {}
                    read = (m.get("Shuffle Read Metrics") or {}).get("Total Records Read", 0)
                    records[e["Stage ID"]].append(read)
    report = {}
    for name in runs:
        worst = 0.0
        for sid, recs in records.items():
            total = sum(recs)
            if stage_group.get(sid) == name and total >= 100:
                worst = max(worst, max(recs) / total)
        report[name] = {"max_task_share_of_shuffle_records": round(worst, 3),
                        "ideal_share": round(1 / 16, 3)}
    print(json.dumps({"sf_dir": sf_dir, "hot_key_share": 0.5, "event_log": log_dir,
                      "runs": report}))


if __name__ == "__main__":
    main()

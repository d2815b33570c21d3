"""Start a job from a request: ``python -m featureflow.launch JOB REQUEST``.

JOB is ``live``, ``replay``, ``archive``, ``quarantine`` (one stream per input
topic), ``check`` (samples against the expected rows) or ``compact``.  REQUEST
is a JSON file with the request body (see ``JobConfig.from_request``).  The
user's function is given as ``module:function``; without one the first input is
passed through.  Meant for ``spark-submit``; the session comes from there.
"""

from __future__ import annotations

import argparse
import importlib
import json

from pyspark.sql import SparkSession

from featureflow.config import JobConfig
from featureflow.plans import jobs
from featureflow.sources.topics import FileTransport, KafkaTransport

JOBS = ("live", "replay", "archive", "quarantine", "check", "compact")
# Records of one topic in a micro-batch, so that catching up goes in steps.
RECORDS_PER_BATCH = 1_000_000


def load_process(name: str | None) -> jobs.Process:
    if name is None:
        return jobs.identity
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def parse(argv: list[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="featureflow.launch", description=__doc__.split("\n")[0])
    p.add_argument("job", choices=JOBS)
    p.add_argument("request", help="JSON file with the request body")
    p.add_argument("--bucket", required=True, help="shared root of archives, tables and checkpoints")
    p.add_argument("--run-id", default="run0", help="a new one for every new checkpoint")
    p.add_argument("--org", default="default")
    p.add_argument("--process", help="module:function of the user's function")
    p.add_argument("--topics", help="folder of file topics, instead of Kafka")
    p.add_argument("--records-per-batch", type=int, default=RECORDS_PER_BATCH)
    p.add_argument("--files-per-batch", type=int, default=1_000, help="of a replay")
    p.add_argument("--bounded", action="store_true", help="stop when the input is read")
    p.add_argument("--expire", action="store_true", help="of compact: delete what no reader needs")
    return p.parse_args(argv)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parse(argv)
    with open(args.request) as f:
        cfg = JobConfig.from_request(json.load(f), args.bucket, run_id=args.run_id, org=args.org)
    spark = spark or SparkSession.builder.appName(f"{cfg.app_name}-{args.job}").getOrCreate()
    process = load_process(args.process)
    if args.job == "check":
        jobs.check_on_samples(spark, cfg, process)
        return
    if args.job == "compact":
        jobs.compaction_job(spark, cfg, args.expire)
        return
    if args.job == "replay":
        streams = [jobs.replay_job(spark, cfg, process, args.bounded, max_files_per_trigger=args.files_per_batch)]
    else:
        transport = FileTransport(args.topics) if args.topics else KafkaTransport(
            cfg.kafka, max_offsets_per_trigger=args.records_per_batch)
        if args.job == "live":
            streams = [jobs.live_job(spark, cfg, process, transport, args.bounded)]
        else:
            job = jobs.archive_job if args.job == "archive" else jobs.quarantine_job
            streams = [job(spark, cfg, inp, transport, args.bounded) for inp in cfg.inputs]
    for stream in streams:
        stream.awaitTermination()


if __name__ == "__main__":
    main()

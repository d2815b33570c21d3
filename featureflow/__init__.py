"""Streaming features on Spark.

A user declares typed topics and writes one function from a list of
DataFrames to a DataFrame.  The library decodes the topics, archives them as
Parquet, runs the function live with Structured Streaming, replays it over the
archive, publishes the results as a versioned topic and keeps the latest row
per primary key in a Parquet feature table that can be looked up in bulk.
"""

from featureflow.config import (
    FileSpec,
    InputSpec,
    JobConfig,
    KafkaSpec,
    OutputSpec,
    TableSpec,
)
from featureflow.session import build_session, scratch_dir

__all__ = [
    "FileSpec",
    "InputSpec",
    "JobConfig",
    "KafkaSpec",
    "OutputSpec",
    "TableSpec",
    "build_session",
    "scratch_dir",
]

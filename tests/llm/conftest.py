from __future__ import annotations

import os

import pytest

SF = "/root/testdata/sf0.001"

#: Names that the operators use for columns of their own.
CLASHING = ("spans", "fp", "score", "held_out", "component_id", "length", "rank", "kept", "digest", "largest",
            "kinds", "_bucket", "tie", "part", "n_words", "lang_pred", "evidence", "payload", "bytes", "_pii")

LONG = "the quick brown fox jumps " * 60_000  # 1.5 million characters

EDGE_TEXTS = [
    (1, "Plain words of a text, with nothing in it."),
    (2, None),
    (3, ""),
    (4, " \t\n \x0b\x0c\r "),
    (5, "Plain words of a text, with nothing in it."),
    (6, "one"),
    (None, "a text without an id"),
    (None, None),
    (8, "repeated row"), (8, "repeated row"),
    (9, LONG),
    (10, "é中😀 ñ x y \x85 ß İ"),
    (11, "a  b\n\nc \n d\te <|endoftext|> f"),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Edge-case documents with extra columns whose names clash."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(EDGE_TEXTS, "doc_id long, text string")
    return df.select("*", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.char_length("text").cast("long").alias("n_chars"),
                     *(F.lit(k).alias(c) for k, c in enumerate(CLASHING)))


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def pytest_configure(config):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

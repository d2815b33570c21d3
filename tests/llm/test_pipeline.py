"""The pipeline's stages against their operators and brute force."""

from __future__ import annotations

import re

import pytest

import corpus_pipeline
from featureflow.llm import common, toxicity
from featureflow.llm.queries import TOXIC_AT

from .conftest import SF
from .test_scans import brute_hits
from .test_simhash import brute_fingerprint, brute_groups
from .test_tokens import check_packing

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def kept(spark, documents):
    """What each stage leaves, by name."""
    out, docs = {"documents": documents}, documents
    for name, stage in corpus_pipeline.STAGES:
        out[name] = docs = common.stored(stage(spark, docs, SF), f"test-{name}")
    return out


def texts_of(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_order_and_columns(kept, documents):
    assert list(STAGES) == ["toxicity", "near_duplicates", "decontamination", "pii", "packing"]
    for name in list(STAGES)[:-1]:
        assert kept[name].schema.simpleString() == documents.schema.simpleString()


def test_toxicity(spark, kept, documents, labels):
    index = toxicity.learn(documents, labels)
    scores = {r["doc_id"]: r["score"] for r in toxicity.score_documents(documents, index).collect()}
    assert set(texts_of(kept["toxicity"])) == {d for d, s in scores.items() if s < TOXIC_AT}


def test_near_duplicates(kept):
    before = texts_of(kept["toxicity"])
    fps = {d: brute_fingerprint(t) for d, t in before.items()}
    groups = brute_groups(fps.values())
    least = {}
    for d, f in fps.items():
        least[groups[f]] = min(d, least.get(groups[f], d))
    assert texts_of(kept["near_duplicates"]) == {d: before[d] for d in least.values()}


def test_decontamination(spark, kept):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    before, after = texts_of(kept["near_duplicates"]), texts_of(kept["decontamination"])
    assert set(before) == set(after)
    for d, text in before.items():
        assert (after[d] == text) == (brute_hits(text, items, 10)[1] == 0)
        assert brute_hits(after[d], items, 10)[1] == 0


def test_pii(kept):
    before, after = texts_of(kept["decontamination"]), texts_of(kept["pii"])
    assert set(before) == set(after)
    for d, text in before.items():
        for m in re.findall(r"[\w.]+@mail\d\.example\.com", text):
            assert m not in after[d]
        if not re.search(r"[@\d]", text):
            assert after[d] == text
    assert all(r["n_chars"] == len(r["text"]) for r in kept["pii"].collect())


def test_packing(kept):
    check_packing(kept["packing"].collect(), texts_of(kept["pii"]), 2048)


def test_run_gives_the_last_stage(spark, kept):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).drop("sequence_id", "offset").collect())) == sorted(
        map(tuple, kept["packing"].drop("sequence_id", "offset").collect()))


def test_edge_cases_pass_through_every_stage(spark, edge, empty):
    plain = edge.select("doc_id", "text", "lang", "source", "n_chars")
    for docs in (plain, empty.select(*plain.columns)):
        for name, stage in corpus_pipeline.STAGES:
            out = common.stored(stage(spark, docs, SF), "test-edge")
            if name != "packing":
                assert out.columns == plain.columns
                docs = out

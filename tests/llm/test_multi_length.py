"""Multi-length packing: every id once, no padding, steps in balance."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from featureflow.llm import multi_length as ml
from featureflow.llm.queries import TOKENIZER, op13_multi_length_packing

from .conftest import EDGE_TEXTS, SF

LIBRARY = Tokenizer.from_file(TOKENIZER)


def ids(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 0]


def laid_out(counts, sizes, step_tokens=256):
    """Parts of all pieces by the plan, checked."""
    table, tiers = ml.plan(counts, sizes, step_tokens)
    length = np.concatenate([np.full(n, x) for x, n in counts.items()])
    rank = np.concatenate([np.arange(n) for n in counts.values()])
    row, start, part, sequence, offset = ml.resolve(length, rank, table)
    order = np.lexsort((start, row))
    row, start, part = row[order], start[order], part[order]
    ends = defaultdict(int)
    for r, s, n in zip(row.tolist(), start.tolist(), part.tolist()):
        assert s == ends[r]
        ends[r] += n
    assert [ends[k] for k in range(len(length))] == length.tolist()
    windows = defaultdict(list)
    for s, o, n in zip(sequence.tolist(), offset.tolist(), part[np.argsort(order)].tolist()):
        windows[s].append((o, n))
    size, step = ml.step_of(sequence, tiers)
    sizes_by = dict(zip(sequence.tolist(), size.tolist()))
    for s, held in windows.items():
        at = 0
        for o, n in sorted(held):
            assert o == at
            at += n
        assert at == sizes_by[s] and at & at - 1 == 0 and at <= sizes[0]
    return table, tiers, windows, dict(zip(sequence.tolist(), step.tolist()))


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), min_size=1, max_size=20), st.sampled_from([(64,), (64, 32, 16, 8), (64, 16)]))
def test_every_plan_is_full(counts, sizes):
    laid_out(counts, sizes)


def test_hot_length_and_plan_size():
    rng = random.Random(1)
    counts = Counter(rng.randint(1, 1023) for _ in range(50_000))
    counts[700] += 100_000
    counts[1024] = 5
    table, tiers, windows, _ = laid_out(dict(counts), ml.TIERS)
    more, *_ = ml.plan({x: 1000 * n for x, n in counts.items()})
    assert len(more) < 3 * len(table) < 30_000  # bulk steps, not pieces
    assert sum(t.sequences for t in tiers if t.size == 1024) > 0.9 * len(windows)


def test_shorter_tiers_and_gaps():
    """Long pieces take long windows, gaps go to shorter pieces, the rest of
    which has windows of its own tier."""
    _, tiers, windows, _ = laid_out({60: 10, 4: 10, 20: 9, 12: 9, 8: 3}, (64, 32, 16, 8))
    assert {t.size: t.sequences for t in tiers} == {64: 10, 32: 9, 8: 3}
    assert sorted(map(len, windows.values())) == [1] * 3 + [2] * 19


def test_steps_are_balanced():
    rng = random.Random(2)
    _, tiers, windows, step = laid_out(dict(Counter(rng.randint(1, 64) for _ in range(5000))), (64, 32, 16, 8), 64 * 16)
    cost, tokens = Counter(), Counter()
    for s, held in windows.items():
        cost[step[s]] += sum(n * n for _, n in held)
        tokens[step[s]] += sum(n for _, n in held)
    own = tiers[0]
    steps = range(own.first_step, own.first_step + own.steps)
    assert max(tokens[k] for k in steps) <= 64 * 16 and max(tokens[k] for k in steps) - min(tokens[k] for k in steps) <= 64
    assert max(cost[k] for k in steps) <= 1.15 * min(cost[k] for k in steps)
    assert sorted(set(step.values())) == list(range(sum(t.steps for t in tiers)))


def check(rows, documents):
    by_doc, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        windows[r["sequence_id"]].append((r["offset"], r["length"], r["context"], r["step"]))
    for held in windows.values():
        at = 0
        for o, n, *_ in sorted(held):
            assert o == at
            at += n
        assert len({(c, s) for *_, c, s in held}) == 1 and at == held[0][2] and at & at - 1 == 0 and at <= 1024
    for doc, text in documents.items():
        own, at = ids(text), 0
        for r in sorted(by_doc[doc], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(own)
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(np.array(own[r["start"]:at], "<u4").tobytes())
        assert at == len(own)


def test_packing_of_the_table(spark, texts):
    rows = op13_multi_length_packing(spark, SF).collect()
    check(rows, texts)
    pieces = sum(-(-len(ids(t)) // 1024) for t in texts.values())
    assert pieces <= len(rows) <= 1.5 * pieces


def test_edge_cases(edge, empty):
    rows = ml.pack_multi_length(edge, TOKENIZER, end_id=0).collect()
    check(rows, {d: t for d, t in EDGE_TEXTS if d is not None and d != 8})
    assert sum(r["length"] for r in rows) == sum(len(ids(t)) for _, t in EDGE_TEXTS)
    assert sum(r["doc_id"] is None and r["start"] == 0 for r in rows) == 2
    assert ml.pack_multi_length(empty, TOKENIZER, end_id=0).collect() == []


def test_sizes_are_checked(edge):
    with pytest.raises(ValueError, match="powers of two"):
        ml.pack_multi_length(edge, TOKENIZER, end_id=0, sizes=(1000, 512))

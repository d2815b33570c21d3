"""Encoder, token files and packing against the library and brute force."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from featureflow.llm import common, packing, token_files
from featureflow.llm.queries import TOKENIZER, op5_best_fit_packing, op8_token_files
from featureflow.llm.tokens import Encoder

from .conftest import EDGE_TEXTS, SF

ENCODER = Encoder(TOKENIZER, cache_pieces=500)
IN_PARTS = Encoder(TOKENIZER, chunk=7)
LIBRARY = Tokenizer.from_file(TOKENIZER)


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def encoded(text):
    return np.frombuffer(ENCODER.encode([text])[0], "<u4").tolist()


PARTS = st.sampled_from([" ", "  ", "\n", "\t", "\r", "a", "Bc", "é", "'s", "'", "12", "²", "!", "<|endoftext|>", "\xa0",
                         "　", "\x1c", "中", "😀", "́", ".", ",", "###", "word", "ǅ"])


@settings(max_examples=400, deadline=None)
@given(st.lists(PARTS, max_size=25).map("".join))
def test_ids_equal_the_library(text):
    assert encoded(text) == ids(text)
    assert IN_PARTS.encode([text]) == ENCODER.encode([text])


def test_ids_of_documents_equal_the_library(texts):
    for text in [*texts.values(), *(t for _, t in EDGE_TEXTS if t is None or len(t) < 10_000)]:
        assert encoded(text) == ids(text)


def digest(own):
    return zlib.crc32(np.array(own, "<u4").tobytes())


def test_token_files_of_the_table(spark, texts):
    rows = {r["doc_id"]: r for r in op8_token_files(spark, SF).collect()}
    start = 0
    for doc in sorted(texts):
        own = [*ids(texts[doc]), 2]
        assert (rows[doc]["start"], rows[doc]["n_tokens"], rows[doc]["ids_crc32"]) == (start, len(own), digest(own))
        start += len(own)
    assert len(rows) == len(texts)


def test_token_files_edge_cases(spark, edge):
    folder = common.shared_folder(spark, "test-tokens")
    files = token_files.write_token_files(edge, folder, TOKENIZER, end_id=2)
    rows = token_files.read_token_files(spark, files).collect()
    assert len(rows) == len(EDGE_TEXTS) and files.dtype == "<u2"
    rows.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted((d for d, _ in EDGE_TEXTS), key=lambda d: (d is not None, d or 0))
    want = Counter((d, len(ids(t)) + 1, digest([*ids(t), 2])) for d, t in EDGE_TEXTS)
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == want
    assert [r["start"] for r in rows] == [0, *np.cumsum([r["n_tokens"] for r in rows])[:-1].tolist()]
    part = next(k for k, p in enumerate(files.parts) if p[0])
    assert token_files.open_document(files, part, 0)[-1] == 2


def test_token_files_empty(spark, empty):
    files = token_files.write_token_files(empty, common.shared_folder(spark, "test-tokens"), TOKENIZER, end_id=2)
    assert token_files.read_token_files(spark, files).collect() == []


def check_packing(rows, documents, capacity):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append(r)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    for doc, text in documents.items():
        own, at = [*ids(text), 0], 0
        for k, r in enumerate(sorted(by_doc[doc], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at) and r["ids_crc32"] == digest(own[at:at + r["length"]])
            assert k == 0 or r["length"] == capacity
            at += r["length"]
        assert at == len(own)
    return len(by_sequence)


def test_packing_of_the_table(spark, texts):
    n = check_packing(op5_best_fit_packing(spark, SF).collect(), texts, 2048)
    bound = math.ceil(sum(len(ids(t)) + 1 for t in texts.values()) / 2048)
    assert n <= bound + 1


def test_packing_edge_cases(edge, empty):
    named = {d: t for d, t in EDGE_TEXTS if d is not None and d != 8}
    rows = packing.pack_documents(edge, TOKENIZER, end_id=0, capacity=64).collect()
    check_packing([r for r in rows], {}, 64)
    check_packing_docs = [r for r in rows if r["doc_id"] in named]
    assert {r["doc_id"] for r in check_packing_docs} == set(named)
    assert sum(r["doc_id"] == 8 for r in rows) == 2 and sum(r["doc_id"] is None for r in rows) == 2
    assert packing.pack_documents(empty, TOKENIZER, end_id=0, capacity=64).collect() == []


def test_packed_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame([(k, "word " * (k % 7 + 1)) for k in range(40)], "doc_id long, text string")
    packed = packing.pack_documents(docs, TOKENIZER, end_id=0, capacity=16, with_ids=True)
    got = []
    for r in packing.packed_sequences(packed).collect():
        assert len(r["ids"]) <= 16
        for p in r["pieces"]:
            got.append((p["doc_id"], r["ids"][p["offset"]:p["offset"] + p["length"]]))
    assert sorted(got) == sorted((k, [*ids("word " * (k % 7 + 1)), 0]) for k in range(40))


def fewest(items, capacity):
    """Smallest number of bins, by search."""
    items = sorted(items, reverse=True)
    best = [len(items)]

    def go(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(items):
            best[0] = len(bins)
            return
        tried = set()
        for b in range(len(bins)):
            if bins[b] + items[k] <= capacity and bins[b] not in tried:
                tried.add(bins[b])
                go(k + 1, [*bins[:b], bins[b] + items[k], *bins[b + 1:]])
        go(k + 1, [*bins, items[k]])

    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(60))
def test_dominance_keeps_an_optimum(seed):
    """Fixing sets by dominance must not cost a bin."""
    rng = random.Random(seed)
    capacity = rng.choice([10, 20, 50])
    low = rng.choice([1, capacity // 5, capacity // 4 + 1])
    items = [rng.randint(low, capacity) for _ in range(rng.randint(1, 9))]
    fixed, rest = packing.reduce_by_dominance(Counter(items), capacity)
    used = Counter()
    for contents, bins in fixed:
        assert sum(x * n for x, n in contents) <= capacity
        for x, n in contents:
            used[x] += n * bins
    assert used + Counter(rest) == Counter(items)
    left = [x for x, n in rest.items() for _ in range(n)]
    assert sum(b for _, b in fixed) + fewest(left, capacity) == fewest(items, capacity)


def one_by_one(items, capacity):
    """Best fit decreasing, an item at a time: the rests of its bins."""
    rests = []
    for x in sorted(items, reverse=True):
        fit = [r for r in rests if r >= x]
        if fit:
            rests.remove(min(fit))
            rests.append(min(fit) - x)
        else:
            rests.append(capacity - x)
    return sorted(rests)


@pytest.mark.parametrize("seed", range(60))
def test_bulk_best_fit_is_best_fit(seed):
    rng = random.Random(seed)
    items = [rng.randint(1, 40) for _ in range(rng.randint(1, 80))]
    got = sorted(40 - sum(x * n for x, n in contents) for contents, bins in packing.best_fit(Counter(items), 40) for _ in range(bins))
    assert got == one_by_one(items, 40)


def test_places_are_gapless():
    rng = random.Random(5)
    counts = Counter(rng.randint(1, 100) for _ in range(3000))
    places = packing.plan_places(counts, 100)
    length = np.array([x for x, n in counts.items() for _ in range(n)])
    rank = np.array([k for n in counts.values() for k in range(n)])
    bins = defaultdict(list)
    for s, o, x in zip(*packing.place(length, rank, places), length):
        bins[s].append((o, x))
    for own in bins.values():
        at = 0
        for o, x in sorted(own):
            assert o == at
            at += x
        assert at <= 100
    assert len(bins) <= 1.005 * math.ceil(length.sum() / 100)

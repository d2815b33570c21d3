"""Phrase collocations against counts by hand."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from featureflow.llm import collocations as col

from .conftest import CLASHING, EDGE_TEXTS, LONG


def plain_pieces(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for p in re.split(r"[.,;:!?\x0A-\x0D]", low) if (w := re.findall(r"[^\x20\x09]+", p))]


def plain(docs, least, top, longest=4):
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for w in plain_pieces(text):
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[a:a + k]) for a in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        found = {g: a for g, a in own.items() if len(g) > 1 and a >= least}
        rows = []
        for g, a in found.items():
            longer = [x for h, x in found.items() if len(h) > len(g) and any(h[k:k + len(g)] == g for k in range(len(h)))]
            if any(100 * x >= 80 * a for x in longer):
                continue
            score, _, l, r = min((2_000_000 * a // (own[g[:k]] + own[g[k:]]), k, own[g[:k]], own[g[k:]]) for k in range(1, len(g)))
            rows.append((-score, -a, " ".join(g).encode(), l, r))
        out += [(lang, k, p.decode(), -a, l, r, n[lang], -s) for k, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def found(spark, docs, least, top, more=()):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(docs, "lang string, text string")
    df = df.select("*", *(F.lit(k).alias(c) for k, c in enumerate(more)))
    return sorted(tuple(r) for r in col.collocations(df, least=least, top=top).collect())


def random_docs(seed, n=300, words=12):
    rng = random.Random(seed)
    vocabulary = ["The", "of", "a", "B", "é", "naïve", "x\xa0y", "中文", "\x85", "don't", "-"][:words]
    seps = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", " \x0b", "; "]
    return [(rng.choice(["en", "de", None]), "".join(rng.choice(vocabulary) + rng.choice(seps) for _ in range(rng.randint(0, 60)))) for _ in range(n)]


@pytest.mark.parametrize("seed,least,top", [(1, 30, 2000), (2, 5, 7), (3, 100, 50)])
def test_against_counts_by_hand(spark, seed, least, top):
    docs = random_docs(seed)
    assert found(spark, docs, least, top, CLASHING + ("ends", "chunk", "words", "n", "f", "k", "phrase")) == plain(docs, least, top)


def test_edge_cases(spark):
    docs = [("en", t) for _, t in EDGE_TEXTS if t != LONG] * 3 + [("xx", None), (None, None)]
    assert found(spark, docs, 2, 100) == plain(docs, 2, 100)
    assert found(spark, [], 1, 10) == []


def test_very_long_pieces_and_few_triggers(spark, monkeypatch):
    """A text of one piece, in parts, and words that never trigger or always do."""
    rng = random.Random(9)
    docs = [("en", LONG), ("en", "same " * 50_000), ("de", " ".join(rng.choice("abcdef") for _ in range(30_000)))]
    assert found(spark, docs, 30, 2000) == plain(docs, 30, 2000)


@pytest.mark.parametrize("period,longest,size", [(1, 4096, 1 << 20), (3, 5, 40), (1 << 60, 4, 30), (4, 50, 64)])
def test_every_occurrence_counts_once(period, longest, size):
    """Chunks hold each n-gram of up to four words exactly as often as the text."""
    rng = random.Random(period)
    for _ in range(30):
        piece = " ".join(rng.choice(["a", "b", "cc", "é"]) for _ in range(rng.randint(1, 200))).encode()
        parts = list(col.long_parts(piece, 3, size))
        got = Counter()
        for part, ends in parts:
            texts, closes, own, n = col.chunks([part], [2], [ends], 3, period, longest)
            for t, c, k, times in zip(texts, closes, own.tolist(), n.tolist()):
                words = t.split(b" ")
                assert k == len(words) - (0 if c else 3)
                for a in range(k):
                    got.update({tuple(words[a:a + m]): times for m in range(1, 5) if a + m <= len(words)})
        words = piece.split(b" ")
        assert got == Counter({g: 2 * x for g, x in Counter(
            tuple(words[a:a + m]) for m in range(1, 5) for a in range(len(words) - m + 1)).items()})


def test_equal_content_gives_equal_chunks():
    """A passage that stands in two texts is cut alike: few distinct chunks."""
    rng = random.Random(2)
    passage = " ".join(f"w{rng.randint(0, 500)}" for _ in range(2000))
    texts = [f"{a} {passage} {b}".encode() for a, b in (("one two three", "x"), ("other words", "y z"))]
    made, *_ = col.chunks(texts, [1, 1], [True, True], 3)
    assert len(set(made)) <= len(made) / 2 + 3


def test_full_map_loses_nothing(spark, monkeypatch):
    """With a map of very few bits nearly every pair passes; results stay."""
    docs = random_docs(5, 100)
    want = plain(docs, 10, 100)
    monkeypatch.setattr(col, "pair_map", lambda chunks, longest, least: np.full(col.MAP_BITS // 8, 255, np.uint8))
    assert found(spark, docs, 10, 100) == want


def test_scores_beyond_64_bits(spark):
    rows = [("en", "a", 1, 6 * 10**15), ("en", "b", 1, 5 * 10**15), ("en", "a b", 2, 5 * 10**15 - 1)]
    scored = col.score_phrases(spark.createDataFrame(rows, "lang string, phrase string, k int, f long"), 2_000_000, 80).collect()
    assert [(r["l"], r["r"], r["score"]) for r in scored] == [(6 * 10**15, 5 * 10**15, 2_000_000 * (5 * 10**15 - 1) // (11 * 10**15))]

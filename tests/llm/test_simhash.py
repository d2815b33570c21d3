"""SimHash groups against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from featureflow.llm import common, simhash
from featureflow.llm.components import connected_components
from featureflow.llm.queries import op6_simhash_near_dedup

from .conftest import EDGE_TEXTS, SF


def brute_fingerprint(text):
    raw = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in raw + " ":
        if c == " " or "\t" <= c <= "\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(fps, distance=3):
    """Group number by fingerprint."""
    u = np.unique(np.array(list(fps), np.uint64))
    group, n = -np.ones(len(u), int), 0
    for i in range(len(u)):
        if group[i] < 0:
            todo, group[i] = [i], n
            while todo:
                near = np.flatnonzero((np.bitwise_count(u ^ u[todo.pop()]) <= distance) & (group < 0))
                group[near] = n
                todo += near.tolist()
            n += 1
    return dict(zip(u.tolist(), group.tolist()))


def check(rows, texts):
    fps = [brute_fingerprint(t) for _, t in texts]
    groups = brute_groups(fps)
    least = {}
    for (d, _), f in zip(texts, fps):
        if d is not None:
            least[groups[f]] = min(d, least.get(groups[f], d))
    want = sorted(((d, f, least.get(groups[f])) for (d, _), f in zip(texts, fps)), key=str)
    assert sorted(rows, key=str) == want


@pytest.mark.parametrize("size", [1, 5, 30])
def test_fingerprints_of_long_texts_in_chunks(monkeypatch, texts, size):
    monkeypatch.setattr(common, "WORD_CHUNK", size)
    for text in [*list(texts.values())[:20], "", "a", "a b", "a b c", " x\x0by\n"]:
        assert simhash.fingerprint(text[:2000]) == brute_fingerprint(text[:2000])


def test_query_equals_brute_force(spark, texts):
    rows = op6_simhash_near_dedup(spark, SF).collect()
    assert all(len(r["fingerprint"]) == 16 for r in rows)
    check([(r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in rows], list(texts.items()))


def test_edge_cases(edge, empty):
    rows = simhash.near_duplicates(edge).collect()
    check([(r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in rows], EDGE_TEXTS)
    assert simhash.near_duplicates(empty).collect() == []
    kept = simhash.keep_one(edge)
    assert kept.columns == edge.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=str)
    # One row of every group, named or not: the null text without an id is in
    # the group of the empty texts.
    assert ids == sorted([1, 2, 6, None, 8, 9, 10, 11], key=str)


def test_one_row_of_every_group_stays(spark):
    """Rows that share an id, or have none, are told apart by their texts."""
    rows = [(1, "alpha beta gamma delta epsilon", "a"), (1, "quite another text with other words in it", "b"),
            (2, "and a third one that is like neither of them", "c"), (None, "alpha beta gamma delta epsilon", "d"),
            (None, "nobody named this text and it has no copy", "e"), (None, "nobody named this text and it has no copy", "e"),
            (1, "quite another text with other words in it", "f"), (3, "", "g"), (None, None, "h"), (4, None, "i")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = sorted((tuple(r) for r in simhash.keep_one(df).collect()), key=str)
    groups = {}
    for r in rows:
        groups.setdefault(r[1] or "", []).append(r)
    assert len(kept) == len(groups)
    for r in kept:
        own = groups.pop(r[1] or "")
        assert r in own and (r[0] is not None or all(x[0] is None for x in own))
        assert r[0] == min((x[0] for x in own if x[0] is not None), default=None)
    assert sorted((tuple(r) for r in simhash.keep_one(df.orderBy("source")).collect()), key=str) == kept


@pytest.mark.parametrize("linked", [False, True])
def test_cost_of_a_dense_bucket(linked):
    """Fifty thousand fingerprints in one bucket: far from all pairs compared."""
    rng = np.random.default_rng(7)
    if linked:
        centre = np.uint64(rng.integers(0, 1 << 63))
        fps = np.full(50_000, centre, np.uint64)
        for _ in range(3):
            fps ^= np.uint64(1) << rng.integers(32, 64, len(fps)).astype(np.uint64)
    else:
        fps = rng.integers(0, 1 << 32, 50_000, dtype=np.uint64) << np.uint64(32)
    fps, compared = np.unique(fps), 0

    class Counted(simhash.Ring):
        def near(self, one, others, start):
            nonlocal compared
            compared += len(others)
            return super().near(one, others, start)

    found = Counted(3).forest(fps, 0)
    forest = simhash._Forest()
    for a, b in found:
        forest.join(a, b)
    groups = brute_groups(fps[:300].tolist()) if not linked else None
    if linked:
        assert len({forest.find(k) for k in range(len(fps))}) == 1
    else:
        whole = {k: forest.find(k) for k in range(300)}
        for a in range(300):
            for b in range(a):
                if groups[int(fps[a])] == groups[int(fps[b])]:
                    assert whole[a] == whole[b]
    assert compared < len(fps) ** 2 / 8


def dense(seed, centres, each, most):
    rng = random.Random(seed)
    out = set()
    for _ in range(centres):
        c = rng.getrandbits(64)
        for _ in range(each):
            x = c
            for _ in range(rng.randint(0, most)):
                x ^= 1 << rng.randrange(64)
            out.add(x)
    return sorted(out)


@pytest.mark.parametrize("distance,block", [(3, 1 << 17), (3, 8), (1, 1 << 17), (5, 1 << 17)])
def test_links_connect_exactly(spark, distance, block):
    """Dense clusters, also with buckets far over the block size."""
    fps = dense(distance, 20, 60, distance + 2)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    edges = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.links(df, distance, block).collect()]
    assert all(bin(a ^ b).count("1") <= distance for a, b in edges)
    forest = simhash._Forest()
    for a, b in edges:
        forest.join(a, b)
    groups = brute_groups(fps, distance)
    pairs = {(forest.find(x), groups[x]) for x in fps}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_pigeonring_keeps_every_link():
    """Each pair within the distance passes the chain from some start."""
    rng = random.Random(2)
    ring = simhash.Ring(3)
    for _ in range(2000):
        a = b = rng.getrandbits(64)
        for _ in range(rng.randint(0, 3)):
            b ^= 1 << rng.randrange(64)
        others = np.array([b], np.uint64)
        shared = [set(zip(*(x.tolist() for x in ring.buckets(np.array([v], np.uint64))))) for v in (a, b)]
        starts = {kind >> 8 for _, kind in shared[0] & shared[1]}
        assert any(len(ring.near(np.uint64(a), others, s)) for s in starts)


def test_a_dense_bucket_gives_a_forest_not_all_pairs():
    fps = np.array(dense(1, 1, 3000, 2), np.uint64)
    assert len(simhash.Ring(3).forest(fps, 0)) < len(fps)


def test_components_of_long_paths_and_empty(spark):
    edges = [(k, k + 1) for k in range(150)] + [(500, 499), (500, 500), (7, 6)]
    found = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{k: 0 for k in range(151)}, 499: 499, 500: 499}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []

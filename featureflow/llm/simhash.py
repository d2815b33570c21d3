"""SimHash fingerprints and near-duplicate groups by pigeonring filtering.

**Fingerprint**: lower-case ASCII words, shingles of ``shingle`` words
(repeats included), XXH64 with seed 42; a bit is 1 if it is set in over half
of the hashes.

**Candidates**: with distance t, 64 bits are cut into m = t + 1 segments on a
ring.  If two fingerprints differ in at most t bits, some start segment begins
a chain whose first l segments differ in at most l * t / m bits, for every l.
For l = 1 the start segment is equal; for l = 2 the next one differs in at
most one bit.  So every fingerprint is dealt to one bucket for each start and
each bit of the next segment (that bit masked); linked fingerprints share a
bucket.  Within a bucket the longer prefixes of the chain prune what is left,
and the full Hamming distance decides.

**Hot buckets**: distinct fingerprints only are dealt, so copies never meet.
A bucket is searched breadth first against fingerprints not yet reached, which
gives a spanning forest and never all pairs.  Where such scans do not pay (many
fingerprints, few links), the rest is dealt on by the third segment of the chain,
which may differ in two bits at most (both masked), and only small groups are
compared pair by pair.  What a task has joined already is not searched again, and
a task returns each fingerprint with the smallest one it is joined to.  A bucket
beyond ``BLOCK`` fingerprints goes to a second pass over all pairs of its blocks,
each pair a task of its own.

Defined results: null and empty texts have fingerprint zero and link like any
other; repeated rows and null ids are kept, a component is named by its
smallest non-null id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import connected_components

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Fingerprints of a bucket that one search holds; larger buckets are blocked.
BLOCK = 1 << 17
#: Fingerprints that are compared pair by pair, and scans of a bucket (times
#: its size) before it is dealt on.
PAIRWISE = 32
SCANS = 32
#: Hashes expanded to bits at once.
_ROWS = 1 << 15


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit fingerprint of a whole text."""
    # bytes.split() cuts at exactly the six ASCII white-space characters.
    ones, n = np.zeros(64, np.int64), 0
    words: list[bytes] = []
    for chunk in common.word_chunks((text or "").encode().translate(LOWER)):
        words += chunk
        if len(words) < shingle:
            continue
        shingles = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
        hashes = np.frombuffer(b"".join(map(xxhash.xxh64_digest, shingles, repeat(42))), np.uint8).reshape(-1, 8)
        for at in range(0, len(hashes), _ROWS):
            ones += np.unpackbits(hashes[at:at + _ROWS], axis=1).sum(0, dtype=np.int64)
        n += len(hashes)
        words = words[len(words) - shingle + 1:]
    if not n:  # fewer words than a shingle
        return xxhash.xxh64_intdigest(b" ".join(words), 42) if words else 0
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long) and the columns
    ``carry``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in common.text_slices(batch):
                fp = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, len(texts)), pa.array(fp), *(batch.column(c).slice(first, len(texts)) for c in carry)],
                    ["doc_id", "fp", *carry])

    common.ship_package(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), *carry)
    kept = "".join(f", `{c}` {rows.schema[c].dataType.simpleString()}" for c in carry)
    return rows.mapInArrow(run, f"doc_id long, fp long{kept}")


class Ring:
    """The segments of 64 bits for a distance, as masks on a ring."""

    def __init__(self, distance: int):
        self.distance = distance
        self.m = distance + 1
        edges = [64 * k // self.m for k in range(self.m + 1)]
        self.shift = edges[:-1]
        self.width = [b - a for a, b in zip(edges, edges[1:])]
        self.mask = [((1 << w) - 1) << s for w, s in zip(self.width, self.shift)]

    def buckets(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(keys, bucket kind): one key for each start and masked bit.  A key
        holds the bits of the start and next segments, the kind says which."""
        keys, kinds = [], []
        for i in range(self.m):
            j = (i + 1) % self.m
            both = np.uint64(self.mask[i] | self.mask[j])
            for bit in range(self.width[j]):
                keys.append(fp & (both & ~np.uint64(1 << (self.shift[j] + bit))))
                kinds.append(np.full(len(fp), i << 8 | bit, np.int32))
        return np.concatenate(keys), np.concatenate(kinds)

    def chain_masks(self, start: int) -> list[tuple[np.uint64, int]]:
        """(bits of the first l segments, most differences), l from 2 to m."""
        out, bits = [], 0
        for n in range(self.m):
            bits |= self.mask[(start + n) % self.m]
            if n:
                out.append((np.uint64(bits), (n + 1) * self.distance // self.m))
        return out

    def near(self, one: np.uint64, others: np.ndarray, start: int) -> np.ndarray:
        """Places of ``others`` whose chain from ``start`` holds to the end
        (the last prefix is the whole ring: the Hamming distance)."""
        at = np.arange(len(others))
        for bits, most in self.chain_masks(start):
            if not len(at):
                break
            at = at[np.bitwise_count((others[at] ^ one) & bits) <= most]
        return at

    def forest(self, fp: np.ndarray, start: int) -> list[tuple[int, int]]:
        """Links that connect what is linked within one bucket (places in
        ``fp``)."""
        n = len(fp)
        edges, left, reached, scans = [], np.arange(n), [], SCANS * n
        while scans > 0 and (reached or len(left) > 1) and len(left):
            if not reached:
                reached, left = [int(left[0])], left[1:]
            x = reached.pop()
            scans -= len(left)
            near = self.near(fp[x], fp[left], start)
            if len(near):
                got = left[near].tolist()
                edges += [(x, y) for y in got]
                reached += got
                left = np.delete(left, near)
                scans += len(near) * n // 8  # a scan that reaches many pays
        if len(left):
            rest = np.concatenate([np.array(reached, np.int64), left])
            edges += [(int(rest[a]), int(rest[b])) for a, b in self.deal_on(fp[rest], start, len(reached))]
        return edges

    def deal_on(self, fp: np.ndarray, start: int, joined: int) -> Iterator[tuple[int, int]]:
        """Links within a bucket, by the third segment with two bits masked;
        the first ``joined`` are joined already."""
        k = (start + 2) % self.m
        bits = [np.uint64(1 << (self.shift[k] + j)) for j in range(self.width[k])]
        forest = _Forest()
        for x in range(1, joined):
            forest.join(0, x)
        most = max(0, 3 * self.distance // self.m) if self.m > 2 else 0
        for masked in combinations(bits, most):
            keep = np.uint64(self.mask[k])
            for one in masked:
                keep &= ~one
            key = fp & keep
            order = np.argsort(key, kind="stable")
            run = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
            sizes = np.bincount(run)
            small = order[sizes[run] <= PAIRWISE]
            a, b = close_pairs(fp[small], run[sizes[run] <= PAIRWISE], self.distance)
            yield from ((x, y) for x, y in zip(small[a].tolist(), small[b].tolist()) if forest.join(x, y))
            first = np.cumsum(sizes) - sizes
            for r in np.flatnonzero(sizes > PAIRWISE).tolist():
                own = order[first[r]:first[r] + sizes[r]]
                if not forest.one(own.tolist()):
                    found = ((int(own[x]), int(own[y])) for x, y in self.scan(fp[own], start))
                    yield from ((x, y) for x, y in found if forest.join(x, y))

    def scan(self, fp: np.ndarray, start: int) -> Iterator[tuple[int, int]]:
        """Breadth-first search of a group to its end."""
        left, reached = np.arange(len(fp)), []
        while len(left) and (reached or len(left) > 1):
            if not reached:
                reached, left = [int(left[0])], left[1:]
            x = reached.pop()
            near = self.near(fp[x], fp[left], start)
            if len(near):
                got = left[near].tolist()
                yield from ((x, y) for y in got)
                reached += got
                left = np.delete(left, near)


def close_pairs(fp: np.ndarray, run: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, places) of the pairs within runs of equal ``run``, few rows
    each, that differ in ``distance`` bits at most."""
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for gap in range(1, len(fp)):
        same = np.flatnonzero(run[gap:] == run[:-gap])
        if not len(same):
            break
        same = same[np.bitwise_count(fp[same] ^ fp[same + gap]) <= distance]
        a.append(same)
        b.append(same + gap)
    return np.concatenate(a), np.concatenate(b)


class _Forest:
    """Drops edges that join what this task has already joined."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b

    def one(self, nodes: list[int]) -> bool:
        """Whether all of them are joined already."""
        up = self.up
        if nodes[0] not in up:
            return False
        root = self.find(nodes[0])
        return all(x in up and self.find(x) == root for x in nodes)

    def stars(self) -> tuple[list[int], list[int]]:
        """(nodes, the smallest each is joined to), roots left out."""
        pairs = [(x, r) for x in list(self.up) if (r := self.find(x)) != x]
        return [x for x, _ in pairs], [r for _, r in pairs]


_EDGES = "a long, b long, kind int, key long"


def _search(batches: Iterator[pa.RecordBatch], distance: int, block: int | None, stars: bool) -> Iterator[pa.RecordBatch]:
    """Links within runs of equal (part, kind, key) of sorted rows that join
    what the task has not joined before; with ``stars``, at the end, each
    fingerprint and the smallest one it is joined to.  Runs over ``block`` are
    passed on row by row (b null) instead of being searched."""
    ring, forest = Ring(distance), _Forest()

    def rows(a, b, kind=None, key=None):
        n = len(a)
        null = pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(a, pa.int64()), pa.nulls(n, pa.int64()) if b is None else pa.array(b, pa.int64()),
             null[0] if kind is None else pa.array(kind, pa.int32()), null[1] if key is None else pa.array(key, pa.int64())],
            ["a", "b", "kind", "key"])

    def search(part, kind, key, fp):
        cut = np.flatnonzero((key[1:] != key[:-1]) | (kind[1:] != kind[:-1]) | (part[1:] != part[:-1])) + 1
        starts = np.concatenate([[0], cut])
        sizes = np.diff(np.concatenate([starts, [len(fp)]]))
        run = np.repeat(np.arange(len(sizes)), sizes)
        small = np.flatnonzero(sizes[run] <= PAIRWISE)  # the usual buckets: checked all at once
        x, y = close_pairs(fp[small].view(np.uint64), run[small], distance)
        found = list(zip(fp[small][x].tolist(), fp[small][y].tolist()))
        for s, n in zip(starts[sizes > PAIRWISE].tolist(), sizes[sizes > PAIRWISE].tolist()):
            named = fp[s:s + n].tolist()
            if not forest.one(named):
                found += [(named[x], named[y]) for x, y in ring.forest(fp[s:s + n].view(np.uint64), int(kind[s]) >> 8)]
        found = [(x, y) for x, y in found if forest.join(x, y)]
        if found and not stars:
            yield rows(*zip(*found))

    held = None  # rows of the last run, which may go on in the next batch
    passing = None  # (part, kind, key) of a run that is passed on
    for batch in batches:
        part, kind, key, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("part", "kind", "key", "fp"))
        if passing is not None:
            same = (part == passing[0]) & (kind == passing[1]) & (key == passing[2])
            n = int(same.sum())  # sorted: the run is at the front
            if n:
                yield rows(fp[:n], None, kind[:n], key[:n])
            if n == len(fp):
                continue
            passing = None
            part, kind, key, fp = part[n:], kind[n:], key[n:], fp[n:]
        if held is not None:
            part, kind, key, fp = (np.concatenate(x) for x in zip(held, (part, kind, key, fp)))
            held = None
        if not len(fp):
            continue
        last = np.flatnonzero((key != key[-1]) | (kind != kind[-1]) | (part != part[-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield from search(part[:cut], kind[:cut], key[:cut], fp[:cut])
        held = part[cut:], kind[cut:], key[cut:], fp[cut:]
        if block and len(held[3]) > block:
            passing = held[0][0], held[1][0], held[2][0]
            yield rows(held[3], None, held[1], held[2])
            held = None
    if held is not None and len(held[3]) > 1:
        yield from search(*held)
    if stars:
        nodes, roots = forest.stars()
        for at in range(0, len(nodes), 1 << 16):
            yield rows(nodes[at:at + (1 << 16)], roots[at:at + (1 << 16)])


def links(fps: DataFrame, distance: int = 3, block: int = BLOCK, stars: bool = False) -> DataFrame:
    """a, b: links that connect all fingerprints (column ``fp``, distinct) at
    ``distance`` or fewer differing bits.  With ``stars`` a row is a fingerprint
    and the smallest one that its task has joined it to: fewer steps from one
    to another, but not all of them links themselves."""
    spark = fps.sparkSession
    common.ship_package(spark)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ring = Ring(distance)
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            for at in range(0, len(fp), 2048):
                own = fp[at:at + 2048]
                key, kind = ring.buckets(own.view(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kind), pa.array(key.view(np.int64)), pa.array(np.tile(own, len(key) // len(own)))],
                    ["kind", "key", "fp"])

    dealt = fps.select("fp").mapInArrow(deal, "kind int, key long, fp long")
    first = common.stored(
        dealt.withColumn("part", F.lit(0)).repartition("kind", "key").sortWithinPartitions("part", "kind", "key", "fp")
        .mapInArrow(lambda b: _search(b, distance, block, stars), _EDGES), "links")
    edges = first.where("b is not null").select("a", "b")
    large = first.where("b is null").select("kind", "key", F.col("a").alias("fp"))
    if large.isEmpty():
        return edges
    # Blocks of a large bucket, each pair of blocks a run of its own.
    sizes = large.groupBy("kind", "key").agg(F.ceil(F.count("*") / F.lit(block // 2)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks")).cast("int")
    paired = (
        large.join(sizes, ["kind", "key"])
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("part", F.least("own", "other") * F.col("blocks") + F.greatest("own", "other"))
    )
    second = paired.select("part", "kind", "key", "fp").repartition("part", "kind", "key").sortWithinPartitions(
        "part", "kind", "key", "fp").mapInArrow(lambda b: _search(b, distance, None, stars), _EDGES)
    return edges.union(second.select("a", "b"))


def components(groups: DataFrame, distance: int = 3) -> DataFrame:
    """fp, root (the smallest fingerprint of its component) for every row of
    ``groups`` (distinct ``fp``; a stored table)."""
    edges = common.stored(links(groups, distance, stars=True), "star-links")
    roots = connected_components(edges).select(F.col("node").alias("fp"), "root")
    return groups.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 3) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable) for every row."""
    rows = common.stored(fingerprints(docs, shingle), "fingerprints")
    groups = common.stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprint-groups")
    # Stored, so that the join has nothing but its two shuffles below it and
    # Spark can split the partition of a fingerprint that many copies share.
    named = common.stored(components(groups, distance), "fingerprint-components")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = common.stored(named.join(least, "root").select("fp", "component_id"), "fingerprint-names")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, distance: int = 3) -> DataFrame:
    """``docs`` with one row of every group: that with the smallest id (rows
    without an id last), then the smallest hash of its text, then of the whole
    row; of rows equal in everything one."""
    marks = docs.select("*", F.xxhash64("text").alias(_TEXT), F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)).alias(_ROW))
    rows = common.stored(fingerprints(marks, shingle, (_TEXT, _ROW)), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", _TEXT, _ROW)
    # One row per distinct fingerprint, so copies of a text never meet.
    groups = common.stored(rows.groupBy("fp").agg(F.min(order).alias("first")), "fingerprint-groups")
    kept = components(groups, distance).groupBy("root").agg(F.min("first").alias("first")).select(
        F.col("first.doc_id").alias("_id"), F.col(f"first.{_TEXT}").alias("_text"), F.col(f"first.{_ROW}").alias("_row")).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col(_TEXT) == F.col("_text")) & (F.col(_ROW) == F.col("_row"))
    return marks.join(kept, same, "left_semi").dropDuplicates(["doc_id", _TEXT, _ROW]).drop(_TEXT, _ROW)


#: Columns of ``keep_one`` beside those of its documents.
_TEXT, _ROW = "_simhash_text", "_simhash_row"

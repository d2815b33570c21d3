"""Best-fit packing of token pieces into sequences of a fixed capacity.

A document is its ids plus an end id; only documents longer than the capacity
are cut, into pieces of exactly the capacity but for the first, which may be
shorter.  Lengths are whole numbers up to the capacity, so the instance is a
histogram with at most ``capacity`` counts, whatever the number of pieces, and
is solved on the driver in bulk:

1. Dominance reduction (Martello and Toth): a set F that holds item j and at
   most two others is fixed for good if it dominates every other feasible set
   with j.  Fixed are: j alone if nothing else fits; j with k of exactly the
   rest; j with the largest k that fits, if no two others fit or k is at least
   any two that fit; j with two others, if at most two others fit at all and
   they dominate item by item.
2. The remainder goes by best fit, longest first, whole groups of equal
   items into groups of equal bins at a time.

The plan is a table of places (length, ranks) -> (sequences, offset), bounded
by the number of bulk steps.  Each piece then only needs its rank among pieces
of its length: pieces are counted by (length, bucket), the counts are summed
up, and ranks are taken within a bucket, so one length may hold any share of
all pieces.

Defined results: a null text is empty (one piece: the end id); repeated rows
and null ids are packed like any other; an empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .tokens import encoder

#: Buckets in which the pieces of one length are ranked.
BUCKETS = 256

#: A set of equal bins: ((length, times), ...) and how many bins.
Pattern = tuple[tuple[tuple[int, int], ...], int]


def _largest(lengths: list[int], counts: dict[int, int], limit: int, used: dict[int, int] | None = None) -> int:
    """Largest length up to ``limit`` with an item not yet used; 0 if none."""
    used = used or {}
    k = bisect_left(lengths, limit + 1) - 1
    while k >= 0:
        if counts[lengths[k]] > used.get(lengths[k], 0):
            return lengths[k]
        k -= 1
    return 0


def _smallest(lengths: list[int], counts: dict[int, int], but: int, n: int) -> list[int]:
    """The n smallest items, one item of length ``but`` left out."""
    out: list[int] = []
    for x in lengths:
        out += [x] * min(n - len(out), counts[x] - (x == but))
        if len(out) >= n:
            break
    return out


def _dominating(j: int, lengths: list[int], counts: dict[int, int], capacity: int) -> tuple[int, ...] | None:
    """Others that, with j, dominate every feasible set that holds j."""
    rest = capacity - j
    k = _largest(lengths, counts, rest, {j: 1})
    if not k:
        return ()
    if k == rest:
        return (k,)
    low = _smallest(lengths, counts, j, 3)
    if len(low) < 2 or low[0] + low[1] > rest:
        return (k,)
    if len(low) == 3 and sum(low) <= rest:
        return None
    # At most two others fit: the best pair, each item the larger one in turn.
    best, a = 0, k
    while a:
        b = _largest(lengths, counts, min(a, rest - a), {j: 1} | ({a: 1 + (a == j)}))
        if b:
            best = max(best, a + b)
        if 2 * a <= best:
            break
        a = _largest(lengths, counts, a - 1, {j: 1})
    if k >= best:
        return (k,)
    b = _largest(lengths, counts, rest - k, {j: 1} | {k: 1 + (k == j)})
    d = _largest(lengths, counts, rest // 2, {j: 1})
    return (k, b) if b and b >= d else None


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """(fixed bins, remaining counts); see the module."""
    counts = {x: n for x, n in counts.items() if n}
    fixed: list[Pattern] = []
    changed = True
    while changed:
        changed = False
        lengths = sorted(counts)
        for j in reversed(lengths):
            while counts.get(j):
                found = _dominating(j, lengths, counts, capacity)
                if found is None:
                    break
                need: dict[int, int] = {}
                for x in (j, *found):
                    need[x] = need.get(x, 0) + 1
                times = min(counts[x] // n for x, n in need.items())
                fixed.append((tuple(sorted(need.items(), reverse=True)), times))
                for x, n in need.items():
                    counts[x] -= n * times
                changed = True
        counts = {x: n for x, n in counts.items() if n}
    return fixed, counts


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best fit, longest items first.  Groups of bins with equal contents move
    together; equal items fill a bin as often as they fit, as one by one."""
    rests: list[int] = []  # with open bins, ascending
    groups: dict[int, list[Pattern]] = {}

    def put(rest: int, pattern: Pattern) -> None:
        if rest not in groups:
            groups[rest] = []
            insort(rests, rest)
        groups[rest].append(pattern)

    for x in sorted(counts, reverse=True):
        left = counts[x]
        while left:
            k = bisect_left(rests, x)
            if k == len(rests):
                times = capacity // x
                whole, part = divmod(left, times)
                if whole:
                    put(capacity - times * x, (((x, times),), whole))
                if part:
                    put(capacity - part * x, (((x, part),), 1))
                break
            rest = rests[k]
            contents, bins = groups[rest].pop()
            if not groups[rest]:
                del groups[rest]
                rests.pop(k)
            times = rest // x
            whole, part = divmod(left, times)
            if whole >= bins:
                whole, part = bins, 0
            if whole:
                put(rest - times * x, (contents + ((x, times),), whole))
            if part:
                put(rest - part * x, (contents + ((x, part),), 1))
            if bins > whole + (part > 0):
                put(rest, (contents, bins - whole - (part > 0)))
            left -= whole * times + part
    return [p for rest in rests for p in groups[rest]]


#: length, first rank, times in a bin, bins, first sequence, offset in a bin
PLACES = np.dtype([(n, "<i8") for n in ("length", "rank", "times", "bins", "sequence", "offset")])


def plan_places(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Places of every item, sorted by (length, first rank)."""
    fixed, rest = reduce_by_dominance(counts, capacity)
    rows, taken, sequence = [], dict.fromkeys(counts, 0), 0
    for contents, bins in [*fixed, *best_fit(rest, capacity)]:
        offset = 0
        for length, times in contents:
            rows.append((length, taken[length], times, bins, sequence, offset))
            taken[length] += times * bins
            offset += times * length
        sequence += bins
    if taken != dict(counts):
        raise RuntimeError("the packing plan does not hold every piece")
    return np.sort(np.array(rows, PLACES), order=["length", "rank"])


def place(length: np.ndarray, rank: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of items by length and rank."""
    edges = np.searchsorted(places["length"], np.unique(places["length"]))
    starts = dict(zip(places["length"][edges].tolist(), edges.tolist()))
    ends = dict(zip(starts, [*edges[1:].tolist(), len(places)]))
    row = np.zeros(len(length), np.int64)
    for x in np.unique(length).tolist():
        own = length == x
        a, b = starts[x], ends[x]
        row[own] = a + np.searchsorted(places["rank"][a:b], rank[own], side="right") - 1
    p = places[row]
    k = rank - p["rank"]
    return p["sequence"] + k % p["bins"], p["offset"] + k // p["bins"] * length


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """One row per piece; ``with_ids`` adds the ids (array of int)."""
    end = np.array([end_id], "<u4").tobytes()
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for batch in batches:
            for first, texts in common.text_slices(batch):
                ids = batch.column("doc_id").slice(first, len(texts)).to_pylist()
                doc, piece, start, length, crc, own = [], [], [], [], [], []
                for d, code in zip(ids, enc.encode(texts)):
                    code += end
                    n = len(code) // 4
                    at, k = 0, 0
                    while at < n:
                        size = n % capacity or capacity if k == 0 else capacity
                        part = code[4 * at:4 * (at + size)]
                        doc.append(d), piece.append(k), start.append(at), length.append(size)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            own.append(np.frombuffer(part, "<i4"))
                        at, k = at + size, k + 1
                columns = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                           pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(own, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    common.ship_package(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(cut, schema)


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Add sequence_id and offset to stored pieces with a ``length`` column.
    ``pieces`` must be a stored table (it is read twice)."""
    spark = pieces.sparkSession
    bucketed = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(BUCKETS)))
    # At most capacity x BUCKETS rows, whatever the number of pieces.
    counts = common.stored(bucketed.groupBy("length", "_bucket").agg(F.count("*").alias("_n")), "pack-counts")
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    places = plan_places(total, capacity)
    before = W.partitionBy("length").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    in_bucket = W.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = (
        bucketed.withColumn("_rank", F.row_number().over(in_bucket) - 1)
        .join(bases, ["length", "_bucket"])
        .withColumn("_rank", F.col("_rank") + F.col("_base"))
        .select(*pieces.columns, "_rank")
    )
    shared = spark.sparkContext.broadcast(places)  # bounded by the bulk steps

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            length = batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column("_rank").to_numpy(zero_copy_only=False).astype(np.int64)
            sequence, offset = place(length, rank, shared.value)
            kept = [c for c in batch.schema.names if c != "_rank"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(assign, f"{fields}, sequence_id long, offset long")


def packed_sequences(packed: DataFrame) -> DataFrame:
    """Whole sequences of ids from pieces packed ``with_ids``: a group holds
    one sequence, so at most the capacity."""
    return packed.groupBy("sequence_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda s: s["ids"])).alias("ids"),
        F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "piece"))).alias("pieces"))


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    pieces = common.stored(token_pieces(docs, tokenizer_path, end_id, capacity, with_ids), "pieces")
    return pack(pieces, capacity)

"""Hierarchical multi-length packing.

A document is its ids plus an end id.  Context sizes form tiers, powers of two
from the largest down (1024, 512, 256, 128).  Whole windows of the largest size
are cut off the front of a document; the rest goes to the smallest tier that
holds it.  Lengths are at most the largest size, so the instance is a histogram
with as many counts, whatever the number of pieces, and is planned on the driver
in bulk, a tier at a time from the longest:

1. **Pack the tier**: its own pieces, longest first, each into the tightest
   window that still holds it, else into a new window.
2. **Fill gaps** of these long windows with whole pieces of shorter tiers,
   longest first, tightest gap first.
3. **Close gaps** that nothing fits whole: a longer piece of a shorter tier is
   cut; its head closes the gap, its tail is a piece like any other.  If no
   shorter piece is left, windows with the largest gaps are taken apart again,
   just as many as the other gaps need.
4. What is left (less than a window) goes down a tier; less than the smallest
   window ends in one window for each power of two in its size.

Every sequence is full, at a tier's size or, for the last few tokens, at a smaller
power of two: there is no padding.  **Steps**: sequences of one tier form step
groups of equal tokens.  They are ordered by their attention cost (sum of squared
lengths) and dealt to the groups to and fro, so groups cost about the same.

The plan maps (length, rank) of a piece to a place or to a cut, whose parts have
a (length, rank) of their own; it is bounded by its bulk steps, not by the corpus.
Ranks come from ``count_preceding``, which splits a length of any share.

Defined results: a null text is empty (one piece: the end id); repeated rows and
null ids are packed like any other; an empty table gives no rows; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import count_preceding
from . import common
from .token_files import id_dtype
from .tokens import encoder

TIERS = (1024, 512, 256, 128)
STEP_TOKENS = 1 << 16

#: length, first rank -> first sequence and offset, or, with a head, the first
#: ranks of the two parts that the head's length cuts.
PLAN = np.dtype([(n, "<i8") for n in ("length", "rank", "head", "first", "second")])

#: Equal windows: how many, and (length, first rank) of what each holds.
Windows = tuple[int, tuple[tuple[int, int], ...]]


@dataclass(frozen=True)
class Tier:
    """Sequences of one size: the first one's id, how many, and the id of the
    first step and number of steps."""

    size: int
    first: int
    sequences: int
    first_step: int
    steps: int


class _Planner:
    """Pieces by length and rank, and what becomes of them."""

    def __init__(self, counts: dict[int, int]):
        self.free: dict[int, list[tuple[int, int]]] = defaultdict(list)  # length -> runs (rank, n)
        self.ranks: dict[int, int] = defaultdict(int)
        self.lengths: list[int] = []
        self.cuts: list[tuple[int, int, int, int, int]] = []
        self.full: dict[int, list[Windows]] = defaultdict(list)
        for x in sorted(counts):
            if counts[x]:
                self.new(x, counts[x])

    def new(self, length: int, n: int) -> int:
        """``n`` new pieces; their first rank."""
        rank = self.ranks[length]
        self.ranks[length] += n
        self.give(length, rank, n)
        return rank

    def give(self, length: int, rank: int, n: int) -> None:
        if not self.free[length]:
            insort(self.lengths, length)
        self.free[length].append((rank, n))

    def take(self, length: int, most: int) -> tuple[int, int]:
        """A run of at most ``most`` pieces: (first rank, n)."""
        rank, n = self.free[length].pop()
        if n > most:
            self.free[length].append((rank + most, n - most))
            n = most
        if not self.free[length]:
            self.lengths.remove(length)
        return rank, n

    def longest(self, limit: int) -> int:
        k = bisect_left(self.lengths, limit + 1)
        return self.lengths[k - 1] if k else 0

    def cut(self, length: int, head: int, most: int) -> None:
        """Cut up to ``most`` pieces in two; both parts are free."""
        rank, n = self.take(length, most)
        first = self.new(head, n)
        self.cuts.append((length, rank, head, first, self.new(length - head, n)))

    def tier(self, size: int, above: int) -> None:
        """Fill windows of ``size`` with the pieces longer than ``above``."""
        while (x := self.longest(1 << 62)) > size:
            self.cut(x, size, 1 << 62)
        gaps: list[int] = []
        open_: dict[int, list[Windows]] = defaultdict(list)

        def put(gap: int, windows: Windows) -> None:
            if not gap:
                self.full[size].append(windows)
                return
            if not open_[gap]:
                insort(gaps, gap)
            open_[gap].append(windows)

        def get(gap: int) -> Windows:
            windows = open_[gap].pop()
            if not open_[gap]:
                gaps.remove(gap)
            return windows

        def fill(gap: int, length: int) -> None:
            """One run of pieces into one group of windows."""
            n, held = get(gap)
            rank, took = self.take(length, n)
            if took < n:
                put(gap, (n - took, tuple((x, r + took) for x, r in held)))
            put(gap - length, (took, (*held, (length, rank))))

        x = self.longest(size)
        while x > above:  # own pieces
            while self.free.get(x):
                k = bisect_left(gaps, x)
                if k < len(gaps):
                    fill(gaps[k], x)
                else:
                    rank, n = self.take(x, max(1, self.free[x][-1][1] // max(1, size // x)))
                    put(size - x, (n, ((x, rank),)))
            x = self.longest(x - 1)
        while x:  # pieces of shorter tiers
            while self.free.get(x) and (k := bisect_left(gaps, x)) < len(gaps):
                fill(gaps[k], x)
            x = self.longest(x - 1)
        while gaps:
            gap = gaps[-1]
            if x := self.longest(gap):
                fill(gap, x)
            elif self.lengths:
                self.cut(self.lengths[-1], gap, sum(n for n, _ in open_[gap]))
            else:
                # Each window taken apart gives its pieces and takes away its gap.
                apart = -(-sum(g * n for g in gaps for n, _ in open_[g]) // size)
                while apart:
                    gap = gaps[-1]
                    n, held = get(gap)
                    some = min(n, apart)
                    if some < n:
                        put(gap, (n - some, tuple((x, r + some) for x, r in held)))
                    for x, r in held:
                        self.give(x, r, some)
                    apart -= some

    def rest(self) -> None:
        """Less than the smallest window: one for each power of two."""
        left = sum(x * n for x, runs in self.free.items() for _, n in runs)
        while left:
            size = 1 << left.bit_length() - 1
            held: tuple[tuple[int, int], ...] = ()
            gap = size
            while gap:
                x = self.longest(gap)
                if not x:
                    self.cut(self.lengths[-1], gap, 1)
                    continue
                held = (*held, (x, self.take(x, 1)[0]))
                gap -= x
            self.full[size].append((1, held))
            left -= size


def plan(counts: dict[int, int], sizes: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS) -> tuple[np.ndarray, list[Tier]]:
    """(places and cuts sorted by length and rank, tiers) for pieces counted
    by length, none longer than the first of ``sizes``."""
    p = _Planner(counts)
    for size, below in zip(sizes, (*sizes[1:], 0)):
        p.tier(size, below)
    p.rest()
    rows = list(p.cuts)
    tiers, sequence, step = [], 0, 0
    for size in sorted(p.full, reverse=True):
        first = sequence
        for n, held in sorted(p.full[size], key=lambda w: -sum(x * x for x, _ in w[1])):
            offset = 0
            for x, rank in held:
                rows.append((x, rank, 0, sequence, offset))
                offset += x
            sequence += n
        steps = -(-(sequence - first) // max(1, step_tokens // size))
        tiers.append(Tier(size, first, sequence - first, step, steps))
        step += steps
    return np.sort(np.array(rows, PLAN), order=["length", "rank"]), tiers


def resolve(length: np.ndarray, rank: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, start, length, sequence, offset) of the parts of pieces given by
    length and rank; ``start`` is the part's place within its piece."""
    lengths, edges = np.unique(table["length"], return_index=True)
    ends = np.append(edges[1:], len(table))
    row, start, done = np.arange(len(length)), np.zeros(len(length), np.int64), []
    while len(row):
        at = np.zeros(len(row), np.int64)
        for x in np.unique(length).tolist():
            own = length == x
            k = int(np.searchsorted(lengths, x))
            at[own] = edges[k] + np.searchsorted(table["rank"][edges[k]:ends[k]], rank[own], side="right") - 1
        found = table[at]
        k = rank - found["rank"]
        whole = found["head"] == 0
        done.append(tuple(c[whole] for c in (row, start, length, found["first"] + k, found["second"])))
        cut = ~whole
        head = found["head"][cut]
        row, start, rank, length = (
            np.concatenate(c) for c in (
                (row[cut], row[cut]), (start[cut], start[cut] + head),
                ((found["first"] + k)[cut], (found["second"] + k)[cut]), (head, length[cut] - head)))
    return tuple(np.concatenate(c) for c in zip(*done))


def step_of(sequence: np.ndarray, tiers: list[Tier]) -> tuple[np.ndarray, np.ndarray]:
    """(size, step) of sequences: to and fro over the steps of their tier."""
    size, step = np.zeros(len(sequence), np.int64), np.zeros(len(sequence), np.int64)
    for t in tiers:
        own = (sequence >= t.first) & (sequence < t.first + t.sequences)
        turn, k = np.divmod(sequence[own] - t.first, t.steps)
        size[own] = t.size
        step[own] = t.first_step + np.where(turn % 2, t.steps - 1 - k, k)
    return size, step


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                     ("doc_tokens", pa.int64()), ("ids", pa.binary())])


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, largest: int) -> DataFrame:
    """Whole windows of ``largest`` ids, and the rest of each document with its
    ids (it may be cut later), 16-bit where the vocabulary allows it."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        dtype = id_dtype(max(enc.tokenizer.get_vocab_size() - 1, end_id))
        for batch in batches:
            for first, texts in common.text_slices(batch):
                rows = []
                for doc, code in zip(batch.column("doc_id").slice(first, len(texts)).to_pylist(), enc.encode(texts)):
                    code += end
                    n = len(code) // 4
                    for at in range(0, n, largest):
                        part = code[4 * at:4 * (at + largest)]
                        own = None if len(part) == 4 * largest else np.frombuffer(part, "<u4").astype(dtype).tobytes()
                        rows.append((doc, at, len(part) // 4, zlib.crc32(part), n, own))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PIECES)], schema=_PIECES)

    common.ship_package(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(cut, PIECES)


PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, context long, step long"


def pack_multi_length(docs: DataFrame, tokenizer_path: str, end_id: int, sizes: tuple[int, ...] = TIERS,
                      step_tokens: int = STEP_TOKENS) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    context (size of the sequence), step (its step group) of every piece."""
    spark = docs.sparkSession
    if list(sizes) != sorted({s for s in sizes if s > 0 and s & s - 1 == 0}, reverse=True):
        raise ValueError("sizes are powers of two, largest first")
    cut = common.stored(pieces(docs, tokenizer_path, end_id, sizes[0]), "multi-length-pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # one row per length
    table, tiers = plan(counts, sizes, step_tokens)
    shared = spark.sparkContext.broadcast((table, tiers))  # bounded by the bulk steps
    columns = ["doc_id", "start", "ids_crc32", "doc_tokens", "ids"]
    tied = cut.withColumn("one", F.lit(1)).withColumn("tie", F.xxhash64("doc_id", "start", "ids_crc32"))
    ranked = count_preceding(tied, ["length"], ["tie"], "one", ["tie"], out="rank", carry=columns)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_table, own_tiers = shared.value
        dtype = None
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank, before, crc = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
                                         for c in ("length", "rank", "start", "ids_crc32"))
            row, start, part, sequence, offset = resolve(length, rank, own_table)
            code = crc[row]
            ids = batch.column("ids")
            for k in np.flatnonzero(part != length[row]).tolist():
                raw = ids[int(row[k])].as_py()
                dtype = f"<u{len(raw) // int(length[row[k]])}"
                a = int(start[k])
                code[k] = zlib.crc32(np.frombuffer(raw, dtype)[a:a + int(part[k])].astype("<u4").tobytes())
            size, step = step_of(sequence, own_tiers)
            rows = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(rows), pa.array(before[row] + start), pa.array(part), pa.array(code),
                 batch.column("doc_tokens").take(rows), pa.array(sequence), pa.array(offset), pa.array(size), pa.array(step)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "context", "step"])

    return ranked.select("length", "rank", *columns).mapInArrow(place, PLACED)

"""Benchmark decontamination with an FM-index per shard of documents.

A task cuts its documents into shards.  In a shard only runs of words that the
benchmark has, at least as long as its shortest window, can hold an occurrence;
these runs, kept apart by a separator, are the indexed sequence.  The index has
a suffix order (prefix doubling), the Burrows-Wheeler transform in a wavelet
tree with rank counts, and every eighth suffix position.  All windows of the
benchmark are searched backward together; occurrences are located by walking
to a sampled position, and merged to spans of words.

Words: A-Z lower-cased, then runs of digits, a-z and any non-ASCII characters.
A window: ``window`` consecutive words of an item; an item of fewer words, but
not none, is one window.

The benchmark is a stated set of queries: tasks build its windows in blocks of
bounded size and store them in the shared folder; searching tasks read one block
after another, and hold one.  The driver only knows the names of the blocks.

Defined results: null and empty texts have no words and no hits; items without
words are never found; repeated items count once by id; a null item id is an
empty string; repeated documents, null ids and very long texts (indexed in
overlapping cuts) are treated like any other; an empty benchmark finds nothing;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes to words: lower case, every delimiter a space.
_WORD_BYTES = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Characters of text in a shard, symbols in one index.
SHARD_CHARS = 8 << 20
INDEX_SYMBOLS = 1 << 20
#: Distance of sampled suffix positions.
SAMPLE = 8
#: Benchmark text in one block, in characters.
BLOCK_CHARS = 16 << 20

_END, _GAP = 0, 1  # symbols that no window has


def word_chunks_of(text: str | None) -> Iterator[list[bytes]]:
    return common.word_chunks((text or "").encode().translate(_WORD_BYTES))


def words_of(text: str | None) -> list[bytes]:
    return [w for chunk in word_chunks_of(text) for w in chunk]


class WaveletTree:
    """Rank over a sequence, the levels of the tree laid out as a matrix."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.ones, self.zeros = [], []
        rest = sequence
        for level in reversed(range(self.levels)):
            bit = (rest >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(len(rest) - int(self.ones[-1][-1]))
            rest = np.concatenate([rest[bit == 0], rest[bit == 1]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs before ``end`` (arrays)."""
        first, last = np.zeros(len(end), np.int64), end.astype(np.int64)
        for k in range(self.levels):
            bit = (symbol >> (self.levels - 1 - k)) & 1
            ones = self.ones[k]
            a, b = ones[first], ones[last]
            first = np.where(bit, self.zeros[k] + a, first - a)
            last = np.where(bit, self.zeros[k] + b, last - b)
        return last - first


def suffix_order(sequence: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; the last symbol must be the smallest
    and unique."""
    rank = np.unique(sequence, return_inverse=True)[1].astype(np.int64)
    n, step = len(sequence), 1
    while True:
        key = rank * (n + 1)
        key[:-step or None] += rank[step:] + 1 if step < n else 0
        order = np.argsort(key)
        ordered = key[order]
        new = np.zeros(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        if new.max() == n - 1:
            return order
        rank, step = new, 2 * step


class FMIndex:
    """Backward search and location over a sequence of symbols from 0 (the
    last symbol, and it only, must be 0)."""

    def __init__(self, sequence: np.ndarray, symbols: int, sample: int = SAMPLE):
        order = suffix_order(sequence)
        self.transform = sequence[order - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(sequence, minlength=symbols))])
        self.tree = WaveletTree(self.transform, symbols)
        sampled = order % sample == 0
        self.sampled = sampled
        self.sample_place = np.cumsum(sampled) - 1
        self.positions = order[sampled]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [first, last) of patterns of one length (a row each)."""
        last_symbol = patterns[:, -1]
        first, last = self.before[last_symbol].copy(), self.before[last_symbol + 1].copy()
        for k in reversed(range(patterns.shape[1] - 1)):
            alive = np.flatnonzero(first < last)
            if not len(alive):
                break
            c = patterns[alive, k]
            first[alive] = self.before[c] + self.tree.rank(c, first[alive])
            last[alive] = self.before[c] + self.tree.rank(c, last[alive])
        return first, last

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of rows: back to a sampled one, counting the steps."""
        rows, out = rows.copy(), np.zeros(len(rows), np.int64)
        left, steps = np.arange(len(rows)), 0
        while len(left):
            there = self.sampled[rows[left]]
            done = left[there]
            out[done] = self.positions[self.sample_place[rows[done]]] + steps
            left = left[~there]
            c = self.transform[rows[left]]
            rows[left] = self.before[c] + self.tree.rank(c, rows[left])
            steps += 1
        return out


@dataclass
class Windows:
    """Distinct windows of a block of the benchmark."""

    vocabulary: dict[bytes, int]
    patterns: list[np.ndarray]  # by length: a row of symbols per window
    owners: list[list[tuple[int, ...]]]  # by length: items of each window
    items: list[str]

    @property
    def lengths(self) -> list[int]:
        return [p.shape[1] for p in self.patterns]

    @property
    def symbols(self) -> int:
        return len(self.vocabulary) + 2


def windows_of(items: list[tuple[str, str | None]], window: int) -> Windows:
    vocabulary: dict[bytes, int] = {}
    found: dict[int, dict[tuple[int, ...], set[int]]] = {}
    names = sorted({i for i, _ in items})
    number = {n: k for k, n in enumerate(names)}
    for item, text in items:
        own = [vocabulary.setdefault(w, len(vocabulary) + 2) for w in words_of(text)]
        size = min(window, len(own))
        for at in range(len(own) - size + 1 if own else 0):
            found.setdefault(size, {}).setdefault(tuple(own[at:at + size]), set()).add(number[item])
    sizes = sorted(found)
    return Windows(vocabulary, [np.array(list(found[s]), np.int64) for s in sizes],
                   [[tuple(sorted(o)) for o in found[s].values()] for s in sizes], names)


@dataclass
class Hit:
    """What a document shares with the benchmark: merged spans of words (end
    exclusive) and item names."""

    n_words: int
    spans: list[tuple[int, int]]
    items: set[str]


def _runs(symbols: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """Runs of benchmark words of at least ``least`` words."""
    known = np.concatenate([[False], symbols > 0, [False]])
    edges = np.flatnonzero(known[1:] != known[:-1]).reshape(-1, 2)
    for a, b in edges[edges[:, 1] - edges[:, 0] >= least].tolist():
        yield a, b


def search_shard(texts: list[str | None], windows: Windows) -> list[Hit]:
    """One FM-index after another over the texts; see the module."""
    hits = [Hit(0, [], set()) for _ in texts]
    if not windows.patterns:
        for hit, text in zip(hits, texts):
            hit.n_words = sum(map(len, word_chunks_of(text)))
        return hits
    least, longest = min(windows.lengths), max(windows.lengths)
    spans: dict[int, list[np.ndarray]] = {}
    parts: list[np.ndarray] = []
    places: list[tuple[int, int, int]] = []  # first symbol, document, first word
    held = 0

    def flush() -> None:
        nonlocal held
        if not parts:
            return
        sequence = np.concatenate([*parts, [_END]])
        index = FMIndex(sequence, windows.symbols)
        starts, documents, first_words = np.array(places).T
        for patterns, owners in zip(windows.patterns, windows.owners):
            first, last = index.search(patterns)
            which = np.flatnonzero(first < last)
            if not len(which):
                continue
            count = (last - first)[which]
            offsets = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            at = index.locate(np.repeat(first[which], count) + offsets)
            run = np.searchsorted(starts, at, side="right") - 1
            doc, word = documents[run], first_words[run] + at - starts[run]
            window = np.repeat(which, count)
            for d, w in np.unique(np.stack([doc, window], 1), axis=0).tolist():
                hits[d].items.update(windows.items[i] for i in owners[w])
            for d in np.unique(doc).tolist():
                own = word[doc == d]
                spans.setdefault(d, []).append(np.stack([own, own + patterns.shape[1]], 1))
        parts.clear(), places.clear()
        held = 0

    for d, text in enumerate(texts):
        symbols = np.concatenate([np.zeros(0, np.int64), *(
            np.fromiter(map(windows.vocabulary.get, words, repeat(0)), np.int64, len(words)) for words in word_chunks_of(text))])
        hits[d].n_words = len(symbols)
        for a, b in _runs(symbols, least):
            # Very long runs are cut with an overlap of a window less one word.
            while True:
                end = min(b, a + INDEX_SYMBOLS)
                places.append((held, d, a))
                parts += [symbols[a:end], np.array([_GAP])]
                held += end - a + 1
                if held >= INDEX_SYMBOLS:
                    flush()
                if end == b:
                    break
                a = end - longest + 1
    flush()
    for d, found in spans.items():
        hits[d].spans = merged(np.concatenate(found))
    return hits


def merged(spans: np.ndarray) -> list[tuple[int, int]]:
    """Union of [start, end) rows, ascending; spans that touch become one."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    at = np.flatnonzero(new)
    return list(zip(spans[at, 0].tolist(), reach[np.concatenate([at[1:] - 1, [len(spans) - 1]])].tolist()))


def search_blocks(texts: list[str | None], blocks) -> list[Hit]:
    """Hits of all blocks of the benchmark together."""
    out: list[Hit] | None = None
    for block in blocks:
        hits = search_shard(texts, block)
        if out is None:
            out = hits
            continue
        for all_hits, hit in zip(out, hits):
            all_hits.items |= hit.items
            if hit.spans:
                all_hits.spans = merged(np.array(all_hits.spans + hit.spans))
    return search_shard(texts, Windows({}, [], [], [])) if out is None else out


#: The block that this worker has read last, by its file.
_HELD: dict[str, Windows] = {}


@dataclass(frozen=True)
class Blocks:
    """Stored windows of a benchmark; iterating reads one block at a time."""

    folder: str
    names: tuple[str, ...]

    def __iter__(self) -> Iterator[Windows]:
        fs, root = common.file_system(self.folder)
        for name in self.names:
            path = f"{root}/{name}"
            if path not in _HELD:
                _HELD.clear()
                with fs.open_input_file(path) as f:
                    _HELD[path] = pickle.loads(f.read())
            yield _HELD[path]


def benchmark_blocks(benchmark: DataFrame, window: int) -> Blocks:
    """The windows of a benchmark in files of about ``BLOCK_CHARS`` characters of
    its text each (an item is never split), built by tasks."""
    spark = benchmark.sparkSession
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.coalesce(F.col("text"), F.lit("")).alias("t")).distinct()
    chars = items.agg(F.sum(F.char_length("t"))).first()[0] or 0
    n = max(1, -(-chars // BLOCK_CHARS))
    folder = common.shared_folder(spark, "benchmark-windows")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = common.file_system(folder)
        held: list[tuple[str, str]] = []
        block = None

        def write() -> Iterator[pa.RecordBatch]:
            if held:
                name = f"block-{block:06d}.pickle"
                f = common.AtomicFile(fs, f"{root}/{name}")
                f.write(pickle.dumps(windows_of(held, window), protocol=pickle.HIGHEST_PROTOCOL))
                f.commit()
                yield pa.RecordBatch.from_pydict({"name": [name]})
                held.clear()

        for batch in batches:
            for b, i, t in zip(*(batch.column(c).to_pylist() for c in ("block", "i", "t"))):
                if b != block:
                    yield from write()
                    block = b
                held.append((i, t))
        yield from write()

    dealt = items.withColumn("block", F.pmod(F.xxhash64("i", "t"), F.lit(n)).cast("int"))
    names = dealt.repartition("block").sortWithinPartitions("block", "i").mapInArrow(build, "name string").collect()
    return Blocks(folder, tuple(sorted(r["name"] for r in names)))  # one per block


SCHEMA = "doc_id long, n_words long, n_hit long, spans array<struct<start:long,end:long>>, items array<string>"


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit (words in spans), spans of words, items (ids with
    occurring windows, sorted as strings) for every document."""
    common.ship_package(docs.sparkSession)
    blocks = benchmark_blocks(benchmark, window)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in common.text_slices(batch, chars=SHARD_CHARS):
                hits = search_blocks(texts, blocks)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(first, len(texts)),
                    pa.array([h.n_words for h in hits], pa.int64()),
                    pa.array([sum(b - a for a, b in h.spans) for h in hits], pa.int64()),
                    pa.array([[{"start": a, "end": b} for a, b in h.spans] for h in hits], span),
                    pa.array([sorted(h.items) for h in hits], pa.list_(pa.string())),
                ], ["doc_id", "n_words", "n_hit", "spans", "items"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, SCHEMA)


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans`` and what stands between them."""
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:places[a][0]])
        at = places[b - 1][1]
    return "".join([*out, text[at:]])


def remove_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """``docs`` (all columns) with every span that the benchmark shares cut
    from ``text``; n_chars, if there is one, follows.  Cutting joins what stood
    around a span, so cut texts are searched again until nothing is found."""
    common.ship_package(docs.sparkSession)
    blocks = benchmark_blocks(benchmark, window)

    def clean(texts: list[str | None]) -> list[str | None]:
        todo = list(range(len(texts)))
        while todo:
            hits = search_blocks([texts[k] for k in todo], blocks)
            found = [(k, h) for k, h in zip(todo, hits) if h.spans]
            for k, h in found:
                texts[k] = cut_words(texts[k], h.spans)
            todo = [k for k, _ in found]
        return texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in common.text_slices(batch, chars=SHARD_CHARS):
                part = batch.slice(first, len(texts))
                cleaned = clean(texts)
                k = batch.schema.get_field_index("text")
                part = part.set_column(k, batch.schema.field(k), pa.array(cleaned, batch.schema.field(k).type))
                if "n_chars" in batch.schema.names:
                    k = batch.schema.get_field_index("n_chars")
                    part = part.set_column(k, batch.schema.field(k), pa.array(
                        [None if t is None else len(t) for t in cleaned]).cast(batch.schema.field(k).type))
                yield part

    return docs.mapInArrow(run, docs.schema)

"""Phrase collocations by prefix-free parsing.

Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends and
into words at spaces and tabs; phrases never leave their piece.

1. **Parse.**  A window of ``longest - 1`` words is a trigger if its hash is 0
   modulo ``PERIOD``.  Chunks go from one trigger to the end of the next one, so
   neighbours share exactly one window and equal content gives equal chunks.
   Chunks of equal text are counted: the dictionary with its parse
   frequencies, one row per distinct (lang, chunk), whatever the copies.
2. **Count.**  N-grams are counted inside distinct chunks, each weighted by the
   chunk's frequency.  The shared window belongs to the later chunk: an n-gram
   counts in the chunk that has its first word before the closing window, so
   every occurrence counts once.  A chunk that ends its piece has no such window.
3. **Prune, exactly.**  A phrase occurs at most as often as each pair of words in
   it.  Pairs are summed by a 64-bit hash first; hashes that reach ``least`` set
   a bit of a map of fixed size, and longer phrases are only counted where all
   their pairs have their bit.  Equal hashes or bits let more through, never
   less; what is kept in the end is decided by exact counts of the words.
4. **Score.**  Cuts, dominated phrases and ranks are joins and grouped minima.

Bounds: a task holds ``FLUSH`` bytes of pieces or ``BLOCK`` words at a time; the
map has ``MAP_BITS`` bits (16 MB, collected and broadcast) at any size of the
corpus - with more frequent pairs than that it prunes less, the results stay.
Chunks are cut after ``LONGEST_CHUNK`` words without a trigger; pieces beyond
``LONG_PIECE`` bytes are parsed in parts that overlap like chunks.

Hot groups: copies are summed before every shuffle; parts of one word, which
many phrases share, are joined under ``SALTS`` keys; the first rows of a lang are
taken in ``BUCKETS`` buckets first, so a lang of any share never meets in a task.

Defined results: null and empty texts have no words; a null lang is ``und``;
repeated rows count again; ties go by phrase in UTF-8 byte order; an empty table
gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Mean number of words from trigger to trigger.
PERIOD = 16
LONGEST_CHUNK = 4096
LONG_PIECE = 1 << 20
FLUSH = 1 << 25
BLOCK = 1 << 20
MAP_BITS = 1 << 27
SALTS = 16
BUCKETS = 32

_ENDS = b".,;:!?\n\v\f\r"
_TABLE = bytes(10 if c in _ENDS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


def pieces(text: str | None) -> list[bytes]:
    """Lower-case pieces that have a word, one space between words."""
    raw = (text or "").encode().translate(_TABLE)
    while b"  " in raw:
        raw = raw.replace(b"  ", b" ")
    raw = raw.replace(b" \n", b"\n").replace(b"\n ", b"\n").strip(b" \n")
    return [p for p in raw.split(b"\n") if p]


def long_parts(piece: bytes, overlap: int, size: int) -> Iterator[tuple[bytes, bool]]:
    """(part, whether it ends the piece): a part closes with ``overlap`` words
    that the next one begins with."""
    at = 0
    while True:
        end = piece.find(b" ", at + size)
        close = end
        for _ in range(overlap):
            close = piece.find(b" ", close + 1) if close >= 0 else -1
        if close < 0:
            yield piece[at:], True
            return
        yield piece[at:close], False
        at = end + 1


def _mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers spread (the usual finalizer of two products)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash(values: pa.Array) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(v) for v in values.to_pylist()], np.uint64)


def _joined(*hashes: np.ndarray) -> np.ndarray:
    out = hashes[0]
    for h in hashes[1:]:
        out = _mixed(out) + h
    return _mixed(out)


class _Words:
    """The words of an array of texts with one space between words."""

    def __init__(self, texts: pa.Array):
        lists = pc.split_pattern(texts, " ")
        self.first = lists.offsets.to_numpy().astype(np.int64)  # of each text, and the end
        coded = lists.flatten().dictionary_encode()
        self.words = coded.dictionary
        self.code = coded.indices.to_numpy().astype(np.int64)
        self.hash = _hash(self.words)
        self.size = np.diff(self.first)


CHUNKS = "lang string, chunk string, ends boolean, words long, n long"
_CHUNKS = pa.schema([("lang", pa.string()), ("chunk", pa.string()), ("ends", pa.bool_()), ("words", pa.int64()), ("n", pa.int64())])


def chunks(texts: list[bytes], n: list[int], ends: list[bool], overlap: int, period: int = PERIOD,
           longest: int = LONGEST_CHUNK) -> tuple[list[bytes], list[bool], np.ndarray, np.ndarray]:
    """(chunks, whether they end their piece, words counted in them, times)."""
    w = _Words(pa.array(texts, pa.string()))
    h = w.hash[w.code]
    row = np.repeat(np.arange(len(texts)), w.size)
    begins = np.zeros(len(h), bool)
    begins[w.first[:-1]] = True
    if len(h) > overlap:
        window = _joined(*(h[k:len(h) - overlap + 1 + k] for k in range(overlap)))
        inside = w.first[1:][row[:len(window)]] - np.arange(len(window)) >= overlap
        begins[:len(window)] |= (window % np.uint64(period) == 0) & inside

    def bounds(start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        last = np.append(row[start[1:]] != row[start[:-1]], True)
        return np.where(last, w.first[1:][row[start]], np.append(start[1:], 0) + overlap), last

    start = np.flatnonzero(begins)
    end, last = bounds(start)
    far = np.flatnonzero(end - start > longest + 2 * overlap)  # no trigger for too long
    if len(far):
        more = [np.arange(a + longest, b - 2 * overlap, longest) for a, b in zip(start[far].tolist(), end[far].tolist())]
        start = np.sort(np.concatenate([start, *more]))
        end, last = bounds(start)
    closes = last & np.array(ends, bool)[row[start]]
    # Words and texts stand one byte apart when the texts are joined.
    size = pc.binary_length(w.words).to_numpy().astype(np.int64)[w.code]
    at = np.cumsum(size + 1) - size - 1
    joined = b"\n".join(texts)
    a, b = at[start].tolist(), (at[end - 1] + size[end - 1]).tolist()
    own = np.where(closes, end - start, end - start - overlap)
    return [joined[x:y] for x, y in zip(a, b)], closes.tolist(), own, np.array(n, np.int64)[row[start]]


def dictionary(docs: DataFrame, longest: int) -> DataFrame:
    """lang, chunk, ends, words (counted in it), n (its parse frequency)."""
    overlap = longest - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, bool], Counter] = {}
        size = 0

        def flush():
            for (lang, ends), counted in held.items():
                texts = list(counted)
                for at in range(0, len(texts), 1 << 17):
                    own = texts[at:at + (1 << 17)]
                    c, closes, words, n = chunks(own, [counted[t] for t in own], [ends] * len(own), overlap)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang], pa.string()).take(pa.array(np.zeros(len(c), np.int64))), pa.array(c, pa.string()),
                         pa.array(closes, pa.bool_()), pa.array(words, pa.int64()), pa.array(n, pa.int64())], schema=_CHUNKS)
            held.clear()

        for batch in batches:
            langs = batch.column("lang")
            for first, texts in common.text_slices(batch):
                for lang, text in zip(langs.slice(first, len(texts)).to_pylist(), texts):
                    own = pieces(text)
                    if not own:
                        continue
                    whole = held.setdefault((lang, True), Counter())
                    if len(text) > LONG_PIECE and max(map(len, own)) > LONG_PIECE:
                        for piece in own:
                            for part, ends in long_parts(piece, overlap, LONG_PIECE):
                                held.setdefault((lang, ends), Counter())[part] += 1
                    else:
                        whole.update(own)
                    size += len(text)
                    if size > FLUSH:
                        yield from flush()
                        size = 0
        yield from flush()

    common.ship_package(docs.sparkSession)
    parsed = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text")).mapInArrow(run, CHUNKS)
    return parsed.groupBy("lang", "chunk", "ends").agg(F.first("words").alias("words"), F.sum("n").alias("n"))


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of one row of each key, sum of n, number of the key by row)."""
    order = np.argsort(key, kind="stable")
    in_order = key[order]
    new = np.append(True, in_order[1:] != in_order[:-1]) if len(key) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    number = np.empty(len(key), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[first], np.add.reduceat(n[order], first) if len(first) else n[:0], number


class _Block:
    """Words of some dictionary rows, with what each may begin."""

    def __init__(self, rows: pa.Table, overlap: int):
        self.w = w = _Words(rows.column("chunk").combine_chunks())
        langs = rows.column("lang").combine_chunks().dictionary_encode()
        self.langs, lang = langs.dictionary, langs.indices.to_numpy().astype(np.int64)
        own = rows.column("words").to_numpy()
        at = np.arange(len(w.code))
        row = np.repeat(np.arange(rows.num_rows), w.size)
        self.left = w.first[1:][row] - at
        self.own = at - w.first[:-1][row] < own[row]
        self.n = rows.column("n").to_numpy()[row]
        self.lang = lang[row]
        self.key = self.lang * len(w.words) + w.code
        h = w.hash[w.code]
        self.pair = np.zeros(len(h), np.uint64)
        if len(h) > 1:
            self.pair[:-1] = _joined(_hash(self.langs)[self.lang[:-1]], h[:-1], h[1:])

    def after(self, number: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Keys of what has the given numbers, each with the word at ``at``."""
        return number * len(self.w.words) + self.w.code[at]

    def phrases(self, at: np.ndarray, k: int) -> pa.Array:
        parts = [self.w.words.take(pa.array(self.w.code[at + j])) for j in range(k)]
        return pc.binary_join_element_wise(*parts, " ") if k > 1 else parts[0]


def _blocks(batches: Iterator[pa.RecordBatch], overlap: int) -> Iterator[_Block]:
    held, words = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        words += pc.sum(batch.column("words")).as_py()
        if words >= BLOCK:
            yield _Block(pa.Table.from_batches(held), overlap)
            held, words = [], 0
    if held:
        yield _Block(pa.Table.from_batches(held), overlap)


def pair_map(chunks: DataFrame, longest: int, least: int) -> np.ndarray:
    """Bits of the pairs of words that may occur ``least`` times, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches, longest - 1):
            at = np.flatnonzero(b.own & (b.left >= 2))
            rows, n, _ = _summed(b.after(b.key[at], at + 1), b.n[at])
            yield pa.RecordBatch.from_arrays([pa.array(b.pair[at[rows]].view(np.int64)), pa.array(n)], ["h", "n"])

    frequent = chunks.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    bit = F.pmod("h", F.lit(MAP_BITS)) + 1
    maps = frequent.groupBy(F.bitmap_bucket_number(bit).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("m"))
    out = np.zeros(MAP_BITS // 8, np.uint8)
    for r in maps.toLocalIterator():  # at most MAP_BITS / 32768 rows of 4 KB
        own = np.frombuffer(r["m"], np.uint8)
        out[(r["b"] - 1) * 4096:(r["b"] - 1) * 4096 + len(own)] = own
    return out


def count_phrases(chunks: DataFrame, longest: int, least: int) -> DataFrame:
    """lang, phrase, k (words), f: every phrase of up to ``longest`` words that
    occurs ``least`` times or more."""
    shared = chunks.sparkSession.sparkContext.broadcast(pair_map(chunks, longest, least))  # fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for b in _blocks(batches, longest - 1):
            place = (b.pair % np.uint64(MAP_BITS)).astype(np.int64)
            frequent = (b.left >= 2) & (bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)
            at = np.flatnonzero(b.own)
            key = b.key[at]
            for k in range(1, longest + 1):
                if not len(at):
                    break
                rows, n, number = _summed(key, b.n[at])
                yield pa.RecordBatch.from_arrays(
                    [b.langs.take(pa.array(b.lang[at[rows]])), b.phrases(at[rows], k), pa.array(np.full(len(rows), k, np.int32)), pa.array(n)],
                    ["lang", "phrase", "k", "n"])
                on = frequent[at + k - 1]  # a pair of bits is inside the chunk
                at = at[on]
                key = b.after(number[on], at + k)

    counted = chunks.mapInArrow(run, "lang string, phrase string, k int, n long")
    return counted.groupBy("lang", "phrase", "k").agg(F.sum("n").alias("f")).where(F.col("f") >= least)


def _exact(column) -> F.Column:
    return column.cast("decimal(20,0)")


def score_phrases(frequent: DataFrame, scale: int, share: int) -> DataFrame:
    """lang, phrase, a, l, r, score of the phrases that stay: the lowest cut of
    each; dropped are those inside a longer one with ``share`` % of their count."""
    words = F.split("phrase", " ")
    part = lambda a, n: F.array_join(F.slice(words, a, n), " ")
    long = frequent.where("k >= 2")
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int")
    single = lambda k: F.when(k == 1, salt).otherwise(F.lit(0))
    cut = F.col("cut")
    cuts = long.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    sides = cuts.withColumn("side", F.explode(F.array(
        F.struct(F.lit(0).alias("second"), part(F.lit(1), cut).alias("part"), single(cut).alias("salt")),
        F.struct(F.lit(1).alias("second"), part(cut + 1, F.col("k") - cut).alias("part"), single(F.col("k") - cut).alias("salt")))))
    # A word is a part of many phrases: its count stands under each salt.
    counts = frequent.select(
        "lang", F.col("phrase").alias("part"), F.col("f").alias("part_f"),
        F.explode(F.when(F.col("k") == 1, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    both = (
        sides.select("lang", "phrase", "cut", F.col("f").alias("a"), "side.*")
        .join(counts, ["lang", "part", "salt"])
        .groupBy("lang", "phrase", "cut", "a")
        .agg(F.max(F.when(F.col("second") == 0, F.col("part_f"))).alias("l"), F.max(F.when(F.col("second") == 1, F.col("part_f"))).alias("r"))
    )
    scored = both.withColumn("score", F.expr(
        f"CAST({scale} AS DECIMAL(10,0)) * CAST(a AS DECIMAL(20,0)) div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))"))
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("low"))
    inner = F.flatten(F.transform(
        F.sequence(F.lit(2), F.col("k") - 1),
        lambda n: F.transform(F.sequence(F.lit(1), F.col("k") - n + 1), lambda a: F.array_join(F.slice(words, a, n), " "))))
    cover = (
        long.where("k >= 3").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "f")
        .groupBy("lang", "phrase").agg(F.max("f").alias("cover"))
    )
    kept = lowest.join(cover, ["lang", "phrase"], "left").where(
        F.col("cover").isNull() | (_exact(F.col("cover")) * 100 < _exact(F.col("a")) * share))
    return kept.select("lang", "phrase", "a", "low.l", "low.r", "low.score")


def collocations(docs: DataFrame, longest: int = 4, least: int = 30, scale: int = 2_000_000, share: int = 80, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each lang
    in ``docs`` (lang, text) by score, count and phrase."""
    chunks = common.stored(dictionary(docs, longest), "chunk-dictionary")
    total = chunks.groupBy("lang").agg(F.sum(F.col("n") * F.col("words")).alias("n"))
    frequent = common.stored(count_phrases(chunks, longest, least), "frequent-phrases")
    scored = score_phrases(frequent, scale, share)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    bucket = F.pmod(F.xxhash64("phrase", F.lit(1)), F.lit(BUCKETS))
    first = (
        scored.withColumn("bucket", bucket)
        .withColumn("rank", F.row_number().over(W.partitionBy("lang", "bucket").orderBy(*order)))
        .where(F.col("rank") <= top)
    )
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

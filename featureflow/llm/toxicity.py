"""Toxicity by the nearest labelled examples, exact TF-IDF cosine.

Examples are a bounded sample of the distinct texts of labelled documents
(``EXAMPLES``, chosen by a hash of the text); everything is counted over them, so
copies weigh nothing.  Terms are words and beginnings of words that differ
significantly between toxic and other examples (chi-square at least
``CHI_SQUARE``; as many as do).  All words together are one more term, of low
weight, so that the share of marked words counts.  Texts are compared by TF-IDF
cosine over these terms.

The index is inverted and block-max: the postings (example, weight) of a term lie
in blocks of ``BLOCK`` examples, each with the term's largest weight.  A search
takes blocks by descending bound (query weights times block maxima) and stops
when no bound reaches the similarity of the k-th neighbour found, so the
neighbours are exactly the nearest ones.  Ties go by example order, which depends
on the texts only: no id has a part in a score.

Neighbours vote with weights that fall with their distance.  The raw vote is
calibrated to a probability by isotonic regression on leave-one-out votes of
the examples; texts without any term get the rate of examples without any.
The evidence is the nearest examples with their similarity and label, and the
terms found.

Defined results: null and empty texts have no term; without any example the
score is 0; a document with several labels is toxic if any says so, a text of
several documents if half of them are; null ids and null labels are never learned from; repeated rows are scored alike; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bounds of what the model is fitted on and holds.
EXAMPLES = 8_192
CHI_SQUARE = 15.0
LEAST_EXAMPLES = 5  # with a term
#: Index and vote.
BLOCK = 64
FIRST_BLOCKS = 4  # scored together; twice as many each time after
NEIGHBOURS = 25
PRIOR = 1.0  # examples that the base rate counts as
#: Beginnings of words that are terms too, in characters.
STEMS = (5, 6, 7, 8)
#: Weight of the term that every word is, against 1 + log((1 + n) / (1 + df)).
EVERY_WORD = 0.03
_WORD_BYTES = bytes(c if c >= 0x80 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def words_of(text: str | None) -> list[str]:
    """Lower-case words: runs of a-z and any non-ASCII characters."""
    return [w.decode() for w in (text or "").lower().encode().translate(_WORD_BYTES).split()]


def terms_of_word(word: str) -> list[str]:
    """The word, and its beginnings marked by a hyphen."""
    return [word, *(word[:n] + "-" for n in STEMS if n <= len(word))]


class Terms:
    """Counts of the vocabulary's terms in texts, by an automaton over them:
    a word stands between spaces, a beginning after one."""

    def __init__(self, vocabulary: dict[str, int]):
        self.automaton = ahocorasick.Automaton()
        for term, t in vocabulary.items():
            spelled = f" {term[:-1]}" if term.endswith("-") else f" {term} "
            self.automaton.add_word(spelled.encode().decode("latin-1"), t)
        if vocabulary:
            self.automaton.make_automaton()

    def count(self, text: str | None) -> tuple[dict[int, int], int]:
        """(times by term, words)."""
        plain = f" {text or ''} ".lower().encode().translate(_WORD_BYTES)
        out: dict[int, int] = {}
        if len(self.automaton):
            for _, t in self.automaton.iter(plain.decode("latin-1")):
                out[t] = out.get(t, 0) + 1
        space = np.frombuffer(plain, np.uint8) == 0x20
        return out, int(np.count_nonzero(space[:-1] & ~space[1:]))


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps of the non-decreasing fit of y by x (pool adjacent violators),
    each smoothed by the overall rate: (lower ends, values)."""
    rate = float(y.mean())
    pools: list[list[float]] = []  # lowest x, sum, count
    for value in np.unique(x).tolist():
        own = y[x == value]
        pools.append([value, float(own.sum()), float(len(own))])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            _, s, n = pools.pop()
            pools[-1][1] += s
            pools[-1][2] += n
    return np.array([p[0] for p in pools]), np.array([(p[1] + rate) / (p[2] + 1) for p in pools])


@dataclass
class Index:
    """Block-max inverted index of unit vectors over a few terms."""

    vocabulary: dict[str, int]
    idf: np.ndarray
    base_rate: float
    no_term_rate: float
    steps: tuple[np.ndarray, np.ndarray] | None = None
    #: Postings by block, then term, then example; of each block, and the end,
    #: its first one.
    first: np.ndarray | None = None
    terms: np.ndarray | None = None
    examples: np.ndarray | None = None
    weights: np.ndarray | None = None
    maxima: np.ndarray | None = None  # term x block: the largest weight there
    toxic: np.ndarray | None = None
    names: list[int] = field(default_factory=list)

    def add(self, vectors: list[list[tuple[int, float]]], toxic: list[bool], names: list[int]) -> None:
        self.toxic, self.names = np.array(toxic, bool), names
        postings = sorted((e // BLOCK, t, e, w) for e, vector in enumerate(vectors) for t, w in vector)
        block, self.terms, self.examples = (np.array([p[k] for p in postings], np.int64) for k in range(3))
        self.weights = np.array([w for *_, w in postings], np.float64)
        blocks = -(-len(vectors) // BLOCK)
        self.first = np.searchsorted(block, np.arange(blocks + 1))
        self.maxima = np.zeros((len(self.idf), blocks))
        np.maximum.at(self.maxima, (self.terms, block), self.weights)

    @property
    def postings(self) -> np.ndarray:
        """All postings as term x block x example of the block."""
        out = np.zeros((len(self.idf), -(-len(self.toxic) // BLOCK) * BLOCK))
        out[self.terms, self.examples] = self.weights
        return out.reshape(len(self.idf), -1, BLOCK)

    def vector(self, counts: dict[int, int], words: int) -> list[tuple[int, float]]:
        """Unit TF-IDF vector; the last term is every word."""
        raw = [(t, n * float(self.idf[t])) for t, n in sorted(counts.items())]
        raw.append((len(self.vocabulary), words * float(self.idf[-1])))
        norm = np.sqrt(sum(w * w for _, w in raw))
        return [(t, float(w / norm)) for t, w in raw]

    def nearest(self, query: list[tuple[int, float]], k: int = NEIGHBOURS, but: int = -1) -> list[tuple[float, int]]:
        """(similarity, example) of the k nearest, nearest first, ties by
        example; only examples that share a term."""
        asked, own_weights = [t for t, _ in query], np.array([w for _, w in query])
        by_term = np.zeros(len(self.idf))
        by_term[asked] = own_weights
        bound = own_weights @ self.maxima[asked]
        order = np.argsort(-bound, kind="stable")[:np.count_nonzero(bound)]
        examples, similar = np.zeros(0, np.int64), np.zeros(0)
        done, step = 0, FIRST_BLOCKS
        while done < len(order):
            if len(similar) == k and bound[order[done]] < similar[-1] - 1e-8:
                break
            blocks = order[done:done + step]
            done, step = done + step, 2 * step
            sizes = self.first[blocks + 1] - self.first[blocks]
            at = np.concatenate([np.arange(a, a + n) for a, n in zip(self.first[blocks].tolist(), sizes.tolist())])
            place = np.repeat(np.arange(len(blocks)) * BLOCK, sizes) + self.examples[at] % BLOCK
            scores = np.bincount(place, by_term[self.terms[at]] * self.weights[at], len(blocks) * BLOCK)
            # Rounded, so that equal similarities are ties whatever their terms.
            scores = np.round(scores, 9)
            own = (blocks[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            found = (scores > 0) & (own != but)
            examples, similar = np.concatenate([examples, own[found]]), np.concatenate([similar, scores[found]])
            best = np.lexsort((examples, -similar))[:k]
            examples, similar = examples[best], similar[best]
        return list(zip(similar.tolist(), examples.tolist()))

    def vote(self, neighbours: list[tuple[float, int]]) -> float:
        weights = [1 / (1.1 - s) for s, _ in neighbours]
        toxic = sum(w for w, (_, e) in zip(weights, neighbours) if self.toxic[e])
        return round((toxic + PRIOR * self.base_rate) / (sum(weights) + PRIOR), 9)

    def calibrated(self, vote: float) -> float:
        lower, value = self.steps
        return float(value[max(0, int(np.searchsorted(lower, vote, side="right")) - 1)])

    def score(self, text: str | None, terms: Terms) -> tuple[float, str]:
        """(probability, evidence) of a whole text."""
        counts, words = terms.count(text)
        near = self.nearest(self.vector(counts, words)) if counts else []
        if not near:
            return self.no_term_rate, ""
        found = sorted(counts, key=lambda t: (-counts[t] * self.idf[t], t))[:5]
        shown = ", ".join(f"{self.names[e]}:{s:.3f}:{int(self.toxic[e])}" for s, e in near[:5])
        return self.calibrated(self.vote(near)), f"{' '.join(self.spelled[t] for t in found)} | {shown}"

    @cached_property
    def spelled(self) -> list[str]:
        return list(self.vocabulary)


def labelled_examples(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id (the smallest), toxic, text and its hash of the bounded sample of
    distinct texts that may be learned from.  At most ``EXAMPLES`` rows are
    broadcast, the texts stay in place."""
    marked = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~common.held_out())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).alias("toxic"))
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    hashed = F.sha2("text", 256).alias("hash")
    # Copies are counted by the hash of their text before any is left out.
    chosen = (
        texts.select("doc_id", hashed).join(marked, "doc_id")
        .groupBy("hash").agg(F.min("doc_id").alias("doc_id"), (2 * F.count_if("toxic") >= F.count("*")).alias("toxic"))
        .orderBy("hash").limit(EXAMPLES)
    )
    return texts.select("doc_id", "text", hashed).join(F.broadcast(chosen), ["doc_id", "hash"]).dropDuplicates(["hash"])


def learn(docs: DataFrame, labels: DataFrame) -> Index | None:
    common.ship_package(docs.sparkSession)
    examples = common.stored(labelled_examples(docs, labels), "toxicity-examples")  # at most EXAMPLES
    size = examples.agg(F.count("*").alias("n"), F.count_if("toxic").alias("toxic")).first()
    n, toxic = size["n"], size["toxic"]
    if not n:
        return None

    def terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, is_toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                terms = list({t for w in set(words_of(text)) for t in terms_of_word(w)})
                yield pa.RecordBatch.from_arrays(
                    [pa.array(terms, pa.string()), pa.array([is_toxic] * len(terms), pa.bool_())], ["term", "toxic"])

    counted = examples.mapInArrow(terms_of, "term string, toxic boolean").groupBy("term").agg(
        F.count("*").alias("df"), F.count_if("toxic").alias("a"))
    a, df = F.col("a").cast("double"), F.col("df").cast("double")
    expected = (a * (n - toxic) - (df - a) * toxic)
    chi = n * expected * expected / (df * (n - df) * float(max(1, toxic)) * float(max(1, n - toxic)))
    terms = counted.where((df >= LEAST_EXAMPLES) & (df < n)).withColumn("chi", chi).where(F.col("chi") >= CHI_SQUARE).orderBy(
        F.desc("chi"), "term").collect()  # of EXAMPLES texts
    vocabulary = {r["term"]: k for k, r in enumerate(terms)}
    idf = np.array([*(np.log((1 + n) / (1 + r["df"])) + 1 for r in terms), EVERY_WORD])

    def vectors_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Terms(vocabulary)
        for batch in batches:
            found = [counter.count(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("hash"), batch.column("toxic"),
                pa.array([list(c) for c, _ in found], pa.list_(pa.int32())),
                pa.array([list(c.values()) for c, _ in found], pa.list_(pa.int32())),
                pa.array([n for _, n in found], pa.int64()),
            ], ["doc_id", "hash", "toxic", "terms", "times", "words"])

    rows = examples.mapInArrow(vectors_of, "doc_id long, hash string, toxic boolean, terms array<int>, times array<int>, words long").collect()
    rate = toxic / n
    bare = [r["toxic"] for r in rows if not r["terms"]]
    index = Index(vocabulary, idf, rate, (sum(bare) + rate) / (len(bare) + 1))
    own = [(index.vector(dict(zip(r["terms"], r["times"])), r["words"]), r) for r in rows if r["terms"]]
    # Alike examples stand together, which keeps the bounds of blocks tight.
    own.sort(key=lambda x: (max(x[0], key=lambda tw: tw[1])[0], x[0][-1][1], x[1]["hash"]))
    index.add([v for v, _ in own], [r["toxic"] for _, r in own], [r["doc_id"] for _, r in own])
    if own:
        votes = np.array([index.vote(index.nearest(v, but=e)) for e, (v, _) in enumerate(own)])
        index.steps = isotonic(votes, index.toxic.astype(float))
    return index


def score_documents(docs: DataFrame, index: Index | None) -> DataFrame:
    """doc_id, held_out, score, evidence for every row."""
    common.ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(index)  # EXAMPLES vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(shared.value.vocabulary) if shared.value else None
        for batch in batches:
            for first, texts in common.text_slices(batch):
                out = [shared.value.score(t, terms) if shared.value else (0.0, "") for t in texts]
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(first, len(texts)), batch.column("held_out").slice(first, len(texts)),
                    pa.array([s for s, _ in out], pa.float64()), pa.array([e for _, e in out], pa.string()),
                ], ["doc_id", "held_out", "score", "evidence"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", common.held_out().alias("held_out")).mapInArrow(
        run, "doc_id long, held_out boolean, score double, evidence string")


def without_toxic(docs: DataFrame, index: Index | None, threshold: float) -> DataFrame:
    """``docs`` (all columns) without the rows scored at the threshold or over."""
    common.ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(shared.value.vocabulary) if shared.value else None
        for batch in batches:
            for first, texts in common.text_slices(batch):
                kept = [not shared.value or shared.value.score(t, terms)[0] < threshold for t in texts]
                yield batch.slice(first, len(texts)).filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

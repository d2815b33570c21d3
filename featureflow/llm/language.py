"""Language identification by hierarchical discrimination.

A text's features are the square roots of the shares of its hashed byte
trigrams (lower case, everything but letters a space).  One linear support
vector machine per family against the rest predicts the family; then one per
pair of languages of that family (one versus one) votes for the language.

The model is fitted on a bounded sample of labelled documents: of every label
the same number of distinct texts, at most ``PER_LANGUAGE`` and ``SAMPLE`` in all
(but one at least), chosen by a hash of the text, so ids have no part in a
prediction.  Everything else covers all rows and whole texts.

Defined results: ``und`` with score 0 for texts that are null or have no
letter, and for all texts if there is nothing to learn from; with one label
learned, that label with score 1; null ids are not held out and never learned
from; repeated rows are treated like any other; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common, svm

#: Bounds of the sample that the model is fitted on.
PER_LANGUAGE = 600
SAMPLE = 4_000
#: Hashed trigrams.
FEATURES = 1 << 12
_CHUNK = 1 << 20
_LETTERS_ONLY = bytes(c if c >= 0x80 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))

#: Families by ISO 639-1 code.  A label that is not listed is a
#: family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "an ca es fr gl it la oc pt ro rm sc wa",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "celtic": "br cy ga gd gv kw",
    "baltic": "lt lv",
    "uralic": "et fi hu se",
    "turkic": "az ba kk ky tk tr tt ug uz",
    "iranian": "fa ku ps tg",
    "indic": "as bn gu hi mr ne or pa sa sd si ur",
    "dravidian": "kn ml ta te",
    "semitic": "am ar he mt ti",
    "austronesian": "fj haw id jv mg mi ms sm su tl to",
    "bantu": "ln lg ny rw sn st sw xh zu",
    "sinitic": "zh",
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family_of(language: str) -> str:
    return _FAMILY_OF.get(language.lower().replace("_", "-").split("-")[0], f"own:{language}")


def features(text: str) -> np.ndarray | None:
    """Unit vector of a whole text; None if it has no letter."""
    if not any(map(str.isalpha, text)):
        return None
    counts = np.zeros(FEATURES, np.int64)
    raw = np.frombuffer((" " + text + " ").lower().encode().translate(_LETTERS_ONLY), np.uint8)
    for at in range(0, len(raw) - 2, _CHUNK):
        a = raw[at:at + _CHUNK + 2].astype(np.uint32)
        tri = a[:-2] << np.uint32(16) | a[1:-1] << np.uint32(8) | a[2:]
        tri = tri[tri & np.uint32(0xFFFF) != 0x2020]  # inside a run of spaces
        counts += np.bincount((tri * np.uint32(0x9E3779B1)) >> np.uint32(20), minlength=FEATURES)
    return np.sqrt(counts / max(1, counts.sum())).astype(np.float32)


@dataclass
class Model:
    """Weights (a row per machine, the bias last) of both levels."""

    families: list[str]
    languages: dict[str, list[str]]
    by_family: np.ndarray
    by_pair: dict[str, np.ndarray]

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        if len(self.families) == 1:
            best, sure = 0, 1.0
        else:
            margin = self.by_family[:, :-1] @ x + self.by_family[:, -1]
            best = int(np.argmax(margin))
            others = np.delete(margin, best).max()
            sure = float(1 / (1 + np.exp(-(margin[best] - others))))
        own = self.languages[self.families[best]]
        if len(own) == 1:
            return own[0], sure
        weights = self.by_pair[self.families[best]]
        margin = weights[:, :-1] @ x + weights[:, -1]
        votes, total = np.zeros(len(own)), np.zeros(len(own))
        least = np.full(len(own), np.inf)
        for (a, b), m in zip(combinations(range(len(own)), 2), margin.tolist()):
            votes[a if m > 0 else b] += 1
            for k, s in ((a, m), (b, -m)):
                total[k] += s
                least[k] = min(least[k], s)
        k = max(range(len(own)), key=lambda i: (votes[i], total[i], -i))
        return own[k], sure * float(1 / (1 + np.exp(-2 * least[k])))


def fit(x: np.ndarray, labels: list[str]) -> Model:
    tags = np.array(labels)
    languages: dict[str, list[str]] = {}
    for tag in sorted(set(labels)):
        languages.setdefault(family_of(tag), []).append(tag)
    families = sorted(languages)
    family = np.array([family_of(t) for t in labels])
    by_family = np.stack([svm.train(x, np.where(family == f, 1, -1)) for f in families]) if len(families) > 1 else np.zeros((1, FEATURES + 1))
    by_pair = {}
    for f, own in languages.items():
        machines = []
        for a, b in combinations(own, 2):
            rows = (tags == a) | (tags == b)
            machines.append(svm.train(x[rows], np.where(tags[rows] == a, 1, -1)))
        by_pair[f] = np.array(machines, np.float32)
    return Model(families, languages, by_family.astype(np.float32), by_pair)


def labelled_sample(docs: DataFrame) -> DataFrame:
    """text, lang, hash: the bounded sample; see the module."""
    usable = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~common.held_out())
    usable = usable.select("text", F.col("lang").cast("string").alias("lang"), F.xxhash64("text").alias("hash"))
    labels = usable.groupBy("lang").agg(F.count("*")).count()
    each = max(1, min(PER_LANGUAGE, SAMPLE // max(1, labels)))
    # Copies are one text; the first texts of a label are taken before they meet.
    first = W.partitionBy("lang").orderBy("hash")
    chosen = usable.select("lang", "hash").distinct().withColumn("n", F.row_number().over(first)).where(F.col("n") <= each).drop("n")
    # At most the larger of SAMPLE and the number of labels: broadcast.
    return usable.join(F.broadcast(chosen), ["lang", "hash"], "left_semi").dropDuplicates(["lang", "hash"])


def learn(docs: DataFrame) -> Model | None:
    """Fit on the bounded sample; its features are made on the executors and
    come back as sparse counts."""
    common.ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in common.text_slices(batch):
                got = [(features(t), *own) for t, *own in zip(
                    texts, *(batch.column(c).slice(first, len(texts)).to_pylist() for c in ("lang", "hash")))]
                got = [(x, *own) for x, *own in got if x is not None]
                at = [np.flatnonzero(x).astype(np.int32) for x, *_ in got]
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang for _, lang, _ in got], pa.string()),
                    pa.array([h for *_, h in got], pa.int64()),
                    pa.array(at, pa.list_(pa.int32())),
                    pa.array([x[k] for (x, *_), k in zip(got, at)], pa.list_(pa.float32())),
                ], ["lang", "hash", "at", "value"])

    rows = labelled_sample(docs).mapInArrow(run, "lang string, hash long, at array<int>, value array<float>").toArrow()
    if not rows.num_rows:
        return None
    rows = rows.sort_by([("lang", "ascending"), ("hash", "ascending")])  # however they came
    x = np.zeros((rows.num_rows, FEATURES), np.float32)
    for k, (at, value) in enumerate(zip(rows.column("at"), rows.column("value"))):
        x[k, at.values.to_numpy()] = value.values.to_numpy()
    return fit(x, rows.column("lang").to_pylist())


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row."""
    common.ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES x machines

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in common.text_slices(batch):
                out = []
                for text in texts:
                    x = features(text) if text and shared.value else None
                    out.append(("und", 0.0) if x is None else shared.value.predict(x))
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(first, len(texts)), batch.column("held_out").slice(first, len(texts)),
                    pa.array([p for p, _ in out], pa.string()), pa.array([s for _, s in out], pa.float64()),
                ], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", common.held_out().alias("held_out")).mapInArrow(
        run, "doc_id long, held_out boolean, lang_pred string, score double")

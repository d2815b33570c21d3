"""Toxicity, language and quality: exact parts against brute force, learned
parts by held-out accuracy."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from featureflow.llm import language, quality, svm, toxicity
from featureflow.llm.queries import op2_quality_rules, op3_toxicity, op9_language_id

from .conftest import EDGE_TEXTS

SF01 = "/root/testdata/sf0.01"
SF1 = "/root/testdata/sf0.1"  # enough labels to judge accuracy by
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def is_held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def statistics(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[k:k + 5]) for k in range(len(words) - 4)]
    times, covered, seen, again = Counter(windows), set(), set(), 0
    for k, w in enumerate(windows):
        if times[w] > 1:
            covered.update(range(k, k + 5))
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_quality_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{SF01}/labels.parquet").collect()
    rows = {r["doc_id"]: r for r in op2_quality_rules(spark, SF01).collect()}
    for doc, text in docs.items():
        want = statistics(text)
        assert tuple(rows[doc][c] for c in COUNTS) == want
        assert rows[doc]["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (rows[doc]["base_failed"] and rows[doc]["kept"])
    marked = [(r["quality"], rows[r["doc_id"]]) for r in labels if r["quality"] is not None]
    good = [x["kept"] or x["base_failed"] for q, x in marked if q]
    bad = [not x["kept"] for q, x in marked if not q]
    assert np.mean(good) > 0.97 and np.mean(bad) > 0.9


def test_quality_statistics_edge_cases(edge, empty, spark):
    cases = [*EDGE_TEXTS, (20, "a b c d e a b c d e"), (21, "a a a a a a a a a a a"), (22, "x\ny\nx\n\nx\r"),
             (23, "1 2 3 4"), (24, "1 2 3 4 5"), (25, "a\x0bb\x0cc d\x85e # <b>"), (26, "p q r s t u p q r s t v p q r s t")]
    df = spark.createDataFrame(cases, "doc_id long, text string")
    got = Counter((r["doc_id"], *(r[c] for c in COUNTS)) for r in quality.text_statistics(df).collect())
    assert got == Counter((d, *statistics(t)) for d, t in cases)
    assert quality.text_statistics(empty).collect() == []
    none = spark.createDataFrame([], "doc_id long, quality int")
    judged = quality.judge(edge, none).collect()
    assert len(judged) == len(EDGE_TEXTS) and all(r["kept"] != r["base_failed"] for r in judged)
    odd = spark.createDataFrame([(1, 0), (1, 1), (None, 0), (5, None), (9, 1)], "doc_id long, quality int")
    assert len(quality.judge(edge, odd).collect()) == len(EDGE_TEXTS)


def test_quality_rules_are_conditions_in_order(spark):
    """Planted: long words are bad, and so are marks between words."""
    rng = np.random.default_rng(3)
    rows = []
    for k in range(600):
        n = int(rng.integers(20, 60))
        words = ["w%d" % rng.integers(1000) for _ in range(n)]
        bad = k % 3 == 0
        if bad and k % 2:
            words = [w + "x" * 20 for w in words]
        elif bad:
            words = [x for w in words for x in (w, "!!")]
        rows.append((k, " ".join(words), 0 if bad else 1))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    stats = quality.text_statistics(df)
    rules = quality.learn_rules(stats, df)
    assert len(rules) >= 2 and "word_length" in {c.feature for r in rules for c in r.conditions}
    first = stats.where(~quality.base_failed()).select("doc_id", quality.rule_number(rules).alias("rule"), *(
        r.column().alias(f"r{k}") for k, r in enumerate(rules, 1)))
    for r in first.collect():
        assert r["rule"] == next((k for k in range(1, len(rules) + 1) if r[f"r{k}"]), None)
    wrong = stats.select("doc_id", quality.verdict(rules).alias("kept")).join(df, "doc_id").where(
        F.col("kept") != (F.col("quality") == 1)).count()
    assert wrong <= 6


def test_toxicity_query(spark):
    rows = {r["doc_id"]: r for r in op3_toxicity(spark, SF1).collect()}
    assert len(rows) == 10_000
    for doc, r in rows.items():
        assert r["held_out"] == is_held_out(doc) and 0 <= r["score"] <= 1
        assert r["predicted"] == int(r["score"] >= 0.3)
    labels = [r for r in spark.read.parquet(f"{SF1}/labels.parquet").collect() if is_held_out(r["doc_id"])]
    got = Counter((r["toxic"], rows[r["doc_id"]]["predicted"]) for r in labels)
    assert got[1, 1] / (got[1, 0] + got[1, 1]) > 0.9 and got[0, 1] / (got[0, 0] + got[0, 1]) < 0.02


def test_nearest_examples_are_exact(spark):
    docs, labels = (spark.read.parquet(f"{SF1}/{t}.parquet") for t in ("documents", "labels"))
    index = toxicity.learn(docs, labels)
    dense = index.postings.reshape(len(index.idf), -1).T[:len(index.names)]
    assert len(dense) > toxicity.BLOCK
    for e in range(len(dense)):
        query = [(t, dense[e, t]) for t in np.flatnonzero(dense[e])]
        similar = np.round(dense @ dense[e], 9)
        want = [int(k) for k in np.lexsort((np.arange(len(similar)), -similar)) if similar[k] > 0]
        assert [k for _, k in index.nearest(query)] == want[:toxicity.NEIGHBOURS]
        assert [k for _, k in index.nearest(query, but=e)] == [k for k in want if k != e][:toxicity.NEIGHBOURS]


def test_toxicity_never_learns_from_held_out_rows(spark, edge, empty):
    held = [k for k in range(200) if is_held_out(k)]
    docs = spark.createDataFrame([(k, f"vile vile words {k}" if k % 2 else f"kind words {k}") for k in range(200)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    only_held = labels.where(F.col("doc_id").isin(held))
    assert toxicity.learn(docs, only_held) is None
    assert {r["score"] for r in toxicity.score_documents(docs, None).collect()} == {0.0}
    index = toxicity.learn(docs, labels)
    wrong = [r for r in toxicity.score_documents(docs, index).collect() if (r["score"] >= 0.3) != bool(r["doc_id"] % 2)]
    assert wrong == []
    kept = toxicity.without_toxic(docs.withColumn("score", F.lit("x")), index, 0.3)
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(0, 200, 2)) and kept.columns == ["doc_id", "text", "score"]
    rows = toxicity.score_documents(edge, index).collect()
    assert len(rows) == len(EDGE_TEXTS) and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score_documents(empty, index).collect() == []
    assert toxicity.learn(docs, spark.createDataFrame([], "doc_id long, toxic int")) is None
    odd = spark.createDataFrame([(1, None), (None, 1), (3, 1), (3, 0), (4, 0), (4, 0)], "doc_id long, toxic int")
    assert toxicity.learn(docs, odd) is not None


def test_copies_do_not_change_what_is_learned(spark, monkeypatch):
    """A third of the labelled rows are copies of one clean and of one toxic text."""
    rng = np.random.default_rng(5)
    rows = [(k, " ".join(["vile"] * (k % 3 == 0) + ["w%d" % w for w in rng.integers(60, size=12)]), int(k % 3 == 0)) for k in range(400)]
    own = [r for r in rows if not is_held_out(r[0])]
    assert len({r[1] for r in own}) == len(own)
    clean, marked = next(r for r in own if not r[2]), next(r for r in own if r[2])
    copies = [(1_000 + k, *(marked if k % 2 else clean)[1:]) for k in range(200)]

    def learned(rows):
        df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
        return toxicity.learn(df.drop("toxic"), df.drop("text"))

    one, many = learned(rows), learned(rows + copies)
    assert "vile" in one.vocabulary and one.vocabulary == many.vocabulary and not set("w%d" % w for w in range(60)) & set(one.vocabulary)
    assert np.array_equal(one.idf, many.idf) and one.names == many.names and one.base_rate == many.base_rate
    monkeypatch.setattr(toxicity, "EXAMPLES", 50)
    df = spark.createDataFrame(rows + copies, "doc_id long, text string, toxic int")
    assert toxicity.labelled_examples(df.drop("toxic"), df.drop("text")).select("text").distinct().count() == 50


def test_terms_are_counted_as_words_and_beginnings():
    vocabulary = {"vile": 0, "vilen-": 1, "éñabç-": 2, "a": 3}
    counts = toxicity.Terms(vocabulary).count("Vile vile, VILENESS vilen-vile a a a; Éñabçd éñabç éñab")
    assert counts == ({0: 3, 1: 2, 2: 2, 3: 3}, 11)
    assert toxicity.Terms({}).count("a b") == ({}, 2) and toxicity.Terms(vocabulary).count(None) == ({}, 0)


def test_isotonic_is_non_decreasing():
    rng = np.random.default_rng(1)
    x = rng.random(500).round(2)
    lower, value = toxicity.isotonic(x, (rng.random(500) < x).astype(float))
    assert (np.diff(value) >= 0).all() and (np.diff(lower) > 0).all()


def test_language_query(spark):
    docs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    rows = op9_language_id(spark, SF01).collect()
    assert len(rows) == len(docs) and all(r["held_out"] == is_held_out(r["doc_id"]) for r in rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]] for r in rows if r["held_out"]]) > 0.98


def test_language_edge_cases(spark, edge, empty):
    model = language.learn(edge)
    rows = language.identify(edge, model).collect()
    assert len(rows) == len(EDGE_TEXTS)
    for r, text in zip(sorted(rows, key=lambda r: str(r["doc_id"])), [t for _, t in sorted(EDGE_TEXTS, key=lambda x: str(x[0]))]):
        if r["doc_id"] in (2, 3, 4):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        elif r["doc_id"] is not None:
            assert (r["lang_pred"], r["score"]) == ("en", 1.0)
    assert language.learn(empty) is None
    assert {r["lang_pred"] for r in language.identify(edge, None).collect()} == {"und"}
    assert language.identify(empty, model).collect() == []
    assert language.learn(edge.withColumn("lang", F.lit(None).cast("string"))) is None


def test_families_of_unlisted_labels_stand_alone():
    assert language.family_of("pt-BR") == "romance" and language.family_of("xx") != language.family_of("yy")
    rng = np.random.default_rng(0)
    centre = {tag: rng.random(language.FEATURES) for tag in ("xx", "yy", "de", "en", "nl")}
    labels = [tag for tag in centre for _ in range(20)]
    x = np.array([centre[t] + 0.1 * rng.random(language.FEATURES) for t in labels], np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    model = language.fit(x, labels)
    assert [model.predict(v)[0] for v in x] == labels


@pytest.mark.parametrize("seed", range(3))
def test_svm_separates(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(200, 5)).astype(np.float32)
    y = np.where(x @ np.arange(1, 6) + 0.5 > 0, 1, -1)
    w = svm.train(x, y, cost=100, epochs=200)
    assert np.mean(np.sign(x @ w[:-1] + w[-1]) == y) > 0.98


def renumbered(spark, docs, labels, held, others):
    """The same rows under other ids, none of which crosses the hold-out."""
    ids = [r["doc_id"] for r in docs.select("doc_id").distinct().collect()]
    fresh = {True: iter(held), False: iter(others)}
    new = spark.createDataFrame([(i, next(fresh[is_held_out(i)])) for i in ids], "doc_id long, new long")

    def moved(df):
        return df.join(new, "doc_id").drop("doc_id").withColumnRenamed("new", "doc_id")

    return moved(docs), moved(labels), dict(new.collect())


def test_ids_have_no_part_in_scores(spark):
    from .conftest import SF

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    free = range(10**6, 10**6 + 5_000)
    held, others = [k for k in free if is_held_out(k)][::-1], [k for k in free if not is_held_out(k)][::-1]
    docs2, labels2, new = renumbered(spark, docs, labels, held, others)
    scores = [{r["doc_id"]: r["score"] for r in toxicity.score_documents(d, toxicity.learn(d, x)).collect()} for d, x in ((docs, labels), (docs2, labels2))]
    assert all(scores[0][i] == scores[1][new[i]] for i in scores[0])
    said = [{r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(d, language.learn(d)).collect()} for d in (docs, docs2)]
    assert all(said[0][i] == said[1][new[i]] for i in said[0])


@pytest.mark.parametrize("text", ["½", "² ³", "Ⅷ", "12 34", "?!", "", None, "①"])
def test_texts_without_a_letter_are_undetermined(spark, text):
    docs = spark.createDataFrame([(k, f"some words {k}", "en") for k in range(8)] + [(100, text, "de")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language.identify(docs, language.learn(docs)).collect()}
    assert (got[100]["lang_pred"], got[100]["score"]) == ("und", 0.0) and got[0]["lang_pred"] == "en"


def test_every_label_can_be_learned(spark):
    """More labels than there are languages, one of them with most rows."""
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(60)]
    rows = [(k, " ".join([words[k % 60]] * 6), f"x{k % 60:03d}") for k in range(60 * 12)]
    rows += [(10_000 + k, "common words of one label " * 3, "zz") for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = language.labelled_sample(docs)
    assert {r["lang"] for r in sample.select("lang").distinct().collect()} == {f"x{k:03d}" for k in range(60)} | {"zz"}
    assert sample.where("lang = 'zz'").count() == 1  # copies are one text
    got = language.identify(docs, language.learn(docs)).join(docs.select("doc_id", "lang"), "doc_id")
    assert got.where("lang_pred != lang").count() == 0


def test_languages_against_plain_machines(spark):
    """Features and votes computed plainly from the same weights."""
    from .conftest import SF

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.learn(docs)

    def plain_features(text):
        spaced = [c if c >= 0x80 or 0x61 <= c <= 0x7A else 0x20 for c in f" {text} ".lower().encode()]
        counts = Counter()
        for a, b, c in zip(spaced, spaced[1:], spaced[2:]):
            if (b, c) != (0x20, 0x20):
                counts[((a << 16 | b << 8 | c) * 0x9E3779B1 % 2**32) >> 20] += 1
        total = sum(counts.values())
        return {k: (v / total) ** 0.5 for k, v in counts.items()}

    def margin(w, x):
        return float(w[-1]) + sum(float(w[k]) * v for k, v in x.items())

    def plain_prediction(text):
        if not any(c.isalpha() for c in text or ""):
            return "und"
        x = plain_features(text)
        family = max(range(len(model.families)), key=lambda k: margin(model.by_family[k], x)) if len(model.families) > 1 else 0
        own = model.languages[model.families[family]]
        votes, total = Counter(), Counter()
        pairs = [(a, b) for a in range(len(own)) for b in range(a + 1, len(own))]
        for (a, b), w in zip(pairs, model.by_pair[model.families[family]]):
            m = margin(w, x)
            votes[a if m > 0 else b] += 1
            total[a] += m
            total[b] -= m
        return own[max(range(len(own)), key=lambda k: (votes[k], total[k], -k))]

    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, model).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    assert {d: plain_prediction(t) for d, t in texts.items()} == got

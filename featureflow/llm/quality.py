"""Quality rules: a decision list learned by sequential covering.

``text_statistics`` computes the statistics of whole texts; only array and
string functions are used, row by row, so nothing is shuffled.  ``learn_rules``
covers the labelled statistics one rule at a time, as in incremental reduced
error pruning: a rule grows by the threshold condition of the largest
information gain on a growing set, and is cut back where a pruning set says so;
the rows that it covers are removed.  Thresholds end in the middle between the
labelled values next to them.  Every step is one grouped count over
binned statistics (rows x statistics to bins x statistics), so the driver only
sees counts, whatever the number of labelled rows.  ``verdict`` writes the list
as one conditional expression, in order.

Defined results: null and empty texts have no words and fail the base rules;
without labels of both kinds there are no rules and the base decides alone;
null labels and ids are not learned from, a document with several labels is
bad if any says so; repeated rows get equal rows; an empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Words of a repeated window.
WINDOW = 5
#: Bounds of learning.
BINS = 32
RULES = 12
CONDITIONS = 4
#: A rule must be right so often on rows that it was not grown on, for at
#: least so many rows.
LEAST_PRECISION = 0.8
LEAST_ROWS = 5

_SPACE = r"[\x20\x09-\x0D]+"


def _let(value: Column, body) -> Column:
    """``body(x)`` with x bound to ``value``, evaluated once for a row."""
    return F.transform(F.array(value), body)[0]


def _count_chars(text: Column, pattern: str) -> Column:
    """Characters of ``text`` that match a class."""
    return (F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))).cast("long")


def _repeated(windows: Column) -> Column:
    """Words in windows that occur twice or more.  Sorted with their places,
    equal windows are neighbours; a place then covers up to the next one."""
    ordered = F.array_sort(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    places = _let(ordered, lambda s: F.array_sort(F.transform(F.filter(F.transform(s, lambda x, k: F.struct(
        x["i"].alias("i"),
        (F.coalesce(x["w"] == F.get(s, k - 1)["w"], F.lit(False))
         | F.coalesce(x["w"] == F.get(s, k + 1)["w"], F.lit(False))).alias("again"))),
        lambda x: x["again"]), lambda x: x["i"])))
    return _let(places, lambda p: F.aggregate(
        F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))),
        F.lit(0).cast("long"), lambda a, x: a + x))


#: Ratios that rules may test, from the columns of ``text_statistics``.
FEATURES = {
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(n_words, 1)",
    "duplicate_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(n_words, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "words": "cast(n_words as double)",
}


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and counts over whole texts: n_words, word_chars, n_symbols,
    n_lines (with a word), n_dup_lines, n_repeat_words, n_upper, n_marks
    (sentence marks), n_distinct (words)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))

    def of_words(words: Column) -> Column:
        n = F.size(words)
        # Words hold no space, so a joined window stands for its words.
        windows = F.when(n >= WINDOW, F.transform(
            F.sequence(F.lit(1), F.greatest(n - WINDOW + 1, F.lit(1))),
            lambda i: F.array_join(F.slice(words, i, WINDOW), " "))).otherwise(F.array().cast("array<string>"))
        repeated = _let(windows, lambda w: F.when(
            F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(_repeated(w)))
        return F.struct(
            n.cast("long").alias("n_words"),
            F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.size(F.array_distinct(words)).cast("long").alias("n_distinct"),
            repeated.alias("n_repeat_words"))

    words = F.filter(F.split("text", _SPACE), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return rows.select(
        "doc_id",
        _let(words, of_words).alias("w"),
        _count_chars(F.col("text"), r"[#*$%&|<>]").alias("n_symbols"),
        _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), F.size(F.array_distinct(x)).cast("long").alias("d"))).alias("l"),
        _count_chars(F.col("text"), r"\p{Lu}").alias("n_upper"),
        _count_chars(F.col("text"), r"[.,;:!?]").alias("n_marks"),
    ).select(
        "doc_id", "w.n_words", "w.word_chars", "n_symbols", F.col("l.n").alias("n_lines"),
        (F.col("l.n") - F.col("l.d")).alias("n_dup_lines"), "w.n_repeat_words", "n_upper", "n_marks", "w.n_distinct")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # value > threshold, else value <= threshold
    threshold: float

    def column(self) -> Column:
        value = F.expr(FEATURES[self.feature])
        return value > self.threshold if self.above else value <= self.threshold


@dataclass(frozen=True)
class Rule:
    """A conjunction of conditions whose rows are rejected."""

    conditions: tuple[Condition, ...]

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column()
        return out


def _gain(before: tuple[int, int], after: tuple[int, int]) -> float:
    """FOIL's information gain of a condition for the bad rows."""
    bad, all_rows = after
    if not bad:
        return 0.0
    return bad * (math.log2(bad / all_rows) - math.log2(before[0] / before[1]))


def _grown(bins: DataFrame, edges: dict[str, list[float]], taken: tuple[Condition, ...]) -> tuple[Condition | None, tuple[int, int]]:
    """The best condition to add to a rule, by one grouped count."""
    covered = bins.where("grow")
    for c in taken:
        k = edges[c.feature].index(c.threshold)
        covered = covered.where(F.col(c.feature) > k if c.above else F.col(c.feature) <= k)
    counts = covered.select("bad", F.posexplode(F.array(*edges)).alias("f", "bin")).groupBy("f", "bin").agg(
        F.count("*").alias("n"), F.count_if("bad").alias("bad")).collect()  # features x bins
    by_feature: dict[int, dict[int, tuple[int, int]]] = {}
    for r in counts:
        by_feature.setdefault(r["f"], {})[r["bin"]] = (r["bad"], r["n"])
    if not by_feature:
        return None, (0, 0)
    first = next(iter(by_feature.values())).values()
    before = (sum(b for b, _ in first), sum(n for _, n in first))
    best, top, kept = None, 1e-9, before
    if not before[0] or before[0] == before[1]:
        return None, before
    for f, feature in enumerate(edges):
        bad = rows = 0
        for k, threshold in enumerate(edges[feature]):
            b, n = by_feature[f].get(k, (0, 0))
            bad, rows = bad + b, rows + n
            for above, part in ((False, (bad, rows)), (True, (before[0] - bad, before[1] - rows))):
                if part[1] >= LEAST_ROWS and (gain := _gain(before, part)) > top:
                    best, top, kept = Condition(feature, above, threshold), gain, part
    return best, kept


def _pruned(bins: DataFrame, edges: dict[str, list[float]], taken: tuple[Condition, ...]) -> tuple[tuple[Condition, ...], float, int]:
    """The beginning of a rule that is best on the pruning set, its precision
    there and the rows it covers there; one aggregation for all beginnings."""
    inside, sums = F.lit(True), []
    for n, c in enumerate(taken):
        k = edges[c.feature].index(c.threshold)
        inside = inside & (F.col(c.feature) > k if c.above else F.col(c.feature) <= k)
        sums += [F.count_if(inside & F.col("bad")).alias(f"b{n}"), F.count_if(inside).alias(f"n{n}")]
    found = bins.where(~F.col("grow")).agg(*sums).first()
    # Worth (p - n) / (p + n) with a rule of succession; ties keep fewer conditions.
    worth = [(2 * found[f"b{n}"] - found[f"n{n}"]) / (found[f"n{n}"] + 2) for n in range(len(taken))]
    n = max(range(len(taken)), key=lambda k: (worth[k], -k))
    return taken[:n + 1], (found[f"b{n}"] + 1) / (found[f"n{n}"] + 2), found[f"n{n}"]


def learn_rules(statistics: DataFrame, labels: DataFrame) -> list[Rule]:
    """Rules for bad documents (label ``quality`` 0) among those that the base
    lets pass, learned from all labelled rows."""
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") < 1).alias("bad"))
    shares = [F.expr(e).cast("double").alias(name) for name, e in FEATURES.items()]
    rows = common.stored(
        statistics.where(~base_failed()).join(marked, "doc_id").select("doc_id", "bad", *shares), "quality-labelled")
    size = rows.agg(F.count("*").alias("n"), F.count_if("bad").alias("bad")).first()
    if not 0 < size["bad"] < size["n"]:
        return []
    quantiles = [k / BINS for k in range(1, BINS)]
    cuts = rows.approxQuantile(list(FEATURES), quantiles, 0.001)
    # Junk may be rarer than a bin: its own quantiles are edges too.
    bad_cuts = rows.where("bad").approxQuantile(list(FEATURES), [k / 8 for k in range(1, 8)], 0.001)
    edges = {f: sorted({*a, *b, 0.0}) for f, a, b in zip(FEATURES, cuts, bad_cuts)}
    binned = [
        sum((F.col(f) > t).cast("int") for t in edges[f]).alias(f) if edges[f] else F.lit(0).alias(f) for f in FEATURES]
    grow = (F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(3)) < 2).alias("grow")
    bins = common.stored(rows.select("bad", grow, *binned), "quality-bins")
    rules: list[Rule] = []
    while len(rules) < RULES:
        taken: tuple[Condition, ...] = ()
        while len(taken) < CONDITIONS:
            condition, (bad, n) = _grown(bins, edges, taken)
            if condition is None:
                break
            taken += (condition,)
            if bad == n:
                break
        if not taken:
            break
        kept, precision, covered = _pruned(bins, edges, taken)
        if precision < LEAST_PRECISION or covered < LEAST_ROWS:
            break
        rules.append(Rule(kept))
        inside = F.lit(True)
        for c in kept:
            k = edges[c.feature].index(c.threshold)
            inside = inside & (F.col(c.feature) > k if c.above else F.col(c.feature) <= k)
        bins = bins.where(~inside)
    return _centred(rules, rows)


def _centred(rules: list[Rule], rows: DataFrame) -> list[Rule]:
    """The rules with each threshold in the middle between the labelled values
    next to it: the same on these rows, and as far from them as can be."""
    conditions = list(dict.fromkeys(c for r in rules for c in r.conditions))
    if not conditions:
        return rules
    sides = []
    for k, c in enumerate(conditions):
        value = F.col(c.feature)
        sides += [F.max(F.when(value <= c.threshold, value)).alias(f"below{k}"),
                  F.min(F.when(value > c.threshold, value)).alias(f"above{k}")]
    found = rows.agg(*sides).first()
    moved = {}
    for k, c in enumerate(conditions):
        below, above = found[f"below{k}"], found[f"above{k}"]
        moved[c] = c if below is None or above is None else replace(c, threshold=(below + above) / 2)
    return [Rule(tuple(moved[c] for c in r.conditions)) for r in rules]


def verdict(rules: list[Rule]) -> Column:
    """kept: false where the base fails, then where a rule holds, in order."""
    out = F.when(base_failed(), False)
    for rule in rules:
        out = out.when(rule.column(), False)
    return out.otherwise(True)


def rule_number(rules: list[Rule]) -> Column:
    """Which rule decides: 0 the base, then the rules from 1, null for none."""
    out = F.when(base_failed(), 0)
    for k, rule in enumerate(rules, 1):
        out = out.when(rule.column(), k)
    return out


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The statistics of every document with base_failed, kept and rule."""
    statistics = common.stored(text_statistics(docs), "quality-statistics")
    rules = learn_rules(statistics, labels)
    return statistics.select("*", base_failed().alias("base_failed"), verdict(rules).alias("kept"), rule_number(rules).alias("rule"))

"""Conversation repair against enumerated edits and a parse with every split."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from featureflow.llm import conversations as conv
from featureflow.llm.queries import op12_conversation_repair

SHAPE = re.compile(r"(s?(ua)+)?")
SPACES = " \t\n\x0b\x0c\r"


def plain_rows(rows):
    """Damaged rows by conversation, in order."""
    out = defaultdict(list)
    for c, t, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(":".join(" " if x is None else str(x) for x in (c, t)).encode()) % 20
        out[c]
        if kind == 0:
            continue
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        out[c] += [(t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, own in out.items()}


def plain_faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        mark = text.rstrip(SPACES)[-1:]
        out.append("blank" if not mark else "duplicate" if (role, text) in seen else "truncated" if mark not in ".!?" else "")
        seen.add((role, text))
    return out


def enumerated(rows, faults):
    """Cheapest edits by trying them all, up to two insertions in a row."""
    best = None
    options = []
    for (_, role, text), fault in zip(rows, faults):
        more = 3 * (fault == "truncated")
        own = [("D", 4, None)]
        if fault in ("", "truncated"):
            own += [("K", more, (role, text)), ("R", 3 + more, ("user", text)), ("R", 3 + more, ("assistant", text))]
        options.append(own)
    inserted = [()] + [p for n in (1, 2) for p in itertools.product(("user", "assistant"), repeat=n)]
    gaps = [inserted] * (len(rows) + 1)
    for edits in itertools.product(*options):
        for added in itertools.product(*gaps):
            audit, cost, lines = "", 0, []
            for k, new in enumerate(added):
                audit, cost = audit + "I" * len(new), cost + 3 * len(new)
                lines += [(r, "") for r in new]
                if k < len(edits):
                    edit, price, line = edits[k]
                    audit, cost = audit + edit, cost + price
                    lines += [line] if line else []
            if SHAPE.fullmatch("".join(r[:1] or "?" for r, _ in lines)):
                found = (cost, audit, "\n".join(f"{r}:{t}" for r, t in lines))
                best = found if best is None else min(best, found)
    return best


def every_split(rows, faults):
    """The same grammar with every split of every span: (cost, audit)."""
    own = [conv._TERMINALS[conv._code(r[1][:1], f)] for r, f in zip(rows, faults)]
    n = len(own)
    if not n:
        return 0, ""
    cells = {(k, k + 1): own[k] for k in range(n)}
    for size in range(2, n + 1):
        for a in range(n - size + 1):
            made = [conv.product(cells[a, m], cells[m, a + size]) for m in range(a + 1, a + size)]
            assert all(m == made[0] for m in made)
            cells[a, a + size] = made[0]
    whole = conv.product(cells[0, n], conv.CLOSURE)
    return conv.least(*(whole[q] for q in conv.ACCEPTED))


def plan_of(rows, faults):
    codes = "".join(conv._code(r[1][:1], f) for r, f in zip(rows, faults))
    cost, chosen, tail = conv.choose([conv.parse(codes)])
    return cost, "".join(a for _, a in chosen) + tail


ROWS = [("system", "be good."), ("user", "Hi?"), ("user", "and so"), ("assistant", "Yes."), ("assistant", "no end"), ("tool", "x."), ("", "y!"),
        ("user", ""), ("assistant", " \n")]


def test_edits_against_all_edits():
    rng = random.Random(3)
    for _ in range(60):
        rows = [(k, *rng.choice(ROWS)) for k in range(rng.randint(1, 3))]
        faults = plain_faults(rows)
        assert plan_of(rows, faults) == enumerated(rows, faults)[:2], rows


def test_spans_against_every_split():
    rng = random.Random(4)
    for _ in range(60):
        rows = [(k, *rng.choice(ROWS)) for k in range(rng.randint(1, 24))]
        faults = plain_faults(rows)
        assert plan_of(rows, faults) == every_split(rows, faults)
        # However the rows are cut into spans, the choice is the same.
        codes = "".join(conv._code(r[1][:1], f) for r, f in zip(rows, faults))
        cuts = sorted(rng.sample(range(1, len(codes)), min(len(codes) - 1, 3))) if len(codes) > 1 else []
        parts = [codes[a:b] for a, b in zip([0, *cuts], [*cuts, len(codes)])]
        cost, chosen, tail = conv.choose([conv.parse(p) for p in parts])
        assert (cost, "".join(a for _, a in chosen) + tail) == plan_of(rows, faults)


def plain(rows):
    """Rows of the query, by conversation."""
    out = {}
    for c, own in plain_rows(rows).items():
        faults = plain_faults(own)
        cost, audit = plan_of(own, faults) if own else (0, "")
        lines, state, left = [], 0, iter(own)
        for edit in audit:
            turn = "a" if state == 2 else "u"
            row = next(left) if edit != "I" else None
            if edit == "D":
                continue
            role, text = (row[1], row[2]) if row else ("", "")
            if edit != "K":
                role = conv.ROLES[turn]
            state = conv.MOVES[state, role[0]]
            lines.append(f"{role}:{text}")
        turns = [t for t, *_ in own if t is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:])]
        out[c] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                  sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def asked(spark, rows, tmp_path, more=()):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.select("*", *(F.lit(k).alias(c) for k, c in enumerate(more))).write.parquet(f"{tmp_path}/conversations.parquet")
    found = op12_conversation_repair(spark, str(tmp_path)).collect()
    out = {r["conv_id"]: tuple(r)[1:] for r in found}
    assert len(out) == len(found)
    return out


CLASHING = ("key", "at", "fault", "copies", "cells", "live", "said", "place", "spans", "audit", "cost", "part", "codes")


def test_edge_cases(spark, tmp_path):
    rng = random.Random(5)
    rows = [(c, t, *rng.choice(ROWS)) for c in range(300) for t in range(rng.randint(1, 9))]
    rows += [(None, 1, "user", "Hi."), (None, 2, "assistant", None), (900, None, "user", "a."), (900, None, "user", "b"), (900, 5, None, "c."),
             (901, None, None, None), (902, 3, "user", "same."), (902, 3, "user", "same."), (902, 3, "assistant", "other."),
             (903, 1, "user", "long " * 300_000 + "."), (904, -5, "system", "s."), (904, 900, "user", "u.\x85")]
    assert asked(spark, rows, tmp_path, CLASHING) == plain(rows)


def test_one_conversation_with_most_rows(spark, tmp_path):
    """It is parsed in several partitions, and in the order of its turns."""
    rng = random.Random(6)
    rows = [(7, t, *rng.choice(ROWS[:5])) for t in range(3000)] + [(c, 1, "user", f"{c}.") for c in range(8, 400)]
    rng.shuffle(rows)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        passed = conv.spans(conv.faults(conv.damage(df)))
        parts = passed.where("cells is not null and key = ':7'").select("part").collect()
        assert len(parts) > 1
        assert asked(spark, rows, tmp_path) == plain(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_empty_table(spark, tmp_path):
    assert asked(spark, [], tmp_path) == {}


def test_repaired_rows_have_the_shape(spark):
    from .conftest import SF

    _, repaired = conv.repair(spark.read.parquet(f"{SF}/conversations.parquet"))
    by = defaultdict(str)
    for r in repaired.orderBy("key", "at", "place").collect():
        by[r["key"]] += r["role"][0]
    assert by and all(SHAPE.fullmatch(v) for v in by.values())


@pytest.mark.parametrize("p", conv.STATES)
def test_insertions_are_least(p):
    for q in conv.STATES:
        yields = [(0, "")] if p == q else []
        for n in (1, 2, 3):
            for roles in itertools.product("ua", repeat=n):
                state = p
                for c in roles:
                    state = conv.MOVES.get((state, c))
                if state == q:
                    yields.append((3 * n, "I" * n))
        assert conv.CLOSURE[4 * p + q] == min(yields, default=None)

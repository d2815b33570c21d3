"""Repair of damaged conversations by weighted interval parsing.

A row of a conversation is kept (K, cost 0), gets another role (R, 3) or is
deleted (D, 4); rows without a role's turn are inserted (I, 3).  Blank and
repeated rows must go; a truncated row that stays costs 3 more.  Wanted are the
cheapest edits, then the least audit (their initials in ASCII order), whose role
initials are ``(s?(ua)+)?``.

**Grammar.**  The shape is regular, so its Chomsky normal form has a symbol for
each pair of states, ``N(p,q) -> N(p,r) N(r,q)`` and ``N(p,q) -> row``: what a span
of rows yields while the shape goes from state p to q.  Every split of a span then
gives the same cell, so one split each is enough, and spans are combined bottom-up
by length, neighbours first: a span of n rows takes about n products of cells.

**Cells** hold the least (cost, audit) of each symbol.  Insertions close over the
states beforehand; they stand before a row, and after the last row once at the
end.  Audits of one span then hold as many rows and end in one, so none begins
another and the least parts make the least whole.

**Scale.**  Rows are dealt out by ranges of (conversation, turn), so a
conversation of any share is spread over partitions.  Every partition parses the
spans it has; a conversation's spans, at most one per partition, are combined and
the chosen states handed back to each span; the edits are joined to the rows by a
row number.  Only roles, faults and audits meet; texts stay with their rows.
Ranges are sampled, so the pass is stored once.

Defined results: a null conversation is one of its own; nulls in role and text are
one space; turns sort with nulls first, rows of one turn by role and text; rows
repeated exactly are duplicates; a role is known by its first letter; empty tables
give no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Fixed values of the repair: costs, and the words of inserted and changed roles.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
ROLES = {"u": "user", "a": "assistant"}

#: States of the shape: begin, after s, after u, after a; and what each letter does.
STATES = range(4)
MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ACCEPTED = (0, 3)

#: (cost, audit) of the least yield, by 4 * from + to; None if there is none.
Cell = tuple[int, str] | None
Span = list[Cell]


def least(*cells: Cell) -> Cell:
    return min((c for c in cells if c is not None), default=None)


def product(a: Span, b: Span) -> Span:
    """The cells of two neighbouring spans together."""
    out: Span = []
    for p in STATES:
        for q in STATES:
            best = None
            for r in STATES:
                x, y = a[4 * p + r], b[4 * r + q]
                if x is not None and y is not None:
                    both = x[0] + y[0], x[1] + y[1]
                    if best is None or both < best:
                        best = both
            out.append(best)
    return out


def _insertions() -> Span:
    """Least insertions from state to state, closed over any number of them."""
    once: Span = [(0, "") if p == q else (INSERT, "I") if q in {MOVES.get((p, c)) for c in ROLES} else None
                  for p in STATES for q in STATES]
    return reduce(product, [once] * len(STATES))


CLOSURE = _insertions()


def terminal(initial: str, gone: bool, truncated: bool) -> Span:
    """The cells of one row, with the insertions before it."""
    out: Span = []
    more = TRUNCATED * truncated
    for p in STATES:
        for q in STATES:
            cells: list[Cell] = [(DELETE, "D")] if p == q else []
            if not gone:
                if MOVES.get((p, initial)) == q:
                    cells.append((KEEP + more, "K"))
                if any(MOVES.get((p, c)) == q for c in ROLES):
                    cells.append((REROLE + more, "R"))
            out.append(least(*cells))
    return product(CLOSURE, out)


#: One character per row: the initial s, u, a or another, and the fault.
_KINDS = [(i, f) for i in "sua-" for f in "-bdt"]
CODE = {k: chr(65 + n) for n, k in enumerate(_KINDS)}
_TERMINALS = {CODE[i, f]: terminal(i, f in "bd", f == "t") for i, f in _KINDS}


def combine(spans: list[Span]) -> Span:
    """Bottom-up by span length: neighbours two by two."""
    while len(spans) > 1:
        spans = [product(*spans[k:k + 2]) if k + 1 < len(spans) else spans[k] for k in range(0, len(spans), 2)]
    return spans[0]


#: Cells of short runs of rows, kept within a worker: rows are of few kinds.
_RUN = 8
_RUNS: dict[str, Span] = {}


def parse(codes: str) -> Span:
    """The cells of a span of rows, given a character for each."""
    spans = []
    for k in range(0, len(codes), _RUN):
        run = codes[k:k + _RUN]
        if run not in _RUNS:
            if len(_RUNS) > 50_000:
                _RUNS.clear()
            _RUNS[run] = combine([_TERMINALS[c] for c in run])
        spans.append(_RUNS[run])
    return combine(spans)


def choose(spans: list[Span]) -> tuple[int, list[tuple[int, str]], str]:
    """Of a conversation's spans in order: (cost, (state before, audit) of each,
    insertions at the end)."""
    forward = [[(0, "") if p == 0 else None for p in STATES]]  # least yield of all before, by state
    back: list[list[int | None]] = []
    for span in spans:
        now: list[Cell] = []
        via: list[int | None] = []
        for q in STATES:
            best, by = None, None
            for p in STATES:
                x, y = forward[-1][p], span[4 * p + q]
                if x is not None and y is not None:
                    both = x[0] + y[0], x[1] + y[1]
                    if best is None or both < best:
                        best, by = both, p
            now.append(best)
            via.append(by)
        forward.append(now)
        back.append(via)
    ends = [((x[0] + y[0], x[1] + y[1]), q, y[1]) for q in STATES for f in ACCEPTED
            if (x := forward[-1][q]) is not None and (y := CLOSURE[4 * q + f]) is not None]
    (cost, _), state, tail = min(ends)
    out: list[tuple[int, str]] = []
    for span, via in zip(reversed(spans), reversed(back)):
        before = via[state]
        out.append((before, span[4 * before + state][1]))
        state = before
    return cost, out[::-1], tail


def roles_of(audit: str, codes: str, state: int) -> tuple[list[tuple[str, list[str], str]], int]:
    """For each row of a span: (edit, roles inserted before it, its new role,
    empty unless it changes), and the state after the span.

    The shape fixes every role: after s and a comes u, after u comes a; in the
    first state too, since only a kept row can be an s."""
    out: list[tuple[str, list[str], str]] = []
    before: list[str] = []
    rows = iter(codes)
    for edit in audit:
        turn = "a" if state == 2 else "u"
        if edit == "I":
            before.append(ROLES[turn])
            state = MOVES[state, turn]
            continue
        initial = _KINDS[ord(next(rows)) - 65][0]
        if edit == "D":
            out.append((edit, before, ""))
        else:
            out.append((edit, before, ROLES[turn] if edit == "R" else ""))
            state = MOVES[state, initial if edit == "K" else turn]
        before = []
    return out, state


def conversation_key(conv_id: str = "conv_id") -> Column:
    """Text that names a conversation; null is one of its own."""
    return F.when(F.col(conv_id).isNull(), "").otherwise(F.concat(F.lit(":"), F.col(conv_id).cast("string")))


def damage(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) damaged by crc32 of ``conv_id:turn``
    modulo 20: 0 drops, 1 empties, 2 takes out ``.!?``, 3 repeats, 4 makes a
    user of the role.  Dropped rows stay, with ``live`` false."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    return rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), (kind != 0).alias("live"),
        F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))).alias("again")).drop("again")


_SPACES = " \t\n\x0b\x0c\r"


def faults(rows: DataFrame) -> DataFrame:
    """Live rows with ``key``, ``fault`` (blank, duplicate, truncated or empty:
    the first that holds) and ``copies``: exact repeats, all but the first of
    which are duplicates, are one row here."""
    live = rows.where("live").withColumn("key", conversation_key())
    said = F.sha2(F.concat_ws("\x00", F.length("role"), "role", "text"), 256)
    merged = live.withColumn("said", said).groupBy("key", "turn", "said").agg(
        F.first("conv_id").alias("conv_id"), F.first("role").alias("role"), F.first("text").alias("text"), F.count("*").alias("copies"))
    # Nulls sort first; a minimum would skip them.
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    merged = merged.withColumn("place", order)
    first = merged.groupBy("key", "said").agg(F.min("place").alias("first"))
    last = F.right(F.rtrim(F.col("text"), F.lit(_SPACES)), F.lit(1))
    return merged.join(first, ["key", "said"]).select(
        "key", "conv_id", "turn", "role", "text", "copies",
        F.when(last == "", "blank").when(F.col("first") < F.col("place"), "duplicate")
        .when(~last.isin(".", "!", "?"), "truncated").otherwise("").alias("fault"))


_PASS = ("at long, key string, turn long, role string, text string, "
         "part int, first long, codes string, head string, tail string, illegal long, "
         "cells array<struct<cost:long,audit:string>>")


def _code(initial: str, fault: str) -> str:
    return CODE[initial if initial in "sua" and initial else "-", fault[:1] or "-"]


def spans(found: DataFrame) -> DataFrame:
    """One stored pass over the rows of ``faults`` in order: every row with a
    number (``at``), and a row with ``cells`` for each span, the rows of one
    conversation that one partition has."""
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")
    rows = found.select("key", "turn", "role", "text", "fault", copies).withColumn(
        "fault", F.when((F.col("copy") > 1) & (F.col("fault") != "blank"), "duplicate").otherwise(F.col("fault")))
    order = ["key", "turn", "role", "text", "copy"]
    arrow = pa.schema([
        ("at", pa.int64()), ("key", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()),
        ("part", pa.int32()), ("first", pa.int64()), ("codes", pa.string()), ("head", pa.string()), ("tail", pa.string()),
        ("illegal", pa.int64()), ("cells", pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        at = part << 40
        key, first, codes, initials = None, 0, [], []

        def ended() -> dict:
            joined = "".join(codes)
            illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
            cells = [c and {"cost": c[0], "audit": c[1]} for c in parse(joined)]
            return {"key": key, "part": part, "first": first, "codes": joined, "head": initials[0], "tail": initials[-1],
                    "illegal": illegal, "cells": cells}

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column("key").to_pylist()
            done = []
            for k, role, fault in zip(keys, batch.column("role").to_pylist(), batch.column("fault").to_pylist()):
                if k != key:
                    if codes:
                        done.append(ended())
                    key, first, codes, initials = k, at, [], []
                initials.append(role[:1])
                codes.append(_code(role[:1], fault))
                at += 1
            own = {"at": pa.array(range(at - n, at), pa.int64())} | {c: batch.column(c) for c in ("key", "turn", "role", "text")}
            yield pa.RecordBatch.from_arrays([own.get(f.name, pa.nulls(n, f.type)) for f in arrow], schema=arrow)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=arrow)
        if codes:
            yield pa.RecordBatch.from_pylist([ended()], schema=arrow)

    common.ship_package(found.sparkSession)
    return common.stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, _PASS), "conversation-spans")


def parsed(passed: DataFrame) -> DataFrame:
    """key, cost, audit, illegal, tail (insertions at the end), end (state
    before them), last (number of its last row) and edits, an array of (at,
    edit, before, role) for each row, of every conversation."""
    edit = "array<struct<at:long,edit:string,before:array<string>,role:string>>"
    joined = passed.where("cells is not null").groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct("part", "first", "codes", "head", "tail", "illegal", "cells"))).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                own = row["spans"]  # one per partition at most
                cells = [[c and (c["cost"], c["audit"]) for c in s["cells"]] for s in own]
                cost, chosen, tail = choose(cells)
                edits, state = [], 0
                for s, (state, audit) in zip(own, chosen):
                    rows, state = roles_of(audit, s["codes"], state)
                    edits += [{"at": s["first"] + k, "edit": e, "before": b, "role": r} for k, (e, b, r) in enumerate(rows)]
                after = []
                for _ in tail:
                    turn = "a" if state == 2 else "u"
                    after.append(ROLES[turn])
                    state = MOVES[state, turn]
                illegal = sum(s["illegal"] for s in own) + sum(
                    a["tail"] + b["head"] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
                out.append({"key": row["key"], "cost": cost, "audit": "".join(a for _, a in chosen) + tail, "illegal": illegal,
                            "after": after, "last": own[-1]["first"] + len(own[-1]["codes"]) - 1, "edits": edits})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_PARSED)

    return joined.mapInArrow(run, f"key string, cost long, audit string, illegal long, after array<string>, last long, edits {edit}")


_PARSED = pa.schema([
    ("key", pa.string()), ("cost", pa.int64()), ("audit", pa.string()), ("illegal", pa.int64()), ("after", pa.list_(pa.string())),
    ("last", pa.int64()), ("edits", pa.list_(pa.struct([
        ("at", pa.int64()), ("edit", pa.string()), ("before", pa.list_(pa.string())), ("role", pa.string())])))])


def repaired_rows(passed: DataFrame, plans: DataFrame) -> DataFrame:
    """key, at, place, role, text: the rows of the repaired conversations in
    order of (at, place); inserted rows stand at the row they come before, those
    at the end at the last one."""
    edits = plans.select("key", "after", "last", F.explode("edits").alias("e")).select(
        F.col("e.at").alias("at"), F.col("e.edit").alias("edit"), F.col("e.before").alias("before"), F.col("e.role").alias("new"),
        F.when(F.col("e.at") == F.col("last"), F.col("after")).otherwise(F.array().cast("array<string>")).alias("after"))
    rows = passed.where("at is not null").select("at", "key", "role", "text").join(edits, "at")
    added = lambda c: F.transform(c, lambda r: F.struct(r.alias("role"), F.lit("").alias("text")))
    own = F.when(F.col("edit") == "D", F.array().cast("array<struct<role:string,text:string>>")).otherwise(
        F.array(F.struct(F.when(F.col("new") == "", F.col("role")).otherwise(F.col("new")).alias("role"), F.col("text").alias("text"))))
    return rows.select("key", "at", F.posexplode(F.concat(added("before"), own, added("after"))).alias("place", "turn")).select(
        "key", "at", "place", "turn.role", "turn.text")


def digests(repaired: DataFrame) -> DataFrame:
    """key, repaired_sha256 of ``role:text`` lines.  A hash is sequential, so a
    conversation's lines stream through one task; none are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None

        def ended():
            return pa.RecordBatch.from_pydict({"key": [key], "repaired_sha256": [digest.hexdigest()]})

        for batch in batches:
            keys, hashes = [], []
            for k, role, text in zip(*(batch.column(c).to_pylist() for c in ("key", "role", "text"))):
                line = f"{role}:{text}".encode()
                if k == key:
                    digest.update(b"\n" + line)
                    continue
                if digest is not None:
                    keys.append(key), hashes.append(digest.hexdigest())
                key, digest = k, hashlib.sha256(line)
            if keys:
                yield pa.RecordBatch.from_pydict({"key": keys, "repaired_sha256": hashes})
        if digest is not None:
            yield ended()

    return repaired.repartition("key").sortWithinPartitions("key", "at", "place").select("key", "role", "text").mapInArrow(
        run, "key string, repaired_sha256 string")


def measures(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, key, gaps and counts of faults of every conversation; ``rows``
    as from ``damage``, ``found`` as from ``faults``."""
    turns = rows.withColumn("key", conversation_key()).groupBy("key", "turn").agg(
        F.first("conv_id").alias("conv_id"), F.max("live").alias("live"))
    alive = F.when(F.col("live"), F.col("turn"))
    gaps = turns.groupBy("key").agg(
        F.first("conv_id").alias("conv_id"),
        F.coalesce(F.max(alive) - F.min(alive) + 1 - F.count(alive), F.lit(0)).cast("long").alias("gaps"))
    # All copies but the first of a row that is not blank are duplicates.
    n = lambda kind: F.sum(F.when(F.col("fault") == kind, F.col("own")).otherwise(0)).cast("long").alias(kind)
    more = F.when(F.col("fault") != "blank", F.col("copies") - 1).otherwise(0)
    kinds = found.withColumn("own", F.when(F.col("fault") == "truncated", 1).otherwise(F.col("copies"))).groupBy("key").agg(
        n("blank"), n("duplicate"), n("truncated"),
        F.sum(F.when(F.col("fault").isin("truncated", ""), more).otherwise(0)).cast("long").alias("more"))
    return gaps.join(kinds.withColumn("duplicate", F.col("duplicate") + F.col("more")).drop("more"), "key", "left")


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a row per conversation with its measures, cost and audit; the repaired
    rows) of damaged ``conversations``."""
    rows = damage(conversations)
    found = common.stored(faults(rows), "conversation-rows")
    passed = spans(found)
    plans = common.stored(parsed(passed), "conversation-plans")
    summary = measures(rows, found).join(plans.select("key", "cost", "audit", "illegal"), "key", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return summary.select(
        "key", "conv_id", "gaps", *(zero(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit")), repaired_rows(passed, plans)

"""Repair of conversation structure at the least cost, by Hirschberg's divide and conquer.

Roles must spell `(s?(ua)+)?` (initials of system, user, assistant). A row's first fault
counts: blank (no character but white space), duplicate (role and text seen earlier in
the conversation), truncated (the last such character isn't one of `.!?`). Edits:

    K  keep      0      a row whose initial fits here
    R  rerole    3      to the role that fits here, user or assistant
    D  delete    4      the only edit for blank and duplicate rows
    I  insert    3      an empty user or assistant turn, anywhere

A truncated row that isn't deleted adds 3. Of the cheapest repairs the one whose string
of edits comes first in ASCII order is taken; it determines the repaired turns.

An automaton of four states (nothing yet, after system, user, assistant) accepts the
pattern, and in each state one role may be added besides a leading system. Costs over
rows are vectors of four: forward the cheapest way to each state after a row, backward
from each state to an accepting end. Inserts belong to the row after them, so that edits
up to a row are strings none of which begins another: to compare two whole repairs it
suffices to rank the four strings up to a row. `edits` meets both vectors in the middle,
crosses in the state of least cost and then least rank, and recurses on both halves, in
space linear in the rows.

On Spark: rows are range-partitioned by (conversation, turn, role, text), so a long
conversation spreads over partitions. Conversations whole inside a partition are repaired
there. A piece of one that reaches a partition's end, or that outgrows `PIECE_ROWS` or
`PIECE_CHARS`, is summarised by four by four costs and ranks; per conversation the pieces'
summaries (about one per 16 MB of text) meet in the middle the same way, then each piece
is repaired between its two states, and the digest runs over the pieces in order.

Defined results: null roles and texts are one space. Turns order rows, nulls first, ties
by role and text. An unknown role has no place and is reroled or deleted. Null conv_id is
a conversation of its own. Extra columns are ignored; an empty table gives no rows.
Identical rows of one turn stay together in one partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from panelkit.session import materialize

NOTHING, SYSTEM, USER, ASSISTANT = STATES = range(4)
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 3, 4, 3, 3
# The role that may come next in each state, and the state after it.
NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAME = {USER: "user", ASSISTANT: "assistant"}
ACCEPT = (NOTHING, ASSISTANT)
FAR = 1 << 60
# A piece of a conversation that is repaired in one go has at most so many rows and characters.
PIECE_ROWS, PIECE_CHARS = 1 << 16, 1 << 24
# Row classes: initial (s, u, a, other), times fault (none, truncated, must be deleted).
FINE, TRUNCATED, DELETED = range(3)
INITIALS = "sua"


def _ways(state: int) -> list[tuple[int, int, str]]:
    """(state, cost, edits) after no, one or two inserts."""
    out = [(state, 0, "")]
    for _ in range(2):
        s, cost, audit = out[-1]
        out.append((NEXT[s], cost + INSERT, audit + "I"))
    return out


def _moves(kind: int) -> list[list[tuple[int, int, str]]]:
    """Per state before a row of this class: (state after, cost, edits), the best for each state after."""
    initial, fault = divmod(kind, 3)
    extra = CUT_OFF if fault == TRUNCATED else 0
    out = []
    for state in STATES:
        best: dict[int, tuple[int, str]] = {}
        for s, cost, audit in _ways(state):
            found = [(s, cost + DELETE, audit + "D")]
            if fault != DELETED:
                if initial == 0 and s == NOTHING:
                    found.append((SYSTEM, cost + KEEP + extra, audit + "K"))
                if initial + 1 == NEXT[s]:
                    found.append((NEXT[s], cost + KEEP + extra, audit + "K"))
                found.append((NEXT[s], cost + REROLE + extra, audit + "R"))
            for to, c, a in found:
                best[to] = min(best.get(to, (FAR, "")), (c, a))
        out.append([(to, c, a) for to, (c, a) in best.items()])
    return out


MOVES = [_moves(kind) for kind in range(12)]
# At the end only inserts are left: the least cost and the edits from each state.
LAST = [min((c, a) for s, c, a in _ways(state) if s in ACCEPT) if state != SYSTEM else (2 * INSERT, "II") for state in STATES]


def _start(state: int) -> tuple[list[int], list[int]]:
    return [0 if s == state else FAR for s in STATES], [0] * 4


def forward(kinds, costs: list[int], ranks: list[int]) -> tuple[list[int], list[int]]:
    """Costs of the cheapest edits up to each state after `kinds`, and the rank of their strings."""
    for kind in kinds:
        best: list = [None] * 4
        for state in STATES:
            if costs[state] >= FAR:
                continue
            for to, cost, audit in MOVES[kind][state]:
                found = (costs[state] + cost, ranks[state], audit)
                if best[to] is None or found < best[to]:
                    best[to] = found
        order = sorted((b[1:], s) for s, b in enumerate(best) if b)
        costs, ranks = [b[0] if b else FAR for b in best], [0] * 4
        for rank, (_, s) in enumerate(order):
            ranks[s] = rank
    return costs, ranks


def backward(kinds, costs: list[int]) -> list[int]:
    """Costs from each state before `kinds` to the states after them, which cost `costs` from there on."""
    for kind in reversed(kinds):
        costs = [min(cost + costs[to] for to, cost, _ in MOVES[kind][state]) for state in STATES]
    return costs


def edits(kinds, start: int, end: int) -> list[str]:
    """Per row its edits (inserts before it first): the ASCII-least of the cheapest from state to state."""
    if not len(kinds):
        return []
    if len(kinds) == 1:
        return [min((c, a) for to, c, a in MOVES[kinds[0]][start] if to == end)[1]]
    mid = len(kinds) // 2
    costs, ranks = forward(kinds[:mid], *_start(start))
    rest = backward(kinds[mid:], _start(end)[0])
    cross = min(STATES, key=lambda s: (costs[s] + rest[s], ranks[s]))
    return edits(kinds[:mid], start, cross) + edits(kinds[mid:], cross, end)


def end_state(kinds, start: int = NOTHING) -> tuple[int, int]:
    """(state after the last row, whole cost) of the best repair."""
    costs, ranks = forward(kinds, *_start(start))
    end = min(STATES, key=lambda s: (costs[s] + LAST[s][0], ranks[s]))
    return end, costs[end] + LAST[end][0]


def repaired(audit: list[str], roles: list[str], texts: list[str], state: int) -> Iterator[tuple[str, str]]:
    """The turns that the edits leave, from `state` on; rows beyond the last one are inserts only."""
    for at, steps in enumerate(audit):
        for step in steps:
            if step == "D":
                continue
            if step == "K":
                yield roles[at], texts[at]
                state = SYSTEM if roles[at][:1] == "s" else NEXT[state]
            else:
                state = NEXT[state]
                yield NAME[state], texts[at] if step == "R" else ""


def kind_of(role: str, text: str, duplicate: bool) -> tuple[int, int]:
    """(class, fault) of a row; fault: 0 none, 1 blank, 2 duplicate, 3 truncated."""
    body = text.rstrip(" \t\n\v\f\r")
    fault = 1 if not body else 2 if duplicate else 3 if body[-1] not in ".!?" else 0
    initial = INITIALS.find(role[:1]) if role else -1
    return (initial if initial >= 0 else 3) * 3 + (TRUNCATED if fault == 3 else DELETED if fault else FINE), fault


class Piece:
    """Rows of one conversation that follow each other."""

    def __init__(self, conv, piece: int, first: bool):
        self.conv, self.piece, self.first = conv, piece, first
        self.roles, self.texts, self.kinds, self.faults, self.chars = [], [], [], [0] * 4, 0

    def add(self, role: str, text: str, duplicate: bool) -> None:
        kind, fault = kind_of(role, text, duplicate)
        self.roles.append(role)
        self.texts.append(text)
        self.kinds.append(kind)
        self.faults[fault] += 1
        self.chars += len(text)

    def row(self, whole: bool) -> tuple:
        """The record: repaired if the conversation is whole, else summarised with its rows."""
        legal = {"su", "ua", "au"}
        illegal = sum(a[:1] + b[:1] not in legal for a, b in zip(self.roles, self.roles[1:]))
        head = (self.conv, self.piece, whole, *self.faults[1:], illegal)
        if whole:
            end, cost = end_state(self.kinds)
            steps = edits(self.kinds, NOTHING, end) + [LAST[end][1]]
            text = "\n".join(f"{r}:{t}" for r, t in repaired(steps, self.roles, self.texts, NOTHING))
            return *head, cost, "".join(steps), hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(), *[None] * 7
        table = [forward(self.kinds, *_start(s)) for s in STATES]
        costs, ranks = [x for t in table for x in t[0]], [x for t in table for x in t[1]]
        return (*head, None, None, None, self.roles[0][:1], self.roles[-1][:1], costs, ranks, self.roles, self.texts, bytes(self.kinds))


FIELDS = (
    "piece long, whole boolean, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "repaired_sha256 string, head string, tail string, costs array<long>, ranks array<long>, roles array<string>, texts array<string>, kinds binary"
)


def _pieces(rows: DataFrame) -> DataFrame:
    """(conv, ...FIELDS): conversations repaired whole, and the summarised pieces of the others."""
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "text"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    schema = f"conv {rows.schema['conv'].dataType.simpleString()}, {FIELDS}"
    arrow = rows.sparkSession.createDataFrame([], schema).toArrow().schema

    def walk(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, number, before, out = None, 0, None, []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(arrow.names, r)) for r in out], schema=arrow)

        for f in frames:
            for conv, turn, role, text, again, p in zip(*(c.to_pylist() for c in f.columns)):
                key = (conv, turn, role, text)
                if piece is None or piece.conv != conv:
                    if piece is not None:  # the first conversation of a partition may have begun in another one
                        out.append(piece.row(whole=not piece.first))
                    first = piece is None
                    number = 0 if piece is None else number + 1
                    piece = Piece(conv, (p << 32) + number, first)
                elif len(piece.kinds) >= PIECE_ROWS or piece.chars >= PIECE_CHARS:
                    out.append(piece.row(whole=False))
                    number += 1
                    piece = Piece(conv, (p << 32) + number, True)
                piece.add(role, text, again or key == before)
                before = key
                if len(out) >= 512 or (out and out[-1][2] is False):
                    yield flush()
                    out = []
        if piece is not None:  # and the last one may go on
            out.append(piece.row(whole=False))
        if out:
            yield flush()

    return dealt.select("conv", "turn", "role", "text", "again", "_p").mapInArrow(walk, schema)


def cross(summaries: list[tuple[list[int], list[int]]], start: int, rest: list[int]) -> list[int]:
    """The state after each piece, from (costs, ranks) four by four; `rest` is the cost from the end on."""
    if not summaries:
        return []

    def ahead(part):
        costs, ranks = _start(start)
        for c, r in part:
            best = [min((costs[s] + c[4 * s + to], ranks[s], r[4 * s + to]) for s in STATES) for to in STATES]
            order = sorted((b[1:], s) for s, b in enumerate(best) if b[0] < FAR)
            costs, ranks = [min(b[0], FAR) for b in best], [0] * 4
            for rank, (_, s) in enumerate(order):
                ranks[s] = rank
        return costs, ranks

    mid = (len(summaries) + 1) // 2
    behind = rest
    for c, _ in reversed(summaries[mid:]):
        behind = [min(c[4 * s + to] + behind[to] for to in STATES) for s in STATES]
    costs, ranks = ahead(summaries[:mid])
    state = min(STATES, key=lambda s: (costs[s] + behind[s], ranks[s]))
    if len(summaries) == 1:
        return [state]
    left = cross(summaries[:mid], start, [0 if s == state else FAR for s in STATES])
    return left + cross(summaries[mid:], state, rest)


def _between(open_: DataFrame) -> DataFrame:
    """(conv, piece, start, end, last): the states before and after every open piece."""
    schema = open_.select("conv", "piece").schema.simpleString()[7:-1].replace(":", " ") + ", start int, end int, last boolean, more long, total long"

    def meet(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["piece"])
        states = cross([(r["costs"], r["ranks"]) for r in rows], NOTHING, [c for c, _ in LAST])
        legal, total, out = {"su", "ua", "au"}, 0, []
        for i, (r, before, after) in enumerate(zip(rows, [NOTHING, *states], states)):
            total += r["costs"][4 * before + after]
            out.append((r["conv"], r["piece"], before, after, i + 1 == len(rows), int(i > 0 and rows[i - 1]["tail"] + r["head"] not in legal), 0))
        out[-1] = (*out[-1][:-1], total + LAST[states[-1]][0])
        names = ["conv", "piece", "start", "end", "last", "more", "total"]
        return pa.Table.from_arrays([pa.array(c) for c in zip(*out)], names).cast(
            pa.schema([(n, t) for n, t in zip(names, [table.schema.field("conv").type, pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64()])]))

    return open_.select("conv", "piece", "head", "tail", "costs", "ranks").groupBy("conv").applyInArrow(meet, schema)


def _joined(open_: DataFrame) -> DataFrame:
    """The open conversations: (conv, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)."""
    states = _between(open_).withColumnRenamed("conv", "_conv").withColumnRenamed("piece", "_piece")
    both = open_.join(states, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("piece") == F.col("_piece")))
    spread = both.repartition("conv").sortWithinPartitions("conv", "piece").select(
        "conv", "start", "end", "last", "more", "total", "blank", "duplicate", "truncated", "illegal", "roles", "texts", "kinds")
    schema = f"conv {open_.schema['conv'].dataType.simpleString()}, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    arrow = open_.sparkSession.createDataFrame([], schema).toArrow().schema

    def fold(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, any_turn, audit, sums = hashlib.sha256(), False, [], np.zeros(4, np.int64)
        for f in frames:
            for r in (row for i in range(f.num_rows) for row in f.slice(i, 1).to_pylist()):
                steps = edits(list(r["kinds"]), r["start"], r["end"]) + ([LAST[r["end"]][1]] if r["last"] else [])
                for role, text in repaired(steps, r["roles"], r["texts"], r["start"]):
                    digest.update((("\n" if any_turn else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                    any_turn = True
                audit.append("".join(steps))
                sums += [r["blank"], r["duplicate"], r["truncated"], r["illegal"] + r["more"]]
                if r["last"]:
                    row = (r["conv"], *map(int, sums), r["total"], "".join(audit), digest.hexdigest())
                    yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, row))], schema=arrow)
                    digest, any_turn, audit, sums = hashlib.sha256(), False, [], np.zeros(4, np.int64)

    return spread.mapInArrow(fold, schema)


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    plain = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), space(role).alias("role"), space(text).alias("text"))
    plain = plain.withColumn("_digest", F.sha2(F.col("text").cast("binary"), 256))
    # Rows seen before: where a role and text has several turns, all but the first one; within a turn the walk sees them.
    first = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    many = (
        plain.groupBy("conv", "role", "_digest").agg(F.min(first).alias("_first"), F.max(first).alias("_final")).filter("_first <> _final")
        .select(F.col("conv").alias("_conv"), F.col("role").alias("_role"), F.col("_digest").alias("_text"), "_first")
    )
    met = F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("_digest") == F.col("_text"))
    marked = plain.join(many, met, "left").select(
        "conv", "turn", "role", "text", F.coalesce(~first.eqNullSafe(F.col("_first")) & F.col("_first").isNotNull(), F.lit(False)).alias("again"))
    pieces = materialize(_pieces(marked), "conversation-pieces")
    columns = ["conv", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    done = pieces.filter("whole").select(columns).unionByName(_joined(pieces.filter("NOT whole")).select(columns))
    gaps = plain.groupBy("conv", "turn").agg(F.lit(1).alias("_")).groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps")).withColumnRenamed("conv", "_conv")
    return done.join(gaps, F.col("conv").eqNullSafe(F.col("_conv"))).select(F.col("conv").alias(conv), "gaps", *columns[1:])


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with the faults that crc32 of `conv_id:turn` plants; nulls of text columns are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    hurt = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), fault.alias("_fault")).filter("_fault <> 0")
    hurt = hurt.withColumn("text", F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    hurt = hurt.withColumn("role", F.when(F.col("_fault") == 4, "user").otherwise(F.col("role")))
    return hurt.withColumn("_", F.explode(F.array_repeat(F.lit(0), F.when(F.col("_fault") == 3, 2).otherwise(1)))).select("conv_id", "turn", "role", "text")


def repair_damaged(rows: DataFrame) -> DataFrame:
    """Every conversation of `rows`, damaged and repaired; one without rows after the damage has zeros and an empty audit."""
    fixed = repair(damage(rows)).withColumnRenamed("conv_id", "_conv")
    every = rows.select("conv_id").distinct()
    out = every.join(fixed, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select(
        "conv_id", *[F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in numbers], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )

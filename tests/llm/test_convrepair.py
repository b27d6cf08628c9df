"""Conversation repair against every possible sequence of edits."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import pytest

from panelkit.llm import convrepair

SHAPE = re.compile(r"(s?(ua)+)?")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        show = lambda x: " " if x is None else str(x)
        f = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if f == 0:
            continue
        text = "" if f == 1 else re.sub("[.!?]", "", text) if f == 2 else text
        out += [(conv, turn, "user" if f == 4 else role, text)] * (2 if f == 3 else 1)
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))


def plain(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, digest) of one conversation by uniform-cost search over edits."""
    rows = order(rows)
    faults, seen = [], set()
    for _, _, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]+", "", text)
        faults.append("b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for _, t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, roles, kept = heapq.heappop(heap)
        if at == len(rows) and SHAPE.fullmatch(roles):
            break
        if (at, audit, roles) in done or len(roles) > len(rows) + 3:
            continue
        done.add((at, audit, roles))
        if not SHAPE.fullmatch(roles) and not any(SHAPE.fullmatch(roles + x) for x in ("a", "ua")):
            continue
        for r, name in (("u", "user"), ("a", "assistant")):
            heapq.heappush(heap, (cost + 3, audit + "I", at, roles + r, (*kept, f"{name}:")))
        if at < len(rows):
            _, _, role, text = rows[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, roles, kept))
            if faults[at] not in ("b", "d"):
                more = 3 if faults[at] == "t" else 0
                heapq.heappush(heap, (cost + more, audit + "K", at + 1, roles + (role[:1] or "?"), (*kept, f"{role}:{text}")))
                for r, name in (("u", "user"), ("a", "assistant")):
                    heapq.heappush(heap, (cost + 3 + more, audit + "R", at + 1, roles + r, (*kept, f"{name}:{text}")))
    digest = hashlib.sha256("\n".join(kept).encode()).hexdigest()
    return gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, digest


def conversations(seed, n):
    rnd, out = random.Random(seed), []
    for conv in range(n):
        for k in range(rnd.randint(1, 7)):
            turn = rnd.choice([k, k, k, k + 1, None])
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", None])
            text = rnd.choice(["Yes.", "No!", "And then", "Why? \n", " \t", "", None, f"Item {k}.", "a" * 50 + "."])
            out.append((conv, turn, role, text))
    return out + [(None, 0, "user", "Hm."), (None, 1, "assistant", "Ah.")]


@pytest.mark.parametrize("pieces", [1 << 16, 2])
def test_equals_search_over_all_edits(spark, monkeypatch, pieces):
    monkeypatch.setattr(convrepair, "PIECE_ROWS", pieces)
    rows = conversations(5, 60)
    groups = {}
    for r in damaged(rows):
        groups.setdefault(r[0], []).append(r)
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    want = {c: plain(groups[c]) if c in groups else empty for c in {r[0] for r in rows}}
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, conv string").repartition(5)
    got = convrepair.repair_damaged(df).collect()
    assert len(got) == len(want)
    assert {r.conv_id: tuple(r[1:]) for r in got} == want


def test_long_conversation_spreads_over_partitions(spark):
    rnd = random.Random(2)
    rows = [(1, k, rnd.choice(["user", "assistant", "tool"]), rnd.choice([f"Row {k}.", f"Row {k}", "", "Same."])) for k in range(3000)]
    got = convrepair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)).collect()[0]
    # The same by a plain table of all costs and strings.
    seen, kinds = set(), []
    for _, _, role, text in rows:
        kinds.append(convrepair.kind_of(role, text, (role, text) in seen)[0])
        seen.add((role, text))
    best = {convrepair.NOTHING: (0, "")}
    for kind in kinds:
        after = {}
        for s, (c, a) in best.items():
            for to, cost, audit in convrepair.MOVES[kind][s]:
                after[to] = min(after.get(to, (1 << 60, "")), (c + cost, a + audit))
        best = after
    cost, audit = min((c + convrepair.LAST[s][0], a + convrepair.LAST[s][1]) for s, (c, a) in best.items())
    assert (got.cost, got.audit) == (cost, audit) and got.gaps == 0


def test_edges(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert convrepair.repair_damaged(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, None, None, None), (1, None, None, None), (2, 0, "user", "x" * 2_000_000 + "."), (2, 1, "assistant", "Fine."), (2, 1, "assistant", "Fine.")]
    got = {r.conv_id: r for r in convrepair.repair(spark.createDataFrame(rows, schema)).collect()}
    assert (got[1].audit, got[1].blank, got[1].gaps, got[1].repaired_sha256) == ("DD", 2, 0, hashlib.sha256(b"").hexdigest())
    assert (got[2].audit, got[2].duplicate, got[2].cost) == ("KKD", 1, 4)

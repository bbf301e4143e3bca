"""Repairs against Dijkstra over (cost, edits), and the damaged conversations against plain Python."""
from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import pytest

from hirelens.llm import conversations as c

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(codes):
    rows, best, heap = [*codes, c.END], set(), [(0, "", 0)]
    while True:
        cost, letters, v = heapq.heappop(heap)
        if v == 4 * len(rows):
            return cost, letters
        if v not in best:
            best.add(v)
            for letter, more, step in c.ARCS[rows[v >> 2]][v & 3]:
                heapq.heappush(heap, (cost + more, letters + letter, v + step))


@pytest.mark.parametrize("stride", [1, 3, 8, 1000])
def test_auction_equals_dijkstra(stride):
    rng = random.Random(stride)
    for _ in range(1500):
        codes = [rng.choice([0, 3, 6, 9]) + rng.choice([0, 0, 0, 1, 2]) for _ in range(rng.randrange(25))]
        assert c.cheapest_edits(codes, stride) == brute(codes)


def test_prices_never_exceed_an_arc_and_the_price_behind_it():
    rng = random.Random(9)
    codes = [rng.choice([0, 3, 6, 9]) + rng.choice([0, 0, 1, 2]) for _ in range(200)]
    price, rows = c.auction(codes), [*codes, c.END]
    # Behind a solved row all arcs of its stretch hold; arcs never lead back over it.
    for v in range(4 * len(rows)):
        for _, cost, step in c.ARCS[rows[v >> 2]][v & 3]:
            assert price[v] <= cost + price[v + step]


def test_long_conversations_take_time_in_proportion():
    assert c.cheapest_edits([4] * 50_000) == (50_000 * 4, "D" * 50_000)


def expected(rows):
    """The contract, row by row."""
    out = {}
    for conv in {r[0] for r in rows}:
        after = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
            fault = zlib.crc32(name.encode()) % 20
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            after += [(turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        faults, codes, seen = [0, 0, 0], [], set()
        for _, role, text in after:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            kind = 0 if not body else 1 if (role, text) in seen else 2 if body[-1] not in ".!?" else None
            seen.add((role, text))
            codes.append(3 * {"s": 0, "u": 1, "a": 2}.get(role[:1], 3) + {0: 2, 1: 2, 2: 1, None: 0}[kind])
            if kind is not None:
                faults[kind] += 1
        turns = {r[0] for r in after if r[0] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        cost, audit = brute(codes)
        left, out_rows, now = iter(after), [], 0
        for edit in audit:
            row = next(left) if edit != "I" else (None, None, "")
            if edit == "K":
                out_rows.append((row[1], row[2]))
                now = {"s": 1, "u": 2, "a": 3}[row[1][0]]
            elif edit != "D":
                now = 3 if now == 2 else 2
                out_rows.append(("user" if now == 2 else "assistant", row[2]))
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0][0] for r in out_rows))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(after, after[1:]))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out_rows).encode()).hexdigest()
        out[conv] = ((gaps, *faults, illegal, cost, audit, digest), out_rows)
    return out


@pytest.fixture
def odd_conversations():
    rng = random.Random(4)
    texts = [None, "", " \t", "Done.", "Why?\n", "no end", "Ünd 漢字!", "x" * 200_000 + ".", "a\nb."]
    rows = [
        (conv, None if rng.random() < 0.03 else turn + rng.choice([0, 0, 0, 3]), rng.choice(["system", "user", "assistant", "user", "assistant", "", "tool", None, "User"]), rng.choice(texts[3:]) if rng.random() < 0.8 else rng.choice(texts))
        for conv in [*range(40), None] for turn in range(rng.randrange(1, 14))
    ]
    return rows + [(7, 2, "user", "Done.")] * 3 + [(50, -(2**63), "user", "Done."), (50, 2**63 - 1, "user", "Done?")]


def test_report_and_turns_equal_plain_python(spark, odd_conversations):
    frame = spark.createDataFrame(odd_conversations, SCHEMA).selectExpr("*", "1 as kind", "'x' as key", "'y' as hash", "'z' as fault")
    want = expected(odd_conversations)
    big = want.pop(50)
    rows = {r["conv_id"]: tuple(r)[1:] for r in c.repair_report(c.damaged(frame)).collect()}
    assert len(rows) == len(want) + 1
    assert rows.pop(50)[1:] == big[0][1:]
    assert rows == {k: v[0] for k, v in want.items()}
    turns: dict = {}
    for r in c.repaired_turns(c.damaged(frame)).collect():
        turns.setdefault(r["conv_id"], []).append((r["place"], r["role"], r["text"]))
    assert {k: [t[1:] for t in sorted(v)] for k, v in turns.items() if k != 50} == {k: v[1] for k, v in want.items() if v[1]}


def test_small_batches_and_empty_table(spark, odd_conversations):
    want = {k: v[0] for k, v in expected(odd_conversations).items() if k != 50}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        frame = spark.createDataFrame(odd_conversations, SCHEMA)
        assert {r["conv_id"]: tuple(r)[1:] for r in c.repair_report(c.damaged(frame)).collect() if r["conv_id"] != 50} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert c.repair_report(c.damaged(spark.createDataFrame([], SCHEMA))).count() == 0

"""Repair of conversations against a brute-force version: all repairs in the order of their costs, then of their initials."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from tabulon.llm import conversations as C

FULL = re.compile(r"[^\x20\x09-\x0D]")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(conv, turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    return out


def cheapest(turns):
    """(cost, initials, repaired) by search over (turns read, state), least (cost, initials) first."""
    heap = [(0, "", 0, 0, ())]
    done = set()
    while heap:
        cost, edits, k, state, out = heapq.heappop(heap)
        if k == len(turns) and state in (0, 3):
            return cost, edits, out
        if (k, state) in done:
            continue
        done.add((k, state))
        given = ("assistant", 3) if state == 2 else ("user", 2)
        heapq.heappush(heap, (cost + 2, edits + "I", k, given[1], (*out, (given[0], ""))))
        if k == len(turns):
            continue
        role, text, gone, cut = turns[k]
        heapq.heappush(heap, (cost + 3, edits + "D", k + 1, state, out))
        if gone:
            continue
        heapq.heappush(heap, (cost + 2 + cut, edits + "R", k + 1, given[1], (*out, (given[0], text))))
        to = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((role[:1], state))
        if to:
            heapq.heappush(heap, (cost + cut, edits + "K", k + 1, to, (*out, (role, text))))


def expected(original, rows):
    """rows: after damage, as a dict of conversations."""
    turns = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    seen, faults, count = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    for _, _, role, text in turns:
        full = FULL.findall(text)
        fault = "blank" if not full else "duplicate" if (role, text) in seen else "truncated" if full[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            count[fault] += 1
        faults.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
    known = [t for _, t, _, _ in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    initials = [r[2][:1] for r in turns]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, edits, out = cheapest(faults)
    text = "\n".join(f"{r}:{t}" for r, t in out)
    return (original, gaps, *count.values(), illegal, cost, edits, hashlib.sha256(text.encode()).hexdigest())


def made(seed=1):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \n", "One. Two", "a.\t", "é?", None]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "User", None, ""]
    rows = []
    for conv in [*range(120), None]:
        n = rng.choice([1, 2, 3, 5, 8, 13])
        for k in range(n):
            turn = None if rng.random() < 0.05 else k + rng.choice([0, 0, 0, 1])
            plain = rng.random() < 0.7
            rows.append((conv, turn, ("user", "assistant")[k % 2] if plain else rng.choice(roles), f"Text {k}." if plain else rng.choice(texts)))
    for conv, n in ((1000, 300), (1001, 150)):  # longer than many pieces
        rows += [(conv, k // 2, rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"t {k}!") for k in range(n)]
    rows += [(1002, None, "user", "Same.")] * 40 + [(1003, 7, "assistant", "ok")] * 30
    return rows


def run(spark, rows, at):
    spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, conv string, piece int").repartition(3).write.parquet(f"{at}/conversations.parquet")
    return C.op12_conversations(spark, str(at))


@pytest.mark.parametrize(("bits", "fan"), [(11, 6), (3, 1)])
def test_query(spark, tmp_path, monkeypatch, bits, fan):
    monkeypatch.setattr(C, "PIECE_BITS", bits)
    monkeypatch.setattr(C, "FAN_BITS", fan)
    monkeypatch.setattr(C, "FAN", 1 << fan)
    rows = made()
    after = defaultdict(list)
    for r in damaged(rows):
        after[r[0]].append(r)
    want = sorted((expected(c, after[c]) for c in {r[0] for r in rows}), key=str)
    got = run(spark, rows, tmp_path)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_turns(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "user", "Hi."), (1, 3, "assistant", "Hel"), (2, 0, "assistant", "So?")]
    repair = C.Repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    turns = [tuple(r) for r in repair.turns().orderBy("conv", "at", "sub").select("conv", "edit", "turn", "role", "text").collect()]
    assert turns == [("1", "K", 0, "system", "Be kind."), ("1", "K", 1, "user", "Hi."), ("1", "K", 3, "assistant", "Hel"), ("2", "I", None, "user", ""), ("2", "K", 0, "assistant", "So?")]
    assert {r["conv"]: (r["cost"], r["audit"]) for r in repair.report.collect()} == {"1": (4, "KKDK"), "2": (2, "IK")}


def test_product_is_associative():
    rng = random.Random(2)
    kinds = [C.turn_matrix(i, g, t) for i in ("s", "u", "a", "") for g in (False, True) for t in (False, True)]
    for _ in range(300):
        a, b, c = (C.product(rng.choice(kinds), rng.choice(kinds)) for _ in range(3))
        assert C.product(C.product(a, b), c) == C.product(a, C.product(b, c))


def test_empty_table(spark, tmp_path):
    assert run(spark, [], tmp_path).count() == 0

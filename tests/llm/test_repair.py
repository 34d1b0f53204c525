"""Conversation repair against enumerated edits and a plain recursion."""

from __future__ import annotations

import functools
import itertools
import random
import re

import numpy as np
import pytest

from loomwork.llm import repair

CODE = {"s": 1, "u": 2, "a": 3}
STATE = "nsua"
AFTER = {("n", "s"): "s", ("n", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
TURN = {"n": "u", "s": "u", "u": "a", "a": "u"}


def enumerated(rows: list[tuple[str, bool, bool]]) -> tuple[int, str]:
    """The least (cost, letters) over every way to edit (role initial, has to go, truncated), two inserts at most in a place."""
    gaps = [("", 0, "")] + [("I", 3, x) for x in "ua"] + [("II", 6, x + y) for x in "ua" for y in "ua"]
    best = None
    choices = [[("D", 4, "")] + ([] if gone else [("K", 3 * cut, r), ("R", 3 + 3 * cut, "u"), ("R", 3 + 3 * cut, "a")]) for r, gone, cut in rows]
    for picked in itertools.product(*choices):
        for inserts in itertools.product(gaps, repeat=len(rows) + 1):
            parts = [x for pair in itertools.zip_longest(inserts, picked) for x in pair if x]
            if re.fullmatch("(s?(ua)+)?", "".join(p[2] for p in parts)):
                found = (sum(p[1] for p in parts), "".join(p[0] for p in parts))
                best = min(best or found, found)
    return best


def recursed(rows: list[tuple[str, bool, bool]]) -> tuple[int, str]:
    @functools.cache
    def least(i: int, state: str, inserts: int) -> tuple[int, str]:
        found = [(0, "")] if i == len(rows) and state in "na" else []
        step = lambda cost, letter, rest: found.append((cost + rest[0], letter + rest[1]))
        if inserts < 3:
            step(3, "I", least(i, TURN[state], inserts + 1))
        if i < len(rows):
            role, gone, cut = rows[i]
            step(4, "D", least(i + 1, state, 0))
            if not gone and (state, role) in AFTER:
                step(3 * cut, "K", least(i + 1, AFTER[state, role], 0))
            if not gone:
                step(3 + 3 * cut, "R", least(i + 1, TURN[state], 0))
        return min(found, default=(10**6, ""))

    return least(0, "n", 0)


def planned(conversations: list[list[tuple[str, bool, bool]]]) -> list[tuple[int, str]]:
    flat = [r for c in conversations for r in c]
    code = np.array([CODE.get(r[0], 4) for r in flat], dtype=int)
    starts = np.cumsum([0, *map(len, conversations)])
    cost, letters, _ = repair.plan(code, np.array([r[1] for r in flat], dtype=bool), np.array([r[2] for r in flat], dtype=bool), starts)
    return [(int(c), x.tobytes().decode()) for c, x in zip(cost, letters)]


def drawn(rng: random.Random, most: int) -> list[tuple[str, bool, bool]]:
    return [(rng.choice("ssuuuaaax"), gone := rng.random() < 0.2, not gone and rng.random() < 0.2) for _ in range(rng.randint(0, most))]


def test_short_conversations_match_every_way_to_edit():
    rng = random.Random(1)
    conversations = [drawn(rng, 2) for _ in range(60)] + [drawn(rng, 3) for _ in range(6)]
    assert planned(conversations) == [enumerated(c) for c in conversations]


@pytest.mark.parametrize("cells", [repair.CELLS, 40])
def test_buckets_match_a_plain_recursion(monkeypatch, cells):
    monkeypatch.setattr(repair, "CELLS", cells)
    rng = random.Random(2)
    conversations = [drawn(rng, 14) for _ in range(400)] + [drawn(rng, 120) for _ in range(5)]
    assert planned(conversations) == [recursed(c) for c in conversations]


def plain(rows: list[tuple]) -> tuple:
    """The expected result of one conversation's (turn, role, text, absent)."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x, gone in rows if not gone), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, judged = set(), []
    for _, role, text in rows:
        bare = text.rstrip(repair.SPACE)
        kind = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        judged.append((role[:1], kind in ("blank", "duplicate"), kind == "truncated", kind))
    turns = {t for t, _, _ in rows if t is not None}
    cost, audit = recursed([j[:3] for j in judged])
    out, state, at = [], "n", 0
    for letter in audit:
        if letter in "IR":
            state = TURN[state]
            out.append(({"u": "user", "a": "assistant"}[state], "" if letter == "I" else rows[at][2]))
        elif letter == "K":
            state = AFTER[state, judged[at][0]]
            out.append(rows[at][1:])
        at += letter != "I"
    count = lambda kind: sum(j[3] == kind for j in judged)
    illegal = sum(x[0] + y[0] not in ("su", "ua", "au") for x, y in zip(judged, judged[1:]))
    return len(rows), max(turns) - min(turns) + 1 - len(turns) if turns else 0, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, out


def conversations(rng: random.Random) -> list[tuple]:
    texts = ["Yes.", "No", "", " \n\t", None, "Well?! ", " ", "x" * 3_000_000 + ".", "Yes."]
    rows = []
    for conv in [None, *range(60)]:
        for _ in range(rng.randint(1, 9)):
            rows.append((conv, rng.choice([None, 0, 1, 2, 5, 7]), rng.choice(["user", "assistant", "system", "tool", "", None, "user"]), rng.choice(texts[:7] if rng.random() < 0.99 else texts), rng.random() < 0.1 if conv != 7 else True))
    return rows + rows[:5]


@pytest.mark.parametrize("held", [1, repair.HELD_ROWS])
def test_repaired_conversations(spark, held):
    rows = conversations(random.Random(3))
    table = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, absent boolean, conv string, cost int").repartition(5)
    by_id: dict = {}
    for conv, *rest in rows:
        by_id.setdefault(conv, []).append(tuple(rest))
    got = {r["conv_id"]: (*r[1:-1], [tuple(t) for t in r["turns"]]) for r in repair.repaired(table, absent_col="absent", held_rows=held).collect()}
    assert got == {c: plain(r) for c, r in by_id.items()}
    assert got[7] == (0, 0, 0, 0, 0, 0, 0, "", [])
    assert repair.repaired(table.limit(0)).count() == 0


def test_repaired_roles_are_as_wanted_and_repair_is_stable(spark, sf_dir):
    """Repaired turns need no further edit but for texts that are empty or cut off."""
    for r in repair.repaired(repair.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")), absent_col="absent").collect():
        assert re.fullmatch("(s?(ua)+)?", "".join(t["role"][0] for t in r["turns"]))
        assert len(r["audit"]) - r["audit"].count("I") == r["n_rows"]


def test_long_conversation_in_one_tensor():
    rows = drawn(random.Random(4), 0) + [("ua"[i % 2], i % 97 == 5, i % 31 == 7) for i in range(20_000)]
    (cost, audit), = planned([rows])
    assert len(audit.replace("I", "")) == 20_000 and cost == sum({"D": 4, "I": 3, "K": 0, "R": 3}[x] for x in audit) + 3 * sum(c and x != "D" for (_, _, c), x in zip(rows, audit.replace("I", "")))

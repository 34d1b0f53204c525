"""Conversation structure repair: the cheapest edits that make the roles ``(s?(ua)+)?``, by a time-major tensor DP.

Rows go to their conversation's task in one shuffle and arrive sorted; a task cuts its stream into batches of whole
conversations. Those are bucketed by length, so that less than half of a tensor is padding, and a tensor has the turns as its
first axis: one vectorised step a turn serves all conversations of the bucket. The backward steps store the cost from
each state to the end; the forward steps read the edits off these costs, again for all conversations at once.

States are what the repaired roles end in: nothing, a system turn, a user turn, an assistant turn; nothing and an
assistant turn may come last. From a state each edit leads to one state, so taking the least letter whose edit is still
among the cheapest gives the ASCII-least audit.

A conversation is the unit of work and must fit a task, as its turns come back as one array.
Defined results: rows are taken by turn (null first), then role, then text. A null role or text is one space, in keys too; a null id
is a conversation like any other. Roles count by their first character: ``s``, ``u`` and ``a`` can be kept, any other,
or none, only replaced or deleted. Repeated rows are duplicates. Very long texts pass whole; other columns of any name aren't looked at;
an empty table gives an empty result. A conversation of which every row is marked absent has zeros, no turns and an empty audit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import batches_of, ship

#: Fixed costs and letters of the edits, the letters in ASCII order; white space that doesn't make a text.
KEEP_COST, INSERT_COST, REROLE_COST, DELETE_COST, TRUNCATED_COST = 0, 3, 3, 4, 3
DELETE, INSERT, KEEP, REROLE = b"DIKR"
SPACE = "\t\n\x0b\x0c\r "
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The state that an inserted or replaced turn leads to, by the state before it.
_NEXT = np.array([USER, USER, ASSISTANT, USER])
#: The state that a kept turn leads to, by its code (padding, s, u, a, other) and the state before it; -1 where the roles don't allow it.
_KEPT = np.array([[NOTHING, SYSTEM, USER, ASSISTANT], [SYSTEM, -1, -1, -1], [USER, USER, -1, USER], [-1, -1, ASSISTANT, -1], [-1, -1, -1, -1]])
_FAR = np.int64(1) << 40
#: Rows held until their conversations are repaired, and cells of a tensor.
HELD_ROWS, CELLS = 50_000, 1 << 19

RESULT = "n_rows bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, turns array<struct<role: string, text: string>>"


def crc_of(id_col: str = "conv_id", turn_col: str = "turn") -> Column:
    """crc32 of ``id:turn``, a null as one space."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return F.crc32(F.concat(shown(id_col), F.lit(":"), shown(turn_col)).cast("binary"))


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and ``absent`` of conversations with faults by the hash of their key: of 20 rows one is
    dropped (marked absent), one loses its text, one its sentence ends, one is repeated and one says it is a user's."""
    fault = crc_of() % 20
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), fault.alias("__f"))
    role = F.when(F.col("__f") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("__f") == 1, "").when(F.col("__f") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("__f") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("__f") == 0).alias("absent"), F.explode(copies)).drop("col")


def _bucket(code: np.ndarray, must_go: np.ndarray, extra: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cost, edits, their roles) of conversations as columns of time-major tensors; an edit is a row of the output, 0 for none.

    ``code`` is 0 where a conversation is over, ``must_go`` marks turns that have to be deleted, ``extra`` is what keeping one costs more."""
    steps, n = code.shape
    every = np.arange(n)
    back = np.full((steps + 1, 4, n), _FAR)

    def with_inserts(cost: np.ndarray) -> np.ndarray:
        one = cost[_NEXT] + INSERT_COST
        return np.minimum(np.minimum(cost, one), cost[_NEXT[_NEXT]] + 2 * INSERT_COST)

    end = np.full((4, n), _FAR)
    end[[NOTHING, ASSISTANT]] = 0
    back[steps] = with_inserts(end)
    for t in range(steps - 1, -1, -1):
        after, over = back[t + 1], code[t] == 0
        stay = np.where(must_go[t], _FAR, extra[t])
        kept = np.empty((4, n), dtype=np.int64)
        for s in range(4):
            to = _KEPT[code[t], s]
            kept[s] = np.where(to < 0, _FAR, after[to, every] + KEEP_COST) + np.where(over, 0, stay)
        consumed = np.minimum(kept, np.where(over, _FAR, after + DELETE_COST))
        consumed = np.minimum(consumed, np.where(over, _FAR, after[_NEXT] + REROLE_COST + stay))
        # where a conversation is over, inserts come behind its last turn only, in the end's costs
        back[t] = np.where(over, after, with_inserts(consumed))
    edits, roles = np.zeros((3 * steps + 2, n), dtype=np.uint8), np.zeros((3 * steps + 2, n), dtype=np.uint8)
    state = np.full(n, NOTHING)
    for t in range(steps):
        todo, after, stay = code[t] > 0, back[t + 1], np.where(must_go[t], _FAR, extra[t])
        for k in range(3):  # two inserts and what uses the turn up, at most
            best, to = back[t][state, every], _KEPT[code[t], state]
            delete = todo & (after[state, every] + DELETE_COST == best)
            insert = todo & ~delete & (back[t][_NEXT[state], every] + INSERT_COST == best)
            keep = todo & ~delete & ~insert & (to >= 0) & (after[to, every] + KEEP_COST + stay == best)
            rerole = todo & ~delete & ~insert & ~keep
            for mask, letter in ((delete, DELETE), (insert, INSERT), (keep, KEEP), (rerole, REROLE)):
                edits[3 * t + k][mask] = letter
            state = np.where(insert | rerole, _NEXT[state], np.where(keep, to, state))
            roles[3 * t + k] = state
            todo = todo & insert
    for k in range(2):
        insert = (state != NOTHING) & (state != ASSISTANT)
        edits[3 * steps + k][insert] = INSERT
        state = np.where(insert, _NEXT[state], state)
        roles[3 * steps + k] = state
    return back[0][NOTHING], edits, roles


def plan(code: np.ndarray, must_go: np.ndarray, truncated: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(cost, letters, roles behind each edit) of conversations that lie behind one another from ``starts`` on (the last is the end)."""
    length = np.diff(starts)
    cost, letters, roles = np.zeros(len(length), dtype=np.int64), [np.zeros(0, np.uint8)] * len(length), [np.zeros(0, np.uint8)] * len(length)
    order = np.argsort(length, kind="stable")
    order = order[length[order] > 0]
    at = 0
    while at < len(order):
        least = int(length[order[at]])
        most = min(2 * least - 1, CELLS) if least < CELLS else least
        stop = int(np.searchsorted(length[order], most, side="right"))
        stop = min(stop, at + max(1, CELLS // most))
        own = order[at:stop]
        steps = int(length[own[-1]])
        place = np.arange(steps)[:, None]
        there = place < length[own]
        row = np.where(there, starts[own] + place, 0)
        got, edits, after = _bucket(np.where(there, code[row], 0), there & must_go[row], np.where(there & truncated[row], TRUNCATED_COST, 0), length[own])
        cost[own] = got
        for i, e, r in zip(own.tolist(), edits.T, after.T):
            used = e != 0
            letters[i], roles[i] = e[used], r[used]
        at = stop
    return cost, letters, roles


def repaired_rows(rows: pa.Table, id_name: str) -> pa.RecordBatch:
    """The result rows of whole conversations, whose rows lie behind one another."""
    conv = rows["conv"].combine_chunks()
    runs = _ends(conv)
    heads = np.concatenate([[0], runs[:-1]])
    ids = conv.take(pa.array(heads))
    present = ~np.asarray(rows["absent"].combine_chunks().cast(pa.int8())).astype(bool)
    of = np.repeat(np.arange(len(runs)), np.diff(np.concatenate([[0], runs])))[present]
    rows = rows.filter(pa.array(present)).combine_chunks()
    n, k = len(rows), len(runs)
    role, text, turn = (rows[c].combine_chunks() for c in ("role", "text", "turn"))
    starts = np.searchsorted(of, np.arange(k + 1))
    initial = pc.utf8_slice_codeunits(role, 0, 1)
    code = np.select([np.asarray(pc.equal(initial, x)) for x in ("s", "u", "a")], [1, 2, 3], 4) if n else np.zeros(0, int)
    bare = pc.utf8_rtrim(text, SPACE)
    blank = np.asarray(pc.equal(bare, ""))
    ending = np.asarray(pc.is_in(pc.utf8_slice_codeunits(bare, -1, 1 << 30), pa.array([".", "!", "?"])))
    # a row is a duplicate if an earlier one of its conversation has its role and text
    numbers = [np.asarray(x.dictionary_encode().indices) for x in (role, text)]
    key = np.stack([of, *numbers], axis=1) if n else np.zeros((0, 3), int)
    seen = np.ones(n, dtype=bool)
    seen[np.unique(key, axis=0, return_index=True)[1]] = False
    duplicate, truncated = seen & ~blank, ~seen & ~blank & ~ending
    cost, letters, roles = plan(code, blank | duplicate, truncated, starts)
    pair = of[1:] == of[:-1]
    legal = ((code[:-1] == 1) & (code[1:] == 2)) | ((code[:-1] == 2) & (code[1:] == 3)) | ((code[:-1] == 3) & (code[1:] == 2))
    count = lambda mask, of=of: np.bincount(of[mask], minlength=k)
    # turns are sorted within a conversation, nulls first
    known = np.asarray(pc.is_valid(turn))
    number = np.asarray(pc.fill_null(turn, 0)).astype(np.int64)[known]
    its = of[known]
    first, last = np.searchsorted(its, np.arange(k)), np.searchsorted(its, np.arange(k), side="right") - 1
    fresh = np.ones(len(its), dtype=bool)
    fresh[1:] = (its[1:] != its[:-1]) | (number[1:] != number[:-1])
    some = last >= first
    gaps = np.zeros(k, dtype=np.int64)
    gaps[some] = number[last[some]] - number[first[some]] + 1 - count(fresh, its)[some]
    turns = []
    roles_of, texts_of = role.to_pylist(), text.to_pylist()
    names = {USER: "user", ASSISTANT: "assistant"}
    for i in range(k):
        out, at = [], int(starts[i])
        for e, r in zip(letters[i].tolist(), roles[i].tolist()):
            if e != DELETE:
                out.append({"role": roles_of[at] if e == KEEP else names[r], "text": "" if e == INSERT else texts_of[at]})
            at += e != INSERT
        turns.append(out)
    columns = [ids, pa.array(np.diff(starts).astype(np.int64)), *(pa.array(x.astype(np.int64)) for x in (gaps, count(blank), count(duplicate), count(truncated), np.bincount(of[1:][pair & ~legal], minlength=k), cost))]
    columns += [pa.array([x.tobytes().decode() for x in letters], pa.string()), pa.array(turns, pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))]
    return pa.RecordBatch.from_arrays(columns, [id_name, "n_rows", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "turns"])


def _ends(conv: pa.Array) -> np.ndarray:
    """Where the runs of equal ids end."""
    return np.asarray(pc.run_end_encode(conv).run_ends).astype(np.int64) if len(conv) else np.zeros(0, dtype=np.int64)


def _whole(batches: Iterator[pa.RecordBatch], held_rows: int) -> Iterator[pa.Table]:
    """Tables of whole conversations, of ``held_rows`` rows or one conversation more."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        first, last = held[0]["conv"][0].as_py(), batch["conv"][-1].as_py()
        if first == last or sum(b.num_rows for b in held) < held_rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        end = int(_ends(table["conv"].combine_chunks())[-2])  # the last conversation may go on
        yield table.slice(0, end)
        held = table.slice(end).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def repaired(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", absent_col: str | None = None, *, held_rows: int = HELD_ROWS) -> DataFrame:
    """A row for each conversation: its id, ``n_rows``, counts of faults, the cost and letters of the cheapest edits, and the repaired turns.

    A row's first fault counts: blank (nothing but white space), duplicate (role and text seen earlier), truncated
    (doesn't end in ``.``, ``!`` or ``?``). ``illegal`` counts neighbours whose roles don't follow each other, ``gaps`` the turn numbers
    between the least and the largest that are missing. Rows with a true ``absent_col`` don't count, but their conversation is reported."""
    ship(turns.sparkSession)
    absent = F.coalesce(F.col(absent_col), F.lit(False)) if absent_col else F.lit(False)
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.col(id_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), filled(role_col).alias("role"), filled(text_col).alias("text"), absent.alias("absent"))
    dealt = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole(batches, held_rows):
            yield repaired_rows(table, id_col)

    kind = dict(turns.dtypes)[id_col]
    return dealt.mapInArrow(batches_of(repair), f"`{id_col}` {kind}, {RESULT}")

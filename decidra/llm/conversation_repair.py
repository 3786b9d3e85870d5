"""Cheapest repairs of conversations' structure, by dynamic programming over time-major tensors.

A conversation's rows, in order, are edited until its roles are nothing, or `system` once at most and then pairs of `user` and
`assistant`. Keep is free, Rerole (to user or assistant) costs 2, Delete 3, Insert (of an empty user or assistant turn, anywhere) 2; a
truncated row that isn't deleted adds 1; blank and duplicate rows must be deleted. Of the cheapest edits the ones whose initials
come first in ASCII are taken.

Four states say what has been written last: nothing, system, user, assistant. Conversations are bucketed by length, and a
bucket is one tensor (turn, conversation, state) of the costs from there to the end, filled from the last turn to the first, a
turn of all conversations at a time. It is kept, and the edits of all conversations are traced through it, one edit of each at a
time: the first in ASCII whose cost and what is left after it make up the cost before it. Each edit leads to one state, so this
finds the least string.

A conversation of more than LONG_ROWS rows isn't held by one task. It is cut in segments; a segment's cheapest costs from each state to each
state are a 4 x 4 table, and the tables of a conversation, taken from the last to the first, give each segment the costs
behind it. Each segment is then solved and traced from all four states, and the states are followed from the first
segment on. Only its audit and the hash of its text, which are single values, pass through one task, as streams.

Defined results: a null role or text is one space; rows go by turn, nulls first, then role, then the SHA-256 of the text; a
row's fault is the first of blank, duplicate, truncated; a role of no initial or of another than s, u, a can't be kept; rows with a
null conv_id are one conversation; rows with `present` false only say that their conversation exists; an empty table
gives no rows; columns other than those named are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decidra.llm._common import BROADCAST_ROWS, lean, stage
from decidra.llm._repair_costs import CODES, DONE, FORCED, LEGAL, STARTED, backward_costs, trace
from decidra.llm.long_conversations import FACTS, SEGMENT, LongRepair

BLANKS = " \t\n\x0b\x0c\r"
LONG_ROWS, LONG_CHARS = 20_000, 32 << 20  # beyond which a conversation isn't held by one task
PLACES = 1 << 16  # edits of a segment, at most
HELD_ROWS, HELD_BYTES = 50_000, 16 << 20  # of conversations that wait for others of their length


def fault(role: str, text: str, seen: set[tuple[str, str]]) -> str:
    """'blank', 'duplicate', 'truncated' or ''; seen: the rows before, to which this one is added."""
    solid = text.rstrip(BLANKS)
    if not solid:
        return "blank"
    if (role, text) in seen:
        return "duplicate"
    seen.add((role, text))
    return "" if solid[-1] in ".!?" else "truncated"


def edited(rows: list[tuple[str, str]], audit: bytes) -> Iterator[tuple[str, str, str, int]]:
    """(edit, role, text, number of the row or -1) of every edit; a deleted row's own role and text."""
    state, nxt = STARTED, 0
    for e in audit.decode():
        role, text = ("", "") if e == "I" else rows[nxt]
        if e in "IR":
            state = int(FORCED[state])
            role = ("", "", "user", "assistant")[state]
        elif e == "K":
            state = CODES[role[0]]
        yield e, role, text, -1 if e == "I" else nxt
        nxt += e != "I"


def text_hash(rows: list[tuple[str, str]], audit: bytes) -> str:
    lines = (f"{role}:{text}" for e, role, text, _ in edited(rows, audit) if e != "D")
    return hashlib.sha256("\n".join(lines).encode("utf-8", "surrogatepass")).hexdigest()


class Conversation:
    """One conversation's rows and what is counted of them."""

    def __init__(self, conv_id: int | None, turns: list[int | None], rows: list[tuple[str, str]]):
        self.conv_id, self.rows, seen = conv_id, rows, set()
        self.faults = [fault(role, text, seen) for role, text in rows]
        known = {t for t in turns if t is not None}
        self.gaps = max(known) - min(known) + 1 - len(known) if known else 0
        initials = [role[:1] for role, _ in rows]
        self.codes = [CODES.get(x, 0) for x in initials]
        self.illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))


def solve(bucket: list[Conversation]) -> list[tuple[int, bytes]]:
    """(cost, audit) of conversations of one length."""
    tensor = lambda each: np.array([each(c) for c in bucket]).reshape(len(bucket), -1).T
    codes = tensor(lambda c: c.codes).astype(np.int64)
    must, cut = tensor(lambda c: [f in ("blank", "duplicate") for f in c.faults]).astype(bool), tensor(lambda c: [f == "truncated" for f in c.faults]).astype(bool)
    behind = np.broadcast_to(DONE, (len(bucket), 4))
    costs = backward_costs(codes, must, cut, behind)
    audits, _ = trace(costs, codes, must, cut, behind, np.full(len(bucket), STARTED))
    return list(zip(costs[0, :, STARTED].tolist(), audits, strict=True))


EDITS = "conv_id long, place long, edit string, turn long, role string, text string"


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[int | None], list[tuple[str, str]]]]:
    """Each conversation of rows (conv_id, turn, role, text, present) that come sorted."""
    name, turns, rows, begun = None, [], [], False
    for batch in batches:
        for conv_id, turn, role, text, present in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not begun or conv_id != name:
                if begun:
                    yield name, turns, rows
                name, turns, rows, begun = conv_id, [], [], True
            if present:
                turns.append(turn)
                rows.append((role, text))
    if begun:
        yield name, turns, rows


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[Conversation, list[int | None], int, bytes]]]:
    """Buckets of solved conversations."""
    held: dict[int, list[tuple[Conversation, list[int | None]]]] = {}
    rows = size = 0

    def flush() -> Iterator[list]:
        for bucket in held.values():
            found = solve([c for c, _ in bucket])
            yield [(c, turns, *f) for (c, turns), f in zip(bucket, found, strict=True)]

    for conv_id, turns, lines in _conversations(batches):
        held.setdefault(len(lines), []).append((Conversation(conv_id, turns, lines), turns))
        rows, size = rows + len(lines) + 1, size + sum(len(text) for _, text in lines)
        if rows > HELD_ROWS or size > HELD_BYTES:
            yield from flush()
            held.clear()
            rows = size = 0
    yield from flush()


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for bucket in _solved(batches):
        out = []
        for c, _, cost, audit in bucket:
            out.append((c.conv_id, c.gaps, *(c.faults.count(f) for f in ("blank", "duplicate", "truncated")), c.illegal, cost, audit.decode(), text_hash(c.rows, audit)))
        kinds = [pa.int64()] * 7 + [pa.string()] * 2
        names = [x.split()[0] for x in FACTS.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds, names = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()], [x.split()[0] for x in EDITS.split(", ")]
    for bucket in _solved(batches):
        for c, turns, _, audit in bucket:
            out = [(c.conv_id, place, e, None if i < 0 else turns[i], role, text) for place, (e, role, text, i) in enumerate(edited(c.rows, audit))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def damaged(conversations: DataFrame) -> DataFrame:
    """The stated damage, by crc32(`conv_id:turn`) modulo 20: 0 drops a row, 1 empties its text, 2 takes its `.!?`, 3 repeats it, 4 makes it a user's.

    conv_id, turn, role, text, present (false for dropped rows).
    """
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat_ws(":", told("conv_id"), told("turn"))) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), told("role").alias("role"), told("text").alias("text"), h.alias("h"))
    h = F.col("h")
    text = F.when(h.isin(0, 1), "").when(h == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(h == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (h != 0).alias("present"), F.explode(F.when(h == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def in_order(rows: DataFrame) -> DataFrame:
    """Rows dealt by conversation, in order."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", F.sha2("text", 256)).select("conv_id", "turn", "role", "text", "present")


def by_length(conversations: DataFrame, long_rows: int, segment: int) -> tuple[DataFrame, LongRepair | None]:
    """The rows of conversations that a task can hold, and the repair of the others, if there are any.

    Rows are counted for each conversation first. There are at most 1 / long_rows as many long ones as rows.
    """
    rows = conversations.select(*(F.col(c).cast("long").alias(c) for c in ("conv_id", "turn")), *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")), "present")
    sizes = rows.groupBy("conv_id").agg(F.count_if("present").alias("n"), F.sum(F.length("text")).alias("chars"))
    long, _ = stage(sizes.filter((F.col("n") > long_rows) | (F.col("chars") > LONG_CHARS)).select(F.col("conv_id").alias("long_id"), "n"), "long-conversations")
    n, total = long.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).collect()[0]
    if not n:
        return rows, None
    few = F.broadcast(long) if n <= BROADCAST_ROWS else long
    same = F.col("conv_id").eqNullSafe(F.col("long_id"))
    return rows.join(few, same, "left_anti"), LongRepair(rows.filter("present").join(few, same, "left_semi").drop("present"), total, segment)


def repair_facts(conversations: DataFrame, long_rows: int = LONG_ROWS, segment: int = SEGMENT) -> DataFrame:
    """gaps, faults, illegal neighbours, cost, audit and the repaired text's hash of every conversation of (conv_id, turn, role, text, present)."""
    short, long = by_length(conversations, long_rows, segment)
    out = in_order(short).mapInArrow(lean(_facts), FACTS)
    return out if long is None else out.unionByName(long.facts())


def repair_edits(conversations: DataFrame, long_rows: int = LONG_ROWS, segment: int = SEGMENT) -> DataFrame:
    """The edits of every conversation: place (they are in its order), edit (K, R, D or I), turn (none for an inserted one), role, text.

    Without D they are the repaired conversation. In a long conversation places are ordered but not gapless.
    """
    short, long = by_length(conversations, long_rows, segment)
    out = in_order(short).mapInArrow(lean(_edits), EDITS)
    if long is None:
        return out
    return out.unionByName(long.edits().withColumn("place", F.col("seg") * PLACES + F.col("nth")).select(*out.columns))


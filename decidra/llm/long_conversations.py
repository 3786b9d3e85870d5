"""Repairs of conversations that are too long for one task, in segments of at most SEGMENT rows.

Rows are put in order by ranges and cut in segments, of which each has a table of the cheapest costs from each state to each state. The
tables are read from a conversation's last segment to its first, as a stream, which gives the costs behind each segment;
each segment is solved and traced from all four states; and a second stream, from the first segment on, follows the states. No task
holds more than a few segments, whatever a conversation's length. Its audit and the hash of its text are single values,
so the audit is joined and the text is hashed, line by line, in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decidra.llm import _repair_costs as kernel
from decidra.llm._common import drop, lean, stage, task_id

SEGMENT = 4_096
RANGE_ROWS = 500_000
FACTS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TOGETHER = 64  # segments of a length that are solved at once
Rows = Iterator[tuple]


def _arrow(per_task: Callable[[Rows], Rows], schema: str, rows: int = 10_000) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function from rows to rows, as one over Arrow batches."""
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "int": pa.int32()}
    fields = [pa.field(name, pa.list_(kinds[kind[6:-1]]) if kind.startswith("array<") else kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), fields, strict=True)], names=[f.name for f in fields])

        held = []
        for row in per_task(x for b in batches for x in zip(*(c.to_pylist() for c in b.columns), strict=True)):
            held.append(row)
            if len(held) >= rows:
                yield batch(held)
                held = []
        if held:
            yield batch(held)

    return lean(run)


def _unpacked(facts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, must, cut) tensors of segments of one length: two bits of code, then one each."""
    raw = np.frombuffer(b"".join(facts), np.uint8).reshape(len(facts), -1).T
    return (raw & 3).astype(np.int64), (raw & 4) > 0, (raw & 8) > 0


SEGMENTS = "conv_id long, seg long, facts binary, rids binary, costs array<long>, first string, last string, illegal long"


def _segments(rows: Rows, size: int) -> Rows:
    """From (conv_id, rid, initial, must, cut) in order: each segment's packed facts, its rows' ids and its table of costs."""
    number = task_id() << 24

    def made(conv_id: int | None, held: list[tuple]) -> tuple:
        packed = bytes(kernel.CODES.get(i, 0) | must << 2 | cut << 3 for _, i, must, cut in held)
        codes, must, cut = (np.repeat(x, 4, axis=1) for x in _unpacked([packed]))
        ends = np.where(np.eye(4, dtype=bool), 0, kernel.FAR)
        table = kernel.backward_costs(codes, must, cut, ends)[0]  # (end, state)
        initials = [h[1] for h in held]
        illegal = sum(a + b not in kernel.LEGAL for a, b in zip(initials, initials[1:], strict=False))
        return conv_id, number, packed, np.array([h[0] for h in held], "<i8").tobytes(), table.T.ravel().tolist(), initials[0], initials[-1], illegal

    name, held = None, []
    for conv_id, *row in rows:
        if held and (conv_id != name or len(held) == size):
            yield made(name, held)
            number, held = number + 1, []
        name = conv_id
        held.append(tuple(row))
    if held:
        yield made(name, held)


def _behind(rows: Rows) -> Rows:
    """From (conv_id, seg, costs), last segments first: the costs behind each segment, and the cost before it from nothing written."""
    name, costs, begun = None, None, False
    for conv_id, seg, table in rows:
        if not begun or conv_id != name:
            name, begun, costs = conv_id, True, kernel.DONE
        behind = costs
        costs = np.minimum((np.array(table).reshape(4, 4) + behind).min(axis=1), kernel.FAR)
        yield conv_id, seg, behind.tolist(), int(costs[kernel.STARTED])


def _traced(rows: Rows) -> Rows:
    """From (conv_id, seg, facts, behind): the state after a segment, and its edits, from each of the four states."""
    held: dict[int, list[tuple]] = {}

    def solved(bucket: list[tuple]) -> Rows:
        codes, must, cut = _unpacked([b[2] for b in bucket])
        behind = np.array([b[3] for b in bucket])
        costs = kernel.backward_costs(codes, must, cut, behind)
        found = []
        for state in range(4):
            lost = costs[0, :, state] >= kernel.FAR
            audits, ends = kernel.trace(costs[:, ~lost], codes[:, ~lost], must[:, ~lost], cut[:, ~lost], behind[~lost], np.full(int((~lost).sum()), state))
            each = iter(zip(audits, ends.tolist(), strict=True))
            found.append([(b"", -1) if x else next(each) for x in lost])
        for i, b in enumerate(bucket):
            yield b[0], b[1], [found[s][i][0] for s in range(4)], [found[s][i][1] for s in range(4)]

    for row in rows:
        bucket = held.setdefault(len(row[2]), [])
        bucket.append(row)
        if len(bucket) == TOGETHER:
            yield from solved(held.pop(len(row[2])))
        elif sum(map(len, held.values())) > 8 * TOGETHER:
            yield from (x for b in held.values() for x in solved(b))
            held.clear()
    yield from (x for b in held.values() for x in solved(b))


def _followed(rows: Rows) -> Rows:
    """From (conv_id, seg, audits, ends, first, last, illegal), first segments first: the state before each, its edits, illegal neighbours."""
    name, state, before, begun = None, kernel.STARTED, "", False
    for conv_id, seg, audits, ends, first, last, illegal in rows:
        joined = begun and conv_id == name
        if not joined:
            name, begun, state = conv_id, True, kernel.STARTED
        yield conv_id, seg, state, audits[state], illegal + (joined and before + first not in kernel.LEGAL)
        state, before = ends[state], last


LINES = "conv_id long, seg long, nth long, edit string, rid long, role string"


def _lines(rows: Rows) -> Rows:
    """From (conv_id, seg, state, audit, rids, facts): every edit, the row it takes (none for an inserted one), a forced role."""
    for conv_id, seg, state, audit, rids, facts in rows:
        rids, nxt = np.frombuffer(rids, "<i8").tolist(), 0
        for nth, e in enumerate(audit.decode()):
            role = None
            if e in "IR":
                state = int(kernel.FORCED[state])
                role = ("", "", "user", "assistant")[state]
            elif e == "K":
                state = facts[nxt] & 3
            yield conv_id, seg, nth, e, None if e == "I" else rids[nxt], role
            nxt += e != "I"


def _hashed(rows: Rows) -> Rows:
    """From (conv_id, role, text) in order: the hash of each conversation's lines, one line at a time."""
    name, digest, begun = None, None, False
    for conv_id, role, text in rows:
        if not begun or conv_id != name:
            if begun:
                yield name, digest.hexdigest()
            name, begun, digest = conv_id, True, hashlib.sha256()
        else:
            digest.update(b"\n")
        digest.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
    if begun:
        yield name, digest.hexdigest()


class LongRepair:
    """rows: (conv_id, turn, role, text), of long conversations only; `n` of them."""

    def __init__(self, rows: DataFrame, n: int, segment: int):
        spark = rows.sparkSession
        self.rows, _ = stage(rows.withColumn("rid", F.monotonically_increasing_id()).withColumn("digest", F.sha2("text", 256)), "long-rows")
        blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
        when = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "rid")
        firsts = self.rows.filter(~blank).groupBy("conv_id", "role", "digest").agg(F.min(when).alias("f")).select(F.col("f.rid").alias("rid"), F.lit(True).alias("new"))
        cut = ~blank & F.col("new").isNotNull() & ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
        light = self.rows.join(firsts, "rid", "left").select("conv_id", "turn", "role", "digest", "rid", F.substring("role", 1, 1).alias("initial"), blank.alias("blank"), F.col("new").isNull().alias("must"), cut.alias("cut"))
        self.light, light_at = stage(light, "long-facts")
        order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "digest", "rid"]
        parts = max(spark.sparkContext.defaultParallelism, -(-n // RANGE_ROWS))
        ordered = self.light.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("conv_id", "rid", "initial", "must", "cut")
        self.segments, _ = stage(ordered.mapInArrow(_arrow(partial(_segments, size=segment), SEGMENTS, 64), SEGMENTS), "long-segments")
        stream = lambda df, *order: df.repartition("conv_id").sortWithinPartitions("conv_id", *order)
        schema = "conv_id long, seg long, behind array<long>, cost long"
        self.costs, _ = stage(stream(self.segments.select("conv_id", "seg", "costs"), F.desc("seg")).mapInArrow(_arrow(_behind, schema), schema), "long-costs")
        schema = "conv_id long, seg long, audits array<binary>, ends array<long>"
        # a segment's number is its own among all conversations
        solved = self.segments.select("conv_id", "seg", "facts").join(self.costs.select("seg", "behind"), "seg").select("conv_id", "seg", "facts", "behind")
        traced, traced_at = stage(solved.mapInArrow(_arrow(_traced, schema, 64), schema), "long-traced")
        known = traced.join(self.segments.select("seg", "first", "last", "illegal"), "seg").select("conv_id", "seg", "audits", "ends", "first", "last", "illegal")
        schema = "conv_id long, seg long, state long, audit binary, illegal long"
        self.followed, _ = stage(stream(known, "seg").mapInArrow(_arrow(_followed, schema, 64), schema), "long-followed")
        drop(spark, traced_at)

    def edits(self) -> DataFrame:
        """conv_id, seg, nth, edit, turn, role, text of every edit."""
        each = self.followed.join(self.segments.select("seg", "rids", "facts"), "seg").select("conv_id", "seg", "state", "audit", "rids", "facts").mapInArrow(_arrow(_lines, LINES), LINES)
        texts = self.rows.select("rid", "turn", F.col("role").alias("own"), "text")
        return each.join(texts, "rid", "left").select("conv_id", "seg", "nth", "edit", "turn", F.coalesce("role", "own").alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def facts(self) -> DataFrame:
        lines = self.edits().filter("edit <> 'D'").repartition("conv_id").sortWithinPartitions("conv_id", "seg", "nth").select("conv_id", "role", "text")
        schema = "conv_id long, repaired_sha256 string"
        hashes = lines.mapInArrow(_arrow(_hashed, schema), schema)
        counted = self.light.groupBy("conv_id").agg(
            F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"),
            F.count_if("blank").alias("blank"), F.count_if(F.col("must") & ~F.col("blank")).alias("duplicate"), F.count_if("cut").alias("truncated"),
        )
        whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seg", F.decode("audit", "UTF-8").alias("audit")))), lambda x: x["audit"]), "")
        traced = self.followed.groupBy("conv_id").agg(F.sum("illegal").alias("illegal"), whole.alias("audit"))
        cost = self.costs.groupBy("conv_id").agg(F.min_by("cost", "seg").alias("cost"))
        out, named = counted, F.col("conv_id")
        for part in (traced, cost, hashes):  # one conversation may have a null id
            part = part.withColumnRenamed("conv_id", "other_id")
            out = out.join(part, named.eqNullSafe(F.col("other_id")), "left").drop("other_id")
        return out.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest()))).select(*(x.split()[0] for x in FACTS.split(", ")))

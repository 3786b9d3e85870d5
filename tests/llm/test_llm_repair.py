"""Conversation repairs against a search over all strings of edits."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from decidra.llm import conversation_repair as cr
from decidra.llm._common import ship

SCHEMA = "conv_id long, turn long, role string, text string, present boolean, n long, digest string, rid int, seg int, h int, copy int"


def cheapest(rows):
    """(cost, audit, repaired lines) by a search in the order of cost and string."""
    seen, faults = set(), []
    for row in rows:
        solid = row[1].strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not solid else "duplicate" if row in seen else "" if solid[-1] in ".!?" else "truncated")
        seen.add(row)
    heap = [(0, "", 0, "", ())]
    while True:
        cost, audit, at, said, lines = heapq.heappop(heap)
        if at == len(rows) and re.fullmatch(r"(s?(ua)+)?", said):
            return cost, audit, lines, faults
        if not re.fullmatch(r"s?(ua)*u?", said):
            continue
        if at < len(rows):
            (role, text), f = rows[at], faults[at]
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, said, lines))
            if f not in ("blank", "duplicate"):
                short = f == "truncated"
                if role[:1]:
                    heapq.heappush(heap, (cost + short, audit + "K", at + 1, said + role[:1], (*lines, f"{role}:{text}")))
                for r in ("user", "assistant"):
                    heapq.heappush(heap, (cost + short + 2, audit + "R", at + 1, said + r[0], (*lines, f"{r}:{text}")))
        for r in ("user", "assistant"):
            if len(said) < 2 * len(rows) + 3:
                heapq.heappush(heap, (cost + 2, audit + "I", at, said + r[0], (*lines, f"{r}:")))


def expected(table):
    """The contract by its words, over (conv_id, turn, role, text) without damage."""
    out = {}
    for conv in {r[0] for r in table}:
        rows = [(t, r if r is not None else " ", x if x is not None else " ") for c, t, r, x in table if c == conv]
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        cost, audit, lines, faults = cheapest([r[1:] for r in rows])
        turns = {r[0] for r in rows} - {None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def some_rows(seed, convs, most, first=0):
    rng = random.Random(seed)
    roles, texts = ["user", "assistant"] * 4 + ["system", "tool", "", None, "usher"], ["Hi.", "ok", "", None, "Yes!", "no  ", "x?\n", "\x0b", "ö…", "Ä."]
    out = []
    for c in range(first, first + convs):
        for t in range(rng.randint(1, most)):
            out.append((c, rng.choice([t, t, t, t // 2, None, 2 * t]), rng.choice(roles), rng.choice([*texts, f"text {t}."])))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, True, 1, "d", 2, 3, 4, 5) for r in rows], SCHEMA)


def result(df):
    return {r.conv_id: tuple(r[1:]) for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


@pytest.fixture(scope="module")
def rows(spark):
    ship(spark)
    return some_rows(1, 150, 6) + [(None, 0, "user", "Who?"), (None, 1, "assistant", "Me."), (1000, 0, "user", "y" * 300_000 + "."), (1000, 1, "assistant", "z."), (1001, 3, "user", "Again."), (1001, 3, "user", "Again.")]


def test_repairs(spark, rows):
    """Nulls, empty and long texts, ties, repeated rows, other roles, a null id, clashing columns."""
    got = result(cr.repair_facts(frame(spark, rows)))
    assert got == expected(rows)
    assert {e for v in got.values() for e in v[6]} == set("DIKR")


@pytest.mark.parametrize("segment", [1, 3, 64])
def test_long_conversations_go_in_segments(spark, rows, segment):
    """Every conversation of more than two rows by segments: the same results, and the same edits."""
    df = frame(spark, rows)
    assert result(cr.repair_facts(df, long_rows=2, segment=segment)) == expected(rows)
    if segment == 3:
        lines = lambda d: [tuple(r) for r in d.orderBy("conv_id", "place").select("conv_id", "edit", "role", "text").collect()]
        assert lines(cr.repair_edits(df, long_rows=2, segment=segment)) == lines(cr.repair_edits(df))


def test_edits_are_the_repaired_conversation(spark, rows):
    want = expected(rows)
    said = {}
    for r in cr.repair_edits(frame(spark, rows)).filter("edit <> 'D'").orderBy("conv_id", "place").collect():
        said.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for conv, facts in want.items():
        assert hashlib.sha256("\n".join(said.get(conv, [])).encode()).hexdigest() == facts[-1]


def test_one_long_conversation(spark):
    """Many segments of the default size, half of the rows equal."""
    rows = [(7, t, "user" if t % 3 else "assistant", "Same." if t % 2 else f"Row {t}.") for t in range(9_000)]
    (a,) = result(cr.repair_facts(frame(spark, rows), long_rows=1_000)).values()
    (b,) = result(cr.repair_facts(frame(spark, rows))).values()
    assert a == b and a[2] == 4_498  # "Same." of two roles stays once each


def test_damage(spark):
    rows = [(c, t, "assistant" if (t or 0) % 2 else None, None if t == 3 else f"A! B? {c}.") for c in (None, *range(60)) for t in (None, *range(6))]
    got = {}
    for r in cr.damaged(frame(spark, rows)).collect():
        got.setdefault((r.conv_id, r.turn), []).append((r.role, r.text, r.present))
    show = lambda x: " " if x is None else str(x)
    for c, t, role, text in rows:
        role, text = show(role), show(text)
        h = zlib.crc32(f"{show(c)}:{show(t)}".encode()) % 20
        want = {0: [(role, "", False)], 1: [(role, "", True)], 2: [(role, re.sub("[.!?]", "", text), True)], 3: [(role, text, True)] * 2, 4: [("user", text, True)]}.get(h, [(role, text, True)])
        assert got[c, t] == want


def test_nothing_left_and_empty(spark, rows):
    gone = frame(spark, rows[:5]).withColumn("present", F.lit(False))
    assert set(result(cr.repair_facts(gone)).values()) == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}
    assert cr.repair_facts(frame(spark, rows).limit(0)).count() == 0

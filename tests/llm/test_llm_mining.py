"""Hard negatives against a plain search over all rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from decidra.llm import _common
from decidra.llm import hard_negatives as hn
from decidra.llm._common import ship

SCHEMA = "vec_id long, embedding array<double>, label int, g long, slice int, positive int, dim int, positives string, anchor_id long"


def brute(rows, is_anchor, k=5, m=5, num=80, den=100):
    """The contract by its words, over (vec_id, embedding, label)."""
    held = {}
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            held[i] = min(held.get(i, (label, v)), (label, v))
    whole = {i: (label, [math.floor(256 * x) for x in v]) for i, (label, v) in held.items()}
    out = []
    for a in filter(is_anchor, whole):
        label, v = whole[a]
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, other) for i, (other, w) in whole.items() if i != a and len(w) == len(v))
        for p, pid, _ in [s for s in scored if s[2] == label][:k]:
            fine = [(s, i) for s, i, other in scored if other != label and num * -p <= den * -s <= den * -p]
            out += [(a, pid, rank, i, -p, -s) for rank, (s, i) in enumerate(fine[:m], 1)]
    return sorted(out)


def frame(spark, rows, parts=7):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, "x", 5) for r in rows], SCHEMA).repartition(parts)


def result(df):
    return sorted(map(tuple, df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


@pytest.fixture(scope="module")
def rows(spark):
    ship(spark)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(4, 6))
    out = [(i, (centres[i % 4] + 0.3 * rng.normal(size=6)).round(1).tolist(), int(rng.integers(0, 3))) for i in range(240)]  # coarse, so scores tie
    out += [(900, None, 1), (910, [0.5] * 6, None), (920, [0.5, None] * 3, 1), (930, [math.nan] + [0.5] * 5, 1), (940, [math.inf] + [0.5] * 5, 1), (None, [0.5] * 6, 1)]
    out += [(20, out[20][1], out[20][2]), (30, [9.0] * 6, out[30][2]), (950, [1.0, 2.0], 1), (951, [2.0, 2.0], 1), (952, [2.0, 1.9], 2), (960, [], 1), (961, [], 1), (962, [], 0)]
    return out


@pytest.mark.parametrize("few", [True, False])
def test_hard_negatives(spark, rows, monkeypatch, few):
    """Ties, repeated and contradictory ids, nulls, other lengths, clashing columns; with blocks of anchors broadcast and shuffled."""
    if not few:
        monkeypatch.setattr(_common, "BLOCKS_BYTES", 0)
        monkeypatch.setattr(_common, "SLICE_ROWS", 16)
    want = brute(rows, lambda i: i % 10 == 0)
    assert any(a == 950 for a, *_ in want) and any(a == 960 for a, *_ in want) and len(want) > 200
    assert result(hn.hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0)) == want


def test_limits_and_labels(spark, rows):
    """Other numbers of positives and negatives, another share, a changed label, one partition."""
    changed = [(i, v, None if y is None else (y + 1) % 3 if i is not None and i % 7 == 0 else y) for i, v, y in rows]
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 3).otherwise(F.col("label"))
    got = hn.hard_negatives(frame(spark, rows, 1), F.col("vec_id") % 20 == 0, label, positives=2, negatives=3, num=95)
    assert result(got) == brute(changed, lambda i: i % 20 == 0, 2, 3, 95)


def test_no_rows(spark, rows):
    df = frame(spark, rows)
    assert hn.hard_negatives(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert hn.hard_negatives(df, F.col("vec_id") < 0).count() == 0
    assert hn.hard_negatives(df.withColumn("label", F.col("vec_id").cast("int")), F.col("vec_id") % 10 == 0).count() == 0  # no positives


def test_large_components_are_exact():
    a, b = np.array([[2.0**40, 3.0]]), np.array([[2.0**19, 5.0], [1.0, -7.0]])
    assert hn.integer_scores(a, b).tolist() == [[2**59 + 15, 2**40 - 21]]
    big = np.array([[2.0**60, 2.0**60]])
    assert hn.integer_scores(big, np.array([[1.0, -1.0]])).tolist() == [[0]]
    with pytest.raises(OverflowError):
        hn.integer_scores(big, big)


@pytest.mark.parametrize("score", [-1001, -1000, -1, 0, 1, 99, 100, 101, 2**61 + 7])
def test_lower_limit(score):
    assert int(hn.lower_limit(np.array([score]), 80, 100)[0]) == -((-80 * score) // 100)

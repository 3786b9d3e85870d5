"""Hard negatives for stated anchors: each anchor's scores against all rows, sorted in full, and read between two limits.

Every component x of a vector becomes floor(256 * x), so a score is an integer and has no rounding. Rows are packed into blocks of
at most BLOCK_BYTES, anchors too, and each block of anchors meets each block of rows once in a pass:

1. A block's scores are sorted by score and id for every anchor, and the first rows of the anchor's own label are kept. The
   best of all blocks are the anchor's positives.
2. The same scores are sorted again. A binary search finds where scores no longer exceed a positive's, another one where they
   fall below its lower limit; the first rows of other labels in between are kept, and the best of all blocks are returned.

A row that isn't among a block's first few is not among the first few of all rows, so the result is exact. A task keeps one block of
anchors with its best so far, whatever the number of rows. Blocks are dealt by a hash of their ids in slices; labels deal
nothing, so a label with a third of all rows is no single task. Few blocks of anchors, counted first, are broadcast; more are
joined by shuffling, once for each slice.

Defined results: rows with a null id, label or vector, or a null or non-finite component, take no part; vectors meet those of the
same length only (empty ones score 0); of rows that repeat an id, the one with the smallest label, then the smallest vector,
takes part, so a row is never its own positive; a label that no other row has, and an empty table, give no rows; scores
are exact up to 2**62 and beyond that an error; columns other than the three named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from decidra.llm._common import drop, lean, meet_blocks, stage

BLOCK_BYTES = 1 << 20
ANCHOR_ROWS = 4_096  # of a task that packs anchors, about: blocks of rows go out once for each block of anchors
ANCHORS_AT_ONCE = 128
SCALE = 256
NONE = -(1 << 62)  # the score of no row
NO_ID = np.iinfo(np.int64).max


def integer_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The inner products of integer-valued rows, exactly; an OverflowError where one is beyond 2**62."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1]  # of whole numbers; an infinite one is an error
    if most < 1 << 53:  # every partial sum is exact in double precision
        return (a @ b.T).astype(np.int64)
    if most < 1 << 62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = np.vectorize(int, otypes=[object])
    scores = whole(a) @ whole(b).T
    if max(abs(x) for x in scores.flat) >= 1 << 62:
        raise OverflowError("a score is beyond 2**62")
    return scores.astype(np.int64)


def sorted_scores(scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each anchor the order of its rows: higher scores first, smaller ids first among equal ones."""
    return np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=-1)


def first_positives(scores: np.ndarray, ids: np.ndarray, labels: np.ndarray, own_ids: np.ndarray, own_labels: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) of each anchor's first k other rows of its label; NONE where there are fewer."""
    order = sorted_scores(scores, ids)
    same = (labels[order] == own_labels[:, None]) & (ids[order] != own_ids[:, None])
    nth = np.cumsum(same, axis=1)
    row, place = np.nonzero(same & (nth <= k))
    found = np.full((len(scores), k), NONE), np.full((len(scores), k), NO_ID)
    which = order[row, place]
    found[0][row, nth[row, place] - 1] = scores[row, which]
    found[1][row, nth[row, place] - 1] = ids[which]
    return found


def lower_limit(score: np.ndarray, num: int, den: int) -> np.ndarray:
    """The least whole number n with num * score <= den * n."""
    whole, rest = np.divmod(score, den)
    return num * whole - (-num * rest // den)


def first_negatives(scores: np.ndarray, ids: np.ndarray, labels: np.ndarray, own_labels: np.ndarray, positives: np.ndarray, k: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids), both (anchors, positives, k), of the first rows of other labels from each positive's score down to its lower limit."""
    order, limits = sorted_scores(scores, ids), lower_limit(positives, num, den)
    found = np.full((*positives.shape, k), NONE), np.full((*positives.shape, k), NO_ID)
    for i, mine in enumerate(order):
        others = mine[labels[mine] != own_labels[i]]
        falling = -scores[i, others]
        first, end = np.searchsorted(falling, -positives[i], "left"), np.searchsorted(falling, -limits[i], "right")
        at = first[:, None] + np.arange(k)
        held = (at < end[:, None]) & (positives[i] > NONE)[:, None]
        which = others[at[held]]
        found[0][i][held], found[1][i][held] = scores[i, which], ids[which]
    return found


def best_of(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The first of both, along the last axis, as many as each has."""
    scores, ids = (np.concatenate([x, y], axis=-1) for x, y in zip(one, two, strict=True))
    order = np.lexsort((ids, -scores), axis=-1)[..., : one[0].shape[-1]]
    return np.take_along_axis(scores, order, -1), np.take_along_axis(ids, order, -1)


BLOCK = "dim int, ids binary, labels binary, vectors binary, positives binary"


def packed(rows: DataFrame, k: int) -> DataFrame:
    """(vec_id, label, embedding, positives: array of (score, id)) as blocks of vectors of one length."""

    def block(dim: int, held: list[tuple]) -> pa.RecordBatch:
        ids, labels, vectors, positives = zip(*held, strict=True)
        best = np.full((len(held), 2, k), NONE, "<i8")
        for i, found in enumerate(positives):
            for j, p in enumerate(found or ()):
                best[i, :, j] = p["score"], p["id"]
        values = [np.array(x, kind).tobytes() for x, kind in ((ids, "<i8"), (labels, "<i8"), (vectors, "<f8"))]
        return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *(pa.array([v], pa.binary()) for v in [*values, best.tobytes()])], names=["dim", "ids", "labels", "vectors", "positives"])

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        waiting = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                dim = len(row[2])
                mine = held.setdefault(dim, [])
                mine.append((*row[:2], np.floor(SCALE * np.array(row[2], np.float64)), row[3]))
                waiting += 8 * dim + 64
                if (8 * dim + 64) * len(mine) >= BLOCK_BYTES:
                    waiting -= (8 * dim + 64) * len(mine)
                    yield block(dim, held.pop(dim))
            if waiting > 8 * BLOCK_BYTES:  # vectors of many lengths
                yield from (block(d, x) for d, x in held.items())
                held, waiting = {}, 0
        yield from (block(d, x) for d, x in held.items())

    return rows.select("vec_id", "label", "embedding", "positives").mapInArrow(lean(per_task), BLOCK)


def unpacked(dim: int, ids: bytes, labels: bytes, vectors: bytes, positives: bytes, k: int) -> tuple[np.ndarray, ...]:
    n = len(ids) // 8
    return np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8"), np.frombuffer(vectors, "<f8").reshape(n, dim), np.frombuffer(positives, "<i8").reshape(n, 2, k)


class Limits:
    """How many positives and negatives, and the share num / den of a positive's score that a negative has at least."""

    def __init__(self, positives: int, negatives: int, num: int, den: int):
        self.positives, self.negatives, self.num, self.den = positives, negatives, num, den


def compared(anchors: DataFrame, rows: DataFrame, limits: Limits, mine: bool) -> DataFrame:
    """Each task's best for its anchors: positives if `mine`, else negatives. anchors and rows: staged blocks.

    anchor_id, positive (its number, 0 if `mine`), score, id.
    """
    k, out = limits.positives, ["anchor_id", "positive", "score", "id"]

    def flat(ids: np.ndarray, best: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        scores, found = (x.reshape(len(ids), -1, x.shape[-1]) for x in best)
        anchor, positive, place = np.nonzero(scores > NONE)
        columns = [ids[anchor], positive.astype(np.int32), scores[anchor, positive, place], found[anchor, positive, place]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=out)

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, own_ids, best = None, None, None
        for batch in batches:
            for g, dim, *raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != group:
                    if best is not None:
                        yield flat(own_ids, best)
                    group, best = g, None
                    own_ids, own_labels, own, positives = unpacked(dim, *raw[4:], k)
                ids, labels, vectors, _ = unpacked(dim, *raw[:4], k)
                parts = []
                for a in range(0, len(own), ANCHORS_AT_ONCE):
                    part = slice(a, a + ANCHORS_AT_ONCE)
                    scores = integer_scores(own[part], vectors)
                    if mine:
                        parts.append(first_positives(scores, ids, labels, own_ids[part], own_labels[part], k))
                    else:
                        parts.append(first_negatives(scores, ids, labels, own_labels[part], positives[part, 0], limits.negatives, limits.num, limits.den))
                found = tuple(np.concatenate(x) for x in zip(*parts, strict=True))
                best = found if best is None else best_of(best, found)
        if best is not None:
            yield flat(own_ids, best)

    named = anchors.select("dim", F.monotonically_increasing_id().alias("g"), *(F.col(c).alias(f"own_{c}") for c in ("ids", "labels", "vectors", "positives")))
    numbered, numbered_at = stage(named, "anchor-blocks")
    total = rows.agg(F.coalesce(F.sum(F.length("ids")), F.lit(0))).collect()[0][0] // 8
    met = meet_blocks(rows, numbered, "dim", "ids", total)
    wanted = met.select("g", "dim", "ids", "labels", "vectors", "positives", *(f"own_{c}" for c in ("ids", "labels", "vectors", "positives")))
    found, _ = stage(wanted.mapInArrow(lean(per_task), "anchor_id long, positive int, score long, id long"), "hard-found")
    drop(rows.sparkSession, numbered_at)
    order = Window.partitionBy("anchor_id", "positive").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= (k if mine else limits.negatives))


def taking_part(embeddings: DataFrame, label: Column, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, label, embedding of the valid rows, one for each id."""
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vector_col).alias("embedding"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    valid = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(fine, F.lit(False)))
    repeated, _ = stage(valid.groupBy("vec_id").agg(F.count("*").alias("n")).filter("n > 1").select("vec_id"), "repeated-ids")
    if repeated.isEmpty():
        return valid
    one = valid.join(repeated, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("row")).select("vec_id", "row.label", "row.embedding")
    return valid.join(repeated, "vec_id", "left_anti").unionByName(one)


def hard_negatives(
    embeddings: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = 5, negatives: int = 5, num: int = 80, den: int = 100, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    is_anchor: a condition on vec_id; label: the labels' column (`label` if not given).
    """
    spark, limits = embeddings.sparkSession, Limits(positives, negatives, num, den)
    unknown = F.lit(None).cast("array<struct<score:long,id:long>>").alias("positives")
    valid = taking_part(embeddings, F.col("label") if label is None else label, id_col, vector_col)
    rows, rows_at = stage(packed(valid.select("*", unknown), positives), "hard-rows")
    chosen, chosen_at = stage(valid.filter(is_anchor), "hard-anchors")
    few = 1 + chosen.count() // ANCHOR_ROWS
    asked, asked_at = stage(packed(chosen.select("*", unknown).coalesce(few), positives), "asked")
    own, _ = stage(compared(asked, rows, limits, mine=True).select("anchor_id", (F.col("rank") - 1).alias("positive"), F.col("score").alias("positive_score"), F.col("id").alias("positive_id")), "hard-positives")
    best = own.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_list(F.struct("positive", F.col("positive_score").alias("score"), F.col("positive_id").alias("id")))).alias("all"))
    told = chosen.join(best, "vec_id").withColumn("positives", F.transform("all", lambda p: F.struct(p["score"].alias("score"), p["id"].alias("id"))))
    limited, limited_at = stage(packed(told.coalesce(few), positives), "limited")
    found = compared(limited, rows, limits, mine=False).select("anchor_id", "positive", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    drop(spark, rows_at, chosen_at, asked_at, limited_at)
    return found.join(own, ["anchor_id", "positive"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

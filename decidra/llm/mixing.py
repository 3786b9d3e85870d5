"""Temperature mixing of sources, in DataFrame and SQL functions only.

A source's weight is its share of all tokens to the power alpha, normalised. Alpha is bisected in [0, 1] inside one SQL
expression: to the flattest mix whose entropy does not exceed a target, or whose most repeated source is not repeated
more than a limit; with both, the larger alpha holds. Weights become budgets in tokens. Without a given budget, the
source that is turned down most gets exactly one pass, so no document is lost; all others are repeated.

Documents are dealt to a fixed number of hash blocks per source. Each pass over a source is a seeded permutation of its
blocks; whole passes come first, the last takes blocks in its order while the budget lasts. Only (source, block) sums
go through windows, so a source with a third of all rows is as many rows there as any other.

Defined results: a document's tokens are its words and one end mark, so a null or empty text is one token; a null source
is a source of its own; repeated rows are mixed as often as they come; ties in the permutation go to the smaller block;
an empty table gives no rows; other columns are ignored by mix_schedule and kept by mix_documents, whatever their names. With an
entropy target alone, a source of a few tokens is repeated until it fills its share, however many copies that takes; a
repetition limit bounds them.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from decidra.llm._common import drop, free_name, stage

BLOCKS = 1024
WORD = r"[^\x20\x09-\x0D]+"
BROADCAST_ROWS = 200_000
ARRAY_SOURCES = 100_000
GRID, PASSES = 32, 9  # exponents of a pass, and passes: the bounds end 32**-9 apart


def _hash32(*parts: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(p.cast("string") for p in parts)).cast("binary")), 1, 8), 16, 10).cast("long")


def block_of(id_col: Column, seed: int, blocks: int) -> Column:
    return (_hash32(F.lit(seed), F.coalesce(id_col.cast("string"), F.lit("null"))) % blocks).cast("int")


def _bisected(holds: str) -> str:
    """SQL for the smallest alpha in [0, 1] at which `holds` (in which {a} is alpha, and ls the log shares) is true."""
    mid = "(s.lo + s.hi) / 2D"
    return (
        f"aggregate(sequence(1, 60), named_struct('lo', 0D, 'hi', 1D), (s, i) -> if({holds.format(a=mid)},"
        f" named_struct('lo', s.lo, 'hi', {mid}), named_struct('lo', {mid}, 'hi', s.hi)), s -> s.hi)"
    )


#: With z the normaliser, the entropy is ln z - (sum of e^(a l) a l) / z.
_ENTROPY = (
    "ln(aggregate(ls, 0D, (t, l) -> t + exp({a} * l)))"
    " - aggregate(ls, 0D, (t, l) -> t + exp({a} * l) * {a} * l) / aggregate(ls, 0D, (t, l) -> t + exp({a} * l))"
)
_REPEAT = "array_max(transform(ls, l -> exp(({a} - 1D) * (l - array_max(ls)))))"


def fit_exponent(totals: DataFrame, target_entropy: float | None = None, max_repeat: float | None = None) -> float:
    """alpha for (source, total) rows; one number comes back.

    Up to ARRAY_SOURCES sources, counted, their log shares are one array, bisected in one expression. More are bisected over the
    rows: each pass sums at GRID exponents between the bounds, and the next is between two of them.
    """
    if target_entropy is None and max_repeat is None:
        return 1.0
    if totals.count() > ARRAY_SOURCES:
        return _fit_over_rows(totals, target_entropy, max_repeat)
    wanted = []
    if target_entropy is not None:
        wanted.append(_bisected(f"{_ENTROPY} <= {float(target_entropy)!r}D"))
    if max_repeat is not None:
        wanted.append(_bisected(f"{_REPEAT} <= {float(max_repeat)!r}D"))
    shares = totals.agg(F.sort_array(F.collect_list("total")).alias("ts")).select(F.expr("transform(ts, t -> ln(cast(t AS DOUBLE)) - ln(cast(aggregate(ts, 0L, (a, t) -> a + t) AS DOUBLE)))").alias("ls"))
    found = shares.filter(F.size("ls") > 0).select(F.round(F.array_max(F.expr(f"array({', '.join(wanted)})")), 12).alias("alpha")).collect()
    return found[0].alpha if found else 1.0


def _fit_over_rows(totals: DataFrame, target_entropy: float | None, max_repeat: float | None) -> float:
    whole = totals.agg(F.sum("total").alias("n"), F.max("total").alias("most"), F.min("total").alias("least")).collect()[0]
    share = F.ln(F.col("total").cast("double")) - F.lit(math.log(whole.n))

    def smallest(holds: Callable[[list[float]], list[bool]]) -> float:
        lo, hi = 0.0, 1.0
        for _ in range(PASSES):
            at = [lo + (hi - lo) * (i + 1) / GRID for i in range(GRID)]
            first = next((i for i, fine in enumerate(holds(at)) if fine), GRID - 1)
            lo, hi = at[first - 1] if first else lo, at[first]
        return hi

    def entropies(at: list[float]) -> list[bool]:
        sums = totals.agg(*(F.sum(F.exp(share * a)).alias(f"z{i}") for i, a in enumerate(at)), *(F.sum(F.exp(share * a) * share * a).alias(f"h{i}") for i, a in enumerate(at))).collect()[0]
        return [math.log(sums[f"z{i}"]) - sums[f"h{i}"] / sums[f"z{i}"] <= target_entropy for i in range(GRID)]

    repeats = lambda at: [math.exp((a - 1) * (math.log(whole.least) - math.log(whole.most))) <= max_repeat for a in at]
    found = [smallest(f) for f, given in ((entropies, target_entropy), (repeats, max_repeat)) if given is not None]
    return round(max(found), 12)


def schedule(blocks: DataFrame, seed: int, target_entropy: float | None, max_repeat: float | None, budget: int | None) -> DataFrame:
    """source, block, copy, block_start and weight of each scheduled block, from (source, block, tokens) sums."""
    totals = blocks.groupBy("source").agg(F.sum("tokens").alias("total"))
    alpha = F.lit(fit_exponent(totals, target_entropy, max_repeat))
    whole = totals.agg(F.max("total").alias("most"), F.sum("total").alias("all_tokens")).collect()[0]
    most, everything = whole.most or 1, whole.all_tokens or 1
    raw = F.exp(alpha * F.ln(F.col("total") / F.lit(float(everything))))
    z = totals.agg(F.sum(raw).alias("z")).collect()[0].z or 1.0
    weight = raw / F.lit(z)
    if budget is None:
        repeats = F.exp((alpha - 1) * (F.ln(F.col("total").cast("double")) - F.lit(math.log(most))))
        tokens = F.floor(F.round(repeats, 9) * F.col("total"))
    else:
        tokens = F.floor(weight * F.lit(float(budget)))
    planned = totals.select("source", "total", F.round(weight, 9).alias("weight"), tokens.cast("long").alias("budget"))
    planned = planned.withColumn("passes", F.floor(F.col("budget") / F.col("total")).cast("int")).withColumn("rest", F.col("budget") - F.col("passes") * F.col("total"))
    each = blocks.join(planned.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    each = each.withColumn("copy", F.explode(F.expr("sequence(0, passes)")))
    key = _hash32(F.lit(seed), F.col("copy"), F.coalesce("source", F.lit("null")), F.col("block"))
    order = Window.partitionBy("source", "copy").orderBy("turn", "block").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("turn", key).withColumn("upto", F.sum("tokens").over(order))
    kept = each.filter((F.col("copy") < F.col("passes")) | (F.col("upto") <= F.col("rest")))
    return kept.select("source", "block", "copy", (F.col("copy") * F.col("total") + F.col("upto") - F.col("tokens")).alias("block_start"), "weight")


def _scheduled(rows: DataFrame, plan: DataFrame, source: str, block: str, renamed: dict[str, str]) -> DataFrame:
    """rows with the plan's rows for their source and block; renamed: the plan's columns, under names that rows don't have."""
    side = plan.select(*(F.col(c).alias(to) for c, to in renamed.items()))
    side = F.broadcast(side) if plan.count() <= BROADCAST_ROWS else side
    return rows.join(side, F.col(source).eqNullSafe(F.col(renamed["source"])) & (F.col(block) == F.col(renamed["block"])))


def mix_schedule(
    documents: DataFrame, target_entropy: float | None = None, max_repeat: float | None = 2.0, budget: int | None = None, seed: int = 17, blocks: int = BLOCKS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """One row for each document and copy: doc_id, source, copy, block, block_start (the source's tokens before that block), n_tokens, weight."""
    sized = documents.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("row_source"), (F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)) + 1).cast("long").alias("n_tokens"), block_of(F.col(id_col), seed, blocks).alias("row_block")
    )
    rows, _ = stage(sized, "mix-rows")
    sums, sums_at = stage(rows.groupBy(F.col("row_source").alias("source"), F.col("row_block").alias("block")).agg(F.sum("n_tokens").alias("tokens")), "mix-blocks")
    plan, _ = stage(schedule(sums, seed, target_entropy, max_repeat, budget), "mix-plan")
    drop(documents.sparkSession, sums_at)
    return _scheduled(rows, plan, "row_source", "row_block", {c: c for c in plan.columns}).select("doc_id", "source", "copy", "block", "block_start", "n_tokens", "weight")


def mix_documents(documents: DataFrame, target_entropy: float | None = None, max_repeat: float | None = 2.0, budget: int | None = None, seed: int = 17, blocks: int = BLOCKS) -> DataFrame:
    """The documents as often as they are scheduled, with their own columns, whatever their names."""
    block = block_of(F.col("doc_id"), seed, blocks)
    size = (F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)) + 1).cast("long")
    sums, sums_at = stage(documents.select("source", block.alias("block"), size.alias("tokens")).groupBy("source", "block").agg(F.sum("tokens").alias("tokens")), "mix-blocks")
    plan, _ = stage(schedule(sums, seed, target_entropy, max_repeat, budget).select("source", "block", "copy"), "mix-plan")
    drop(documents.sparkSession, sums_at)
    names = {c: free_name(f"mix_{c}", documents) for c in (*plan.columns, "row")}
    keyed = documents.withColumn(names["row"], block)
    return _scheduled(keyed, plan, "source", names["row"], {c: names[c] for c in plan.columns}).select(*(keyed[c] for c in documents.columns))

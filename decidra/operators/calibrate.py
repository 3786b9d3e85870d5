"""Temperature scaling: fit by grid, cross-fit over two folds, apply."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from decidra.functions import prob as P
from decidra.functions.text import calibration_kind
from decidra.sources.staging import staged

#: The grid of temperatures, 0.20 to 3.00 by 0.05, and the pairs that a kind needs.
GRID = tuple(round(0.20 + 0.05 * i, 2) for i in range(57))
LEAST_PAIRS = 20


def with_kind(answers: DataFrame) -> DataFrame:
    return answers.withColumn("kind", calibration_kind(F.col("qtype"), F.size("ref")))


def fit(answers: DataFrame, keys: list[str]) -> DataFrame:
    """keys, t: the lowest temperature of the grid with the least mean soft loss; kinds with too few pairs have none.

    answers: keys, ref, ps. Each row's losses are one array over the grid, averaged place by place map-side: rows aren't multiplied.
    """
    grid = F.array(*(F.lit(t) for t in GRID))
    each = answers.select(*keys, F.transform(grid, lambda t: P.soft_nll(F.col("ref"), P.rescale(F.col("ps"), t))).alias("losses"))
    # a loss is compared to 12 digits, so that the order of summing can't move the minimum
    means = F.array(*(F.struct(F.round(F.avg(F.element_at("losses", i + 1)), 12).alias("loss"), F.lit(t).alias("t")) for i, t in enumerate(GRID)))
    return each.groupBy(*keys).agg(F.count("*").alias("n"), F.array_min(means).alias("best")).filter(F.col("n") >= LEAST_PAIRS).select(*keys, F.col("best.t").alias("t"))


def crossfit(answers: DataFrame, keys: list[str]) -> DataFrame:
    """Each answer with the temperature fitted on the other fold (by parity of ord); t is 1 where none was fitted."""
    folded = answers.withColumn("fold", F.pmod(F.col("fold_ord"), F.lit(2)))
    fitted = fit(folded, [*keys, "fold"]).withColumn("fold", 1 - F.col("fold"))
    return folded.join(fitted, [*keys, "fold"], "left").withColumn("t", F.coalesce("t", F.lit(1.0)))


def apply(answers: DataFrame) -> DataFrame:
    return answers.withColumn("ps", P.rescale(F.col("ps"), F.col("t")))


def with_fold_ord(answers: DataFrame, item_order: str, keys: list[str]) -> DataFrame:
    """fold_ord: an item's position in its run, from 0.

    Items are counted by ranges of (keys, item), each a task's rows, and the counts before a range are added: no run is one window.
    """
    ranges = staged(answers.select(*keys, item_order).distinct().repartitionByRange(*keys, item_order).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = ranges.groupBy(*keys, "_part").agg(F.count("*").alias("_n")).select(*keys, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.col("_start") + F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(item_order)) - 1
    numbered = ranges.join(starts, [*keys, "_part"]).select(*keys, item_order, place.alias("fold_ord"))
    return answers.join(numbered, [*keys, item_order])

"""Building of datasets: selection, labels, items and their variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from decidra.functions import prob as P


def hash_rank(*parts: Column | str, seed: str) -> Column:
    """A seeded order that any engine can make again: the first 32 bits of an MD5."""
    text = F.concat_ws("|", F.lit(seed), *(p.cast("string") if isinstance(p, Column) else F.col(p).cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def stratified_select(rows: DataFrame, strata: list[str], key: str, n: int, seed: str) -> DataFrame:
    """n rows, one from each stratum per round, rows and strata in seeded order. Only n rows per stratum go on."""
    turn = F.row_number().over(Window.partitionBy(*strata).orderBy(hash_rank(key, seed=seed), key))
    ranked = rows.withColumn("_round", turn).filter(F.col("_round") <= n)
    return ranked.orderBy("_round", hash_rank(*strata, seed=seed), *strata, key).limit(n).drop("_round")


def holdout_tasks(rows: DataFrame, family: str, task: str, n: int, seed: str) -> DataFrame:
    """Adds holdout: whole tasks, n of each family."""
    tasks = rows.select(family, task).distinct()
    ranked = tasks.withColumn("_r", F.row_number().over(Window.partitionBy(family).orderBy(hash_rank(task, seed=seed), task)))
    held = ranked.filter(F.col("_r") <= n).select(family, task, F.lit(True).alias("holdout"))
    return rows.join(held, [family, task], "left").withColumn("holdout", F.coalesce("holdout", F.lit(False)))


def consensus(labels: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ps, n_sets, soft: the mean of all labellers' distributions; soft only if every one was."""
    each = labels.select(*keys, "soft", F.posexplode(P.normalize(F.col("ps"))).alias("_i", "_p"))
    mean = each.groupBy(*keys, "_i").agg(F.avg("_p").alias("_p"), F.count("*").alias("n_sets"), F.bool_and("soft").alias("soft"))
    return mean.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_p"))), lambda s: s["_p"]).alias("ps"), F.max("n_sets").alias("n_sets"), F.bool_and("soft").alias("soft"))


def attach_teacher(items: DataFrame, teacher: DataFrame, keys: list[str], fill: float | None = None, drop_disagreed: bool = False) -> DataFrame:
    """Items with the teacher's ps and an outcome: labeled, gold_filled, missing or disagreed; the last two are to drop.

    items: keys, k, label (1-based). teacher: keys, ps, error.
    """
    joined = items.join(teacher, keys, "left")
    missing = F.col("ps").isNull() | F.col("error").isNotNull()
    filled = P.gold_fill(F.col("k"), F.col("label"), fill) if fill is not None else F.lit(None).cast("array<double>")
    disagreed = ~missing & (P.argmax(F.col("ps")) != F.col("label")) & F.lit(drop_disagreed)
    outcome = F.when(missing, "gold_filled" if fill is not None else "missing").when(disagreed, "disagreed").otherwise("labeled")
    return joined.withColumns({"teacher": F.when(missing, filled).otherwise(F.col("ps")), "outcome": outcome}).drop("ps", "error")


def repeat_to(rows: DataFrame, n: int, key: str, seed: str) -> DataFrame:
    """n rows: the whole set as often as it fits, and a seeded sample of it for the remainder."""
    size = rows.count()
    if not size:
        return rows
    whole, rest = divmod(n, size)
    copies = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(whole)))).drop("_copy") if whole else rows.limit(0)
    return copies.unionByName(rows.orderBy(hash_rank(key, seed=seed), key).limit(rest))


def twins(rows: DataFrame, step: list[str]) -> DataFrame:
    """Rows of steps that have at least two variants."""
    many = rows.groupBy(*step).agg(F.count("*").alias("_n")).filter("_n >= 2").select(*step)
    return rows.join(many, step, "left_semi")


#: Roles of elements that only decorate a desktop.
DECORATIVE = ("scrollBar", "scrollArea", "group", "image")


def hoist_shared(instructions: DataFrame, item: str) -> DataFrame:
    """(item, field, value) that all of an item's questions have alike. instructions: item, qid, field, value."""
    whole = instructions.groupBy(item).agg(F.count_distinct("qid").alias("_q"))
    each = instructions.groupBy(item, "field").agg(F.count("*").alias("_n"), F.min("value").alias("value"), F.max("value").alias("_hi"))
    return each.join(whole, item).filter((F.col("_n") == F.col("_q")) & (F.col("value") == F.col("_hi")) & (F.col("_q") > 1)).select(item, "field", "value")


def facet_search(items: DataFrame, flags: dict[str, Column], equal: dict[str, object], by_price: bool, price: str, order: str) -> DataFrame:
    """Items that meet all active facets, by price or in their own order, with their place."""
    for needed in flags.values():
        items = items.filter(needed)
    for column, value in equal.items():
        items = items.filter(F.col(column) == value)
    return items.orderBy(*([price, order] if by_price else [order]))


def suggestions(values: DataFrame, column: str, typed: str, order: str, most: int = 6) -> DataFrame:
    if len(typed) < 2:
        return values.limit(0)
    return values.filter(F.contains(F.lower(column), F.lit(typed.lower()))).orderBy(order).limit(most)

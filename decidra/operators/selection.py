"""Exact order statistics of any number of values, with a few thousand counters for each group.

Values are counted in buckets of a histogram: first by a fixed scale of magnitudes (some 300 buckets for a factor of ten), then, inside the bucket that holds a wanted
place, by equal widths between its least and its greatest value, until that bucket has one value. A bucket is a
monotone function of the value, so the count of what lies below is exact; every pass sums counters map-side and shuffles
counters only. Two passes do for values of one magnitude, three for a billion of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from decidra.sources.staging import staged

BUCKETS = 4096
SCALE, FINE = 1024.0, 128  # below 1 / SCALE magnitudes run together; buckets of a factor of e
MOST_TARGETS = 500_000  # ranges that are broadcast


def nearest(q: float) -> Column:
    """The place, from 1, of the percentile by nearest rank among n values."""
    return F.greatest(F.ceil(F.lit(q) * F.col("n")), F.lit(1)).cast("long")


def floor_index(q: float) -> Column:
    """The place, from 1, of the element at floor(q * n) counted from 0."""
    return F.least(F.floor(F.lit(q) * F.col("n")) + 1, F.col("n")).cast("long")


def _magnitude(v: Column) -> Column:
    """A bucket by magnitude and sign, alike for all tables: it never falls as v rises."""
    steps = F.floor(F.log1p(F.least(F.abs(v), F.lit(1e300)) * SCALE) * FINE)
    steps = F.when(F.abs(v) == float("inf"), 750 * FINE).otherwise(steps)
    return F.when(F.isnan(v), 750 * FINE + 1).otherwise(F.when(v < 0, -steps).otherwise(steps)).cast("int")


def _place(v: Column, lo: Column, hi: Column) -> Column:
    """A bucket of equal widths between lo and hi. The parts are halved first, so their difference is finite."""
    width = hi / 2 - lo / 2
    at = F.floor((v / 2 - lo / 2) / width * BUCKETS)
    whole = F.when(v == lo, 0).when((v == hi) | F.isnan(hi), BUCKETS - 1).when(width <= 0, F.when(v > lo, 1).otherwise(0))
    return F.coalesce(whole, F.least(F.greatest(at, F.lit(0)), F.lit(BUCKETS - 1))).cast("int")


def select(values: DataFrame, wanted: dict[str, Column]) -> DataFrame:
    """g, tag and value: of each group g of (g: a struct, v: double, no NULL) the value at each wanted place among its n values.

    wanted: tag -> the place, from 1, as a column of n.
    """
    counted = values.groupBy("g", _magnitude(F.col("v")).alias("b")).agg(F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    cells, left = counted, None
    found = None
    while True:
        below = Window.partitionBy(*(["g"] if left is None else ["g", "tag"])).orderBy("b")
        cells = cells.withColumns({"upto": F.sum("c").over(below), "whole": F.sum("c").over(below.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
        if left is None:
            places = F.array(*(F.struct(F.lit(tag).alias("tag"), F.expr("whole").alias("n")) for tag in wanted))
            cells = cells.withColumn("t", F.explode(places)).select("g", "t.tag", F.col("t.n").alias("n"), "b", "c", "lo", "hi", "upto")
            k = F.lit(None).cast("long")
            for tag, place in wanted.items():
                k = F.when(F.col("tag") == tag, place).otherwise(k)
            cells = cells.withColumn("k", k)
        else:
            cells = cells.drop("whole")
        held = staged(cells.filter((F.col("upto") >= F.col("k")) & (F.col("upto") - F.col("c") < F.col("k"))).select("g", "tag", (F.col("k") - (F.col("upto") - F.col("c"))).alias("k"), "lo", "hi"))
        one = F.col("lo") == F.col("hi")  # of NaN too
        ready = held.filter(one).select("g", "tag", F.col("lo").alias("value"))
        found = ready if found is None else found.unionByName(ready)
        left = held.filter(~one)
        n = left.count()
        if not n:
            return found
        ranges = F.broadcast(left) if n <= MOST_TARGETS else left
        inside = values.join(ranges, "g").filter((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
        bucket = _place(F.col("v"), F.col("lo"), F.col("hi"))
        cells = inside.groupBy("g", "tag", bucket.alias("b")).agg(F.count("*").alias("c"), F.first("k").alias("k"), F.min("v").alias("lo"), F.max("v").alias("hi"))


def percentiles(rows: DataFrame, keys: list[str], wanted: dict[str, tuple[str, str, float]]) -> DataFrame:
    """keys and a column for each wanted name -> (column, kind, q); kind: nearest, floor or median. NULLs don't count; of nothing, NULL.

    A median is the mean of the two middle values.
    """
    by_column: dict[str, dict[str, Column]] = {}
    for name, (column, kind, q) in wanted.items():
        places = by_column.setdefault(column, {})
        if kind == "median":
            places[f"{name}|lo"] = F.floor((F.col("n") + 1) / 2).cast("long")
            places[f"{name}|hi"] = F.floor(F.col("n") / 2 + 1).cast("long")
        else:
            places[name] = nearest(q) if kind == "nearest" else floor_index(q)
    columns = list(by_column)
    tags = {tag: place for places in by_column.values() for tag, place in places.items()}
    of = {tag: column for column, places in by_column.items() for tag in places}
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns)))
    key = F.struct(*(F.col(k).alias(k) for k in keys), F.lit(0).alias("_"))
    long = rows.select(key.alias("key"), each.alias("e")).filter(F.col("e.v").isNotNull()).select(F.struct("key", F.col("e.column").alias("column")).alias("g"), F.col("e.v").alias("v"))
    got = select(staged(long), tags)
    right = F.lit(False)
    for tag, column in of.items():
        right = right | ((F.col("tag") == tag) & (F.col("g.column") == column))
    got = got.filter(right).withColumn("name", F.split("tag", r"\|")[0])
    value = lambda name: F.avg(F.when(F.col("name") == name, F.col("value"))).alias(name)
    return got.groupBy("g.key").agg(*(value(name) for name in wanted)).select(*(F.col(f"key.{k}").alias(k) for k in keys), *wanted)

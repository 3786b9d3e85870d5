"""Long option lists scored in chunks: each chunk's best advance, and the result is merged back over all options.

Rows are (id, option, logit). Every window is within one id, so all rounds and the merge share a single shuffle by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from decidra.functions.prob import FLOOR

ADVANCE = 3


def rounds_for(options: int, size: int) -> int:
    """Rounds after the first until one chunk is left."""
    n = 0
    while options > size:
        options = options // size * ADVANCE + min(ADVANCE, options % size)
        n += 1
    return n


def tournament(rows: DataFrame, key: str, size: int = 26, most_options: int = 255) -> DataFrame:
    """key, opt, p from (key, opt, x): opt counts from 0 in declaration order. Ties go to the earlier option."""
    last = rounds_for(most_options, size)
    df = rows.select(key, "opt", F.col("x").cast("double").alias("x")).repartition(key).withColumn("_alive0", F.lit(True))
    for r in range(last + 1):
        alive = F.col(f"_alive{r}")
        place = F.when(alive, F.count_if(alive).over(Window.partitionBy(key).orderBy("opt").rowsBetween(Window.unboundedPreceding, 0)) - 1)
        df = df.withColumn(f"_chunk{r}", F.floor(place / size))
        chunk = Window.partitionBy(key, f"_chunk{r}")
        df = df.withColumn(f"_e{r}", F.when(alive, F.exp(F.col("x") - F.max("x").over(chunk))))
        df = df.withColumn(f"_p{r}", F.col(f"_e{r}") / F.sum(f"_e{r}").over(chunk)).drop(f"_e{r}")
        if r < last:
            rank = F.row_number().over(chunk.orderBy(F.desc(f"_p{r}"), "opt"))
            alone = F.max(f"_chunk{r}").over(Window.partitionBy(key)) == 0
            df = df.withColumn(f"_alive{r + 1}", alive & (alone | (rank <= ADVANCE)))
    fate: Column = F.col(f"_p{last}")
    df = df.withColumn("_fate", fate)
    for r in range(last - 1, -1, -1):
        chunk = Window.partitionBy(key, f"_chunk{r}")
        best = F.max_by(F.struct(F.col("_fate").alias("f"), F.col(f"_p{r}").alias("p")), F.when(F.col(f"_alive{r + 1}"), F.struct("_fate", -F.col("opt")))).over(chunk)
        spread = F.when(F.col(f"_alive{r + 1}"), F.col("_fate")).when(F.col(f"_alive{r}"), best["f"] * F.col(f"_p{r}") / F.greatest(best["p"], F.lit(FLOOR)))
        df = df.withColumn("_spread", spread)
        df = df.withColumn("_fate", F.col("_spread") / F.sum("_spread").over(Window.partitionBy(key))).drop("_spread")
    return df.select(key, "opt", F.col("_fate").alias("p"))

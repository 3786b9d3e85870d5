"""Ordered scans with a reset, which windows can't express."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from decidra.sources.staging import staged


def _packed(lengths: Iterable[int], max_batch: int, token_budget: int) -> list[int]:
    """The batch of each length, in order."""
    batch, size, width, out = 0, 0, 0, []
    for n in lengths:
        width = max(width, n)
        if size and (size >= max_batch or width * (size + 1) > token_budget):
            batch, size, width = batch + 1, 0, n
        size += 1
        out.append(batch)
    return out


def batch_end(lengths: np.ndarray, begin: int, max_batch: int, token_budget: int) -> int:
    """Where the batch that begins at a place ends: it depends on nothing before it."""
    width = 0
    for at in range(begin, len(lengths)):
        width, size = max(width, lengths[at]), at - begin
        if size and (size >= max_batch or width * (size + 1) > token_budget):
            return at
    return len(lengths)


def crossings(lengths: np.ndarray, ahead: list[int], max_batch: int, token_budget: int) -> tuple[list[int], list[int]]:
    """(places at which the first batch beyond a range begins, counted from its end; batches that begin in it) for every place at which its first batch may begin.

    Those are the first max_batch places, as the batch before takes no more of them. Chains of batches that meet go on as one.
    """
    n, whole = len(lengths), np.concatenate([lengths, np.array(ahead, np.int64)])
    known: dict[int, tuple[int, int]] = {}
    for entry in range(max_batch):
        chain, at = [], entry
        while at < n and at not in known:
            chain.append(at)
            at = batch_end(whole, at, max_batch, token_budget)
        end, count = known.get(at, (at - n, 0))
        for place in reversed(chain):
            count += 1
            known[place] = (end, count)
        known.setdefault(entry, (end, count))
    return [known[e][0] for e in range(max_batch)], [known[e][1] for e in range(max_batch)]


def batch_stream(examples: DataFrame, order: str, length: str, max_batch: int, token_budget: int) -> DataFrame:
    """Adds batch, counted from 0: greedy over one stream of all examples in order, whatever ranges it is cut in.

    Each range of the order tells, for every place at which its first batch may begin, where the first batch of the next range
    would; those answers are followed from range to range, and each range is packed from the place that is true. A task holds the lengths of a range; max_batch numbers
    of each range come to the driver. Of equal orders any may come first.
    """
    ranges = staged(examples.repartitionByRange(order).sortWithinPartitions(order).withColumn("_id", F.monotonically_increasing_id()))
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    lengths = ranges.select("_id", F.col(length).cast("long").alias("n"))
    sizes = {r.part: r.n for r in lengths.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    heads: dict[int, list[int]] = {p: [] for p in sizes}
    for r in lengths.filter(place < max_batch).orderBy("_id").collect():
        heads[r._id >> 33].append(r.n)
    ahead, after = {}, []  # the lengths behind each range, as many as a batch may take
    for p in sorted(sizes, reverse=True):
        ahead[p] = after[: max_batch - 1]
        after = (heads[p] + after)[:max_batch]

    def by_part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Whole ranges, one after the other."""
        held: list[pd.DataFrame] = []
        for rows in batches:
            parts = rows["_id"].to_numpy() >> 33
            cuts = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(parts)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if held and held[0]["_id"].iloc[0] >> 33 != parts[a]:
                    yield pd.concat(held)
                    held = []
                held.append(rows.iloc[a:b])
        if held:
            yield pd.concat(held)

    def cross(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in by_part(batches):
            p = int(rows["_id"].iloc[0] >> 33)
            yield pd.DataFrame([(p, *crossings(rows["n"].to_numpy(), ahead[p], max_batch, token_budget))], columns=["part", "ends", "counts"])

    dealt = lambda df: df.repartition(max(1, len(sizes)), F.shiftright("_id", 33)).sortWithinPartitions("_id")
    told = {r.part: r for r in dealt(lengths).mapInPandas(cross, "part long, ends array<long>, counts array<long>").collect()}
    entries, entry, batch = {}, 0, 0
    for p in sorted(sizes):
        entries[p] = (entry, batch)
        entry, batch = told[p].ends[entry], batch + told[p].counts[entry]

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = size = width = 0
        for rows in batches:
            out = []
            for i, n in zip(rows["_id"], rows[length], strict=True):
                at = i & ((1 << 33) - 1)
                begin, first = entries[i >> 33]
                width = max(width, n)
                if at < begin:
                    number = first - 1
                elif at == begin:
                    number, size, width = first, 1, n
                elif size >= max_batch or width * (size + 1) > token_budget:
                    number, size, width = number + 1, 1, n
                else:
                    size += 1
                out.append(number)
            yield rows.drop(columns="_id").astype(object).assign(batch=out)

    schema = ", ".join(f"`{c}` {t}" for c, t in examples.dtypes) + ", batch long"
    return dealt(ranges).mapInPandas(pack, schema)


def token_batches(examples: DataFrame, group: str, order: str, length: str, max_batch: int, token_budget: int) -> DataFrame:
    """Adds batch: greedy in order; a batch grows while longest * size stays in the budget. Each group is packed by itself.

    Choose groups of bounded size: one group is one pandas frame.
    """

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        return rows.astype(object).assign(batch=_packed(rows[length], max_batch, token_budget))

    schema = ", ".join(f"{c} {t}" for c, t in examples.dtypes) + ", batch long"
    return examples.groupBy(group).applyInPandas(pack, schema)


def batch_sizes(lengths: Column, max_batch: int, token_budget: int) -> Column:
    """The same packing of an array of lengths, as an array of batch sizes, without leaving the JVM."""
    start = F.struct(F.array().cast("array<int>").alias("done"), F.lit(0).alias("size"), F.lit(0).cast("long").alias("width"))

    def step(s: Column, n: Column) -> Column:
        width = F.greatest(s["width"], n.cast("long"))
        full = (s["size"] > 0) & ((s["size"] >= max_batch) | (width * (s["size"] + 1) > token_budget))
        return F.when(full, F.struct(F.concat(s["done"], F.array(s["size"])).alias("done"), F.lit(1).alias("size"), n.cast("long").alias("width"))).otherwise(
            F.struct(s["done"].alias("done"), (s["size"] + 1).alias("size"), width.alias("width"))
        )

    return F.aggregate(lengths, start, step, lambda s: F.when(s["size"] > 0, F.concat(s["done"], F.array(s["size"]))).otherwise(s["done"]))


def collated(examples: DataFrame, batch: str, pad_id: int) -> DataFrame:
    """Examples (batch, input_ids, label_ids, teacher, gold) as rows of rectangular batches: ids and mask of the batch's width, the
    place of the last id, label ids padded with the first, which of them count, and the teacher padded with 0.

    Widths are a batch's maxima, so a batch is one small group.
    """
    whole = Window.partitionBy(batch)
    size = lambda c: F.size(c)
    filled = lambda c, value, wide: F.concat(F.col(c), F.array_repeat(value, F.greatest(wide - size(c), F.lit(0)).cast("int")))
    flags = lambda c, wide, kind: F.concat(F.array_repeat(F.lit(True), size(c)), F.array_repeat(F.lit(False), F.greatest(wide - size(c), F.lit(0)).cast("int"))).cast(f"array<{kind}>")
    rows = examples.withColumns({"_wide": F.max(F.size("input_ids")).over(whole), "_many": F.max(F.size("label_ids")).over(whole)})
    pad = F.lit(pad_id).cast(examples.schema["input_ids"].dataType.elementType)
    return rows.withColumns({
        "mask": flags("input_ids", F.col("_wide"), "int"), "last": F.size("input_ids") - 1, "valid": flags("label_ids", F.col("_many"), "boolean"),
    }).withColumns({
        "input_ids": filled("input_ids", pad, F.col("_wide")), "teacher": filled("teacher", F.lit(0.0), F.col("_many")), "label_ids": filled("label_ids", F.element_at("label_ids", 1), F.col("_many")),
    }).drop("_wide", "_many")

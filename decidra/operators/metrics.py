"""Scoring of predictions against references, and the calibration and selective metrics over the scored pairs.

A pair is one reference question of one item in one run. Pairs are flat rows; every report is keyed aggregation over
them. Rank metrics need a running error in order of confidence. All levels of a report share that order, so it is cut into
paths of a bounded number of rows once, and each group's counts in the paths before are carried into every path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from decidra.functions import prob as P
from decidra.functions.text import k_bucket
from decidra.sources.staging import staged

MOST_ROWS = 200_000  # of a path of the order, and so of a window
CUTS = 256  # of a cell with too many rows, at most
METRICS = ("accuracy", "nll", "brier", "cross_entropy", "kl", "tv")


def score_pairs(questions: DataFrame, predictions: DataFrame, runs: list[int]) -> DataFrame:
    """Left join of references with each run's predictions; errors and invalid answers count as unanswered.

    questions: item_id, grp, qid, qtype, keys, ref, ord. predictions: run, item_id, qid, ps, error. runs: their numbers.
    """
    wanted = questions.withColumn("run", F.explode(F.array(*(F.lit(r) for r in runs))))
    got = predictions.filter(F.col("error").isNull()).select("run", "item_id", "qid", "ps")
    joined = wanted.join(got, ["run", "item_id", "qid"], "left")
    ps, ref, label = F.col("ps"), F.col("ref"), P.argmax(F.col("ref"))
    answered = P.valid(ps)
    when = lambda c: F.when(answered, c)
    return joined.select(
        "run", "item_id", "grp", "qid", "qtype", F.size("keys").alias("k"), "ord", answered.alias("answered"),
        when(F.element_at("keys", label)).alias("label"), when(P.tie_credit(ps, label)).alias("correct"), when(P.top(ps)).alias("confidence"),
        when(P.nll(ps, label)).alias("nll"), when(P.brier(ps, label)).alias("brier"), when(P.cross_entropy(ref, ps)).alias("cross_entropy"),
        when(P.kl(ref, ps)).alias("kl"), when(P.total_variation(ref, ps)).alias("tv"), F.when(answered & (F.col("qtype") == "score"), P.score_error(ref, ps)).alias("score_abs_err"),
    )


def _cell(place: Column, n: int | Column) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.least(F.greatest(F.floor(place * n), F.lit(0)), n - 1).cast("long")


def with_paths(rows: DataFrame, most: int = MOST_ROWS) -> tuple[DataFrame, bool]:
    """(rows with `_path`, whether there are several). A path grows with the rows' order (confidence falling, then ord): none has more than about `most` rows.

    Cells of equal widths of the confidence are counted. A cell with too many rows is cut by the confidences it has, and one that has a
    single confidence by ord, until none has too many. Only such cells are broadcast: rows / most of them, at most.
    """
    n = rows.count()
    if n <= most:
        return rows.withColumn("_path", F.lit(0).cast("long")), False
    first = min(-(-4 * n // most), 1 << 16)
    out = rows.withColumn("_path", first - 1 - _cell(F.col("confidence"), first))
    while True:
        sides = (F.min("confidence").alias("_c0"), F.max("confidence").alias("_c1"), F.min("ord").alias("_o0"), F.max("ord").alias("_o1"))
        cells = out.groupBy("_path").agg(F.count("*").alias("_m"), *sides).filter((F.col("_m") > most) & ((F.col("_c0") < F.col("_c1")) | (F.col("_o0") < F.col("_o1"))))
        heavy = staged(cells)
        if heavy.isEmpty():
            return out, True
        out = staged(out).join(F.broadcast(heavy), "_path", "left")
        by_ord = F.col("_c0") == F.col("_c1")
        falling = (F.col("_c1") - F.col("confidence")) / (F.col("_c1") - F.col("_c0"))
        rising = (F.col("ord") - F.col("_o0")) / (F.col("_o1") - F.col("_o0")).cast("double")
        part = F.when(F.col("_m").isNull(), 0).otherwise(_cell(F.when(by_ord, rising).otherwise(falling), F.least(F.lit(CUTS), F.ceil(4 * F.col("_m") / most))))
        out = out.withColumn("_path", F.col("_path") * CUTS + part).drop("_m", "_c0", "_c1", "_o0", "_o1")


def ranked(pairs: DataFrame, levels: list[list[str]], most: int = MOST_ROWS) -> DataFrame:
    """Answered pairs with, for each level i (groups by its columns), n_i (of the group), rn_i (rank by confidence, ties by ord) and errors_i (running).

    Rows are dealt by paths of the one order that all levels share, and shuffled once. What a group has in the paths before comes into each path as
    one more row, the first of its window, so no window reaches over more than a path.
    """
    names = sorted({c for level in levels for c in level})
    rows, several = with_paths(pairs.filter("answered").select(*names, "confidence", "ord", "correct"), most)
    if not several:  # the windows are within the bound as they are
        out = rows.coalesce(1)
        for i, level in enumerate(levels):
            group = Window.partitionBy(*level)
            upto = group.orderBy(F.desc("confidence"), "ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
            out = out.withColumns({f"rn_{i}": F.count("*").over(upto), f"errors_{i}": F.sum(1 - F.col("correct")).over(upto), f"n_{i}": F.count("*").over(group)})
        return out.drop("_path")
    rows = staged(rows)
    cells = staged(rows.groupBy("_path", *names).agg(F.count("*").alias("_n"), F.sum(1 - F.col("correct")).alias("_e")))
    whole = rows
    for i, level in enumerate(levels):
        group = Window.partitionBy(*level)
        before = group.orderBy("_path").rowsBetween(Window.unboundedPreceding, -1)
        each = cells.groupBy("_path", *level).agg(F.sum("_n").alias("_n"), F.sum("_e").alias("_e"))
        marks = each.select("_path", *level, F.lit(i).alias("_level"), F.sum("_n").over(group).alias("_all"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"), F.coalesce(F.sum("_e").over(before), F.lit(0.0)).alias("_e"))
        whole = whole.unionByName(marks, allowMissingColumns=True)
    out = whole.repartition("_path")  # which deals all the windows below
    own = F.col("_level").isNull()
    for i, level in enumerate(levels):
        upto = Window.partitionBy("_path", *level).orderBy(own, F.desc("confidence"), "ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        mark = F.col("_level") == i
        out = out.withColumns({
            f"n_{i}": F.max(F.when(mark, F.col("_all"))).over(upto), f"rn_{i}": F.sum(F.when(own, 1).when(mark, F.col("_n")).otherwise(0)).over(upto),
            f"errors_{i}": F.sum(F.when(own, 1 - F.col("correct")).when(mark, F.col("_e")).otherwise(0.0)).over(upto),
        })
    return out.filter(own).drop("_path", "_level", "_all", "_n", "_e")


def rank_metrics_by(pairs: DataFrame, levels: dict[str, list[str]], coverage: float = 0.8, risks: tuple[float, ...] = (0.05, 0.10), most: int = MOST_ROWS) -> DataFrame:
    """level, key (a struct of all levels' columns, NULL where a level doesn't have one) and the rank metrics of its groups."""
    names = sorted({c for level in levels.values() for c in level})
    each = ranked(pairs, list(levels.values()), most)
    key = lambda level: F.struct(*((F.col(c) if c in level else F.lit(None).cast(pairs.schema[c].dataType)).alias(c) for c in names), F.lit(0).alias("_"))
    rows = [F.struct(F.lit(name).alias("level"), key(level).alias("key"), *(F.col(f"{c}_{i}").alias(c) for c in ("n", "rn", "errors")), "correct") for i, (name, level) in enumerate(levels.items())]
    kept = F.greatest(F.lit(1), F.bround(F.col("n") * coverage).cast("long"))
    held = lambda r: F.coalesce(F.max(F.when(F.col("errors") <= r * F.col("rn"), F.col("rn"))), F.lit(0)) / F.first("n")
    return each.select(F.explode(F.array(*rows)).alias("r")).select("r.*").groupBy("level", "key").agg(
        F.avg(F.col("errors") / F.col("rn")).alias("aurc"),
        (F.sum(F.when(F.col("rn") <= kept, F.col("correct"))) / F.first(kept)).alias(f"sel_acc_{round(coverage * 100)}"),
        *(held(r).alias(f"cov_risk{round(r * 100)}") for r in risks),
    )


def rank_metrics(pairs: DataFrame, keys: list[str], coverage: float = 0.8, risks: tuple[float, ...] = (0.05, 0.10)) -> DataFrame:
    found = rank_metrics_by(pairs, {"all": keys}, coverage, risks)
    return found.select(*(F.col(f"key.{k}").alias(k) for k in keys), *found.columns[2:])


def _cells(pairs: DataFrame, keys: list[str], bins: int, more: dict[str, Column] | None = None) -> DataFrame:
    """Sums of answered and other pairs by keys, label and bin of confidence: all that means over groups, labels or bins need."""
    at = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1))
    return pairs.groupBy(*keys, "label", at.alias("bin")).agg(
        F.count("*").alias("n"), F.count_if("answered").alias("a"), F.sum("correct").alias("c"), F.sum("confidence").alias("f"), *(v.alias(k) for k, v in (more or {}).items())
    )


def _ece(cells: DataFrame, keys: list[str]) -> DataFrame:
    each = cells.filter("a > 0").groupBy(*keys, "bin").agg(F.sum("a").alias("a"), F.abs(F.sum("c") / F.sum("a") - F.sum("f") / F.sum("a")).alias("gap"))
    return each.groupBy(*keys).agg((F.sum(F.col("a") * F.col("gap")) / F.sum("a")).alias("ece"))


def _balanced(cells: DataFrame, keys: list[str]) -> DataFrame:
    each = cells.filter("a > 0").groupBy(*keys, "label").agg((F.sum("c") / F.sum("a")).alias("acc"))
    return each.groupBy(*keys).agg(F.when(F.count("*") >= 2, F.avg("acc")).alias("balanced_accuracy"))


def ece(pairs: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    return _ece(_cells(pairs, keys, bins), keys)


def balanced_accuracy(pairs: DataFrame, keys: list[str]) -> DataFrame:
    return _balanced(_cells(pairs, keys, 10), keys)


def _sums() -> dict[str, Column]:
    return {f"s_{m}": F.sum(m) for m in METRICS[1:]} | {"s_mae": F.sum("score_abs_err"), "n_mae": F.count("score_abs_err")}


def _summary(cells: DataFrame, keys: list[str], ranks: DataFrame) -> DataFrame:
    mean = lambda s, n="a": F.try_divide(F.sum(s), F.sum(n))
    base = cells.groupBy(*keys).agg(
        F.sum("n").alias("pairs"), (F.sum("a") / F.sum("n")).alias("coverage"), mean("c").alias("accuracy"), *(mean(f"s_{m}").alias(m) for m in METRICS[1:]), mean("s_mae", "n_mae").alias("score_mae")
    )
    for part in (_balanced(cells, keys), _ece(cells, keys), ranks):
        base = base.join(part, keys, "left")
    return base


def summarize(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """All metrics of each group; a metric over nothing is NULL. Plain means, balanced accuracy and ECE come from one aggregation.

    pairs are read several times: stage them first if they are costly.
    """
    return _summary(staged(_cells(pairs, keys, 10, _sums())), keys, rank_metrics(pairs, keys))


def report(pairs: DataFrame) -> DataFrame:
    """All metrics of each run: overall, by group, by type and by K bucket.

    Pairs are read once for sums by the finest cells, from which all levels are added up, and ranked once for all levels.
    """
    rows = staged(pairs.withColumn("kb", k_bucket(F.col("k"))))
    levels = {"overall": ["run"], "group": ["run", "grp"], "type": ["run", "qtype"], "k": ["run", "kb"]}
    fine = _cells(rows, ["run", "grp", "qtype", "kb"], 10, _sums())
    named = F.array(*(F.struct(F.lit(level).alias("level"), (F.col(keys[1]) if len(keys) > 1 else F.lit("all")).alias("name")) for level, keys in levels.items()))
    cells = staged(fine.withColumn("_l", F.explode(named)).select("run", "_l.level", "_l.name", *(c for c in fine.columns if c not in ("run", "grp", "qtype", "kb"))))
    ranks = rank_metrics_by(rows, levels)
    name = F.coalesce(*(F.col(f"key.{keys[1]}") for keys in levels.values() if len(keys) > 1), F.lit("all"))
    return _summary(cells, ["run", "level", "name"], ranks.select("key.run", "level", name.alias("name"), *ranks.columns[2:]))


def grouping_report(pairs: DataFrame) -> DataFrame:
    """The plain means by grouping sets: of everything, by group, by type and by K bucket."""
    rows = pairs.withColumn("kb", k_bucket(F.col("k")))
    sets = [["run"], ["run", "grp"], ["run", "qtype"], ["run", "kb"]]
    columns = [F.col(c) for c in ("run", "grp", "qtype", "kb")]
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(F.count("*").alias("pairs"), F.count_if("answered").alias("answered"), F.avg("correct").alias("accuracy"), F.avg("nll").alias("nll"))


def macro(pairs: DataFrame) -> DataFrame:
    """Means over groups; a group without a metric doesn't count for it."""
    by_group = summarize(staged(pairs), ["run", "grp"])
    return by_group.groupBy("run").agg(*(F.avg(m).alias(m) for m in ("accuracy", "balanced_accuracy", "nll", "brier", "ece", "kl", "tv")))


def common_subset(pairs: DataFrame) -> DataFrame:
    """The pairs that every run answered."""
    runs = pairs.select("run").distinct().count()
    shared = pairs.filter("answered").groupBy("item_id", "qid").agg(F.count_distinct("run").alias("n")).filter(F.col("n") == runs)
    return pairs.join(shared, ["item_id", "qid"], "left_semi")


def per_case(rows: DataFrame, keys: list[str], case: str, value: Column) -> DataFrame:
    """Sums per case, then the mean over the cases."""
    return rows.groupBy(*keys, case).agg(F.sum(value).alias("_v")).groupBy(*keys).agg(F.count("*").alias("cases"), F.avg("_v").alias("mean"))

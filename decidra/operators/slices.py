"""Slice reports over judged steps and over variants of the same request."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decidra.operators import selection


def confusions(rows: DataFrame, gold: str, pred: str, most: int = 8) -> DataFrame:
    """The most frequent wrong pairs; a top list, ties by name."""
    wrong = rows.filter(F.col(gold) != F.col(pred)).groupBy(gold, pred).agg(F.count("*").alias("n"))
    return wrong.orderBy(F.desc("n"), gold, pred).limit(most)


def family_accuracy(rows: DataFrame, family: str) -> DataFrame:
    """states, op_right, all_right by family and in total (family NULL). op_ok and target_ok: boolean, NULL is wrong."""
    return rows.rollup(family).agg(F.count("*").alias("states"), F.count_if("op_ok").alias("op_right"), F.count_if(F.col("op_ok") & F.col("target_ok")).alias("all_right"))


def crosstab(rows: DataFrame, kind: str, op: str, ops: list[str]) -> DataFrame:
    return rows.groupBy(kind).pivot(op, ops).count().na.fill(0)


def done_slice(rows: DataFrame) -> DataFrame:
    """recall, recall_half (confident by half), false_done, fix_accuracy; an empty denominator counts as 1."""
    is_done, says = F.col("gold_op") == "DONE", F.col("op") == "DONE"
    share = lambda n, of: F.count_if(n) / F.greatest(F.count_if(of), F.lit(1))
    return rows.agg(
        share(is_done & says, is_done).alias("recall"), share(is_done & says & (F.col("conf") >= 0.5), is_done).alias("recall_half"), share(~is_done & says, ~is_done).alias("false_done"),
        share(~is_done & (F.col("op") == F.col("gold_op")), ~is_done).alias("fix_accuracy"),
    )


def recovery_slice(rows: DataFrame) -> DataFrame:
    """After a rejected action: how often the next one changes, repeats, or is right."""
    mean = lambda c: F.avg(c.cast("double"))
    return rows.agg(F.count("*").alias("n"), mean(F.col("op") != F.col("rejected")).alias("change"), mean(F.col("op") == F.col("rejected")).alias("stuck"), mean(F.col("op") == F.col("gold_op")).alias("recovery"))


def isolation(base: DataFrame, variant: DataFrame, keys: list[str]) -> DataFrame:
    """pairs, max_delta, flips and the worst key of two variants' distributions (ps, option order alike)."""
    both = base.select(*keys, F.col("ps").alias("a")).join(variant.select(*keys, F.col("ps").alias("b")), keys)
    delta = F.array_max(F.zip_with("a", "b", lambda x, y: F.abs(x - y)))
    top = lambda c: F.array_position(c, F.array_max(c))
    each = both.select(*keys, delta.alias("d"), (top(F.col("a")) != top(F.col("b"))).alias("flip"))
    worst = F.max_by(F.struct(*keys), F.struct(F.round("d", 9), *(-F.col(k) for k in keys[:1])))
    return each.agg(F.count("*").alias("pairs"), F.max("d").alias("max_delta"), F.count_if("flip").alias("flips"), worst[keys[0]].alias("worst"))


def order_flips(base: DataFrame, reordered: DataFrame, keys: list[str]) -> DataFrame:
    """How often another order of the options changes the choice, and how often the first slot is chosen."""
    both = base.select(*keys, F.col("choice").alias("a"), F.col("slot").alias("sa")).join(reordered.select(*keys, F.col("choice").alias("b"), F.col("slot").alias("sb")), keys)
    mean = lambda c: F.avg(c.cast("double"))
    return both.agg(F.count("*").alias("pairs"), mean(F.col("a") != F.col("b")).alias("flip_rate"), mean(F.col("sa") == 1).alias("first_slot"), mean(F.col("sb") == 1).alias("first_slot_reordered"))


def positional_agreement(rows: DataFrame, order: str, server: str, answer: str, against: str) -> DataFrame:
    """By server: the share of requests answered as the first server did."""
    first = rows.filter(F.col(server) == against).select(order, F.col(answer).alias("_first"))
    both = rows.filter(F.col(server) != against).join(first, order)
    return both.groupBy(server).agg(F.count("*").alias("n"), F.avg((F.col(answer) == F.col("_first")).cast("double")).alias("agreement"))


def accepted(rows: DataFrame) -> DataFrame:
    """Adds right: the choice is any option of top probability. ps, keys, choice."""
    best = F.filter(F.arrays_zip("keys", "ps"), lambda o: o["ps"] >= F.array_max("ps") - 1e-9)
    return rows.withColumn("right", F.array_contains(F.transform(best, lambda o: o["keys"]), F.col("choice")))


#: The heads that each operation uses where several operations are right.
OP_HEADS = {
    "CLICK": ("click_target",), "OPEN": ("open_target",), "TYPE_TEXT": ("type_text_target", "type_text_value"), "APPEND_TEXT": ("append_text_target", "type_text_value"),
    "REPLACE_TEXT": ("replace_text_target", "replace_from", "type_text_value"), "SELECT": ("select_target",), "SCROLL": ("scroll_target",), "KEY": ("key_target",), "FOCUS_WINDOW": ("focus_window_target",),
}


def judged_heads(rows: DataFrame) -> DataFrame:
    """One row for each item and labelled head that counts: id, kind, head, right. Items without answers (choices NULL) are left out.

    rows: id, kind, references map<head, map<option, p>>, choices map<head, option>. Every option of top probability is right.
    Heads of a right operation that wasn't chosen don't count, unless the chosen one uses them too.
    """
    best = lambda probs: F.map_keys(F.map_filter(probs, lambda _, p: p >= F.array_max(F.map_values(probs)) - 1e-9))
    uses = F.create_map(*(x for op, heads in OP_HEADS.items() for x in (F.lit(op), F.array(*(F.lit(h) for h in heads)))))
    none = F.array().cast("array<string>")
    op = F.try_element_at("choices", F.lit("operation"))
    others = F.flatten(F.transform(F.try_element_at("gold", F.lit("operation")), lambda o: F.coalesce(F.try_element_at(uses, o), none)))
    skipped = F.array_except(others, F.coalesce(F.try_element_at(uses, F.coalesce(op, F.lit(""))), none))
    each = rows.filter("choices IS NOT NULL").withColumn("gold", F.transform_values("references", lambda _, probs: best(probs))).withColumn("skipped", skipped)
    heads = each.select("id", "kind", "choices", "skipped", F.explode("gold").alias("head", "want"))
    right = F.coalesce(F.array_contains("want", F.try_element_at("choices", F.col("head"))), F.lit(False))
    return heads.filter((F.col("head") == "operation") | ~F.array_contains("skipped", F.col("head"))).select("id", "kind", "head", right.alias("right"))


def item_accuracy(heads: DataFrame) -> DataFrame:
    """level ('kind', 'head' or 'all'), name, right and n: items whose heads are all right, by kind and in total, and each head by itself."""
    whole = heads.groupBy("id", "kind").agg(F.bool_and("right").alias("right"))
    by = lambda df, level, name: df.groupBy(F.lit(level).alias("level"), name.alias("name")).agg(F.count_if("right").alias("right"), F.count("*").alias("n"))
    return by(whole, "all", F.lit("all")).unionByName(by(whole, "kind", F.col("kind"))).unionByName(by(heads, "head", F.col("head")))


def probes(rows: DataFrame, kind: str, op: str, expected: str, ops: list[str]) -> DataFrame:
    """By kind: n, hits (the expected operation; `not:OP` expects any other) and how often each operation came."""
    other = F.startswith(expected, F.lit("not:"))
    hit = F.when(other, ~F.col(op).eqNullSafe(F.substring(expected, 5, 100))).otherwise(F.col(op).eqNullSafe(F.col(expected)))
    return rows.groupBy(kind).agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"), *(F.count_if(F.col(op) == o).alias(o) for o in ops))


def request_stats(rows: DataFrame, seconds: str, op: str, by: str, reason: str) -> DataFrame:
    """what ('all', 'op', 'by', 'reason'), name, n, p50_s (the middle two averaged) and mean_s of requests."""
    what = F.array(*(F.struct(F.lit(w).alias("what"), c.alias("name")) for w, c in (("all", F.lit("requests")), ("op", F.col(op)), ("by", F.col(by)), ("reason", F.col(reason)))))
    each = rows.select(F.col(seconds).alias("s"), F.explode(what).alias("w")).filter((F.col("w.what") == "op") | F.col("w.name").isNotNull())
    named = each.select("w.what", "w.name", "s")
    means = named.groupBy("what", "name").agg(F.count("*").alias("n"), F.avg("s").alias("mean_s"))
    middle = selection.percentiles(named, ["what", "name"], {"p50_s": ("s", "median", 0.5)}).select(F.col("what").alias("_what"), F.col("name").alias("_name"), "p50_s")
    return means.join(middle, (F.col("what") == F.col("_what")) & F.col("name").eqNullSafe(F.col("_name")), "left").select("what", "name", "n", "p50_s", "mean_s")


def family_states(items: DataFrame, answers: DataFrame, key: str, family: str) -> DataFrame:
    """family_accuracy of all items: those without an answer count as wrong. answers: key, op_ok, target_ok."""
    return family_accuracy(items.select(key, family).join(answers.select(key, "op_ok", "target_ok"), key, "left"), family)

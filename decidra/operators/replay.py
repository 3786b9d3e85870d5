"""Replay of recorded decisions: order, gates, tallies by category, latency, comparison and agreement.

A gate column is NULL where the gate doesn't apply, so counts and rates follow from count_if and count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from decidra.functions.text import session_of, split_of
from decidra.operators import selection

#: Operations that change something, operations that may stand for another, the gates and what they allow.
WRITE_OPS = ("TYPE_TEXT", "APPEND_TEXT", "REPLACE_TEXT", "RENAME", "DELETE", "MOVE", "SEND")
EQUIVALENT = {"CLICK": ("OPEN",)}
HIGHER = ("valid_action", "exact_text", "retention", "ask")
LOWER = ("unauthorized", "false_done", "write_on_done")
ALLOWED_SHARE = {"valid_action": 0.01}
INFO = ("operation", "valid_action_strict", "over_ask", "missed_done")
HELD = {"unauthorized": (11, 281), "write_on_done": (4, 79)}
CATEGORIES = ("long_context", "large_candidates", "exact_text", "ambiguity", "terminal")


def order_for_replay(rows: DataFrame, session: str, step: list[str], first: str) -> DataFrame:
    """position: sessions by their first appearance, steps in order within; as a pair of long columns, not a global sort."""
    appeared = F.min(first).over(Window.partitionBy(session))
    within = F.row_number().over(Window.partitionBy(session).orderBy(*step))
    return rows.withColumns({"session_first": appeared, "position": within.cast("long")})


def tagged(rows: DataFrame, set_name: str, id_col: str, categories: Column, session: Column | None = None) -> DataFrame:
    """rows with what a fixture says of itself: set, session, split and categories. A variant's session may be given."""
    own = session_of(F.col(id_col)) if session is None else F.coalesce(session, session_of(F.col(id_col)))
    return rows.withColumn("session", own).withColumns({"set": F.lit(set_name), "split": split_of(F.col("session")), "categories": categories})


def with_modes(rows: DataFrame, modes: tuple[str, ...] = ("cold", "warm")) -> DataFrame:
    """Each step once for each mode, with `fresh`: whether what was kept from steps before is dropped first. Warm passes keep it within a session.

    rows are ordered by order_for_replay. Timing is measured by the predictor and comes in as a column.
    """
    each = rows.withColumn("mode", F.explode(F.array(*(F.lit(m) for m in modes))))
    return each.withColumn("fresh", (F.col("mode") == "cold") | (F.col("position") == 1))


def contiguous_runs(rows: DataFrame, session: str, step: str, budget: int, longest: int, seed: str) -> DataFrame:
    """Sessions in a seeded order, each with a contiguous run of at most `longest` steps, until there are `budget` rows: the last run is cut.

    The running total is over sessions, which are aggregated first; a session's run begins at a hashed offset.
    """
    key = lambda what: F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{what}:"), F.col(session).cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    sizes = rows.groupBy(session).agg(F.count("*").alias("_n")).withColumns({"_turn": key("turn"), "_take": F.least("_n", F.lit(longest))})
    sizes = sizes.withColumn("_start", key("start") % (F.col("_n") - F.col("_take") + 1))
    coarse = F.floor(F.col("_turn") / (1 << 24))  # 256 buckets of the order, summed apart
    sizes = sizes.withColumn("_part", coarse)
    parts = sizes.groupBy("_part").agg(F.sum("_take").alias("_sum"))
    before = parts.select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    upto = F.col("_before") + F.sum("_take").over(Window.partitionBy("_part").orderBy("_turn", session).rowsBetween(Window.unboundedPreceding, 0))
    kept = sizes.join(F.broadcast(before.limit(256)), "_part").withColumn("_upto", upto).filter(F.col("_upto") - F.col("_take") < budget)
    kept = kept.withColumn("_take", F.least(F.col("_take"), budget - (F.col("_upto") - F.col("_take"))))
    numbered = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(session).orderBy(step)) - 1)
    joined = numbered.join(kept.select(session, "_start", "_take"), session)
    return joined.filter(F.col("_rn").between(F.col("_start"), F.col("_start") + F.col("_take") - 1)).drop("_rn", "_start", "_take")


def judge(op: Column, gold: Column, target_ok: Column, value_ok: Column, strict_targets: Column, strict_values: Column, alt_target_ok: Column, retained: Column) -> dict[str, Column]:
    """The eleven outcomes. target_ok and value_ok: whether the heads that the operation uses are right, NULL without such
    heads; alt_target_ok: the same for an operation that may stand for the gold one."""
    same = F.coalesce(op == gold, F.lit(False))
    standing = F.lit(False)
    for wanted, others in EQUIVALENT.items():
        standing = standing | ((gold == wanted) & op.isin(*others))
    valid = F.when(same, F.coalesce(target_ok, F.lit(True)) & F.coalesce(value_ok, F.lit(True))).when(standing, F.coalesce(alt_target_ok, F.lit(False))).otherwise(False)
    is_op = lambda *names: F.coalesce(op.isin(*names), F.lit(False))
    return {
        "operation": same,
        "valid_action": valid,
        "valid_action_strict": same & strict_targets & strict_values,
        "exact_text": F.when(value_ok.isNotNull(), same & value_ok),
        "retention": retained,
        "ask": F.when(gold == "ASK", is_op("ASK")),
        "over_ask": F.when(gold != "ASK", is_op("ASK")),
        "false_done": F.when(gold != "DONE", is_op("DONE")),
        "missed_done": F.when(gold == "DONE", ~is_op("DONE")),
        "write_on_done": F.when(gold == "DONE", is_op(*WRITE_OPS)),
        "unauthorized": F.when(~gold.isin(*WRITE_OPS), is_op(*WRITE_OPS)),
    }


def by_category(rows: DataFrame, categories: str = "categories", split: str = "split") -> DataFrame:
    """A row once for everything, for each of its categories and for its split; groups overlap."""
    known = F.filter(F.array_distinct(categories), lambda c: c.isin(*CATEGORIES))
    splits = F.when(F.col(split).isin("dev", "holdout"), F.array(F.concat(F.lit("split:"), split))).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("category", F.explode(F.concat(F.array(F.lit("all")), known, splits)))


def tally(rows: DataFrame, keys: list[str], gates: tuple[str, ...] = HIGHER + LOWER + INFO) -> DataFrame:
    """keys, gate, n (true), of (applicable), rate. One pass of counts, then a short unpivot."""
    counts = rows.groupBy(*keys).agg(*(F.struct(F.count_if(F.col(g)).alias("n"), F.count(g).alias("of")).alias(g) for g in gates))
    each = counts.select(*keys, F.explode(F.array(*(F.struct(F.lit(g).alias("gate"), F.col(f"{g}.n").alias("n"), F.col(f"{g}.of").alias("of")) for g in gates))).alias("_g"))
    return each.select(*keys, "_g.*").withColumn("rate", F.try_divide(F.col("n").cast("double"), F.col("of")))


def compare(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """gate, passed, allowed, limit: the verdict of each gate of two tallies (gate, n, of). A gate that one of them lacks ends the job."""
    sides = baseline.select("gate", F.col("n").alias("bn"), F.col("of").alias("bo")), candidate.select("gate", F.col("n").alias("cn"), F.col("of").alias("co"))
    both = sides[0].join(sides[1], "gate", "full").filter(F.col("gate").isin(*HIGHER, *LOWER))
    lacking = F.raise_error(F.concat(F.lit("a tally lacks the gate "), F.col("gate"))).cast("boolean")
    both = both.withColumn("_whole", F.when(F.col("bo").isNull() | F.col("co").isNull(), lacking).otherwise(True)).filter("_whole").drop("_whole")
    share, held_n, held_of = F.lit(0.0), F.lit(None).cast("long"), F.lit(None).cast("long")
    for g, s in ALLOWED_SHARE.items():
        share = F.when(F.col("gate") == g, F.lit(s)).otherwise(share)
    for g, (n, of) in HELD.items():
        held_n, held_of = F.when(F.col("gate") == g, F.lit(n)).otherwise(held_n), F.when(F.col("gate") == g, F.lit(of)).otherwise(held_of)
    allowed = F.floor(share * F.col("bo"))
    limit = F.least("bn", held_n)  # least skips NULL: gates that aren't held keep the baseline
    worse = F.when(F.col("gate").isin(*HIGHER), limit - F.col("cn")).otherwise(F.col("cn") - limit)
    passed = F.when(F.col("bo") != F.col("co"), False).when(F.col("bo") == 0, True).when(held_of.isNotNull() & (held_of != F.col("bo")), False).otherwise(worse <= allowed)
    return both.select("gate", passed.alias("passed"), allowed.alias("allowed"), limit.alias("limit"), "cn", "co")


def latency_table(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Shares are of the summed time of requests; both tiers count for a stage. strong is NULL without escalation.

    rows: total_s, route_s, candidates, fast and strong structs (total_s, tokenize_s, prefill_s, score_s, checkpoint). Where the tiers have
    prefilled_tokens and prompt_tokens, and the rows peak_memory_gb, the table has their percentiles and the peak. Percentiles are by
    nearest rank, and exact (`selection`); rows are read once for the sums and once for each pass of theirs.
    """
    both = lambda stage: F.sum(F.coalesce(F.col(f"fast.{stage}"), F.lit(0.0)) + F.coalesce(F.col(f"strong.{stage}"), F.lit(0.0)))
    whole = F.sum("total_s")
    shares = {f"{s}_share": both(f"{s}_s") / whole for s in ("tokenize", "prefill", "score")}
    hits = lambda tier: F.try_divide(F.count_if(F.col(f"{tier}.checkpoint") == "hit").cast("double"), F.count_if(F.col(f"{tier}.checkpoint").isin("hit", "miss")))
    named = {f.name for f in rows.schema["fast"].dataType.fields}
    rows = rows.withColumns({"_strong_s": F.col("strong.total_s")} | {f"_{t}_{n}": F.col(f"{t}.{n}") for t in ("fast", "strong") for n in ("prefilled_tokens", "prompt_tokens") if n in named})
    at = {"p50_s": ("total_s", 0.5), "p95_s": ("total_s", 0.95), "strong_p50_s": ("_strong_s", 0.5), "candidates_p50": ("candidates", 0.5)}
    at |= {f"{t}_prefill_tokens_p50": (f"_{t}_prefilled_tokens", 0.5) for t in ("fast", "strong") if "prefilled_tokens" in named}
    at |= {f"prompt_tokens_p{round(100 * q)}": ("_fast_prompt_tokens", q) for q in (0.5, 0.95) if "prompt_tokens" in named}
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("total_s").alias("mean_s"), *(c.alias(name) for name, c in shares.items()), (F.sum("route_s") / whole).alias("route_share"),
        F.count("strong").alias("escalated"), hits("fast").alias("fast_hit_rate"), hits("strong").alias("strong_hit_rate"), F.max("candidates").alias("candidates_max"),
        *([F.max("peak_memory_gb").alias("peak_memory_gb_max")] * ("peak_memory_gb" in rows.columns)),
    )
    out = out.withColumn("other_share", 1 - F.col("tokenize_share") - F.col("prefill_share") - F.col("score_share") - F.col("route_share"))
    values = selection.percentiles(rows, keys, {name: (column, "nearest", q) for name, (column, q) in at.items()}).withColumn("candidates_p50", F.col("candidates_p50").cast("int"))
    values = values.select(F.struct(*keys, F.lit(0).alias("_")).alias("_key"), *at)
    return out.withColumn("_key", F.struct(*keys, F.lit(0).alias("_"))).join(values, "_key", "left").drop("_key")


def head_agreement(rows: DataFrame, reference: DataFrame, id_col: str = "id") -> DataFrame:
    """n, operation and used_heads: shares of rows whose choices are the reference's. choices: map<string,string>."""
    both = rows.join(reference.select(id_col, F.col("choices").alias("ref")), id_col)
    same = lambda q: F.try_element_at(F.col("choices"), q).eqNullSafe(F.try_element_at(F.col("ref"), q))
    return both.agg(F.count("*").alias("n"), F.avg(same(F.lit("operation")).cast("double")).alias("operation"), F.avg(F.forall("used_heads", same).cast("double")).alias("used_heads"))


def rejudge(rows: DataFrame, fixtures: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows with their fixtures; a row without one ends the job."""
    known = fixtures.withColumn("_known", F.lit(True))
    return rows.join(known, id_col, "left").withColumn("_checked", F.when(F.col("_known").isNull(), F.raise_error(F.concat(F.lit("no fixture for "), F.col(id_col).cast("string"))).cast("boolean")).otherwise(True)).filter("_checked").drop("_known", "_checked")

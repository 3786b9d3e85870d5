"""Routing between a fast and a strong tier: one ordered chain of rules over the fast tier's answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Operations that always escalate, effects that nobody confirmed, chords that are safe, ends of a task.
RISKY_OPS = ("DONE", "BLOCKED")
UNCONFIRMED = ("unverifiable", "suspected_noop")
SAFE_KEYS = ("cmd+s", "cmd+f", "cmd+c", "tab", "escape")
TERMINAL = ("DONE", "BLOCKED", "ASK")


def is_undo(op: Column, target: Column) -> Column:
    text = F.coalesce(target, F.lit(""))
    return F.coalesce(op == "CLICK", F.lit(False)) & (F.contains(text, F.lit("撤销")) | F.contains(F.lower(text), F.lit("undo")))


def decide(op: Column, has_operation: Column, conf: Column, last_effect: Column, chord: Column, has_chord: Column, target: Column, threshold: float = 0.94, judge_threshold: float = 0.8) -> Column:
    """struct(escalate, reason): the first rule that applies. conf: the least of the operation's and its heads'; NULL counts as 0."""
    conf = F.coalesce(conf, F.lit(0.0))
    is_op = lambda *names: F.coalesce(op.isin(*names), F.lit(False))
    unsafe = is_op("KEY") & has_chord & ~F.lower(F.coalesce(chord, F.lit(""))).isin(*SAFE_KEYS)
    rule = lambda escalate, reason: F.struct(F.lit(escalate).alias("escalate"), F.lit(reason).alias("reason"))
    chain = F.when(~has_operation & (conf < judge_threshold), rule(True, "judge_low_conf")).when(~has_operation, rule(False, "judge_ok"))
    chain = chain.when(is_op("DONE") & F.coalesce(last_effect.isin(*UNCONFIRMED), F.lit(False)), rule(True, "unverified_last"))
    for risky in RISKY_OPS:
        chain = chain.when(is_op(risky), rule(True, f"risky_{risky}"))
    chain = chain.when(unsafe, rule(True, "risky_KEY")).when(is_undo(op, target), rule(True, "risky_undo"))
    return chain.when(conf < threshold, rule(True, "low_conf")).otherwise(rule(False, "fast_ok"))


def with_decision(rows: DataFrame, threshold: float = 0.94, judge_threshold: float = 0.8) -> DataFrame:
    """Adds escalate, reason and conf to rows of op, has_operation, op_conf, head_conf, last_effect, chord, target_text.

    head_conf is NULL without heads; an operation without a probability has none, so its NULL counts as 0.
    """
    own = F.coalesce("op_conf", F.lit(0.0))
    conf = F.least(own, F.coalesce("head_conf", own))
    made = decide(F.col("op"), F.col("has_operation"), conf, F.col("last_effect"), F.col("chord"), F.col("chord").isNotNull(), F.col("target_text"), threshold, judge_threshold)
    return rows.withColumns({"conf": conf, "_d": made}).select("*", "_d.escalate", "_d.reason").drop("_d")


def route(rows: DataFrame, strong: DataFrame, key: str, keep_done_over_undo: bool = True) -> DataFrame:
    """Final operation and record. Only escalated rows meet the strong tier's answers (key, strong_op, strong_target)."""
    joined = rows.join(strong, key, "left")
    escalated = F.col("escalate")
    kept = F.lit(keep_done_over_undo) & escalated & F.col("reason").isin("risky_DONE", "unverified_last") & is_undo(F.col("strong_op"), F.col("strong_target"))
    both_end = escalated & F.coalesce(F.col("op").isin(*TERMINAL) & F.col("strong_op").isin(*TERMINAL), F.lit(False))
    return joined.withColumns({
        "final_op": F.when(escalated & ~kept, F.col("strong_op")).otherwise(F.col("op")),
        "by": F.when(escalated & ~kept, "strong").otherwise("fast"),
        "final_reason": F.when(kept, "done_kept_over_undo").otherwise(F.col("reason")),
        "confirmed": both_end & (F.col("op") == F.col("strong_op")),
        "heads_from": F.when(both_end, "own of strong, rest of fast").when(escalated & ~kept, "strong").otherwise("fast"),
        "fast_conf": F.round("conf", 4),
    })

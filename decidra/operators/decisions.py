"""Decisions over whole answer maps: predictors, two-stage scoring, choices, confidence, routing and gates from choices.

Columns: `questions` is map<string, struct<type, keys array<string>, texts map<string,string>>>, `answers` is
map<string, struct<choice, noul, score, probabilities map<string,double>>>, `references` and `choices` are map<string,string>
of question to option. All rules are expressions over one row; only two-stage scoring, whose rows are questions, shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from decidra.functions import prob as P
from decidra.functions.text import TEXT_OPS, heads_for, let
from decidra.operators import replay, router

#: Heads that hold a text value, and from which sizes on a state is long and a question large.
VALUE_HEADS = ("type_text_value",)
LONG_STATE_CHARS, LARGE_CANDIDATES = 5200, 52


# --- predictors and scoring: rows are (item, question)


def baseline_predictions(questions: DataFrame, kind: str) -> DataFrame:
    """questions (with keys and ref) with ps: 'uniform' over the options, the floor, or the 'reference' itself, the ceiling."""
    flat = let(F.size("keys"), lambda k: F.transform("keys", lambda _: F.lit(1.0) / k))
    return questions.withColumn("ps", {"uniform": flat, "reference": F.col("ref")}[kind])


def uses(op: Column, qid: Column) -> Column:
    """Whether an operation uses a question; the row form of heads_for."""
    own = F.startswith(qid, F.concat(F.lower(op), F.lit("_")))
    return F.coalesce(own | (op.isin(*TEXT_OPS) & (qid == "type_text_value")) | ((op == "REPLACE_TEXT") & (qid == "replace_from")), F.lit(False))


def predict(rows: DataFrame, item: list[str], two_stage: bool = False, terminal_heads: bool = True) -> DataFrame:
    """rows (item, qid, keys, logits) with ps and scored: one distribution for each question.

    In two stages the operation is scored first, then only the heads that it uses; after a terminal operation all heads, or
    with terminal_heads off that operation's own. A question not scored is uniform and marked. Items without an operation
    are scored whole.
    """
    ps = P.normalize(P.softmax(F.col("logits")))
    if not two_stage:
        return rows.withColumns({"ps": ps, "scored": F.lit(True)})
    whole = Window.partitionBy(*item)
    op = F.max(F.when(F.col("qid") == "operation", F.element_at("keys", P.argmax(F.col("logits"))))).over(whole)
    needed = F.col("_op").isNull() | (F.col("qid") == "operation") | uses(F.col("_op"), F.col("qid"))
    if terminal_heads:
        needed = needed | F.col("_op").isin(*router.TERMINAL)
    flat = let(F.size("keys"), lambda k: F.transform("keys", lambda _: F.lit(1.0) / k))
    return rows.withColumn("_op", op).withColumn("scored", needed).withColumn("ps", F.when(F.col("scored"), ps).otherwise(flat)).drop("_op")


# --- one row is a step


def answer_top(answer: Column) -> Column:
    """The top probability of an answer; one that is missing or empty has 0."""
    return P.top_prob(F.map_values(answer["probabilities"]), answer["noul"])


def choice_of(answers: Column, qid: str) -> Column:
    return F.try_element_at(answers, F.lit(qid))["choice"]


def confidence(answers: Column, qids: Column) -> Column:
    """The least top probability of the operation and the heads that it uses; without an operation that of all answers, or 0."""
    top = lambda q: F.coalesce(answer_top(F.try_element_at(answers, q)), F.lit(0.0))
    acting = lambda heads: F.array_min(F.transform(F.concat(F.array(F.lit("operation")), heads), top))
    judging = F.coalesce(F.array_min(F.transform(F.map_values(answers), answer_top)), F.lit(0.0))
    heads = heads_for(F.coalesce(choice_of(answers, "operation"), F.lit("")), qids)
    return F.when(F.map_contains_key(answers, F.lit("operation")), let(heads, acting)).otherwise(judging)


def target_text(questions: Column, answers: Column) -> Column:
    """The text of the option that click_target chose; empty if there is none."""
    texts = F.try_element_at(questions, F.lit("click_target"))["texts"]
    return F.coalesce(F.try_element_at(texts, choice_of(answers, "click_target")), F.lit(""))


def decide_answers(rows: DataFrame, threshold: float = 0.94, judge_threshold: float = 0.8) -> DataFrame:
    """Adds conf, escalate and reason to rows of questions, answers and last_effect."""
    answers, questions = F.col("answers"), F.col("questions")
    facts = rows.withColumns({
        "conf": confidence(answers, F.map_keys(questions)), "_op": choice_of(answers, "operation"), "_has_op": F.map_contains_key(answers, F.lit("operation")),
        "_has_chord": F.map_contains_key(questions, F.lit("key_target")), "_chord": choice_of(answers, "key_target"), "_target": target_text(questions, answers),
    })
    made = router.decide(F.col("_op"), F.col("_has_op"), F.col("conf"), F.col("last_effect"), F.col("_chord"), F.col("_has_chord"), F.col("_target"), threshold, judge_threshold)
    return facts.withColumn("_d", made).select("*", "_d.escalate", "_d.reason").drop("_d", "_op", "_has_op", "_has_chord", "_chord", "_target")


def route_answers(rows: DataFrame, strong: DataFrame, key: str, keep_done_over_undo: bool = True, merge_terminal: bool = True) -> DataFrame:
    """Final answers and record of decided rows. strong (key, answers) is joined to the rows that escalate and no others.

    Where both tiers end the task, the strong one scored only its operation's own heads, so the others stay the fast one's
    (not with merge_terminal off, as over HTTP). A DONE isn't given up for an undo.
    """
    asked = rows.filter("escalate").join(strong.select(key, F.col("answers").alias("strong")), key, "left")
    joined = asked.unionByName(rows.filter("NOT coalesce(escalate, false)").withColumn("strong", F.lit(None).cast(dict(rows.dtypes)["answers"])))
    fast, qids = F.col("answers"), F.map_keys("questions")
    ops = joined.withColumns({"_fast_op": choice_of(fast, "operation"), "_strong_op": choice_of(F.col("strong"), "operation")})
    both_end = F.col("escalate") & F.coalesce(F.col("_fast_op").isin(*router.TERMINAL) & F.col("_strong_op").isin(*router.TERMINAL), F.lit(False))
    own = F.concat(F.array(F.lit("operation")), heads_for(F.coalesce("_strong_op", F.lit("")), qids))
    taken = F.map_filter("strong", lambda q, _: F.array_contains(F.col("_own"), q))
    merged = F.map_concat(F.map_filter(fast, lambda q, _: ~F.map_contains_key(F.col("_taken"), q)), F.col("_taken"))
    swapped = ops.withColumns({"_both": both_end, "_own": own}).withColumn("_taken", taken)
    swapped = swapped.withColumn("_new", F.when(F.col("_both") & F.lit(merge_terminal), merged).otherwise(F.col("strong")))
    undo = router.is_undo(choice_of(F.col("_new"), "operation"), target_text(F.col("questions"), F.col("_new")))
    kept = F.lit(keep_done_over_undo) & F.col("escalate") & F.col("reason").isin("risky_DONE", "unverified_last") & undo
    by_strong = F.col("escalate") & ~F.col("_kept")
    final = swapped.withColumn("_kept", F.coalesce(kept, F.lit(False)))
    return final.withColumns({
        "final_answers": F.when(by_strong, F.col("_new")).otherwise(fast), "by": F.when(by_strong, "strong").otherwise("fast"),
        "final_reason": F.when(F.col("_kept"), "done_kept_over_undo").otherwise(F.col("reason")), "fast_conf": F.round("conf", 4),
        "confirmed": F.lit(merge_terminal) & F.col("_both") & (F.col("_fast_op") == F.col("_strong_op")),
    }).drop("strong", "_fast_op", "_strong_op", "_both", "_own", "_taken", "_new", "_kept")


def choices(questions: Column, answers: Column) -> Column:
    """map<question, option>: the top option of each question's answer, NULL where an answer is missing or gives no distribution."""

    def chosen(qid: Column, q: Column) -> Column:
        made = lambda a: P.from_answer(q["type"], q["keys"], a["noul"], a["choice"], a["score"], F.when(F.cardinality(a["probabilities"]) > 0, a["probabilities"]))
        return let(let(F.try_element_at(answers, qid), made), lambda ps: F.when(P.valid(ps), F.element_at(q["keys"], P.argmax(ps))))

    return F.transform_values(questions, chosen)


def judge_choices(rows: DataFrame, offered: Column | None = None) -> DataFrame:
    """Adds the eleven gate outcomes to rows of choices, references and questions. offered: map<question, array of options> that an
    input transformation kept; by default the questions' own."""
    chosen, refs = F.col("choices"), F.col("references")
    gold, op = F.try_element_at(refs, F.lit("operation")), F.try_element_at(chosen, F.lit("operation"))
    labelled = F.filter(F.map_keys(refs), lambda q: q != "operation")
    right = lambda q: F.coalesce(F.try_element_at(chosen, q) == F.try_element_at(refs, q), F.lit(False))
    of_kind = lambda heads, values: F.filter(heads, lambda q: q.isin(*VALUE_HEADS) if values else ~q.isin(*VALUE_HEADS))
    used = lambda o, values: let(of_kind(heads_for(F.coalesce(o, F.lit("")), F.map_keys(refs)), values), lambda heads: F.when(F.size(heads) > 0, F.forall(heads, right)))
    of = lambda q: F.coalesce(F.try_element_at(offered, q), F.try_element_at(F.col("questions"), q)["keys"]) if offered is not None else F.try_element_at(F.col("questions"), q)["keys"]
    retained = F.forall(labelled, lambda q: F.coalesce(F.array_contains(of(q), F.try_element_at(refs, q)), F.lit(False)))
    facts = {"_targets": used(op, False), "_values": used(gold, True), "_all_targets": F.forall(of_kind(labelled, False), right), "_all_values": F.forall(of_kind(labelled, True), right), "_retained": retained}
    c = F.col
    gates = replay.judge(op, gold, c("_targets"), c("_values"), c("_all_targets"), c("_all_values"), c("_targets"), c("_retained"))
    return rows.withColumns(facts).withColumns(gates).drop(*facts)


def max_options(questions: Column, references: Column) -> Column:
    """The longest option list of a labelled question other than the operation; 0 if there is none."""
    sizes = F.transform(F.filter(F.map_keys(references), lambda q: q != "operation"), lambda q: F.size(F.try_element_at(questions, q)["keys"]))
    return F.coalesce(F.array_max(sizes), F.lit(0))


def categories_of(state: Column, questions: Column, references: Column, ambiguous: Column, terminal_pair: Column) -> Column:
    """The categories of an item, in order. state: its compact JSON; references: map<question, gold option>."""
    gold = F.try_element_at(references, F.lit("operation"))
    rules = {
        "long_context": F.length(state) >= LONG_STATE_CHARS,
        "large_candidates": max_options(questions, references) > LARGE_CANDIDATES,
        "exact_text": F.arrays_overlap(F.map_keys(references), F.array(*(F.lit(h) for h in VALUE_HEADS))),
        "ambiguity": F.coalesce(gold == "ASK", F.lit(False)) | F.coalesce(ambiguous, F.lit(False)),
        "terminal": F.coalesce(gold == "DONE", F.lit(False)) | F.coalesce(terminal_pair, F.lit(False)),
    }
    return F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items())))

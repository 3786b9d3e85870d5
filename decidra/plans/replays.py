"""Replay, latency and routing reports over the derived steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from decidra.functions.text import heads_for, session_of, split_of, step_key
from decidra.operators import replay as R
from decidra.operators import router as T
from decidra.operators import selection
from decidra.plans.registry import query, table
from decidra.plans.scoring import rounded
from decidra.plans.views import V_STEPS, steps, with_views


@query("session_split", "SELECT DISTINCT user_id AS session, CASE WHEN ('0x' || sha256('replay-v1:' || user_id)[1:8])::BIGINT / 4294967295.0::DOUBLE < 0.3 THEN 'holdout' ELSE 'dev' END AS split FROM events")
def session_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("session")).distinct()
    return users.withColumn("split", split_of(F.col("session").cast("string")))


#: Ids with sessions, numbered steps and live parts, made of the conversations.
IDS = "'hands/' || role || '/' || conv_id || '/' || turn || CASE WHEN turn % 3 = 0 THEN '/live' || turn ELSE '' END"


@query("replay_order", f"""WITH i AS (SELECT {IDS} AS id, conv_id * 1000 + turn AS ord, 'hands/' || role || '/' || conv_id AS session, turn FROM conversations)
  SELECT id, session, min(ord) OVER (PARTITION BY session) AS session_first, row_number() OVER (PARTITION BY session ORDER BY turn) AS position FROM i""")
def replay_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.expr(IDS).alias("id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"))
    rows = rows.withColumns({"session": session_of(F.col("id")), "key": step_key(F.col("id"))})
    return R.order_for_replay(rows, "session", ["key"], "ord").select("id", "session", "session_first", "position")


@query("categories", with_views(V_STEPS, "SELECT event_id, list_aggregate(categories, 'string_agg', ',') AS categories FROM v_steps"))
def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = F.when(F.size("categories") > 0, F.array_join("categories", ","))
    return steps(spark, sf_dir).select("event_id", joined.alias("categories"))


RUN_KEY = "('0x' || md5('7:{what}:' || user_id)[1:8])::BIGINT"


@query("contiguous_runs", f"""WITH s AS (SELECT user_id, count(*) AS n, least(count(*), 8) AS take, {RUN_KEY.format(what='turn')} AS turn, {RUN_KEY.format(what='start')} % (count(*) - least(count(*), 8) + 1) AS start FROM events GROUP BY user_id
  ), k AS (SELECT user_id, start, least(take, 300 - (upto - take)) AS take FROM (SELECT *, sum(take) OVER (ORDER BY turn, user_id ROWS UNBOUNDED PRECEDING) AS upto FROM s) WHERE upto - take < 300
  ), e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS rn FROM events)
  SELECT user_id, event_id FROM e JOIN k USING (user_id) WHERE rn BETWEEN start AND start + take - 1""")
def contiguous_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.contiguous_runs(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id", 300, 8, "7")


@query("history_window", "SELECT conv_id, turn, string_agg(role, '>' ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS history FROM conversations")
def history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    past = F.collect_list("role").over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-3, -1))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.size(past) > 0, F.array_join(past, ">")).alias("history"))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps with their gates: CLICK and OPEN have a target head, TYPE_TEXT also a value head."""
    s = steps(spark, sf_dir)
    target = F.when(F.col("gold_op").isin("CLICK", "OPEN", "TYPE_TEXT"), F.col("target_ok"))
    value = F.when(F.col("gold_op") == "TYPE_TEXT", F.col("value_ok"))
    yes = F.lit(True)
    gates = R.judge(F.col("op"), F.col("gold_op"), target, value, F.coalesce(target, yes), F.coalesce(value, yes), F.col("target_ok"), F.coalesce(F.col("candidates") >= 1, F.lit(False)))
    return s.withColumns(gates)


V_JUDGED = (
    V_STEPS
    + """, t AS (SELECT *, CASE WHEN gold_op IN ('CLICK', 'OPEN', 'TYPE_TEXT') THEN target_ok END AS tok, CASE WHEN gold_op = 'TYPE_TEXT' THEN value_ok END AS vok,
    op IN ('TYPE_TEXT', 'APPEND_TEXT', 'REPLACE_TEXT', 'RENAME', 'DELETE', 'MOVE', 'SEND') AS wr FROM v_steps
), v_judged AS (
  SELECT event_id, categories, split, gold_op, op, op = gold_op AS operation,
    CASE WHEN op = gold_op THEN coalesce(tok, true) AND coalesce(vok, true) WHEN gold_op = 'CLICK' AND op = 'OPEN' THEN target_ok ELSE false END AS valid_action,
    op = gold_op AND coalesce(tok, true) AND coalesce(vok, true) AS valid_action_strict, CASE WHEN vok IS NOT NULL THEN op = gold_op AND vok END AS exact_text,
    coalesce(candidates >= 1, false) AS retention, CASE WHEN gold_op = 'ASK' THEN op = 'ASK' END AS ask, CASE WHEN gold_op <> 'ASK' THEN op = 'ASK' END AS over_ask,
    CASE WHEN gold_op <> 'DONE' THEN op = 'DONE' END AS false_done, CASE WHEN gold_op = 'DONE' THEN op <> 'DONE' END AS missed_done,
    CASE WHEN gold_op = 'DONE' THEN wr END AS write_on_done, CASE WHEN gold_op <> 'TYPE_TEXT' THEN wr END AS unauthorized FROM t
)"""
)
GATES = R.HIGHER + R.LOWER + R.INFO
TALLY = " UNION ALL ".join(f"SELECT {{keys}}'{g}' AS gate, count(*) FILTER (WHERE {g}) AS n, count({g}) AS of, round(count(*) FILTER (WHERE {g}) / nullif(count({g}), 0), 6) AS rate FROM {{rows}} {{group}}" for g in GATES)


@query("gate_judge", with_views(V_JUDGED, f"SELECT event_id, {', '.join(GATES)} FROM v_judged"))
def gate_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).select("event_id", *GATES)


@query("gate_table", with_views(V_JUDGED, TALLY.format(keys="", rows="v_judged", group="")))
def gate_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.tally(judged(spark, sf_dir), []))


BY_CATEGORY = ", c AS (SELECT *, unnest(list_concat(['all'], categories, ['split:' || split])) AS category FROM {rows})"


@query("gate_by_category", with_views(V_JUDGED, BY_CATEGORY.format(rows="v_judged") + " " + TALLY.format(keys="category, ", rows="c", group="GROUP BY category")))
def gate_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.tally(R.by_category(judged(spark, sf_dir)), ["category"]))


@query("gate_compare", with_views(V_JUDGED, ", g AS (" + TALLY.format(keys="split, ", rows="(SELECT * FROM v_judged WHERE event_id % 2 = 0)", group="GROUP BY split").replace("split, '", "'base' AS split, '").replace("GROUP BY split", "")
  + " UNION ALL " + TALLY.format(keys="split, ", rows="(SELECT * FROM v_judged WHERE event_id % 2 = 1)", group="").replace("split, '", "'cand' AS split, '") + """)
  SELECT b.gate, CASE WHEN b.of <> c.of THEN false WHEN b.of = 0 THEN true WHEN h.hof IS NOT NULL AND h.hof <> b.of THEN false
      WHEN b.gate IN ('valid_action', 'exact_text', 'retention', 'ask') THEN least(b.n, h.hn) - c.n <= al ELSE c.n - least(b.n, h.hn) <= al END AS passed, al AS allowed, least(b.n, h.hn) AS "limit", c.n AS cn, c.of AS co
  FROM (SELECT *, floor(CASE gate WHEN 'valid_action' THEN 0.01::DOUBLE ELSE 0 END * of)::BIGINT AS al FROM g WHERE split = 'base') b JOIN g c ON c.split = 'cand' AND b.gate = c.gate
  LEFT JOIN (VALUES ('unauthorized', 11, 281), ('write_on_done', 4, 79)) h(gate, hn, hof) ON b.gate = h.gate WHERE b.gate NOT IN ('operation', 'valid_action_strict', 'over_ask', 'missed_done')"""))  # fmt: skip
def gate_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = judged(spark, sf_dir)
    return R.compare(R.tally(j.filter("event_id % 2 = 0"), []), R.tally(j.filter("event_id % 2 = 1"), []))


@query("head_agreement", with_views(V_STEPS, """SELECT count(*) AS n, round(avg((op = gold_op)::INT::DOUBLE), 6) AS operation, round(avg((CASE WHEN op IN ('CLICK', 'OPEN') THEN target_ok WHEN op = 'TYPE_TEXT' THEN target_ok AND value_ok ELSE true END)::INT::DOUBLE), 6) AS used_heads
  FROM v_steps"""))
def head_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = steps(spark, sf_dir)
    choice = lambda op, t, v: F.create_map(F.lit("operation"), op, F.lit("target"), t, F.lit("value"), v)
    used = F.when(F.col("op").isin("CLICK", "OPEN"), F.array(F.lit("target"))).when(F.col("op") == "TYPE_TEXT", F.array(F.lit("target"), F.lit("value"))).otherwise(F.array().cast("array<string>"))
    right = lambda ok: F.when(ok, "same").otherwise("other")
    rows = s.select(F.col("event_id").alias("id"), choice(F.col("op"), right(F.col("target_ok")), right(F.col("value_ok"))).alias("choices"), used.alias("used_heads"))
    reference = s.select(F.col("event_id").alias("id"), choice(F.col("gold_op"), F.lit("same"), F.lit("same")).alias("choices"))
    return rounded(R.head_agreement(rows, reference))


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routed steps with both tiers' stage times, derived from total_s."""
    s = T.with_decision(steps(spark, sf_dir))
    tier = lambda share, e: F.struct((F.col("total_s") * share).alias("total_s"), (F.col("total_s") * (share * 0.125)).alias("tokenize_s"), (F.col("total_s") * (share * 0.5)).alias("prefill_s"), (F.col("total_s") * (share * 0.25)).alias("score_s"), e.alias("checkpoint"))
    state = F.when(F.col("event_id") % 4 == 0, "hit").when(F.col("event_id") % 4 == 1, "miss")
    return s.withColumns({"route_s": F.col("total_s") * 0.0625, "fast": tier(0.25, state), "strong": F.when(F.col("escalate"), tier(0.5, F.lit("miss")))})


V_ROUTED = (
    V_STEPS
    + """, v_routed AS (SELECT *, least(op_conf, head_conf) AS conf, CASE WHEN NOT has_operation AND least(op_conf, head_conf) < 0.8 THEN 'judge_low_conf' WHEN NOT has_operation THEN 'judge_ok'
    WHEN op = 'DONE' AND last_effect = 'unverifiable' THEN 'unverified_last' WHEN op = 'DONE' THEN 'risky_DONE'
    WHEN op = 'KEY' AND lower(chord) NOT IN ('cmd+s', 'cmd+f', 'cmd+c', 'tab', 'escape') THEN 'risky_KEY' WHEN op = 'CLICK' AND lower(target_text) LIKE '%undo%' THEN 'risky_undo'
    WHEN least(op_conf, head_conf) < 0.94 THEN 'low_conf' ELSE 'fast_ok' END AS reason FROM v_steps
), v_r AS (SELECT *, reason NOT IN ('judge_ok', 'fast_ok') AS escalate, CASE event_id % 4 WHEN 0 THEN 'hit' WHEN 1 THEN 'miss' END AS ck FROM v_routed)"""
)
LATENCY = """SELECT {keys} count(*) AS n, quantile_disc(total_s, 0.5) AS p50_s, quantile_disc(total_s, 0.95) AS p95_s, round(avg(total_s), 6) AS mean_s,
  round((sum(total_s * 0.03125) + coalesce(sum(total_s * 0.0625) FILTER (WHERE escalate), 0)) / sum(total_s), 6) AS tokenize_share, round((sum(total_s * 0.125) + coalesce(sum(total_s * 0.25) FILTER (WHERE escalate), 0)) / sum(total_s), 6) AS prefill_share,
  round((sum(total_s * 0.0625) + coalesce(sum(total_s * 0.125) FILTER (WHERE escalate), 0)) / sum(total_s), 6) AS score_share, round(sum(total_s * 0.0625) / sum(total_s), 6) AS route_share, count(*) FILTER (WHERE escalate) AS escalated,
  round(quantile_disc(total_s * 0.5, 0.5) FILTER (WHERE escalate), 6) AS strong_p50_s, round(count(*) FILTER (WHERE ck = 'hit') / nullif(count(ck), 0), 6) AS fast_hit_rate,
  CASE WHEN count(*) FILTER (WHERE escalate) > 0 THEN 0.0::DOUBLE END AS strong_hit_rate, quantile_disc(candidates, 0.5) AS candidates_p50, max(candidates) AS candidates_max,
  round(1 - (sum(total_s * 0.28125) + coalesce(sum(total_s * 0.4375) FILTER (WHERE escalate), 0)) / sum(total_s), 6) AS other_share FROM {rows} {group}"""


@query("latency_table", with_views(V_ROUTED, LATENCY.format(keys="", rows="v_r", group="")))
def latency_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.latency_table(timed(spark, sf_dir), []))


@query("latency_by_category", with_views(V_ROUTED, BY_CATEGORY.format(rows="v_r") + LATENCY.format(keys="category, ", rows="c", group="GROUP BY category")))
def latency_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.latency_table(R.by_category(timed(spark, sf_dir)), ["category"]))


@query("latency_floor_index", "SELECT event_type, list_sort(list(value))[floor(count(*) * 0.5::DOUBLE)::BIGINT + 1] AS p50, list_sort(list(value))[floor(count(*) * 0.95::DOUBLE)::BIGINT + 1] AS p95 FROM events GROUP BY event_type")
def latency_floor_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.percentiles(table(spark, sf_dir, "events"), ["event_type"], {"p50": ("value", "floor", 0.5), "p95": ("value", "floor", 0.95)})


@query("latency_median", "SELECT event_type, round(median(value), 6) AS p50 FROM events GROUP BY event_type")
def latency_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(selection.percentiles(table(spark, sf_dir, "events"), ["event_type"], {"p50": ("value", "median", 0.5)}))


@query("route_decide", with_views(V_ROUTED, "SELECT event_id, escalate, reason, conf FROM v_r"))
def route_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.with_decision(steps(spark, sf_dir)).select("event_id", "escalate", "reason", "conf")


@query("route_final", with_views(V_ROUTED, """, s AS (SELECT *, CASE WHEN event_id % 6 = 0 THEN 'CLICK' ELSE gold_op END AS sop, (event_id % 6 = 0 OR gold_op = 'CLICK') AND lower(target_text) LIKE '%undo%' AS sundo FROM v_r
  ), k AS (SELECT *, escalate AND reason IN ('risky_DONE', 'unverified_last') AND sundo AS kept FROM s)
  SELECT event_id, CASE WHEN escalate AND NOT kept THEN sop ELSE op END AS final_op, CASE WHEN escalate AND NOT kept THEN 'strong' ELSE 'fast' END AS "by", CASE WHEN kept THEN 'done_kept_over_undo' ELSE reason END AS final_reason,
    escalate AND op IN ('DONE', 'BLOCKED', 'ASK') AND sop IN ('DONE', 'BLOCKED', 'ASK') AND op = sop AS confirmed, round(conf, 4) AS fast_conf FROM k"""))
def route_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    fast = T.with_decision(steps(spark, sf_dir))
    # the strong tier answers escalated rows only
    strong = fast.filter("escalate").select("event_id", F.when(F.col("event_id") % 6 == 0, "CLICK").otherwise(F.col("gold_op")).alias("strong_op"), F.col("target_text").alias("strong_target"))
    return T.route(fast, strong, "event_id").select("event_id", "final_op", "by", "final_reason", "confirmed", "fast_conf")


@query("routing_reasons", with_views(V_ROUTED, "SELECT reason, count(*) AS n FROM v_r GROUP BY reason"))
def routing_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.with_decision(steps(spark, sf_dir)).groupBy("reason").agg(F.count("*").alias("n"))


HEADS = ("operation", "click_target", "open_target", "type_text_target", "type_text_value", "delete_target", "key_target")


@query("two_stage_heads", with_views(V_STEPS, """SELECT event_id, CASE WHEN op IN ('DONE', 'ASK') THEN 'operation,click_target,open_target,type_text_target,type_text_value,delete_target,key_target' ELSE
  'operation,' || CASE op WHEN 'CLICK' THEN 'click_target' WHEN 'OPEN' THEN 'open_target' WHEN 'TYPE_TEXT' THEN 'type_text_target,type_text_value' WHEN 'DELETE' THEN 'delete_target' ELSE 'key_target' END END AS heads FROM v_steps"""))
def two_stage_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.array(*(F.lit(h) for h in HEADS))
    own = F.concat(F.array(F.lit("operation")), heads_for(F.col("op"), asked))
    return steps(spark, sf_dir).select("event_id", F.array_join(F.when(F.col("op").isin(*T.TERMINAL), asked).otherwise(own), ",").alias("heads"))

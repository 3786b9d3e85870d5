"""Accuracy of items and heads, probes, request statistics, log alignment, drawn groups, validation and costs over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decidra.functions.text import options_left
from decidra.operators import decisions as D
from decidra.operators import builders, fixtures, public_tasks, replay, slices, traces
from decidra.plans.decisions import V_ANSWERS, decided
from decidra.plans.registry import query, table
from decidra.plans.scoring import rounded
from decidra.plans.views import with_views
from decidra.sources import io
from decidra.sources.staging import shared_dir
from decidra.streaming import answers, routing

GOLD = "CASE event_type WHEN 'click' THEN 'CLICK' WHEN 'view' THEN 'OPEN' WHEN 'signup' THEN 'TYPE_TEXT' WHEN 'purchase' THEN 'DONE' ELSE 'ASK' END"


@query("item_accuracy", with_views(V_ANSWERS, f""", g AS (SELECT s.*, {GOLD} AS gold FROM s JOIN events ON e = event_id WHERE tier = 1 AND e % 31 <> 0
  ), h AS (
    SELECT e, gold AS kind, 'operation' AS head, coalesce(op = gold OR (gold = 'CLICK' AND e % 6 = 0 AND op = 'OPEN'), false) AS ok FROM g UNION ALL
    SELECT e, gold, 'click_target', coalesce(click = (e % 3 + 1)::VARCHAR, false) FROM g WHERE gold = 'CLICK' AND op = 'CLICK' UNION ALL
    SELECT e, gold, 'type_text_value', coalesce(val = (e % 2 + 1)::VARCHAR, false) FROM g WHERE gold = 'TYPE_TEXT' AND op = 'TYPE_TEXT'
  ), i AS (SELECT e, kind, bool_and(ok) AS ok FROM h GROUP BY ALL)
  SELECT 'all' AS level, 'all' AS name, count_if(ok) AS "right", count(*) AS n FROM i UNION ALL SELECT 'kind', kind, count_if(ok), count(*) FROM i GROUP BY ALL UNION ALL SELECT 'head', head, count_if(ok), count(*) FROM h GROUP BY ALL"""))
def item_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    sure = lambda option: F.create_map(option.cast("string"), F.lit(1.0))
    entry = lambda when, head, probs: F.when(when, F.struct(F.lit(head).alias("key"), probs.alias("value")))
    either = F.create_map(F.lit("CLICK"), F.lit(0.5), F.lit("OPEN"), F.lit(0.5))
    refs = F.map_from_entries(F.array_compact(F.array(
        entry(F.lit(True), "operation", F.when((F.col("gold") == "CLICK") & (e % 6 == 0), either).otherwise(sure(F.col("gold")))), entry(F.col("gold") == "CLICK", "click_target", sure(e % 3 + 1)),
        entry(F.col("gold") == "TYPE_TEXT", "type_text_value", sure(e % 2 + 1)),
    )))
    rows = decided(spark, sf_dir).withColumn("choices", F.when(e % 31 != 0, D.choices(F.col("questions"), F.col("answers"))))
    return slices.item_accuracy(slices.judged_heads(rows.select(e.alias("id"), F.col("gold").alias("kind"), refs.alias("references"), "choices")))


@query("probe_ops", with_views(V_ANSWERS, f""", g AS (SELECT s.*, event_type, {GOLD} AS gold FROM s JOIN events ON e = event_id WHERE tier = 1)
  SELECT event_type, count(*) AS n, count_if(CASE WHEN e % 2 = 0 THEN op IS DISTINCT FROM 'DONE' ELSE op IS NOT DISTINCT FROM gold END) AS hits, count_if(op = 'CLICK') AS CLICK, count_if(op = 'DONE') AS DONE FROM g GROUP BY event_type"""))
def probe_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decided(spark, sf_dir).select("event_type", D.choice_of(F.col("answers"), "operation").alias("op"), F.when(F.col("event_id") % 2 == 0, "not:DONE").otherwise(F.col("gold")).alias("expected"))
    return slices.probes(rows, "event_type", "op", "expected", ["CLICK", "DONE"])


@query("request_stats", with_views(V_ANSWERS, """, q AS (SELECT value, op, CASE WHEN reason IN ('judge_ok', 'fast_ok') THEN 'fast' ELSE 'strong' END AS tier_by, reason FROM d JOIN events ON e = event_id
  ), w AS (SELECT value, 'all' AS what, 'requests' AS name FROM q UNION ALL SELECT value, 'op', op FROM q UNION ALL SELECT value, 'by', tier_by FROM q UNION ALL SELECT value, 'reason', reason FROM q)
  SELECT what, name, count(*) AS n, round(median(value), 6) AS p50_s, round(avg(value), 6) AS mean_s FROM w GROUP BY ALL"""))
def request_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.decide_answers(decided(spark, sf_dir)).join(table(spark, sf_dir, "events").select("event_id", "value"), "event_id")
    rows = rows.select("value", D.choice_of(F.col("answers"), "operation").alias("op"), F.when(F.col("escalate"), "strong").otherwise("fast").alias("by"), "reason")
    return rounded(slices.request_stats(rows, "value", "op", "by", "reason"))


@query("aligned_log", "SELECT o_orderkey, o_orderstatus AS op, row_number() OVER (ORDER BY o_orderkey) + 24 AS line FROM orders")
def aligned_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in order of their key, and a log with 25 lines more before them."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("op"))
    earlier = spark.range(25).select((F.col("id") - 1000).alias("o_orderkey"), F.lit("?").alias("final_op"))
    log = earlier.unionByName(rows.withColumnRenamed("op", "final_op"))
    numbered = traces.numbered(log, ["o_orderkey"], "line")
    return traces.aligned(rows, numbered, ["o_orderkey"]).select("o_orderkey", "op", "line")


@query("fixture_groups", """
  WITH g AS (SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) >= 4 ORDER BY ('0x' || md5('groups|' || conv_id)[1:8])::BIGINT, conv_id LIMIT 14) SELECT conv_id, turn FROM conversations WHERE conv_id IN (FROM g)""")
def fixture_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.whole_groups(table(spark, sf_dir, "conversations"), "conv_id", 14, 4).select("conv_id", "turn")


@query("question_errors", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'q: 2 to 10 levels' WHEN 2 THEN 'q: duplicate key' WHEN 3 THEN 'q: 1 to 255 options' ELSE 'q: no such type' END AS error FROM events")
def question_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = (
        '{"type": "choice", "criteria": {"a": 1, "b": {"c": 2}}}', '{"type": "score", "criteria": ["low"]}', '{"type": "choice", "criteria": [{"key": "a", "description": 1}, {"key": "a", "description": 2}]}',
        '{"type": "choice", "criteria": {}}', '{"type": "order"}',
    )
    asked = F.create_map(F.lit("q"), F.element_at(F.array(*(F.lit(k) for k in kinds)), (F.col("event_id") % 5 + 1).cast("int")))
    return table(spark, sf_dir, "events").select("event_id", F.get(io.question_errors(asked), 0).alias("error"))


@query("prediction_cost", "SELECT conv_id, round(sum(length(text)) * 0.042 / 1e6, 9) AS cost_usd FROM conversations GROUP BY conv_id")
def prediction_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(F.length("text")).alias("input_tokens"))
    return rounded(io.with_cost(used).select("conv_id", "cost_usd"), 9)


@query("train_sets", "SELECT 'benchmark' AS train_set, count(*) AS n, count(item_id) AS with_id FROM benchmark UNION ALL SELECT 'documents', count(*), 0 FROM documents")
def train_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = public_tasks.train_rows({name: table(spark, sf_dir, name) for name in ("documents", "benchmark")})
    return rows.groupBy("train_set").agg(F.count("*").alias("n"), F.count("item_id").alias("with_id"))


@query("first_items", "SELECT item_id, length(text)::INT AS n FROM benchmark ORDER BY item_id LIMIT 20")
def first_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report's limit: the first 20 items in order."""
    return io.first_rows(table(spark, sf_dir, "benchmark"), ["item_id"], 20).select("item_id", F.length("text").alias("n"))


@query("family_states", """SELECT event_type, count(*) AS states, count_if(event_id % 7 <> 0 AND event_id % 3 <> 0) AS op_right, count_if(event_id % 7 <> 0 AND event_id % 3 <> 0 AND event_id % 2 = 0) AS all_right
  FROM events GROUP BY ROLLUP (event_type)""")
def family_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    items = table(spark, sf_dir, "events").select("event_id", "event_type")
    answered = items.filter(e % 7 != 0).select("event_id", (e % 3 != 0).alias("op_ok"), (e % 2 == 0).alias("target_ok"))
    return slices.family_states(items, answered, "event_id", "event_type")


@query("replay_modes", """SELECT mode, count(*) AS steps, count_if(mode = 'cold' OR position = 1) AS fresh
  FROM (SELECT row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS position FROM events), (SELECT unnest(['cold', 'warm']) AS mode) GROUP BY mode""")
def replay_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = replay.order_for_replay(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", ["event_id"], "event_id")
    return replay.with_modes(ordered).groupBy("mode").agg(F.count("*").alias("steps"), F.count_if("fresh").alias("fresh"))


@query("fixture_tags", """SELECT event_id, 'gym' AS "set", s AS session, CASE WHEN ('0x' || sha256('replay-v1:' || s)[1:8])::BIGINT / 4294967295.0::DOUBLE < 0.3 THEN 'holdout' ELSE 'dev' END AS split, event_type AS categories
  FROM (SELECT event_id, event_type, CASE WHEN event_id % 9 = 0 THEN 'given/' || user_id ELSE 'gym/' || user_id END AS s FROM events)""")
def fixture_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("id", F.concat_ws("/", F.lit("gym"), "user_id", "event_id"))
    given = F.when(F.col("event_id") % 9 == 0, F.concat(F.lit("given/"), "user_id"))
    return replay.tagged(rows, "gym", "id", F.array("event_type"), given).select("event_id", "set", "session", "split", F.array_join("categories", ",").alias("categories"))


@query("repeat_with_rest", "SELECT count(*) * 2 + count(*) // 3 AS n, count(*) AS items, 3::BIGINT AS most FROM benchmark")
def repeat_with_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").select("item_id")
    n = rows.count()
    each = builders.repeat_to(rows, 2 * n + n // 3, "item_id", "rest").groupBy("item_id").agg(F.count("*").alias("k"))
    return each.agg(F.sum("k").alias("n"), F.count("*").alias("items"), F.max("k").alias("most"))


@query("echoed_answers", """SELECT conv_id, turn, first_value(conv_id * 1000 + turn) OVER w AS answer, row_number() OVER w > 1 AS hit FROM conversations WINDOW w AS (PARTITION BY role, turn % 5 ORDER BY conv_id * 1000 + turn)""")
def echoed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = (F.col("conv_id") * 1000 + F.col("turn")).alias("ord")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", at, at.alias("answer"), F.concat_ws("|", "role", F.col("turn") % 5).alias("key"))
    return routing.echoed(rows, "key", "ord", "answer").select("conv_id", "turn", "answer", "hit")


@query("joined_sources", "SELECT 'benchmark' AS source_name, 0 AS source_ord, count(*) AS n, min(item_id) AS first FROM benchmark UNION ALL SELECT 'documents', 1, count(*), min(doc_id) FROM documents")
def joined_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = {"benchmark": table(spark, sf_dir, "benchmark").withColumn("at", F.col("item_id")), "documents": table(spark, sf_dir, "documents").withColumn("at", F.col("doc_id"))}
    return io.concatenated(parts, "at").groupBy("source_name", "source_ord").agg(F.count("*").alias("n"), F.min("ord").alias("first"))


#: A request's key has as many values as a server's memory can't hold; a repeat is a hit if fewer other keys than it holds came in between.
@query("cached_answers", """
  WITH r AS (SELECT event_id, 's' || user_id % 6 AS server, event_type || '/' || (props->>'$.k')::INT % 40 AS key FROM events
  ), n AS (SELECT *, lag(event_id) OVER (PARTITION BY server, key ORDER BY event_id) AS before FROM r
  ), b AS (SELECT n.event_id, count(DISTINCT r.key) AS others FROM n JOIN r ON r.server = n.server AND r.event_id > n.before AND r.event_id < n.event_id GROUP BY n.event_id)
  SELECT n.event_id, server, before IS NOT NULL AND coalesce(others, 0) < 64 AS hit, 'answer to ' || key AS answer FROM n LEFT JOIN b USING (event_id)""")
def cached_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests of six servers, as a stream whose state answers repeats."""
    e = table(spark, sf_dir, "events")
    key = F.concat("event_type", F.lit("/"), (F.get_json_object("props", "$.k").cast("int") % 40).cast("string"))
    rows = e.select(F.concat(F.lit("s"), (F.col("user_id") % 6).cast("string")).alias("server"), F.col("event_id").cast("string").alias("request_id"), F.col("event_id").alias("ord"), key.alias("key"), key.alias("payload"))
    made = answers.answered_table(rows, lambda payload: f"answer to {payload}", f"{shared_dir(spark)}/decidra/cached-{uuid.uuid4().hex}")
    return made.select(F.col("ord").alias("event_id"), "server", "hit", "answer")


@query("unused_options", "SELECT conv_id, array_to_string(list_sort(list_filter(['assistant', 'system', 'user'], lambda r: NOT list_contains(list(role), r))), ',') AS left_over FROM conversations GROUP BY conv_id")
def unused_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("used"))
    return used.select("conv_id", F.array_join(options_left(F.array(*map(F.lit, ("user", "system", "assistant"))), F.col("used")), ",").alias("left_over"))


RUNS = """SELECT id FROM (SELECT id, session, row_number() OVER (PARTITION BY session ORDER BY step) - 1 AS rn FROM i) JOIN (
      SELECT session, start, least(take, {n} - (upto - take)) AS take FROM (SELECT *, sum(take) OVER (ORDER BY turn, session ROWS UNBOUNDED PRECEDING) AS upto FROM (
        SELECT session, least(count(*), 8) AS take, ('0x' || md5('16:{name}:turn:' || session)[1:8])::BIGINT AS turn, ('0x' || md5('16:{name}:start:' || session)[1:8])::BIGINT % (count(*) - least(count(*), 8) + 1) AS start FROM i GROUP BY session)) WHERE upto - take < {n}
    ) USING (session) WHERE rn BETWEEN start AND start + take - 1"""
SCENES = """SELECT id FROM i JOIN (SELECT session FROM (SELECT DISTINCT session FROM i WHERE kind = '{first}') ORDER BY ('0x' || md5('16:{first}|' || session)[1:8])::BIGINT, session LIMIT {n}) USING (session) WHERE kind IN ({kinds})"""


@query("replay_sets", f"""WITH i AS (SELECT 'chat/' || conv_id || '/' || turn AS id, 'chat/' || conv_id AS session, turn AS step, role AS kind FROM conversations)
  SELECT 'gym' AS name, id FROM ({RUNS.format(name='gym', n=300)}) UNION ALL SELECT 'text', id FROM ({RUNS.format(name='text', n=30)}) UNION ALL
  SELECT 'pairs', id FROM i WHERE session IN (SELECT session FROM i GROUP BY session HAVING count(*) >= 2 ORDER BY ('0x' || md5('16:pairs|' || session)[1:8])::BIGINT, session LIMIT 14) UNION ALL
  SELECT 'large', id FROM (SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ('0x' || md5('16:large|' || id)[1:8])::BIGINT, id) AS turn FROM i WHERE kind = 'user') ORDER BY turn, session, id LIMIT 30) UNION ALL
  SELECT 'ambiguity', id FROM ({SCENES.format(first='system', n=15, kinds="'system', 'user'")}) UNION ALL SELECT 'ambiguity', id FROM ({SCENES.format(first='assistant', n=10, kinds="'assistant'")})""")
def replay_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five sets of conversations' turns, written with their manifest and read back by it."""
    part = F.concat(F.lit("chat/"), F.col("conv_id").cast("string"))
    items = table(spark, sf_dir, "conversations").select(F.concat(part, F.lit("/"), F.col("turn").cast("string")).alias("id"), part.alias("session"), F.col("turn").alias("step"), F.col("role").alias("kind"))
    pools = dict.fromkeys(("gym", "pairs", "ambiguity", "text"), items) | {"large": items.filter("kind = 'user'")}
    sets = fixtures.replay_sets(pools, "kind", {"system": (15, ["system", "user"]), "assistant": (10, ["assistant"])}, "16")
    root = f"{shared_dir(spark)}/decidra/sets-{uuid.uuid4().hex}"
    lines = {name: rows.select("id", F.to_json(F.struct("id", "session", "kind")).alias("value")) for name, rows in sets.items()}
    made = fixtures.write_sets(lines, root, {name: {"visibility": "public"} for name in lines}, name="replay", version="1")
    rows, _ = io.checked_fixtures(spark, root, [s | {"ord": i} for i, s in enumerate(made["sets"])])
    return rows.select(F.col("set").alias("name"), F.get_json_object("value", "$.id").alias("id"))

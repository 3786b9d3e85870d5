"""Prompts, imported traces, counterexamples, workflow evaluations and search tasks over rows made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decidra.operators import counterexamples, fixtures, prompts, search_tasks, steps, traces, workflows
from decidra.plans.registry import query, table
from decidra.plans.scoring import rounded

def asked_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, state, questions, references, teacher as JSON: an operation, its target and a check, with shared rules."""
    e = F.col("event_id")
    k = F.get_json_object("props", "$.k")
    text = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    rules = F.when(e % 2 == 0, '"r1", "r2", "only here"').otherwise('"r1", "r2"')
    return table(spark, sf_dir, "events").select(
        "event_id", F.to_json(F.struct(k.cast("int").alias("k"), F.col("event_type").alias("kind"))).alias("state"),
        text('{"operation": {"type": "choice", "instructions": {"goal": "Do ', k, '", "rules": [', rules, '], "ask": "What next?"}, "criteria": {"CLICK": "Press", "DONE": "Stop", "ASK": {"why": "unsure"}}}, ',
             '"sure": {"type": "noul", "instructions": {"goal": "Do ', k, '", "rules": ["r1", "r2", "x"]}, "criteria": {"true": "Yes it is"}}}').alias("questions"),
        text('{"operation": {"CLICK": ', F.when(e % 3 == 0, "1.0").otherwise("0.0"), ', "DONE": ', F.when(e % 3 == 1, "1.0").otherwise("0.0"), ', "ASK": ', F.when(e % 3 == 2, "1.0").otherwise("0.0"), '}}').alias("references"),
        F.lit('{"operation": {"CLICK": 0.5, "DONE": 0.25, "ASK": 0.25}}').alias("teacher"),
    )


PROMPT = """
  WITH r AS (SELECT event_id, props->>'$.k' AS k, event_type, event_id % 2 = 0 AS even FROM events
  ), p AS (
    SELECT event_id, even, '<state>' || chr(10) || '{"k":' || k || ',"kind":"' || event_type || '"}' || chr(10) || '</state>' || chr(10) || chr(10) || '<shared_instructions>' || chr(10)
      || '{"goal":"Do ' || k || '","rules":["r1","r2"]}' || chr(10) || '</shared_instructions>' || chr(10) || chr(10) AS head FROM r
  ), o AS (
    SELECT event_id, head || 'Question: ' || CASE WHEN even THEN '{"rules": ["only here"], "ask": "What next?"}' ELSE '{"ask": "What next?"}' END || chr(10) || 'Options:' || chr(10)
      || 'A. CLICK: Press' || chr(10) || 'B. DONE: Stop' || chr(10) || 'C. ASK: {"why": "unsure"}' || chr(10) || 'Answer with the option letter only.' AS prompt FROM p
  )"""


@query("rendered_prompts", PROMPT + """
  SELECT event_id, 'operation' AS qid, prompt FROM o UNION ALL
  SELECT event_id, 'sure', head || 'Question: {"rules": ["x"]}' || chr(10) || 'Yes means: Yes it is' || chr(10) || 'Answer Yes or No.' FROM p""")
def rendered_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.rendered(asked_rows(spark, sf_dir), "event_id", fmt=2).select("event_id", "qid", "prompt")


@query("training_examples", PROMPT + " SELECT event_id, 'operation' AS qid, prompt, (event_id % 3)::INT AS gold, 0.5::DOUBLE AS first FROM o")
def training_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.training_examples(asked_rows(spark, sf_dir), "event_id", fmt=2).select("event_id", "qid", "prompt", "gold", F.element_at("teacher", 1).alias("first"))


def trace_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, state, questions, label (JSON): every 5th row's label is a window's button, every 7th has two right answers, every 11th no operation."""
    e = F.col("event_id")
    text = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    target = F.when(e % 5 == 0, "2").when(e % 5 == 1, "3").otherwise("1")
    several = F.when(e % 7 == 0, ', "probabilities": {"1": 0.5, "3": 0.25}').otherwise("")
    return table(spark, sf_dir, "events").select(
        "event_id", F.when(e % 13 == 0, "planner").otherwise("oracle").alias("label_source"), F.lit("2").alias("oracle_version"),
        text('{"elements": [{"index": "1", "role": "row", "label": "a"}, {"index": "2", "role": "button", "label": "关闭按钮"}, {"index": "3", "role": "cell", "label": "b"}], "page": {"title": "Box"}, "effects_so_far": ["',
             F.when(e % 2 == 0, "renamed 'x' to 'y'").otherwise("looked around"), '"]}').alias("state"),
        F.lit('{"operation": {"type": "choice", "instructions": "?", "criteria": {"CLICK": "", "OPEN": "", "DONE": ""}}, "click_target": {"type": "choice", "instructions": "?", "criteria": {"1": {"element": "[1] a", "role": "row"}, "2": {"element": "[2] 关闭按钮"}, "3": {"element": "[3] b", "role": "cell"}}}}').alias("questions"),
        text("{", F.when(e % 11 == 0, "").otherwise(text('"operation": {"choice": "', F.when(e % 3 == 0, "OPEN").otherwise("CLICK"), '"}, ')), '"click_target": {"choice": "', target, '"', several, "}}").alias("label"),
    )


@query("trace_items", """
  WITH r AS (SELECT event_id AS e FROM events WHERE event_id % 13 <> 0 AND event_id % 5 <> 0 AND event_id % 11 <> 0)
  SELECT e AS event_id, CASE WHEN e % 3 = 0 THEN 'OPEN' ELSE 'CLICK' END AS gold_op, source_kind, CASE WHEN e % 7 = 0 THEN 'click_target' ELSE '' END AS soft,
    round(CASE WHEN e % 7 = 0 THEN 2.0 / 3 WHEN e % 5 = 1 THEN 0 ELSE 1 END, 6)::DOUBLE AS first_row, CASE source_kind WHEN 'real' THEN 2 ELSE 3 END::INT AS offered
  FROM r, (SELECT unnest(['real', 'undo_ce', 'undo_ce_loop']) AS source_kind) WHERE source_kind = 'real' OR (e % 3 = 0 AND e % 2 = 0)""")
def trace_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = traces.admitted(trace_rows(spark, sf_dir), "2", "nobody")
    made = traces.imported(rows, "event_id", undo=True)
    p = F.try_element_at(F.try_element_at(F.col("references"), F.lit("click_target")), F.lit("1"))
    offered = F.size(steps.criteria(F.col("questions"), "click_target"))
    return rounded(made.select("event_id", "gold_op", "source_kind", F.array_join("soft", ",").alias("soft"), p.alias("first_row"), offered.alias("offered")))


@query("trace_outcomes", """
  WITH r AS (SELECT event_id AS e FROM events WHERE event_id % 13 <> 0 AND event_id % 5 <> 0 AND event_id % 11 <> 0)
  SELECT 'rows' AS tag, count(*) AS n FROM events UNION ALL SELECT 'op:' || CASE WHEN e % 3 = 0 THEN 'OPEN' ELSE 'CLICK' END, count(*) FROM r GROUP BY ALL UNION ALL SELECT 'soft', count(*) FROM r WHERE e % 7 = 0""")
def trace_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trace_rows(spark, sf_dir)
    made = traces.imported(traces.admitted(rows, "2", None), "event_id")
    return traces.outcomes(rows, made, [F.concat(F.lit("op:"), "gold_op"), F.when(F.size("soft") > 0, "soft")])


@query("row_clicks", """
  SELECT event_id, event_id % 3 <> 0 AND event_id % 11 <> 0 AS holds FROM events WHERE event_id % 13 <> 0 AND event_id % 5 <> 0 AND event_id % 11 <> 0""")
def row_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = traces.imported(traces.admitted(trace_rows(spark, sf_dir), None, None), "event_id")
    return items.select("event_id", traces.row_click(F.col("questions"), F.col("references")).alias("holds"))


def editing_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text-editing steps from documents: the goal asks for a change that the text shows, and another window shows a value to copy.

    Every 4th is finished, the next types, the next looks at the other window, the last is finished and could look there.
    """
    d = F.col("doc_id").cast("string")
    body = F.concat(F.lit("status: final\nowner "), "source", F.lit("\ncount "), d)
    area = F.struct(F.lit("1").alias("index"), F.lit("textArea").alias("role"), body.alias("label"), body.alias("current_value"))
    value = F.concat(F.lit("A-"), (F.col("doc_id") + 1000).cast("string"))
    state = F.struct(F.array(area).alias("elements"), F.struct(F.concat(F.lit("note"), d, F.lit(".txt")).alias("title"), body.alias("text")).alias("page"),
                     F.array(F.struct(F.lit("w").alias("window"), F.concat(F.lit("one\nid "), value, F.lit("\nend")).alias("text"))).alias("read_in_other_windows"))
    asked = F.concat(F.lit('{"operation": {"type": "choice", "instructions": {"goal": "Change the status from draft to final."}, "criteria": {"DONE": "", "REPLACE_TEXT": "", "TYPE_TEXT": ""'),
                     F.when(F.col("doc_id") % 4 == 3, ', "FOCUS_WINDOW": ""').otherwise(""), F.lit('}}, "type_text_value": {"type": "choice", "criteria": {"1": {"value": "'), value, F.lit('"}}}}'))
    gold = F.element_at(F.array(*map(F.lit, ("DONE", "TYPE_TEXT", "FOCUS_WINDOW", "DONE"))), (F.col("doc_id") % 4 + 1).cast("int"))
    mass = lambda sure, rest: F.concat(F.lit('{"operation": {"'), "gold_op", F.lit(f'": {sure}, "REPLACE_TEXT": {rest}}}, "type_text_value": {{"1": 1.0}}}}'))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.to_json(state).alias("state"), asked.alias("questions"), gold.alias("gold_op")).withColumns({"references": mass(1.0, 0.0), "teacher": mass(0.95, 0.05)})
    return steps.typed(rows, references=steps.MASS, teacher=steps.MASS)


PICK = "('0x' || md5('{what}' || chr(31) || 'counter:{rule}:' || doc_id)[1:12])::BIGINT"
TURN = "row_number() OVER (ORDER BY ('0x' || md5('counter:{rule}|' || doc_id)[1:8])::BIGINT, doc_id)"
WORDS = ", ".join(f"'{v}'" for v in counterexamples.VALUES if v != "final")


@query("counterexamples", f"""
  WITH d AS (SELECT doc_id, doc_id % 4 AS g, 'status: final' || chr(10) || 'owner ' || source || chr(10) || 'count ' || doc_id AS body FROM documents
  ), s AS (SELECT *, ['revert', 'revert', 'wrong', 'wrong', 'punct'][{PICK.format(what='kind', rule='spoilt')} % 5 + 1] AS kind, [{WORDS}][{PICK.format(what='value', rule='spoilt')} % 17 + 1] AS other,
      ['，', '。', ',', '.', ';', '；'][{PICK.format(what='sign', rule='spoilt')} % 6 + 1] AS sign FROM d WHERE g IN (0, 3) QUALIFY {TURN.format(rule='spoilt')} <= 100)
  SELECT 'spoilt' AS rule, doc_id, 'corrupt_' || kind AS kind, 'REPLACE_TEXT' AS gold_op, 'status: ' || CASE kind WHEN 'revert' THEN 'draft' WHEN 'wrong' THEN other ELSE 'final' || sign END || substr(body, 14) AS text, 1 AS windows, CASE g WHEN 0 THEN 3 ELSE 4 END AS offered FROM s
  UNION ALL SELECT 'sibling_done', doc_id, 'sibling_done', 'DONE', body, 2, 4 FROM (SELECT * FROM d WHERE g = 0 QUALIFY {TURN.format(rule='sibling_done')} <= 50)
  UNION ALL SELECT 'sibling_open', doc_id, 'sibling_keep', 'TYPE_TEXT', body, 2, 4 FROM (SELECT * FROM d WHERE g = 1 QUALIFY {TURN.format(rule='sibling_open')} <= 50)
  UNION ALL SELECT 'ask', doc_id, 'ask', 'ASK', body, 1, 4 FROM (SELECT * FROM d WHERE g = 1 QUALIFY {TURN.format(rule='ask')} <= 60)""")
def made_counterexamples(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = counterexamples.counterexamples(editing_steps(spark, sf_dir), "doc_id", {"spoilt": 100, "sibling_done": 50, "sibling_open": 50, "ask": 60})
    area = steps.text_area(F.col("state"))["current_value"]
    return made.select("rule", "doc_id", "kind", "gold_op", area.alias("text"), F.size("state.read_in_other_windows").alias("windows"), F.size(steps.criteria(F.col("questions"), "operation")).alias("offered"))


@query("filler_fixtures", """
  WITH d AS (SELECT doc_id, [12, 24, 40][('0x' || md5('size' || chr(31) || doc_id || chr(31) || 'filler')[1:12])::BIGINT % 3 + 1] AS n FROM documents)
  SELECT doc_id, doc_id || '~filler' || n AS id, (5 * n + 1)::INT AS elements, (n + 3)::INT AS lines, 3::INT AS offered FROM d""")
def filler_fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = editing_steps(spark, sf_dir).filter("gold_op IS NOT NULL").select("doc_id", "state", "questions", "references")
    made = fixtures.filler_fixtures(rows, "doc_id")
    base = F.size(steps.criteria(F.col("questions"), "operation")) - (F.col("doc_id") % 4 == 3).cast("int")
    return made.select("doc_id", "id", F.size("state.elements").alias("elements"), F.size(F.split("state.page.text", "\n")).alias("lines"), base.alias("offered"))


def _workflow(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Runs, nodes, labels, catalogue and documents: four events make a case, each of them a node that two models may run."""
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("w"), (F.floor(e / 4) % 3).cast("string")).alias("wf"), F.floor(e / 4).alias("case_id"), F.concat(F.lit("n"), (e % 4).cast("string")).alias("node"), "value")
    each = rows.withColumn("m", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("model", F.element_at(F.array(F.lit("a"), F.lit("b")), F.col("m") + 1))
    ran, both = (e + F.col("m")) % 5 != 0, (e + F.col("m")) % 3 != 0
    entry = lambda q, v: F.struct(F.lit(q).alias("key"), v.alias("value"))
    idx = (e % 3).cast("int")
    nodes = each.select(
        "wf", "case_id", "model", "node", ran.alias("ran"), F.when(e % 17 != 0, (e % 10).cast("int")).alias("doc"),
        F.map_from_entries(F.array_compact(F.array(entry("q1", idx), F.when(both, entry("q2", idx + 3))))).alias("questions"),
        F.when(e % 19 != 0, F.map_from_entries(F.array_compact(F.array(entry("q1", F.lit("true")), F.when(both, entry("q2", F.lit("x"))))))).alias("answers"),
    )
    runs = each.groupBy("wf", "case_id", "model").agg(F.round(F.sum("value"), 2).alias("seconds"), F.when(F.col("case_id") % 4 != 0, F.lit(0.25)).alias("cost"))
    p = F.when(F.col("who") == 0, F.array(F.lit(0.2), F.lit(0.8))).otherwise(F.array(F.lit(0.0), F.lit(1.0)))
    labels = rows.withColumn("who", F.explode(F.array(F.lit(0), F.lit(1)))).select("wf", "case_id", "node", F.explode(F.array(F.lit("q1"), F.lit("q2"))).alias("qid"), p.alias("ps"), (F.col("who") == 0).alias("soft"))
    numbers = spark.range(30).select(F.concat(F.lit("w"), (F.col("id") % 3).cast("string")).alias("wf"), F.floor(F.col("id") / 3).cast("int").alias("idx"))
    return {"runs": runs, "nodes": nodes, "labels": labels, "catalogue": numbers.withColumn("question", F.concat(F.lit("question "), "idx")), "documents": numbers.withColumn("state", F.concat(F.lit("document "), "wf", F.lit("-"), "idx"))}


V_NODES = """
  WITH ev AS (SELECT event_id AS e, 'w' || (event_id // 4) % 3 AS wf, event_id // 4 AS case_id, 'n' || event_id % 4 AS node, value FROM events
  ), nd AS (
    SELECT ev.*, m, ['a', 'b'][m + 1] AS model, (e + m) % 5 <> 0 AS ran, (e + m) % 3 <> 0 AS two, CASE WHEN e % 17 <> 0 THEN e % 10 END AS doc FROM ev, (SELECT unnest([0, 1]) AS m)
  ), sp AS (SELECT e, wf, case_id, node, any_value(doc) AS doc, bool_or(two) AS two FROM nd WHERE ran AND doc IS NOT NULL GROUP BY ALL
  ), it AS (
    SELECT e, wf || '/' || case_id || '/' || node AS item_id, wf, case_id, node, doc, qid, e % 3 + CASE qid WHEN 'q2' THEN 3 ELSE 0 END AS idx FROM sp, (SELECT unnest(['q1', 'q2']) AS qid) WHERE qid = 'q1' OR two
  )"""


@query("workflow_items", V_NODES + " SELECT item_id, qid, 'document ' || wf || '-' || doc AS state, 'question ' || idx AS question, 0.9::DOUBLE AS p_true, 2::BIGINT AS n_sets, false AS soft FROM it")
def workflow_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _workflow(spark, sf_dir)
    made = workflows.items(w["nodes"], w["labels"], w["catalogue"], w["documents"])
    return rounded(made.select("item_id", "qid", "state", "question", F.element_at("ps", 2).alias("p_true"), "n_sets", "soft"))


@query("workflow_published", V_NODES + """, an AS (SELECT *, CASE WHEN e % 19 = 0 THEN 0 WHEN two THEN 2 ELSE 1 END AS n FROM nd WHERE ran
  ), tt AS (SELECT wf, case_id, model, sum(n) AS whole FROM an GROUP BY ALL
  ), ru AS (SELECT wf, case_id, model, round(sum(value), 2) AS seconds, CASE WHEN case_id % 4 <> 0 THEN 0.25::DOUBLE END AS cost FROM nd GROUP BY ALL)
  SELECT an.model, wf || '/' || case_id || '/' || an.node AS item_id, n::INT AS answers, round(seconds * n / whole, 6) AS latency_s, round(cost * n / whole, 6) AS cost_usd
  FROM an JOIN tt USING (wf, case_id, model) JOIN ru USING (wf, case_id, model) WHERE n > 0 AND doc IS NOT NULL""")
def workflow_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _workflow(spark, sf_dir)
    made = workflows.published(w["runs"], w["nodes"], workflows.items(w["nodes"], w["labels"], w["catalogue"], w["documents"]))
    return rounded(made.select("model", "item_id", F.cardinality("answers").alias("answers"), "latency_s", "cost_usd"))


def search_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of one search form in every stage, from events."""
    e = F.col("event_id")
    pick = lambda when, value: F.when(when, F.lit(value))
    def some(**values):
        return F.map_filter(F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v))), lambda _, v: v.isNotNull())

    define = lambda *rows: F.array(*(F.struct(F.lit(k).alias("key"), F.lit(kind).alias("kind"), F.lit(label).alias("label"), F.lit(inline).alias("inline")) for k, kind, label, inline in rows))
    submitted = F.when(e % 4 > 0, some(where=pick(e % 8 < 7, "Porto"), q=pick(F.lit(True), "tea")))
    return table(spark, sf_dir, "events").select(
        "event_id", some(where=pick(e % 3 > 0, "Porto"), q=pick(e % 5 > 0, "tea"), day=pick(e % 2 > 0, "May 5")).alias("form"), some(pool=pick(e % 6 > 1, "true"), stars=pick(e % 6 > 2, "5")).alias("filters"),
        some(day=pick(e % 3 == 2, "May 5")).alias("pending"), submitted.alias("submitted"), pick(e % 10 > 4, "Price").alias("sort"), F.when(e % 7 == 0, F.concat(F.lit("i"), (e % 2).cast("string"))).alias("opened"),
        pick(e % 23 == 0, "yes").alias("reserved"), F.when(e % 7 == 0, F.struct(submitted.alias("submitted"), some(pool=pick(F.lit(True), "true"), stars=pick(e % 9 > 1, "5")).alias("filters"), F.lit("Price").alias("sort"))).alias("opened_with"),
        some(where=F.lit("Porto"), q=F.lit("tea"), day=F.when(e % 5 != 4, F.lit("May 5"))).alias("all_form"), some(pool=F.lit("true"), stars=F.lit("5")).alias("req_filters"), F.when(e % 3 > 0, F.lit("Price")).alias("req_sort"), F.lit("i0").alias("target"),
        define(("where", "combobox", "Where to?", False), ("q", "text", "Search", False), ("day", "date", "Day", False)).alias("fields"), define(("pool", "checkbox", "Pool", True), ("stars", "radio", "Stars", False)).alias("filter_defs"),
        F.lit("Sort by").alias("sort_label"), F.lit("The Quay").alias("target_name"), F.create_map(*(F.lit(x) for x in ("done", "Done", "search", "Search now", "back", "Back", "view", "View"))).alias("labels"),
    ).withColumn("req_form", F.when(e % 7 == 0, F.map_filter("all_form", lambda k, _: k != "day")).otherwise(F.col("all_form"))).drop("all_form")


V_SEARCH = """
  WITH s AS (
    SELECT event_id AS e, e % 3 > 0 AS w, e % 5 > 0 AS q, e % 2 > 0 AS d, e % 7 = 0 AS shown, e % 5 <> 4 AND e % 7 <> 0 AS dated, e % 4 > 0 AS sub, e % 4 > 0 AND e % 8 < 7 AS sub_w, e % 3 > 0 AS sorts FROM events
  ), v AS (
    SELECT *, 4 + sorts::INT + 2 + dated::INT AS total,
      sub_w::INT + sub::INT + CASE WHEN shown THEN 1 + (e % 9 > 1)::INT ELSE (e % 6 > 1)::INT + (e % 6 > 2)::INT END + CASE WHEN sorts THEN shown::INT ELSE 0 END + (shown AND e % 2 = 0)::INT + (e % 23 <> 0)::INT AS satisfied FROM s
  )"""


@query("search_evaluation", V_SEARCH + " SELECT e AS event_id, satisfied = total AS passed, satisfied::INT AS satisfied, total::INT AS total FROM v")
def search_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_tasks.evaluate(search_states(spark, sf_dir)).select("event_id", "passed", "satisfied", "total")


@query("search_next_step", V_SEARCH + """, n AS (SELECT e, CASE
      WHEN shown THEN CASE WHEN e % 2 = 0 AND satisfied = total THEN ['done', NULL, NULL] ELSE ['click', 'Back', NULL] END
      WHEN NOT w THEN ['pick_or_fill', 'Where to?', 'Porto'] WHEN NOT q THEN ['fill', 'Search', 'tea']
      WHEN dated AND NOT d THEN CASE WHEN e % 3 = 2 THEN ['click', 'Done', NULL] ELSE ['date', 'Day', 'May 5'] END
      WHEN e % 6 <= 1 THEN ['click', 'Pool', NULL] WHEN NOT sub OR NOT sub_w OR dated THEN ['click', 'Search now', NULL] WHEN e % 6 <= 2 THEN ['click', '5', NULL]
      WHEN sorts AND e % 10 <= 4 THEN ['select', 'Sort by', 'Price'] ELSE ['click', 'View The Quay', NULL] END AS x FROM v)
  SELECT e AS event_id, x[1] AS what, x[2] AS label, x[3] AS value FROM n""")
def search_next_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_tasks.next_step(search_states(spark, sf_dir)).select("event_id", "what", "label", "value")

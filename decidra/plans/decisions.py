"""Decisions over whole answer maps: one step for each event, with the answers of two tiers made by integer arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from decidra.functions import prob as P
from decidra.operators import decisions as D
from decidra.operators import public_tasks
from decidra.plans.registry import query, table
from decidra.plans.scoring import rounded
from decidra.plans.views import V_Q, questions, with_views

ASKED = {
    "operation": ("CLICK", "OPEN", "TYPE_TEXT", "KEY", "DONE", "ASK"),
    "click_target": ("1", "2", "3"),
    "type_text_value": ("1", "2"),
    "key_target": ("cmd+s", "cmd+z"),
}
TEXTS = {"1": "Save", "2": "Open file", "3": "Undo last change"}
GOLDS = {"click": "CLICK", "view": "OPEN", "signup": "TYPE_TEXT", "purchase": "DONE"}


def _weights(event: Column, qn: int, k: int, tier: int) -> Column:
    at = lambda o: F.pow(1 + ((event * 31 + qn * 17 + o * 29 + tier * 13) * (event % 7 + 1)) % 23, F.lit(3.0))
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), at)


def _present(event: Column, qid: str) -> Column:
    return {"operation": event % 29 != 0, "key_target": event % 4 != 0}.get(qid, F.lit(True))


def _map(entries: list[Column]) -> Column:
    return F.map_from_entries(F.array_compact(F.array(*entries)))


def _answers(event: Column, tier: int) -> Column:
    none = F.lit(None).cast("double")

    def answer(qn: int, keys: tuple[str, ...]) -> Column:
        options = F.array(*(F.lit(k) for k in keys))
        made = lambda ps: F.struct(F.element_at(options, P.argmax(ps)).alias("choice"), none.alias("noul"), none.alias("score"), F.map_from_arrays(options, ps).alias("probabilities"))
        return P.let(P.normalize(_weights(event, qn, len(keys), tier)), made)

    entries = [F.when(_present(event, qid), F.struct(F.lit(qid).alias("key"), answer(qn, keys).alias("value"))) for qn, (qid, keys) in enumerate(ASKED.items())]
    return _map(entries)


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, gold, questions, references, answers (of the fast tier), strong (the other's), last_effect."""
    e = F.col("event_id")
    texts = F.create_map(*(F.lit(x) for kv in TEXTS.items() for x in kv))
    asked = _map([F.when(_present(e, qid) if qid != "operation" else F.lit(True), F.struct(F.lit(qid).alias("key"), F.struct(
        F.lit("choice").alias("type"), F.array(*(F.lit(k) for k in keys)).alias("keys"), (texts if qid == "click_target" else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).alias("texts")).alias("value")))
        for qid, keys in ASKED.items()])
    gold = F.lit("ASK")
    for kind, op in GOLDS.items():
        gold = F.when(F.col("event_type") == kind, op).otherwise(gold)
    entry = lambda when, qid, option: F.when(when, F.struct(F.lit(qid).alias("key"), option.cast("string").alias("value")))
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "props", gold.alias("gold"), asked.alias("questions"), _answers(e, 1).alias("answers"), _answers(e, 2).alias("strong"), F.when(e % 11 == 0, "unverifiable").alias("last_effect"))
    refs = _map([entry(F.lit(True), "operation", F.col("gold")), entry(F.col("gold") == "CLICK", "click_target", e % 4 + 1), entry(F.col("gold") == "TYPE_TEXT", "type_text_value", e % 2 + 1), entry((e % 5 == 0) & (e % 4 != 0), "key_target", F.lit("cmd+s"))])
    return rows.withColumn("references", refs)


V_ANSWERS = """
o AS (
  SELECT event_id AS e, tier, qn, qid, opt, keys[opt + 1] AS key, power(1 + ((event_id * 31 + qn * 17 + opt * 29 + tier * 13) * (event_id % 7 + 1)) % 23, 3)::DOUBLE AS w
  FROM events, (SELECT unnest([1, 2]) AS tier), (SELECT unnest([
    {'qn': 0, 'qid': 'operation', 'keys': ['CLICK', 'OPEN', 'TYPE_TEXT', 'KEY', 'DONE', 'ASK']}, {'qn': 1, 'qid': 'click_target', 'keys': ['1', '2', '3']},
    {'qn': 2, 'qid': 'type_text_value', 'keys': ['1', '2']}, {'qn': 3, 'qid': 'key_target', 'keys': ['cmd+s', 'cmd+z']}], max_depth := 2)), (SELECT unnest(range(6)) AS opt)
  WHERE opt < len(keys) AND NOT (qid = 'operation' AND event_id % 29 = 0) AND NOT (qid = 'key_target' AND event_id % 4 = 0)
), p AS (SELECT *, w / sum(w) OVER (PARTITION BY e, tier, qid) AS p FROM o
), a AS (SELECT e, tier, qid, max(p) AS top, arg_max(key, (p, -opt)) AS choice FROM p GROUP BY ALL
), s AS (
  SELECT e, tier, max(choice) FILTER (qid = 'operation') AS op, max(choice) FILTER (qid = 'click_target') AS click, max(choice) FILTER (qid = 'type_text_value') AS val, max(choice) FILTER (qid = 'key_target') AS chord,
    max(top) FILTER (qid = 'operation') AS t_op, max(top) FILTER (qid = 'click_target') AS t_click, max(top) FILTER (qid = 'type_text_value') AS t_val, max(top) FILTER (qid = 'key_target') AS t_key, min(top) AS t_all
  FROM a GROUP BY e, tier
), c AS (
  SELECT *, CASE WHEN op IS NULL THEN t_all ELSE least(t_op, CASE op WHEN 'CLICK' THEN t_click WHEN 'TYPE_TEXT' THEN t_val WHEN 'KEY' THEN coalesce(t_key, t_op) ELSE t_op END) END AS conf FROM s
), d AS (
  SELECT *, CASE WHEN op IS NULL THEN CASE WHEN conf < 0.8 THEN 'judge_low_conf' ELSE 'judge_ok' END WHEN op = 'DONE' AND e % 11 = 0 THEN 'unverified_last' WHEN op = 'DONE' THEN 'risky_DONE'
    WHEN op = 'KEY' AND chord = 'cmd+z' THEN 'risky_KEY' WHEN op = 'CLICK' AND click = '3' THEN 'risky_undo' WHEN conf < 0.94 THEN 'low_conf' ELSE 'fast_ok' END AS reason FROM c WHERE tier = 1
)"""


@query("decide_answers", with_views(V_ANSWERS, "SELECT e AS event_id, round(conf, 6) AS conf, reason NOT IN ('judge_ok', 'fast_ok') AS escalate, reason FROM d"))
def decide_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.decide_answers(decided(spark, sf_dir)).select("event_id", "conf", "escalate", "reason"))


@query("route_answers", with_views(V_ANSWERS, """, r AS (
    SELECT d.e, d.op AS f_op, d.click AS f_click, s.op AS s_op, s.click AS s_click, reason, reason NOT IN ('judge_ok', 'fast_ok') AS esc, d.conf AS conf,
      reason NOT IN ('judge_ok', 'fast_ok') AND coalesce(d.op IN ('DONE', 'ASK') AND s.op IN ('DONE', 'ASK'), false) AS both_end FROM d JOIN c s ON d.e = s.e AND s.tier = 2
  ), k AS (SELECT *, esc AND reason IN ('risky_DONE', 'unverified_last') AND coalesce(s_op = 'CLICK' AND s_click = '3', false) AS kept FROM r)
  SELECT e AS event_id, CASE WHEN esc AND NOT kept THEN s_op ELSE f_op END AS final_op, CASE WHEN esc AND NOT kept AND NOT both_end THEN s_click ELSE f_click END AS final_click,
    CASE WHEN esc AND NOT kept THEN 'strong' ELSE 'fast' END AS by, CASE WHEN kept THEN 'done_kept_over_undo' ELSE reason END AS final_reason, both_end AND f_op = s_op AS confirmed, round(conf, 4) AS fast_conf FROM k"""))
def route_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.decide_answers(decided(spark, sf_dir))
    routed = D.route_answers(rows.drop("strong"), rows.select("event_id", F.col("strong").alias("answers")), "event_id")
    final = F.col("final_answers")
    return routed.select("event_id", D.choice_of(final, "operation").alias("final_op"), D.choice_of(final, "click_target").alias("final_click"), "by", "final_reason", F.coalesce("confirmed", F.lit(False)).alias("confirmed"), "fast_conf")


GATES = ("operation", "valid_action", "valid_action_strict", "exact_text", "retention", "ask", "over_ask", "false_done", "missed_done", "write_on_done", "unauthorized")


@query("judge_answers", with_views(V_ANSWERS, """, g AS (
    SELECT s.*, CASE event_type WHEN 'click' THEN 'CLICK' WHEN 'view' THEN 'OPEN' WHEN 'signup' THEN 'TYPE_TEXT' WHEN 'purchase' THEN 'DONE' ELSE 'ASK' END AS gold FROM s JOIN events ON e = event_id WHERE tier = 1
  ), r AS (
    SELECT *, coalesce(op, '') = gold AS same, CASE WHEN gold = 'CLICK' THEN click = (e % 4 + 1)::VARCHAR END AS r_click, CASE WHEN gold = 'TYPE_TEXT' THEN val = (e % 2 + 1)::VARCHAR END AS r_val, CASE WHEN e % 5 = 0 AND e % 4 <> 0 THEN chord = 'cmd+s' END AS r_key FROM g
  ), u AS (SELECT *, CASE op WHEN 'CLICK' THEN r_click WHEN 'KEY' THEN r_key END AS targets FROM r)
  SELECT e AS event_id, same AS operation, same AND coalesce(targets, true) AND coalesce(r_val, true) AS valid_action, same AND coalesce(r_click, true) AND coalesce(r_val, true) AND coalesce(r_key, true) AS valid_action_strict,
    CASE WHEN r_val IS NOT NULL THEN same AND r_val END AS exact_text, gold <> 'CLICK' OR e % 4 < 3 AS retention, CASE WHEN gold = 'ASK' THEN coalesce(op = 'ASK', false) END AS ask, CASE WHEN gold <> 'ASK' THEN coalesce(op = 'ASK', false) END AS over_ask,
    CASE WHEN gold <> 'DONE' THEN coalesce(op = 'DONE', false) END AS false_done, CASE WHEN gold = 'DONE' THEN coalesce(op <> 'DONE', true) END AS missed_done,
    CASE WHEN gold = 'DONE' THEN coalesce(op = 'TYPE_TEXT', false) END AS write_on_done, CASE WHEN gold <> 'TYPE_TEXT' THEN coalesce(op = 'TYPE_TEXT', false) END AS unauthorized FROM u"""))
def judge_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decided(spark, sf_dir)
    return D.judge_choices(rows.withColumn("choices", D.choices(F.col("questions"), F.col("answers")))).select("event_id", *GATES)


@query("item_categories", """
  SELECT event_id, CASE WHEN event_type = 'click' THEN event_id % 60 + 1 ELSE 0 END::INT AS max_options, array_to_string(list_filter([
    CASE WHEN length(props) * (event_id % 900 + 1) >= 5200 THEN 'long_context' END, CASE WHEN event_type = 'click' AND event_id % 60 + 1 > 52 THEN 'large_candidates' END, CASE WHEN event_type = 'signup' THEN 'exact_text' END,
    CASE WHEN event_type NOT IN ('click', 'view', 'signup', 'purchase') OR event_id % 97 = 0 THEN 'ambiguity' END, CASE WHEN event_type = 'purchase' OR event_id % 89 = 0 THEN 'terminal' END], lambda x: x IS NOT NULL), ',') AS categories FROM events""")
def item_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    many = F.transform(F.sequence(F.lit(1).cast("long"), e % 60 + 1), lambda i: i.cast("string"))
    asked = F.transform_values("questions", lambda q, v: F.struct(v["type"].alias("type"), F.when(q == "click_target", many).otherwise(v["keys"]).alias("keys"), v["texts"].alias("texts")))
    refs = F.map_filter("references", lambda q, _: q != "key_target")
    rows = decided(spark, sf_dir).withColumns({"questions": asked, "references": refs, "state": F.expr("repeat(props, cast(event_id % 900 + 1 as int))")})
    rows = rows.withColumn("references", F.when(F.col("gold") == "TYPE_TEXT", F.col("references")).otherwise(F.map_filter("references", lambda q, _: q != "type_text_value")))
    wide = F.when(F.col("gold") == "TYPE_TEXT", F.lit(0)).otherwise(D.max_options(F.col("questions"), F.col("references")))
    return rows.select("event_id", wide.alias("max_options"), F.array_join(D.categories_of(F.col("state"), F.col("questions"), F.col("references"), e % 97 == 0, e % 89 == 0), ",").alias("categories"))


def flat_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, qid, keys, logits: the fast tier's weights as scores, one row for each question."""
    e = F.col("event_id")
    each = [F.when(_present(e, qid), F.struct(F.lit(qid).alias("qid"), F.array(*(F.lit(k) for k in keys)).alias("keys"), F.transform(_weights(e, qn, len(keys), 1), F.ln).alias("logits"))) for qn, (qid, keys) in enumerate(ASKED.items())]
    return table(spark, sf_dir, "events").select("event_id", F.explode(F.array_compact(F.array(*each))).alias("q")).select("event_id", "q.*")


TWO_STAGE = """, n AS (
    SELECT a.e, a.qid, a.top, s.op, count(*) AS k FROM a JOIN s ON a.e = s.e AND s.tier = 1 JOIN o ON o.e = a.e AND o.tier = 1 AND o.qid = a.qid WHERE a.tier = 1 GROUP BY ALL
  ), m AS (SELECT *, op IS NULL OR qid = 'operation' OR (op = 'CLICK' AND qid = 'click_target') OR (op = 'TYPE_TEXT' AND qid = 'type_text_value') OR (op = 'KEY' AND qid = 'key_target') {all} AS scored FROM n)
  SELECT e AS event_id, qid, scored, round(CASE WHEN scored THEN top ELSE 1.0 / k END, 6) AS top FROM m"""


def _two_stage(name: str, terminal_heads: bool) -> None:
    @query(name, with_views(V_ANSWERS, TWO_STAGE.format(all="OR op IN ('DONE', 'ASK')" if terminal_heads else "")))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        scored = D.predict(flat_logits(spark, sf_dir), ["event_id"], two_stage=True, terminal_heads=terminal_heads)
        return rounded(scored.select("event_id", "qid", "scored", F.array_max("ps").alias("top")))


_two_stage("two_stage_heads", True)
_two_stage("two_stage_own_heads", False)


@query("predict_answers", with_views(V_ANSWERS, "SELECT e AS event_id, qid, choice, round(top, 6) AS top FROM a WHERE tier = 1"))
def predict_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = D.predict(flat_logits(spark, sf_dir), ["event_id"])
    return rounded(scored.select("event_id", "qid", F.element_at("keys", P.argmax(F.col("ps"))).alias("choice"), F.array_max("ps").alias("top")))


@query("baseline_predictors", with_views(V_Q, """SELECT qid, kind, count(*) AS n, round(avg(CASE kind WHEN 'uniform' THEN 1.0 / k ELSE top END), 6) AS top
  FROM (SELECT item_id, qid, any_value(k) AS k, max(r) AS top FROM v_ref GROUP BY ALL), (SELECT unnest(['uniform', 'reference']) AS kind) GROUP BY qid, kind"""))
def baseline_predictors(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = questions(spark, sf_dir)
    both = [D.baseline_predictions(asked, kind).select("qid", F.lit(kind).alias("kind"), F.array_max("ps").alias("top")) for kind in ("uniform", "reference")]
    return rounded(both[0].unionByName(both[1]).groupBy("qid", "kind").agg(F.count("*").alias("n"), F.avg("top").alias("top")))


def _posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in the shape of several public sets, from labelled documents."""
    e = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    part = lambda i: ((e * (i + 3)) % 11 / F.lit(10.0)).alias(("toxicity", "insult", "threat", "identity_attack", "obscene")[i])
    return docs.select(
        F.col("doc_id").alias("id"), "text", F.left("text", F.floor(F.length("text") / 2).cast("int")).alias("prompt"), F.substr("text", F.floor(F.length("text") / 2).cast("int") + 1).alias("response"), (F.col("toxic") == 0).alias("is_safe"),
        F.create_map(F.lit("hate_speech,offensive_language"), F.col("toxic") == 1, F.lit("animal_abuse"), e % 4 == 0).alias("category"), *(part(i) for i in range(5)),
        F.element_at(F.array(*(F.lit(x) for x in ("negative", "neutral", "positive"))), (e % 3 + 1).cast("int")).alias("label_text"), (e % 21 / F.lit(20.0)).alias("score"),
        F.concat(F.lit(" Is it "), F.col("lang"), F.lit("?? ")).alias("question"), F.when(e % 2 == 0, "Yes").otherwise("no").alias("answer"), F.col("lang").alias("passage"), (e % 5).cast("int").alias("label"),
    )


def public_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, items = _posts(spark, sf_dir), None
    for name in ("beavertails", "civil_comments", "tweet_sentiment", "boolq", "amazon_reviews"):
        made = public_tasks.build(rows, name)
        items = made if items is None else items.unionByName(made)
    return items


@query("public_task_items", """
  WITH d AS (SELECT *, doc_id AS e FROM documents JOIN labels USING (doc_id)
  ), t AS (SELECT *, text AS body, length(text) // 2 AS one, length(text) - length(text) // 2 AS two FROM d
  ), c AS (SELECT *, CASE WHEN length(body) > 8000 THEN substr(body, 1, 8000) || ' …[truncated]' ELSE body END AS clipped, CASE WHEN one > 8000 THEN 8013 ELSE one END + CASE WHEN two > 8000 THEN 8013 ELSE two END AS halves FROM t
  ), x AS (
    SELECT 'beavertails/' || e AS item_id, 'heldout' AS role, 'harmful' AS qid, 'noul' AS qtype, 'Is `response` harmful, given `prompt`?' AS instructions, toxic::DOUBLE AS last, 2 AS k, false AS soft, halves AS state_chars FROM c UNION ALL
    SELECT 'beavertails/' || e, 'heldout', 'animal_abuse', 'noul', 'Does the exchange in `prompt` and `response` involve: animal abuse?', (e % 4 = 0)::INT, 2, false, halves FROM c UNION ALL
    SELECT 'beavertails/' || e, 'heldout', 'hate_speech,offensive_language', 'noul', 'Does the exchange in `prompt` and `response` involve: hate speech, offensive language?', toxic, 2, false, halves FROM c UNION ALL
    SELECT 'civil_comments/' || e, 'heldout', q, 'noul', s, (e * n) % 11 / 10.0, 2, true, length(clipped) FROM c, (SELECT unnest([
      {'n': 3, 'q': 'toxicity', 's': 'Is `comment` rude, disrespectful, or unreasonable enough to make someone leave a discussion?'}, {'n': 4, 'q': 'insult', 's': 'Is `comment` insulting toward a person or group?'},
      {'n': 5, 'q': 'threat', 's': 'Does `comment` threaten violence or harm?'}, {'n': 6, 'q': 'identity_attack', 's': 'Does `comment` attack someone because of their identity (race, religion, gender, ...)?'},
      {'n': 7, 'q': 'obscene', 's': 'Is `comment` obscene or vulgar?'}], recursive := true)) UNION ALL
    SELECT 'tweet_sentiment/' || e, 'heldout', 'sentiment', 'score', 'What sentiment does `tweet` express?', (e % 3 = 2)::INT, 3, false, length(trim(body, ' ')) FROM c UNION ALL
    SELECT 'boolq/' || e, 'intask', 'answer_is_yes', 'noul', 'According to `passage`, is the answer to this question yes: Is it ' || lang || '?', (e % 2 = 0)::INT, 2, false, 2 FROM d UNION ALL
    SELECT 'amazon_reviews/' || e, 'intask', 'stars', 'score', 'How many stars did the author of `review` give the product?', (e % 5 = 4)::INT, 5, false, length(clipped) FROM c
  ) SELECT item_id, role, qid, qtype, instructions, round(last, 6) AS last, k::INT AS k, soft, state_chars::INT AS state_chars FROM x""")
def public_task_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = public_items(spark, sf_dir)
    texts = F.map_values(F.from_json("state", "map<string,string>"))
    chars = F.aggregate(texts, F.lit(0), lambda n, t: n + F.length(t))
    return rounded(items.select("item_id", "role", "qid", "qtype", "instructions", F.element_at("ref", -1).alias("last"), F.size("keys").alias("k"), "soft", chars.alias("state_chars")))


@query("train_tasks", """WITH n AS (SELECT count(*) AS n FROM documents JOIN labels USING (doc_id))
  SELECT task, n::BIGINT AS items FROM n, (SELECT unnest(['amazon_reviews', 'boolq']) AS task)""")
def train_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training tasks among the public sets that the labelled documents make, with their items."""
    trained = F.split("item_id", "/")[0].isin(*public_tasks.train_tasks())
    return public_items(spark, sf_dir).filter(trained).groupBy(F.split("item_id", "/")[0].alias("task")).agg(F.count_distinct("item_id").alias("items"))

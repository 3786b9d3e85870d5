"""Decision views over the driver's tables, in Spark and as DuckDB SQL.

The tables hold no decisions, so these derive items, references, predictions and steps from them by integer arithmetic
that both engines do exactly alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from decidra.functions.text import split_of
from decidra.plans.registry import table

LANGS = ("de", "en", "es", "fr")


def _level(n: Column) -> Column:
    return F.when(n < 500, 0).when(n < 1000, 1).when(n < 2000, 2).when(n < 4000, 3).otherwise(4)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, grp, qid, qtype, keys, ref, truth (0-based), qn, ord: four questions for each labelled document."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("source").alias("grp"), "lang", "n_chars")
    items = docs.join(table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "item_id"), "item_id")
    ask = lambda qn, qid, kind, keys, truth: F.struct(F.lit(qn).alias("qn"), F.lit(qid).alias("qid"), F.lit(kind).alias("qtype"), F.array(*(F.lit(k) for k in keys)).alias("keys"), truth.cast("int").alias("truth"))
    lang = F.array_position(F.array(*(F.lit(x) for x in LANGS)), F.col("lang")) - 1
    each = items.select(
        "item_id", "grp",
        F.explode(F.array(
            ask(0, "quality", "noul", ("false", "true"), F.col("quality")), ask(1, "toxic", "noul", ("false", "true"), F.col("toxic")),
            ask(2, "lang", "choice", LANGS, lang), ask(3, "len", "score", ("0", "1", "2", "3", "4"), _level(F.col("n_chars"))),
        )).alias("q"),
    ).select("item_id", "grp", "q.*")
    k = F.size("keys")
    mass = F.when(F.col("item_id") % 5 == 0, 0.8).otherwise(1.0)
    ref = F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.when(i == F.col("truth"), mass).otherwise((1.0 - mass) / (k - 1)))
    return each.withColumns({"ref": ref, "ord": F.col("item_id") * 10 + F.col("qn")})


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run, item_id, qid, ps, error for runs 1 and 2; some items have none, some an error."""
    q = questions(spark, sf_dir).withColumn("run", F.explode(F.array(F.lit(1), F.lit(2))))
    i, run = F.col("item_id"), F.col("run")

    def weight(opt: Column) -> Column:
        o = opt + 7 * F.col("qn")
        return (1 + ((i * 7919 + o * 104729 + run * 1299709) * ((i * 31 + o * 17 + run * 13) % 1009 + 1)) % 97 + F.when(opt == F.col("truth"), 25).otherwise(0)).cast("double")

    ws = F.transform(F.sequence(F.lit(0), F.size("keys") - 1), weight)
    shares = F.transform("ws", lambda w: w / F.aggregate(F.col("ws"), F.lit(0.0), lambda a, b: a + b))
    q = q.filter(i % 17 != run).withColumn("ws", ws)
    return q.select("run", "item_id", "qid", shares.alias("ps"), F.when(i % 23 == run, "timeout").alias("error"))


RUNS = [1, 2]


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One decision step for each event; see V_STEPS for the same in SQL."""
    e = F.col("event_id")
    gold = F.when(F.col("event_type") == "click", "CLICK").when(F.col("event_type") == "view", "OPEN").when(F.col("event_type") == "signup", "TYPE_TEXT").when(F.col("event_type") == "purchase", "DONE").otherwise("ASK")
    h = (e * 7919 + 17) % 10
    op = F.when(h < 5, F.col("gold_op")).when(h == 5, "KEY").when(h == 6, "CLICK").when(h == 7, "DONE").when(h == 8, "DELETE").otherwise("TYPE_TEXT")
    k = F.get_json_object("props", "$.k").cast("int")
    base = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", k.alias("candidates"))
    base = base.withColumns({"session": F.col("user_id"), "gold_op": gold, "step": F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")}).withColumn("op", op)
    category = lambda when, name: F.when(when, F.lit(name))
    return base.select(
        "event_id", "session", "step", "gold_op", "op", "candidates", F.col("value").alias("total_s"), split_of(F.col("session").cast("string")).alias("split"),
        F.array_compact(F.array(category(e % 5 == 0, "long_context"), category(F.col("candidates") > 52, "large_candidates"), category(F.col("gold_op") == "TYPE_TEXT", "exact_text"),
                                category(F.col("gold_op") == "ASK", "ambiguity"), category(F.col("gold_op") == "DONE", "terminal"))).alias("categories"),
        ((e * 31 % 100) / 100.0).alias("op_conf"), ((e * 17 % 100) / 100.0).alias("head_conf"), (e % 29 != 0).alias("has_operation"),
        F.when(e % 11 == 0, "unverifiable").alias("last_effect"), F.element_at(F.array(*(F.lit(c) for c in ("cmd+s", "cmd+z", "Tab", "delete"))), (e % 4 + 1).cast("int")).alias("chord"),
        F.when(e % 13 == 0, "Undo last change").otherwise("Save").alias("target_text"), (e % 3 != 0).alias("target_ok"), (e % 7 != 0).alias("value_ok"),
    )


V_Q = """
v_q AS (
  SELECT item_id, grp, qid, qtype, k, truth, qn, item_id * 10 + qn AS ord FROM (
    SELECT d.doc_id AS item_id, source AS grp, unnest([
      {'qn': 0, 'qid': 'quality', 'qtype': 'noul', 'k': 2, 'truth': quality}, {'qn': 1, 'qid': 'toxic', 'qtype': 'noul', 'k': 2, 'truth': toxic},
      {'qn': 2, 'qid': 'lang', 'qtype': 'choice', 'k': 4, 'truth': list_position(['de', 'en', 'es', 'fr'], lang) - 1},
      {'qn': 3, 'qid': 'len', 'qtype': 'score', 'k': 5, 'truth': CASE WHEN n_chars < 500 THEN 0 WHEN n_chars < 1000 THEN 1 WHEN n_chars < 2000 THEN 2 WHEN n_chars < 4000 THEN 3 ELSE 4 END}
    ], recursive := true) FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
), v_ref AS (
  SELECT q.*, o.opt, CASE qtype WHEN 'noul' THEN ['false', 'true'][opt + 1] WHEN 'choice' THEN ['de', 'en', 'es', 'fr'][opt + 1] ELSE opt::VARCHAR END AS opt_key,
    CASE WHEN opt = truth THEN (CASE WHEN item_id % 5 = 0 THEN 0.8 ELSE 1.0 END)::DOUBLE ELSE (1.0::DOUBLE - (CASE WHEN item_id % 5 = 0 THEN 0.8 ELSE 1.0 END)::DOUBLE) / (k - 1) END AS r
  FROM v_q q, (SELECT unnest(range(5)) AS opt) o WHERE opt < k
), v_w AS (
  SELECT v_ref.*, run, (1 + ((item_id * 7919 + (opt + 7 * qn) * 104729 + run * 1299709) * ((item_id * 31 + (opt + 7 * qn) * 17 + run * 13) % 1009 + 1)) % 97 + CASE WHEN opt = truth THEN 25 ELSE 0 END)::DOUBLE AS w
  FROM v_ref, (SELECT unnest([1, 2]) AS run)
), v_pred AS (
  SELECT *, CASE WHEN item_id % 17 <> run AND item_id % 23 <> run THEN w / sum(w) OVER (PARTITION BY run, item_id, qid) END AS p FROM v_w
)"""

V_PAIRS = (
    V_Q
    + """, v_lab AS (
  SELECT *, first_value(opt) OVER (PARTITION BY run, item_id, qid ORDER BY r DESC, opt) AS lab, max(p) OVER (PARTITION BY run, item_id, qid) AS top,
    CASE WHEN p IS NOT NULL THEN least(greatest(p, 1e-6), 1) END AS pc FROM v_pred
), v_pairs AS (
  SELECT run, item_id, grp, qid, qtype, k, ord, bool_and(p IS NOT NULL) AS answered,
    CASE WHEN bool_and(p IS NOT NULL) THEN max(CASE WHEN opt = lab THEN opt_key END) END AS label,
    CASE WHEN max(top) IS NULL THEN NULL WHEN bool_or(opt = lab AND p >= top - 1e-12) THEN 1.0::DOUBLE / count(*) FILTER (WHERE p >= top - 1e-12) ELSE 0.0::DOUBLE END AS correct,
    max(p) AS confidence, -ln(max(CASE WHEN opt = lab THEN pc END)) AS nll,
    sum(power(p - CASE WHEN opt = lab THEN 1 ELSE 0 END, 2)) AS brier, -sum(r * ln(pc)) AS cross_entropy,
    CASE WHEN max(p) IS NOT NULL THEN greatest(-sum(r * ln(pc)) + sum(CASE WHEN r > 0 THEN r * ln(r) ELSE 0 END), 0) END AS kl,
    0.5 * sum(abs(p - r)) AS tv, CASE WHEN qtype = 'score' AND max(p) IS NOT NULL THEN abs(sum(opt * p) - sum(opt * r)) / (k - 1) END AS score_abs_err
  FROM v_lab GROUP BY run, item_id, grp, qid, qtype, k, ord
)"""
)

V_STEPS = """
v_steps AS (
  SELECT *, CASE WHEN h < 5 THEN gold_op WHEN h = 5 THEN 'KEY' WHEN h = 6 THEN 'CLICK' WHEN h = 7 THEN 'DONE' WHEN h = 8 THEN 'DELETE' ELSE 'TYPE_TEXT' END AS op,
    list_filter([CASE WHEN event_id % 5 = 0 THEN 'long_context' END, CASE WHEN candidates > 52 THEN 'large_candidates' END, CASE WHEN gold_op = 'TYPE_TEXT' THEN 'exact_text' END,
      CASE WHEN gold_op = 'ASK' THEN 'ambiguity' END, CASE WHEN gold_op = 'DONE' THEN 'terminal' END], lambda x: x IS NOT NULL) AS categories
  FROM (
    SELECT event_id, user_id AS session, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, value AS total_s, (props->>'$.k')::INT AS candidates,
      CASE event_type WHEN 'click' THEN 'CLICK' WHEN 'view' THEN 'OPEN' WHEN 'signup' THEN 'TYPE_TEXT' WHEN 'purchase' THEN 'DONE' ELSE 'ASK' END AS gold_op, (event_id * 7919 + 17) % 10 AS h,
      CASE WHEN ('0x' || sha256('replay-v1:' || user_id)[1:8])::BIGINT / 4294967295.0::DOUBLE < 0.3 THEN 'holdout' ELSE 'dev' END AS split,
      (event_id * 31 % 100) / 100.0::DOUBLE AS op_conf, (event_id * 17 % 100) / 100.0::DOUBLE AS head_conf, event_id % 29 <> 0 AS has_operation,
      CASE WHEN event_id % 11 = 0 THEN 'unverifiable' END AS last_effect, ['cmd+s', 'cmd+z', 'Tab', 'delete'][event_id % 4 + 1] AS chord,
      CASE WHEN event_id % 13 = 0 THEN 'Undo last change' ELSE 'Save' END AS target_text, event_id % 3 <> 0 AS target_ok, event_id % 7 <> 0 AS value_ok
    FROM events)
)"""


def with_views(views: str, body: str) -> str:
    return "WITH " + views.strip() + "\n" + body

"""Score, calibration and comparison reports over the derived decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from decidra.functions import prob as P
from decidra.operators import calibrate as C
from decidra.operators import metrics as M
from decidra.operators.runner import last_wins, todo
from decidra.plans.registry import query, table
from decidra.plans.views import RUNS, V_PAIRS, V_Q, predictions, questions, with_views


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.score_pairs(questions(spark, sf_dir), predictions(spark, sf_dir), RUNS)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


#: Rank and bin metrics of groups (run, level, name) over rows x.
LEVELS = """, x AS (
  SELECT p.*, unnest(['overall', 'group', 'type', 'k']) AS level,
    unnest(['all', grp, qtype, CASE WHEN k <= 2 THEN 'K=2' WHEN k <= 5 THEN 'K=3-5' WHEN k <= 10 THEN 'K=6-10' WHEN k <= 50 THEN 'K=11-50' ELSE 'K>50' END]) AS name FROM v_pairs p
)"""
BY_GROUP = """, x AS (SELECT *, 'group' AS level, grp AS name FROM v_pairs)"""
OVERALL = """, x AS (SELECT *, 'overall' AS level, 'all' AS name FROM v_pairs)"""
STATS = """, a AS (SELECT * FROM x WHERE answered
), b AS (
  SELECT run, level, name, CASE WHEN count(*) >= 2 THEN avg(acc) END AS balanced_accuracy FROM (SELECT run, level, name, label, avg(correct) AS acc FROM a GROUP BY ALL) GROUP BY ALL
), e AS (
  SELECT run, level, name, sum(n * gap) / sum(n) AS ece FROM (
    SELECT run, level, name, least(floor(confidence * 10), 9) AS bin, count(*) AS n, abs(avg(correct) - avg(confidence)) AS gap FROM a GROUP BY ALL) GROUP BY run, level, name
), r AS (
  SELECT *, row_number() OVER w AS rn, sum(1 - correct) OVER (w ROWS UNBOUNDED PRECEDING) AS errors, count(*) OVER (PARTITION BY run, level, name) AS n
  FROM a WINDOW w AS (PARTITION BY run, level, name ORDER BY confidence DESC, ord)
), k AS (
  SELECT run, level, name, avg(errors / rn) AS aurc, sum(CASE WHEN rn <= greatest(1, round_even(n * 0.8::DOUBLE, 0)) THEN correct END) / first(greatest(1, round_even(n * 0.8::DOUBLE, 0))) AS sel_acc_80,
    coalesce(max(CASE WHEN errors <= 0.05::DOUBLE * rn THEN rn END), 0) / first(n) AS cov_risk5, coalesce(max(CASE WHEN errors <= 0.1::DOUBLE * rn THEN rn END), 0) / first(n) AS cov_risk10
  FROM r GROUP BY ALL
), s AS (
  SELECT run, level, name, count(*) AS pairs, avg(answered::INT::DOUBLE) AS coverage, avg(correct) AS accuracy, avg(nll) AS nll, avg(brier) AS brier, avg(cross_entropy) AS cross_entropy, avg(kl) AS kl, avg(tv) AS tv, avg(score_abs_err) AS score_mae
  FROM x GROUP BY ALL
), j AS (SELECT * FROM s LEFT JOIN b USING (run, level, name) LEFT JOIN e USING (run, level, name) LEFT JOIN k USING (run, level, name))"""
ALL_METRICS = ("coverage", "accuracy", "nll", "brier", "cross_entropy", "kl", "tv", "score_mae", "balanced_accuracy", "ece", "aurc", "sel_acc_80", "cov_risk5", "cov_risk10")
ROUNDED = ", ".join(f"round({m}, 6) AS {m}" for m in ALL_METRICS)


@query("score_report", with_views(V_PAIRS, LEVELS + STATS + f" SELECT run, level, name, pairs, {ROUNDED} FROM j"))
def score_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.report(pairs(spark, sf_dir)))


@query(
    "pair_metrics",
    with_views(V_PAIRS, "SELECT run, item_id, qid, answered, label, round(correct, 6) AS correct, round(confidence, 6) AS confidence, round(nll, 6) AS nll, round(brier, 6) AS brier, round(kl, 6) AS kl, round(tv, 6) AS tv, round(score_abs_err, 6) AS score_abs_err FROM v_pairs"),
)
def pair_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pairs(spark, sf_dir).select("run", "item_id", "qid", "answered", "label", "correct", "confidence", "nll", "brier", "kl", "tv", "score_abs_err"))


@query(
    "report_grouping_sets",
    with_views(V_PAIRS, """SELECT run, grp, qtype, kb, count(*) AS pairs, count(*) FILTER (WHERE answered) AS answered, round(avg(correct), 6) AS accuracy, round(avg(nll), 6) AS nll FROM (
      SELECT *, CASE WHEN k <= 2 THEN 'K=2' WHEN k <= 5 THEN 'K=3-5' WHEN k <= 10 THEN 'K=6-10' WHEN k <= 50 THEN 'K=11-50' ELSE 'K>50' END AS kb FROM v_pairs)
      GROUP BY GROUPING SETS ((run), (run, grp), (run, qtype), (run, kb))"""),
)
def report_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.grouping_report(pairs(spark, sf_dir)))


def _metric(name: str, columns: tuple[str, ...], level: str, build) -> None:
    picked = ", ".join(f"round({c}, 6) AS {c}" for c in columns)
    keys = ["run", "grp"] if level == BY_GROUP else ["run"]
    head = "run, name AS grp" if level == BY_GROUP else "run"

    @query(name, with_views(V_PAIRS, level + STATS + f" SELECT {head}, {picked} FROM j"))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(build(pairs(spark, sf_dir), keys).select(*keys, *columns))


_metric("ece_by_run", ("ece",), OVERALL, M.ece)
_metric("aurc_by_run", ("aurc",), OVERALL, M.rank_metrics)
_metric("selective_acc", ("sel_acc_80",), BY_GROUP, M.rank_metrics)
_metric("coverage_at_risk", ("cov_risk5", "cov_risk10"), BY_GROUP, M.rank_metrics)
_metric("balanced_accuracy", ("balanced_accuracy",), BY_GROUP, M.balanced_accuracy)
_metric("coverage", ("coverage",), BY_GROUP, M.summarize)

MACRO = ("accuracy", "balanced_accuracy", "nll", "brier", "ece", "kl", "tv")


@query("macro_metrics", with_views(V_PAIRS, BY_GROUP + STATS + " SELECT run, " + ", ".join(f"round(avg({m}), 6) AS {m}" for m in MACRO) + " FROM j GROUP BY run"))
def macro_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.macro(pairs(spark, sf_dir)))


@query(
    "common_subset",
    with_views(V_PAIRS, """SELECT run, qid, count(*) AS pairs, round(avg(correct), 6) AS accuracy FROM v_pairs
      WHERE (item_id, qid) IN (SELECT (item_id, qid) FROM v_pairs WHERE answered GROUP BY item_id, qid HAVING count(*) = 2) GROUP BY run, qid"""),
)
def common_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.common_subset(pairs(spark, sf_dir)).groupBy("run", "qid").agg(F.count("*").alias("pairs"), F.avg("correct").alias("accuracy")))


@query("runner_todo", with_views(V_Q, """SELECT DISTINCT run, item_id FROM v_w WHERE item_id % 17 = run OR item_id % 23 = run"""))
def runner_todo(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = questions(spark, sf_dir).select("item_id", F.explode(F.array(*(F.lit(r) for r in RUNS))).alias("run")).distinct()
    return todo(items, predictions(spark, sf_dir), ["run", "item_id"]).select("run", "item_id")


@query("last_wins_predictions", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def last_wins_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    return last_wins(log, ["user_id", "event_type"], "event_id").select("user_id", "event_id", "event_type")


@query("per_case_cost", "SELECT event_type, count(*) AS cases, round(avg(v), 6) AS mean FROM (SELECT event_type, user_id, sum(value) AS v FROM events GROUP BY ALL) GROUP BY event_type")
def per_case_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.per_case(table(spark, sf_dir, "events"), ["event_type"], "user_id", F.col("value")))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answered pairs with their distributions, for calibration."""
    got = predictions(spark, sf_dir).filter("error IS NULL").select("run", "item_id", "qid", "ps")
    return C.with_kind(questions(spark, sf_dir).join(got, ["item_id", "qid"]))


SCALED = """, g AS (SELECT round(0.2 + 0.05 * i, 2)::DOUBLE AS t FROM (SELECT unnest(range(57)) AS i)
), z AS (SELECT run, item_id, qid, qtype AS kind, k, opt, r, p, t, ln(greatest(p, 1e-12)) / t AS l FROM v_pred, g WHERE p IS NOT NULL
), zz AS (SELECT *, exp(l - max(l) OVER w) AS ex FROM z WINDOW w AS (PARTITION BY run, item_id, qid, t)
), q AS (SELECT *, CASE WHEN t = 1.0 THEN p ELSE ex / sum(ex) OVER (PARTITION BY run, item_id, qid, t) END AS s FROM zz
), nl AS (SELECT run, item_id, qid, kind, t, -sum(CASE WHEN r > 0 THEN r * ln(greatest(s, 1e-12)) ELSE 0 END) AS loss FROM q GROUP BY ALL)"""


@query("temperature_fit", with_views(V_Q, SCALED + """, m AS (SELECT run, kind, t, round(avg(loss), 12) AS loss, count(*) AS n FROM nl GROUP BY ALL HAVING count(*) >= 20)
  SELECT run, kind, arg_min(t, (loss, t)) AS t FROM m GROUP BY run, kind"""))
def temperature_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.fit(answers(spark, sf_dir), ["run", "kind"])


@query("temperature_crossfit", with_views(V_Q, SCALED + """, f AS (SELECT *, (dense_rank() OVER (PARTITION BY run ORDER BY item_id) - 1) % 2 AS fold FROM nl
  ), m AS (SELECT run, kind, fold, t, round(avg(loss), 12) AS loss, count(*) AS n FROM f GROUP BY ALL HAVING count(*) >= 20
  ), b AS (SELECT run, kind, 1 - fold AS fold, arg_min(t, (loss, t)) AS t FROM m GROUP BY run, kind, fold)
  SELECT f.run, f.kind, count(*) AS pairs, round(avg(f.loss), 6) AS loss FROM f LEFT JOIN b ON f.run = b.run AND f.kind = b.kind AND f.fold = b.fold WHERE f.t = coalesce(b.t, 1.0) GROUP BY f.run, f.kind"""))
def temperature_crossfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = C.crossfit(C.with_fold_ord(answers(spark, sf_dir), "item_id", ["run"]), ["run", "kind"])
    return rounded(C.apply(fitted).groupBy("run", "kind").agg(F.count("*").alias("pairs"), F.avg(P.soft_nll(F.col("ref"), F.col("ps"))).alias("loss")))


@query("rescale_pred", with_views(V_Q, SCALED + " SELECT run, item_id, qid, opt::INT AS opt, round(s, 6) AS p FROM q WHERE t = 0.5"))
def rescale_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(answers(spark, sf_dir).select("run", "item_id", "qid", F.posexplode(P.rescale(F.col("ps"), F.lit(0.5))).alias("opt", "p")))


@query("score_codecs", with_views(V_Q, """SELECT run, item_id, qid, round(CASE WHEN qtype = 'noul' THEN NULL ELSE CASE qtype WHEN 'choice' THEN (k * max(p) - 1) / (k - 1) ELSE greatest(0, 1 - 2 * sum(p * abs(opt - mean)) / (k - 1)) END END, 6) AS confidence,
    round(CASE WHEN qtype = 'score' THEN max(mean) END, 6) AS score, CASE WHEN qtype = 'choice' THEN arg_max(opt_key, (p, -opt)) END AS choice, round(CASE WHEN qtype = 'noul' THEN max(CASE WHEN opt = 1 THEN p END) END, 6) AS noul
  FROM (SELECT *, sum(opt * p) OVER (PARTITION BY run, item_id, qid) AS mean FROM v_pred WHERE p IS NOT NULL) GROUP BY run, item_id, qid, qtype, k"""))
def score_codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = P.to_answer(F.col("qtype"), F.col("keys"), F.col("ps"))
    return rounded(answers(spark, sf_dir).select("run", "item_id", "qid", a.alias("a")).select("run", "item_id", "qid", "a.confidence", "a.score", "a.choice", "a.noul"))


def softmaxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode(P.softmax(F.col("embedding"))).alias("opt", "p"))


LOGITS = """l AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS opt FROM embeddings
), ex AS (SELECT *, exp(x - max(x) OVER (PARTITION BY vec_id)) AS ex FROM l
), p0 AS (SELECT vec_id, label, opt, x, ex / sum(ex) OVER (PARTITION BY vec_id) AS p FROM ex)"""


@query("softmax_logits", with_views(LOGITS, "SELECT vec_id, opt::INT AS opt, round(p, 6) AS p FROM p0"))
def softmax_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(softmaxed(spark, sf_dir).select("vec_id", "opt", "p"))


def _tournament_sql(size: int) -> str:
    """At 64 options: one round of chunks, their finalists in one chunk, merged back."""
    return with_views(LOGITS, f""", c AS (SELECT vec_id, opt, x, opt // {size} AS chunk FROM l
  ), c1 AS (SELECT *, exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id, chunk) AS pc, row_number() OVER (PARTITION BY vec_id, chunk ORDER BY x DESC, opt) AS rk FROM c
  ), f AS (SELECT vec_id, opt, chunk, pc, exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id) AS pf FROM c1 WHERE rk <= 3
  ), b AS (SELECT vec_id, chunk, arg_max(pf, (pf, -opt)) AS pf, arg_max(pc, (pf, -opt)) AS pc FROM f GROUP BY ALL
  ), m AS (SELECT c1.vec_id, c1.opt, coalesce(f.pf, b.pf * c1.pc / greatest(b.pc, 1e-12)) AS p FROM c1 LEFT JOIN f USING (vec_id, opt) JOIN b ON c1.vec_id = b.vec_id AND c1.chunk = b.chunk)
  SELECT vec_id, opt::INT AS opt, round(p / sum(p) OVER (PARTITION BY vec_id), 6) AS p FROM m""")


def _tournament(size: int):
    from decidra.operators.tournament import tournament

    @query(f"tournament_{size}", _tournament_sql(size))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(tournament(table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("opt", "x")), "vec_id", size, 64))


_tournament(26)
_tournament(52)


@query("finalists", with_views(LOGITS, "SELECT vec_id, chunk::INT AS chunk, opt::INT AS opt FROM (SELECT *, opt // 26 AS chunk, row_number() OVER (PARTITION BY vec_id, opt // 26 ORDER BY x DESC, opt) AS rk FROM l) WHERE rk <= 3"))
def finalists(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("opt", "x")).withColumn("chunk", F.floor(F.col("opt") / 26).cast("int"))
    best = Window.partitionBy("vec_id", "chunk").orderBy(F.desc("x"), "opt")
    return each.withColumn("rk", F.row_number().over(best)).filter("rk <= 3").select("vec_id", "chunk", "opt")

"""Contamination, selection, labels, pages, texts and slices over the driver's tables, and the routing stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from decidra.functions import prob as P
from decidra.functions.text import TOKEN
from decidra.operators import batching, builders, pages, slices, variants
from decidra.operators import contamination as C
from decidra.operators import router as T
from decidra.operators.text_choices import candidates, spans
from decidra.plans.registry import query, table
from decidra.plans.scoring import answers, rounded
from decidra.plans.views import V_Q, V_STEPS, predictions, questions, steps, with_views
from decidra.streaming import routing

GRAMS = f"""tk AS (SELECT 'b' AS side, item_id AS id, regexp_extract_all(lower(text), '{TOKEN.replace("'", "''")}') AS w FROM benchmark UNION ALL
  SELECT 'd', doc_id, regexp_extract_all(lower(text), '{TOKEN.replace("'", "''")}') FROM documents
), gr AS (SELECT DISTINCT side, id, array_to_string(w[i:i + 12], ' ') AS gram FROM (SELECT side, id, w, unnest(range(1, len(w) - 11)) AS i FROM tk WHERE len(w) >= 13)
), hit AS (SELECT b.id AS item_id, d.id AS doc_id, gram FROM gr b JOIN gr d USING (gram) WHERE b.side = 'b' AND d.side = 'd'
), per AS (SELECT item_id, doc_id, count(*) AS shared FROM hit GROUP BY ALL
), best AS (SELECT item_id, arg_max(doc_id, (shared, -doc_id)) AS best, max(shared) AS shared FROM per GROUP BY item_id
), size AS (SELECT item_id, count(gr.gram) AS grams FROM benchmark LEFT JOIN gr ON gr.side = 'b' AND gr.id = item_id GROUP BY item_id
), n AS (SELECT item_id, count(DISTINCT gram) AS hits FROM hit GROUP BY item_id)"""


def _bench(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents").select("doc_id", "text")


@query("contamination", "WITH " + GRAMS + """ SELECT item_id, grams, coalesce(hits, 0) AS hits, round(coalesce(hits, 0) / greatest(grams, 1), 6) AS share, best, coalesce(shared, 0) AS shared, coalesce(hits, 0) / greatest(grams, 1) >= 0.05::DOUBLE OR coalesce(shared, 0) >= 20 AS flagged
  FROM size LEFT JOIN n USING (item_id) LEFT JOIN best USING (item_id)""")
def contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    bench, docs = _bench(spark, sf_dir)
    return rounded(C.summary(bench, C.gram_hits(bench, docs)).select("item_id", "grams", "hits", "share", "best", "shared", "flagged"))


@query("contamination_best", "WITH " + GRAMS + " SELECT item_id, best, shared FROM best")
def contamination_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.best_match(C.gram_hits(*_bench(spark, sf_dir)))


@query("contamination_top", "WITH " + GRAMS + " SELECT item_id, hits, grams, best FROM size JOIN n USING (item_id) JOIN best USING (item_id) ORDER BY hits / grams DESC, hits DESC, grams DESC, item_id DESC LIMIT 10")
def contamination_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    bench, docs = _bench(spark, sf_dir)
    found = C.summary(bench, C.gram_hits(bench, docs)).filter("hits > 0")
    return found.orderBy(F.desc("share"), F.desc("hits"), F.desc("grams"), F.desc("item_id")).limit(10).select("item_id", "hits", "grams", "best")


OPTIONS = "list_sort(list_distinct(string_split(role || ',' || (turn % 3) || ',' || (conv_id % 7), ',')))"


@query("option_set_hits", f"""WITH o AS (SELECT conv_id * 1000 + turn AS id, conv_id, {OPTIONS} AS o FROM conversations), b AS (SELECT * FROM o WHERE conv_id % 10 = 0 AND len(o) >= 3),
  r AS (SELECT o FROM b GROUP BY o HAVING count(DISTINCT id) <= 2) SELECT b.id AS item_id, d.id AS doc_id FROM b JOIN r USING (o) JOIN (SELECT * FROM o WHERE conv_id % 10 <> 0) d ON b.o = d.o""")
def option_set_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.split(F.concat_ws(",", "role", (F.col("turn") % 3).cast("string"), (F.col("conv_id") % 7).cast("string")), ",")
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "conv_id", keys.alias("keys"))
    return C.option_set_hits(rows.filter("conv_id % 10 = 0").withColumnRenamed("id", "item_id"), rows.filter("conv_id % 10 <> 0").withColumnRenamed("id", "doc_id"))


@query("dedup_exact", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return C.dedup_exact(docs, F.to_json(F.struct("text")), "doc_id").select("doc_id")


MD5 = "('0x' || md5({0})[1:8])::BIGINT"


@query("stratified_select", f"""WITH r AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang ORDER BY {MD5.format("'s1|' || doc_id")}, doc_id) AS rn FROM documents)
  SELECT doc_id, lang FROM r ORDER BY rn, {MD5.format("'s1|' || lang")}, lang, doc_id LIMIT 50""")
def stratified_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return builders.stratified_select(table(spark, sf_dir, "documents").select("doc_id", "lang"), ["lang"], "doc_id", 50, "s1")


@query("holdout_tasks", f"""WITH t AS (SELECT DISTINCT l_returnflag, l_suppkey FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY {MD5.format("'s2|' || l_suppkey")}, l_suppkey) AS rn FROM t)
  SELECT l_returnflag, rn <= 5 AS holdout, count(*) AS n FROM lineitem JOIN r USING (l_returnflag, l_suppkey) GROUP BY ALL""")
def holdout_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_suppkey")
    return builders.holdout_tasks(rows, "l_returnflag", "l_suppkey", 5, "s2").groupBy("l_returnflag", "holdout").agg(F.count("*").alias("n"))


@query("consensus_labels", with_views(V_Q, """, m AS (SELECT item_id, qid, opt, avg(p) AS p, count(*) AS n_sets FROM v_pred WHERE p IS NOT NULL GROUP BY ALL) SELECT item_id, qid, opt::INT AS opt, round(p, 9) AS p, n_sets FROM m"""))
def consensus_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = answers(spark, sf_dir).select("item_id", "qid", "ps", F.lit(True).alias("soft"))
    return rounded(builders.consensus(labels, ["item_id", "qid"]).select("item_id", "qid", "n_sets", F.posexplode("ps").alias("opt", "p")), 9)


@query("teacher_attach", with_views(V_Q, """, x AS (SELECT item_id, qid, CASE WHEN item_id % 17 = 1 OR item_id % 23 = 1 THEN 'gold_filled' WHEN arg_max(opt, (p, -opt)) <> max(truth) THEN 'disagreed' ELSE 'labeled' END AS outcome, max(p) AS top FROM v_pred WHERE run = 1 GROUP BY item_id, qid)
  SELECT item_id, qid, outcome, round(CASE WHEN outcome = 'gold_filled' THEN 0.9 ELSE top END, 6) AS top FROM x"""))
def teacher_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = questions(spark, sf_dir).select("item_id", "qid", F.size("keys").alias("k"), P.argmax(F.col("ref")).alias("label"))
    teacher = predictions(spark, sf_dir).filter("run = 1").drop("run")
    return rounded(builders.attach_teacher(items, teacher, ["item_id", "qid"], fill=0.9, drop_disagreed=True).select("item_id", "qid", "outcome", P.top(F.col("teacher")).alias("top")))


@query("smooth_labels", with_views(V_Q, "SELECT item_id, qid, opt::INT AS opt, round(0.95 * r + 0.05 / k, 6) AS p FROM v_ref"))
def smooth_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(questions(spark, sf_dir).select("item_id", "qid", F.posexplode(P.smooth(F.col("ref"))).alias("opt", "p")))


@query("stsb_soft", """WITH x AS (SELECT l_orderkey, l_linenumber, l_discount * 50 AS x, least(floor(l_discount * 50), 4) AS lo FROM lineitem)
  SELECT l_orderkey, l_linenumber, i::INT AS level, round(CASE WHEN i = lo THEN 1 - (x - lo) ELSE x - lo END, 6) AS p FROM x, (SELECT unnest(range(6)) AS i) WHERE i = lo OR i = lo + 1""")
def stsb_soft(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.posexplode(P.two_level(F.col("l_discount") * 50, 6)).alias("level", "p"), F.least(F.floor(F.col("l_discount") * 50), F.lit(4)).alias("lo"))
    return rounded(rows.filter("level = lo OR level = lo + 1").drop("lo"))


@query("facet_search", "SELECT p_partkey, p_retailprice FROM part WHERE p_brand = 'Brand#4' AND p_size BETWEEN 10 AND 40 AND p_type LIKE '%LARGE%'")
def facet_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = {"size": F.col("p_size").between(10, 40), "large": F.col("p_type").contains("LARGE")}
    return builders.facet_search(table(spark, sf_dir, "part"), flags, {"p_brand": "Brand#4"}, True, "p_retailprice", "p_partkey").select("p_partkey", "p_retailprice")


@query("facet_counts", "SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_size))")
def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    return parts.groupingSets([[F.col("p_brand")], [F.col("p_size")]], "p_brand", "p_size").agg(F.count("*").alias("n"))


@query("suggestions", "SELECT p_name FROM part WHERE contains(lower(p_name), 're') ORDER BY p_partkey LIMIT 6")
def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return builders.suggestions(table(spark, sf_dir, "part"), "p_name", "Re", "p_partkey").select("p_name")


@query("page_elements")
def page_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_elements(table(spark, sf_dir, "pages"))


@query("page_windows")
def page_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = pages.page_stream(table(spark, sf_dir, "pages"))
    return pages.windows(stream, _first_anchors(stream))


def _first_anchors(stream: DataFrame) -> DataFrame:
    return stream.filter("role = 'anchor'").groupBy("page_id").agg(F.min_by("node", "pos").alias("node"))


def _web_steps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """One step for each page, whose target is its first anchor, and the pages' streams. Every 5th step's target isn't on its page, every 7th has none."""
    stream = pages.page_stream(table(spark, sf_dir, "pages"))
    before = F.transform(F.sequence(F.lit(1).cast("long"), F.col("page_id") % 7 + 1), lambda i: F.concat(F.lit("step "), i.cast("string")))
    steps = table(spark, sf_dir, "pages").join(_first_anchors(stream), "page_id", "left").select(
        F.col("page_id").alias("step_id"), F.regexp_extract("url", "://([^/]+)", 1).alias("website"), F.concat(F.lit("Open link "), "page_id").alias("goal"), before.alias("history"),
        F.when(F.col("page_id") % 5 == 0, "elsewhere").when(F.col("page_id") % 7 > 0, F.col("node")).alias("node"),
    )
    return steps, stream.withColumnRenamed("page_id", "step_id")


@query("web_items")
def web_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.web_items(*_web_steps(spark, sf_dir))[0]


@query("web_items_skipped", "SELECT 'no_target' AS skipped, count(*) AS n FROM pages WHERE page_id % 5 = 0 OR page_id % 7 = 0")
def web_items_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.web_items(*_web_steps(spark, sf_dir))[1]


@query("web_records")
def web_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.web_records(*_web_steps(spark, sf_dir))


@query("page_sites", "SELECT count(*) AS items, count(DISTINCT regexp_extract(url, '://([^/]+)', 1)) AS websites FROM pages")
def page_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.site_counts(table(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^/]+)", 1).alias("website")))


@query("text_spans")
def text_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", spans(F.col("text")).alias("spans"))


@query("value_candidates")
def value_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.element_at(F.array(F.lit("Departure date"), F.lit("Guests"), F.lit("City")), (F.col("turn") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", candidates(F.col("text"), label, F.array("role")).alias("candidates"))


@query("rename_variants")
def rename_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.rename_variants(table(spark, sf_dir, "events"), "event_id", "props")


#: The greedy packing, one example after the other.
PACKED = """
  WITH RECURSIVE r AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations
  ), b AS (
    SELECT conv_id, turn, n, i, 0 AS batch, 1 AS size, n AS width FROM r WHERE i = 1 UNION ALL
    SELECT r.conv_id, r.turn, r.n, r.i, CASE WHEN b.size >= 4 OR greatest(b.width, r.n) * (b.size + 1) > 2000 THEN b.batch + 1 ELSE b.batch END,
      CASE WHEN b.size >= 4 OR greatest(b.width, r.n) * (b.size + 1) > 2000 THEN 1 ELSE b.size + 1 END, CASE WHEN b.size >= 4 OR greatest(b.width, r.n) * (b.size + 1) > 2000 THEN r.n ELSE greatest(b.width, r.n) END
    FROM b JOIN r ON r.conv_id = b.conv_id AND r.i = b.i + 1
  )"""


@query("token_batches", PACKED + " SELECT conv_id, turn, n, batch::BIGINT AS batch FROM b")
def token_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("n"))
    return batching.token_batches(rows, "conv_id", "turn", "n", 4, 2000)


@query("batch_sizes", PACKED + ", c AS (SELECT conv_id, batch, count(*) AS size FROM b GROUP BY ALL) SELECT conv_id, list(size::INT ORDER BY batch) AS sizes FROM c GROUP BY conv_id")
def batch_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("n")))), lambda s: s["n"])
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(batching.batch_sizes(ordered, 4, 2000).alias("sizes"))


@query("token_stream", """WITH RECURSIVE r AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (ORDER BY conv_id, turn) - 1 AS p FROM conversations
  ), w AS (SELECT *, count(*) OVER () AS total, max(n) OVER (ORDER BY p ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS w2, max(n) OVER (ORDER BY p ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS w3, max(n) OVER (ORDER BY p ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS w4 FROM r
  ), e AS (SELECT p, p + CASE WHEN p + 1 >= total OR 2 * w2 > 2000 THEN 1 WHEN p + 2 >= total OR 3 * w3 > 2000 THEN 2 WHEN p + 3 >= total OR 4 * w4 > 2000 THEN 3 ELSE 4 END AS q FROM w
  ), b AS (SELECT p, q, 0::BIGINT AS batch FROM e WHERE p = 0 UNION ALL SELECT e.p, e.q, b.batch + 1 FROM b JOIN e ON e.p = b.q)
  SELECT conv_id, turn, batch FROM r JOIN b ON r.p >= b.p AND r.p < b.q""")
def token_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("conv_id") * 1000 + F.col("turn")).alias("at"), F.length("text").cast("long").alias("n"))
    return batching.batch_stream(rows, "at", "n", 4, 2000).select("conv_id", "turn", "batch")


@query("adjacent_duplicates", "SELECT conv_id, turn FROM (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) WHERE before IS NULL OR before <> role")
def adjacent_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf_dir, "conversations").withColumn("before", before).filter("before IS NULL OR before <> role").select("conv_id", "turn")


@query("step_twins", "SELECT conv_id, turn FROM conversations WHERE (turn, role) IN (SELECT (turn, role) FROM conversations GROUP BY turn, role HAVING count(*) >= 2)")
def step_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return builders.twins(table(spark, sf_dir, "conversations"), ["turn", "role"]).select("conv_id", "turn")


@query("hoist_shared", """WITH i AS (SELECT conv_id, turn, unnest(['role', 'parity']) AS field, unnest([role, (conv_id % 2)::VARCHAR]) AS value FROM conversations)
  SELECT conv_id, field, min(value) AS value FROM i GROUP BY conv_id, field HAVING min(value) = max(value) AND count(DISTINCT turn) > 1""")
def hoist_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("qid"), F.explode(F.create_map(F.lit("role"), "role", F.lit("parity"), (F.col("conv_id") % 2).cast("string"))).alias("field", "value"))
    return builders.hoist_shared(rows, "conv_id")


@query("history_repeat", "SELECT conv_id, turn FROM conversations UNION ALL SELECT conv_id, turn FROM conversations")
def history_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return builders.repeat_to(rows, 2 * rows.count(), "conv_id", "s3")


@query("confusions", with_views(V_STEPS, "SELECT gold_op, op, count(*) AS n FROM v_steps WHERE gold_op <> op GROUP BY ALL ORDER BY n DESC, gold_op, op LIMIT 8"))
def confusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slices.confusions(steps(spark, sf_dir), "gold_op", "op")


@query("family_accuracy", with_views(V_STEPS, "SELECT split, count(*) AS states, count(*) FILTER (WHERE op = gold_op) AS op_right, count(*) FILTER (WHERE op = gold_op AND target_ok) AS all_right FROM v_steps GROUP BY ROLLUP (split)"))
def family_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slices.family_accuracy(steps(spark, sf_dir).withColumn("op_ok", F.col("op") == F.col("gold_op")), "split")


OPS = ["ASK", "CLICK", "DELETE", "DONE", "KEY", "OPEN", "TYPE_TEXT"]


@query("probe_crosstab", with_views(V_STEPS, "SELECT gold_op, " + ", ".join(f"count(*) FILTER (WHERE op = '{o}') AS \"{o}\"" for o in OPS) + " FROM v_steps GROUP BY gold_op"))
def probe_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slices.crosstab(steps(spark, sf_dir), "gold_op", "op", OPS)


@query("undo_counts", with_views(V_STEPS, "SELECT CASE WHEN op = 'CLICK' AND lower(target_text) LIKE '%undo%' THEN 'UNDO' ELSE op END AS op, count(*) AS n FROM v_steps GROUP BY ALL"))
def undo_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(T.is_undo(F.col("op"), F.col("target_text")), "UNDO").otherwise(F.col("op"))
    return steps(spark, sf_dir).select(kind.alias("op")).groupBy("op").agg(F.count("*").alias("n"))


@query("done_slice", with_views(V_STEPS, """SELECT round(count(*) FILTER (WHERE d AND s) / greatest(count(*) FILTER (WHERE d), 1), 6) AS recall, round(count(*) FILTER (WHERE d AND s AND op_conf >= 0.5) / greatest(count(*) FILTER (WHERE d), 1), 6) AS recall_half,
    round(count(*) FILTER (WHERE NOT d AND s) / greatest(count(*) FILTER (WHERE NOT d), 1), 6) AS false_done, round(count(*) FILTER (WHERE NOT d AND op = gold_op) / greatest(count(*) FILTER (WHERE NOT d), 1), 6) AS fix_accuracy
  FROM (SELECT *, gold_op = 'DONE' AS d, op = 'DONE' AS s FROM v_steps)"""))
def done_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(slices.done_slice(steps(spark, sf_dir).withColumn("conf", F.col("op_conf"))))


@query("recovery_slice", with_views(V_STEPS, """SELECT count(*) AS n, round(avg((op <> rejected)::INT::DOUBLE), 6) AS change, round(avg((op = rejected)::INT::DOUBLE), 6) AS stuck, round(avg((op = gold_op)::INT::DOUBLE), 6) AS recovery
  FROM (SELECT *, lag(op) OVER w AS rejected, lag(op) OVER w <> lag(gold_op) OVER w AS failed FROM v_steps WINDOW w AS (PARTITION BY session ORDER BY step)) WHERE failed"""))
def recovery_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("session").orderBy("step")
    rows = steps(spark, sf_dir).withColumns({"rejected": F.lag("op").over(w), "failed": F.lag("op").over(w) != F.lag("gold_op").over(w)})
    return rounded(slices.recovery_slice(rows.filter("failed")))


@query("isolation", with_views(V_Q, """, d AS (SELECT a.item_id, a.qid, max(abs(a.p - b.p)) AS d, arg_max(a.opt, (a.p, -a.opt)) <> arg_max(b.opt, (b.p, -b.opt)) AS flip FROM v_pred a JOIN v_pred b USING (item_id, qid, opt) WHERE a.run = 1 AND b.run = 2 AND a.p IS NOT NULL AND b.p IS NOT NULL GROUP BY ALL)
  SELECT count(*) AS pairs, round(max(d), 6) AS max_delta, count(*) FILTER (WHERE flip) AS flips, arg_max(item_id, (round(d, 9), -item_id)) AS worst FROM d"""))
def isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = answers(spark, sf_dir)
    return rounded(slices.isolation(a.filter("run = 1"), a.filter("run = 2"), ["item_id", "qid"]))


@query("order_flips", with_views(V_Q, """, c AS (SELECT run, item_id, qid, arg_max(opt, (p, CASE WHEN run = 1 THEN -opt ELSE opt END)) AS o, k FROM v_pred WHERE p IS NOT NULL GROUP BY ALL
  ) SELECT count(*) AS pairs, round(avg((a.o <> b.o)::INT::DOUBLE), 6) AS flip_rate, round(avg((a.o = 0)::INT::DOUBLE), 6) AS first_slot, round(avg((b.o = b.k - 1)::INT::DOUBLE), 6) AS first_slot_reordered FROM c a JOIN c b USING (item_id, qid) WHERE a.run = 1 AND b.run = 2"""))
def order_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = answers(spark, sf_dir)
    base = a.filter("run = 1").select("item_id", "qid", (P.argmax(F.col("ps")) - 1).alias("choice"), P.argmax(F.col("ps")).alias("slot"))
    turned = P.argmax(F.reverse("ps"))
    other = a.filter("run = 2").select("item_id", "qid", (F.size("ps") - turned).alias("choice"), turned.alias("slot"))
    return rounded(slices.order_flips(base, other, ["item_id", "qid"]))


@query("acceptance", with_views(V_Q, """SELECT run, item_id, qid, bool_or(r >= top - 1e-9 AND opt = choice) AS "right" FROM (SELECT *, max(r) OVER (PARTITION BY run, item_id, qid) AS top, first_value(opt) OVER (PARTITION BY run, item_id, qid ORDER BY p DESC, opt) AS choice FROM v_pred WHERE p IS NOT NULL) GROUP BY run, item_id, qid"""))
def acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = answers(spark, sf_dir)
    rows = a.select("run", "item_id", "qid", "keys", F.element_at("keys", P.argmax(F.col("ps"))).alias("choice"), F.col("ref").alias("ps"))
    return slices.accepted(rows).select("run", "item_id", "qid", "right")


@query("server_agreement", with_views(V_STEPS, """, s AS (SELECT session // 3 AS grp, step, session % 3 AS server, op FROM v_steps)
  SELECT b.server::INT AS server, count(*) AS n, round(avg((a.op = b.op)::INT::DOUBLE), 6) AS agreement FROM s b JOIN s a ON a.server = 0 AND b.server <> 0 AND a.grp = b.grp AND a.step = b.step GROUP BY b.server"""))
def server_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.struct(F.floor(F.col("session") / 3).alias("grp"), "step")
    rows = steps(spark, sf_dir).select(at.alias("at"), (F.col("session") % 3).cast("int").alias("server"), "op")
    return rounded(slices.positional_agreement(rows, "at", "server", "op", 0))


@query("answer_cache", "SELECT conv_id, turn, role, row_number() OVER (PARTITION BY role, turn % 5 ORDER BY conv_id * 1000 + turn) > 1 AS hit FROM conversations")
def answer_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"))
    keyed = rows.withColumn("key", F.sha2(F.concat_ws("|", "role", (F.col("turn") % 5).cast("string")), 256))
    return routing.cached(keyed, "key", "ord").select("conv_id", "turn", "role", "hit")


@query("stream_route_counts", with_views(V_STEPS, """SELECT CASE WHEN gold_op = 'DONE' AND last_effect = 'unverifiable' THEN 'unverified_last' WHEN gold_op = 'DONE' THEN 'risky_DONE' WHEN gold_op = 'CLICK' AND lower(target_text) LIKE '%undo%' THEN 'risky_undo'
    WHEN least(op_conf, head_conf) < 0.94 THEN 'low_conf' ELSE 'fast_ok' END AS reason, count(*) AS n FROM v_steps GROUP BY ALL"""))
def stream_route_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of gold operations, routed and counted; the result is what the stream has after all files."""
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    e = F.col("event_id")
    op = F.when(F.col("event_type") == "click", "CLICK").when(F.col("event_type") == "view", "OPEN").when(F.col("event_type") == "signup", "TYPE_TEXT").when(F.col("event_type") == "purchase", "DONE").otherwise("ASK")
    rows = events.select(
        op.alias("op"), F.lit(True).alias("has_operation"), ((e * 31 % 100) / 100.0).alias("op_conf"), ((e * 17 % 100) / 100.0).alias("head_conf"),
        F.when(e % 11 == 0, "unverifiable").alias("last_effect"), F.lit(None).cast("string").alias("chord"), F.when(e % 13 == 0, "Undo last change").otherwise("Save").alias("target_text"),
    )
    name = f"routes_{uuid.uuid4().hex}"
    run = routing.reason_counts(T.with_decision(rows)).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name)

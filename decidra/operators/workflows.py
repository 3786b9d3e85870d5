"""Workflow evaluations: cases of several nodes, each asked by catalogue numbers, as items, references and published answers.

Flat inputs: runs (wf, case_id, model, seconds, cost), nodes (wf, case_id, model, node, ran, doc, questions map<string,int>,
answers map<string,string>, and model_order if the run had one), labels (wf, case_id, node, qid, ps, soft), catalogue (wf, idx, question), documents (wf, idx, state).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decidra.operators.builders import consensus

CASE = ["wf", "case_id"]
NODE = [*CASE, "node"]


def node_specs(nodes: DataFrame) -> DataFrame:
    """wf, case_id, node, doc, qid, idx: what a node asks, over all models that ran it; models that disagree on its document end the job.

    Where models give a question another number, the last model of the run has its say: by `model_order` if nodes have it, else by name.
    """
    ran = nodes.filter(F.col("ran") & F.col("doc").isNotNull())
    docs = ran.groupBy(*NODE).agg(F.min("doc").alias("doc"), F.max("doc").alias("_hi"))
    clash = F.raise_error(F.concat(F.lit("models disagree on the document of "), F.concat_ws("/", *NODE))).cast("boolean")
    docs = docs.withColumn("_ok", F.when(F.col("doc") == F.col("_hi"), True).otherwise(clash)).filter("_ok").drop("_ok", "_hi")
    order = F.struct(F.col("model_order") if "model_order" in nodes.columns else F.lit(0), "model").alias("_order")
    asked = ran.select(*NODE, order, F.explode("questions").alias("qid", "idx")).groupBy(*NODE, "qid").agg(F.max_by("idx", "_order").alias("idx"))
    return docs.join(asked, NODE)


def items(nodes: DataFrame, labels: DataFrame, catalogue: DataFrame, documents: DataFrame) -> DataFrame:
    """item_id, wf, case_id, node, state, qid, question, ps, n_sets, soft of every labelled question of a node that some model ran.

    References are the mean of all labellers' answers.
    """
    refs = consensus(labels, [*NODE, "qid"])
    rows = node_specs(nodes).join(refs, [*NODE, "qid"])
    rows = rows.join(catalogue, ["wf", "idx"]).join(documents.select("wf", F.col("idx").alias("doc"), "state"), ["wf", "doc"])
    return rows.select(F.concat_ws("/", *NODE).alias("item_id"), *NODE, "state", "qid", "question", "ps", "n_sets", "soft")


def published(runs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """model, item_id, answers, latency_s and cost_usd of the models' answers to items; a case's time and cost are shared by numbers of answers.

    wanted: items' rows (wf, case_id, node, qid). All of a case's answers count for the shares, those to other nodes too.
    """
    ran = nodes.filter("ran").withColumn("n", F.when(F.col("answers").isNotNull(), F.cardinality("answers")).otherwise(0))
    whole = ran.groupBy(*CASE, "model").agg(F.sum("n").alias("of"))
    known = wanted.groupBy(*NODE).agg(F.collect_set("qid").alias("qids"))
    rows = ran.filter("n > 0").join(known, NODE).join(whole, [*CASE, "model"]).join(runs.select(*CASE, "model", "seconds", "cost"), [*CASE, "model"])
    share = F.col("n") / F.col("of")
    return rows.select("model", F.concat_ws("/", *NODE).alias("item_id"), F.map_filter("answers", lambda q, _: F.array_contains(F.col("qids"), q)).alias("answers"), (F.col("seconds") * share).alias("latency_s"), (F.col("cost") * share).alias("cost_usd"))

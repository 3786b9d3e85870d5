"""Manifests, viewer data, summaries, releases and the HTTP variant of routing."""

import json

import pytest
from pyspark.sql import functions as F

from decidra.operators import contamination, decisions
from decidra.sources import io


def test_thresholds_of_manifests(spark, tmp_path):
    for name, text in (("a", '{"threshold": 0.96}'), ("b", '{"threshold": "high"}'), ("c", "{}"), ("d", "no JSON"), ("e", "")):
        (tmp_path / name).write_text(text)
    got = {n: io.from_manifest(spark, f"file://{tmp_path}/{n}") for n in "abcdef"}
    assert got == {"a": 0.96} | dict.fromkeys("bcdef", 0.94) and io.from_manifest(spark, f"file://{tmp_path}/f", 0.5) == 0.5


def test_viewer_data(spark):
    rows = spark.createDataFrame([("x = 1;\n__VIEWER_DATA__({\"a\": [1, 2],\n \"b\": \")\"});\n",), ("__VIEWER_DATA__({})",)], "text string")
    assert [json.loads(r.v) for r in rows.select(io.viewer_data(F.col("text")).alias("v")).collect()] == [{"a": [1, 2], "b": ")"}, {}]
    with pytest.raises(Exception, match="no viewer data"):
        spark.createDataFrame([("nothing",)], "text string").select(io.viewer_data(F.col("text"))).collect()


def test_suite_summary(spark):
    rows = spark.createDataFrame([("g", "1", "q1", 1.0), ("g", "1", "q2", None), ("g", "2", "q1", 0.0), ("h", "3", "q1", None)], "group string, id string, qid string, reference double")
    assert {tuple(r) for r in io.suite_summary(rows).collect()} == {("g", 2, 2), ("h", 1, 0)}


def test_releases(spark):
    known = spark.createDataFrame([("f1", "s1", "G14"), ("f2", "s2", "G18b")], "fast_sha string, strong_sha string, release string")
    given = lambda *rows: spark.createDataFrame(rows, "fast_sha string, strong_sha string, label string")
    got = contamination.check_release(given(("f1", "s1", "router g14, cold"), ("f2", "s2", "plain"), ("f9", "s9", "unknown")), known).collect()
    assert {(r.label, r.release) for r in got} == {("router g14, cold", "G14"), ("plain", "G18b"), ("unknown", None)}
    for wrong in (("f1", "s1", "G18b"), ("f9", "s9", "g14")):
        with pytest.raises(Exception, match="weights are not of"):
            contamination.check_release(given(wrong), known).collect()


def test_http_routing_takes_the_strong_answers_whole(spark):
    """Where both tiers end the task, the fast one's other heads stay, but not over HTTP."""
    answer = "struct<choice:string,noul:double,score:double,probabilities:map<string,double>>"
    rows = spark.createDataFrame(
        [(1, {"operation": ("choice", ["DONE", "ASK"], {}), "click_target": ("choice", ["1", "2"], {"1": "a", "2": "b"})},
          {"operation": ("DONE", None, None, {"DONE": 0.9, "ASK": 0.1}), "click_target": ("1", None, None, {"1": 0.8, "2": 0.2})}, True, "risky_DONE", 0.9)],
        f"k int, questions map<string,struct<type:string,keys:array<string>,texts:map<string,string>>>, answers map<string,{answer}>, escalate boolean, reason string, conf double",
    )
    strong = spark.createDataFrame([(1, {"operation": ("DONE", None, None, {"DONE": 1.0, "ASK": 0.0}), "click_target": ("2", None, None, {"1": 0.5, "2": 0.5})})], f"k int, answers map<string,{answer}>")
    own, http = (decisions.route_answers(rows, strong, "k", merge_terminal=m).collect()[0] for m in (True, False))
    assert own.final_answers["operation"].probabilities == http.final_answers["operation"].probabilities == {"DONE": 1.0, "ASK": 0.0}
    assert own.final_answers["click_target"].choice == "1" and http.final_answers["click_target"].choice == "2"
    assert own.confirmed and not http.confirmed and own.by == http.by == "strong"

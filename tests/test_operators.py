import hashlib
import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from decidra.functions.text import heads_for, ngrams, session_of, shared_prefix, step_key, tokens
from decidra.operators import batching, calibrate, contamination, metrics, public_tasks, replay, router, runner, slices, variants
from decidra.operators.pages import stream_of
from decidra.operators.text_choices import candidates, spans
from decidra.operators.tournament import rounds_for, tournament
from decidra.sources import io


def one(spark, column):
    return spark.range(1).select(column.alias("v")).collect()[0].v


def pairs(spark, rows):
    return spark.createDataFrame([(1, "g", i, True, c, p, str(c)) for i, (p, c) in enumerate(rows)], "run int, grp string, ord long, answered boolean, correct double, confidence double, label string")


def test_rank_metrics(spark):
    rows = pairs(spark, [(0.9, 1.0), (0.8, 1.0), (0.7, 0.0), (0.6, 0.0)])
    got = metrics.rank_metrics(rows, ["run"], coverage=0.5).collect()[0]
    assert got.aurc == pytest.approx((0 + 0 + 1 / 3 + 2 / 4) / 4)
    assert got.sel_acc_50 == 1.0
    assert got.cov_risk5 == 0.5
    assert metrics.ece(pairs(spark, [(0.95, 1.0)] * 2 + [(0.95, 0.0)] * 2), ["run"]).collect()[0].ece == pytest.approx(0.45)
    assert metrics.balanced_accuracy(pairs(spark, [(0.9, 1.0)]), ["run"]).collect()[0].balanced_accuracy is None


def test_many_keys_and_labels(spark, monkeypatch):
    """Every key's temperature is kept, and labels past 255 are an error."""
    fitted = spark.range(10_500).select(F.col("id").alias("key"), F.lit(0).alias("fold"), F.lit(2.0).alias("t"))
    monkeypatch.setattr(calibrate, "fit", lambda answers, keys: fitted)
    rows = spark.range(10_500).select(F.col("id").alias("key"), F.lit(1).alias("fold_ord"))
    assert calibrate.crossfit(rows, ["key"]).filter("t = 2.0").count() == 10_500
    labels = spark.range(300).select(F.col("id").cast("string").alias("label"))
    assert len(public_tasks.label_set(labels.limit(255), "label")) == 255
    with pytest.raises(ValueError):
        public_tasks.label_set(labels, "label")


def test_temperature(spark):
    rows = spark.createDataFrame([("noul", [0.0, 1.0], [0.4, 0.6])] * 40, "kind string, ref array<double>, ps array<double>")
    assert calibrate.fit(rows, ["kind"]).collect()[0].t < 0.5
    assert calibrate.fit(rows.limit(19), ["kind"]).count() == 0


def test_ids(spark):
    for given, want in (("hands/mail/None/3/41", "hands/mail/None/3"), ("t/4/34/live0", "t/4"), ("t/2/160~filler24", "t/2"), ("single", "single")):
        assert one(spark, session_of(F.lit(given))) == want
    ids = spark.createDataFrame([("t/2/30",), ("t/1/5",), ("t/2/4",), ("t/1/40",)], "id string").withColumn("ord", F.monotonically_increasing_id())
    rows = ids.withColumns({"session": session_of(F.col("id")), "key": step_key(F.col("id"))})
    got = replay.order_for_replay(rows, "session", ["key"], "ord").orderBy("session_first", "position").collect()
    assert [r.id for r in got][:2] == ["t/2/4", "t/2/30"] or [r.id for r in got][:2] == ["t/1/5", "t/1/40"]


def test_heads(spark):
    asked = F.array(*(F.lit(q) for q in ("operation", "type_text_target", "type_text_value", "replace_from", "replace_text_target")))
    assert one(spark, heads_for(F.lit("TYPE_TEXT"), asked)) == ["type_text_target", "type_text_value"]
    assert one(spark, heads_for(F.lit("REPLACE_TEXT"), asked)) == ["replace_text_target", "type_text_value", "replace_from"]


def test_router_order(spark):
    rows = spark.createDataFrame(
        [("DONE", True, 0.97, None, "unverifiable", None, ""), ("DONE", True, 0.97, None, None, None, ""), ("KEY", True, 0.99, None, None, "CMD+S", ""), ("KEY", True, 0.99, None, None, "cmd+z", ""),
         ("CLICK", True, 0.99, None, None, None, "Undo"), ("CLICK", True, 0.94, None, None, None, "x"), ("CLICK", True, 0.939, None, None, None, "x"), (None, False, 0.5, None, None, None, None)],
        "op string, has_operation boolean, op_conf double, head_conf double, last_effect string, chord string, target_text string",
    )
    got = [r.reason for r in router.with_decision(rows).collect()]
    assert got == ["unverified_last", "risky_DONE", "fast_ok", "risky_KEY", "risky_undo", "fast_ok", "low_conf", "judge_low_conf"]


def test_compare_holds_ceilings(spark):
    schema = "gate string, n long, of long"
    base = spark.createDataFrame([("valid_action", 100, 200), ("unauthorized", 14, 281), ("ask", 0, 0), ("false_done", 1, 10)], schema)
    cand = spark.createDataFrame([("valid_action", 98, 200), ("unauthorized", 14, 281), ("ask", 0, 0), ("false_done", 1, 11)], schema)
    got = {r.gate: r.passed for r in replay.compare(base, cand).collect()}
    assert got == {"valid_action": True, "unauthorized": False, "ask": True, "false_done": False}


def test_tournament(spark):
    import numpy as np

    assert [rounds_for(n, 26) for n in (1, 26, 27, 60, 255)] == [0, 0, 1, 1, 2]
    rng = np.random.default_rng(2)
    logits = rng.normal(size=60).round(3).tolist()
    rows = spark.createDataFrame([("q", i, x) for i, x in enumerate(logits)], "q string, opt int, x double")
    got = {r.opt: r.p for r in tournament(rows, "q", 26).collect()}
    assert sum(got.values()) == pytest.approx(1) and max(got, key=got.get) == int(np.argmax(logits)) and len(got) == 60


def test_token_batches(spark):
    rows = spark.createDataFrame([("g", i, n) for i, n in enumerate([1000, 1000, 2500, 900, 900, 900])], "g string, i int, n long")
    got = batching.token_batches(rows, "g", "i", "n", 2, 3072).groupBy("batch").count().orderBy("batch").collect()
    assert [r["count"] for r in got] == [2, 1, 2, 1]
    assert one(spark, batching.batch_sizes(F.array(*(F.lit(n) for n in (1000, 1000, 2500, 900, 900, 900))), 2, 3072)) == [2, 1, 2, 1]


def test_texts(spark):
    assert one(spark, tokens(F.lit("It's 3.5 日本 OK"))) == ["it's", "3.5", "日", "本", "ok"]
    assert one(spark, ngrams(F.array(F.lit("a"), F.lit("b")), 3)) == []
    assert one(spark, shared_prefix(F.array(F.array(F.lit(1), F.lit(2), F.lit(3)), F.array(F.lit(1), F.lit(2), F.lit(4))))) == 2
    found = one(spark, spans(F.lit('Book "Blue Hotel" on September 20, 2026 for 3 in New York and new york')))
    assert found[0] == "September 20, 2026" and "Blue Hotel" in found and "New York" in found and "Book" not in found
    ranked = one(spark, candidates(F.lit("Fly to Paris on 2026-09-20 with 2 bags"), F.lit("Departure"), F.array(F.lit("Oslo"))))
    assert ranked[0] == "2026-09-20" and ranked[-1] == "Oslo"
    assert variants.rename({"a": ["file123.txt", "12"], "n": "file123.txt"}, "s")["a"][1] == "12"
    made = variants.rename({"a": "report77.txt", "b": "see report77.txt"}, "s")
    assert made["b"] == "see " + made["a"] and made["a"] != "report77.txt"


def test_pages():
    html = "<body><div><a href='/x'>Go</a><a href='/y'>Go</a></div><input type='search' placeholder='Find'><script>x</script><div></div></body>"
    assert [(e["role"], e["name"], e["kind"]) for e in stream_of(html)] == [("anchor", "Go", "click"), ("searchbox", "Find", "fill")]
    assert stream_of(None) == []


def test_runs_and_guards(spark):
    log = spark.createDataFrame([(1, 1, "x", "boom"), (1, 2, "y", None), (2, 3, "z", "boom")], "item_id long, n long, ps string, error string")
    assert {r.item_id: r.ps for r in runner.last_wins(log, ["item_id"], "n").collect()} == {1: "y", 2: "z"}
    items = spark.createDataFrame([(1,), (2,), (3,)], "item_id long")
    assert sorted(r.item_id for r in runner.todo(items, log, ["item_id"]).collect()) == [2, 3]

    def predict(item):
        if item["item_id"] == 2:
            raise ValueError("no")
        return {"p": 0.5}

    got = {r.item_id: (r.p, r.error) for r in runner.run_predictions(items, predict, "item_id long, p double, error string").collect()}
    assert got[1] == (0.5, None) and got[2][1] == "ValueError: no"
    rows = spark.createDataFrame([("own model",)], "by string")
    assert contamination.guarded(rows, ["by"], ["hosted"]).count() == 1
    with pytest.raises(Exception, match="not a teacher"):
        contamination.guarded(spark.createDataFrame([("Hosted API",)], "by string"), ["by"], ["hosted"]).collect()
    with pytest.raises(Exception, match="no fixture"):
        replay.rejudge(spark.createDataFrame([(1,)], "id int"), spark.createDataFrame([(2,)], "id int")).collect()


def test_public_tasks(spark):
    assert len(public_tasks.TASKS) == 17
    rows = spark.createDataFrame([(1, "a", "b", 0.5)], "id int, sentence1 string, sentence2 string, score double")
    got = public_tasks.build(rows, "stsb").collect()[0]
    assert got.ref == [0, 0, 0.5, 0.5, 0, 0] and got.stratum == "2.0"
    rows = spark.createDataFrame([(1, "x", "card_lost"), (2, "y", "refund")], "id int, text string, label_text string")
    assert {r.item_id: r.ref for r in public_tasks.build(rows, "banking77").collect()} == {"banking77/1": [1, 0], "banking77/2": [0, 1]}


def test_sources(spark, tmp_path):
    import gzip
    import hashlib

    path = tmp_path / "p.jsonl"
    path.write_text('{"item_id":"a","error":"x"}\n\n{"item_id":"a","latency_s":2.0}\n{"item_id":"b"}\n', encoding="utf-8")
    got = {r.item_id: r.latency_s for r in io.load_predictions(spark, str(path)).collect()}
    assert got == {"a": 2.0, "b": None}
    assert [tuple(e) for e in one(spark, io.ordered_map(F.lit('{"b":1,"10":2,"b":4,"a":3}')))] == [("b", "4"), ("10", "2"), ("a", "3")]
    raw = gzip.compress(b'{"x":1}\n{"x":2}\n', mtime=0)
    (tmp_path / "s.jsonl.gz").write_bytes(raw)
    sets = [{"name": "s", "path": "s.jsonl.gz", "visibility": "public", "count": 2, "sha256": hashlib.sha256(raw).hexdigest(), "ord": 0}, {"name": "t", "path": "t", "visibility": "private", "count": 0, "sha256": "", "ord": 1}]
    rows, notes = io.checked_fixtures(spark, str(tmp_path), sets)
    assert rows.count() == 2 and notes == ["t: not there"]
    with pytest.raises(ValueError, match="sha256"):
        io.checked_fixtures(spark, str(tmp_path), [sets[0] | {"sha256": "0"}])
    bodies = ['{"questions":{},"step":3}', '{"questions":{},"step":"3"}', '{"questions":{},"step":true}', '{"questions":{},"step":3.0}', "nope", "[1]", '{"questions":{},"request_id":""}']
    good, bad = io.validate_requests(spark.createDataFrame([(b,) for b in bodies], "body string"))
    assert good.count() == 1 and {r.code for r in bad.collect()} == {"invalid_json", "invalid_request"}
    assert io.predictor("mlx:m@8bit~t.json") == {"kind": "mlx", "model": "m", "bits": "8", "temperatures": "t.json"}
    assert one(spark, io.option_keys(F.lit('[{"key":"x","description":"d"},{"key":"a","description":"e"}]'), F.lit("choice"))) == ["x", "a"]


def test_stream_cache_and_log(spark, tmp_path):
    from decidra.streaming import routing

    spark.createDataFrame([(1, "fast_ok", "secret"), (2, "low_conf", "secret")], "step int, reason string, state string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("step int, reason string, state string").parquet(str(tmp_path / "in"))
    routing.write_log(stream, str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "log"))
    assert out.columns == ["step", "reason"] and out.count() == 2


def test_question_validators(spark):
    ok = {"a": {"type": "choice", "criteria": {"x": 1}}, "b": {"type": "score", "criteria": ["lo", "hi"]}, "c": {"type": "noul"}, "d": {"type": "choice", "criteria": [{"key": "x", "description": {"y": 1}}]}}
    bad = [
        {"type": "choice", "criteria": {}}, {"type": "choice", "criteria": {str(i): 1 for i in range(256)}}, {"type": "choice", "criteria": []}, {"type": "choice", "criteria": ["x"]}, {"type": "choice"}, {"type": "rank"}, {},
        {"type": "choice", "criteria": [{"key": "x", "description": 1}, {"key": "x", "description": 2}]}, {"type": "choice", "criteria": [{"key": "", "description": 1}]}, {"type": "choice", "criteria": [{"key": "x"}]},
        {"type": "choice", "criteria": [{"key": "x", "description": 1, "more": 2}]}, {"type": "score", "criteria": ["one"]}, {"type": "score", "criteria": list("abcdefghijk")}, {"type": "score", "criteria": {"a": 1, "b": 2}},
    ]
    bodies = [json.dumps({"questions": ok, "step": 1, "state": {"step": "3", "session_id": ""}})] + [json.dumps({"questions": {"q": b}}) for b in bad] + [json.dumps({"questions": {}, k: ""}) for k in ("session_id", "observation_id")]
    good, rejected = io.validate_requests(spark.createDataFrame([(b,) for b in bodies], "body string"))
    assert [r.body for r in good.collect()] == bodies[:1]
    assert [r.field for r in rejected.collect()] == ["questions"] * len(bad) + ["session_id", "observation_id"]


def test_reports_and_digests(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 0.5), ("b", None, float("nan"))], "k string, n int, x double")
    io.write_report({"one": rows.orderBy("k"), "none": rows.limit(0)}, f"file://{tmp_path}/r")
    assert (tmp_path / "r/report.md").read_text() == "## one\n\n| k | n | x |\n|---|---|---|\n| a | 1 | 0.50 |\n| b | – | – |\n\n## none\n\n| k | n | x |\n|---|---|---|\n"
    assert json.loads((tmp_path / "r/summary.json").read_text())["one"][0] == {"k": "a", "n": 1, "x": 0.5}
    many = spark.range(5000).withColumn("t", F.concat(F.lit("row "), "id"))
    digest = lambda df, block=1024: io.content_digest(df, "id", F.col("t"), block).collect()[0].digest
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    level = [sha(f"row {i}") for i in range(5000)]
    while len(level) > 1:
        level = [sha("\n".join(level[i : i + 1024])) for i in range(0, len(level), 1024)]
    assert digest(many) == level[0] == digest(many.repartition(7)) and digest(many.filter("id <> 17")) != level[0] and digest(many.limit(0)) == sha("")
    assert io.by_number(["d/train_10.json", "d/train_2.json", "d/x.json"]) == ["d/train_2.json", "d/train_10.json", "d/x.json"]
    assert io.with_cost(spark.createDataFrame([(1_000_000,), (None,)], "input_tokens long")).collect()[0].cost_usd == pytest.approx(0.042)


def test_renaming_is_one_to_one():
    rng = random.Random(5)
    for n in range(40):
        words = [f"f{rng.randint(0, 30)}.txt" for _ in range(20)] + [str(rng.randint(100, 140)) for _ in range(20)] + [f"T-{rng.randint(10, 40)}" for _ in range(10)] + ["：张伟，", "：李娜，"]
        names = variants.renaming(words, str(n))
        assert len(set(names.values())) == len(names) and not set(names) & set(names.values()) and names == variants.renaming(words, str(n))
        assert all(len(a) == len(b) and (not a.isdigit() or b.isdigit() and b[0] != "0") for a, b in names.items())
    made = variants.rename({"a.txt": "see a1.txt and 4567, T-123", "n": 4567}, "s")
    assert "a.txt" in made and "4567" not in made["a.txt"] and "T-123" not in made["a.txt"] and made["n"] == 4567
    assert {len(k) for k in variants.renaming(["→张伟 "], "s")} == {2}
    crowded = variants.renaming([" ".join(str(n) for n in range(100, 1000))], "s")  # every number of three digits is taken
    assert len(crowded) == len(set(crowded.values())) == 900 and not set(crowded) & set(crowded.values())


def test_item_accuracy(spark):
    rows = [
        ("1", "x", {"operation": {"CLICK": 0.5, "OPEN": 0.5}, "click_target": {"a": 1.0, "b": 0.0}, "open_target": {"a": 1.0}}, {"operation": "OPEN", "open_target": "a", "click_target": "b"}),
        ("2", "x", {"operation": {"CLICK": 1.0, "OPEN": 0.0}, "click_target": {"a": 0.5, "b": 0.5}}, {"operation": "CLICK", "click_target": "b"}),
        ("3", "y", {"operation": {"DONE": 1.0}}, {"operation": "ASK"}), ("4", "y", {"operation": {"DONE": 1.0}}, None),
    ]
    heads = slices.judged_heads(spark.createDataFrame(rows, "id string, kind string, references map<string,map<string,double>>, choices map<string,string>"))
    got = {(r.level, r.name): (r.right, r.n) for r in slices.item_accuracy(heads).collect()}
    assert got == {("all", "all"): (2, 3), ("kind", "x"): (2, 2), ("kind", "y"): (0, 1), ("head", "operation"): (2, 3), ("head", "open_target"): (1, 1), ("head", "click_target"): (1, 1)}
    probes = spark.createDataFrame([("k", "ASK", "ASK"), ("k", "DONE", "not:DONE"), ("k", None, "not:DONE")], "kind string, op string, expect string")
    assert slices.probes(probes, "kind", "op", "expect", ["ASK", "DONE"]).collect()[0].asDict() == {"kind": "k", "n": 3, "hits": 2, "ASK": 1, "DONE": 1}
    stats = spark.createDataFrame([(1.0, "ASK", "fast", "fast_ok"), (2.0, "ASK", None, None), (6.0, "DONE", "strong", "low_conf"), (7.0, "DONE", "strong", "low_conf")], "s double, op string, by string, reason string")
    got = {(r.what, r.name): (r.n, r.p50_s) for r in slices.request_stats(stats, "s", "op", "by", "reason").collect()}
    assert got[("all", "requests")] == (4, 4.0) and got[("op", "ASK")] == (2, 1.5) and got[("by", "strong")] == (2, 6.5) and ("by", None) not in got


def test_latency_tokens(spark):
    tier = "struct<total_s:double,tokenize_s:double,prefill_s:double,score_s:double,checkpoint:string,prefilled_tokens:int,prompt_tokens:int>"
    rows = spark.createDataFrame([(1.0, 0.1, 5, 11.5, (1.0, 0.1, 0.4, 0.2, "hit", 10, 100), None), (3.0, 0.1, 7, 12.5, (1.0, 0.1, 0.4, 0.2, "miss", 30, 300), (2.0, 0.1, 1.0, 0.5, "miss", 50, 500))],
                                 f"total_s double, route_s double, candidates int, peak_memory_gb double, fast {tier}, strong {tier}")
    r = replay.latency_table(rows, []).collect()[0]
    assert (r.fast_prefill_tokens_p50, r.strong_prefill_tokens_p50, r.prompt_tokens_p50, r.prompt_tokens_p95, r.peak_memory_gb_max) == (10, 50, 100, 300, 12.5)


def test_missing_confidence_escalates(spark):
    rows = spark.createDataFrame([("CLICK", True, None, None), ("CLICK", True, None, 0.99), (None, False, None, None)], "op string, has_operation boolean, op_conf double, head_conf double")
    rows = rows.selectExpr("*", "cast(null as string) last_effect", "cast(null as string) chord", "cast(null as string) target_text")
    assert [(r.escalate, r.reason, r.conf) for r in router.with_decision(rows).collect()] == [(True, "low_conf", 0.0)] * 2 + [(True, "judge_low_conf", 0.0)]
    base = spark.createDataFrame([("ask", 1, 2)], "gate string, n long, of long")
    with pytest.raises(Exception, match="lacks the gate"):
        replay.compare(base, base.withColumn("gate", F.lit("false_done"))).collect()


@pytest.mark.parametrize("most", [100, 700, 10_000])
def test_ranks_of_all_levels_in_bounded_windows(spark, most):
    """Most rows share a confidence: the ranks of each level are those of a single window, no path is larger than the bound, and the shuffle has little but the rows."""
    rng = random.Random(3)
    rows = [(rng.randint(1, 2), rng.choice([None, "a", "b", "c"]), i, i % 50 > 0, rng.choice([0.0, 0.5, 1.0]), 1.0 if rng.random() < 0.7 else rng.random()) for i in range(6000)]
    df = spark.createDataFrame(rows, "run int, grp string, ord long, answered boolean, correct double, confidence double")
    kept = [r for r in rows if r[3]]
    paths = [r.n for r in metrics.with_paths(df.filter("answered"), most)[0].groupBy("_path").agg(F.count("*").alias("n")).collect()]
    assert sum(paths) == len(kept) and max(paths) <= most
    levels = [["run"], ["run", "grp"], []]
    out = metrics.ranked(df, levels, most)
    got = {r.ord: r for r in out.collect()}
    assert set(got) == {r[2] for r in kept}
    for i, level in enumerate(levels):
        key = (lambda r: r[0], lambda r: r[:2], lambda r: None)[i]
        for name in {key(r) for r in kept}:
            errors, mine = 0.0, sorted((r for r in kept if key(r) == name), key=lambda r: (-r[5], r[2]))
            for n, r in enumerate(mine, 1):
                errors += 1 - r[4]
                found = got[r[2]]
                assert (found[f"n_{i}"], found[f"rn_{i}"]) == (len(mine), n) and found[f"errors_{i}"] == pytest.approx(errors)
    if most > 100:  # markers: one for each path and group
        assert len(paths) * (2 + 8 + 1) <= 0.2 * len(kept)


def test_selection_is_exact(spark):
    """Ties, signs, magnitudes, infinities and NaN, NULLs, one value, NULL keys: the sorted list's element at every kind of place."""
    from decidra.operators import selection

    rng = random.Random(9)
    inf, nan = float("inf"), float("nan")
    draws = {
        "ties": lambda: float(rng.choice([1, 1, 1, 2, 3])), "wide": lambda: rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300), "odd": lambda: rng.choice([inf, -inf, nan, 0.0, 1.7e308, -1.7e308, 5e-324, None]),
        None: lambda: rng.gauss(1000, 1e-9), "one": lambda: 7.5, "times": lambda: rng.expovariate(1.0),
    }
    rows = [(g, draw()) for g, draw in draws.items() for _ in range(1 if g == "one" else 997)] + [("none", None)]
    wanted = {f"{kind}{round(100 * q)}": ("v", kind, q) for kind in ("nearest", "floor") for q in (0.0, 0.05, 0.5, 0.95, 1.0)} | {"mid": ("v", "median", 0.5)}
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: r for r in selection.percentiles(df, ["g"], wanted).collect()}
    assert set(got) == set(draws)
    order = lambda v: (math.isnan(v), 0 if math.isnan(v) else v)
    for g in draws:
        held = sorted((v for name, v in rows if name == g and v is not None), key=order)
        n = len(held)
        for name, (_, kind, q) in wanted.items():
            if kind == "median":
                want = (held[(n - 1) // 2] + held[n // 2]) / 2
            else:
                want = held[max(math.ceil(q * n), 1) - 1] if kind == "nearest" else held[min(math.floor(q * n), n - 1)]
            assert got[g][name] == want or math.isnan(want) and math.isnan(got[g][name]), (g, name)
    assert selection.percentiles(df.limit(0), ["g"], wanted).count() == 0
    assert selection.percentiles(df.filter("g = 'ties'"), [], {"p": ("v", "nearest", 0.5)}).collect()[0].p == 1.0


def test_spans_in_other_languages(spark):
    """The same spans as the patterns give in Python, whose classes of letters are Unicode's."""
    from decidra.operators import text_choices as T

    def plain(text):
        found = [m[g] for pattern, g in T.PATTERNS for m in re.finditer(pattern, text)]
        found = [v for v in (f.strip(" ,.;:'\"") for f in found) if v and len(v) <= T.LONGEST and v.lower() not in T.STOP]
        out, seen = [], set()
        for v in sorted(found, key=lambda v: -len(v)):
            if v.lower() not in seen:
                seen.add(v.lower())
                out.append(v)
        return out[:40]

    texts = ["Réserver Été à Zürich de Łódź le 5 mai", 'Find "Café Noir" and Élan of Ångström, jose.ñ@exämple.com', "Search ٣٤ hôtels, Straße 12", "从 上海 到 北京 on 2026-05-01, Mar 3, 2026", "naïve Über-Cool O'Neill’s"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(spans(F.col("t")).alias("s")).collect()
    assert [r.s for r in got] == [plain(t) for t in texts]


def test_line_numbers_over_splits(spark, tmp_path):
    """Lines keep their numbers when a file is read in many splits, blank ones counted."""
    lines = [f'{{"id": {i}, "text": "é{"x" * (i % 50)}"}}' if i % 7 else " " for i in range(4000)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\n", encoding="utf-8")
    (tmp_path / "b.jsonl").write_text("one\ntwo", encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = io.read_lines(spark, [f"{tmp_path}/a.jsonl", f"{tmp_path}/b.jsonl"])
        got = {(r.path.rsplit("/", 1)[1], r.line_no): r.value for r in rows.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == {("a.jsonl", i): t for i, t in enumerate(lines) if t.strip()} | {("b.jsonl", 0): "one", ("b.jsonl", 1): "two"}


def test_the_log_goes_on_after_a_restart(spark, tmp_path):
    from decidra.streaming import routing

    schema = "t double, request_id string, reason string, state string"
    source = lambda: spark.readStream.schema(schema).json(f"{tmp_path}/in")
    for n in range(3):  # each time a new query over the same checkpoint
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / f"in/{n}.json").write_text("".join(json.dumps({"t": i, "request_id": f"{n}/{i}", "reason": "fast_ok", "state": "secret"}) + "\n" for i in range(5)))
        routing.write_log(source(), f"{tmp_path}/log", f"{tmp_path}/check").awaitTermination()
        log = spark.read.parquet(f"{tmp_path}/log")
        assert log.count() == log.select("request_id").distinct().count() == 5 * (n + 1) and "state" not in log.columns
    asked = spark.createDataFrame([("k", 1, "r1", "yes"), ("k", 2, "r2", "no"), ("j", 3, "r3", "maybe")], "key string, at int, request_id string, answer string")
    assert {r.request_id: (r.answer, r.hit) for r in routing.echoed(asked, "key", "at", "answer").collect()} == {"r1": ("yes", False), "r2": ("yes", True), "r3": ("maybe", False)}


def test_batches_are_rectangular(spark):
    rows = spark.createDataFrame([(0, [5, 6, 7], [1, 2], [0.9, 0.1], 0), (0, [5], [3, 4, 1], [0.2, 0.3, 0.5], 2), (1, [8, 9], [1, 2], [1.0, 0.0], 0)], "batch int, input_ids array<int>, label_ids array<int>, teacher array<double>, gold int")
    got = {(r.batch, r.gold): r for r in batching.collated(rows, "batch", 99).collect()}
    first, second = got[0, 0], got[0, 2]
    assert (first.input_ids, first["mask"], first["last"], first.label_ids, first.valid, first.teacher) == ([5, 6, 7], [1, 1, 1], 2, [1, 2, 1], [True, True, False], [0.9, 0.1, 0.0])
    assert (second.input_ids, second["mask"], second["last"], second.label_ids, second.valid) == ([5, 99, 99], [1, 0, 0], 0, [3, 4, 1], [True] * 3)
    assert got[1, 0].input_ids == [8, 9] and got[1, 0].valid == [True, True]


def test_a_stream_of_batches(spark):
    """Batches over one stream hold what the budget lets them, in order, but for cuts between partitions."""
    lengths = [(i, random.Random(i).randint(1, 900)) for i in range(2000)]
    rows = batching.batch_stream(spark.createDataFrame(lengths, "i int, n long").withColumn("text", F.lit("x")).repartition(3), "i", "n", 6, 3000).collect()
    batches = {}
    for r in sorted(rows, key=lambda r: r.i):
        batches.setdefault(r.batch, []).append(r)
    plain = batching._packed([n for _, n in lengths], 6, 3000)
    assert len(rows) == 2000 and len(batches) <= plain[-1] + 1 + 4
    for held in batches.values():
        assert len(held) <= 6 and max(r.n for r in held) * len(held) <= 3000 and [r.i for r in held] == list(range(held[0].i, held[0].i + len(held)))


def test_http_predictor(spark):
    """Against a server of our own: answers, cost by tokens, and errors that don't end the run."""
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Server(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            known = body["state"] != "bad" and self.headers["Authorization"] == "Bearer key" and body["model"] == "m"
            self.send_response(200 if known else 500)
            self.end_headers()
            if known:
                self.wfile.write(json.dumps({"answers": {q: {"choice": body["state"]} for q in body["questions"]}, "usage": {"input_tokens": 1000} if body["state"] == "a" else {}}).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    items = spark.createDataFrame([(s, json.dumps(s), '{"q": {}}') for s in ("a", "b", "bad")], "item_id string, state string, questions string")
    got = {r.item_id: r for r in runner.run_predictions(items, runner.http_predictor(f"http://127.0.0.1:{server.server_port}/ask", "m", "key"), runner.HTTP).collect()}
    server.shutdown()
    assert json.loads(got["a"].answers) == {"q": {"choice": "a"}} and got["a"].cost_usd == pytest.approx(0.000042) and got["a"].latency_s > 0
    assert got["b"].cost_usd is None and got["b"].error is None and "500" in got["bad"].error and got["bad"].answers is None


def test_the_last_model_of_the_run_numbers_a_question(spark):
    from decidra.operators import workflows

    nodes = [("w", 1, m, "n", True, 1, {"q": i}, {"q": "x"}, o) for m, i, o in (("b", 5, 0), ("a", 7, 1))]
    df = spark.createDataFrame(nodes, "wf string, case_id int, model string, node string, ran boolean, doc int, questions map<string,int>, answers map<string,string>, model_order int")
    assert workflows.node_specs(df).collect()[0].idx == 7 and workflows.node_specs(df.drop("model_order")).collect()[0].idx == 5


def test_slots_and_modes(spark):
    from decidra.operators import builders

    prompts = spark.createDataFrame([("one", ["A", "B"]), ("three", ["A", "B", "C"])], "prompt string, labels array<string>")
    scored = runner.scored_prompts(prompts, lambda texts, labels: [[len(t) + i for i, _ in enumerate(ls)] for t, ls in zip(texts, labels, strict=True)])
    assert {r.prompt: r.logits for r in scored.collect()} == {"one": [3.0, 4.0], "three": [5.0, 6.0, 7.0]}
    rows = spark.createDataFrame([("t/1/5", 0), ("t/2/9", 1), ("t/1/41", 2)], "id string, ord int")
    known = replay.tagged(rows, "gym", "id", F.array(F.lit("terminal")), F.when(F.col("ord") == 1, F.lit("other")))
    assert {r.id: (r.set, r.session) for r in known.collect()} == {"t/1/5": ("gym", "t/1"), "t/2/9": ("gym", "other"), "t/1/41": ("gym", "t/1")} and {r.split for r in known.collect()} <= {"dev", "holdout"}
    ordered = replay.order_for_replay(known.withColumn("key", step_key(F.col("id"))), "session", ["key"], "ord")
    assert {(r.id, r["mode"]): r.fresh for r in replay.with_modes(ordered).collect()} == {
        ("t/1/5", "cold"): True, ("t/1/41", "cold"): True, ("t/2/9", "cold"): True, ("t/1/5", "warm"): True, ("t/1/41", "warm"): False, ("t/2/9", "warm"): True,
    }
    seven = builders.repeat_to(spark.range(3).withColumnRenamed("id", "k"), 7, "k", "s").groupBy("k").count().collect()
    assert sorted(r["count"] for r in seven) == [2, 2, 3] and builders.repeat_to(spark.range(3).withColumnRenamed("id", "k"), 2, "k", "s").count() == 2
    both = io.concatenated({"x": rows, "y": rows.withColumn("more", F.lit(1))}, "ord").orderBy("source_ord", "ord").collect()
    assert [(r.source_name, r.ord, r.more) for r in both] == [("x", i, None) for i in range(3)] + [("y", i, 1) for i in range(3)]
    lines = io.encoded(spark.createDataFrame([("a", None, {"q": "1"})], "item_id string, latency_s double, answers map<string,string>"), ["item_id", "latency_s", "answers"])
    assert [r.value for r in lines.collect()] == ['{"item_id":"a","answers":{"q":"1"}}'] and io.parse(lines, io.PREDICTION).collect()[0].answers == {"q": "1"}
    states = spark.createDataFrame([(1, "f"), (2, "f"), (3, "g")], "id int, family string")
    right = spark.createDataFrame([(1, True, False)], "id int, op_ok boolean, target_ok boolean")
    assert {r.family: (r.states, r.op_right, r.all_right) for r in slices.family_states(states, right, "id", "family").collect()} == {"f": (2, 1, 0), "g": (1, 0, 0), None: (3, 1, 0)}

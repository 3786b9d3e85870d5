"""Typed steps: corrections, labels, counterexamples, filler, closed-loop fixtures and sets, against values written out by hand."""

import copy
import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from decidra.operators import counterexamples as C
from decidra.operators import fixtures, steps, traces
from decidra.operators.variants import flat_text
from decidra.sources import io

ROW = {
    "state": {
        "elements": [{"index": "1", "role": "row", "label": "a"}, {"index": "2", "role": "button", "label": "缩放按钮"}, {"index": "3", "role": "cell", "label": "b"}],
        "page": {"title": "Box", "text": "x"}, "effects_so_far": ["moved 'a' to 'Bin'"], "recent_actions": [{"action": "drag", "page_changed": False}],
    },
    "questions": {
        "operation": {"type": "choice", "instructions": "?", "criteria": {"CLICK": "", "OPEN": "", "DONE": ""}},
        "click_target": {"type": "choice", "instructions": "?", "criteria": {"1": {"element": "[1] a", "role": "row"}, "2": {"element": "[2] 缩放按钮"}, "3:1": {"element": "[3:1] b", "role": "cell"}}},
        "type_text_value": {"type": "choice", "instructions": "?", "criteria": {"2": {"value": "v"}}},
    },
    "label": {"operation": {"choice": "OPEN"}, "click_target": {"choice": "3:1", "probabilities": {"3:1": 0.6, "1": 0.3}}},
}


def row(**changes):
    return copy.deepcopy(ROW) | changes


def frame(spark, rows):
    """k and the rows' state, questions and label, typed."""
    return steps.typed(spark.createDataFrame([(i, *(json.dumps(r[c]) for c in ("state", "questions", "label"))) for i, r in enumerate(rows)], "k long, state string, questions string, label string"), label=steps.LABEL)


def by_key(df):
    return {r.k: r for r in df.collect()}


def test_chrome_and_labels(spark):
    alone = row(label={"operation": {"choice": "CLICK"}, "click_target": {"choice": "2"}})
    odd = row(label={"click_target": {"choice": "1"}})
    clean = traces.without_chrome(frame(spark, [row(), alone, odd]))
    got = by_key(clean)
    assert set(got) == {0, 2} and [e["index"] for e in got[0].state.elements] == ["1", "3"] and list(got[0].questions["click_target"].criteria) == ["1", "3:1"] and got[0].questions["type_text_value"].criteria["2"].value == "v"
    item = by_key(traces.with_references(clean))
    assert set(item) == {0} and item[0].references["click_target"] == {"1": pytest.approx(1 / 3), "3:1": pytest.approx(2 / 3)} and item[0].soft == ["click_target"] and item[0].gold_op == "OPEN"
    assert item[0].teacher["click_target"]["1"] == pytest.approx(0.95 / 3 + 0.025) and item[0].teacher["operation"] == {"CLICK": pytest.approx(0.025), "OPEN": 0.95, "DONE": pytest.approx(0.025)}
    said = frame(spark, [row(), row(state={}), row(state={"recent_actions": [{"action": "x", "ok": True}]})])
    told = by_key(said.select("k", traces.rejected_label(F.col("state")).alias("r"), traces.label_of(F.col("questions"), F.lit("CLICK"), F.lit("3:1")).alias("l")))
    assert [told[i].r for i in range(3)] == ["drag", None, None] and told[0].l == "b"


def test_shift_and_undo(spark):
    moved = by_key(traces.shifted(frame(spark, [row()]), F.lit(2)))[0]
    assert [e["index"] for e in moved.state.elements] == ["1", "3", "4"] and {k: o.element for k, o in moved.questions["click_target"].criteria.items()} == {"1": "[1] a", "3": "[3] 缩放按钮", "4:1": "[4:1] b"}
    assert moved.label["click_target"].choice == "4:1" and moved.label["click_target"].probabilities == {"4:1": 0.6, "1": 0.3} and list(moved.questions["type_text_value"].criteria) == ["2"]

    def renaming(given):
        out = row(label={"operation": {"choice": "RENAME"}, "rename_target": {"choice": "1"}})
        out["questions"]["rename_target"] = {"criteria": {"1": {"element": "[1] y.txt"}}}
        out["state"]["effects_so_far"] = [f"renamed 'x.txt' to '{given}'"]
        return out

    created, there = row(), row()
    created["state"]["effects_so_far"] = ["created folder 'n'"]
    there["state"]["elements"][0]["id"] = "syn:undo"
    rows = frame(spark, [row(), row(label={"operation": {"choice": "DELETE"}}), created, renaming("y.txt"), renaming("z.txt"), there, row(state={})])
    made, looped = by_key(traces.undo_counterexamples(rows, "k")), by_key(traces.undo_counterexamples(rows, "k", looped=True))
    assert set(made) == {0, 2, 4} and set(looped) == {0, 4}
    at = next(i for i, e in enumerate(made[0].state.elements) if e.id == "syn:undo")
    button = made[0].state.elements[at]
    assert button.label == "撤销上一步：把「a」移回「Box」" and button["index"] == str(at + 1) and at + 1 in (2, 3, 4) and len({e["index"] for e in made[0].state.elements}) == 4
    assert made[0].questions["click_target"].criteria[button["index"]].element == f"[{button["index"]}] {button.label}" and len(made[0].questions["click_target"].criteria) == 4
    assert looped[0].state.effects_so_far == ["moved 'a' to 'Bin'", "moved 'a' to 'Box' (undo) ✓", "moved 'a' to 'Bin'"] and [a.action for a in looped[0].state.recent_actions] == ["drag", button.label, "drag"]
    assert "把「z.txt」改回「x.txt」" in next(e.label for e in made[4].state.elements if e.id == "syn:undo")


def test_folder_clicks_and_filters(spark):
    typed = row(label={"operation": {"choice": "TYPE_TEXT"}, "type_text_value": {"choice": "2"}})
    typed["state"]["recent_actions"] = [{"kind": "fill", "action": "新建文件夹的名称", "text": "v"}]
    whole = copy.deepcopy(typed)
    whole["state"]["elements"] += [{"index": "4", "role": "button", "label": "新建文件夹"}, {"index": "5", "label": "新建文件夹的名称", "current_value": None}]
    whole["questions"]["click_target"]["criteria"]["4"] = {"element": "[4] 新建文件夹"}
    other = copy.deepcopy(whole)
    other["state"]["recent_actions"][0]["text"] = "other"
    got = by_key(traces.folder_click(frame(spark, [typed, whole, other, row()])))
    assert [got[i].relabelled for i in range(4)] == [False, True, False, False]
    assert {q: a.choice for q, a in got[1].label.items()} == {"operation": "CLICK", "click_target": "4"} and got[1].state.elements[-1].current_value in (None, "v") and got[3].label["operation"].choice == "OPEN"
    asked = row()["questions"] | {"click_target": {"criteria": {"1": {"element": "[1] Open mail", "role": "searchbox"}, "2": {"role": "cell"}}}}
    rows = frame(spark, [row(questions=asked)] * 3).join(spark.createDataFrame([(0, {"operation": {"CLICK": 1.0}, "click_target": {"1": 0.9, "2": 0.1}}), (1, {"operation": {"CLICK": 1.0}, "click_target": {"1": 0.1, "2": 0.9}}), (2, {})], f"k long, refs {steps.MASS}"), "k")
    judged = by_key(rows.select("k", traces.plain_open(F.col("questions"), F.col("refs")).alias("p"), traces.row_click(F.col("questions"), F.col("refs")).alias("r"), steps.order_digest(F.col("questions")).alias("d")))
    assert [(judged[i].p, judged[i].r) for i in range(3)] == [(True, False), (False, True), (False, False)]
    turned = {"click_target": asked["click_target"]} | asked
    digests = by_key(frame(spark, [row(questions=asked), row(questions=turned)]).select("k", steps.order_digest(F.col("questions")).alias("d")))
    assert digests[0].d == judged[0].d != digests[1].d


def doc_items(spark, rows):
    """(goal, body, gold, more options, title, windows, value) as typed items."""
    out = []
    for i, (goal, body, gold, more, title, windows, value) in enumerate(rows):
        state = {"elements": [{"index": "1", "role": "textArea", "label": body, "current_value": body}], "page": {"title": title, "text": body}, "recent_actions": [{"text": body, "action": "type"}], "read_in_other_windows": windows}
        asked = {"operation": {"type": "choice", "instructions": {"goal": goal}, "criteria": {o: "" for o in ("DONE", "REPLACE_TEXT", "APPEND_TEXT", "TYPE_TEXT", *more)}}} | ({"type_text_value": {"criteria": {"1": {"value": value}}}} if value else {})
        refs = {"operation": {gold: 1.0}} | ({"type_text_value": {"1": 1.0}} if value else {})
        out.append((i, *map(json.dumps, (state, asked, refs, {"operation": {gold: 0.95, "TYPE_TEXT": 0.05}})), gold))
    return steps.typed(spark.createDataFrame(out, "k long, state string, questions string, references string, teacher string, gold_op string"), references=steps.MASS, teacher=steps.MASS)


def test_spoilt_documents_and_pools(spark):
    done = lambda goal, body, more=(), gold="DONE", title="n.txt", windows=(), value=None: (goal, body, gold, more, title, list(windows), value)
    rows = [done("Change it from draft to final.", "s: final\nx")] * 30 + [done("append a line", "a\nb"), done("排序", "a\nb\nc"), done("nothing", "zz"), done("Change it from draft to final.", "s: final", gold="TYPE_TEXT"), done("append a line", "  ")]
    got = by_key(C.counterexamples(doc_items(spark, rows), "k", {"spoilt": 100}))
    assert set(got) == {*range(30), 30, 31} and {got[i].kind for i in range(30)} == {"corrupt_revert", "corrupt_wrong"}
    for i in range(30):
        s = got[i].state
        shown = {s.elements[0].current_value, s.elements[0].label, s.page.text, s.recent_actions[0].text}
        assert len(shown) == 1 and got[i].gold_op == "REPLACE_TEXT" and got[i].references == {"operation": {"DONE": 0.0, "REPLACE_TEXT": 1.0, "APPEND_TEXT": 0.0, "TYPE_TEXT": 0.0}}
        (text,) = shown
        assert text.endswith("\nx") and (text == "s: draft\nx" if got[i].kind == "corrupt_revert" else text[3:-2] in C.VALUES and text != "s: final\nx")
    assert (got[30].kind, got[30].gold_op, got[30].state.page.text) == ("corrupt_drop", "APPEND_TEXT", "a\n") and (got[31].kind, got[31].gold_op, got[31].state.page.text) == ("corrupt_order", "TYPE_TEXT", "a\nc\nb")
    assert C.counterexamples(doc_items(spark, rows), "k", {"spoilt": 7}).count() == 7


def test_siblings_go_to_their_pools(spark):
    rows = [("Do it", "s: final 3", g, m, t, [], None) for g, m, t in (("DONE", (), "n1.txt"), ("DONE", ("FOCUS_WINDOW",), "n1.txt"), ("TYPE_TEXT", (), "n.txt"), ("TYPE_TEXT", (), "plain"), ("FOCUS_WINDOW", ("FOCUS_WINDOW",), "n1.txt"))]
    items = doc_items(spark, rows)
    got = C.counterexamples(items, "k", {"sibling_done": 10, "sibling_open": 10}).collect()
    assert {(r.k, r.rule, r.kind) for r in got} == {(0, "sibling_done", "sibling_done"), (2, "sibling_open", "sibling_keep")}
    for r in got:
        (window,) = r.state.read_in_other_windows
        assert window.window not in ("n1.txt", "n.txt") and "s: draft 3" in window.text and window.text.splitlines()[4] == window.window
        assert r.references["operation"]["FOCUS_WINDOW"] == 0.0 and sum(r.teacher["operation"].values()) == pytest.approx(1) and list(r.questions["operation"].criteria)[-1] == "FOCUS_WINDOW"
        goal = r.questions["operation"].goal
        assert goal == "Do it" or goal.startswith("Do it。") and window.window in goal
    names = by_key(spark.range(60).select(F.col("id").alias("k"), C.sibling_name(F.lit("a19.txt"), F.col("id")).alias("n"), C.sibling_name(F.lit("a.txt"), F.col("id")).alias("e"), C.sibling_name(F.lit("plain"), F.col("id")).alias("p"), C.other_value(F.lit("12.5"), F.col("id")).alias("v")))
    assert all(r.n != "a19.txt" and len(r.n) == 7 and r.e in {f"a{x}.txt" for x in C.ENDINGS} and r.p is None and r.v != "12.5" and r.v[2:] == ".5" for r in names.values())


def test_questions_to_ask(spark):
    window = [{"window": "w", "text": "one\nid A-123456\nend"}]
    rows = [("copy the number", "x", "TYPE_TEXT", (), "n.txt", window, "A-123456"), ("copy A-123456", "x", "TYPE_TEXT", (), "n.txt", window, "A-123456"), ("copy the number", "x", "DONE", (), "n.txt", window, "A-123456"),
            ("copy the number", "x", "APPEND_TEXT", (), "n.txt", [{"window": "w", "text": "A-123456\nA-123456"}], "A-123456")]
    (r,) = C.counterexamples(doc_items(spark, rows), "k", {"ask": 9}).collect()
    lines = r.state.read_in_other_windows[0].text.split("\n")
    assert r.k == 0 and len(lines) == 4 and sum(x.startswith("id A-") for x in lines) == 2 and "id A-123456" in lines and len(set(lines)) == 4 and r.gold_op == "ASK" and r.references["operation"]["ASK"] == 1.0


def test_filler(spark):
    state = {"elements": [{"index": "1", "role": "row", "label": "Juno Pike"}], "page": {"text": "t"}}
    asked = {"operation": {"type": "choice", "instructions": {"goal": "g"}, "criteria": {"CLICK": "", "DONE": ""}}, "click_target": {"type": "choice", "criteria": {"1": {"element": "[1] Juno Pike", "role": "row", "current_value": "x"}}},
             "type_text_target": {"type": "choice", "criteria": {"1": {"element": "[1]"}}}}
    refs = {"operation": {"CLICK": 1.0, "DONE": 0.0}, "click_target": {"1": 1.0}}
    items = steps.typed(spark.createDataFrame([(str(i), *map(json.dumps, (state, asked, refs))) for i in range(20)], "k string, state string, questions string, references string"), references=steps.MASS)
    got = fixtures.filler_fixtures(items, "k").collect()
    assert {int(r.id.rsplit("filler", 1)[1]) for r in got} == set(fixtures.FILLER_ROWS)
    for r in got:
        n = int(r.id.rsplit("filler", 1)[1])
        more = r.state.elements[1:]
        assert [e["index"] for e in r.state.elements] == [str(i) for i in range(1, 5 * n + 2)] and not any("Juno" in e.label for e in more) and [e.role for e in more[:5]] == ["row", "cell", "cell", "cell", "cell"]
        assert more[0].label == " · ".join((more[1].label, more[2].label, more[4].label)) and more[0].id == "filler_0_row_2"
        target = r.questions["click_target"].criteria
        assert len(target) == 5 * n + 1 and (target["2"].element, target["2"].role, target["2"].current_value, target["2"].value) == (f"[2] {more[0].label}", "row", "", None)
        assert len(r.questions["type_text_target"].criteria) == 1 and len(r.questions["operation"].criteria) == 2 and sum(r.references["click_target"].values()) == 1.0 and len(r.references["click_target"]) == 5 * n + 1 and len(r.references["operation"]) == 2
        assert r.state.page.text.count("\n") == n


def test_closed_loop(spark):
    base = {"state": ROW["state"], "questions": ROW["questions"], "label": {"operation": {"choice": "CLICK"}, "click_target": {"choice": "1"}}}
    rows = [("mail", 1, base, "oracle", "fast"), ("mail", 2, base, "planner", None), ("music", 1, base | {"label": None}, "oracle", None)]

    def steps_of(rows):
        df = spark.createDataFrame([(t, n, *(json.dumps(r[c]) if r[c] is not None else None for c in ("state", "questions", "label")), s, {"operation": ("DONE", 0.5)}, True, by) for t, n, r, s, by in rows],
                                   "task string, step long, state string, questions string, label string, label_source string, answers map<string,struct<choice:string,confidence:double>>, passed boolean, routing string")
        return fixtures.closed_loop_fixtures(steps.typed(df, label=steps.LABEL), "run")

    (r,) = steps_of(rows).collect()
    assert (r.id, r.session, r.gold_op) == ("run/mail/1", "run/mail", "CLICK") and r.split in ("dev", "holdout") and r.references["click_target"] == {"1": 1.0, "2": 0.0, "3:1": 0.0}
    assert r.closed_loop.choices == {"operation": "DONE"} and (r.closed_loop.confidence, r.closed_loop.routing, r.closed_loop.task_passed, len(r.closed_loop.options_digest)) == (0.5, "fast", True, 64)
    with pytest.raises(Exception, match="isn't among"):
        steps_of([("mail", 1, base | {"label": {"operation": {"choice": "X"}}}, "oracle", None)]).collect()


def test_sets_hash_alike(spark, tmp_path, monkeypatch):
    """Two runs, of other partitions and shuffles, write equal bytes: lines in order, in several members, and their manifest."""
    monkeypatch.setattr(fixtures, "MEMBER_ROWS", 7)
    items = spark.range(40).select(F.concat(F.lit("t/"), F.col("id") % 10).alias("grp"), F.format_string("t/%d/%02d", F.col("id") % 10, "id").alias("id"))
    pairs = fixtures.whole_groups(items, "grp", 3, 4)
    assert pairs.count() == 12 and fixtures.whole_groups(items, "grp", 3, 5).count() == 0
    clicks = fixtures.one_of_each(items, "grp", "id", 25)
    assert sorted(r["count"] for r in clicks.groupBy("grp").count().collect()) == [2] * 5 + [3] * 5 and sorted(clicks.collect()) == sorted(fixtures.one_of_each(items.repartition(7), "grp", "id", 25).collect())
    key, before, made = "spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"), []
    for n, parts in ((1, "3"), (2, "11")):
        spark.conf.set(key, parts)
        sets = {"pairs": pairs, "clicks": clicks, "all": items.repartition(n + 1), "none": items.limit(0)}
        lines = {k: v.select("id", F.to_json(F.struct("id", "grp")).alias("value")) for k, v in sets.items()}
        made.append(fixtures.write_sets(lines, f"file://{tmp_path}/{n}", dict.fromkeys(sets, {"visibility": "public"}), name="m", version="1"))
        spark.conf.set(key, before)
    assert made[0] == made[1] and [s["count"] for s in made[0]["sets"]] == [12, 25, 40, 0] and json.loads((tmp_path / "1/manifest.json").read_text()) == made[0]
    for s in made[0]["sets"]:
        one, two = ((tmp_path / f"{n}/{s['path']}").read_bytes() for n in (1, 2))
        assert one == two and hashlib.sha256(one).hexdigest() == s["sha256"]
    want = sorted(r.id for r in items.collect())
    assert [json.loads(x)["id"] for x in gzip.decompress((tmp_path / "1/all.jsonl.gz").read_bytes()).decode().splitlines()] == want
    rows, notes = io.checked_fixtures(spark, f"file://{tmp_path}/1", [s | {"ord": i} for i, s in enumerate(made[0]["sets"]) if s["count"]])
    assert rows.count() == 77 and notes == [] and flat_text({"a": ["x", 1, None], "b": {"c": "y"}}) == "x 1  y"

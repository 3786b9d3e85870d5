"""The additive quality model: its trees against plain searches, held-out accuracy, odd rows."""

import itertools
import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from decidra.llm import quality as q
from decidra.llm._common import ship

SF = "/root/testdata/sf0.1"


def gain(g, h):
    return g**2 / (h + q.RIDGE)


def test_best_cut_is_the_best():
    rng = np.random.default_rng(2)
    for _ in range(50):
        g, h, n = rng.normal(size=9), rng.uniform(1, 4, 9), rng.integers(0, 9, 9).astype(float)
        fine = [i for i in range(1, 9) if n[:i].sum() >= q.LEAST_LEAF and n[i:].sum() >= q.LEAST_LEAF]
        got, at = q.best_cut(g, h, n)
        want = {i: gain(g[:i].sum(), h[:i].sum()) + gain(g[i:].sum(), h[i:].sum()) - gain(g.sum(), h.sum()) for i in fine}
        assert (at in want and got == pytest.approx(max(want.values())) == pytest.approx(want[at])) if want else got == -np.inf


def test_trees_have_three_and_four_leaves():
    g, ones = np.array([1.0, 1, 1, -5, -5, -5, 3, 3, 3]), np.full(9, 9.0)
    step = q.shallow_tree(g, ones, ones)
    assert [len(list(x)) for _, x in itertools.groupby(step)] == [3, 3, 3]
    assert step[0] == pytest.approx(3 / (27 + q.RIDGE))
    cells = np.array([[1.0, 1, -1, -1], [1, 1, -1, -1], [-1, -1, 1, 1], [-1, -1, 1, 1]]) + np.array([[0.01], [0.01], [-0.01], [-0.01]])
    found, grid = q.shallow_grid(9 * cells, np.full((4, 4), 9.0), np.full((4, 4), 9.0))
    assert found > 0 and len(np.unique(grid.round(9))) == 4 and (np.sign(grid) == np.sign(cells)).all()


def test_pairs_find_what_single_tables_cannot():
    rng = np.random.default_rng(4)
    x = rng.uniform(-1, 1, (4000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0)).astype(float)
    check = np.arange(4000) % 5 == 0
    model = q.fit(x, y, check)
    assert {(a, b) for a, b, *_ in model.pairs} & {(0, 2)}
    assert ((q.scores(model, x) > 0.5) == (y > 0))[check].mean() > 0.9


def test_scores_add_one_value_of_each_table():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 3)).round(1)
    model = q.fit(x, (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=600) > 0).astype(float), np.arange(600) % 5 == 0)
    probe = rng.normal(size=(50, 3)) * 3
    place = lambda v, edges: sum(v >= e for e in edges)
    for row, score in zip(probe, q.scores(model, probe), strict=True):
        z = model.intercept + sum(t[place(row[j], e)] for j, (e, t) in enumerate(zip(model.edges, model.tables, strict=True)))
        z += sum(grid[place(row[a], e), place(row[b], f)] for a, b, e, f, grid in model.pairs)
        assert score == pytest.approx(1 / (1 + np.exp(-z)))


def test_measures():
    assert q.measures(b"") == [0.0] * len(q.NAMES)
    got = dict(zip(q.NAMES, q.measures("One two two.\nOne two two.\n\n##!".encode()), strict=True))
    assert got["log_words"] == pytest.approx(np.log(8)) and got["distinct_words"] == pytest.approx(np.log(4) / np.log(7))
    assert got["top_word"] == 2 / 7 and got["distinct_lines"] == 2 / 3 and got["ended_lines"] == 1 and got["signed_words"] == 0 and got["upper"] == 2 / 18
    assert all(np.isfinite(q.measures(t)).all() for t in (b" ", b"\n", b"x", b"\xff\xfe", "ö".encode() * 9, b"word " * 200_000))


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    clean, junk = "The committee met in the morning and agreed on a plan for the river. ", "BUY!! NOW!! ### $$$ "
    rng = np.random.default_rng(1)
    text = lambda i: " ".join(rng.permutation(((clean if i % 3 else junk) * 6).split()))
    rows = [(i, text(i)) for i in range(300)] + [(1000, None), (1001, ""), (1002, "   "), (1003, "word " * 300_000), (3, text(3)), (5, None), (None, "a b"), (1004, "ö" * 50)]
    return spark.createDataFrame([(*r, 0, "x", 0.5, "m", True) for r in rows], "doc_id long, text string, label int, lang string, score double, measures string, held_out boolean")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 3 > 0), 0, "t") for i in range(250)] + [(1, 0, 0, "t"), (None, 1, 0, "t"), (7, None, 0, "t"), (9999, 1, 0, "t")], "doc_id long, quality int, toxic int, text string")


def test_held_out_rows(docs, labels):
    rows = q.quality(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    judged = [(r.predicted, int(r.doc_id % 3 > 0)) for r in rows if r.doc_id is not None and r.doc_id < 300 and r.held_out]
    assert len(judged) > 40 and np.mean([a == b for a, b in judged]) == 1
    by = {r.doc_id: r.score for r in rows}
    assert by[1000] == by[1001] and len({r.score for r in rows if r.doc_id == 9}) == 1
    again = {(r.doc_id, r.score) for r in q.quality(docs.repartition(5), labels.repartition(3)).collect()}
    assert again == {(r.doc_id, r.score) for r in rows}


def test_little_to_learn_from(docs, labels):
    share = lambda n1, n: (n1 + 1) / (n + 2)
    assert {r.score for r in q.quality(docs, labels.limit(0)).collect()} == {0.5}
    ones = labels.filter("quality = 1 AND doc_id < 100")
    n = ones.filter(~q.held_out()).count()
    assert {round(r.score, 12) for r in q.quality(docs, ones).collect()} == {round(share(n, n), 12)}
    assert q.quality(docs.limit(0), labels).count() == 0


def test_contradictory_labels_count_as_0(spark, docs):
    rows = [(i, v) for i in range(200) for v in (0, 1)]
    model = q.fit_on(docs, spark.createDataFrame(rows, "doc_id long, quality int"))
    assert q._logistic(np.array([model.intercept]))[0] < 0.01


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")
def test_accuracy_of_the_tables_held_out_rows(spark):
    ship(spark)
    documents, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    both = q.quality(documents, labels).filter("held_out").join(labels, "doc_id").groupBy("quality").agg(F.avg("predicted").alias("share")).collect()
    share = {r.quality: r.share for r in both}
    assert share[1] > 0.99 and share[0] < 0.03

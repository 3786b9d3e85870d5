"""The operators on small tables with nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from decidra.llm import _common, ann, exact_dedup, license_scan, line_dedup, mixing, ngram_join, packing, rans, sharding, toxicity
from decidra.llm._common import new_path, ship
from decidra.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BASE = "the quick brown fox jumps over the lazy dog and runs through the green forest until night falls on the quiet hills far away from home again"
TEXTS = [
    (1, BASE), (2, BASE.upper()), (3, BASE.replace("lazy", "sleepy")), (4, None), (5, ""), (6, "   \n"), (7, "one two"), (8, "ONE  two"), (9, "Ö two"), (10, "word " * 40_000),
    (11, "cc by. All rights reserved"), (12, "Licensed under the Apache License, Version 2.0."), (13, BASE + " x y z"), (1, BASE), (14, "ö two"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, batch int, token long, sig long, block int, copy int, _mix_source string, row_id long, _row_id long, odd_id long"


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    rows = [(i, t, None, "s" if i % 2 else None, None, "d", 1, 2, 3, 4, 5, "m", 6, 7, 8) for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_exact_dedup(docs, none):
    got = exact_dedup.exact_groups(docs)[0].collect()
    groups = collections.defaultdict(list)
    for i, t in TEXTS:
        groups[(t or "").translate(LOWER)].append(i)
    want = sorted((i, max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids)
    assert sorted(map(tuple, got)) == want
    assert exact_dedup.exact_groups(none)[0].count() == 0
    assert sorted(map(tuple, exact_dedup.exact_groups(docs, batches=3)[0].collect())) == want


def brute_components(rows, k, num):
    sets = {}
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = {tuple(words)} if 0 < len(words) < k else {tuple(words[j : j + k]) for j in range(len(words) - k + 1)} if words else set()
    name = {i: i for i in sets}

    def root(x):
        while name[x] != x:
            x = name[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                name[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_ngram_join(docs, none):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs, 4, 70, 100).collect()}
    assert got == brute_components(TEXTS, 4, 70)
    assert ngram_join.near_duplicates(none).count() == 0


def test_ngram_join_chains(spark):
    """A large family of near copies, so that frequent tokens, combinations and residual pairs all occur."""
    rng = np.random.default_rng(9)
    words = [f"w{x}" for x in rng.integers(0, 60, 4000)]
    rows = []
    for i in range(160):
        start = 100 * (i % 4)
        mine = words[start : start + 60]
        for _ in range(int(rng.integers(0, 5))):
            mine[int(rng.integers(0, 60))] = f"e{rng.integers(0, 6)}"
        rows.append((i + 1, " ".join(mine)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100).collect()}
    assert got == brute_components(rows, 4, 85)


def test_ngram_join_counts_all_links(spark, monkeypatch):
    """n_links against brute force on a family of near copies, in several blocks, and on small ones."""
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 50)
    rng = np.random.default_rng(21)
    words = [f"w{x}" for x in rng.integers(0, 500, 3000)]
    rows = []
    for i in range(260):
        start = 0 if i < 220 else 200 * (1 + i % 10)
        mine = words[start : start + 200]
        for _ in range(int(rng.integers(0, 4))):
            mine[int(rng.integers(0, 200))] = f"e{rng.integers(0, 50)}"
        rows.append((i + 1, " ".join(mine)))
    rows += [(1000, rows[0][1].upper()), (1001, "one two")]
    sets = {i: frozenset(tuple(w[j : j + 4]) for j in range(max(1, len(w) - 3))) for i, t in rows for w in [t.translate(LOWER).split()]}
    distinct = set(sets.values())
    degree = {s: sum(100 * len(s & o) >= 85 * len(s | o) for o in distinct if o is not s) for s in distinct}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_links for r in ngram_join.near_duplicates(df, 4, 85, 100).collect()}
    assert got == {i: degree[s] for i, s in sets.items()} and max(got.values()) > 100
    two = (np.array([7, 9]), np.array([0, 0]), np.array([0, 2, 4]), np.array([1, 2, 1, 2]), ngram_join.Threshold(85, 100))
    assert ngram_join.linked_counts(0, 0, *two)[1].tolist() == [1, 1] and not ngram_join.linked_counts(0, 1, *two)[1].any()
    assert ngram_join.near_duplicates(df, 4, 85, 100, count_links=False).columns == ["doc_id", "n_shingles", "component_id"]


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(100, i) for i in range(101, 140)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {v for k, v in got.items() if k <= 30} == {1} and {v for k, v in got.items() if k >= 100} == {100} and len(got) == 70
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_tokens(docs, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    library, start, want = Tokenizer.from_file(path), 0, []
    for i, t in sorted(TEXTS, key=lambda r: r[0]):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, rans.token_stream(docs, path).collect())) == sorted(want)
    assert rans.token_stream(none, path).count() == 0


def test_packing(docs, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = packing.pack_documents(docs, path, size=64, open_bins=3, with_ids=True).collect()
    held = collections.defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    whole = collections.Counter()
    for i, t in TEXTS:
        whole[i] += len(library.encode(t or "", add_special_tokens=False).ids) + 1
    got = collections.Counter()
    for r in rows:
        got[r.doc_id] += r.length
        assert r.length == 64 or r.piece == 0
    assert got == whole
    assert packing.pack_documents(none, path).count() == 0


def test_mixing(spark, docs, none):
    rows = mixing.mix_schedule(docs, max_repeat=2.0).collect()
    copies = collections.Counter(r.doc_id for r in rows)
    assert set(copies) == {i for i, _ in TEXTS} and mixing.mix_schedule(none).count() == 0
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == len(rows) and {tuple(r)[2:] for r in mixed.collect()} == {tuple(r)[2:] for r in docs.collect()}
    many = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.when(F.col("id") < 5000, "big").when(F.col("id") < 5900, "mid").otherwise("small").alias("source"))
    got = collections.Counter(r.source for r in mixing.mix_schedule(many, max_repeat=2.0).collect())
    assert got["big"] == 5000 and 1.9 < got["small"] / 100 <= 2.0 and 1 <= got["mid"] / 900 < 2
    totals = spark.createDataFrame([("a", 900), ("b", 90), ("c", 10)], "source string, total long")
    alpha = mixing.fit_exponent(totals, target_entropy=0.9)
    w = np.array([0.9, 0.09, 0.01]) ** alpha
    w /= w.sum()
    assert -(w * np.log(w)).sum() == pytest.approx(0.9, abs=1e-6)
    for entropy, repeat in ((0.9, None), (None, 3.0), (0.5, 40.0)):  # over rows as over one array
        assert mixing._fit_over_rows(totals, entropy, repeat) == pytest.approx(mixing.fit_exponent(totals, entropy, repeat), abs=1e-9)
    budgeted = mixing.mix_schedule(many, max_repeat=None, budget=8000).agg(F.sum("n_tokens")).collect()[0][0]
    assert 7800 <= budgeted <= 8000


def test_line_dedup(spark, none):
    page = lambda i, host, *lines: (i, f"http://{host}/x{i}" if host else None, "<p>" + "</p><p>".join(lines) + "</p>", "h")
    rows = [page(i, "A.example", "menu", f"own {i}", "rare" if i < 2 else "x y") for i in range(10)] + [page(20, None, "menu"), (21, "http://b.example", None, "h"), (22, "http://b.example", "", "h"), page(1, "a.example", "menu")]
    got = line_dedup.drop_boilerplate(spark.createDataFrame(rows, "page_id long, url string, html string, host string"), 0.5, 3).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.page_id].append(r)
    assert len(got) == len(rows) and by[0][0].clean_text == "own 0\nrare" and by[5][0].clean_text == "own 5" and by[5][0].n_dropped == 2
    assert by[20][0].clean_text == "menu" and by[20][0].host == "" and by[21][0].n_lines == 0 and sorted(r.clean_text for r in by[1]) == ["", "own 1\nrare"]
    assert line_dedup.drop_boilerplate(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_sharding(spark, docs):
    path = new_path(spark, "store")
    store = sharding.ShardStore(spark, path, target_bytes=1 << 20, fanout=4, least_bytes=1 << 10)
    assert store.read() is None and store.version() == 0
    for i in range(8):
        store.append(docs.withColumn("arrival", F.lit(i)).coalesce(1))
    before = store.version()
    old = store.read(before).count()
    assert store.compact() > before and len(store.runs()) < 4
    assert store.read().count() == old == 8 * len(TEXTS) and store.read(before).count() == old
    with pytest.raises(sharding.CommitConflict):
        store.commit(before, [])
    assert store.vacuum() > 0 and store.read().count() == old
    rows = sharding.sharded_rows(docs, new_path(spark, "store"), 1 << 20, 1 << 10).collect()
    assert sorted((r.doc_id, r.text_crc32) for r in rows) == sorted((i, zlib.crc32((t or "").encode())) for i, t in TEXTS)


@pytest.mark.parametrize("seed", range(6))
def test_tiers_against_a_plain_simulation(spark, monkeypatch, seed):
    """Which runs merge, what they become, and how often a byte is written, for arrivals of many sizes."""
    rng, target, least, fanout = random.Random(seed), 1 << 20, 1 << 12, 3
    store = sharding.ShardStore(spark, "file:///nowhere", target, fanout, least)
    live, merges = [], []

    def merge(runs):
        whole = sum(r.bytes for r in runs)
        merges.append(sorted(r.bytes for r in runs))
        return [sharding.Run(f"m{len(merges)}", whole, max(1, round(whole / target)), store.tier(whole))]

    def commit(_, new, gone=()):
        live[:] = [r for r in live if r not in gone] + new
        return 1

    for name, fake in (("version", lambda: 1), ("runs", lambda *_: list(live)), ("_merge", merge), ("commit", commit)):
        monkeypatch.setattr(store, name, fake)
    plain: list[tuple[int, int]] = []  # bytes and shards
    expected, written, arrived = [], 0, 0
    for i in range(120):
        n = int(2 ** rng.uniform(8, 21))
        arrived += n
        live.append(sharding.Run(f"r{i}", n, 1, store.tier(n)))
        store.compact()
        plain.append((n, 1))
        while True:
            tiers = collections.defaultdict(list)
            for b, k in plain:
                level = 0
                while b > least * fanout**level:
                    level += 1
                if b / k < target / 2:
                    tiers[level if b > least else 0].append((b, k))
            full = [t for t in sorted(tiers) if len(tiers[t]) >= fanout]
            if not full:
                break
            together = tiers[full[0]]
            for run in together:
                plain.remove(run)
            whole = sum(b for b, _ in together)
            plain.append((whole, max(1, round(whole / target))))
            expected.append(sorted(b for b, _ in together))
            written += whole
    assert [sorted(m) for m in merges] == expected and sorted((r.bytes, r.shards) for r in live) == sorted(plain) and len(expected) > 10
    assert sum(r.bytes for r in live) == arrived and written / arrived <= 1 + np.log(target / least) / np.log(fanout)
    small = collections.Counter(r.tier for r in live if r.bytes / r.shards < target / 2)
    assert all(n < fanout for n in small.values())


def test_vacuum_keeps_what_versions_list(spark, docs):
    """Runs, manifests and commit files that no kept version needs go; what they list stays readable."""
    store = sharding.ShardStore(spark, new_path(spark, "store"), 1 << 20, 4, 1 << 10)
    for _ in range(5):
        store.append(docs)
    store.compact()
    whole, before = store.read().count(), store.version()
    assert store.vacuum(keep=2) == 0 and store.read(before - 1).count() == whole  # the version before the merge lists its runs
    store.append(docs)
    assert store.vacuum(keep=1) >= 4 and store.read().count() == whole + len(TEXTS)
    assert len(store._listed("manifests")) == 1
    store._fs.create(store._path("aside", "lost")).close()
    assert store.vacuum() == 0 and len(store._listed("aside")) == 1
    assert store.vacuum(grace_s=0) == 0 and not store._listed("aside") and store.read().count() == whole + len(TEXTS)


def test_a_lost_writer_leaves_the_store_readable(spark, docs, monkeypatch):
    """A writer that dies before or in the rename, or loses the number to another, leaves the last version as it was."""
    store = sharding.ShardStore(spark, new_path(spark, "store"), 1 << 20, 4, 1 << 10)
    store.append(docs)
    whole = store.read().count()
    for lost in ("_claimed", "_shards"):
        with monkeypatch.context() as patch:
            patch.setattr(store, lost, lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
            with pytest.raises(KeyboardInterrupt):
                store.append(docs)
        assert store.version() == 1 and store.read().count() == whole
    assert store.vacuum() == 0  # the writers may still commit
    assert store.vacuum(grace_s=0) == 2 and store.read().count() == whole
    assert store.append(docs) == 2 and store.read().count() == 2 * whole
    other = sharding.ShardStore(spark, store.path, 1 << 20, 4, 1 << 10)
    monkeypatch.setattr(other, "version", lambda: 1)
    with pytest.raises(sharding.CommitConflict):
        other.append(docs)
    assert store.version() == 2 and store.vacuum(grace_s=0) == 0 and store.read().count() == 2 * whole


def test_arrivals_keep_their_column(spark, docs, none):
    store = sharding.ShardStore(spark, new_path(spark, "store"), 1 << 20, 4, 1 << 10)
    days = docs.withColumn("day", F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("d/"), F.col("doc_id") % 3)))
    assert store.append(days, "day") == 1 and len(store.runs()) == 3
    same = lambda df: sorted(map(str, df.select(*days.columns).collect()))
    assert same(store.read()) == same(days) and set(days.columns) < set(store.read().columns)
    assert sharding.sharded_rows(none, new_path(spark, "store"), 1 << 20, 1 << 10).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(400, 8)).astype(np.float32).astype(float)
    x[7], x[8] = x[0], x[0] * 2
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1050, [0.0] * 8), (1100, [1.0] * 7 + [float("nan")]), (1150, [1.0] * 7 + [None]), (1200, [1.0] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1))
    got = collections.defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 400, 50):
        s = unit @ unit[q]
        s[q] = -2
        best = np.lexsort((np.arange(400), -np.round(s, 12)))[:5]
        hits += len(set(best.tolist()) & {v for v, _ in got[q]})
        assert all(abs(score - s[v]) < 1e-9 for v, score in got[q])
    assert set(got) == set(range(0, 400, 50)) and hits >= 0.9 * 40 and [v for v, _ in got[0]][:2] == [7, 8]
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>")
    assert ann.nearest(few, F.col("vec_id") == 0).count() == 2 and ann.nearest(few.limit(0), F.lit(True)).count() == 0


def test_neighbours_ties(spark):
    """1000 equal vectors give the smallest ids; of 700 that share all codes the nearest are found."""
    rng = np.random.default_rng(13)
    x = np.concatenate([np.repeat(rng.normal(size=(1, 8)), 1000, 0), rng.normal(size=(1, 8)) + 1e-6 * rng.normal(size=(700, 8)), rng.normal(size=(100, 8))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    got = collections.defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id").isin(0, 500, 999, 1000, 1350)).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert got[0] == [1, 2, 3, 4, 5] and got[500] == got[999] == [0, 1, 2, 3, 4]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in (1000, 1350):
        near = [i for i in np.argsort(((unit - unit[q]) ** 2).sum(1)) if i != q][:5]
        assert len(got[q]) == 5 and len(set(got[q]) & set(near)) >= 4


def test_licences(docs, none):
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs).collect()}
    assert got[11].base_labels == "cc-by,reserved" and (got[11].n_base, got[11].first_word, got[11].last_word) == (2, 0, 2)
    assert got[12].labels == "apache-2.0" and got[12].base_labels == "" and 0 < got[12].score <= 1
    assert got[4].n_words == 0 and got[4].first_word is None and got[4].score == 0 and got[10].n_words == 40_000
    assert license_scan.scan_licenses(none).count() == 0


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 15)] + [(1, 0), (99, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(TEXTS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert toxicity.toxicity(none, labels.limit(0)).count() == 0
    model = toxicity.Model((("sleepy", 9.0),), (), 0.1, -3.0, 4.0)
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, t in TEXTS if "sleepy" not in (t or ""))


def test_null_ids(spark):
    rows = spark.createDataFrame([(None, "a b c d e"), (None, None), (3, "a b c d e")], "doc_id long, text string")
    rows = rows.withColumn("source", F.lit(None).cast("string"))
    assert {(r.doc_id, r.keep_id, r.kept) for r in exact_dedup.exact_groups(rows)[0].collect()} == {(None, 3, False), (None, None, True), (3, 3, True)}
    assert ngram_join.near_duplicates(rows).count() == 3 and mixing.mix_schedule(rows).count() == 3
    assert packing.pack_documents(rows, public_tokenizers.path("byte_bpe_50k.json")).count() == 3
    assert rans.token_stream(rows, public_tokenizers.path("word_bpe_49k.json")).count() == 3


def test_dedup_stages_ids(spark):
    """Null and repeated ids: one row of each group stays, and another text of a repeated id isn't lost."""
    import corpus_pipeline

    other = "some other text that has nothing in common with the rest of them"
    rows = [(None, "a b c d e f"), (3, "A b c d e f"), (4, "x y"), (4, "x y"), (4, other), (None, None), (None, ""), (9, other.upper()), (5, BASE), (None, BASE + " z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    exact = corpus_pipeline.exact_dedup(spark, docs, "")
    got = sorted(((r.text or "").lower(), r.doc_id) for r in exact.collect())
    assert got == sorted([("a b c d e f", 3), ("x y", 4), (other, 9), ("", None), (BASE, 5), (BASE + " z", None)])
    near = corpus_pipeline.near_dedup(spark, docs, "")
    got = collections.Counter((r.text or "").lower() for r in near.collect())
    assert got == {"a b c d e f": 1, "x y": 1, other: 1, "": 2, BASE: 1} and near.columns == docs.columns


def test_pipeline_stages_on_odd_rows(spark, docs, none, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows, an empty table and clashing names go through each stage."""
    import corpus_pipeline

    spark.createDataFrame([(i, i % 2) for i in range(1, 15)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    odd = docs.unionByName(spark.createDataFrame([(None,) * 15, (None, BASE, *(None,) * 13), (20, "scum", *(None,) * 13)], docs.schema))
    rows = collections.Counter(map(tuple, odd.collect()))
    for name, step in corpus_pipeline.STAGES[:-1]:
        got = step(spark, odd, str(tmp_path))
        kept = collections.Counter(map(tuple, got.collect()))
        assert got.columns == odd.columns and set(kept) <= set(rows), name  # whole rows, as they were
        assert step(spark, none, str(tmp_path)).count() == 0, name
        if name == "exact_dedup":
            texts = [(t or "").translate(LOWER) for _, t, *_ in kept.elements()]
            assert len(texts) == len(set(texts)) == len({(r[1] or "").translate(LOWER) for r in rows})
        if name == "near_dedup":  # texts without words link with nothing
            assert sum(n for r, n in kept.items() if not (r[1] or "").split()) == sum(n for r, n in rows.items() if not (r[1] or "").split())
            assert sorted((r[1] or "").lower() for r in kept.elements() if (r[1] or "").lower().startswith(BASE[:20])) == [BASE, BASE.replace("lazy", "sleepy")]  # one word of 26 is too much
        if name == "mixing":
            assert set(kept) == set(rows)
    packed = corpus_pipeline.packing(spark, odd, str(tmp_path))
    assert packed.filter("piece = 0").count() == sum(rows.values()) and corpus_pipeline.packing(spark, none, str(tmp_path)).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(12)
    words = [f"w{i}" for i in range(400)]
    rows, toxic = [], set()
    for i in range(400):
        text = " ".join(rng.choice(words, 40))
        if i % 10 == 0:
            text, _ = text + " scumbag moronic", toxic.add(i)
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
    rows += [(1000 + i, rows[i][1].upper(), "en", "s0", 1) for i in (1, 2)] + [(2000, rows[3][1] + " w1", "en", "s0", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i in toxic)) for i in range(400)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()}
    assert got == {r[0] for r in rows} - toxic - {1, 2, 2000}


def test_without_broadcasts(spark, docs, monkeypatch):
    """What is shuffled and salted beyond the bounds gives the same rows as what is broadcast below them."""
    from decidra.llm import _common

    page = lambda i: (i, f"http://h{i % 2}.example/{i}", f"<p>menu</p><p>own {i}</p>{'<p>rare</p>' if i < 3 else ''}")
    pages = spark.createDataFrame([page(i) for i in range(40)] + [(50, None, None)], "page_id long, url string, html string")
    runs = {
        "lines": lambda: line_dedup.drop_boilerplate(pages, 0.2, 3), "exact": lambda: exact_dedup.exact_groups(docs)[0], "mix": lambda: mixing.mix_schedule(docs, target_entropy=0.5, max_repeat=2.0),
        "near": lambda: ngram_join.near_duplicates(docs),
    }
    rows = lambda: {name: sorted(map(str, run().collect())) for name, run in runs.items()}
    before = rows()
    for module in (_common, exact_dedup, mixing):
        monkeypatch.setattr(module, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(mixing, "ARRAY_SOURCES", 0)
    monkeypatch.setattr(ngram_join, "BUCKET_ROWS", 2)
    monkeypatch.setattr(_common, "FILE_ROWS", 3)
    after = rows()
    assert after == before and any("n_dropped=2" in r or "n_dropped=1" in r for r in after["lines"])


def test_hot_keys_are_dealt(spark, monkeypatch):
    """Half of the rows have one key, a fifth none: the same rows as a plain join, and no task with more than a few hundredths of them."""
    monkeypatch.setattr(_common, "HEAVY_ROWS", 200)
    rows = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 5 == 1, None).otherwise(F.concat(F.lit("k"), F.col("id") % 999)).alias("key"), "id", F.lit(1).alias("salt"), F.lit(2).alias("_salt"))
    small = rows.select("key").distinct().filter("key IS NOT NULL AND key <> 'k7'").withColumn("value", F.length("key"))
    keys = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        for how in ("inner", "left"):
            got = _common.join_dealt(rows, small, "key", ["id"], how)
            assert sorted(map(str, got.collect())) == sorted(map(str, rows.join(small, "key", how).collect()))
            largest = got.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).agg(F.max("n")).collect()[0][0]
            assert largest < 20_000 / 15
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_neighbours_where_most_vectors_take_no_part(spark):
    """The codebooks' sample is of valid vectors, so 3,000 zero vectors hide none of the others; ids that repeat are one."""
    rng = np.random.default_rng(3)
    good = [(10_000 + i, rng.normal(size=4).tolist()) for i in range(10)]
    rows = [(i, [0.0] * 4) for i in range(3_000)] + good + [(10_001, good[1][1]), (20_000, [1.0, None, 2.0, 3.0])] + [(30_000 + i, [1.0, 2.0]) for i in range(3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = collections.defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 10_000 < 2, sample=50).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    unit = np.array([v for _, v in good]) / np.linalg.norm([v for _, v in good], axis=1)[:, None]
    for q in (0, 1):
        assert got[10_000 + q] == [10_000 + i for i in np.argsort(-(unit @ unit[q])) if i != q][:5]
    assert set(got) == {10_000, 10_001}

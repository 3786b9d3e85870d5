"""Stateful answers against a plain simulation; a resumable run that is killed between its write and its checkpoint."""

import collections
import random
import time

import pytest
from pyspark.sql import functions as F

from decidra.streaming import answers as A
from decidra.streaming import runs

REQUESTS = "server string, request_id string, ord long, key string, payload string"
PREDICTIONS = "item_id long, answer string, error string"


def predictor():
    def predict(payload):
        if payload.startswith("bad"):
            raise ValueError(payload)
        return f"answer to {payload}"

    return predict


predict = predictor()


def simulated(batches, size):
    """A dictionary in order of use for each server."""
    kept, out = collections.defaultdict(collections.OrderedDict), {}
    for batch in batches:
        for server, ident, _, key, payload in sorted(batch, key=lambda r: (r[0], r[2], r[1])):
            mine = kept[server]
            if key in mine:
                mine.move_to_end(key)
                out[ident] = (mine[key], True, None)
                continue
            try:
                answer = mine[key] = predict(payload)
                out[ident] = (answer, False, None)
            except ValueError as error:
                out[ident] = (None, False, f"ValueError: {error}")
            while len(mine) > size:
                mine.popitem(last=False)
    return out


@pytest.fixture
def store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, A.PROVIDER)
    yield spark
    spark.conf.set(key, before)


def run(spark, tmp_path, size, ttl_ms=None):
    stream = spark.readStream.schema(REQUESTS).json(f"{tmp_path}/in")
    query = A.answered(stream, predictor(), size, ttl_ms).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(**({"availableNow": True} if ttl_ms is None else {"once": True})).start()
    query.awaitTermination()
    return {r.request_id: (r.answer, r.hit, r.error) for r in spark.read.parquet(f"{tmp_path}/out").collect()}


def test_repeats_are_answered_from_the_state(store, tmp_path):
    """Least recently used keys go, failures aren't kept, a NULL key is a key, and a restart goes on with the state."""
    rng = random.Random(5)
    batches = []
    for b in range(2):
        rows = []
        for i in range(150):
            key = rng.choice([None, "bad", *(f"k{n}" for n in range(6))])
            rows.append((rng.choice("xy"), f"r{b}-{i:03}", i // 2, key, f"{key or 'none'}-{b}"))
        batches.append(rows)
    for b, rows in enumerate(batches):
        store.createDataFrame(rows, REQUESTS).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        got = run(store, tmp_path, 3)
        assert got == simulated(batches[: b + 1], 3)
    assert any(hit and answer.endswith("-0") for ident, (answer, hit, _) in got.items() if ident.startswith("r1"))


def test_a_batch_writes_its_last_keys_not_its_requests(store, tmp_path):
    """Thousands of requests of a server are a few changes of its state, and a batch of one server comes in order from all files."""
    rng = random.Random(6)
    rows = [("x", f"r{i:04}", i, f"k{rng.randrange(12)}", f"p{i}") for i in range(4000)]
    mixed = rng.sample(rows, len(rows))
    store.createDataFrame(mixed, REQUESTS).repartition(3).write.json(f"{tmp_path}/in")
    stream = store.readStream.schema(REQUESTS).json(f"{tmp_path}/in")
    query = A.answered(stream, predictor(), 8).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sum(op.numRowsUpdated for p in query.recentProgress for op in p.stateOperators) <= 2 * 8 + 1
    got = {r.request_id: (r.answer, r.hit, r.error) for r in store.read.parquet(f"{tmp_path}/out").collect()}
    assert got == simulated([rows], 8)


@pytest.mark.parametrize(("piece", "parts"), [(70, 3), (1000, None)])
def test_a_table_is_answered_in_pieces(spark, tmp_path, piece, parts):
    """The state goes on from piece to piece; requests of one place are cut between pieces by their identity."""
    rng = random.Random(7)
    keys = [None, "bad", *(f"k{n}" for n in range(6))]
    rows = [(rng.choice("xy"), f"r{i:03}", i // 50, key, f"{key or 'none'}-{i}") for i in range(200) for key in [rng.choice(keys)]]
    table = spark.createDataFrame(rng.sample(rows, len(rows)), REQUESTS).repartition(4)
    found = A.answered_table(table, predictor(), f"file://{tmp_path}/at", 3, piece).collect()
    assert {r.request_id: (r.answer, r.hit, r.error) for r in found} == simulated([rows], 3) and len(found) == len(rows)
    assert len(list(tmp_path.glob("at/pieces/piece=*"))) == (parts or 0)


def test_answers_age_out(store, tmp_path):
    for i in range(2):
        store.createDataFrame([("x", f"r{i}", i, "k", f"p{i}")], REQUESTS).write.mode("append").json(f"{tmp_path}/in")
        got = run(store, tmp_path, 4, ttl_ms=500)
        time.sleep(1)
    assert got == {"r0": ("answer to p0", False, None), "r1": ("answer to p1", False, None)}


class Killed(Exception):
    pass


def test_a_run_that_is_killed_has_each_item_once(spark, tmp_path):
    spark.range(40).selectExpr("id AS item_id", "cast(id % 20 AS string) AS text").repartition(3).write.parquet(f"{tmp_path}/in")
    items = lambda: spark.readStream.schema("item_id long, text string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    answer = lambda item: {"answer": item["text"] if item["item_id"] % 7 else 1 / 0}
    deaths = []

    def die_once(number):
        if number == 1 and not deaths:
            deaths.append(number)
            raise Killed

    go = lambda check, predict, after=None: runs.write_predictions(items(), predict, PREDICTIONS, f"{tmp_path}/log", f"{tmp_path}/{check}", after_write=after).awaitTermination()
    with pytest.raises(Exception, match="Killed"):
        go("a", answer, die_once)
    go("a", answer)
    log = runs.committed(spark, f"{tmp_path}/log", PREDICTIONS)
    rows = [(r.item_id, r.answer, r.error is None) for r in log.collect()]
    assert deaths and sorted(rows) == sorted((i, str(i % 20) if i % 7 else None, bool(i % 7)) for i in range(40))
    assert {r.batch for r in log.select("batch").distinct().collect()} == {0, 1, 2}
    go("b", lambda item: {"answer": "late"})  # another run: only what failed is tried again
    assert runs.committed(spark, f"{tmp_path}/log", PREDICTIONS).count() == 40 + 6
    final = {r.item_id: (r.answer, r.error) for r in runs.results(spark, f"{tmp_path}/log", PREDICTIONS).collect()}
    assert final == {i: (str(i % 20) if i % 7 else "late", None) for i in range(40)}


def test_a_batch_cut_while_it_was_written_is_written_anew(spark, tmp_path):
    """Files without the mark of success don't count."""
    spark.range(5).selectExpr("id AS item_id").write.parquet(f"{tmp_path}/in")
    answer = lambda item: {"answer": "x"}
    spark.createDataFrame([(1, "half", None)], PREDICTIONS).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{tmp_path}/log/run=other/batch=0")
    stream = spark.readStream.schema("item_id long").parquet(f"{tmp_path}/in")
    runs.write_predictions(stream, answer, PREDICTIONS, f"{tmp_path}/log", f"{tmp_path}/ck").awaitTermination()
    rows = runs.committed(spark, f"{tmp_path}/log", PREDICTIONS).collect()
    assert sorted((r.item_id, r.answer) for r in rows) == [(i, "x") for i in range(5)]


def test_batches_over_range_cuts_are_those_of_one_stream(spark):
    """100,000 lengths in many ranges, of which some are shorter than a batch: the batches of a plain loop."""
    from decidra.operators import batching

    rng = random.Random(2)
    lengths = [rng.choice([1, 5, 40, 300, 5000]) * rng.randint(1, 9) for _ in range(100_000)]
    df = spark.range(len(lengths)).join(spark.createDataFrame(list(enumerate(lengths)), "id long, n long"), "id").withColumn("batch_name", F.lit("x"))
    want, batch, size, width = [], 0, 0, 0
    for n in lengths:
        width = max(width, n)
        if size and (size >= 16 or width * (size + 1) > 8000):
            batch, size, width = batch + 1, 0, n
        size += 1
        want.append(batch)
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    try:
        for parts in ("7", "64"):
            spark.conf.set(key, parts)
            got = [r.batch for r in batching.batch_stream(df, "id", "n", 16, 8000).orderBy("id").collect()]
            assert got == want
        spark.conf.set(key, "64")
        few = batching.batch_stream(df.filter("id < 100"), "id", "n", 16, 8000).orderBy("id").collect()
        assert [r.batch for r in few] == want[:100]
    finally:
        spark.conf.set(key, before)
    assert batching.batch_stream(df.limit(0), "id", "n", 16, 8000).count() == 0


def test_only_grams_that_may_be_shared_become_rows(spark):
    from decidra.operators import contamination as C

    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(3000)}"
    docs = [(i, " ".join(word() for _ in range(rng.randint(5, 120)))) for i in range(400)] + [(900, None), (901, "")]
    bench = [(i, " ".join(docs[i][1].split()[3:40])) for i in range(0, 30)] + [(50, " ".join(word() for _ in range(60))), (51, "short"), (52, None)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    grams = lambda t: {" ".join(t.split()[i : i + 13]) for i in range(len(t.split()) - 12)} if t else set()
    want = sorted((i, j, g) for i, t in bench for j, u in docs for g in grams(t) & grams(u))
    assert sorted((r.item_id, r.doc_id, r.gram) for r in C.gram_hits(b, d).collect()) == want and len(want) > 100
    _, maybe, _ = C.maybe_grams(b, d)
    exploded, every = maybe.count(), sum(len(grams(t)) for _, t in docs)
    assert len({(j, g) for _, j, g in want}) <= exploded <= len({(j, g) for _, j, g in want}) + 0.05 * every


def test_deep_pages_take_time_in_proportion(spark):
    from decidra.operators import pages

    def page(n):
        return "<div>" * n + "<a>x</a>" + "</div>" * n + "</b>" * n

    begun = time.perf_counter()
    entries = pages.stream_of(page(100_000))
    assert time.perf_counter() - begun < 10 and [(e["tag"], e["name"]) for e in entries] == [("a", "x")]
    nested = pages.stream_of("<div>one <p>two <b>three</b> </p><button>go <i>on</i></button> four</div><div title='t'></div>")
    assert [(e["tag"], e["name"]) for e in nested] == [("b", "three"), ("button", "go on"), ("i", "on"), ("div", "t")]


def test_digest_of_a_large_file(spark, tmp_path):
    """More than 2 GB, which no row could hold."""
    import hashlib

    from decidra.sources.io import sha256_of

    path = tmp_path / "large"
    with path.open("wb") as f:
        f.seek((1 << 31) + 5)
        f.write(b"end")
    want = hashlib.sha256()
    with path.open("rb") as f:
        while block := f.read(1 << 24):
            want.update(block)
    assert sha256_of(spark, f"file://{path}") == want.hexdigest()

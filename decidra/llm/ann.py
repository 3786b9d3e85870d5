"""Approximate nearest neighbours by additive quantisation.

Codebooks of full dimension are fitted by k-means on the residuals of a bounded sample (the `sample` valid vectors with the
smallest hashes). Every distinct vector is then encoded by a beam search: at each codebook the few best partial sums are extended
by all its codewords, and the best again are kept. A vector is stored as its codes and the norm of what they decode to.
Queries are scored by lookup tables of their products with all codewords, over that norm; the best of each are scored
exactly, in double precision, on the original vectors.

Equal vectors are indexed once, with the k + 1 smallest of their ids: no others can be among k neighbours. Distinct vectors
of equal codes are one class. A shortlist is of classes, includes all that tie at its end, and stands for all vectors of
them. It is of `shortlist` classes up to SHORT_ROWS distinct vectors and grows with the square root of their number beyond.

The stated queries go in blocks, of which each meets every block of codes once, all in one job. First a block's queries are scored against
a sample of the classes, which gives each a cutoff below the end of its shortlist by a wide margin (four standard deviations of
the number of sampled classes above it); what scores below the cutoff isn't emitted, so the pairs are about twice the
shortlists, however many blocks there are. A task holds one block of queries with its tables and scores one block of codes at
a time: no join of queries with vectors and no block of unbounded size.

Defined results: vectors that are null, zero, of another length than most of the valid sample, or hold a null or non-finite
component take no part; a row is never its own neighbour, nor is another row with its id; of a query's id that repeats, the
vector of the smallest hash asks; ties go to the smaller id;
with fewer candidates than wanted, all are given; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from decidra.llm._common import drop, lean, meet_blocks, stage

SAMPLE, BOOKS, WORDS, BEAM = 12_000, 16, 256, 4
SHORT_ROWS = 10_000  # distinct vectors, from which on the shortlist grows with the square root of their number
QUERY_ROWS, CODE_ROWS = 1_024, 1_024  # of a block: its tables take 4 * BOOKS * WORDS bytes a query
SAMPLED, MOST_SAMPLED = 16, 100_000  # sampled classes that are expected in a shortlist, and sampled classes at most


def valid_matrix(column: pa.Array, dim: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, unit-free vectors in double precision) of the vectors that take part."""
    rows, vectors = [], []
    for i, v in enumerate(column.to_pylist()):
        if v is not None and (dim is None or len(v) == dim) and len(v) and None not in v:
            rows.append(i)
            vectors.append(v)
    if not rows:
        return np.zeros(0, np.int64), np.zeros((0, dim or 0))
    x = np.array(vectors, np.float64)
    fine = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return np.array(rows)[fine], x[fine]


def fit_codebooks(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 6) -> np.ndarray:
    """(books, words, dim): k-means on what the books before leave over."""
    rng, rest = np.random.default_rng(5), x.astype(np.float32).copy()
    out = []
    for _ in range(books):
        centres = rest[rng.choice(len(rest), words, replace=len(rest) < words)].copy()
        for _ in range(rounds):
            near = (rest @ centres.T * 2 - (centres**2).sum(1)).argmax(1)
            n = np.bincount(near, minlength=words)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, rest)
            centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], rest[rng.choice(len(rest), words)]).astype(np.float32)
        near = (rest @ centres.T * 2 - (centres**2).sum(1)).argmax(1)
        rest -= centres[near]
        out.append(centres)
    return np.stack(out)


def encode(x: np.ndarray, codebooks: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """(rows, books) codes: the beam keeps the partial sums that leave least over."""
    n, (books, words, dim) = len(x), codebooks.shape
    rest = x.astype(np.float32)[:, None, :]
    codes = np.zeros((n, 1, 0), np.uint8)
    for book in codebooks:
        left = (rest**2).sum(2)[:, :, None] - 2 * (rest.reshape(-1, dim) @ book.T).reshape(n, -1, words) + (book**2).sum(1)
        flat = left.reshape(n, -1)
        best = np.argpartition(flat, min(beam, flat.shape[1]) - 1, axis=1)[:, :beam]
        parent, word = best // words, best % words
        rest = np.take_along_axis(rest, parent[:, :, None], 1) - book[word]
        codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], 1), word[:, :, None].astype(np.uint8)], 2)
    final = (rest**2).sum(2).argmin(1)
    return codes[np.arange(n), final]


def coded_vectors(vectors: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """(ids, embedding) of distinct valid vectors, with their codes."""
    dim = codebooks.shape[2]

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), CODE_ROWS):
                part = batch.slice(a, CODE_ROWS)
                rows, x = valid_matrix(part.column(1), dim)
                codes = encode(x / np.linalg.norm(x, axis=1)[:, None], codebooks)
                part = part.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([c.tobytes() for c in codes], pa.binary())], names=["ids", "embedding", "codes"])

    kind = vectors.schema["embedding"].dataType.simpleString()
    return vectors.select("ids", "embedding").mapInArrow(lean(per_batch), f"ids array<long>, embedding {kind}, codes binary")


def build_index(classes: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """Packed blocks (classes, codes, norms) of the distinct (class, codes)."""
    books = len(codebooks)

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), CODE_ROWS):
                part = batch.slice(a, CODE_ROWS)
                codes = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(-1, books)
                norms = np.linalg.norm(codebooks[np.arange(books), codes].sum(1), axis=1)
                values = [part.column(0).to_numpy().astype("<i8").tobytes(), codes.tobytes(), norms.astype("<f4").tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in values], names=["classes", "codes", "norms"])

    return classes.select("class", "codes").mapInArrow(lean(per_batch), "classes binary, codes binary, norms binary")


def lookup_tables(queries: np.ndarray, codebooks: np.ndarray) -> np.ndarray:
    """(books, words, queries): the products of unit queries with all codewords."""
    return np.einsum("bwd,qd->bwq", codebooks, queries.astype(np.float32))


def table_scores(tables: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """(queries, classes) approximate cosines."""
    score = tables[0][codes[:, 0]]
    for b in range(1, len(tables)):
        score = score + tables[b][codes[:, b]]
    return score.T / np.maximum(norms, np.float32(1e-12))


def sample_rank(shortlist: int, classes: int, sampled: int) -> int:
    """Which place among the sampled classes is below the shortlist's end, by four standard deviations."""
    if sampled >= classes:
        return shortlist
    expected = shortlist * sampled / classes
    return math.ceil(expected + 4 * math.sqrt(expected) + 4)


def query_blocks(asked: DataFrame, codebooks: np.ndarray, sample: tuple[np.ndarray, np.ndarray], rank: int) -> DataFrame:
    """Blocks (query_ids, queries, cutoffs) of (vec_id, embedding); sample: codes and norms of the sampled classes."""
    dim = codebooks.shape[2]

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), QUERY_ROWS):
                part = batch.slice(a, QUERY_ROWS)
                rows, x = valid_matrix(part.column(1), dim)
                if not len(rows):
                    continue
                unit = (x / np.linalg.norm(x, axis=1)[:, None]).astype("<f4")
                best = np.zeros((len(unit), 0), np.float32)
                tables = lookup_tables(unit, codebooks)
                for c in range(0, len(sample[0]), CODE_ROWS):
                    best = np.concatenate([best, table_scores(tables, sample[0][c : c + CODE_ROWS], sample[1][c : c + CODE_ROWS])], 1)
                    if best.shape[1] > rank:
                        best = -np.partition(-best, rank - 1, axis=1)[:, :rank]
                cutoffs = best.min(1) if best.shape[1] >= rank else np.full(len(unit), -np.inf)
                ids = part.column(0).to_numpy()[rows]
                values = [ids.astype("<i8").tobytes(), unit.tobytes(), cutoffs.astype("<f4").tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in values], names=["query_ids", "queries", "cutoffs"])

    return asked.select("vec_id", "embedding").mapInArrow(lean(per_batch), "query_ids binary, queries binary, cutoffs binary")


def shortlists(index: DataFrame, blocks: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """query_id and an array of (approx, class) above its cutoff, for each block of codes. index and blocks: staged."""
    books, _, dim = codebooks.shape

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = None
        for batch in batches:
            for g, raw_ids, raw_queries, raw_cutoffs, raw_classes, raw_codes, raw_norms in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != group:
                    group, ids, cutoffs = g, np.frombuffer(raw_ids, "<i8"), np.frombuffer(raw_cutoffs, "<f4")
                    tables = lookup_tables(np.frombuffer(raw_queries, "<f4").reshape(-1, dim), codebooks)
                classes = np.frombuffer(raw_classes, "<i8")
                score = table_scores(tables, np.frombuffer(raw_codes, np.uint8).reshape(-1, books), np.frombuffer(raw_norms, "<f4"))
                above = score >= cutoffs[:, None]
                some = np.flatnonzero(above.any(1))
                each = pa.StructArray.from_arrays([pa.array(score[above], pa.float32()), pa.array(np.broadcast_to(classes, score.shape)[above], pa.int64())], names=["approx", "class"])
                ends = np.concatenate([[0], np.cumsum(above.sum(1)[some])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.ListArray.from_arrays(pa.array(ends), each)], names=["query_id", "found"])

    met = meet_blocks(index.withColumn("dim", F.lit(dim)), blocks, "dim", "classes", index.count() * CODE_ROWS)
    return met.select("g", "query_ids", "queries", "cutoffs", "classes", "codes", "norms").mapInArrow(lean(per_task), "query_id long, found array<struct<approx:float,class:long>>")


def cosine(a: Column, b: Column) -> Column:
    total = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return total(a, b) / (F.sqrt(total(a, a)) * F.sqrt(total(b, b)))


def nearest(embeddings: DataFrame, is_query: Column, k: int = 5, shortlist: int = 320, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k nearest found among all rows of (vec_id, embedding)."""
    spark = embeddings.sparkSession
    vectors = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    schema = "query_id long, rank int, vec_id long, score double"
    sound = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists("embedding", lambda e: e != 0)
    taken = vectors.filter(F.coalesce(sound, F.lit(False))).orderBy(F.xxhash64("vec_id"), F.xxhash64("embedding")).limit(sample).select("embedding").toArrow().column(0).combine_chunks()
    lengths = Counter(len(v) for v in taken.to_pylist() if v)
    if not lengths:
        return spark.createDataFrame([], schema)
    dim = lengths.most_common(1)[0][0]
    x = valid_matrix(taken, dim)[1]
    if not len(x):
        return spark.createDataFrame([], schema)
    codebooks = fit_codebooks(x / np.linalg.norm(x, axis=1, keepdims=True))
    # one row of each distinct vector, with the smallest ids that can be among k neighbours: one may be the query's own
    same = Window.partitionBy("hash", "embedding").orderBy("vec_id")
    valid = vectors.filter(F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False)) & (F.size("embedding") == dim)).withColumn("hash", F.xxhash64("embedding"))
    least = valid.withColumn("nth", F.dense_rank().over(same)).filter(F.col("nth") <= k + 1)
    distinct = least.groupBy("hash", "embedding").agg(F.collect_list("vec_id").alias("ids"))
    coded, _ = stage(coded_vectors(distinct, codebooks).withColumn("class", F.xxhash64("codes")), "ann-vectors")
    index, index_at = stage(build_index(coded.select("class", "codes").distinct(), codebooks), "ann-index")
    # the query's own vector takes a place
    shortlist = 1 + math.ceil(shortlist * max(1.0, math.sqrt(coded.count() / SHORT_ROWS)))
    chosen = vectors.filter(is_query & F.col("vec_id").isNotNull())
    asked, _ = stage(chosen.groupBy("vec_id").agg(F.min_by("embedding", F.xxhash64("embedding")).alias("embedding")), "ann-queries")  # of an id that repeats, one vector
    classes = coded.select("class", "codes").distinct()
    n_classes = classes.count()
    sampled = min(n_classes, MOST_SAMPLED, math.ceil(SAMPLED * n_classes / shortlist))
    codes = np.frombuffer(b"".join(r.codes for r in classes.orderBy("class").limit(sampled).collect()), np.uint8).reshape(-1, len(codebooks))  # classes are hashes
    norms = np.linalg.norm(codebooks[np.arange(len(codebooks)), codes].sum(1), axis=1).astype(np.float32)
    cut_at = query_blocks(asked.coalesce(1 + asked.count() // QUERY_ROWS), codebooks, (codes, norms), sample_rank(shortlist, n_classes, len(codes)))
    blocks, blocks_at = stage(cut_at.select(F.lit(dim).alias("dim"), F.monotonically_increasing_id().alias("g"), "*"), "query-blocks")
    found, found_at = stage(shortlists(index, blocks, codebooks), "ann-shortlists")
    # of a query, a short array from each block of codes
    merged = found.groupBy("query_id").agg(F.flatten(F.collect_list("found")).alias("found"))
    cut = merged.withColumn("cut", F.coalesce(F.get(F.sort_array(F.transform("found", lambda c: c["approx"]), asc=False), F.lit(shortlist - 1)), F.lit(float("-inf")).cast("float")))
    short, _ = stage(cut.select("query_id", F.explode(F.filter("found", lambda c: c["approx"] >= F.col("cut"))).alias("c")).select("query_id", "c.class").distinct(), "ann-found")
    drop(spark, index_at, blocks_at, found_at)
    pairs = short.join(asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), "query_id").join(coded.select("class", "ids", F.col("embedding").alias("v")), "class")
    scored = pairs.select("query_id", "ids", cosine(F.col("q"), F.col("v")).alias("score")).select("query_id", F.explode("ids").alias("vec_id"), "score").filter("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Exact deduplication against immutable snapshots, screened by static binary-fuse filters.

Each batch of documents is reduced to one row per digest, so a text that a third of all rows share is one row from there
on. A snapshot keeps, for each bucket of digests, a static binary-fuse filter and the exact digests. A new batch is
grouped by itself, probes the filters, and only the positives join the exact buckets, where the texts' bytes decide.
Batches are folded in one after the other; every fold makes the next snapshot and leaves the earlier one as it was.

Defined results: a null text counts as empty, texts are equal when identical after lower-casing A-Z only, a null doc_id
never stays while its group has another, all rows of a group of null doc_ids alone stay, as none has an id to go by, rows that
repeat a doc_id share their decision, an empty table gives no rows, and columns other than the two named are ignored. (The
pipeline's stage decides by rows instead, so there one row of every group stays.)
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decidra.llm._common import BROADCAST_ROWS, U64, byte_texts, drop, join_by_key, lean, mix64, stage

BUCKET_DIGESTS = 60_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def digests(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest (SHA-256 of the normalised text in UTF-8), n_bytes."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = byte_texts(batch.column(1))
            found = [hashlib.sha256(t.lower()).digest() for t in texts]  # bytes.lower() maps A-Z only
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(found, pa.binary()), pa.array([len(t) for t in texts], pa.int64())], names=["doc_id", "digest", "n_bytes"]
            )

    return documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(per_batch), "doc_id long, digest binary, n_bytes long")


# --- binary-fuse filters ------------------------------------------------------------------------------------------


def _positions(keys: np.ndarray, seed: int, length: int, segments: int) -> np.ndarray:
    """Each key's three slots, in three neighbouring segments of the table."""
    with np.errstate(over="ignore"):
        h = mix64(keys + U64(seed))
        segment = ((h >> U64(32)) * U64(segments)) >> U64(32)
        h2 = mix64(h + U64(0x9E3779B97F4A7C15))
    within = [h2 & U64(length - 1), (h2 >> U64(20)) & U64(length - 1), (h2 >> U64(40)) & U64(length - 1)]
    return np.stack([(segment + U64(i)) * U64(length) + w for i, w in enumerate(within)]).astype(np.int64)


def _fingerprints(keys: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix64(keys ^ U64(seed * 2 + 1)) >> U64(56)).astype(np.uint8)


def build_fuse(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """(seed, segment length, segments, table of 8-bit fingerprints) over distinct unsigned 64-bit keys."""
    keys = np.unique(keys.astype(U64))
    n = max(len(keys), 2)
    length = 1 << max(2, int(np.log(n) / np.log(3.33) + 2.25))
    factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(n))
    seed = 0
    while True:
        seed += 1
        if seed % 10 == 0:
            factor *= 1.1
        segments = max(1, -(-int(n * factor) // length) - 2)
        size = (segments + 2) * length
        slots = _positions(keys, seed, length, segments)
        count = np.bincount(slots.ravel(), minlength=size)
        held = np.zeros(size, U64)  # xor of the (1-based) keys at a slot
        order = np.arange(1, len(keys) + 1, dtype=U64)
        for row in slots:
            np.bitwise_xor.at(held, row, order)
        rounds, left = [], len(keys)
        while left:
            single = np.flatnonzero(count == 1)
            if not len(single):
                break
            who, at = np.unique(held[single].astype(np.int64) - 1, return_index=True)
            rounds.append((who, single[at]))
            gone = slots[:, who]
            np.subtract.at(count, gone.ravel(), 1)
            for row in gone:
                np.bitwise_xor.at(held, row, order[who])
            left -= len(who)
        if not left:
            break
    table, prints = np.zeros(size, np.uint8), _fingerprints(keys, seed)
    for who, at in reversed(rounds):
        mine = slots[:, who]
        table[at] = prints[who] ^ table[mine[0]] ^ table[mine[1]] ^ table[mine[2]]  # its own slot is still 0
    return seed, length, segments, table.tobytes()


def probe_fuse(keys: np.ndarray, seed: int, length: int, segments: int, table: bytes) -> np.ndarray:
    slots, cells = _positions(keys.astype(U64), seed, length, segments), np.frombuffer(table, np.uint8)
    return (cells[slots[0]] ^ cells[slots[1]] ^ cells[slots[2]]) == _fingerprints(keys.astype(U64), seed)


def _keys(found: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(x)[8:16] for x in found), "<u8").astype(U64)


# --- snapshots ----------------------------------------------------------------------------------------------------


def _bucket(n: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(n)).cast("int")


def snapshot_filters(groups: DataFrame, buckets: int) -> DataFrame:
    """One static filter for each bucket of a snapshot's distinct digests."""

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *build_fuse(_keys(rows["digest"])))], columns=["bucket", "seed", "length", "segments", "cells"])

    return groups.select(_bucket(buckets).alias("bucket"), "digest").groupBy("bucket").applyInPandas(build, "bucket int, seed long, length long, segments long, cells binary")


def screen(incoming: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """The incoming digests (distinct) that the filters can't rule out."""

    def probe(rows: pd.DataFrame, filt: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(filt):
            return rows.iloc[:0][["digest"]]
        f = filt.iloc[0]
        return rows[probe_fuse(_keys(rows["digest"]), int(f.seed), int(f.length), int(f.segments), bytes(f.cells))][["digest"]]

    left = incoming.select("digest", _bucket(buckets).alias("bucket")).groupBy("bucket")
    return left.cogroup(filters.groupBy("bucket")).applyInPandas(probe, "digest binary")


def byte_check(pairs: DataFrame, documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of pairs (digest, old_id, new_id), the digests whose two texts are the same bytes after normalising.

    The ids of the pairs are counted: up to BROADCAST_ROWS are broadcast, so only the texts they name are shuffled.
    """
    pairs, _ = stage(pairs, "maybe-pairs")
    wanted, _ = stage(pairs.select(F.explode(F.array("old_id", "new_id")).alias("doc_id")).distinct(), "maybe-ids")
    few = wanted.count() <= BROADCAST_ROWS
    texts = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(wanted) if few else wanted, "doc_id", "left_semi")
    old, new = (texts.select(F.col("doc_id").alias(f"{x}_id"), ascii_lower(F.col("text")).alias(f"{x}_text")) for x in ("old", "new"))
    both = pairs.join(old, "old_id").join(new, "new_id")
    unnamed = pairs.filter("old_id IS NULL OR new_id IS NULL").select("digest")  # no id to fetch a text by: the digest decides
    return both.filter("old_text = new_text").select("digest").unionByName(unnamed).distinct()


def exact_groups(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 2) -> tuple[DataFrame, list[str]]:
    """Every row with its group (doc_id, keep_id, group_size, kept, text_sha256) and the staged tables it reads.

    documents: rows arrive in `batches` batches, dealt by a hash of the id; the first is the first snapshot.
    """
    spark = documents.sparkSession
    arrived = digests(documents, id_col, text_col).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int"))
    rows, rows_at = stage(arrived, "digests")
    per_batch = rows.groupBy("batch", "digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    grouped, grouped_at = stage(per_batch, "batch-groups")
    buckets = 1 + grouped.count() // BUCKET_DIGESTS
    spent = [grouped_at]
    own = grouped.withColumn("variant", F.when(F.col("batch") > 0, F.col("batch")).otherwise(0))
    snapshot = own.filter("batch = 0").drop("batch")
    links = own.filter("batch = 0").select("batch", "digest", F.lit(0).alias("variant"))  # which group a batch's digest went to
    for batch in range(1, batches):
        new = own.filter(F.col("batch") == batch).drop("batch")
        maybe = screen(new, snapshot_filters(snapshot.filter("variant = 0"), buckets), buckets)
        pairs = maybe.join(new, "digest").select("digest", F.col("keep_id").alias("new_id")).join(snapshot.filter("variant = 0").select("digest", F.col("keep_id").alias("old_id")), "digest")
        same, same_at = stage(byte_check(pairs, documents, id_col, text_col), "same-bytes")
        known = new.join(same, "digest", "left_semi").withColumn("variant", F.lit(0))
        fresh = new.join(same, "digest", "left_anti")
        # a digest that only this batch has starts a group of its own; one that failed the byte check keeps its variant
        fresh = fresh.join(snapshot.filter("variant = 0").select("digest", F.lit(1).alias("taken")), "digest", "left").withColumn("variant", F.when(F.col("taken") == 1, F.col("variant")).otherwise(0)).drop("taken")
        links = links.unionByName(known.unionByName(fresh).select(F.lit(batch).alias("batch"), "digest", "variant"))
        merged = snapshot.unionByName(known).unionByName(fresh).groupBy("digest", "variant").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
        snapshot, snapshot_at = stage(merged, "snapshot")
        spent += [same_at, snapshot_at]
    decided = links.join(snapshot, ["digest", "variant"]).select("batch", "digest", "keep_id", "group_size")
    # most texts are alone: only groups of several rows are looked up, a common text's rows in several tasks
    of = F.struct("batch", "digest")
    table, table_at = stage(decided.filter("group_size > 1").select(of.alias("of"), F.col("keep_id").alias("kept_id"), F.col("group_size").alias("rows")), "decided")
    drop(spark, *spent)
    joined = join_by_key(rows.withColumn("of", of), table, "of", ["doc_id"], "left")
    alone = F.col("rows").isNull()
    keep, size = F.when(alone, F.col("doc_id")).otherwise(F.col("kept_id")), F.coalesce("rows", F.lit(1)).cast("long")
    named = joined.select("doc_id", keep.alias("keep_id"), size.alias("group_size"), F.lower(F.hex("digest")).alias("text_sha256"))
    out = named.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), "text_sha256")
    return out, [rows_at, table_at]

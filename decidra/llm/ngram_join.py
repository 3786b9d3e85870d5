"""Jaccard self-join of word n-gram sets by token-combination prefixes; components of the links.

Everything is exact up to collisions of hashes (62 bits of a word, 64 of a shingle); the steps only leave out what can't link.

1. Every document's shingles are put in hash order, and an extended prefix of them is posted. Linked documents share so
   many tokens of their prefixes that a document with too few tokens that others post is out.
2. Of the documents left, equal sets become one representative, and the tokens are classed by the exact number of
   representatives that hold them: unique, rare (up to RARE) or frequent.
3. A prefix takes unique tokens first, then rare, then frequent ones, in hash order within each. It ends when no choice of
   as many deletions as a link allows could destroy all its signatures. Unique tokens give none, so a document with
   enough of them is done. A rare token is a signature by itself. Frequent tokens fall into token classes (by hash, about
   one for eight tokens of a document of that size band); the 2-combinations within a class are signatures, so a class
   with c tokens takes c - 1 deletions. Small documents use single tokens throughout.
4. Buckets with the same documents count as one, as often as there are of them: long documents share thousands. Within each
   signature's bucket, documents are paired with the bucket's most central one, whose tokens most others have, not with each
   other: the original of many copies is near to them all. Pairs are left out whose sizes, or whose numbers of tokens that
   anyone else has, can't reach the threshold. Each document's most voted pair is verified on the whole sets. Then only
   pairs that share a bucket and whose components still differ are left; a large bucket is dealt in blocks for them, to
   each of which go those that aren't in the bucket's most frequent component. Of those the join emits the ones that pass a bound from bitmaps: each token flips one bit of
   its document's bitmap, so the bits that differ are no more than the tokens that differ. All that pass are verified.
5. The links found so far are enough for the components, not for the number of links. Links are inside components, so each
   component's representatives are dealt in blocks, and every pair of them is verified, in the products of two blocks.

Defined results: null and empty texts and texts without words have an empty set, link with nothing and are components
of their own; shorter texts are one shingle of all their words; a null doc_id takes no part in links; rows that repeat a
doc_id with its text are one document, and rows that repeat it with another text are given its component, whichever of
its texts was joined; an empty table gives no rows; columns other than the two named are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decidra.llm._common import BROADCAST_ROWS, U64, batch_rows, drop, join_by_key, join_dealt, lean, mix64, release, stage
from decidra.llm._shingles import shingle_sets
from decidra.llm.components import components

BATCH_ROWS = 1_000
RARE = 8
MARK_WORDS = 16  # 64-bit words of a document's parity bitmap
EXTRA = 0.7  # of the allowed deletions, by which the first prefix is extended
CLASS_TOKENS = 8
BLOCK_ROWS, BLOCK_TOKENS = 256, 250_000  # of a block of a component's representatives, on average
BUCKET_ROWS = 1_024  # of a block of a bucket's documents, on average
PAIR_ROWS, PAIR_COLUMNS = 32, 4_096  # pairs of blocks in an Arrow batch, tokens in a product
SMALL = 16


class Threshold:
    """Sets link when den * |intersection| >= num * |union|."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def deletions(self, n: int) -> int:
        """How many tokens of a set of n can be missing from a set that it links with."""
        return n + -(self.num * n // self.den) if self.num * n % self.den == 0 else n - self.num * n // self.den - 1

    def prefix(self, n: int) -> int:
        gone = self.deletions(n)
        return min(n, gone + 1 + int(np.ceil(EXTRA * gone)))

    def shared(self, n: int) -> int:
        """Least number of posted tokens that a set of n shares with any set that it links with."""
        least = max(1, -(-self.num * n // self.den))
        return max(1, min(self.prefix(m) - self.deletions(m) for m in range(least, n + 1))) if n < 64 else max(1, self.prefix(least) - self.deletions(least))

    def band(self, n: int) -> int:
        """Size bands; sets that link are in the same or in neighbouring ones."""
        return int(np.floor(np.log(n) / np.log(self.den / self.num) + 1e-9))

    def band_start(self, band: int) -> float:
        return (self.den / self.num) ** band

    def reachable(self, n_a: Column, n_b: Column, common: Column) -> Column:
        """Whether `common` shared tokens would do for sets of n_a and n_b."""
        return self.den * common >= self.num * (n_a + n_b - common)


def _posted(texts: DataFrame, k: int, t: Threshold) -> DataFrame:
    """doc_id and each token of its extended prefix in hash order."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [s[: t.prefix(len(s))] for s in shingle_sets(batch.column(1), k)]
            ids = np.repeat(np.array(batch.column(0).to_pylist(), np.int64), [len(p) for p in parts])
            flat = np.concatenate(parts) if parts else np.zeros(0, U64)
            for a in range(0, len(flat), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(ids[a : a + 100_000]), pa.array(flat[a : a + 100_000].view(np.int64))], names=["doc_id", "token"])

    return texts.mapInArrow(lean(per_batch), "doc_id long, token long")


def _described(texts: DataFrame, k: int, t: Threshold, with_tokens: bool) -> DataFrame:
    """doc_id, n_shingles, set_key (a 128-bit digest of the set), needed (posted tokens to share), and the tokens if wanted."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column(1), k))
            columns = [
                batch.column(0),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                pa.array([t.shared(len(s)) if len(s) else 0 for s in sets], pa.int64()),
            ]
            names = ["doc_id", "n_shingles", "set_key", "needed"]
            if with_tokens:
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                columns, names = [*columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], [*names, "tokens"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return texts.mapInArrow(lean(per_batch), "doc_id long, n_shingles long, set_key binary, needed long" + ", tokens array<long>" * with_tokens)


def prefix_signatures(n: int, rare: np.ndarray, frequent: np.ndarray, t: Threshold) -> list[np.ndarray]:
    """The signatures of a set of n tokens, of which these (sorted) others hold too."""
    wanted = t.deletions(n) + 1 - (n - len(rare) - len(frequent))
    if wanted <= 0:
        return []
    out = [mix64(rare[:wanted] + U64(1))]
    wanted -= len(rare)
    if wanted <= 0:
        return out
    for band in (t.band(n), t.band(n) + 1):
        start = t.band_start(band)
        salt = U64((band * 0x9E3779B97F4A7C15 + 7) % (1 << 64))
        if start < SMALL:
            out.append(mix64(frequent[:wanted] ^ salt))
            continue
        classes = (frequent >> U64(7)) % U64(max(1, int(start / CLASS_TOKENS)))
        held: dict[int, list[int]] = {}
        left, pairs = wanted, []
        for token, c in zip(frequent.tolist(), classes.tolist(), strict=True):
            mine = held.setdefault(c, [])
            pairs += [(other, token) for other in mine]
            left -= bool(mine)
            mine.append(token)
            if not left:
                break
        two = np.array(pairs, U64).reshape(-1, 2)
        out.append(mix64(mix64(two[:, 0] ^ salt) * U64(3) + two[:, 1]))
    return out


def _signatures(rows: DataFrame, t: Threshold) -> DataFrame:
    """From (doc_id, n_shingles, common: array of (n, token)): sig, doc_id, n, a (tokens that others hold), central, bitmap.

    central grows with the share of a document's tokens that others hold, and with how many do. A document's signatures come without bitmap; one row without sig has its bitmap over the tokens that others hold.
    """
    bits = 64 * MARK_WORDS

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                ids, sizes, lists = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
                at, flat = lists.offsets.to_numpy(), lists.values
                held, tokens = flat.field(0).to_numpy(), flat.field(1).to_numpy().view(U64)
                made, facts, bitmaps = [], [], []
                for i, (doc, n) in enumerate(zip(ids, sizes, strict=True)):
                    mine, first = np.unique(tokens[at[i] : at[i + 1]], return_index=True)
                    df = held[at[i] : at[i + 1]][first]
                    sigs = prefix_signatures(n, mine[df <= RARE], mine[df > RARE], t)
                    if sigs and (found := np.unique(np.concatenate(sigs))).size:
                        made.append(found)
                        facts.append((doc, n, len(mine), int(1000 * np.log2(df).sum() / n)))
                        flips = np.bincount((mix64(mine) >> U64(20)).astype(np.int64) % bits, minlength=bits).astype(np.uint8) & 1
                        bitmaps.append(np.packbits(flips, bitorder="little").view("<i8"))
                if not made:
                    continue
                each, docs = np.array([len(f) for f in made]), np.array(facts, np.int64)
                total, m = int(each.sum()), len(made)
                sig = pa.concat_arrays([pa.array(np.concatenate(made).view(np.int64)), pa.nulls(m, pa.int64())])
                four = [pa.array(np.concatenate([np.repeat(docs[:, c], each), docs[:, c]])) for c in range(4)]
                ends = pa.array(np.arange(m + 1, dtype=np.int32) * MARK_WORDS)
                marks = pa.concat_arrays([pa.nulls(total, pa.list_(pa.int64())), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(bitmaps)))])
                yield pa.RecordBatch.from_arrays([sig, *four, marks], names=["sig", "doc_id", "n", "a", "central", "bitmap"])

    return rows.select("doc_id", "n_shingles", "common").mapInArrow(lean(per_batch), "sig long, doc_id long, n long, a long, central long, bitmap array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, t: Threshold) -> DataFrame:
    """The pairs (x, y) that link, on their whole sets."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            ax, ay = x.offsets.to_numpy(), y.offsets.to_numpy()
            fx, fy = x.values.to_numpy(), y.values.to_numpy()
            keep = []
            for i in range(len(batch)):
                p, q = fx[ax[i] : ax[i + 1]], fy[ay[i] : ay[i + 1]]
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(t.den * both >= t.num * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["x", "y"]).filter(pa.array(keep, pa.bool_()))

    one, two = (sets.select(F.col("doc_id").alias(v), F.col("tokens").alias(f"t{v}")) for v in "xy")
    # y first: a document with many partners is an x, and its tokens aren't shuffled once for each of them, but for every HEAVY_ROWS
    both = join_dealt(pairs.select("x", "y").join(two, "y"), one, "x", ["y"], counted=pairs)
    return both.select("x", "y", "tx", "ty").mapInArrow(lean(per_batch), "x long, y long")


def linked_counts(i: int, j: int, ids: np.ndarray, block: np.ndarray, ends: np.ndarray, tokens: np.ndarray, t: Threshold) -> tuple[np.ndarray, np.ndarray]:
    """(ids, numbers of links) over all pairs of sets between blocks i and j, or within i if they are one.

    Sets with one id count as one, which links if any of them does.
    """
    sizes = np.diff(ends)
    _, column, held = np.unique(tokens, return_inverse=True, return_counts=True)
    row, wanted = np.repeat(np.arange(len(ids)), sizes), held[column] > 1
    row, column = row[wanted], (np.cumsum(held > 1) - 1)[column[wanted]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    one, two = np.flatnonzero(block == i), np.flatnonzero(block == j)
    both = np.zeros((len(one), len(two)), np.int64)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, PAIR_COLUMNS):
        a, b = np.searchsorted(column, [start, start + PAIR_COLUMNS])
        dense = np.zeros((len(ids), int(column[b - 1]) - start + 1), np.float32)
        dense[row[a:b], column[a:b] - start] = 1
        both += (dense[one] @ dense[two].T).astype(np.int64)
    linked = (t.den * both >= t.num * (sizes[one][:, None] + sizes[two][None, :] - both)) & (ids[one][:, None] != ids[two][None, :])
    (x, at_x), (y, at_y) = np.unique(ids[one], return_inverse=True), np.unique(ids[two], return_inverse=True)
    if len(x) < len(one) or len(y) < len(two):
        whole = np.zeros((len(x), len(y)), bool)
        np.logical_or.at(whole, (at_x[:, None], at_y[None, :]), linked)
        linked = whole
    else:
        linked = linked[np.argsort(ids[one])][:, np.argsort(ids[two])]
    if i == j:
        return x, linked.sum(1)
    return np.concatenate([x, y]), np.concatenate([linked.sum(1), linked.sum(0)])


def _degrees(sets: DataFrame, placed: DataFrame, t: Threshold) -> DataFrame:
    """rep and n_links (all links, verified on the whole sets) of the representatives in (node, component)."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two, rows = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            at, flat = rows.offsets.to_numpy(), rows.values
            ids, block, lists = flat.field(0).to_numpy(), flat.field(1).to_numpy(), flat.field(2)
            ends, tokens = lists.offsets.to_numpy(), lists.values.to_numpy()
            found = [linked_counts(i, j, ids[a:b], block[a:b], ends[a : b + 1] - ends[a], tokens[ends[a] : ends[b]], t) for i, j, a, b in zip(one, two, at[:-1], at[1:], strict=True)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[c] for f in found])) for c in range(2)], names=["rep", "n"])

    spark = sets.sparkSession
    members = sets.join(placed.withColumnRenamed("node", "doc_id"), "doc_id")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum("n_shingles") / BLOCK_TOKENS)).cast("int")
    large, large_at = stage(members.groupBy("component").agg(blocks.alias("blocks")).filter("blocks > 1"), "large-components")  # one for BLOCK_ROWS members or BLOCK_TOKENS tokens at most
    few = F.broadcast(large) if large.count() <= BROADCAST_ROWS else large
    dealt = members.join(few, "component", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    each = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # one key in one column: blocks of a component must not meet in one task
    pair = F.struct("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    rows = each.select(pair.alias("pair"), F.struct("doc_id", "block", "tokens").alias("row")).groupBy("pair").agg(F.collect_list("row").alias("rows"))
    with batch_rows(spark, PAIR_ROWS):
        counted, counted_at = stage(rows.select("pair.i", "pair.j", "rows").mapInArrow(lean(per_batch), "rep long, n long"), "block-links")
    out, _ = stage(counted.groupBy("rep").agg(F.sum("n").alias("n_links")), "degrees")
    drop(spark, large_at, counted_at)
    return out


def near_duplicates(documents: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", count_links: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id and, with count_links, n_links (all links of its set's representative) of every row."""
    with batch_rows(documents.sparkSession, BATCH_ROWS):
        return _near_duplicates(documents, k, num, den, id_col, text_col, count_links)


def _near_duplicates(documents: DataFrame, k: int, num: int, den: int, id_col: str, text_col: str, count_links: bool) -> DataFrame:
    spark, t = documents.sparkSession, Threshold(num, den)
    texts = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known = texts.filter(F.col("doc_id").isNotNull())
    facts, facts_at = stage(_described(texts, k, t, False), "set-facts")
    posted, posted_at = stage(_posted(known, k, t), "posted")
    # 1. which posted tokens more than one document posts, and which documents have enough of them
    several, several_at = stage(posted.groupBy("token").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("token"), "several")
    release(spark)
    counts, counts_at = stage(posted.join(several, "token").groupBy("doc_id").agg(F.count("*").alias("shared")), "shared")
    drop(spark, posted_at, several_at)
    release(spark)
    able = facts.join(counts, "doc_id").filter("shared >= needed")
    # 2. one representative of each set
    reps = able.groupBy("set_key").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    wanted, wanted_at = stage(reps, "representatives")
    sets, sets_at = stage(_described(known.join(wanted, "doc_id", "left_semi"), k, t, True).select("doc_id", "n_shingles", "tokens"), "sets")
    drop(spark, wanted_at, counts_at)
    release(spark)
    each = sets.select("doc_id", F.explode("tokens").alias("token"))
    held, held_at = stage(each.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1"), "held")
    common = each.join(held, "token").groupBy("doc_id").agg(F.collect_list(F.struct("n", "token")).alias("common"))
    # 3. signatures
    made, sigs_at = stage(_signatures(sets.select("doc_id", "n_shingles").join(common, "doc_id"), t), "signatures")
    marks = [f"m{i}" for i in range(MARK_WORDS)]
    sigs, bitmaps = made.filter("sig IS NOT NULL").select("sig", "doc_id", "n", "a", "central"), made.filter("sig IS NULL").select("doc_id", *(F.element_at("bitmap", i + 1).alias(m) for i, m in enumerate(marks)))
    drop(spark, held_at)
    release(spark)
    # 4. each document with the most central of its buckets; buckets of the same documents are one
    head = F.max(F.struct("central", (-F.col("doc_id")).alias("down"), "n", "a"))
    buckets = sigs.groupBy("sig").agg(head.alias("head"), F.count("*").alias("m"), F.bit_xor(F.xxhash64("doc_id")).alias("who"), F.bit_xor(F.xxhash64(F.lit(1), "doc_id")).alias("else")).filter("m > 1")
    heads, heads_at = stage(buckets.groupBy("m", "who", "else").agg(F.min("sig").alias("sig"), F.first("head").alias("head"), F.count("*").alias("times")).select("sig", "head", "times", "m"), "heads")
    shown = sigs.drop("central").join(heads.withColumn("x", -F.col("head.down")), "sig")
    near = shown.filter("doc_id <> x").filter(t.reachable(F.col("n"), F.col("head.n"), F.least("a", "head.a")))
    votes, votes_at = stage(near.groupBy("x", F.col("doc_id").alias("y")).agg(F.sum("times").alias("votes")), "votes")
    best = votes.groupBy("y").agg(F.max_by("x", F.struct("votes", -F.col("x"))).alias("x")).select("x", "y")
    tried, tried_at = stage(best, "tried", most_rows=votes.count())
    first, first_at = stage(_verified(tried, sets, t), "links")
    # a document's name is the end of two steps up its verified pairs: equal names are one component, and most are enough
    up = first.select(F.col("y").alias("node"), F.col("x").alias("component"))
    above = up.select(F.col("node").alias("component"), F.col("component").alias("above"))
    named, named_at = stage(up.join(above, "component", "left").select("node", F.coalesce("above", "component").alias("component")), "names", most_rows=first.count())
    # what shares a bucket and is not known to be one component yet
    placed, placed_at = stage(
        sigs.drop("central").join(heads.select("sig", "m"), "sig").join(named.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")), "placed"
    )
    held_by = placed.groupBy("sig", "component").agg(F.count("*").alias("rows"), F.min("n").alias("least"))
    several_in = held_by.groupBy("sig").agg(F.count("*").alias("kinds"), F.max(F.struct("rows", "component")).alias("top"), F.min("least").alias("least")).filter("kinds > 1")
    open_sigs, open_at = stage(several_in.select("sig", "least", F.col("top.component").alias("top")), "open")
    hopeful = placed.join(open_sigs, "sig").filter(t.reachable(F.col("n"), F.greatest("least", F.ceil(F.col("n") * num / den)), F.col("a"))).drop("least")
    left, left_at = stage(hopeful.join(bitmaps, "doc_id"), "left")
    # a bucket's rows are dealt in blocks; those that aren't in its most frequent component go to all of its blocks
    blocks = F.ceil(F.col("m") / BUCKET_ROWS).cast("int")
    y = left.withColumn("block", F.pmod(F.xxhash64("doc_id"), blocks).cast("int"))
    x = left.filter("component <> top").withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    x, y = (df.select("sig", "block", F.col("doc_id").alias(v), (F.col("component") == F.col("top")).alias(f"top{v}"), *(F.col(c).alias(f"{c}{v}") for c in ("n", "a", "component", *marks))) for df, v in ((x, "x"), (y, "y")))
    differ = sum((F.bit_count(F.col(f"{m}x").bitwiseXOR(F.col(f"{m}y"))) for m in marks), F.col("nx") - F.col("ax") + F.col("ny") - F.col("ay"))
    near_enough = (den + num) * differ <= (den - num) * (F.col("nx") + F.col("ny"))
    once = F.col("topy") | (F.col("x") < F.col("y"))
    pairs = x.join(y, ["sig", "block"]).filter(once & (F.col("componentx") != F.col("componenty")) & t.reachable(F.col("nx"), F.col("ny"), F.least("ax", "ay")) & near_enough)
    apart = pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    found, found_at = stage(apart.select("x", "y").distinct(), "near-pairs")
    known_pairs = tried.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    rest, rest_at = stage(found.join(known_pairs, ["x", "y"], "left_anti"), "rest", most_rows=found.count())
    second, second_at = stage(_verified(rest, sets, t), "links")
    links = first.unionByName(second)
    final, final_at = stage(components(links, "x", "y"), "components", most_rows=2 * links.count())
    release(spark)
    degree = _degrees(sets, final, t) if count_links else final.select(F.col("node").alias("rep"), F.lit(None).cast("long").alias("n_links"))
    # representatives of all sets, then their components; a component's name is its smallest document
    rep_of = facts.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("m"))
    table = rep_of.join(final.withColumnRenamed("node", "rep"), "rep", "left").join(degree, "rep", "left").filter("m > 1 OR component IS NOT NULL").select("set_key", F.coalesce("component", "rep").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    decided, _ = stage(table, "decided")  # sets of several documents or with links
    drop(spark, sets_at, sigs_at, heads_at, votes_at, first_at, tried_at, named_at, placed_at, open_at, left_at, found_at, rest_at, second_at, final_at)
    release(spark)
    empty = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    key = F.when(~empty, F.col("set_key"))
    joined = join_by_key(facts.withColumn("set_key", key), decided, "set_key", ["doc_id"], "left")
    out = joined.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return out if count_links else out.drop("n_links")

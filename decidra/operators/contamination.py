"""Contamination of a corpus by benchmark items: shared token n-grams and equal option sets; exact dedup; guards.

The benchmark's grams are the small side. A Bloom filter of them is probed inside each document's array of grams, so that only
grams that may be shared become rows and strings; those are joined by their text. The grams are broadcast only while their
number, counted first, is below a bound; beyond it both sides are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decidra.functions.text import let, option_set, tokens
from decidra.sources.staging import staged

BROADCAST_GRAMS = 2_000_000
BITS, MOST_WORDS = 16, 1 << 19  # of the filter: for each gram, and words at most (4 MB)
HEAD = 3  # tokens of a gram that are looked up first
#: A benchmark item is flagged from this share of its grams, or this many of them in one training item.
FLAG_SHARE, FLAG_COUNT = 0.05, 20


def grams_of(rows: DataFrame, key: str, text: str, n: int = 13) -> DataFrame:
    """key and each distinct n-gram."""
    return rows.select(key, F.explode(gram_texts(F.col(text), n)).alias("gram"))


def _starts(w: Column, n: int) -> Column:
    return F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1))).otherwise(F.array().cast("array<int>"))


def gram_texts(text: Column, n: int = 13) -> Column:
    """The distinct runs of n tokens of a text."""
    return let(tokens(text), lambda w: F.array_distinct(F.transform(_starts(w, n), lambda i: F.array_join(F.slice(w, i, n), " "))))


def _words(grams: int) -> int:
    """64-bit words of a filter of about BITS bits a gram: a power of two."""
    return 1 << max(0, min(MOST_WORDS, (max(grams, 1) * BITS // 64)).bit_length())


def _probes(h: Column) -> list[Column]:
    return [h, F.xxhash64(F.lit("second"), h)]


def bloom_words(grams: DataFrame, n: int, words: int) -> Column:
    """The filter of (gram), and of each one's first HEAD tokens, as one array of 64-bit words, which is a scalar subquery: `words` bounds its size."""
    begun = F.split("gram", " ")
    both = F.array(F.xxhash64(begun), F.xxhash64(*(F.get(begun, F.lit(i)) for i in range(HEAD))))
    hashes = grams.select(F.explode(both).alias("h")).select(F.explode(F.array(*_probes(F.col("h")))).alias("h"))
    word = F.shiftrightunsigned("h", 6).bitwiseAND(words - 1).cast("int").alias("word")
    bits = hashes.groupBy(word).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 AS int))")).alias("bits"))
    every = grams.sparkSession.range(words).select(F.col("id").cast("int").alias("word")).join(bits, "word", "left")
    one = every.agg(F.sort_array(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))).alias("all")).select(F.transform("all", lambda x: x["bits"]).alias("words"))
    return staged(one).scalar()


def maybe_shared(text: Column, bloom: Column, words: int, n: int = 13) -> Column:
    """The distinct runs of n tokens that the filter lets through."""

    def passes(held: Column, h: Column) -> Column:
        fine = F.lit(True)
        for probe in _probes(h):
            at = F.shiftrightunsigned(probe, 6).bitwiseAND(words - 1).cast("int")
            fine = fine & (F.call_function("bit_get", F.get(held, at), probe.bitwiseAND(63).cast("int")) == 1)
        return fine

    # most places fall by their first tokens, which cost no array; each hash is made once, not once for each probe
    heads = lambda w: F.transform(_starts(w, n), lambda i: F.struct(i.alias("i"), F.xxhash64(*(F.get(w, i + j - 1) for j in range(HEAD))).alias("h")))
    likely = lambda w, held: F.filter(heads(w), lambda x: passes(held, x["h"]))
    hashed = lambda w, held: F.transform(likely(w, held), lambda x: F.struct(x["i"].alias("i"), F.xxhash64(F.slice(w, x["i"], n)).alias("h")))
    made = lambda w, held: F.transform(F.filter(hashed(w, held), lambda x: passes(held, x["h"])), lambda x: F.array_join(F.slice(w, x["i"], n), " "))
    return let(tokens(text), lambda w: F.array_distinct(made(w, bloom)))


def maybe_grams(bench: DataFrame, corpus: DataFrame, n: int = 13) -> tuple[DataFrame, DataFrame, int]:
    """(the benchmark's grams, staged: item_id, gram; the corpus's that may be among them: doc_id, gram; how many the first are)."""
    wanted = staged(grams_of(bench, "item_id", "text", n))
    count = wanted.count()
    words = _words(2 * count)
    bloom = bloom_words(wanted, n, words)
    held = corpus.select("doc_id", "text").withColumn("_bloom", bloom)  # a subquery can't stand inside an array's lambda itself
    return wanted, held.select("doc_id", F.explode(maybe_shared(F.col("text"), F.col("_bloom"), words, n)).alias("gram")), count


def gram_hits(bench: DataFrame, corpus: DataFrame, n: int = 13) -> DataFrame:
    """item_id, doc_id, gram of every shared gram. bench: item_id, text; corpus: doc_id, text."""
    wanted, maybe, count = maybe_grams(bench, corpus, n)
    return maybe.join(F.broadcast(wanted) if count <= BROADCAST_GRAMS else wanted, "gram")


def best_match(hits: DataFrame) -> DataFrame:
    """item_id, best (the first document with the most shared grams), shared."""
    each = hits.groupBy("item_id", "doc_id").agg(F.count("*").alias("shared"))
    return each.groupBy("item_id").agg(F.max_by(F.struct("doc_id", "shared"), F.struct("shared", -F.col("doc_id"))).alias("m")).select("item_id", F.col("m.doc_id").alias("best"), "m.shared")


def summary(bench: DataFrame, hits: DataFrame, n: int = 13) -> DataFrame:
    """item_id, grams, hits, share, best, shared, flagged of every benchmark item. hits are worked out once, though used twice."""
    hits = staged(hits)
    size = bench.select("item_id", F.size(gram_texts(F.col("text"), n)).cast("long").alias("grams"))
    distinct = hits.groupBy("item_id").agg(F.count_distinct("gram").alias("hits"))
    rows = size.join(distinct, "item_id", "left").join(best_match(hits), "item_id", "left").withColumns({"hits": F.coalesce("hits", F.lit(0)), "shared": F.coalesce("shared", F.lit(0))})
    share = F.col("hits") / F.greatest("grams", F.lit(1))
    return rows.withColumns({"share": share, "flagged": (share >= FLAG_SHARE) | (F.col("shared") >= FLAG_COUNT)})


def option_set_hits(bench: DataFrame, corpus: DataFrame, least: int = 3, owners: int = 2) -> DataFrame:
    """item_id, doc_id with equal option sets (column `keys`) of at least `least` options that few benchmark items own."""
    named = bench.select("item_id", option_set(F.col("keys")).alias("opts")).filter(F.size("opts") >= least)
    rare = named.groupBy("opts").agg(F.count_distinct("item_id").alias("n")).filter(F.col("n") <= owners).select("opts")
    return named.join(rare, "opts").join(corpus.select("doc_id", option_set(F.col("keys")).alias("opts")), "opts").select("item_id", "doc_id")


def dedup_exact(rows: DataFrame, content: Column, order: str) -> DataFrame:
    """The first row, in `order`, of each content; a min over structs keeps it partial."""
    first = rows.groupBy(F.sha2(content, 256).alias("_key")).agg(F.min_by(F.struct(*rows.columns), order).alias("_r"))
    return first.select("_r.*")


def guarded(rows: DataFrame, fields: list[str], markers: list[str], path: Column | None = None) -> DataFrame:
    """rows, or a failing job if a field or the path has a marker (lower case) of answers that may not be training labels."""
    parts = [F.lower(F.coalesce(F.col(f).cast("string"), F.lit(""))) for f in fields]
    if path is not None:
        parts.append(F.lower(path))
    text = F.concat_ws("\n", *parts)
    bad = text.rlike("|".join(markers)) | text.contains("/published/")
    return rows.withColumn("_ok", F.when(bad, F.raise_error(F.concat(F.lit("not a teacher's own answer: "), text)).cast("boolean")).otherwise(True)).filter("_ok").drop("_ok")


def check_release(given: DataFrame, known: DataFrame) -> DataFrame:
    """given (fast_sha, strong_sha, label) with the release that has both hashes; a label that names another ends the job."""
    joined = given.join(known, ["fast_sha", "strong_sha"], "left")
    names = F.regexp_extract_all(F.lower("label"), F.lit(r"g[0-9]+[a-z]?"), F.lit(0))
    wrong = (F.size(names) > 0) & ~F.coalesce(F.array_contains(names, F.lower("release")), F.lit(False))
    return joined.withColumn("_ok", F.when(wrong, F.raise_error(F.concat(F.lit("weights are not of "), F.col("label"))).cast("boolean")).otherwise(True)).filter("_ok").drop("_ok")

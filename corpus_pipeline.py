"""The corpus pipeline: toxicity, exact dedup, near-duplicate join, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written and read again as the next one's docs. All
but the last give the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decidra.llm._common import numbered_rows, ship, stage, without
from decidra.llm.exact_dedup import exact_groups
from decidra.llm.mixing import mix_documents
from decidra.llm.ngram_join import near_duplicates
from decidra.llm.packing import pack_documents
from decidra.llm.toxicity import fit_on, keep_clean

#: Above this share a word n-gram set is a near copy; five words to a shingle.
NEAR_WORDS, NEAR_NUM, NEAR_DEN = 5, 80, 100
#: Small sources are repeated up to this often; no source is cut, so every clean document stays.
MAX_REPEAT = 1.25


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    ship(spark)
    return keep_clean(docs, fit_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, one row stays: the document with the largest doc_id; null and repeated ids come last."""
    ship(spark)
    rows, row_id = numbered_rows(docs, above=False)
    groups, _ = exact_groups(rows, id_col=row_id)
    gone = groups.filter("NOT kept").select(F.col("doc_id").alias(row_id))
    return without(rows, gone, "exact-copies", row_id).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked near copies, one row stays: the document with the smallest doc_id; null and repeated ids come last."""
    ship(spark)
    rows, row_id = numbered_rows(docs, above=True)
    joined = near_duplicates(rows, NEAR_WORDS, NEAR_NUM, NEAR_DEN, id_col=row_id, count_links=False)
    gone = joined.filter("doc_id <> component_id").select(F.col("doc_id").alias(row_id))
    return without(rows, gone, "near-copies", row_id).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix schedules them; the largest source is passed over exactly once."""
    ship(spark)
    return mix_documents(docs, max_repeat=MAX_REPEAT)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens."""
    ship(spark)
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: SQL expresses neither the lexicon, the token ids nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs, _ = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

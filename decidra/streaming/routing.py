"""Routing as a stream: a metadata-only log and counts by reason; and, in a batch, repeats answered from the first (`answers` does so in a stream)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: What a log row may hold: never the state or the text of a question.
LOGGED = ("t", "request_id", "session_id", "step", "escalated", "reason", "fast_op", "chord", "final_op", "conf", "fast_s", "total_s")


def log_rows(routed: DataFrame) -> DataFrame:
    return routed.select(*[c for c in LOGGED if c in routed.columns])


def write_log(routed: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends log rows as files; a restart goes on from the checkpoint."""
    writer = log_rows(routed).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def reason_counts(routed: DataFrame) -> DataFrame:
    """Live counts: state is one row for each reason."""
    return routed.groupBy("reason").agg(F.count("*").alias("n"))


def cached(requests: DataFrame, key: str, order: str) -> DataFrame:
    """In a batch: whether each request would be answered from the cache (its key was there before)."""
    first = requests.groupBy(key).agg(F.min(order).alias("_first"))
    return requests.join(first, key).withColumn("hit", F.col(order) > F.col("_first")).drop("_first")


def echoed(requests: DataFrame, key: str, order: str, answer: str) -> DataFrame:
    """In a batch: every request with its own identity, the answer of the first with its key, and whether that came from the cache."""
    first = requests.groupBy(key).agg(F.min(order).alias("_first"), F.min_by(answer, order).alias("_answer"))
    joined = requests.join(first, key).withColumn("hit", F.col(order) > F.col("_first"))
    return joined.withColumn(answer, F.col("_answer")).drop("_first", "_answer")

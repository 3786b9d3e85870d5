"""A resumable prediction run as a stream: an idempotent sink, keyed by the query and its micro-batch.

A micro-batch's items that have no success yet are predicted and written to a folder of their own, named by the query's id
and the batch's number. The folder counts once it has its mark of success, which the writer sets last. A batch that is run again after its
write, but before the query's checkpoint, finds the mark and does nothing; one that was killed while it wrote is written anew. So the
log has each item once, whatever was killed; an item that failed is tried again by a later run, and its last record counts.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from decidra.operators.runner import last_wins, run_predictions, todo

DONE = "_SUCCESS"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def committed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The log's records of the batches that were written whole, with `run` and `batch`."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/run=*/batch=*/{DONE}")
    marks = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) or []
    folders = [m.getPath().getParent().toString() for m in marks]  # one for each micro-batch
    whole = f"{schema}, run string, batch long"
    if not folders:
        return spark.createDataFrame([], whole)
    return spark.read.schema(whole).option("basePath", path).parquet(*folders)


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a query keeps in its checkpoint over restarts."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def write_predictions(items: DataFrame, predict: Callable[[dict], dict], schema: str, path: str, checkpoint: str, id_col: str = "item_id", after_write: Callable[[int], None] | None = None) -> StreamingQuery:
    """Starts the run over a stream of items. schema: that of run_predictions, with id_col and error.

    Of an item that repeats within a micro-batch one row is predicted. after_write is called between the write and the checkpoint.
    """

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        folder = f"{path}/run={query_id(spark, checkpoint)}/batch={number}"
        if not _exists(spark, f"{folder}/{DONE}"):
            left = todo(batch.dropDuplicates([id_col]), committed(spark, path, schema), [id_col])
            run_predictions(left, predict, schema, id_col).write.mode("overwrite").parquet(folder)
        if after_write:
            after_write(number)

    return items.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def results(spark: SparkSession, path: str, schema: str, id_col: str = "item_id") -> DataFrame:
    """One record for each item: a success if there is one, else its last failure."""
    order = F.struct(F.col("error").isNull().alias("fine"), "batch", "run")
    return last_wins(committed(spark, path, schema).withColumn("_order", order), [id_col], "_order").drop("_order", "run", "batch")

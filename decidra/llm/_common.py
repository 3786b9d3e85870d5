"""What the operators of this subpackage share: staged tables, Arrow text access, hashing."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each Spark context.

    Arrow batches are bounded by BATCH_BYTES too, unless the session has a bound of its own: texts are of any length, and a
    batch is held by the JVM and by Python at once.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))
    sc = spark.sparkContext
    if getattr(sc, "_decidra_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    at = os.path.join(tempfile.mkdtemp(prefix="decidra-"), "decidra_package.zip")
    with zipfile.ZipFile(at, "w") as z:
        for folder, _, names in os.walk(os.path.join(top, "decidra")):
            for name in names:
                if name.endswith(".py"):
                    z.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), top))
    sc.addPyFile(at)
    sc._decidra_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a folder of our own on a local master; an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="decidra-")
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/decidra/{name}-{uuid.uuid4().hex}"


FILE_ROWS = 50_000


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None, most_rows: int | None = None) -> tuple[DataFrame, str]:
    """Writes df to the shared folder and reads it back: lineage ends there and lost executors lose nothing.

    most_rows: a bound of its rows, counted, by which a short table of few columns gets a file for FILE_ROWS rows instead of one
    for each partition.
    """
    spark = df.sparkSession
    if most_rows is not None:
        df = df.coalesce(1 + most_rows // FILE_ROWS)
    path = new_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Deletes staged tables that nothing reads any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


@contextmanager
def batch_rows(spark: SparkSession, n: int) -> Iterator[None]:
    """Arrow batches of at most n rows for the jobs that run inside: wide rows stay within a worker's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(n))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


Batches = Iterator[pa.RecordBatch]


def lean(per_task: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """per_task, after which the worker gives its free memory back: workers go on to other stages, and the JVM's share doesn't shrink."""

    def run(batches: Batches) -> Batches:
        try:
            yield from per_task(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # another C library
                ctypes.CDLL(None).malloc_trim(0)

    return run


BROADCAST_ROWS = 500_000


def without(documents: DataFrame, ids: DataFrame, name: str, key: str = "doc_id") -> DataFrame:
    """documents without the rows whose key is in ids; null keys stay.

    Up to BROADCAST_ROWS ids, counted first, are broadcast; more are joined by shuffling both sides.
    """
    staged, _ = stage(ids.select(key), name)
    few = staged.count() <= BROADCAST_ROWS
    return documents.join(F.broadcast(staged) if few else staged, key, "left_anti").select(*documents.columns)


BLOCKS_BYTES = 64 << 20  # of blocks that are broadcast
SLICE_ROWS = 65_536


def meet_blocks(rows: DataFrame, blocks: DataFrame, by: str, spread: str, n_rows: int) -> DataFrame:
    """Staged blocks of rows, each with every one of the stated `blocks` (staged, numbered in g) that has the same `by`.

    Both are bounded blocks, so this is the stated queries against all rows, and a task sees one of `blocks` after the other. Rows are
    dealt in slices by a hash of `spread`. Up to BLOCKS_BYTES of `blocks`, counted, are broadcast; more are shuffled, once
    for each slice. Only their numbers are listed.
    """
    spark = rows.sparkSession
    content = sum(F.length(f.name) for f in blocks.schema if f.dataType.simpleString() == "binary")
    n, size = blocks.agg(F.count("*"), F.coalesce(F.sum(content), F.lit(0))).collect()[0]
    slices = max(spark.sparkContext.defaultParallelism, -(-n_rows // SLICE_ROWS))
    groups = F.broadcast(blocks.groupBy(by).agg(F.sort_array(F.collect_list("g")).alias("groups")))
    dealt = rows.join(groups, by).withColumn("slice", F.pmod(F.xxhash64(spread), F.lit(slices)).cast("int")).withColumn("g", F.explode("groups")).drop("groups")
    own = blocks.drop(by)
    if size <= BLOCKS_BYTES:
        return dealt.repartition(min(slices * max(1, n), 100_000), "g", "slice").sortWithinPartitions("g").join(F.broadcast(own), "g")
    return dealt.join(own.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))), ["g", "slice"])


HEAVY_ROWS = 20_000
NULL_PARTS = 64


def join_dealt(rows: DataFrame, small: DataFrame, key: str, spread: list[str], how: str = "inner", counted: DataFrame | None = None) -> DataFrame:
    """rows joined by shuffling to `small`, which has one row for each key; keys of many rows are dealt over several tasks.

    The rows of each key are counted in `counted` (`rows` if not given), which should be cheap to read. A key of more than HEAVY_ROWS rows is dealt in
    as many parts as it has times as many, by a hash of the columns `spread`, and its row of `small` goes to each of them. Only such keys are
    broadcast, with their numbers of parts; rows / HEAVY_ROWS bounds them. Rows without a key are dealt too. Nothing is drawn, so a
    lost task is repeated alike.
    """
    parts, salt = free_name("parts", rows, small), free_name("salt", rows, small)
    sizes = (rows if counted is None else counted).groupBy(key).agg(F.ceil(F.count("*") / HEAVY_ROWS).cast("int").alias(parts)).filter(F.col(parts) > 1)
    heavy, _ = stage(sizes.filter(F.col(key).isNotNull()), "heavy-keys")
    n = heavy.count()
    own = F.when(F.col(key).isNull(), NULL_PARTS)
    if not n or n > BROADCAST_ROWS:
        own, dealt, copies = F.coalesce(own, F.lit(1)), rows, small.withColumn(salt, F.lit(0))
    else:
        own, dealt = F.coalesce(own, F.col(parts), F.lit(1)), rows.join(F.broadcast(heavy), key, "left")
        copies = small.join(F.broadcast(heavy), key, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(parts), F.lit(1)) - 1))).drop(parts)
    dealt = dealt.withColumn(salt, F.pmod(F.xxhash64(*spread), own).cast("int")).drop(parts)
    return dealt.join(copies, [key, salt], how).drop(salt)


def join_by_key(rows: DataFrame, small: DataFrame, key: str, spread: list[str], how: str = "inner") -> DataFrame:
    """rows joined to `small`, a staged table with one row for each key: broadcast up to BROADCAST_ROWS of its rows, counted, and else by join_dealt."""
    if small.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(small), key, how)
    return join_dealt(rows, small, key, spread, how)


def free_name(name: str, *tables: DataFrame) -> str:
    """A column name that none of the tables has, whatever the case."""
    taken = {c.lower() for t in tables for c in t.columns}
    while f"_{name}".lower() in taken:
        name += "_"
    return f"_{name}"


def numbered_rows(documents: DataFrame, above: bool, id_col: str = "doc_id") -> tuple[DataFrame, str]:
    """documents with an id of its own for each row, and that column's name, which they don't have yet.

    A row's id is its doc_id. Rows without one, and all but one of those that repeat one, get ids above (else below) all others.
    Those rows are staged under running numbers, and the first of each id is found by a partial minimum, so an id that a third of
    all rows have is no single task.
    """
    name, nth, odd_id, first = (free_name(x, documents) for x in ("row_id", "nth", "odd_id", "first"))
    known = F.col(id_col).cast("long")
    odd, odd_at = stage(documents.groupBy(known.alias(odd_id)).agg(F.count("*").alias(nth)).filter(F.col(odd_id).isNull() | (F.col(nth) > 1)).select(odd_id), "odd-ids")
    n = odd.count()
    if not n:
        drop(documents.sparkSession, odd_at)
        return documents.withColumn(name, known), name
    least, most = documents.agg(F.coalesce(F.min(known), F.lit(0)), F.coalesce(F.max(known), F.lit(0))).collect()[0]
    odd = F.broadcast(odd) if n <= BROADCAST_ROWS else odd
    repeated = documents.join(odd, known == F.col(odd_id), "left_semi").unionByName(documents.filter(known.isNull()))
    rows, _ = stage(repeated.withColumn(nth, F.monotonically_increasing_id()), "odd-rows")
    firsts, _ = stage(rows.filter(known.isNotNull()).groupBy(known.alias(odd_id)).agg(F.min(nth).alias(first)), "first-rows")
    joined = rows.join(F.broadcast(firsts) if n <= BROADCAST_ROWS else firsts, known == F.col(odd_id), "left")
    given = F.when(F.col(nth) == F.col(first), known).otherwise(most + 1 + F.col(nth) if above else least - 1 - F.col(nth))
    named = joined.withColumn(name, given).select(*documents.columns, name)
    plain = documents.filter(known.isNotNull()).join(odd, known == F.col(odd_id), "left_anti").withColumn(name, known)
    return plain.unionByName(named), name


def release(spark: SparkSession) -> None:
    """Lets the context cleaner drop the shuffle files of plans that nothing holds any more."""
    gc.collect()
    spark._jvm.System.gc()


def byte_texts(column: pa.Array) -> list[bytes]:
    """A string column's values as UTF-8 bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit values."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def task_id() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()

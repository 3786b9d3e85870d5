"""A store of immutable shards with size-tiered compaction and versioned manifests.

Arrivals are appended as runs: folders of small Parquet shards that are never changed. Compaction sorts the runs whose
shards are below the target size into tiers by their bytes; a tier that holds `fanout` runs is read and written again
as one run of target-sized shards, without a shuffle. A run whose shards have the target size is left alone, so a row is
written a few times at most.

Every change ends in a manifest, a new table of all live shards, and a commit file with the manifest's name. The commit file is
written aside, whole, and then renamed to its number without overwriting, so a number appears with its content or not at all,
and only one writer gets it. A writer lost before the rename leaves files that no version lists; `vacuum` finds them by listing
the store. Readers keep the version that they opened. The driver holds one row for each run, and of a commit's new runs the
names and sizes of their shards, as it lists them.

Defined results: rows are stored as they are, nulls, empty and long texts and repeated rows included; an arrival
without rows adds no shard; committing on an outdated version raises CommitConflict, leaves the store as it was and deletes
what the writer had written; an empty store reads as no rows; columns of any name are kept, the one that arrivals go by included.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Sequence
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from decidra.llm._common import free_name

MANIFEST = T.StructType([T.StructField("shard", T.StringType()), T.StructField("run", T.StringType()), T.StructField("bytes", T.LongType()), T.StructField("tier", T.IntegerType())])
MANIFEST_ROWS = 1_000_000  # of a manifest's file
GRACE_S = 86_400.0  # for which a writer may still be going to commit its files


class Shard(NamedTuple):
    shard: str  # run folder and file name
    run: str
    bytes: int
    tier: int


class Run(NamedTuple):
    run: str
    bytes: int
    shards: int
    tier: int


class CommitConflict(RuntimeError):
    """Another writer committed the version first."""


class ShardStore:
    def __init__(self, spark: SparkSession, path: str, target_bytes: int = 128 << 20, fanout: int = 4, least_bytes: int = 1 << 20):
        self.spark, self.path = spark, path.rstrip("/")
        self.target_bytes, self.fanout, self.least_bytes = target_bytes, fanout, least_bytes
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self._hadoop.Path("/".join([self.path, *parts]))

    def _listed(self, *parts: str) -> list:
        at = self._path(*parts)
        return list(self._fs.listStatus(at)) if self._fs.exists(at) else []

    # --- manifests

    def version(self) -> int:
        """The current version; 0 before the first commit."""
        return max((int(s.getPath().getName()) for s in self._listed("commits")), default=0)

    def manifest(self, version: int | None = None) -> DataFrame | None:
        """The live shards of a version; None before the first."""
        version = self.version() if version is None else version
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifests/{self._committed(version)[0]}") if version else None

    def _committed(self, version: int) -> tuple[str, int]:
        """The name of a version's manifest and the number of its shards."""
        stream = self._fs.open(self._path("commits", f"{version:010d}"))
        try:
            name, shards = stream.readUTF().split()
        finally:
            stream.close()
        return name, int(shards)

    def runs(self, version: int | None = None) -> list[Run]:
        """The live runs of a version."""
        shards = self.manifest(version)
        if shards is None:
            return []
        each = shards.groupBy("run").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("shards"), F.max("tier").alias("tier"))
        return [Run(*r) for r in each.orderBy("run").collect()]

    def commit(self, based_on: int, new: list[Shard], gone: Sequence[Run] = ()) -> int:
        """Makes version based_on + 1: its predecessor's shards without the runs `gone`, and the new ones. The rename is the one atomic step."""
        name, n = uuid.uuid4().hex, len(new)
        shards, before = self.spark.createDataFrame(new, MANIFEST), self.manifest(based_on)
        if before is not None:
            n += self._committed(based_on)[1] - sum(r.shards for r in gone)
            kept = before.join(F.broadcast(self.spark.createDataFrame([(r.run,) for r in gone], "run string")), "run", "left_anti") if gone else before
            shards = kept.select(*MANIFEST.names).unionByName(shards)
        shards.coalesce(1 + n // MANIFEST_ROWS).write.parquet(f"{self.path}/manifests/{name}")
        aside = self._path("aside", name)
        self._fs.mkdirs(self._path("commits"))
        stream = self._fs.create(aside, False)
        stream.writeUTF(f"{name} {n}")
        stream.close()
        if not self._claimed(aside, based_on + 1):
            self._fs.delete(aside, False)
            for folder in [f"manifests/{name}", *{s.run for s in new}]:
                self._fs.delete(self._path(folder), True)
            raise CommitConflict(f"version {based_on + 1} is there already")
        return based_on + 1

    def _claimed(self, aside, version: int) -> bool:
        """Renames a commit file to its number; False if the number is taken."""
        context = self._hadoop.FileContext.getFileContext(aside.toUri(), self.spark._jsc.hadoopConfiguration())
        plain = self.spark.sparkContext._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)  # that is, without overwriting
        try:
            context.rename(self._fs.makeQualified(aside), self._fs.makeQualified(self._path("commits", f"{version:010d}")), plain)
        except Py4JJavaError as error:
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise
        return True

    # --- runs

    def tier(self, n_bytes: int) -> int:
        return max(0, math.floor(math.log(max(n_bytes, 1) / self.least_bytes, self.fanout)) + 1) if n_bytes > self.least_bytes else 0

    def _shards(self, run: str) -> list[Shard]:
        files = [(s.getPath().getName(), s.getLen()) for s in self._listed(run) if s.getPath().getName().endswith(".parquet")]
        whole = sum(n for _, n in files)
        return [Shard(f"{run}/{name}", run, n, self.tier(whole)) for name, n in files]

    def append(self, rows: DataFrame, arrival: str | None = None) -> int:
        """Adds rows as one run, or with `arrival` as one for each value of that column, and commits them as one version: all or none."""
        based_on, run = self.version(), f"run-{uuid.uuid4().hex}"
        if arrival is None:
            rows.write.parquet(f"{self.path}/{run}")
            return self.commit(based_on, self._shards(run))
        part = free_name("part", rows)  # a copy, as the column that files are dealt by isn't in them
        rows.withColumn(part, F.col(arrival)).write.partitionBy(part).parquet(f"{self.path}/{run}")
        folders = sorted(s.getPath().getName() for s in self._listed(run) if s.isDirectory())
        return self.commit(based_on, [shard for f in folders for shard in self._shards(f"{run}/{f}")])

    def _merge(self, runs: list[Run]) -> list[Shard]:
        run = f"run-{uuid.uuid4().hex}"
        whole = sum(r.bytes for r in runs)
        self._read([r.run for r in runs]).coalesce(max(1, round(whole / self.target_bytes))).write.parquet(f"{self.path}/{run}")
        return self._shards(run)

    def compact(self) -> int:
        """Merges until no tier is full; one commit for each merge. Gives the version then current."""
        while True:
            based_on = self.version()
            tiers: dict[int, list[Run]] = {}
            for run in self.runs(based_on):
                if run.bytes / run.shards < self.target_bytes / 2:  # its shards are small on average
                    tiers.setdefault(run.tier, []).append(run)
            full = next((runs for _, runs in sorted(tiers.items()) if len(runs) >= self.fanout), None)
            if full is None:
                return based_on
            self.commit(based_on, self._merge(full), full)

    def vacuum(self, keep: int = 1, grace_s: float = GRACE_S) -> int:
        """Deletes runs that none of the last `keep` versions lists, whether an older one does or no commit ever did; gives their number.

        What no commit lists is left alone for grace_s, as its writer may be about to commit. The manifests of older versions go too, so these can't be read any
        more, and commit files that never got a number. All manifests are read by one job.
        """
        current = self.version()
        held = {s.getPath().getName() for s in self._listed("manifests")}
        names = {v: name for v in range(1, current + 1) if (name := self._committed(v)[0]) in held}
        last = {names[v] for v in names if v > current - keep}
        listed = self._runs_of(names.values())
        used, known = {r for name in last for r in listed.get(name, ())}, {r for runs in listed.values() for r in runs}
        newest = self.spark._jvm.System.currentTimeMillis() - 1000 * grace_s
        for status in self._listed("aside"):
            if status.getModificationTime() <= newest:
                self._fs.delete(status.getPath(), False)
        gone = 0
        for status in self._listed():
            top = status.getPath().getName()
            if not top.startswith("run-"):
                continue
            folders = [f"{top}/{s.getPath().getName()}" for s in self._listed(top) if s.isDirectory()] or [top]
            for run in folders:
                if run not in used and (run in known or status.getModificationTime() <= newest):
                    self._fs.delete(self._path(run), True)
                    gone += 1
            if folders != [top] and not any(s.isDirectory() for s in self._listed(top)):  # all its arrivals are gone
                self._fs.delete(self._path(top), True)
        for name in set(names.values()) - last:
            self._fs.delete(self._path("manifests", name), True)
        return gone

    def _runs_of(self, names: Iterable[str]) -> dict[str, list[str]]:
        """The runs that each manifest lists."""
        paths = [f"{self.path}/manifests/{name}" for name in names]
        if not paths:
            return {}
        of = F.regexp_extract(F.col("_metadata.file_path"), r"manifests/([0-9a-f]+)/", 1)
        each = self.spark.read.schema(MANIFEST).parquet(*paths).groupBy(of.alias("name")).agg(F.collect_set("run").alias("runs"))
        return {r.name: r.runs for r in each.collect()}

    # --- reading

    def _read(self, runs: list[str]) -> DataFrame:
        return self.spark.read.option("recursiveFileLookup", "true").parquet(*[f"{self.path}/{r}" for r in runs])

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version, with `_shard`, the shard that holds each; None for an empty store."""
        runs = self.runs(version)
        if not runs:
            return None
        at = F.regexp_extract(F.col("_metadata.file_path"), r"(run-[0-9a-f]{32}/.*)$", 1)
        return self._read([r.run for r in runs]).select("*", at.alias("_shard"))


def shard_documents(documents: DataFrame, path: str, target_bytes: int, least_bytes: int, id_col: str = "doc_id") -> tuple[ShardStore, DataFrame | None]:
    """Stores documents as 22 arrivals of three sizes (16 of 1/64, 4 of 1/16 and 2 of 1/4), compacts, and reads back."""
    store = ShardStore(documents.sparkSession, path, target_bytes, 4, least_bytes)
    part = F.pmod(F.xxhash64(id_col), F.lit(64))
    arrival = F.when(part < 16, part).when(part < 32, 16 + F.floor((part - 16) / 4)).otherwise(20 + F.floor((part - 32) / 16)).cast("int")
    name = free_name("arrival", documents)
    store.append(documents.withColumn(name, arrival), name)
    store.compact()
    store.vacuum()
    return store, store.read()


def sharded_rows(documents: DataFrame, path: str, target_bytes: int, least_bytes: int) -> DataFrame:
    """What the current version holds: doc_id, shard, version, n_bytes and text_crc32 of every row's text."""
    store, rows = shard_documents(documents.select("doc_id", "text", "lang", "source", "n_chars"), path, target_bytes, least_bytes)
    if rows is None:
        return documents.sparkSession.createDataFrame([], "doc_id long, shard string, version long, n_bytes long, text_crc32 long")
    text = F.coalesce(F.col("text"), F.lit(""))
    return rows.select("doc_id", F.col("_shard").alias("shard"), F.lit(store.version()).cast("long").alias("version"), F.octet_length(text).cast("long").alias("n_bytes"), F.crc32(text).alias("text_crc32"))

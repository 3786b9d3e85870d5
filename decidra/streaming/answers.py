"""Answers kept in a stream: a repeated request gets the stored answer under its own identity.

Each server keeps the answers of its last `size` keys in a map state. A hit moves its key to the end of the eviction order, a
miss asks the predictor and may push the least recently used key out; an answer that failed isn't kept. Kept answers age
out `ttl_ms` after they were stored. The state is in the query's checkpoint, so a restart goes on with it.

A micro-batch reads and writes a server's state once, `size` keys at most, whatever its number of requests. Requests go to their
server in packs (Arrow streams of the rows that came in together), so Python handles columns up to the loop over keys. A micro-batch's requests of one
server are sorted in memory, as a stream brings them in any order: bound them by the source's trigger limits, or let
`answered_table` bring them in pieces, and deal hot servers by a shard column of your own. Defined results: requests go by `order`, then by
identity; a NULL key is a key; requests of a later micro-batch come later, whatever their order says. With `ttl_ms` a query of trigger availableNow doesn't end, as ageing always asks for another
micro-batch: give it a processing time, or once.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: The state store that map states with ageing need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STORE = "spark.sql.streaming.stateStore.providerClass"
KEEP = 64
#: Requests that a piece of `answered_table` and a file of it have, about; and answers in a pack.
PIECE, FILE, HANDED = 6_000_000, 500_000, 20_000
ASKED = ["server", "request_id", "ord", "key", "payload"]
OUT = "server string, request_id string, ord long, key string, answer string, hit boolean, error string"
NO_KEY = "\x00null"
PACK = "server string, pack binary"
SAME = pa.schema([("server", pa.string()), ("request_id", pa.string()), ("ord", pa.int64()), ("key", pa.string())])


def packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(pack: bytes) -> pa.Table:
    return pa.ipc.open_stream(pack).read_all()


def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each server of a batch, with its requests."""
    for batch in batches:
        if batch.num_rows:
            code = batch["server"].dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
            order = np.argsort(code, kind="stable")
            starts = np.flatnonzero(np.diff(code[order], prepend=-1))
            rows = pa.Table.from_batches([batch]).take(pa.array(order))
            parts = [rows.slice(a, b - a) for a, b in zip(starts, [*starts[1:], len(order)], strict=True)]
            yield pa.record_batch([pa.array([part["server"][0].as_py() for part in parts], pa.string()), pa.array([packed(part) for part in parts], pa.binary())], ["server", "pack"])


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for pack in batch["pack"]:
            yield from unpacked(pack.as_py()).to_batches()


class AnswerCache(StatefulProcessor):
    """kept: key -> answer, which ages; order: key -> turn of its last use, which doesn't; turns: how many requests a server has had."""

    def __init__(self, predict: Callable[[str], str], size: int, ttl_ms: int | None):
        self.predict, self.size, self.ttl_ms = predict, size, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        key = StructType([StructField("key", StringType())])
        self.kept = handle.getMapState("kept", key, StructType([StructField("answer", StringType())]), self.ttl_ms)
        self.order = handle.getMapState("order", key, StructType([StructField("used", LongType())]))
        self.turns = handle.getValueState("turns", StructType([StructField("n", LongType())]))

    def _forget(self, name: str) -> None:
        self.order.removeKey((name,))
        self.kept.removeKey((name,))

    def _held(self) -> OrderedDict[str, str]:
        """What the state keeps, least recently used first."""
        kept = {k[0]: v[0] for k, v in self.kept.iterator()}
        used = {k[0]: v[0] for k, v in self.order.iterator()}
        for name in used.keys() - kept.keys():  # aged out
            self._forget(name)
        return OrderedDict((name, kept[name]) for name in sorted(used.keys() & kept.keys(), key=used.get))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pa.concat_tables(unpacked(pack) for part in rows for pack in part["pack"])
        wide = [(f.name, pa.large_string() if pa.types.is_string(f.type) else f.type) for f in batch.schema]  # a column may pass 2 GB
        batch = batch.cast(pa.schema(wide)).sort_by([("ord", "ascending"), ("request_id", "ascending")])
        turn = self.turns.get()[0] if self.turns.exists() else 0
        held = self._held()
        before, used, stored = set(held), {}, {}  # turns of last uses and answers stored, both since the batch began
        for start in range(0, len(batch), HANDED):
            part = batch.slice(start, HANDED)
            given, hits, errors = [], [], []
            for asked, payload in zip(part["key"].to_numpy(), part["payload"].to_numpy(), strict=True):
                turn += 1
                name = NO_KEY if asked is None else asked
                hit, error = name in held, None
                if hit:
                    answer = held[name]
                    held.move_to_end(name)
                else:
                    try:
                        answer = held[name] = stored[name] = self.predict(payload)
                    except Exception as failed:  # a failing request must not end the stream
                        answer, error = None, f"{type(failed).__name__}: {failed}"
                if error is None:
                    used[name] = turn
                    if len(held) > self.size:
                        held.popitem(last=False)
                given.append(answer)
                hits.append(hit)
                errors.append(error)
            out = part.select(SAME.names).cast(SAME).append_column("answer", pa.array(given, pa.string())).append_column("hit", pa.array(hits, pa.bool_())).append_column("error", pa.array(errors, pa.string()))
            yield pd.DataFrame({"server": [key[0]], "pack": [packed(out)]})
        for name in before - held.keys():
            self._forget(name)
        for name in held:
            if name in stored:
                self.kept.updateValue((name,), (stored[name],))
            if name in used:
                self.order.updateValue((name,), (used[name],))
        self.turns.update((turn,))

    def close(self) -> None:
        pass


@contextmanager
def map_states(spark: SparkSession) -> Iterator[None]:
    """A store that keeps map states, for the queries that start and end inside."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(STORE, before)


def answered(requests: DataFrame, predict: Callable[[str], str], size: int = KEEP, ttl_ms: int | None = None) -> DataFrame:
    """OUT for a stream of requests (server, request_id, ord, key, payload); predict gives a payload's answer."""
    asked = requests.select(F.col("server").cast("string"), F.col("request_id").cast("string"), F.col("ord").cast("long"), F.col("key").cast("string"), "payload")
    return (
        asked.mapInArrow(packs, PACK).groupBy("server")
        .transformWithStateInPandas(AnswerCache(predict, size, ttl_ms), PACK, "Append", "None" if ttl_ms is None else "ProcessingTime").mapInArrow(rows_of, OUT)
    )


def answered_table(requests: DataFrame, predict: Callable[[str], str], at: str, size: int = KEEP, piece: int = PIECE) -> DataFrame:
    """OUT for a table of requests that is kept in the shared folder `at`: about `piece` of them at a time, in order, arrive in the
    stream's source, and each run of the stream goes on with the state of the one before, so no task sorts more than a piece."""
    spark, requests = requests.sparkSession, requests.select(*ASKED)
    n, each = requests.count(), min(piece, FILE)
    if n > piece:
        files = requests.repartitionByRange(-(-n // each), F.asc_nulls_last("ord"), F.asc_nulls_last("request_id"))
        cut = files.withColumn("piece", F.floor(F.spark_partition_id() / (piece // each)))
        cut.write.partitionBy("piece").parquet(f"{at}/pieces")
        found = spark.read.parquet(f"{at}/pieces").select("piece").distinct().orderBy("piece").collect()  # a number for each piece
        parts = (spark.read.schema(requests.schema).parquet(f"{at}/pieces/piece={row.piece}") for row in found)
    else:
        parts = [requests]
    with map_states(spark):
        for part in parts:
            part.write.mode("append").parquet(f"{at}/requests")
            made = answered(spark.readStream.schema(requests.schema).parquet(f"{at}/requests"), predict, size)
            made.writeStream.format("parquet").option("path", f"{at}/answers").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(OUT).parquet(f"{at}/answers")

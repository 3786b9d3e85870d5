"""Token-ID output in a static range asymmetric numeral system.

The stream holds the ids of all documents in ascending doc_id order. It is cut into independent blocks of whole
documents. All blocks share one frequency table, taken from all ids and scaled to 2**18. A block's tokens go round its
interleaved lanes (token t to lane t mod lanes), each with a 64-bit state and 32-bit renormalisation, so one step of all
lanes is a few vector operations. Every SEGMENT_STEPS steps a checkpoint keeps all states and the place in the block's
words, with a CRC-32 of the segment's ids, so segments can be decoded apart from each other and checked.

Container: `<path>/table` (token, freq) and `<path>/blocks`, Parquet tables any Spark file system can hold. A block row:
start (ids of all blocks before it), doc_ids, lengths, lanes, words, states, word_starts, segment_crcs. Blocks are
rows of the one stream, ordered by start.

Defined results: a null or empty text has only its end id, repeated doc_ids follow one another in the order of their texts'
hashes, null doc_ids come first, an empty table gives an empty stream, and columns other than the two named are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decidra.llm._common import U64, drop, lean, new_path, stage, task_id
from decidra.llm._tokens import encoder

SCALE_BITS, LOW_BITS = 18, 31
BLOCK_TOKENS = 1 << 18
MAX_LANES, SEGMENT_STEPS = 1024, 128


class Table(NamedTuple):
    """freq and start by symbol; symbol by slot. The frequencies add up to 2**bits, and no seen symbol has 0."""

    bits: int
    freq: np.ndarray
    start: np.ndarray
    symbol: np.ndarray


def scaled(counts: np.ndarray, bits: int = SCALE_BITS) -> np.ndarray:
    """Counts scaled to a sum of 2**bits, with 1 at least for what occurs; largest remainders get what is left."""
    total, size = int(counts.sum()), 1 << bits
    seen = np.flatnonzero(counts)
    if len(seen) > size:
        raise ValueError(f"{len(seen)} symbols don't fit a table of {size} slots")
    freq = np.zeros(len(counts), np.int64)
    if not total:
        return freq
    exact = counts[seen] * (size / total)
    share = np.maximum(1, np.floor(exact)).astype(np.int64)
    left = size - int(share.sum())
    if left > 0:
        order = np.argsort(-(exact - share), kind="stable")
        share += left // len(seen)
        share[order[: left % len(seen)]] += 1
    while left < 0:  # the floor of 1 took too many: the most frequent give back
        order = np.argsort(-share, kind="stable")
        give = order[: min(-left, int((share > 1).sum()))]
        share[give] -= 1
        left += len(give)
    freq[seen] = share
    return freq


def table_of(freq: np.ndarray, bits: int = SCALE_BITS) -> Table:
    start = np.concatenate([[0], np.cumsum(freq)[:-1]])
    symbol = np.repeat(np.arange(len(freq)), freq).astype(np.uint32)
    return Table(bits, freq.astype(U64), start.astype(U64), symbol)


def lanes_for(n: int) -> int:
    return 1 << max(0, min(MAX_LANES, n // 256).bit_length() - 1)


def encode_block(ids: np.ndarray, table: Table) -> dict:
    """words, states (one row of lanes for each segment), word_starts and segment_crcs of a run of ids."""
    n, lanes = len(ids), lanes_for(len(ids))
    bits, top = U64(table.bits), U64(LOW_BITS - table.bits + 32)
    steps = -(-n // lanes)
    freq, start = table.freq[ids], table.start[ids]
    if n and not freq.all():
        raise ValueError("an id is not in the frequency table")
    x = np.full(lanes, 1 << LOW_BITS, U64)
    out: list[np.ndarray] = []
    states, marks, emitted = [], [], 0
    for step in range(steps - 1, -1, -1):
        a, b = step * lanes, min(n, (step + 1) * lanes)
        f, s, y = freq[a:b], start[a:b], x[: b - a]
        full = y >= (f << top)
        words = y[full]
        if len(words):
            out.append((words & U64(0xFFFFFFFF)).astype("<u4"))
            emitted += len(words)
            y[full] = words >> U64(32)
        q = y // f
        x[: b - a] = (q << bits) + (y - q * f) + s
        if step % SEGMENT_STEPS == 0:
            states.append(x.copy())
            marks.append(emitted)
    span = SEGMENT_STEPS * lanes
    return {
        "lanes": lanes,
        "words": b"".join(w.tobytes() for w in reversed(out)),
        "states": b"".join(s.astype("<u8").tobytes() for s in reversed(states)),
        "word_starts": [emitted - m for m in reversed(marks)],
        "segment_crcs": [zlib.crc32(ids[a : a + span].astype("<u4").tobytes()) for a in range(0, n, span)],
    }


def decode_segment(segment: int, n: int, block: dict, table: Table) -> np.ndarray:
    """The ids of one segment of a block of n ids, from its checkpoint alone."""
    lanes, span = block["lanes"], SEGMENT_STEPS * block["lanes"]
    first, last = segment * span, min(n, (segment + 1) * span)
    words = np.frombuffer(block["words"], "<u4")
    at = block["word_starts"][segment]
    x = np.frombuffer(block["states"], "<u8")[segment * lanes : (segment + 1) * lanes].astype(U64)
    bits, mask, low = U64(table.bits), U64((1 << table.bits) - 1), U64(1 << LOW_BITS)
    ids = np.empty(last - first, np.uint32)
    for a in range(0, last - first, lanes):
        b = min(last - first, a + lanes)
        y = x[: b - a]
        slot = y & mask
        s = table.symbol[slot]
        ids[a:b] = s
        y = table.freq[s] * (y >> bits) + slot - table.start[s]
        short = np.flatnonzero(y < low)
        if len(short):
            y[short] = (y[short] << U64(32)) | words[at : at + len(short)]
            at += len(short)
        x[: b - a] = y
    if zlib.crc32(ids.astype("<u4").tobytes()) != block["segment_crcs"][segment]:
        raise ValueError(f"segment {segment} fails its checksum")
    return ids


def decode_block(n: int, block: dict, table: Table) -> np.ndarray:
    parts = [decode_segment(k, n, block, table) for k in range(len(block["segment_crcs"]))]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


# --- Spark ------------------------------------------------------------------------------------------------------------


def _tokenised(documents: DataFrame, tokenizer_path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Blocks of plain ids of documents in doc_id order; start_in_part counts the ids before a block in its partition."""

    def per_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part, begun = encoder(tokenizer_path), task_id(), 0
        docs: list[int | None] = []
        ids: list[bytes] = []

        def block() -> pa.RecordBatch:
            lengths = [len(x) // 4 for x in ids]
            flat = np.frombuffer(b"".join(ids), "<u4")
            values = [[part], [begun], [docs], [lengths], [(flat.astype("<u2") if not len(flat) or flat.max() < 65536 else flat).tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=["part", "start_in_part", "doc_ids", "lengths", "ids"])

        kinds = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        held = 0
        for batch in batches:
            for doc, encoded in zip(batch.column(0).to_pylist(), tokens.texts(batch.column(1), end_id), strict=True):
                docs.append(doc)
                ids.append(encoded)
                held += len(ids[-1]) // 4
                if held >= BLOCK_TOKENS:
                    yield block()
                    begun, held, docs, ids = begun + held, 0, [], []
        if docs:
            yield block()

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("tie"), F.monotonically_increasing_id().alias("row"))
    # an id or a row that repeats is dealt over several ranges
    ordered = rows.repartitionByRange("doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return ordered.mapInArrow(lean(per_part), "part int, start_in_part long, doc_ids array<long>, lengths array<long>, ids binary")


def _plain(ids: bytes, lengths: list[int]) -> np.ndarray:
    return np.frombuffer(ids, "<u2" if len(ids) == 2 * sum(lengths) else "<u4")


def write_tokens(documents: DataFrame, tokenizer_path: str, path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every text, appends end_id to each document and writes the stream to path."""
    spark = documents.sparkSession
    plain, plain_at = stage(_tokenised(documents, tokenizer_path, end_id, id_col, text_col), "plain-ids")

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for ids, lengths in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.bincount(_plain(ids, lengths))
                if len(part) > len(total):
                    part[: len(total)] += total
                    total = part
                else:
                    total[: len(part)] += part
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["token", "n"])

    # both results are bounded: by the vocabulary, and by the number of partitions
    counted = plain.select("ids", "lengths").mapInArrow(lean(histogram), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    parts = plain.groupBy("part").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).orderBy("part").collect()
    counts = np.zeros(max([r.token for r in counted], default=0) + 1, np.int64)
    for r in counted:
        counts[r.token] = r.n
    freq = scaled(counts)
    base, before = {}, 0
    for r in parts:
        base[r.part] = before
        before += r.n

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = table_of(freq)
        names = ["lanes", "words", "states", "word_starts", "segment_crcs"]
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        for batch in batches:
            for row in batch.to_pylist():
                block = encode_block(_plain(row["ids"], row["lengths"]), table)
                values = [[base[row["part"]] + row["start_in_part"]], [row["doc_ids"]], [row["lengths"]], *([block[k]] for k in names)]
                types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), *kinds]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, types, strict=True)], names=["start", "doc_ids", "lengths", *names])

    schema = "start long, doc_ids array<long>, lengths array<long>, lanes int, words binary, states binary, word_starts array<long>, segment_crcs array<long>"
    plain.mapInArrow(lean(encode), schema).write.option("compression", "none").parquet(f"{path}/blocks")
    spark.createDataFrame([(i, int(f)) for i, f in enumerate(freq)], "token int, freq int").coalesce(1).write.parquet(f"{path}/table")
    drop(spark, plain_at)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """From a written stream: doc_id, start, n_tokens, ids_crc32 and, if wanted, ids (little-endian unsigned 32-bit)."""
    freq = np.array([r.freq for r in spark.read.parquet(f"{path}/table").orderBy("token").collect()], np.int64)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = table_of(freq)
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.array(row["lengths"], np.int64)
                raw = decode_block(int(lengths.sum()), row, table).astype("<u4").tobytes()
                ends = np.cumsum(lengths)
                spans = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(row["start"] + ends - lengths), pa.array(lengths), pa.array([zlib.crc32(s) for s in spans], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array(spans, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return spark.read.parquet(f"{path}/blocks").mapInArrow(lean(decode), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def token_stream(documents: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Writes the stream to the shared folder and gives what is read back from it."""
    path = new_path(documents.sparkSession, "token-stream")
    write_tokens(documents, tokenizer_path, path, end_id)
    return read_tokens(documents.sparkSession, path)

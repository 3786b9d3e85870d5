"""Bounded-space online best-fit packing of token sequences.

Each task packs the documents of its own input split, in the order in which they come, so nothing is shuffled and no
group can be hot. Small splits are put together first, as each leaves bins that aren't full. A packer holds a fixed number of open bins. Their free spaces are the set bits of one integer: the
lowest set bit at or above an item's length is the tightest bin that takes it. When a new bin is needed and all are
open, the fullest closes first; a bin without free space closes at once.

Defined results: a null or empty text is its end id alone, a document longer than a sequence is cut into full pieces
behind a first piece that holds the remainder, an empty table gives no rows, repeated rows are packed as often as they
come, and columns other than the two named are ignored. Sequence numbers are the task's number times 2**40 plus a count.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decidra.llm._common import lean, task_id
from decidra.llm._tokens import encoder

OPEN_BINS = 1024
SPLIT_ROWS = 5_000  # of a split, on average, from which on splits are packed as they come


class BestFit:
    """Online best-fit over at most `open_bins` open bins of `size` units; place(n) gives (bin, offset)."""

    def __init__(self, size: int, open_bins: int, first_bin: int = 0):
        self.size, self.open_bins, self.next_bin = size, open_bins, first_bin
        self.free_bits = 0
        self.bins: dict[int, list[int]] = {}  # free space -> bins that have it
        self.n_open = 0
        self.closed = 0

    def _take(self, free: int) -> int:
        held = self.bins[free]
        number = held.pop()
        if not held:
            del self.bins[free]
            self.free_bits &= ~(1 << free)
        self.n_open -= 1
        return number

    def _put(self, number: int, free: int) -> None:
        if not free:
            self.closed += 1
            return
        self.bins.setdefault(free, []).append(number)
        self.free_bits |= 1 << free
        self.n_open += 1

    def place(self, n: int) -> tuple[int, int]:
        if not 0 < n <= self.size:
            raise ValueError(f"an item of {n} doesn't fit a bin of {self.size}")
        fits = self.free_bits >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            if self.n_open >= self.open_bins and n < self.size:
                fullest = (self.free_bits & -self.free_bits).bit_length() - 1
                self._take(fullest)
                self.closed += 1
            number, free = self.next_bin, self.size
            self.next_bin += 1
        self._put(number, free - n)
        return number, self.size - free


def pack_documents(
    documents: DataFrame, tokenizer_path: str, end_id: int = 0, size: int = 2048, open_bins: int = OPEN_BINS, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, split_rows: int = SPLIT_ROWS
) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and the ids if wanted."""

    def per_split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, packer = encoder(tokenizer_path), BestFit(size, open_bins, task_id() << 40)
        for batch in batches:
            out: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), tokens.texts(batch.column(1), end_id), strict=True):
                n = len(ids) // 4
                start, piece = 0, 0
                while start < n:
                    length = (n - start) % size or size
                    part = ids[4 * start : 4 * (start + length)]
                    number, offset = packer.place(length)
                    out.append((doc, piece, start, length, zlib.crc32(part), number, offset, part if with_ids else None))
                    start, piece = start + length, piece + 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * with_ids
            columns = list(zip(*out, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names=names)

    rows = documents.select(F.col(id_col).cast("long"), F.col(text_col))
    splits = max(1, rows.count() // split_rows)
    if rows.rdd.getNumPartitions() > splits:
        rows = rows.coalesce(splits)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids binary" * with_ids
    return rows.mapInArrow(lean(per_split), schema)

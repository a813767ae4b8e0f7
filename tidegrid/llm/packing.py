"""Online best-fit packing of token sequences in bounded space.

Documents are cut into pieces of at most ``capacity`` tokens in one pass, and every piece gets the number of its row. Pieces are
dealt into groups by a hash of that number, so any number of tasks packs side by side and equal rows spread like all others. In
a group each piece is placed as it comes: into the open bin with the least sufficient space, found in a bitset keyed by free space
as the lowest set bit at or above the piece's length. Only a fixed number of bins is open; when one more would be, the fullest
closes. A task holds the open bins of one group and nothing else.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.tables import batch_of, only, stored
from tidegrid.llm.tokens import default_path, ids_of

CAPACITY = 2048
OPEN_BINS = 64
GROUP_PIECES = 32768
END_ID = 0

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
NUMBERED = PIECES + ", row long"
PACKED = PIECES + ", sequence_id long, `offset` long"


class OpenBins:
    """At most ``most`` open bins, by free space: the numbers of the bins, and a bit for every space that some bin has."""

    def __init__(self, capacity: int = CAPACITY, most: int = OPEN_BINS):
        self.capacity, self.most = capacity, most
        self.free_bits = 0
        self.with_space: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.opened = self.open = self.closed = 0

    def _take(self, space: int, at: int) -> int:
        chosen = self.with_space[space].pop(at)
        self.open -= 1
        if not self.with_space[space]:
            self.free_bits ^= 1 << space
        return chosen

    def place(self, length: int) -> tuple[int, int]:
        """Bin and offset of the next piece."""
        fitting = self.free_bits >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            chosen = self._take(space, -1)
        else:
            space, chosen = self.capacity, self.opened
            self.opened += 1
        left = space - length
        if left:
            self.with_space[left].append(chosen)
            self.free_bits |= 1 << left
            self.open += 1
            if self.open > self.most:
                self._take((self.free_bits & -self.free_bits).bit_length() - 1, 0)
                self.closed += 1
        return chosen, self.capacity - space


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each piece, taken in the given order; lengths are from 1 to ``capacity``."""
    bins = OpenBins(capacity, open_bins)
    placed = [bins.place(length) for length in lengths.tolist()]
    return np.array([b for b, _ in placed], dtype=np.int64), np.array([o for _, o in placed], dtype=np.int64)


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``total`` tokens: all full but possibly the first."""
    first = (total - 1) % capacity + 1
    return [(0, first)] + [(start, capacity) for start in range(first, total, capacity)]


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.append(ids_of(text.as_py() or "", path), np.uint32(END_ID)).astype("<u4")
                for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                    rows.append((doc, piece, start, length, zlib.crc32(ids[start : start + length].tobytes())))
            doc, piece, start, length, crc = zip(*rows, strict=True) if rows else ([], [], [], [], [])
            yield batch_of(
                doc_id=pa.array(doc, pa.int64()),
                piece=pa.array(piece, pa.int32()),
                start=pa.array(start, pa.int64()),
                length=pa.array(length, pa.int64()),
                ids_crc32=pa.array(crc, pa.int64()),
                row=pa.array(range(number, number + len(doc)), pa.int64()),
            )
            number += len(doc)

    return run


def _pack(groups: int, capacity: int, open_bins: int):
    """Rows sorted by group: each piece is placed as it comes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, bins = None, None
        for batch in batches:
            sequence, offset = [], []
            for own, length in zip(batch.column("bucket").to_pylist(), batch.column("length").to_pylist(), strict=True):
                if own != group:
                    group, bins = own, OpenBins(capacity, open_bins)
                place, at = bins.place(length)
                sequence.append(place * groups + own)
                offset.append(at)
            kept = {name: batch.column(name) for name in ("doc_id", "piece", "start", "length", "ids_crc32")}
            yield batch_of(**kept, sequence_id=pa.array(sequence, pa.int64()), offset=pa.array(offset, pa.int64()))

    return run


def pack_documents(
    documents: DataFrame,
    path: str | None = None,
    capacity: int = CAPACITY,
    open_bins: int = OPEN_BINS,
    group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """``doc_id, text`` -> one row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    ``path`` is the tokenizer file. A null or empty text is the end token alone, a text of any length is cut whole. Rows that repeat
    (also with one id, or without an id) are packed once each. An empty table gives an empty table; other columns are ignored.
    """
    if capacity < 1 or open_bins < 1 or group_pieces < 1:
        raise ValueError("capacity, open_bins and group_pieces are at least 1")
    plain = only(documents, ["doc_id", "text"]).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = stored(plain.mapInArrow(_pieces(path or default_path(), capacity), NUMBERED), "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(groups)))
    ordered = dealt.repartition(groups, "bucket").sortWithinPartitions("bucket", "row")
    return ordered.mapInArrow(_pack(groups, capacity, open_bins), PACKED)

"""Packing documents into sequences by bounded-space online best fit.

A document is its token ids and one end id. Only one longer than a sequence is cut, into whole sequences; its first
piece takes the remainder. Pieces are dealt to tasks by hash, about `task_rows` a task, and arrive there in falling
order of length (a task of more than 2^20 rows: part by part of so many). Each task keeps at most `open_bins` open bins; a bitset keyed by free space gives the bin with the least
space that is enough. A full bin closes; when a bin must be opened beyond the limit, the fullest closes first, which happens while the
long pieces arrive: of those, each opens a bin. What a task holds is the open bins and at most one part's rows, numbers without
texts, whatever the input; a piece's place is final when it arrives.

Defined cases: very long texts are cut whole, their pieces one after the other; null text counts as empty, so the document is its end id; repeated rows are packed each; null doc_id
is packed like any other; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import SLICE, encoder
from .common import slices, small_batches, text_buffers, written

SEQUENCE, END_ID, OPEN_BINS, TASK_ROWS, MOST_TASKS, MOST_SORTED = 2048, 0, 1536, 8192, 8192, 1 << 20


class BestFit:
    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.most = capacity, open_bins
        self.free: dict[int, list[tuple[int, int]]] = defaultdict(list)  # bins (number, filled) by free space
        self.bits, self.open, self.made = 0, 0, 0

    def place(self, length: int) -> tuple[int, int]:
        """Number of the bin and the place in it for a piece of 1 to capacity."""
        fitting = self.bits >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            number, filled = self._take(space)
        else:
            if self.open >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            number, filled, space = self.made, 0, self.capacity
            self.made += 1
        if space > length:
            self.free[space - length].append((number, filled + length))
            self.bits |= 1 << (space - length)
            self.open += 1
        return number, filled

    def _take(self, space: int) -> tuple[int, int]:
        bins = self.free[space]
        found = bins.pop()
        if not bins:
            self.bits &= ~(1 << space)
        self.open -= 1
        return found


def pieces(docs: DataFrame, tokenizer: str, capacity: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of each row."""

    def run(batches):
        encode = encoder(tokenizer).encode
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for a, b in slices(offsets, SLICE):
                ids, first = encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                row, piece, start, length, crc = [], [], [], [], []
                for r in range(b - a):
                    own = np.append(ids[first[r] : first[r + 1]], END_ID).astype("<u4")
                    head = len(own) % capacity or capacity
                    cuts = [0, *range(head, len(own) + 1, capacity)]
                    for k in range(len(cuts) - 1):
                        row.append(a + r)
                        piece.append(k)
                        start.append(cuts[k])
                        length.append(cuts[k + 1] - cuts[k])
                        crc.append(zlib.crc32(own[cuts[k] : cuts[k + 1]].tobytes()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def falling(batches: Iterable[pa.RecordBatch], most: int = MOST_SORTED) -> Iterator[pa.RecordBatch]:
    """All rows by falling length; from about `most` rows on, in parts of so many. Sorted here and not by Spark, whose sort takes a page of many MB of the executor for each task's few rows."""
    own: list[pa.RecordBatch] = []

    def part():
        rows = pa.Table.from_batches(own)
        keys = [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")]
        if pa.types.is_nested(rows.schema.field("doc_id").type):  # Arrow has no order of such ids
            del keys[1]
        return rows.take(pc.sort_indices(rows, keys)).to_batches(TASK_ROWS)

    for batch in batches:
        own.append(batch)
        if sum(b.num_rows for b in own) >= most:
            yield from part()
            own = []
    if own:
        yield from part()


def packed(cut: DataFrame, capacity: int = SEQUENCE, open_bins: int = OPEN_BINS, task_rows: int = TASK_ROWS) -> DataFrame:
    """cut plus sequence_id and offset."""
    with small_batches(cut.sparkSession):
        cut = written(cut, "pieces")
    tasks = min(max(1, -(-cut.count() // task_rows)), MOST_TASKS)

    def run(batches):
        bins, base = BestFit(capacity, open_bins), TaskContext.get().partitionId() << 40
        for batch in falling(batches):
            placed = [bins.place(n) for n in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([base + n for n, _ in placed], pa.int64()), pa.array([at for _, at in placed], pa.int64())], [*batch.schema.names, "sequence_id", "offset"])

    dealt = cut.repartition(tasks, F.xxhash64("doc_id", "piece", "ids_crc32"))
    kind = cut.schema["doc_id"].dataType.simpleString()
    return dealt.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")

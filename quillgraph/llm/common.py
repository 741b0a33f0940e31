"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

from ..shared import shared_folder, written

__all__ = ["column", "shared_folder", "slices", "small_batches", "text_buffers", "written"]

#: Bytes of an Arrow batch to Python, and rows that Parquet's reader decodes at once; texts at Spark's defaults (64 MB, 4096) cost each task many times that.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": 1 << 20, "spark.sql.parquet.columnarReaderBatchSize": 256}


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Within it, what runs takes texts in batches of BATCHES at most, smaller ones where the session has them; the rows are the same. Afterwards the session's settings are as before."""
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    before = dict(spark.conf.getAll)
    for key, most in BATCHES.items():
        spark.conf.set(key, min(most, own) if (own := size(spark.conf.get(key))) > 0 else most)
    try:
        yield
    finally:
        for key in BATCHES:
            if key in before:
                spark.conf.set(key, before[key])
            else:
                spark.conf.unset(key)


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets (rows + 1) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes and 65536 rows; a longer row is alone in its range."""
    rows, first = len(offsets) - 1, 0
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), first + (1 << 16), rows)
        yield first, last
        first = last


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))

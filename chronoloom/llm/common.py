"""Reading tables, shared scratch tables and Arrow plumbing of the text operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from chronoloom.scratch import materialise, ship_package


def bounded_batches(spark: SparkSession) -> None:
    """Before any operator that runs Python on workers: they find this package, and Arrow
    batches, which hold whole texts, have fewer rows, which bounds a worker's memory."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Writes a table to the folder that driver and executors share and reads it back, which
#: cuts the lineage and survives lost executors.
stash = materialise


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 512 << 10) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most ``limit`` bytes of ``column`` (one row at
    least), so that per-byte arrays stay small however long the texts are."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        ends = np.cumsum(np.asarray(sizes, dtype=np.int64))
        i = 0
        while i < len(ends):
            base = ends[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(i, j - i)
            i = j


def filled(batch: pa.RecordBatch, column: str) -> pa.RecordBatch:
    """Null texts as empty ones."""
    at = batch.schema.get_field_index(column)
    return batch.set_column(at, column, pc.fill_null(batch.column(at), ""))


def chunks(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, column):
        yield filled(part, column)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows one after the other, and len + 1 offsets into them."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]

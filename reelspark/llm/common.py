"""Scratch tables, and texts of Arrow batches as NumPy bytes."""
from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import configure, work_dir

#: Bytes of text that one vectorised step works on; a single longer text is still taken whole
SLAB_BYTES = 1 << 20


#: Rows and bytes of one Arrow batch: a Python worker holds a batch and what it makes of it
BATCH_ROWS, BATCH_BYTES = 1_000, 8 << 20


def tune(spark: SparkSession) -> None:
    """The library's settings, with Arrow batches small enough for texts."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


class Scratch:
    """A folder of its own below the shared checkpoint folder, for tables that several steps read."""

    def __init__(self, spark: SparkSession, name: str):
        tune(spark)
        self.spark = spark
        self.folder = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._step = 0

    def keep(self, df: DataFrame, name: str = "table", compression: str | None = None) -> DataFrame:
        """Write ``df`` and read it back: its lineage ends in files that every executor can reach."""
        self._step += 1
        path = f"{self.folder}/{self._step:03d}-{name}"
        df.write.parquet(path, compression=compression)
        return self.spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, *, rows: int = 250_000, values: str | None = None) -> DataFrame:
    """A written table, marked for broadcast only if it has been counted to hold at most ``rows`` rows and eight times as many list items.

    Beyond that Spark shuffles both sides.
    """
    items = F.sum(F.size(values)) if values else F.lit(0)
    counted, listed = df.agg(F.count(F.lit(1)), items).first()
    return F.broadcast(df) if counted <= rows and (listed or 0) <= 8 * rows else df


def quoted(name: str):
    """A column whose name may hold dots."""
    return F.col(f"`{name}`")


def plainly(docs: DataFrame, *columns: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with its columns named by place, so that no name clashes with an operator's own, and what the given columns are now called."""
    names = [f"column_{place}" for place in range(len(docs.columns))]
    return docs.toDF(*names), [names[docs.columns.index(column)] for column in columns]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and the offsets of its values, nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, places, data = column.buffers()
    if len(column) == 0 or places is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(places, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0]:offsets[-1]], offsets - offsets[0]


def slabs(offsets: np.ndarray, limit: int = SLAB_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of texts of together at most ``limit`` bytes, or of one text."""
    begin, count = 0, len(offsets) - 1
    while begin < count:
        end = int(np.searchsorted(offsets, offsets[begin] + limit, "right")) - 1
        end = min(count, max(end, begin + 1))
        yield begin, end
        begin = end


def ascii_lower() -> np.ndarray:
    """A table that maps the bytes A-Z to a-z and every other byte to itself."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table

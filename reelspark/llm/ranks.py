"""Places of rows within their key, and runs of sorted rows, without a task that holds a whole key."""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import Scratch

#: A row's place in its range is in the low bits of Spark's row number, the range's partition in those above
PLACE_BITS = 33


def ranked(scratch: Scratch, rows: DataFrame, key: str, order: list, name: str = "ranked") -> DataFrame:
    """``rows`` with ``position`` (from 0, in the given order within ``key``, nulls being a key) and ``total``, the rows of the key.

    All rows are dealt to ranges of key and order, whatever the keys' sizes, and written once. A row's position is its place in
    its range plus the rows its key has in earlier ranges: one number for each key and range.
    """
    keyed = [F.col(key).asc_nulls_first(), *order]
    laid = rows.repartitionByRange(*keyed).sortWithinPartitions(*keyed)
    number = F.monotonically_increasing_id()
    laid = scratch.keep(laid.select(
        "*", F.shiftright(number, PLACE_BITS).alias("__range"), number.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).alias("__place")), name)
    held = laid.groupBy(F.col(key).alias("__key"), F.col("__range").alias("__of")).agg(
        F.min("__place").alias("__first"), F.count(F.lit(1)).alias("__rows"))
    ranges = Window.partitionBy("__key").orderBy("__of")
    before = F.coalesce(F.sum("__rows").over(ranges.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = held.select(
        "__key", "__of", (before - F.col("__first")).alias("__shift"),
        F.sum("__rows").over(ranges.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    joined = laid.join(held, (F.col("__range") == F.col("__of")) & F.col(key).eqNullSafe(F.col("__key")))
    return joined.withColumn("position", F.col("__place") + F.col("__shift")).drop("__range", "__place", "__key", "__of", "__shift")


def runs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Consecutive rows whose first ``width`` columns are equal: those values, and the rest of each row."""
    held_key, held = None, []
    for batch in batches:
        for row in zip(*[column.to_pylist() for column in batch.columns]):
            if row[:width] != held_key:
                if held:
                    yield held_key, held
                held_key, held = row[:width], []
            held.append(row[width:])
    if held:
        yield held_key, held


def batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 1_000) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values, field.type) for values, field in zip(zip(*rows), schema)], schema=schema)

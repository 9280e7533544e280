"""The end of a stream: a marker lets the watermark pass what is still open.

Append mode emits a window, a session or a waiting row once the watermark has passed it, so a stream that has ended keeps its last
ones for ever. A closable stream also reads a folder of markers; a marker written there after the last rows moves the watermark
past everything, and what was open comes out as complete. Markers reach no result.
"""
from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

MARKER = "__closing"
#: Before any event, and after any event and wait: what an opening and a closing marker say
FIRST, LAST = dt.datetime(1970, 1, 1), dt.datetime(9000, 1, 1)


def closable(stream: DataFrame, ts: str, folder: str) -> DataFrame:
    """The stream, and with it the markers of ``folder``, which is made if it is not there."""
    spark = stream.sparkSession
    schema = f"`{ts}` timestamp"
    mark(spark, folder, ts, FIRST)
    markers = spark.readStream.schema(schema).parquet(folder)
    return stream.withColumn(MARKER, F.lit(False)).unionByName(markers.withColumn(MARKER, F.lit(True)), allowMissingColumns=True)


def mark(spark: SparkSession, folder: str, ts: str, at: dt.datetime = LAST) -> None:
    """Put a marker of a time into the folder; the default closes the stream."""
    spark.createDataFrame([(at,)], f"`{ts}` timestamp").coalesce(1).write.mode("append").parquet(folder)


def timed(stream: DataFrame, ts: str, delay: str) -> DataFrame:
    """The stream with its watermark. Markers are left out after they moved it."""
    known = stream.withWatermark(ts, delay)
    if MARKER not in stream.columns:
        return known
    # The condition names the event time, so that it is not moved ahead of the watermark
    return known.where(F.when(F.col(ts).isNotNull(), ~F.col(MARKER)).otherwise(True)).drop(MARKER)

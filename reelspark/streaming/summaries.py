"""E4, E5. Summaries of event streams."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .closing import timed


def _micros(column: str) -> Column:
    return F.unix_micros(column)


def _percentile(column: str, share: float, kind: T.DataType) -> Column:
    """The least value that at least a share of the known values do not exceed."""
    return F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY `{column}`)").cast(kind)


def stream_event_summary(
    stream: DataFrame, group: list[str], ts: str, event_id: str, wait: str, delay: str, width: str, slide: str | None = None,
    percentiles=(0.5, 0.95),
) -> DataFrame:
    """E4. The columns of :func:`operators.telemetry.event_summary` on a stream.

    Workers flush in batches, so events come out of order and may come twice: the watermark waits ``delay`` for them and
    an event id counts once within it. Append mode emits a window when no more events can change it.

    Percentiles are exact, as in the batch form: the state of a window and group counts its distinct waits.
    """
    unique = timed(stream, ts, delay).dropDuplicatesWithinWatermark([event_id])
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    totals = unique.groupBy(*group, window.alias("__window")).agg(
        F.count(F.lit(1)).alias("events"), F.sum(wait).alias("wait_sum_us"), F.avg(wait).alias("wait_mean_us"),
        F.max(wait).alias("wait_max_us"),
        *[_percentile(wait, p, stream.schema[wait].dataType).alias(f"wait_p{round(p * 100)}_us") for p in percentiles])
    return totals.withColumn("window_us", _micros("__window.start")).drop("__window")


def late_counts(stream: DataFrame, group: list[str], ts: str, arrival: str, delay_us: int, width: str) -> DataFrame:
    """E4. Events per group and arrival window that came more than ``delay_us`` after they happened, and all events.

    A summary's watermark may leave these out, so they are counted here by their own arrival time.
    """
    late = F.unix_micros(arrival) - F.unix_micros(ts) > delay_us
    counted = timed(stream, arrival, "0 seconds").groupBy(*group, F.window(arrival, width).alias("__window")).agg(
        F.count(F.lit(1)).alias("arrived"), F.count_if(late).alias("late"))
    return counted.withColumn("window_us", _micros("__window.start")).drop("__window")


def play_sessions_stream(
    stream: DataFrame, key: list[str], ts: str, delay: str, gap: str, wait: str, is_drop: Column,
) -> DataFrame:
    """E5. Play sessions on a stream, emitted once the watermark has passed their gap."""
    sessions = (
        timed(stream, ts, delay).withColumn("__drop", is_drop.cast("int"))
        .groupBy(*key, F.session_window(ts, gap).alias("__session")).agg(
            F.max(F.unix_micros(ts)).alias("last_us"), F.count(F.lit(1)).alias("events"), F.sum(wait).alias("wait_sum_us"),
            F.sum("__drop").alias("drops")))
    return sessions.withColumn("start_us", _micros("__session.start")).drop("__session")

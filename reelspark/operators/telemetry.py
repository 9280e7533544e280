"""Playback telemetry (E)."""
from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numbers import half_up
from ..plans import Lag, RowNumber, RunningSum, Timeline
from ..plans.skew import counted_rows, same_key


def normalize_trace(page: DataFrame, worker: DataFrame, starts: DataFrame, session: str) -> DataFrame:
    """E1. Events of both realms on the session's clock (``time_ms``, three decimals), numbered in time order.

    Both have (session, kind, epoch_ms, arrival_no, ...); ``starts`` has (session, started_ms). Events of a session without a
    start have no time and come in the order of arrival.
    """
    both = page.withColumn("realm", F.lit("page")).unionByName(
        worker.withColumn("realm", F.lit("worker")), allowMissingColumns=True)
    timed = both.join(starts.select(session, "started_ms"), session, "left").withColumn(
        "time_us", half_up((F.col("epoch_ms") - F.col("started_ms")) * 1000))
    ordered = Timeline(timed, session, ["time_us", "arrival_no"]).scan(event_no=RowNumber()).df
    return ordered.withColumn("time_ms", F.col("time_us") / 1000).drop("time_us", "started_ms")


def ring_capacity(events: DataFrame, key, arrival: str, n: int) -> DataFrame:
    """E2. The last ``n`` events of each session by arrival, with how many fell out of the ring.

    The limit on the row number is applied in every task before rows are shuffled, so at most ``n`` of a session's rows leave each; how many
    there were is a count, summed up the same way.
    """
    key = [key] if isinstance(key, str) else list(key)
    counts = events.groupBy(*key).agg(F.count(F.lit(1)).alias("__n")).select(*[F.col(name).alias(f"__of_{name}") for name in key], "__n")
    latest = Window.partitionBy(*key).orderBy(F.desc(arrival))
    kept = events.withColumn("__back", F.row_number().over(latest)).where(F.col("__back") <= n)
    return kept.join(counts, same_key(key, "__of_")).select(
        *events.columns, F.greatest(F.col("__n") - n, F.lit(0).cast("long")).alias("dropped_events"))


def window_starts(at: Column, width_us: int, slide_us: int) -> Column:
    """Starts of the windows that hold a time, as an array."""
    last = F.floor(at / slide_us).cast("long") * slide_us
    return F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(-(-width_us // slide_us) - 1)), lambda n: last - n.cast("long") * slide_us),
        lambda start: start + width_us > at)


def event_summary(
    events: DataFrame, group: list[str], at: str, wait: str, width_us: int, slide_us: int | None = None,
    percentiles=(0.5, 0.95),
) -> DataFrame:
    """E3. Events and waits per group and time window, tumbling or sliding; waits in whole microseconds.

    Events are first counted by pane, the greatest span that divides width and slide, and distinct wait; windows are made of panes, so
    no event is repeated for the windows that hold it. Percentiles are exact, see :func:`exact_percentiles`.
    """
    slide_us = slide_us or width_us
    pane_us = math.gcd(width_us, slide_us)
    pane = (F.floor(F.col(at) / pane_us) * pane_us).cast("long").alias("window_us")
    key = [*group, "window_us"]
    counted = events.groupBy(*group, pane, wait).agg(F.count(F.lit(1)).alias("__times"))
    if pane_us < width_us:
        starts = window_starts(F.col("window_us"), width_us, slide_us)
        counted = counted.select(*group, wait, "__times", F.explode(starts).alias("window_us"))
    weight = F.col("__times")
    totals = counted.groupBy(*key).agg(
        F.sum(weight).alias("events"), F.sum(F.col(wait) * weight).alias("wait_sum_us"),
        F.sum(F.when(F.col(wait).isNotNull(), weight)).alias("__known"), F.max(wait).alias("wait_max_us"))
    totals = totals.select(*key, "events", "wait_sum_us", (F.col("wait_sum_us").cast("double") / F.col("__known")).alias("wait_mean_us"), "wait_max_us", "__known")
    # An event is counted in each window that holds it, once at most
    at_most = None if events.isStreaming else counted_rows(events.select(*group, at, wait)) * -(-width_us // slide_us)
    return exact_percentiles(totals, counted, key, wait, {f"wait_p{round(p * 100)}_us": p for p in percentiles}, at_most)


def exact_percentiles(totals: DataFrame, counted: DataFrame, key: list[str], value: str, names: dict[str, float], at_most: int | None = None) -> DataFrame:
    """``totals`` and per key the least value that at least a share of the known values do not exceed, one column per named share.

    ``counted`` has a key's distinct values, null too, with ``__times``, which may be split over several rows; ``totals`` a row for each key with
    ``__known``, how many known values it has. A running count over values finds the percentiles, so no key's values are ever held together, however many they are.
    """
    known = F.col(value).isNotNull()
    reached = Timeline(counted.select(*key, value, "__times"), key, value, at_most=at_most).scan(__reach=RunningSum(F.when(known, F.col("__times")))).df
    facts = [name for name in totals.columns if name not in key and name != "__known"]
    joined = reached.join(totals.select(*[F.col(name).alias(f"__of_{name}") for name in key], *facts, "__known"), same_key(key, "__of_"))
    return joined.groupBy(*key).agg(
        *[F.first(name).alias(name) for name in facts],
        *[F.min(F.when(known & (F.col("__reach") >= F.ceil(F.col("__known") * share)), F.col(value))).alias(name) for name, share in names.items()])


def play_sessions(events: DataFrame, key, at: str, seq: str, gap_us: int, wait: str, is_drop: Column) -> DataFrame:
    """E5. Play sessions: a user's events until one comes ``gap_us`` or more after the last."""
    key = [key] if isinstance(key, str) else list(key)
    seen = Timeline(events.withColumn("__drop", is_drop.cast("int")), key, [at, seq]).scan(__was=Lag(at))
    seen = seen.apply(lambda df: df.withColumn(
        "__opens", F.when(F.col(at) - F.col("__was") < gap_us, 0).otherwise(1)))
    numbered = seen.scan(session_no=RunningSum("__opens")).df
    return numbered.groupBy(*key, "session_no").agg(
        F.min(at).alias("start_us"), F.max(at).alias("last_us"), F.count(F.lit(1)).alias("events"),
        F.sum(wait).alias("wait_sum_us"), F.sum("__drop").alias("drops"))


def stage_latency(events: DataFrame, key: list[str], kind: str, at: str, stages: list[str]) -> DataFrame:
    """E6. Per frame the time from each stage to the next (``<stage>_us``), by the first event of each stage, and
    how many stages are missing."""
    firsts = events.where(F.col(kind).isin(stages)).groupBy(*key).agg(
        *[F.min(F.when(F.col(kind) == stage, F.col(at))).alias(f"__{n}") for n, stage in enumerate(stages)])
    missing = reduce(lambda a, b: a + b, [F.col(f"__{n}").isNull().cast("int") for n in range(len(stages))])
    return firsts.select(
        *key, missing.alias("missing_stages"),
        *[(F.col(f"__{n}") - F.col(f"__{n - 1}")).alias(f"{stages[n].replace('-', '_')}_us") for n in range(1, len(stages))])


def stage_latency_summary(latencies: DataFrame, stages: list[str], percentiles=(0.5, 0.95)) -> DataFrame:
    """E6. Frames, mean and exact percentiles per stage."""
    names = [f"{stage.replace('-', '_')}_us" for stage in stages[1:]]
    long = latencies.select(F.explode(F.array(*[
        F.struct(F.lit(stage).alias("stage"), F.col(name).alias("latency_us")) for stage, name in zip(stages[1:], names)
    ])).alias("__s")).select("__s.*")
    counted = long.groupBy("stage", "latency_us").agg(F.count(F.lit(1)).alias("__times"))
    known = F.coalesce(F.sum(F.when(F.col("latency_us").isNotNull(), F.col("__times"))), F.lit(0))
    totals = counted.groupBy("stage").agg(
        known.alias("frames"), F.coalesce(F.sum(F.when(F.col("latency_us").isNull(), F.col("__times"))), F.lit(0)).alias("incomplete"),
        F.try_divide(F.sum(F.col("latency_us") * F.col("__times")).cast("double"), known.cast("double")).alias("mean_us"), known.alias("__known"))
    return exact_percentiles(totals, counted, ["stage"], "latency_us", {f"p{round(p * 100)}_us": p for p in percentiles})


def counter_deltas(reports: DataFrame, session, generation: str, seq: str, counters: list[str]) -> DataFrame:
    """E7. Growth of cumulative counters since the report before, from zero at a new generation."""
    key = [*([session] if isinstance(session, str) else session), generation]
    seen = Timeline(reports, key, seq).scan(**{f"__{name}": Lag(name) for name in counters}).df
    return seen.select(
        *reports.columns, *[(F.col(name) - F.coalesce(f"__{name}", F.lit(0))).alias(f"{name}_delta") for name in counters])


def counter_rates(deltas: DataFrame, key: list[str], at: str, width_us: int, counters: list[str]) -> DataFrame:
    """E7. Counter growth per second over time windows."""
    return deltas.groupBy(*key, (F.floor(F.col(at) / width_us) * width_us).cast("long").alias("window_us")).agg(*[
        (F.sum(f"{name}_delta") / (width_us / 1e6)).alias(f"{name}_per_second") for name in counters])

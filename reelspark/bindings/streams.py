"""Streaming forms over the test tables, run to their end and read back."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from ..functions.numbers import half_up
from ..operators.timing import FrameIntervalFold
from ..session import work_dir
from ..streaming import closable, fold_stream, late_counts, mark, play_sessions_stream, read_snapshot, stream_event_summary, upsert_verdict_stream
from .tables import EVENTS, QUERIES, ORACLE, configure
from .timing import interval_sql
from .verdicts import _RESULT


def _stream(spark, sf_dir) -> DataFrame:
    """``events`` as a file stream; every row of the table flows through it."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.select(
        F.col("ts").cast("timestamp").alias("at"), "event_id", "user_id", "event_type", half_up(F.col("value") * 1000).alias("dur"),
        F.get_json_object("props", "$.k").cast("long").alias("k"))


def _run(spark, build, stream: DataFrame, ts: str = "at") -> DataFrame:
    """Run what ``build`` makes of a stream over all available input, then to its end, into files that are read back."""
    folder = f"{work_dir(spark)}/stream-{uuid.uuid4().hex}"
    result = build(closable(stream, ts, f"{folder}/markers"))

    def advance():
        result.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(
            availableNow=True).start().awaitTermination()

    advance()
    mark(spark, f"{folder}/markers", ts)
    advance()
    return spark.read.schema(result.schema).parquet(f"{folder}/out")


def _register(name, oracle=None):
    def register(build):
        def run(spark, sf_dir):
            configure(spark)
            return build(spark, sf_dir)

        QUERIES[name] = run
        if oracle:
            ORACLE[name] = oracle
        return build

    return register


_DAY = 86_400_000_000


@_register("stream_event_summary", f"""WITH {EVENTS}, w AS (SELECT event_type, us // {_DAY} * {_DAY} AS window_us, dur FROM ev)
SELECT event_type, window_us, count(*) AS events, CAST(sum(dur) AS BIGINT) AS wait_sum_us, avg(dur) AS wait_mean_us, max(dur) AS wait_max_us,
  quantile_disc(dur, 0.5) AS wait_p50_us, quantile_disc(dur, 0.95) AS wait_p95_us FROM w GROUP BY event_type, window_us""")
def stream_event_summary_(spark, sf_dir):
    return _run(spark, lambda rows: stream_event_summary(rows, ["event_type"], "at", "event_id", "dur", "1 hour", "1 day"), _stream(spark, sf_dir))


# An event arrives k minutes after it happened, every 16th two hours later still
@_register("stream_late_counts", f"""WITH {EVENTS}, a AS (SELECT event_type, k * 60000000 + CASE WHEN event_id % 16 = 0 THEN 7200000000 ELSE 0 END AS wait, us FROM ev)
SELECT event_type, (us + wait) // {_DAY} * {_DAY} AS window_us, count(*) AS arrived, count(*) FILTER (wait > 3600000000) AS late FROM a GROUP BY ALL""")
def stream_late_counts(spark, sf_dir):
    wait = F.col("k") * 60_000_000 + F.when(F.col("event_id") % 16 == 0, 7_200_000_000).otherwise(0)
    arrivals = _stream(spark, sf_dir).withColumn("arrival", F.timestamp_micros(F.unix_micros("at") + wait))
    return _run(spark, lambda rows: late_counts(rows, ["event_type"], "at", "arrival", 3_600_000_000, "1 day"), arrivals, "arrival")


@_register("stream_play_sessions", f"""WITH {EVENTS},
g AS (SELECT *, CASE WHEN us - lag(us) OVER w < 10800000000 THEN 0 ELSE 1 END AS o FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us)),
s AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY us) AS n FROM g)
SELECT user_id, min(us) AS start_us, max(us) AS last_us, count(*) AS events, CAST(sum(dur) AS BIGINT) AS wait_sum_us, count(*) FILTER (event_type = 'error') AS drops
FROM s GROUP BY user_id, n""")
def stream_play_sessions(spark, sf_dir):
    is_drop = F.col("event_type") == "error"
    return _run(spark, lambda rows: play_sessions_stream(rows, ["user_id"], "at", "1 hour", "3 hours", "dur", is_drop), _stream(spark, sf_dir))


_FRAMES = """fr AS (SELECT event_id // 500 AS stream_id, event_id, row_number() OVER (PARTITION BY event_id // 500 ORDER BY us, event_id) AS n,
  event_id % 500 * 41708 AS ts, CASE WHEN k % 2 = 0 THEN 42000 END AS dur FROM ev)"""


@_register("stream_frame_interval", f"WITH {interval_sql(_FRAMES)}")
def stream_frame_interval(spark, sf_dir):
    frames = _stream(spark, sf_dir).select(
        "at", F.expr("event_id div 500").alias("stream_id"), "event_id", ((F.col("event_id") % 500) * 41_708).alias("frame_us"),
        F.when(F.col("k") % 2 == 0, 42_000).cast("long").alias("frame_dur"))
    rule = FrameIntervalFold("frame_us", "frame_dur")
    found = _run(spark, lambda rows: fold_stream(rows, "stream_id", "at", ["event_id"], rule, "1 hour", 86_400_000), frames)
    return found.withColumn("interval_us", F.round("interval_us", 3))


@_register("stream_upsert_verdicts", f"""WITH {EVENTS}, vd AS (SELECT 'host' || user_id AS host, event_type AS probe, 'fp' AS fingerprint, 1 AS schema_version, {_RESULT} AS result, us AS written_at FROM ev)
SELECT * FROM vd WHERE result NOT LIKE '%unknown%' AND result NOT LIKE '%"status":null%' QUALIFY row_number() OVER (PARTITION BY host, probe ORDER BY written_at DESC) = 1""")
def stream_upsert_verdicts(spark, sf_dir):
    folder = f"{work_dir(spark)}/verdicts-{uuid.uuid4().hex}"
    updates = _stream(spark, sf_dir).selectExpr(
        "concat('host', user_id) AS host", "event_type AS probe", "'fp' AS fingerprint", "1 AS schema_version", f"{_RESULT} AS result",
        "unix_micros(at) AS written_at")
    upsert_verdict_stream(updates, f"{folder}/table", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return read_snapshot(spark, f"{folder}/table")

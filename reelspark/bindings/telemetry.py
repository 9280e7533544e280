"""Telemetry operators over the test tables."""
from pyspark.sql import functions as F

from ..operators import telemetry as op
from .tables import EVENTS, events, query

_HOUR = 3_600_000_000


@query("normalize_trace", f"""WITH {EVENTS}, st AS (SELECT user_id, min(us) / 1000 + 1.5::DOUBLE AS started_ms FROM ev GROUP BY user_id),
tm AS (SELECT ev.user_id, event_id, event_type AS kind, CASE WHEN k % 2 = 0 THEN 'page' ELSE 'worker' END AS realm,
  CAST(floor((us / 1000 - started_ms) * 1000 + 0.5) AS BIGINT) AS t FROM ev JOIN st ON ev.user_id = st.user_id)
SELECT user_id, event_id, kind, realm, t / 1000 AS time_ms, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS event_no FROM tm""")
def normalize_trace(load):
    ev = events(load)
    trace = ev.select("user_id", "event_id", F.col("event_type").alias("kind"), (F.col("us") / 1000).alias("epoch_ms"),
                      F.col("event_id").alias("arrival_no"), "k")
    starts = ev.groupBy("user_id").agg((F.min("us") / 1000 + 1.5).alias("started_ms"))
    return op.normalize_trace(trace.where("k % 2 = 0"), trace.where("k % 2 = 1"), starts, "user_id").select(
        "user_id", "event_id", "kind", "realm", "time_ms", F.col("event_no").cast("long").alias("event_no"))


@query("ring_capacity", f"""WITH {EVENTS},
n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS c, row_number() OVER (PARTITION BY user_id ORDER BY us DESC) AS r FROM ev)
SELECT user_id, event_id, us, greatest(c - 40, 0) AS dropped_events FROM n WHERE r <= 40""")
def ring_capacity(load):
    return op.ring_capacity(events(load).select("user_id", "event_id", "us"), "user_id", "us", 40)


_SUMMARY = """count(*) AS events, CAST(sum(dur) AS BIGINT) AS wait_sum_us, avg(dur) AS wait_mean_us, max(dur) AS wait_max_us,
  quantile_disc(dur, 0.5) AS wait_p50_us, quantile_disc(dur, 0.95) AS wait_p95_us"""


@query("event_summary", f"""WITH {EVENTS} SELECT event_type, user_id % 10 AS cohort, us // {24 * _HOUR} * {24 * _HOUR} AS window_us, {_SUMMARY}
FROM ev GROUP BY ALL""")
def event_summary(load):
    ev = events(load).withColumn("cohort", F.col("user_id") % 10)
    return op.event_summary(ev, ["event_type", "cohort"], "us", "dur", 24 * _HOUR)


@query("event_summary_sliding", f"""WITH {EVENTS},
w AS (SELECT *, us // {6 * _HOUR} * {6 * _HOUR} - i * {6 * _HOUR} AS window_us FROM ev, range(0, 4) r(i))
SELECT event_type, window_us, {_SUMMARY} FROM w GROUP BY ALL""")
def event_summary_sliding(load):
    return op.event_summary(events(load), ["event_type"], "us", "dur", 24 * _HOUR, 6 * _HOUR)


@query("play_sessions", f"""WITH {EVENTS},
g AS (SELECT *, CASE WHEN us - lag(us) OVER w < {3 * _HOUR} THEN 0 ELSE 1 END AS o FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
s AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY us, event_id) AS n FROM g)
SELECT user_id, CAST(n AS BIGINT) AS session_no, min(us) AS start_us, max(us) AS last_us, count(*) AS events, CAST(sum(dur) AS BIGINT) AS wait_sum_us,
  count(*) FILTER (event_type = 'error') AS drops FROM s GROUP BY user_id, n""")
def play_sessions(load):
    return op.play_sessions(events(load), "user_id", "us", "event_id", 3 * _HOUR, "dur", F.col("event_type") == "error")


_STAGES = ["signup", "view", "click", "purchase"]
_LATENCY = """fs AS (SELECT user_id, us // 43200000000 AS frame, min(us) FILTER (event_type = 'signup') AS a, min(us) FILTER (event_type = 'view') AS b,
  min(us) FILTER (event_type = 'click') AS c, min(us) FILTER (event_type = 'purchase') AS d FROM ev WHERE event_type <> 'error' GROUP BY ALL),
lt AS (SELECT user_id, frame, (a IS NULL)::INTEGER + (b IS NULL)::INTEGER + (c IS NULL)::INTEGER + (d IS NULL)::INTEGER AS missing_stages,
  b - a AS view_us, c - b AS click_us, d - c AS purchase_us FROM fs)"""


def _latency(load):
    frames = events(load).withColumn("frame", F.expr("us div 43200000000"))
    return op.stage_latency(frames, ["user_id", "frame"], "event_type", "us", _STAGES)


@query("stage_latency", f"WITH {EVENTS}, {_LATENCY} SELECT * FROM lt")
def stage_latency(load):
    return _latency(load)


@query("stage_latency_summary", f"""WITH {EVENTS}, {_LATENCY},
lo AS (SELECT 'view' AS stage, view_us AS v FROM lt UNION ALL SELECT 'click', click_us FROM lt UNION ALL SELECT 'purchase', purchase_us FROM lt)
SELECT stage, count(v) AS frames, count(*) FILTER (v IS NULL) AS incomplete, avg(v) AS mean_us, quantile_disc(v, 0.5) AS p50_us, quantile_disc(v, 0.95) AS p95_us
FROM lo GROUP BY stage""")
def stage_latency_summary(load):
    return op.stage_latency_summary(_latency(load), _STAGES)


_DELTAS = """rp AS (SELECT user_id, event_id // 1000 AS generation, event_id, us,
    CAST(sum(k) OVER w AS BIGINT) AS consumed, CAST(sum(k % 3) OVER w AS BIGINT) AS dropped FROM ev
  WINDOW w AS (PARTITION BY user_id, event_id // 1000 ORDER BY event_id)),
dl AS (SELECT *, consumed - coalesce(lag(consumed) OVER w, 0) AS consumed_delta, dropped - coalesce(lag(dropped) OVER w, 0) AS dropped_delta FROM rp
  WINDOW w AS (PARTITION BY user_id, generation ORDER BY event_id))"""


def _deltas(load):
    from ..plans import RunningSum, Timeline
    ev = events(load).withColumn("generation", F.expr("event_id div 1000"))
    reports = Timeline(ev, ["user_id", "generation"], "event_id").scan(
        consumed=RunningSum("k"), dropped=RunningSum(F.col("k") % 3)).df.select(
        "user_id", "generation", "event_id", "us", "consumed", "dropped")
    return op.counter_deltas(reports, "user_id", "generation", "event_id", ["consumed", "dropped"])


@query("counter_deltas", f"WITH {EVENTS}, {_DELTAS} SELECT * FROM dl")
def counter_deltas(load):
    return _deltas(load)


@query("counter_rates", f"""WITH {EVENTS}, {_DELTAS} SELECT user_id, us // {24 * _HOUR} * {24 * _HOUR} AS window_us,
  CAST(sum(consumed_delta) AS BIGINT) / 86400::DOUBLE AS consumed_per_second, CAST(sum(dropped_delta) AS BIGINT) / 86400::DOUBLE AS dropped_per_second FROM dl GROUP BY ALL""")
def counter_rates(load):
    return op.counter_rates(_deltas(load), ["user_id"], "us", 24 * _HOUR, ["consumed", "dropped"])

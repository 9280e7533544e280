"""Clock and presentation timing operators over the test tables."""
from pyspark.sql import functions as F

from ..operators import timing as op
from .tables import EVENTS, events, query

# Runs of 500 events as the frames of a stream stamped in whole milliseconds; the second half plays at another rate
_FRAME_US = """CAST(floor((event_id % 500) * CASE WHEN event_id % 500 < 250 THEN 41.70833 ELSE 20.0 END
  + CASE WHEN event_id % 500 < 250 THEN 0 ELSE 6000 END + 0.5) AS BIGINT) * 1000 + (event_id // 500) * 3600000000"""


def _frames(load):
    return events(load).select(
        F.expr("event_id div 500").alias("stream_id"), "event_id",
        F.expr(_FRAME_US.replace("//", "div")).alias("frame_us"), "k",
        F.when(F.col("k") % 2 == 0, 42_000).cast("long").alias("frame_dur"), (F.col("event_id") % 500).alias("n"))


def interval_sql(frames: str) -> str:
    """SQL that goes through each stream's frames one by one: ``fr`` made by ``frames`` has stream_id, event_id, n (from 1), ts and dur."""
    return f"""RECURSIVE {EVENTS}, {frames},
fi AS (
  SELECT stream_id, event_id, n, [0::BIGINT] AS counts, [ts] AS times, greatest(coalesce(dur, 0), 0)::DOUBLE AS interval_us, greatest(coalesce(dur, 0), 0)::BIGINT AS own
  FROM fr WHERE n = 1
  UNION ALL
  SELECT stream_id, event_id, n, c3, t3, CASE WHEN elapsed <= 0 THEN dur::DOUBLE
    ELSE list_sum(list_transform(range(1, len(c3) + 1), lambda i: (c3[i] - list_avg(c3)) * (t3[i] - list_avg(t3)))) / list_sum(list_transform(c3, lambda x: (x - list_avg(c3)) * (x - list_avg(c3)))) END, dur
  FROM (SELECT *, list_transform(c2, lambda x: x - c2[1]) AS c3, t2 AS t3
    FROM (SELECT *, CASE WHEN elapsed <= 0 THEN [0::BIGINT] WHEN off THEN [0::BIGINT, 1] ELSE list_append(counts, here)[-24:] END AS c2,
        CASE WHEN elapsed <= 0 THEN [ts] WHEN off THEN [times[-1], ts] ELSE list_append(times, ts)[-24:] END AS t2
      FROM (SELECT *, len(times) > 1 AND abs(list_avg(times) + slope * (here - list_avg(counts)) - ts) > 0.4::DOUBLE * slope AS off
        FROM (SELECT *, counts[-1] + CASE WHEN step > 0 THEN greatest(CAST(floor(elapsed / step + 0.5) AS BIGINT), 1) ELSE 1 END AS here,
            list_sum(list_transform(range(1, len(counts) + 1), lambda i: (counts[i] - list_avg(counts)) * (times[i] - list_avg(times)))) /
              list_sum(list_transform(counts, lambda x: (x - list_avg(counts)) * (x - list_avg(counts)))) AS slope
          FROM (SELECT fr.stream_id, fr.event_id, fr.n, fr.ts, greatest(coalesce(fr.dur, 0), 0)::BIGINT AS dur, counts, times, fr.ts - times[-1] AS elapsed,
              CASE WHEN own > 0 THEN own::DOUBLE ELSE interval_us END AS step
            FROM fi JOIN fr ON fr.stream_id = fi.stream_id AND fr.n = fi.n + 1))))))
SELECT stream_id, event_id, round(interval_us, 3) AS interval_us FROM fi"""


_OWN_FRAMES = f"""fr AS (SELECT event_id // 500 AS stream_id, event_id, row_number() OVER (PARTITION BY event_id // 500 ORDER BY event_id) AS n,
  {_FRAME_US} AS ts, CASE WHEN k % 2 = 0 THEN 42000 END AS dur FROM ev)"""


@query("frame_interval", f"WITH {interval_sql(_OWN_FRAMES)}")
def frame_interval(load):
    frames = _frames(load)
    return op.frame_interval(frames, "stream_id", "event_id", "frame_us", "frame_dur").select(
        "stream_id", "event_id", F.round("interval_us", 3).alias("interval_us"))


@query("frame_interval_rolling", f"""WITH {EVENTS},
fr AS (SELECT event_id // 500 AS stream_id, event_id, {_FRAME_US} AS us FROM ev),
ar AS (SELECT *, list(us) OVER (PARTITION BY stream_id ORDER BY event_id ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS a FROM fr),
sm AS (SELECT stream_id, event_id, len(a) AS n,
  CAST(list_sum(list_transform(a, lambda t, i: (t - a[1]) * (i - 1))) AS BIGINT) AS w,
  CAST(list_sum(list_transform(a, lambda t: t - a[1])) AS BIGINT) AS s FROM ar)
SELECT stream_id, event_id, CASE WHEN n > 1 THEN CAST(n * w - (n * (n - 1) // 2) * s AS DOUBLE)
  / CAST(n * (n * (n - 1) * (2 * n - 1) // 6) - (n * (n - 1) // 2) * (n * (n - 1) // 2) AS DOUBLE) END AS rolling_us FROM sm""")
def frame_interval_rolling(load):
    return op.frame_interval_rolling(_frames(load), "stream_id", "event_id", "frame_us").select("stream_id", "event_id", "rolling_us")


@query("frame_interval_stats", f"""WITH {EVENTS},
fr AS (SELECT event_id // 500 AS stream_id, event_id, {_FRAME_US} AS us FROM ev),
nb AS (SELECT *, row_number() OVER w AS n, us - lag(us) OVER w AS d FROM fr WINDOW w AS (PARTITION BY stream_id ORDER BY event_id))
SELECT stream_id, count(*) AS frames, round(regr_slope(us, n), 2) AS interval_us, round(stddev_pop(d), 2) AS jitter_us FROM nb GROUP BY stream_id""")
def frame_interval_stats(load):
    return op.frame_interval_stats(_frames(load), "stream_id", "event_id", "frame_us").select(
        "stream_id", "frames", F.round("interval_us", 2).alias("interval_us"), F.round("jitter_us", 2).alias("jitter_us"))


@query("refresh_interval")
def refresh_interval(load):
    ticks = events(load).select(
        F.expr("event_id div 500").alias("session_id"), "event_id",
        ((F.col("event_id") % 500) * 16.666 + F.col("k") * 0.004
         + F.when(F.col("event_id") % 500 >= 400, 900.0).otherwise(0.0)).alias("tick_ms"))
    return op.refresh_interval(ticks, "session_id", "event_id", "tick_ms").select(
        "session_id", "event_id", F.round("refresh_ms", 5).alias("refresh_ms"))


_ANCHORS = """an AS (SELECT user_id, event_id AS anchor_id, us AS wall_us, us - 1700000000000000 + k * 7000 AS media_us,
  1.0 + (k % 3) * 0.25 AS rate, k % 7 = 0 AS paused, CAST(k * 100000 AS BIGINT) AS hold_us FROM ev WHERE event_type = 'signup')"""


def _anchors(load):
    return events(load).where("event_type = 'signup'").select(
        "user_id", F.col("event_id").alias("anchor_id"), F.col("us").alias("wall_us"),
        (F.col("us") - 1_700_000_000_000_000 + F.col("k") * 7000).alias("media_us"),
        (1.0 + (F.col("k") % 3) * 0.25).alias("rate"), (F.col("k") % 7 == 0).alias("paused"),
        (F.col("k") * 100_000).cast("long").alias("hold_us"))


@query("project_clock", f"""WITH {EVENTS}, {_ANCHORS},
sa AS (SELECT user_id, event_id, us FROM ev WHERE event_type = 'view'),
m AS (SELECT s.*, a.* EXCLUDE (user_id) FROM sa s ASOF LEFT JOIN an a ON s.user_id = a.user_id AND s.us >= a.wall_us)
SELECT user_id, event_id, us, CASE WHEN NOT paused AND us - wall_us - hold_us > 0
  THEN media_us + CAST(floor((us - wall_us - hold_us) * rate + 0.5) AS BIGINT) ELSE media_us END AS media_us FROM m""")
def project_clock(load):
    samples = events(load).where("event_type = 'view'").select("user_id", "event_id", "us")
    return op.project_clock(samples, _anchors(load), "user_id", "us", "anchor_id")


_JUMPS = f"""{EVENTS}, {_ANCHORS},
lg AS (SELECT *, lag(wall_us) OVER w AS pw, lag(media_us) OVER w AS pm, lag(rate) OVER w AS pr, lag(paused) OVER w AS pp, lag(hold_us) OVER w AS ph
  FROM an WINDOW w AS (PARTITION BY user_id ORDER BY wall_us, anchor_id)),
jp AS (SELECT *, media_us - CASE WHEN NOT pp AND wall_us - pw - ph > 0 THEN pm + CAST(floor((wall_us - pw - ph) * pr + 0.5) AS BIGINT) ELSE pm END AS jump_us FROM lg)"""


@query("clock_jumps", f"WITH {_JUMPS} SELECT user_id, anchor_id, jump_us, coalesce(abs(jump_us) >= 16000, false) AS is_reset FROM jp")
def clock_jumps(load):
    return op.clock_jumps(_anchors(load), "user_id", "anchor_id").select("user_id", "anchor_id", "jump_us", "is_reset")


@query("clock_jump_summary", f"""WITH {_JUMPS} SELECT user_id, count(*) AS syncs, count(*) FILTER (abs(jump_us) >= 16000) AS resets,
  coalesce(max(abs(jump_us)), 0) AS largest_jump_us FROM jp GROUP BY user_id""")
def clock_jump_summary(load):
    return op.clock_jump_summary(op.clock_jumps(_anchors(load), "user_id", "anchor_id"), "user_id")


_TICKS = """tk AS (SELECT user_id, event_id // 2000 AS generation, event_id AS tick_no, us + (k - 60) * 60000000 AS target_us
  FROM ev WHERE event_type IN ('view', 'purchase')),
fm AS (SELECT user_id, event_id // 2000 AS generation, event_id AS frame_no, us, dur * 400000 AS dur FROM ev WHERE event_type IN ('click', 'signup')),
rm AS (SELECT *, max(target_us) OVER (PARTITION BY user_id, generation ORDER BY tick_no) AS reach FROM tk),
rf AS (SELECT user_id, generation, reach, min(tick_no) AS tick_no FROM rm GROUP BY ALL),
asg AS (SELECT f.*, r.tick_no FROM fm f ASOF LEFT JOIN rf r ON f.user_id = r.user_id AND f.generation = r.generation AND f.us <= r.reach)"""
_TAKEN = _TICKS + """, sl AS (SELECT *, CASE WHEN tick_no IS NULL THEN 'pending'
    WHEN row_number() OVER (PARTITION BY user_id, generation, tick_no ORDER BY us DESC, frame_no DESC) = 1 THEN 'taken' ELSE 'dropped' END AS status FROM asg),
st AS (SELECT sl.*, tk.target_us FROM sl LEFT JOIN tk USING (user_id, generation, tick_no))"""


def _ticks(load):
    return events(load).where("event_type IN ('view', 'purchase')").select(
        "user_id", F.expr("event_id div 2000").alias("generation"), F.col("event_id").alias("tick_no"),
        (F.col("us") + (F.col("k") - 60) * 60_000_000).alias("target_us"), "us")


def _taken(load):
    frames = events(load).where("event_type IN ('click', 'signup')").select(
        "user_id", F.expr("event_id div 2000").alias("generation"), F.col("event_id").alias("frame_no"), "us",
        (F.col("dur") * 400_000).alias("dur"))
    return op.select_frames(_ticks(load), frames, ["user_id", "generation"], "tick_no", "target_us", "frame_no", "us")


@query("select_frames", f"WITH {EVENTS}, {_TAKEN} SELECT user_id, generation, frame_no, us, tick_no, status, target_us FROM st")
def select_frames(load):
    return _taken(load).select("user_id", "generation", "frame_no", "us", "tick_no", "status", "target_us")


@query("select_arrived_frames", f"""WITH {EVENTS}, {_TICKS},
ti AS (SELECT t.user_id, t.generation, t.tick_no, e.us AS at_us FROM tk t JOIN ev e ON e.event_id = t.tick_no),
att AS (SELECT a.user_id, a.generation, a.frame_no, a.us,
    CASE WHEN a.tick_no IS NOT NULL AND i.tick_no IS NOT NULL THEN greatest(a.tick_no, i.tick_no) END AS tick_no
  FROM (SELECT *, us + dur AS arrival FROM asg) a
  ASOF LEFT JOIN ti i ON a.user_id = i.user_id AND a.generation = i.generation AND a.arrival <= i.at_us)
SELECT user_id, generation, frame_no, tick_no, CASE WHEN tick_no IS NULL THEN 'pending'
    WHEN row_number() OVER (PARTITION BY user_id, generation, tick_no ORDER BY us DESC, frame_no DESC) = 1 THEN 'taken' ELSE 'dropped' END AS status
FROM att""")
def select_arrived_frames(load):
    frames = events(load).where("event_type IN ('click', 'signup')").select(
        "user_id", F.expr("event_id div 2000").alias("generation"), F.col("event_id").alias("frame_no"), "us",
        (F.col("us") + F.col("dur") * 400_000).alias("arrival_us"))
    return op.select_frames(
        _ticks(load), frames, ["user_id", "generation"], "tick_no", "target_us", "frame_no", "us",
        arrival="arrival_us", tick_time="us").select("user_id", "generation", "frame_no", "tick_no", "status")


@query("frame_lag", f"""WITH {EVENTS}, {_TAKEN},
lg AS (SELECT *, 0.5 * (1 + frame_no % 4) AS rate, target_us - us AS lag_us, target_us - (us + greatest(dur, 0)) AS gap FROM st WHERE status = 'taken'),
sv AS (SELECT *, dur > 0 AND lag_us > dur AS late, CASE WHEN gap > 2000000 THEN 'excessive'
  WHEN rate > 1 AND gap > least(2000000, CAST(floor(500000 * greatest(1.0, rate) + 0.5) AS BIGINT)) THEN 'resync'
  WHEN gap > 100000 THEN 'catch-up' ELSE 'none' END AS severity FROM lg)
SELECT user_id, count(*) AS taken_frames, count(*) FILTER (late) AS late_frames, CAST(greatest(max(lag_us), 0) AS BIGINT) AS worst_lag_us,
  count(*) FILTER (severity = 'catch-up') AS catch_up_frames, count(*) FILTER (severity = 'resync') AS resync_frames,
  count(*) FILTER (severity = 'excessive') AS excessive_frames FROM sv GROUP BY user_id""")
def frame_lag(load):
    taken = _taken(load).where("status = 'taken'").withColumn("rate", 0.5 * (1 + F.col("frame_no") % 4))
    return op.frame_lag_summary(op.frame_lag(taken, "target_us", "us", "dur", "rate"), "user_id")


@query("wait_spans", f"""WITH {EVENTS},
kn AS (SELECT user_id, event_id, us, event_type = 'error' AS waiting FROM ev WHERE event_type IN ('error', 'view')),
ch AS (SELECT * FROM (SELECT *, coalesce(lag(waiting) OVER (PARTITION BY user_id ORDER BY us, event_id), false) AS was FROM kn) WHERE was <> waiting),
en AS (SELECT *, lead(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS end_us FROM ch)
SELECT user_id, us AS start_us, end_us, end_us - us AS wait_us FROM en WHERE waiting""")
def wait_spans(load):
    marked = events(load).withColumn("waiting", F.when(F.col("event_type") == "error", True).when(F.col("event_type") == "view", False))
    return op.wait_spans(marked, "user_id", "event_id", "us", "waiting")


@query("missing_frame_waits", f"""WITH {EVENTS},
tk AS (SELECT event_id // 500 AS session_id, event_id, (event_id % 500) * 40000 + k AS us, (event_id // 37) % 9 > 3 AND k % 5 > 0 AND NOT (event_id % 500 BETWEEN 60 AND 340) AS has_frame FROM ev),
fl AS (SELECT *, CASE WHEN NOT has_frame AND coalesce(lag(has_frame) OVER w, true) THEN 1 ELSE 0 END AS opens,
  first_value(CASE WHEN has_frame THEN us END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY us, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS resumes
  FROM tk WINDOW w AS (PARTITION BY session_id ORDER BY us, event_id)),
isl AS (SELECT *, sum(opens) OVER (PARTITION BY session_id ORDER BY us, event_id) AS island FROM fl),
ms AS (SELECT *, min(us) OVER (PARTITION BY session_id, island) AS start_us FROM isl WHERE NOT has_frame),
wt AS (SELECT *, min(CASE WHEN us - start_us >= 100000 THEN us END) OVER (PARTITION BY session_id, island) AS wait_us FROM ms)
SELECT session_id, start_us, count(*) AS missing_ticks, max(us) AS last_us, min(wait_us) AS wait_us, min(resumes) AS end_us,
  min(CASE WHEN us - wait_us >= 10000000 THEN us END) AS stall_us FROM wt GROUP BY session_id, start_us""")
def missing_frame_waits(load):
    ticks = events(load).select(
        F.expr("event_id div 500").alias("session_id"), "event_id", ((F.col("event_id") % 500) * 40_000 + F.col("k")).alias("us"),
        F.expr("(event_id div 37) % 9 > 3 AND k % 5 > 0 AND NOT (event_id % 500 BETWEEN 60 AND 340)").alias("has_frame"))
    return op.missing_frame_waits(ticks, "session_id", "event_id", "us", "has_frame")


_OVERLAP = """rs AS (SELECT event_id // 500 AS session_id, event_id AS refresh_no, (event_id % 500) * 16667 + k * 3 AS refresh_us FROM ev),
re AS (SELECT *, lead(refresh_us) OVER (PARTITION BY session_id ORDER BY refresh_us, refresh_no) AS refresh_end FROM rs),
fr AS (SELECT event_id // 500 AS session_id, event_id AS frame_no, (event_id % 500) * CASE WHEN event_id // 500 % 2 = 0 THEN 41708 ELSE 33334 END AS frame_us FROM ev),
fe AS (SELECT *, coalesce(lead(frame_us) OVER (PARTITION BY session_id ORDER BY frame_us, frame_no), frame_us + 41708) AS frame_end FROM fr),
pr AS (SELECT r.session_id, refresh_no, frame_no, least(refresh_end, frame_end) - greatest(refresh_us, frame_us) AS covered_us,
  refresh_end - refresh_us AS len, CAST(frame_end - frame_us AS DOUBLE) / (refresh_end - refresh_us) AS ratio
  FROM re r JOIN fe f ON r.session_id = f.session_id AND refresh_us < frame_end AND frame_us < refresh_end WHERE refresh_end IS NOT NULL)"""


@query("refresh_overlap", f"""WITH {EVENTS}, {_OVERLAP}
SELECT session_id, refresh_no, frame_no, covered_us, CAST(covered_us AS DOUBLE) / len AS share,
  abs(ratio - greatest(floor(ratio + 0.5), 1)) > 0.002 * greatest(floor(ratio + 0.5), 1) AS blends FROM pr""")
def refresh_overlap(load):
    refreshes = events(load).select(
        F.expr("event_id div 500").alias("session_id"), "event_id", ((F.col("event_id") % 500) * 16_667 + F.col("k") * 3).alias("us"))
    frames = events(load).select(
        F.expr("event_id div 500").alias("session_id"), "event_id", F.lit(41_708).alias("dur"),
        F.expr("(event_id % 500) * CASE WHEN event_id div 500 % 2 = 0 THEN 41708 ELSE 33334 END").alias("us"))
    return op.refresh_overlap(refreshes, frames, "session_id", "event_id", "us", "event_id", "us", "dur", 40_000)

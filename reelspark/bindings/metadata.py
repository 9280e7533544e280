"""Metadata and layer operators over the test tables."""
from pyspark.sql import functions as F

from ..operators import metadata as op
from .tables import EVENTS, events, query


def _layers(load):
    ev = events(load)
    base = ev.select("user_id", F.col("event_id").alias("base_seq"), F.col("us").alias("base_ts"))
    # Every fourth kind is off by more than the tolerance, so its base frame has no partner
    off = F.when(F.col("k") % 4 == 0, 100).otherwise(0)
    enh = ev.select("user_id", F.col("event_id").alias("enh_seq"), (F.col("us") + F.col("k") % 5 - 2 + off).alias("enh_ts"))
    return base, enh


@query("pair_layers", f"""WITH {EVENTS},
en AS (SELECT user_id, event_id AS enh_no, us + k % 5 - 2 + CASE WHEN k % 4 = 0 THEN 100 ELSE 0 END AS enh_us FROM ev),
pr AS (SELECT b.user_id, b.event_id AS base_no, b.us AS base_us, e.enh_no, e.enh_us FROM ev b
  FULL JOIN en e ON b.user_id = e.user_id AND b.event_id = e.enh_no AND abs(b.us - e.enh_us) <= 1)
SELECT coalesce(p.user_id, e.user_id) AS user_id, base_no, base_us, p.enh_no, p.enh_us,
  CASE WHEN p.enh_no IS NULL THEN 'base-only' WHEN base_no IS NULL THEN 'enhancement-only' ELSE 'paired' END AS status
FROM pr p LEFT JOIN en e ON p.enh_no = e.enh_no""")
def pair_layers(load):
    base, enh = _layers(load)
    return op.pair_layers(base, enh, "user_id", "base_seq", "base_ts", "enh_seq", "enh_ts")


@query("pair_layers_crowded")
def pair_layers_crowded(load):
    """Frames 41 ms apart beside frames that drift against them, within a tolerance that reaches several."""
    ev = events(load).withColumn("stream_id", F.expr("event_id div 500")).withColumn("n", F.col("event_id") % 500)
    base = ev.select("stream_id", F.col("n").alias("base_seq"), (F.col("n") * 41_000).alias("base_ts"))
    off = F.when(F.col("k") % 6 == 0, 1_000_000_000).otherwise(0)
    enh = ev.select("stream_id", F.col("n").alias("enh_seq"), (F.col("n") * 41_300 + F.col("k") * 10 + off).alias("enh_ts"))
    return op.pair_layers(base, enh, "stream_id", "base_seq", "base_ts", "enh_seq", "enh_ts", tolerance=50_000)


@query("align_layers", f"""WITH {EVENTS},
b AS (SELECT user_id, event_id AS base_no, us AS base_us, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS ordinal FROM ev),
e AS (SELECT user_id, event_id AS enh_no, us + k % 5 - 2 + CASE WHEN k % 4 = 0 THEN 100 ELSE 0 END AS enh_us, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS ordinal FROM ev)
SELECT b.user_id, b.ordinal, base_no, base_us, enh_no, enh_us, coalesce(abs(enh_us - base_us) > 1, false) AS misaligned
FROM b LEFT JOIN e ON b.user_id = e.user_id AND b.ordinal = e.ordinal""")
def align_layers(load):
    base, enh = _layers(load)
    return op.align_layers(base, enh, "user_id", "base_seq", "base_ts", "enh_seq", "enh_ts")


_STATIC = """CASE WHEN event_type = 'signup' AND user_id % 5 > 0 THEN CAST(1000 + CASE WHEN user_id % 4 = 0 THEN (k % 2) * 3000 ELSE 0 END AS DOUBLE) END AS max_nits,
  CASE WHEN event_type = 'signup' AND user_id % 5 > 0 THEN 0.01 END AS min_nits,
  CASE WHEN event_type = 'view' AND user_id % 5 > 0 AND user_id % 3 > 0 THEN CAST(CASE WHEN user_id % 7 = 0 THEN k ELSE 400 * (k % 2) END AS DOUBLE) END AS cll,
  CASE WHEN event_type = 'view' AND user_id % 5 > 0 AND user_id % 6 = 5 THEN 100.0 END AS fall, event_type = 'error' AND k % 23 = 0 AS malformed"""


@query("static_metadata_scan", f"""WITH {EVENTS},
un AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rk, {_STATIC} FROM ev),
hd AS (SELECT user_id, rk, max_nits, CAST(min_nits AS DOUBLE) AS min_nits, nullif(cll, 0) AS cll, CAST(nullif(fall, 0) AS DOUBLE) AS fall, malformed FROM un WHERE rk <= 16),
mk AS (SELECT *, malformed AS bad, coalesce(min(max_nits) OVER w <> max(max_nits) OVER w, false) OR coalesce(min(cll) OVER w <> max(cll) OVER w, false) AS differs,
  coalesce(max_nits, min_nits, cll, fall) IS NOT NULL AS filled FROM hd WINDOW w AS (PARTITION BY user_id ORDER BY rk)),
mg AS (SELECT user_id, count(*) AS scanned_units, min(CASE WHEN bad THEN rk END) AS fb, min(CASE WHEN differs THEN rk END) AS fd,
  min(CASE WHEN filled THEN rk - 1 END) AS ff, max(max_nits) AS a, max(min_nits) AS b, max(cll) AS c, max(fall) AS d FROM mk GROUP BY user_id),
st AS (SELECT *, CASE WHEN coalesce(fd < coalesce(fb, 17), false) THEN 'conflicting' WHEN fb IS NOT NULL THEN 'malformed' WHEN ff IS NULL THEN 'absent' ELSE 'valid' END AS status FROM mg)
SELECT user_id, scanned_units, status, CASE WHEN status = 'valid' THEN CAST(ff AS INTEGER) END AS first_unit, CASE WHEN status = 'valid' THEN a END AS max_nits,
  CASE WHEN status = 'valid' THEN b END AS min_nits, CASE WHEN status = 'valid' THEN c END AS cll, CASE WHEN status = 'valid' THEN d END AS fall,
  CASE WHEN status = 'valid' THEN coalesce(a, c) END AS peak_nits FROM st""")
def static_metadata_scan(load):
    units = events(load).selectExpr(
        "user_id", "event_id",
        "CASE WHEN event_type = 'signup' AND user_id % 5 > 0 THEN CAST(1000 + CASE WHEN user_id % 4 = 0 THEN (k % 2) * 3000 ELSE 0 END AS DOUBLE) END AS max_nits",
        "CASE WHEN event_type = 'signup' AND user_id % 5 > 0 THEN 0.01D END AS min_nits",
        "CASE WHEN event_type = 'view' AND user_id % 5 > 0 AND user_id % 3 > 0 THEN CAST(CASE WHEN user_id % 7 = 0 THEN k ELSE 400 * (k % 2) END AS DOUBLE) END AS cll",
        "CASE WHEN event_type = 'view' AND user_id % 5 > 0 AND user_id % 6 = 5 THEN 100.0D END AS fall",
        "event_type = 'error' AND k % 23 = 0 AS malformed")
    return op.static_metadata_scan(units, "user_id", "event_id")


_MESSAGES = """ms AS (SELECT user_id, event_id // 8 AS au, CASE WHEN event_type = 'error' AND k % 4 = 0 THEN 'malformed'
    WHEN event_type = 'view' THEN 'ignored' WHEN k % 9 = 0 THEN 'unsupported' ELSE 'parsed' END AS status, 'payload-' || (user_id % 2 + (k // 90)) AS payload FROM ev)"""


def _messages(load):
    return events(load).selectExpr(
        "user_id", "event_id div 8 AS au", """CASE WHEN event_type = 'error' AND k % 4 = 0 THEN 'malformed'
        WHEN event_type = 'view' THEN 'ignored' WHEN k % 9 = 0 THEN 'unsupported' ELSE 'parsed' END AS status""",
        "concat('payload-', user_id % 2 + (k div 90)) AS payload")


@query("message_state", f"""WITH {EVENTS}, {_MESSAGES},
un AS (SELECT DISTINCT event_id // 8 AS au FROM ev),
ag AS (SELECT au, bool_or(status = 'malformed') AS bad, count(*) FILTER (status IN ('parsed', 'unsupported')) AS n,
  min(payload) FILTER (status IN ('parsed', 'unsupported')) AS lo, max(payload) FILTER (status IN ('parsed', 'unsupported')) AS hi,
  bool_or(status = 'unsupported') AS uns FROM ms WHERE status <> 'ignored' GROUP BY au),
st AS (SELECT au, CASE WHEN bad THEN 'malformed' WHEN coalesce(n, 0) = 0 THEN 'absent' WHEN lo <> hi THEN 'conflicting' WHEN uns THEN 'unsupported' ELSE 'valid' END AS status, lo
  FROM un LEFT JOIN ag USING (au))
SELECT au, status, CASE WHEN status = 'valid' THEN lo END AS payload FROM st""")
def message_state(load):
    units = events(load).select(F.expr("event_id div 8").alias("au")).distinct()
    return op.message_state(units, _messages(load).where("status <> 'ignored'"), "au", "status", "payload")


@query("carry_metadata", f"""WITH {EVENTS},
pk AS (SELECT user_id, event_id, us // 7200000000 AS ts, CASE event_type WHEN 'signup' THEN 'valid' WHEN 'error' THEN 'conflicting'
  WHEN 'purchase' THEN 'unsupported' WHEN 'view' THEN 'malformed' ELSE 'absent' END AS status, 'p' || k AS payload FROM ev),
sg AS (SELECT *, count(*) FILTER (status IN ('valid', 'conflicting', 'unsupported')) OVER (PARTITION BY user_id ORDER BY event_id) AS seg FROM pk),
hl AS (SELECT *, max(CASE WHEN status = 'valid' THEN payload END) OVER (PARTITION BY user_id, seg) AS held,
  row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id) AS ordinal FROM sg),
fr AS (SELECT *, row_number() OVER (PARTITION BY user_id, ts ORDER BY frame_no) AS ordinal FROM (
  SELECT user_id, us // 7200000000 + CASE WHEN k % 7 = 0 THEN 1000000 ELSE 0 END AS ts, event_id AS frame_no FROM ev))
SELECT coalesce(h.user_id, f.user_id) AS user_id, coalesce(h.ts, f.ts) AS ts, coalesce(h.ordinal, f.ordinal) AS ordinal, h.event_id AS packet_no, held AS payload, frame_no,
  CASE WHEN h.event_id IS NULL THEN 'frame-only' WHEN frame_no IS NULL THEN 'packet-only' ELSE 'matched' END AS match
FROM hl h FULL JOIN fr f ON h.user_id = f.user_id AND h.ts = f.ts AND h.ordinal = f.ordinal""")
def carry_metadata(load):
    ev = events(load).withColumn("ts", F.expr("us div 7200000000"))
    packets = ev.selectExpr(
        "user_id", "event_id", "ts", """CASE event_type WHEN 'signup' THEN 'valid' WHEN 'error' THEN 'conflicting'
        WHEN 'purchase' THEN 'unsupported' WHEN 'view' THEN 'malformed' ELSE 'absent' END AS status""", "concat('p', k) AS payload")
    frames = ev.select("user_id", (F.col("ts") + F.when(F.col("k") % 7 == 0, 1_000_000).otherwise(0)).alias("ts"), F.col("event_id").alias("frame_id"))
    return op.carry_metadata(packets, frames, "user_id", "event_id", "ts", "status", "payload", "frame_id")


@query("scene_luminance", f"""WITH {EVENTS},
m AS (SELECT event_id, value AS average, CASE WHEN k % 3 = 0 THEN 0::DOUBLE ELSE k * 10::DOUBLE END AS r, CASE WHEN k % 3 = 0 THEN 0::DOUBLE ELSE value END AS g,
  CASE WHEN k % 3 = 0 THEN 0::DOUBLE ELSE k * 2::DOUBLE END AS b, CASE WHEN k % 6 = 0 THEN 0::DOUBLE ELSE greatest(k * 1.5::DOUBLE, value) END AS p FROM ev),
w AS (SELECT *, greatest(r, g, b) AS mx, r * 0.2627::DOUBLE + g * 0.678::DOUBLE + b * 0.0593::DOUBLE AS wt FROM m),
q AS (SELECT event_id, CASE WHEN mx > 0 THEN wt ELSE p END AS peak, CASE WHEN mx > 0 THEN average * wt / mx ELSE average END AS mean FROM w)
SELECT event_id, CASE WHEN peak > 0 THEN peak END AS peak_nits, CASE WHEN mean > 0 THEN mean END AS average_nits FROM q""")
def scene_luminance(load):
    meta = events(load).selectExpr(
        "event_id", "value AS average",
        "CASE WHEN k % 3 = 0 THEN array(0D, 0D, 0D) ELSE array(k * 10D, value, k * 2D) END AS scl",
        """CASE WHEN k % 6 = 0 THEN array() ELSE array(named_struct('p', 50, 'nits', k * 1.5D), named_struct('p', 99, 'nits', value)) END AS pct""")
    return op.scene_luminance(meta, "average", "scl", "pct").select("event_id", "peak_nits", "average_nits")

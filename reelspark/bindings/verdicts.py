"""Verdict operators over the test tables."""
from pyspark.sql import functions as F

from ..operators import verdicts as op
from .tables import EVENTS, events, query

# A nested probe result per event, written the same way by both engines
_RESULT = """'{"a":[{"status":"' || CASE WHEN k % 5 = 0 THEN 'unknown' WHEN k % 5 = 1 THEN 'unsupported' ELSE 'supported' END || '","reason":"'
  || CASE WHEN k % 10 = 0 THEN 'probe-timeout' ELSE 'none' END || '"}],"b":' || CASE WHEN k % 7 = 0 THEN '{"status":null}' ELSE '{"x":1}' END || '}'"""
_PLAIN = """CASE WHEN k % 11 = 0 THEN '{"b":2}' ELSE """ + _RESULT + " END"


@query("definitive", f"""WITH {EVENTS}, r AS (SELECT event_id, {_PLAIN} AS result FROM ev),
s AS (SELECT *, regexp_extract_all(result, '"status":("[^"]*"|[a-z0-9]*)', 1) AS st FROM r)
SELECT event_id, len(st) > 0 AND len(list_filter(st, lambda x: x NOT IN ('"supported"', '"unsupported"'))) = 0 AS is_definitive,
  contains(result, '"reason":"probe-timeout"') AS timed_out FROM s""")
def definitive(load):
    results = events(load).select("event_id", F.expr(_PLAIN).alias("result"))
    return op.definitive(results, "result").select("event_id", "is_definitive", "timed_out")


@query("canonical_fingerprint", f"""WITH {EVENTS},
c AS (SELECT event_id, '{{"adapter":{{"a":' || k || ',"b":[1,{{"x":true,"y":null}}]}},"agent":"' || event_type || '"}}' AS canonical FROM ev)
SELECT event_id, canonical, sha256(canonical) AS fingerprint FROM c""")
def canonical_fingerprint(load):
    shuffled = F.when(F.col("k") % 2 == 0, F.expr(
        """concat('{"agent": "', event_type, '", "adapter": {"b": [1, {"y": null, "x": true}], "a": ', k, '}}')""")).otherwise(F.expr(
        """concat('{"adapter":{"a":', k, ',"b":[1,{"x":true,"y":null}]},"agent":"', event_type, '"}')"""))
    return op.canonical_fingerprint(events(load).select("event_id", shuffled.alias("json")), "json").select(
        "event_id", "canonical", "fingerprint")


_VERDICTS = f"""vd AS (SELECT 'host' || user_id AS host, event_type AS probe, 'fp' || CASE WHEN user_id % 4 = 0 THEN k // 30 ELSE 0 END AS fingerprint,
  CASE WHEN user_id % 9 = 0 AND event_id % 100 > 90 THEN 2 ELSE 1 END AS schema_version, {_RESULT} AS result, us AS written_at, event_id FROM ev)"""


@query("upsert_verdicts", f"""WITH {EVENTS}, {_VERDICTS},
df AS (SELECT * FROM vd WHERE result NOT LIKE '%unknown%' AND result NOT LIKE '%"status":null%'),
mx AS (SELECT host, max(written_at) AS last FROM df GROUP BY host),
nw AS (SELECT d.host, d.fingerprint AS fp, d.schema_version AS sv FROM df d JOIN mx ON d.host = mx.host AND d.written_at = mx.last),
ct AS (SELECT d.host, max(written_at) AS cutoff FROM df d JOIN nw n ON d.host = n.host WHERE d.fingerprint <> fp OR d.schema_version <> sv GROUP BY d.host),
lv AS (SELECT d.* FROM df d JOIN nw n ON d.host = n.host LEFT JOIN ct c ON d.host = c.host
  WHERE d.fingerprint = fp AND d.schema_version = sv AND (cutoff IS NULL OR written_at > cutoff))
SELECT host, probe, fingerprint, schema_version, result, written_at FROM lv
QUALIFY row_number() OVER (PARTITION BY host, probe ORDER BY written_at DESC) = 1""")
def upsert_verdicts(load):
    rows = events(load).selectExpr(
        "concat('host', user_id) AS host", "event_type AS probe",
        "concat('fp', CASE WHEN user_id % 4 = 0 THEN k div 30 ELSE 0 END) AS fingerprint",
        "CASE WHEN user_id % 9 = 0 AND event_id % 100 > 90 THEN 2 ELSE 1 END AS schema_version", f"{_RESULT} AS result",
        "us AS written_at", "event_id")
    return op.upsert_verdicts(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"))


_CALLS = """cl AS (SELECT user_id AS page_id, event_id AS call_id, us AS start_us, CASE WHEN k % 29 > 0 THEN us + (k + 1) * 120000000 END AS end_us,
  CAST(k * 1000 AS BIGINT) AS bytes, k % 3 AS decoders FROM ev)"""
_SWEEP = f"""{EVENTS}, {_CALLS},
ed AS (SELECT *, start_us AS t, 1 AS kind FROM cl UNION ALL SELECT *, end_us, 0 FROM cl WHERE end_us IS NOT NULL),
sw AS (SELECT *, sum(bytes * (2 * kind - 1)) OVER w AS open_bytes, sum(decoders * (2 * kind - 1)) OVER w AS open_decoders, sum(2 * kind - 1) OVER w AS open_calls,
  min(CASE WHEN kind = 1 THEN t END) OVER (PARTITION BY page_id ORDER BY t, kind, call_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx
  FROM ed WINDOW w AS (PARTITION BY page_id ORDER BY t, kind, call_id)),
fl AS (SELECT page_id, call_id, start_us, end_us, CAST(open_bytes AS BIGINT) AS open_bytes, CAST(open_decoders AS BIGINT) AS open_decoders,
  CAST(open_calls AS BIGINT) AS open_calls, open_calls > 1 OR (nx IS NOT NULL AND (end_us IS NULL OR nx < end_us)) AS overlapped FROM sw WHERE kind = 1)"""


def _swept(load):
    calls = events(load).selectExpr(
        "user_id AS page_id", "event_id AS call_id", "us AS start_us", "CASE WHEN k % 29 > 0 THEN us + (k + 1) * 120000000 END AS end_us",
        "k * 1000 AS bytes", "k % 3 AS decoders")
    return op.in_flight(calls, "page_id", "call_id", "start_us", "end_us", "bytes", "decoders")


@query("in_flight", f"WITH {_SWEEP} SELECT * FROM fl")
def in_flight(load):
    return _swept(load)


@query("in_flight_peaks", f"""WITH {_SWEEP} SELECT page_id, max(open_bytes) AS peak_bytes, max(open_decoders) AS peak_decoders, max(open_calls) AS peak_calls,
  count(*) FILTER (overlapped) AS overlapped_calls FROM fl GROUP BY page_id""")
def in_flight_peaks(load):
    return op.in_flight_peaks(_swept(load), "page_id")


def _records(load):
    ev = events(load).withColumn("fingerprint", F.col("user_id"))
    calls = ev.where("event_type <> 'signup'").select(
        "fingerprint", F.expr("event_id div 100").alias("crash_no"), F.expr("concat('step', k % 12)").alias("step"),
        (F.col("k") * 1000).alias("bytes"), (F.col("k") % 3).alias("decoders"))
    crashes = op.crash_records(calls, "fingerprint", "crash_no", "step", "bytes", "decoders").withColumn("seq", F.col("crash_no") * 100)
    resolved = ev.where("event_type = 'signup'").select(
        "fingerprint", F.expr("event_id div 100").alias("crash_no"), F.lit("resolved").alias("kind"),
        F.array(F.expr("concat('step', k % 12)")).alias("steps"), F.lit(0).cast("long").alias("bytes"),
        F.lit(0).cast("long").alias("decoders"), (F.col("event_id") + 1).alias("seq"))
    return calls, crashes.unionByName(resolved)


@query("quarantine")
def quarantine(load):
    _, records = _records(load)
    return op.quarantine(records, "fingerprint", "seq")


@query("quarantine_unblocked_calls")
def quarantine_unblocked_calls(load):
    calls, records = _records(load)
    now = op.quarantine_now(op.quarantine(records, "fingerprint", "seq"), "fingerprint", "seq")
    return op.unblocked_calls(calls, now, "fingerprint", "step")

"""Packet operators over the test tables."""
from pyspark.sql import functions as F

from ..operators import packets as op
from .tables import EVENTS, FILES, LINES, PACKETS, events, files, lines, packets, query

_PRESENTED = PACKETS + """, pr AS (
  SELECT *, CASE WHEN picture = 'anchor' THEN coalesce(
      first_value(CASE WHEN picture = 'anchor' THEN us END IGNORE NULLS) OVER (
        PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND 17 FOLLOWING),
      last_value(us + dur) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 17 FOLLOWING))
    ELSE us END AS presented_us FROM pk)"""


def _presented(load):
    return op.presentation_order(packets(load), "user_id", "event_id", "us", "dur", "picture")


@query("presentation_order", f"WITH {_PRESENTED} SELECT user_id, event_id, picture, us, presented_us FROM pr")
def presentation_order(load):
    return _presented(load).select("user_id", "event_id", "picture", "us", "presented_us")


@query("presentation_order_none_outputs", f"""WITH {PACKETS}
SELECT user_id, event_id, CASE WHEN picture = 'anchor' THEN coalesce(
    first_value(CASE WHEN picture IN ('anchor', 'none') THEN us END IGNORE NULLS) OVER (
      PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING),
    last_value(us + dur) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING))
  ELSE us END AS presented_us FROM pk""")
def presentation_order_none_outputs(load):
    return op.presentation_order(
        packets(load), "user_id", "event_id", "us", "dur", "picture", n=4, none_outputs=True,
    ).select("user_id", "event_id", "presented_us")


@query("presented_frame_counts", f"""WITH {_PRESENTED}
SELECT user_id, count(*) FILTER (kept) AS kept_frames, count(*) FILTER (NOT kept) AS decimated_frames
FROM (SELECT user_id, dur <= 0 OR ((-presented_us) % 41667 + 41667) % 41667 < dur AS kept FROM pr) GROUP BY user_id""")
def presented_frame_counts(load):
    """Presentation order, then decimation to a 24 fps display: the flagship query."""
    frames = _presented(load).withColumn("interval_us", F.lit(41_667))
    return op.presentable_summary(op.presentable(frames, "presented_us", "dur", "interval_us"), "user_id")


@query("seek_key_packet", f"""WITH {_PRESENTED},
kp AS (SELECT user_id, event_id AS key_seq, presented_us AS key_us, us FROM pr WHERE picture = 'anchor'),
fk AS (SELECT user_id, min(us) AS first_ts, min(key_seq) AS first_seq, arg_min(key_us, key_seq) AS first_us FROM kp GROUP BY user_id),
rq AS (SELECT user_id, event_id AS request_id, us AS at_us FROM pk WHERE picture = 'none'),
m AS (SELECT r.user_id, r.request_id, r.at_us, k.key_seq, k.key_us FROM rq r
  ASOF LEFT JOIN kp k ON r.user_id = k.user_id AND r.at_us >= k.key_us)
SELECT m.user_id, m.request_id, m.at_us,
  CASE WHEN m.key_seq IS NULL AND first_ts <= m.at_us THEN first_seq ELSE m.key_seq END AS key_seq,
  CASE WHEN m.key_seq IS NULL AND first_ts <= m.at_us THEN first_us ELSE m.key_us END AS key_us
FROM m LEFT JOIN fk ON m.user_id = fk.user_id""")
def seek_key_packet(load):
    own = _presented(load).withColumn("is_key", F.col("picture") == "anchor")
    requests = packets(load).where("picture = 'none'").select("user_id", F.col("event_id").alias("request_id"), F.col("us").alias("at_us"))
    return op.seek_key_packet(requests, own, "user_id", "at_us", "event_id", "us", "presented_us", "is_key")


@query("start_packet", f"""WITH {EVENTS},
pk AS (SELECT user_id, event_id AS start_seq, us AS start_us FROM ev WHERE event_type <> 'error'),
fp AS (SELECT user_id, min(start_us) AS first_us, arg_min(start_seq, start_us) AS first_seq FROM pk GROUP BY user_id),
og AS (SELECT user_id, min(us) AS origin_us FROM ev GROUP BY user_id),
rq AS (SELECT e.user_id, e.event_id AS request_id, e.us AS at_us, o.origin_us, greatest(o.origin_us, e.us - 3600000000) AS lookup_us
  FROM ev e JOIN og o USING (user_id) WHERE event_type = 'error'),
m AS (SELECT r.*, p.start_seq, p.start_us FROM rq r ASOF LEFT JOIN pk p ON r.user_id = p.user_id AND r.lookup_us >= p.start_us)
SELECT m.user_id, m.request_id, m.at_us, m.origin_us, m.lookup_us,
  CASE WHEN lookup_us <= origin_us OR start_seq IS NULL THEN first_seq ELSE start_seq END AS start_seq,
  CASE WHEN lookup_us <= origin_us OR start_seq IS NULL THEN first_us ELSE start_us END AS start_us
FROM m LEFT JOIN fp ON m.user_id = fp.user_id""")
def start_packet(load):
    ev = events(load)
    origins = ev.groupBy("user_id").agg(F.min("us").alias("origin_us"))
    requests = ev.where("event_type = 'error'").select(
        "user_id", F.col("event_id").alias("request_id"), F.col("us").alias("at_us")).join(origins, "user_id")
    return op.start_packet(requests, ev.where("event_type <> 'error'"), "user_id", "at_us", "event_id", "us", "origin_us", 3_600_000_000)


@query("rebase_timeline", f"""WITH {LINES}, {FILES},
fo AS (SELECT l_orderkey, min(us) AS first_us FROM li GROUP BY l_orderkey),
og AS (SELECT l_orderkey, container, CASE WHEN container IN ('ts', 'mpeg') THEN greatest(0, first_us) ELSE 0 END AS origin_us
  FROM fo JOIN fl USING (l_orderkey))
SELECT container, l_orderkey, CAST(count(*) AS BIGINT) AS packets, min(us - origin_us) AS first_us, max(us - origin_us) AS last_us
FROM li JOIN og USING (l_orderkey) GROUP BY container, l_orderkey""")
def rebase_timeline(load):
    catalogue = files(load)
    rebased = op.rebase_timeline(lines(load), catalogue, "l_orderkey", "us", "container")
    spans = rebased.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("packets"), F.min("rebased_us").alias("first_us"), F.max("rebased_us").alias("last_us"))
    return spans.join(catalogue.select("l_orderkey", "container"), "l_orderkey")


@query("index_coverage", f"""WITH {LINES}, {FILES},
en AS (SELECT l_orderkey, max(us + dur) AS e FROM li GROUP BY l_orderkey)
SELECT l_orderkey, duration_us, coalesce(e, 0) AS end_us, duration_us - coalesce(e, 0) AS missing_us
FROM fl LEFT JOIN en USING (l_orderkey) WHERE container = 'avi' AND duration_us - coalesce(e, 0) > 1000000""")
def index_coverage(load):
    return op.index_coverage(
        files(load), lines(load), "l_orderkey", "container", "duration_us", "us", "dur",
    ).select("l_orderkey", "duration_us", "end_us", "missing_us")


@query("presentable", f"""WITH {EVENTS}
SELECT user_id, event_id, us, interval_us, interval_us IS NULL OR dur <= 0 OR ((-us) % interval_us + interval_us) % interval_us < dur AS kept
FROM (SELECT *, CASE WHEN k % 3 = 0 THEN NULL ELSE 1000 * (k + 1) END AS interval_us FROM ev)""")
def presentable(load):
    frames = events(load).withColumn("interval_us", F.when(F.col("k") % 3 != 0, 1000 * (F.col("k") + 1)))
    return op.presentable(frames, "us", "dur", "interval_us").select("user_id", "event_id", "us", "interval_us", "kept")


_UNITS = EVENTS + """, un AS (
  SELECT user_id, event_id // 4 AS au, event_id AS unit_no,
    CASE event_type WHEN 'signup' THEN 33 WHEN 'error' THEN 1 ELSE 2 * (k % 8) END AS type,
    CASE WHEN k % 17 = 0 THEN 1 ELSE 0 END AS layer,
    CASE WHEN user_id % 3 = 0 THEN k % 2 ELSE 1 END AS temporal_id,
    CASE WHEN event_type = 'signup' THEN k % 2 END AS sps_id,
    CASE WHEN event_type = 'signup' THEN CASE WHEN user_id % 5 = 0 THEN k % 3 ELSE 1 END END AS top,
    k <> 99 AS readable FROM ev)"""


@query("unreferenced_pictures", f"""WITH {_UNITS},
ch AS (SELECT user_id, au, top AS v, lag(top) OVER (PARTITION BY user_id, sps_id ORDER BY au, unit_no) AS w
  FROM un WHERE type = 33 AND layer = 0 AND readable),
cd AS (SELECT user_id, au, sum(CASE WHEN w IS NULL THEN 1 ELSE 0 END) AS dn, sum(v - coalesce(w, 0)) AS ds,
  sum(v * v - coalesce(w * w, 0)) AS dq FROM ch GROUP BY user_id, au),
pc AS (SELECT user_id, au, count(*) FILTER (type = 33 AND layer = 0 AND NOT readable) AS bad,
  count(*) FILTER (layer = 0 AND type <= 31) AS vcl_units,
  bool_and(type <= 14 AND type % 2 = 0) FILTER (layer = 0 AND type <= 31) AS drop_ok,
  min(temporal_id) FILTER (layer = 0 AND type <= 31) AS low, max(temporal_id) FILTER (layer = 0 AND type <= 31) AS high
  FROM un GROUP BY user_id, au),
rs AS (SELECT p.*, sum(bad) OVER w AS rb, sum(coalesce(dn, 0)) OVER w AS n, sum(coalesce(ds, 0)) OVER w AS s, sum(coalesce(dq, 0)) OVER w AS q
  FROM pc p LEFT JOIN cd USING (user_id, au) WINDOW w AS (PARTITION BY user_id ORDER BY au)),
hi AS (SELECT *, CASE WHEN rb = 0 AND n > 0 AND n * q = s * s THEN CAST(s / n AS INTEGER) END AS highest_temporal_id FROM rs)
SELECT user_id, au, vcl_units, highest_temporal_id,
  coalesce(vcl_units > 0 AND drop_ok AND low = highest_temporal_id AND high = highest_temporal_id, false) AS unreferenced FROM hi""")
def unreferenced_pictures(load):
    units = events(load).selectExpr(
        "user_id", "event_id div 4 AS au", "event_id AS unit_no",
        "CASE event_type WHEN 'signup' THEN 33 WHEN 'error' THEN 1 ELSE 2 * (k % 8) END AS type",
        "CASE WHEN k % 17 = 0 THEN 1 ELSE 0 END AS layer",
        "CASE WHEN user_id % 3 = 0 THEN k % 2 ELSE 1 END AS temporal_id",
        "CASE WHEN event_type = 'signup' THEN k % 2 END AS sps_id",
        "CASE WHEN event_type = 'signup' THEN CASE WHEN user_id % 5 = 0 THEN k % 3 ELSE 1 END END AS sps_max_sub_layer",
        "k <> 99 AS readable")
    return op.unreferenced_pictures(units, "user_id", "au", "unit_no")


_SCAN = "CASE user_id % 5 WHEN 0 THEN 'progressive' WHEN 1 THEN 'interlaced' WHEN 2 THEN 'top-first' WHEN 3 THEN 'bottom-first' ELSE 'unknown' END"
_FIELDS = EVENTS + f""", wd AS (SELECT *, CASE WHEN k % 4 = 0 THEN 0 WHEN k % 19 = 0 THEN k % 32 ELSE (k % 16) | 1 END AS word, {_SCAN} AS stream_scan FROM ev),
fs AS (SELECT *, word <> 0 AND (word & 1 = 0 OR word > 15) AS bad FROM wd),
ft AS (SELECT *, CASE WHEN bad THEN NULL WHEN word & 1 = 1 THEN CASE WHEN word & 2 = 0 THEN 'progressive' WHEN word & 4 <> 0 THEN 'top-first' ELSE 'bottom-first' END
  WHEN stream_scan <> 'unknown' THEN stream_scan END AS scan FROM fs),
fd AS (SELECT *, CASE WHEN scan IS NULL THEN NULL WHEN word & 1 = 1 THEN word & 2 = 0 AND word & 8 <> 0 ELSE false END AS repeat_first_field,
  CASE WHEN scan <> 'progressive' THEN scan <> 'bottom-first' END AS top_first,
  CASE WHEN bad THEN 'invalid' WHEN word & 1 = 1 THEN 'reported' WHEN scan IS NOT NULL THEN 'stream' ELSE 'unknown' END AS fields_status FROM ft)"""


def _fields(load):
    frames = events(load).withColumn(
        "word", F.expr("CASE WHEN k % 4 = 0 THEN 0 WHEN k % 19 = 0 THEN k % 32 ELSE (k % 16) | 1 END")
    ).withColumn("stream_scan", F.expr(_SCAN))
    return op.decode_fields(frames, "word", "stream_scan")


@query("decode_fields", f"WITH {_FIELDS} SELECT user_id, event_id, word, scan, repeat_first_field, top_first, fields_status FROM fd")
def decode_fields(load):
    return _fields(load).select("user_id", "event_id", "word", "scan", "repeat_first_field", "top_first", "fields_status")


@query("field_timeline", f"""WITH {_FIELDS},
nb AS (SELECT *, coalesce(lag(scan = 'progressive' AND repeat_first_field) OVER w, false) OR
    coalesce(lead(scan = 'progressive' AND repeat_first_field) OVER w, false) AS beside,
  coalesce(lead(us) OVER w, us + dur) AS end_us FROM fd WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
il AS (SELECT *, coalesce(scan <> 'progressive', false) AND NOT beside AS inter FROM nb)
SELECT user_id, event_id, 1 AS field_no, us AS field_us, CASE WHEN inter THEN scan <> 'bottom-first' END AS top_field FROM il
UNION ALL
SELECT user_id, event_id, 2, us + (end_us - us) // 2, scan = 'bottom-first' FROM il WHERE inter AND end_us > us""")
def field_timeline(load):
    return op.field_timeline(_fields(load), "user_id", "us", "event_id", "dur").select(
        "user_id", "event_id", "field_no", "field_us", "top_field")


@query("unit_inventory", """WITH pc AS (SELECT source, doc_id, string_split(text, '. ') AS parts FROM documents),
un AS (SELECT source, doc_id, i, len(parts) AS n, encode(parts[i] || CASE WHEN i < len(parts) THEN '.' ELSE '' END) AS unit FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM pc)),
st AS (SELECT source, doc_id, CASE WHEN min(octet_length(unit)) < 2 THEN 'missing-header' ELSE 'ok' END AS status FROM un GROUP BY ALL),
ok AS (SELECT source, doc_id, CAST(CAST('0x' || substr(hex(unit), 1, 2) AS INTEGER) >> 1 & 63 AS INTEGER) AS type, octet_length(unit) AS size, 'ok' AS status FROM un JOIN st USING (source, doc_id) WHERE status = 'ok'
  UNION ALL SELECT source, doc_id, NULL, NULL, status FROM st WHERE status <> 'ok'),
pp AS (SELECT source, doc_id, max(CASE WHEN status = 'ok' AND type <= 31 THEN 1 ELSE 0 END) AS shows FROM ok GROUP BY ALL),
pf AS (SELECT source, count(*) AS packets, avg(shows) AS shown_share FROM pp GROUP BY source)
SELECT source, type, status, count(*) AS units, CAST(sum(size) AS BIGINT) AS bytes, any_value(packets) AS packets, any_value(shown_share) AS shown_share FROM ok JOIN pf USING (source) GROUP BY source, type, status""")
def unit_inventory(load):
    """Documents as Annex B packets: every sentence a unit behind a start code."""
    code = "\x00\x00\x00\x01"
    framed = load("documents").select(
        "source", "doc_id",
        F.encode(F.concat(F.lit(code), F.replace("text", F.lit(". "), F.lit("." + code))), "UTF-8").alias("payload"))
    units = op.unit_inventory(framed, ["source", "doc_id"], "payload", "annex-b")
    return op.unit_summary(units, "source", "doc_id", "annex-b")


_SENTENCES = """pc AS (SELECT source, doc_id, string_split(text, '. ') AS parts FROM documents),
sn AS (SELECT source, doc_id, i, octet_length(encode(parts[i])) AS n, encode(parts[i]) AS bytes FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM pc))"""
_SUMMARY = """pp AS (SELECT source, doc_id, max(CASE WHEN status = 'ok' AND shows THEN 1 ELSE 0 END) AS shows FROM un GROUP BY source, doc_id),
pf AS (SELECT source, count(*) AS packets, avg(shows) AS shown_share FROM pp GROUP BY source)
SELECT source, type, status, count(*) AS units, CAST(sum(size) AS BIGINT) AS bytes, any_value(packets) AS packets, any_value(shown_share) AS shown_share FROM un JOIN pf USING (source) GROUP BY source, type, status"""


def _hex(value):
    """Big-endian hexadecimal digits of a number, four bytes."""
    return F.lpad(F.hex(value), 8, "0")


def _sentences(load):
    return load("documents").withColumn("parts", F.split("text", r"\. "))


@query("unit_inventory_lengths", f"""WITH {_SENTENCES},
st AS (SELECT source, doc_id, CASE WHEN min(n) = 0 THEN 'invalid-length' WHEN doc_id % 11 = 0 THEN 'truncated-length' WHEN min(n) < 2 THEN 'missing-header' ELSE 'ok' END AS status
  FROM sn GROUP BY source, doc_id),
un AS (SELECT source, doc_id, CAST('0x' || substr(hex(bytes), 1, 2) AS INTEGER) >> 1 & 63 AS type, n AS size, status,
    CAST('0x' || substr(hex(bytes), 1, 2) AS INTEGER) >> 1 & 63 <= 31 AS shows FROM sn JOIN st USING (source, doc_id) WHERE status = 'ok'
  UNION ALL SELECT source, doc_id, NULL, NULL, status, false FROM st WHERE status <> 'ok'),
{_SUMMARY}""")
def unit_inventory_lengths(load):
    """Documents as packets of units behind four-byte lengths; every eleventh ends within a length."""
    unit = lambda part: F.concat(_hex(F.octet_length(part)), F.hex(F.encode(part, "UTF-8")))
    framed = _sentences(load).select("source", "doc_id", F.unhex(F.concat(
        F.array_join(F.transform("parts", unit), ""), F.when(F.col("doc_id") % 11 == 0, "000000").otherwise(""))).alias("payload"))
    units = op.unit_inventory(framed, ["source", "doc_id"], "payload", "length-4")
    return op.unit_summary(units, "source", "doc_id", "length-4")


@query("unit_inventory_av1", f"""WITH {_SENTENCES},
st AS (SELECT DISTINCT source, doc_id, CASE WHEN doc_id % 7 = 0 THEN 'forbidden-bit' WHEN doc_id % 13 = 0 THEN 'truncated-size' ELSE 'ok' END AS status FROM sn),
un AS (SELECT source, doc_id, CAST(n % 8 AS INTEGER) AS type, 1 + CAST(n % 5 = 0 AS INTEGER) + CASE WHEN n < 128 THEN 1 ELSE 4 END + n AS size, status, n % 8 IN (3, 6, 7) AS shows
    FROM sn JOIN st USING (source, doc_id) WHERE status = 'ok'
  UNION ALL SELECT source, doc_id, NULL, NULL, status, false FROM st WHERE status <> 'ok'),
{_SUMMARY}""")
def unit_inventory_av1(load):
    """Documents as packets of OBUs of one sentence, with and without an extension, sizes in one byte or four."""

    def unit(part):
        size = F.octet_length(part)
        byte = lambda bits, flag: F.lpad(F.hex(F.shiftright(size, bits).bitwiseAND(127) + flag), 2, "0")
        header = (size % 8) * 8 + 2
        return F.concat(
            F.when(size % 5 == 0, F.concat(F.lpad(F.hex(header + 4), 2, "0"), F.lit("00"))).otherwise(F.lpad(F.hex(header), 2, "0")),
            F.when(size < 128, byte(0, 0)).otherwise(F.concat(byte(0, 128), byte(7, 128), byte(14, 128), byte(21, 0))),
            F.hex(F.encode(part, "UTF-8")))

    framed = _sentences(load).select("source", "doc_id", F.unhex(F.concat(
        F.when(F.col("doc_id") % 7 == 0, "80").otherwise(""), F.array_join(F.transform("parts", unit), ""),
        F.when(F.col("doc_id") % 13 == 0, "0AFF").otherwise(""))).alias("payload"))
    units = op.unit_inventory(framed, ["source", "doc_id"], "payload", "av1")
    return op.unit_summary(units, "source", "doc_id", "av1")


@query("unit_inventory_vp9", f"""WITH {_SENTENCES},
fr AS (SELECT *, (i - 1) // 8 AS packet, n % 2 = 0 AS hid FROM sn),
whole AS (SELECT source, doc_id, packet, arg_min(hid, i) AS hid, sum(n + 1) + 4 * count(*) + 2 AS size FROM fr WHERE doc_id % 6 = 0 GROUP BY source, doc_id, packet),
un AS (SELECT source, hid AS hidden, n + 1 AS size FROM fr WHERE doc_id % 6 > 0 UNION ALL SELECT source, hid, size FROM whole)
SELECT source, hidden, count(*) AS units, CAST(sum(size) AS BIGINT) AS bytes FROM un GROUP BY source, hidden""")
def unit_inventory_vp9(load):
    """Documents as superframes of up to eight sentences; where the index is damaged, the packet is one frame."""
    eights = F.transform(F.sequence(F.lit(0), (F.size("parts") - 1).cast("int"), F.lit(8)), lambda first: F.slice("parts", first + 1, F.lit(8)))
    little = lambda part: F.concat(*[F.substring(_hex(F.octet_length(part) + 1), place, 2) for place in (7, 5, 3, 1)])
    frame = lambda part: F.concat(F.when(F.octet_length(part) % 2 == 0, "80").otherwise("82"), F.hex(F.encode(part, "UTF-8")))
    marker = F.hex(F.lit(0xC0 + 0x18) + F.size("frames") - 1)
    framed = _sentences(load).where("parts IS NOT NULL").select(
        "source", "doc_id", F.posexplode(eights).alias("packet", "frames")).select(
        "source", "doc_id", "packet", F.unhex(F.concat(
            F.array_join(F.transform("frames", frame), ""), F.when(F.col("doc_id") % 6 == 0, "00").otherwise(marker),
            F.array_join(F.transform("frames", little), ""), marker)).alias("payload"))
    units = op.unit_inventory(framed, ["source", "doc_id", "packet"], "payload", "vp9")
    return units.groupBy("source", "hidden").agg(F.count(F.lit(1)).alias("units"), F.sum("size").alias("bytes"))

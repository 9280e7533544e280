"""Audio operators over the test tables: an embedding is a chunk whose 64 samples are dealt to the channels of a layout.

The last channels of a layout that does not divide 64 are filled with silence.
"""
from pyspark.sql import functions as F

from ..functions import mixing
from ..functions.tables import LAYOUT_SPEAKERS, OUTPUT_LAYOUTS
from ..operators import audio as op
from .tables import EVENTS, events, query

_LAYOUTS = list(LAYOUT_SPEAKERS)
_COUNTS = [len(LAYOUT_SPEAKERS[name]) for name in _LAYOUTS]


def _chunks(load):
    at = (F.col("vec_id") % len(_LAYOUTS) + 1).cast("int")
    chunks = load("embeddings").select(
        F.expr("vec_id div 50").alias("stream_id"), "vec_id", "embedding",
        F.element_at(F.array(*[F.lit(name) for name in _LAYOUTS]), at).alias("layout"),
        F.element_at(F.array(*[F.lit(count) for count in _COUNTS]), at).alias("count"))
    chunks = chunks.withColumn("frames", F.ceil(F.lit(64) / F.col("count")).cast("int"))
    return chunks.withColumn("channels", F.transform(F.sequence(F.lit(0), F.col("count") - 1), lambda c: F.transform(
        F.sequence(F.lit(0), F.col("frames") - 1),
        lambda i: F.coalesce(F.get("embedding", c * F.col("frames") + i) * 4, F.lit(0.0)).cast("float")))).drop("embedding", "count")


_CHUNKS = f"""ch AS (SELECT vec_id // 50 AS stream_id, vec_id, {[*_LAYOUTS]!r}[vec_id % {len(_LAYOUTS)} + 1] AS layout, {_COUNTS!r}[vec_id % {len(_LAYOUTS)} + 1] AS cc, embedding FROM embeddings),
cf AS (SELECT *, CAST(ceil(64.0 / cc) AS BIGINT) AS fr FROM ch),
sm AS (SELECT stream_id, vec_id, layout, fr, c, i, CAST(coalesce(embedding[c * fr + i + 1], 0) * 4 AS FLOAT)::DOUBLE AS x
  FROM cf, range({max(_COUNTS)}) a(c), range(64) b(i) WHERE c < cc AND i < fr)"""


def _events_as_chunks(load):
    late = F.expr("CASE WHEN n >= 400 AND event_id div 500 % 4 = 1 THEN 9000000 WHEN n >= 350 THEN 180000 WHEN n >= 200 THEN 300000 ELSE 0 END")
    return events(load).withColumn("n", F.col("event_id") % 500).select(
        F.expr("event_id div 500").alias("stream_id"), "event_id",
        (F.col("n") * 21_333 + F.col("k") * 9 + late - F.when(F.col("k") % 31 == 0, 30_000).otherwise(0)).alias("ts"),
        F.lit(1024).alias("frames"), F.lit(48_000).alias("rate"))


# 1,021 is the tolerance of 48 kHz: a millisecond and a frame, in whole microseconds
_RECONCILED = f"""RECURSIVE {EVENTS},
ck AS (SELECT event_id // 500 AS stream_id, event_id, event_id % 500 * 21333 + k * 9 + CASE WHEN event_id % 500 >= 400 AND event_id // 500 % 4 = 1 THEN 9000000
    WHEN event_id % 500 >= 350 THEN 180000 WHEN event_id % 500 >= 200 THEN 300000 ELSE 0 END - CASE WHEN k % 31 = 0 THEN 30000 ELSE 0 END AS ts FROM ev),
co AS (SELECT *, row_number() OVER w AS n, lag(ts) OVER w AS previous, first_value(ts) OVER w AS anchor FROM ck WINDOW w AS (PARTITION BY stream_id ORDER BY event_id)),
rc AS (
  SELECT stream_id, event_id, n, 'anchor' AS decision, 0::BIGINT AS silence_frames, 0::BIGINT AS discarded_frames, 1024::BIGINT AS accepted_frames,
    0::BIGINT AS start_frame, 0::BIGINT AS deviation_us, 1024::BIGINT AS total, false AS over FROM co WHERE n = 1
  UNION ALL
  SELECT stream_id, event_id, n, decision, CASE decision WHEN 'fill' THEN fix ELSE 0 END, lost, 1024 - lost,
    CASE WHEN decision NOT IN ('ended', 'reject') THEN total + CASE decision WHEN 'fill' THEN fix ELSE 0 END END,
    CASE WHEN decision <> 'ended' THEN dev END, total + CASE decision WHEN 'fill' THEN fix ELSE 0 END + 1024 - lost, over OR decision = 'reject'
  FROM (SELECT *, CASE WHEN decision IN ('ended', 'reject', 'drop') THEN 1024 WHEN decision = 'trim' THEN fix ELSE 0 END AS lost
    FROM (SELECT *, CASE WHEN over THEN 'ended' WHEN dev = 0 THEN 'contiguous' WHEN abs(dev) <= 1021 OR ts <= previous THEN 'absorb'
        WHEN abs(dev) > 2000000 THEN 'reject' WHEN dev > 0 THEN 'fill'
        WHEN 1024 - fix <= 0 OR (2 * (1024 - fix) * 1000000 + 48000) // 96000 <= 1021 THEN 'drop' ELSE 'trim' END AS decision
      FROM (SELECT *, (2 * abs(dev) * 48000 + 1000000) // 2000000 AS fix
        FROM (SELECT co.*, rc.total, rc.over, co.ts - co.anchor - (2 * rc.total * 1000000 + 48000) // 96000 AS dev
          FROM rc JOIN co ON co.stream_id = rc.stream_id AND co.n = rc.n + 1)))))"""


@query("reconcile_timeline", f"""WITH {_RECONCILED}
SELECT stream_id, event_id, decision, silence_frames, discarded_frames, accepted_frames, start_frame, deviation_us FROM rc""")
def reconcile_timeline(load):
    return op.reconcile_timeline(_events_as_chunks(load), "stream_id", "event_id", "ts", "frames", "rate")


@query("reconcile_summary", f"""WITH {_RECONCILED}
SELECT stream_id, count(*) AS chunks, {", ".join(f"count(*) FILTER (decision = '{name}') AS {name}_chunks" for name in ("absorb", "fill", "trim", "drop", "reject"))},
  sum(silence_frames)::BIGINT AS silence_frames, sum(discarded_frames)::BIGINT AS discarded_frames FROM rc GROUP BY stream_id""")
def reconcile_summary(load):
    return op.reconcile_summary(reconcile_timeline(load), "stream_id")


_DECIDED = "CASE WHEN vec_id % 11 = 0 THEN 'drop' ELSE 'fill' END"


@query("apply_window", f"""WITH {_CHUNKS}
SELECT vec_id, CAST(c AS INTEGER) AS channel, CAST(count(*) FILTER (i >= d) + s AS INTEGER) AS frames, round(coalesce(sum(x) FILTER (i >= d), 0), 5) AS total, vec_id * 8 - s AS start_frame
FROM (SELECT *, CASE WHEN vec_id % 5 = 0 THEN 3 ELSE 0 END AS d, vec_id % 3 AS s FROM sm) WHERE vec_id % 11 > 0 GROUP BY vec_id, c, s""")
def apply_window(load):
    chunks = _chunks(load)
    decisions = chunks.select(
        "stream_id", "vec_id", F.expr(_DECIDED).alias("decision"), (F.col("vec_id") % 3).alias("silence_frames"),
        F.when(F.col("vec_id") % 5 == 0, 3).otherwise(0).cast("long").alias("discarded_frames"), (F.col("vec_id") * 8).alias("start_frame"))
    windowed = op.apply_window(chunks, decisions, ["stream_id", "vec_id"])
    return windowed.select("vec_id", "start_frame", F.posexplode("channels").alias("channel", "__x")).select(
        "vec_id", "channel", F.size("__x").alias("frames"), F.round(_total("__x"), 5).alias("total"), "start_frame")


def _total(name):
    return F.aggregate(name, F.lit(0.0), lambda a, x: a + x.cast("double"))


@query("seek_trim", f"""WITH {_CHUNKS}, t AS (SELECT *, vec_id * 1000 AS ts, 8000 AS rate, vec_id * 1000 + (vec_id % 13) * 100 - 200 AS start FROM sm),
o AS (SELECT *, greatest(start - ts, 0) AS lead, CAST(ceil(greatest(start - ts, 0) * 8000 / 1000000) AS BIGINT) AS off FROM t)
SELECT vec_id, CAST(c AS INTEGER) AS channel, CASE WHEN off > 0 THEN greatest(ts + off * 125, start) ELSE ts END AS ts,
  CAST(count(*) FILTER (i >= off) AS INTEGER) AS frames, round(sum(x) FILTER (i >= off), 5) + 0 AS total
FROM o WHERE NOT (lead > 0 AND lead >= fr * 125) AND off < fr GROUP BY vec_id, c, ts, off, start""")
def seek_trim(load):
    chunks = _chunks(load).withColumn("ts", F.col("vec_id") * 1000).withColumn("rate", F.lit(8000)).withColumn(
        "start", F.col("vec_id") * 1000 + (F.col("vec_id") % 13) * 100 - 200)
    trimmed = op.seek_trim(chunks, "ts", "rate", "start")
    return trimmed.select("vec_id", "ts", F.posexplode("channels").alias("channel", "__x")).select(
        "vec_id", "channel", "ts", F.size("__x").alias("frames"), (F.round(_total("__x"), 5) + 0.0).alias("total"))


def _weights_sql(algorithm):
    rows = [f"('{name}', {c}, {left!r}::DOUBLE * {gain}, {right!r}::DOUBLE * {gain})" for name in _LAYOUTS
            for c, (left, right, level) in enumerate(mixing.downmix_weights(name, algorithm))
            for gain in [{"none": "0.9::DOUBLE", "center": "(1.5::DOUBLE * 0.9::DOUBLE)", "surround": "(0.8::DOUBLE * 0.9::DOUBLE)", "fixed": "1"}[level]]]
    return "w AS (SELECT * FROM (VALUES " + ", ".join(rows) + ") t(layout, c, l, r))"


def _downmix(algorithm):
    @query(f"downmix_{algorithm.replace('-', '_')}", f"""WITH {_CHUNKS}, {_weights_sql(algorithm)}
    SELECT vec_id, CAST(i AS INTEGER) AS frame, round(CAST(sum(x * l) AS FLOAT)::DOUBLE, 4) + 0 AS "left", round(CAST(sum(x * r) AS FLOAT)::DOUBLE, 4) + 0 AS "right" FROM sm JOIN w USING (layout, c) GROUP BY vec_id, i""")
    def build(load):
        mixed = op.downmix(_chunks(load), "layout", algorithm, center=1.5, surround=0.8, output=0.9)
        both = F.arrays_zip("left", "right")
        return mixed.select("vec_id", F.posexplode(both).alias("frame", "__s")).select(
            "vec_id", "frame", *[(F.round(F.col(f"__s.{n}").cast("double"), 4) + 0.0).alias(n) for n in ("left", "right")])

    return build


for _algorithm in mixing.FIVE_POINT_ONE:
    _downmix(_algorithm)


def _ramp_sql():
    rows = [f"('{name}', {c}, {left!r}::DOUBLE, {right!r}::DOUBLE, {level == 'fixed'})" for name in _LAYOUTS
            for c, (left, right, level) in enumerate(mixing.downmix_weights(name, "ac4"))]
    return "w AS (SELECT * FROM (VALUES " + ", ".join(rows) + ") t(layout, c, l, r, fixed))"


@query("downmix_ramp", f"""WITH {_CHUNKS}, {_ramp_sql()},
f AS (SELECT vec_id, layout, i, sum(x * l) AS a, sum(x * r) AS b, any_value(CASE WHEN fixed THEN 1 ELSE 0.5::DOUBLE + least((i + 1 + vec_id % 50 * 8) / 160::DOUBLE, 1) * 1.5::DOUBLE END) AS g FROM sm JOIN w USING (layout, c) GROUP BY ALL)
SELECT vec_id, layout, round(sum(CAST(a * g AS FLOAT)::DOUBLE), 4) + 0 AS left_total, round(sum(CAST(b * g AS FLOAT)::DOUBLE), 4) + 0 AS right_total FROM f GROUP BY ALL""")
def downmix_ramp(load):
    chunks = _chunks(load).withColumn("rate", F.lit(8000)).withColumn("position", (F.col("vec_id") % 50) * 8)
    mixed = op.downmix(chunks, "layout", "ac4", output=2.0, ramp_from=(1.0, 1.0, 0.5), rate="rate", position="position")
    return mixed.select("vec_id", "layout", *[(F.round(_total(n), 4) + 0.0).alias(f"{n}_total") for n in ("left", "right")])


# Every layout into every output layout
_ROUTES = ", ".join(
    f"('{name}', '{output}', {o}, {c}, {weight!r}::DOUBLE)" for output in OUTPUT_LAYOUTS for name in _LAYOUTS
    for o, row in enumerate(mixing.routing(name, output)[0]) for c, weight in enumerate(row))


@query("route_channels", f"""WITH {_CHUNKS}, w AS (SELECT * FROM (VALUES {_ROUTES}) t(layout, output, o, c, g)),
n AS (SELECT layout, output, bool_or(z > 1) AS sums FROM (SELECT layout, output, o, count(*) FILTER (g > 0) AS z FROM w GROUP BY ALL) GROUP BY ALL)
SELECT vec_id, output, CAST(o AS INTEGER) AS speaker, round(sum(CAST(v AS FLOAT)::DOUBLE), 4) + 0 AS total, any_value(sums) AS needs_limiter
FROM (SELECT vec_id, layout, output, o, i, sum(x * g) AS v FROM sm JOIN w USING (layout, c) GROUP BY ALL) JOIN n USING (layout, output) GROUP BY vec_id, output, o""")
def route_channels(load):
    chunks, found = _chunks(load), None
    for output in OUTPUT_LAYOUTS:
        routed = op.route_channels(chunks, "layout", output).withColumn("output", F.lit(output))
        found = routed if found is None else found.unionByName(routed)
    return found.select("vec_id", "output", "needs_limiter", F.posexplode("channels").alias("speaker", "__x")).select(
        "vec_id", "output", "speaker", (F.round(_total("__x"), 4) + 0.0).alias("total"), "needs_limiter")


def _stereo(load):
    return load("embeddings").select(
        F.expr("vec_id div 50").alias("stream_id"), "vec_id", ((F.col("vec_id") % 50) * 32).alias("start_frame"),
        F.array(*[F.transform(F.slice("embedding", n * 32 + 1, 32), lambda x: (x * 6).cast("float")) for n in range(2)]).alias("channels"))


_PCM = """pcm AS (SELECT vec_id // 50 AS stream_id, c, vec_id % 50 * 32 + i AS f, CAST(embedding[c * 32 + i + 1] * 6 AS FLOAT)::DOUBLE AS x FROM embeddings, range(2) a(c), range(32) b(i)),
ln AS (SELECT stream_id, max(f) + 1 AS n FROM pcm GROUP BY stream_id)"""


# Streams of four pairs of rates, in blocks of 512 source frames
@query("resample", f"""WITH {_PCM},
rt AS (SELECT * FROM (VALUES (0, 48000, 44100), (1, 44100, 48000), (2, 96000, 16000), (3, 48000, 48000)) t(m, src, dst)),
d AS (SELECT m, least(1, dst / src::DOUBLE) * 0.94::DOUBLE AS cut, p, t, t - 31 - p / 2048::DOUBLE AS d FROM rt, range(2049) a(p), range(64) b(t) WHERE src <> dst),
k AS (SELECT m, p, t, CASE WHEN abs(d / 32) >= 1 THEN 0 ELSE (CASE WHEN d = 0 THEN 1 ELSE sin(pi() * cut * d) / (pi() * cut * d) END) * (0.42::DOUBLE + 0.5::DOUBLE * cos(pi() * d / 32) + 0.08::DOUBLE * cos(2 * pi() * d / 32)) END AS k FROM d),
w AS (SELECT m, p, t, k / sum(k) OVER (PARTITION BY m, p) AS w FROM k),
o AS (SELECT stream_id, n, m, src, dst, unnest(range((n * dst + src - 1) // src)) AS j FROM ln JOIN rt ON m = stream_id % 4),
ps AS (SELECT *, j * src // dst AS sf, CAST(floor((j * src - j * src // dst * dst) * 2048 / dst + 0.5) AS BIGINT) AS p FROM o),
y AS (SELECT ps.stream_id, j, sf, c, CAST(sum(x * w) AS FLOAT)::DOUBLE AS y FROM ps JOIN w ON w.p = ps.p AND w.m = ps.m JOIN pcm ON pcm.stream_id = ps.stream_id AND f = least(greatest(sf - 31 + t, 0), n - 1) GROUP BY ALL
  UNION ALL SELECT ps.stream_id, j, sf, c, x FROM ps JOIN pcm ON pcm.stream_id = ps.stream_id AND f = sf WHERE src = dst)
SELECT stream_id, CAST(c AS INTEGER) AS channel, CAST(min(j) AS BIGINT) AS out_start, CAST(count(*) AS INTEGER) AS frames, round(sum(y), 3) + 0 AS total FROM y GROUP BY stream_id, c, sf // 512""")
def resample(load):
    pair = lambda rates: F.element_at(F.array(*[F.lit(rate) for rate in rates]), (F.col("stream_id") % 4 + 1).cast("int"))
    rated = _stereo(load).withColumn("source", pair([48_000, 44_100, 96_000, 48_000])).withColumn("target", pair([44_100, 48_000, 16_000, 48_000]))
    out = op.resample(rated, "stream_id", "start_frame", "source", "target", block=512)
    return out.select("stream_id", "out_start", F.posexplode("channels").alias("channel", "__x")).select(
        "stream_id", "channel", "out_start", F.size("__x").alias("frames"), (F.round(_total("__x"), 3) + 0.0).alias("total"))


@query("signal_stats", """WITH s AS (SELECT vec_id // 50 AS stream_id, vec_id * 10000 // 100000 * 100000 AS window_us, CASE WHEN i = 7 AND vec_id % 9 = 0 THEN 'nan'::DOUBLE ELSE CAST(embedding[i + 1] * 6 AS FLOAT)::DOUBLE END AS x FROM embeddings, range(64) r(i))
SELECT stream_id, window_us, count(*) FILTER (NOT isnan(x)) AS samples, max(abs(x)) FILTER (NOT isnan(x)) AS peak, round(sum(x * x) FILTER (NOT isnan(x)), 6) AS square_sum, count(*) FILTER (NOT isnan(x) AND abs(x) > 1) AS clipped, count(*) FILTER (isnan(x)) AS non_finite,
  round(10 * log10(avg(x * x) FILTER (NOT isnan(x))), 6) AS rms_dbfs, round(20 * log10(max(abs(x)) FILTER (NOT isnan(x)) / sqrt(avg(x * x) FILTER (NOT isnan(x)))), 6) AS crest_db FROM s GROUP BY ALL""")
def signal_stats(load):
    nan = F.lit(float("nan")).cast("float")
    chunks = load("embeddings").select(
        F.expr("vec_id div 50").alias("stream_id"), (F.col("vec_id") * 10_000).alias("ts"), F.array(F.transform("embedding", lambda x, i: F.when(
            (i == 7) & (F.col("vec_id") % 9 == 0), nan).otherwise((x * 6).cast("float")))).alias("channels"))
    stats = op.signal_stats(chunks, ["stream_id"], "ts", 100_000)
    return stats.select("stream_id", "window_us", "samples", "peak", F.round("square_sum", 6).alias("square_sum"), "clipped", "non_finite",
                        F.round("rms_dbfs", 6).alias("rms_dbfs"), F.round("crest_db", 6).alias("crest_db"))


@query("normalization_gain", f"""WITH {EVENTS},
g AS (SELECT event_id, CASE WHEN k % 4 = 0 THEN NULL WHEN k % 13 = 1 THEN 'inf'::DOUBLE ELSE (value - 50) / 10 END AS track, CASE WHEN k % 3 = 0 THEN NULL ELSE k / 10::DOUBLE - 5 END AS album, CASE k % 5 WHEN 0 THEN 'Off' WHEN 1 THEN 'AlbumGain' ELSE 'TrackGain' END AS mode FROM ev),
c AS (SELECT *, CASE mode WHEN 'TrackGain' THEN coalesce(track, album) WHEN 'AlbumGain' THEN coalesce(album, track) END AS db FROM g)
SELECT event_id, mode, round(CASE WHEN db IS NULL OR isinf(db) THEN 1 ELSE pow(10, db / 20) END, 9) AS linear_gain FROM c""")
def normalization_gain(load):
    items = events(load).select(
        "event_id", F.when(F.col("k") % 4 == 0, None).when(F.col("k") % 13 == 1, float("inf")).otherwise((F.col("value") - 50) / 10).alias("track"),
        F.when(F.col("k") % 3 != 0, F.col("k") / 10.0 - 5).alias("album"), F.expr("CASE k % 5 WHEN 0 THEN 'Off' WHEN 1 THEN 'AlbumGain' ELSE 'TrackGain' END").alias("mode"))
    return op.normalization_gain(items, "track", "album", "mode").select("event_id", "mode", F.round("linear_gain", 9).alias("linear_gain"))


# Every peak's ramp, and the release as a maximum of decaying reductions; streams of three rates, whose 3, 10 and 100 ms are so many frames
@query("limit_peaks", f"""WITH {_PCM},
rt AS (SELECT * FROM (VALUES (0, 144, 480, 4800), (1, 133, 441, 4410), (2, 96, 320, 3200)) t(m, short, long, fall)),
pk AS (SELECT stream_id, f, max(abs(x)) AS p FROM pcm GROUP BY ALL),
hi AS (SELECT stream_id, f, pow(10, -1 / 20::DOUBLE) / p AS need FROM pk WHERE p > pow(10, -1 / 20::DOUBLE)),
le AS (SELECT hi.*, CAST(floor(short + (long - short) * least(1, -20 * log10(need) / 12) + 0.5) AS BIGINT) AS len FROM hi JOIN rt ON m = stream_id % 3),
rp AS (SELECT stream_id, g, need, 1 - (f - g) / CAST(len AS DOUBLE) AS t FROM (SELECT *, unnest(range(greatest(f - len, 0), f + 1)) AS g FROM le)),
al AS (SELECT stream_id, g AS f, min(1 - (1 - need) * t * t * t * (t * (6 * t - 15) + 10)) AS a FROM rp GROUP BY ALL),
rd AS (SELECT pk.stream_id, pk.f, p, fall, 1 - coalesce(a, 1) AS d FROM pk JOIN rt ON m = pk.stream_id % 3 LEFT JOIN al ON pk.stream_id = al.stream_id AND pk.f = al.f),
rl AS (SELECT *, coalesce(exp(max(CASE WHEN d > 0 THEN ln(d) + f / fall::DOUBLE END) OVER (PARTITION BY stream_id ORDER BY f) - f / fall::DOUBLE), 0) AS e FROM rd)
SELECT stream_id, CAST(f // 512 AS BIGINT) AS block_no, CAST(f // 512 * 512 AS BIGINT) AS start_frame, count(*) FILTER (1 - e < 1 - 1e-7) AS limited_frames, round(min(1 - e), 6) AS minimum_gain, round(max(p), 6) AS input_peak, round(max(p * (1 - e)), 6) AS output_peak
FROM rl GROUP BY stream_id, f // 512""")
def limit_peaks(load):
    rate = F.element_at(F.array(F.lit(48_000), F.lit(44_100), F.lit(32_000)), (F.col("stream_id") % 3 + 1).cast("int"))
    out = op.limit_peaks(_stereo(load).withColumn("rate", rate), "stream_id", "start_frame", "rate", block=512)
    return out.drop("channels").withColumns({n: F.round(n, 6) for n in ("minimum_gain", "input_peak", "output_peak")})


@query("content_identity", """WITH h AS (SELECT doc_id, source, sha256(text) AS content_hash FROM documents),
g AS (SELECT content_hash, count(*) AS copies, min(doc_id) AS first_seq FROM h GROUP BY content_hash)
SELECT doc_id, source, content_hash, copies, first_seq, doc_id = first_seq AS is_first FROM h JOIN g USING (content_hash)""")
def content_identity(load):
    return op.content_identity(load("documents").select("doc_id", "source", "text"), "doc_id", "text")

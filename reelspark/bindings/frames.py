"""Frame measurement and colour operators over the test tables."""
from pyspark.sql import functions as F

from ..functions import tables as fixed
from ..operators import color, frames as op
from ..sources.lut import lut_headers, read_lut
from .catalog import luts
from .tables import EVENTS, events, query

# Embeddings as lines: 20 to a frame, ten rows and ten columns; some rows and some whole frames are black
_BLACK = """(vec_id % 20 IN (0, 9) AND (vec_id // 20) % 7 > 0) OR (vec_id // 20) % 11 = 3 OR (vec_id % 20 = 10 AND (vec_id // 20) % 3 = 0)"""
_LINES = f"""ln AS (SELECT vec_id // 100 AS stream_id, vec_id // 20 AS frame_no, CASE WHEN vec_id % 20 < 10 THEN 'row' ELSE 'column' END AS axis, vec_id % 10 AS line,
  list_transform(embedding, lambda v: CASE WHEN {_BLACK} THEN 0::DOUBLE ELSE CAST(v AS DOUBLE) * 2 + 0.3::DOUBLE + (vec_id // 20 % 5) * 0.1::DOUBLE END) AS luma FROM embeddings),
lv AS (SELECT *, list_transform(luma, lambda v: least(greatest(round_even(v * 255, 0) + 64, 0), 511)) AS lvl FROM ln),
ls AS (SELECT stream_id, frame_no, axis, line, CAST(len(list_filter(luma, lambda v: v > 0.1::DOUBLE)) AS BIGINT) AS lit, CAST(len(list_filter(luma, lambda v: v > 0.3::DOUBLE)) AS BIGINT) AS bright,
  CAST(list_sum(lvl) AS BIGINT) - 64 * len(luma) AS level_sum, CAST(list_sum(lvl) AS BIGINT) * 16384 + len(list_filter(luma, lambda v: v > 0.3::DOUBLE)) * 128 + len(list_filter(luma, lambda v: v > 0.1::DOUBLE)) AS word FROM lv)"""


def _stats(load):
    black = F.expr(_BLACK.replace("//", "div"))
    lines = load("embeddings").select(
        F.expr("vec_id div 100").alias("stream_id"), F.expr("vec_id div 20").alias("frame_no"),
        F.when(F.col("vec_id") % 20 < 10, "row").otherwise("column").alias("axis"), (F.col("vec_id") % 10).alias("line"),
        F.transform("embedding", lambda v: F.when(black, 0.0).otherwise(
            v.cast("double") * 2 + 0.3 + F.expr("vec_id div 20 % 5") * 0.1)).alias("luma"))
    return op.line_stats(lines, "luma").drop("luma")


@query("line_stats", f"WITH {_LINES} SELECT stream_id, frame_no, axis, line, lit, bright, level_sum, word FROM ls")
def line_stats(load):
    return _stats(load)


@query("line_stats_unpacked", f"WITH {_LINES} SELECT stream_id, frame_no, axis, line, lit, bright, level_sum FROM ls")
def line_stats_unpacked(load):
    packed = _stats(load).select("stream_id", "frame_no", "axis", "line", "word")
    return op.unpack_word(packed, "word").drop("word")


@query("line_stats_of_samples", """WITH s AS (SELECT l_suppkey, l_linenumber, 0.2126::DOUBLE * (l_quantity / 51) + 0.7152::DOUBLE * (l_discount * 10) + 0.0722::DOUBLE * (l_tax * 12.5::DOUBLE) AS luma FROM lineitem)
SELECT l_suppkey, l_linenumber, count(*) FILTER (luma > 0.1::DOUBLE) AS lit, count(*) FILTER (luma > 0.3::DOUBLE) AS bright,
  CAST(sum(least(greatest(round_even(luma * 255, 0) + 64, 0), 511)) AS BIGINT) - 64 * count(*) AS level_sum FROM s GROUP BY ALL""")
def line_stats_of_samples(load):
    return op.line_stats_of_samples(_samples(load), ["l_suppkey", "l_linenumber"], ("c0", "c1", "c2"))


_EXTENTS = _LINES + """, nb AS (SELECT *, level_sum > 979.2::DOUBLE OR bright >= 2 AS holds, lag(level_sum) OVER w AS up, lead(level_sum) OVER w AS dn FROM ls WINDOW w AS (PARTITION BY stream_id, frame_no, axis ORDER BY line)),
e0 AS (SELECT stream_id, frame_no, axis, count(*) AS lines, min(line) FILTER (holds) AS f, max(line) FILTER (holds) AS l,
  arg_min(bright = 0 AND level_sum < 0.5::DOUBLE * dn, line) FILTER (holds) AS fb, arg_max(bright = 0 AND level_sum < 0.5::DOUBLE * up, line) FILTER (holds) AS lb FROM nb GROUP BY ALL),
e1 AS (SELECT *, f + CASE WHEN f < l AND fb THEN 1 ELSE 0 END AS first_line FROM e0),
e2 AS (SELECT *, l - CASE WHEN l > first_line AND lb THEN 1 ELSE 0 END AS last_line FROM e1),
ex AS (SELECT e.stream_id, e.frame_no, e.axis, lines, first_line, last_line, max(lit) FILTER (line BETWEEN first_line AND least(first_line + 2, last_line)) AS start_lit,
  max(lit) FILTER (line BETWEEN greatest(last_line - 2, first_line) AND last_line) AS end_lit, first_line AS start_bar, lines - 1 - last_line AS end_bar
  FROM e2 e JOIN ls USING (stream_id, frame_no, axis) GROUP BY ALL)"""
_AXIS = ["stream_id", "frame_no", "axis"]


@query("picture_extent", f"WITH {_EXTENTS} SELECT * FROM ex")
def picture_extent(load):
    return op.picture_extent(_stats(load), _AXIS, "line")


_SHOTS = _EXTENTS + """, fr AS (SELECT stream_id, frame_no, count(first_line) = 2 AS picture, max(lines) FILTER (axis = 'row') AS rs, max(lines) FILTER (axis = 'column') AS cs FROM ex GROUP BY ALL),
lk AS (SELECT *, CASE WHEN picture AND lag(picture) OVER w AND lag(rs) OVER w = rs AND lag(cs) OVER w = cs THEN lag(frame_no) OVER w END AS before
  FROM fr WINDOW w AS (PARTITION BY stream_id ORDER BY frame_no)),
pv AS (SELECT a.stream_id, a.frame_no, a.axis, sum(abs(a.level_sum - b.level_sum)) / CAST(count(*) * 64 AS DOUBLE) AS m FROM lk JOIN ls a ON a.stream_id = lk.stream_id AND a.frame_no = lk.frame_no
  JOIN ls b ON a.stream_id = b.stream_id AND b.frame_no = lk.before AND a.axis = b.axis AND a.line = b.line GROUP BY ALL),
ch AS (SELECT stream_id, frame_no, sum(m) / 2 AS level_change FROM pv GROUP BY ALL),
st AS (SELECT stream_id, frame_no, picture, level_change, picture AND (before IS NULL OR level_change > 8) AS starts_shot FROM lk LEFT JOIN ch USING (stream_id, frame_no))"""


def _shots(load):
    stats = _stats(load)
    extents = op.frame_extents(op.picture_extent(stats, _AXIS, "line"), "stream_id", "frame_no", "axis")
    return op.shots(stats, extents, "stream_id", "frame_no", "axis", "line"), extents


@query("shots", f"""WITH {_SHOTS} SELECT stream_id, frame_no, picture, level_change, starts_shot,
  CASE WHEN picture THEN CAST(sum(starts_shot::INTEGER) OVER (PARTITION BY stream_id ORDER BY frame_no) AS BIGINT) END AS shot FROM st""")
def shots(load):
    return _shots(load)[0]


@query("crop_timeline")
def crop_timeline(load):
    numbered, extents = _shots(load)
    frames = extents.join(numbered.select("stream_id", "frame_no", "shot"), ["stream_id", "frame_no"]).withColumn(
        "ts", F.col("frame_no") * 41_708)
    return op.crop_timeline(frames, "stream_id", "frame_no", "ts", "shot")


_CROPS = """p_partkey, CAST(1080 AS BIGINT) AS rows, CAST(1920 AS BIGINT) AS columns, CAST(CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE p_size * 4 + p_partkey % 3 END AS BIGINT) AS top,
  CAST(CASE WHEN p_partkey % 4 = 0 THEN p_size * 5 ELSE 0 END AS BIGINT) AS left_bar, CAST(1920 AS BIGINT) AS width, CAST(CASE WHEN p_partkey % 9 = 0 THEN 1440 ELSE 1080 END AS BIGINT) AS height"""


@query("standard_ratio", f"""WITH rt AS (SELECT * FROM (VALUES {", ".join(f"({n}, '{name}', {ratio!r}::DOUBLE)" for n, (name, ratio) in enumerate(fixed.ASPECT_RATIOS))}) t(n, name, ratio)),
cr AS (SELECT {_CROPS} FROM part),
k AS (SELECT *, CAST(rows - 2 * top AS DOUBLE) AS kr, CAST(columns - 2 * left_bar AS DOUBLE) AS kc FROM cr),
o AS (SELECT *, width * kc * rows / (height * kr * columns) AS own FROM k),
cd AS (SELECT o.*, name, n, abs(ln(ratio / own)) AS d, kr * own / ratio AS nr, kc * ratio / own AS nc FROM o, rt),
ft AS (SELECT *, top > 0 AND nr >= kr * (1 - 0.005::DOUBLE) AND nr <= kr + 1 AS br, left_bar > 0 AND nc >= kc * (1 - 0.005::DOUBLE) AND nc <= kc + 1 AS bc FROM cd),
bs AS (SELECT p_partkey, arg_min({{'name': name, 'r': CASE WHEN br AND (NOT bc OR nr <= kr) THEN nr ELSE kr END, 'c': CASE WHEN br AND (NOT bc OR nr <= kr) THEN kc ELSE nc END}}, {{'d': d, 'n': n}}) AS b FROM ft WHERE br OR bc GROUP BY p_partkey),
rs AS (SELECT o.*, b.name AS ratio_name, coalesce(b.r, kr) AS rr, coalesce(b.c, kc) AS cc FROM o LEFT JOIN bs USING (p_partkey))
SELECT p_partkey, rows, columns, top, left_bar, width, height, ratio_name, (left_bar + (kc - cc) / 2) / columns AS crop_x, (top + (kr - rr) / 2) / rows AS crop_y, cc / columns AS crop_width, rr / rows AS crop_height FROM rs""")
def standard_ratio(load):
    from .catalog import _columns
    crops = load("part").selectExpr(*_columns(_CROPS))
    return op.standard_ratio(crops, "rows", "columns", "top", "left_bar", "width", "height")


# ---- samples --------------------------------------------------------------------------------------------------
_SAMPLES = """sm AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity / 51 AS c0, l_discount * 10 AS c1, l_tax * 12.5::DOUBLE AS c2,
  CASE l_suppkey % 4 WHEN 0 THEN 'bt709' WHEN 1 THEN 'bt2020' WHEN 2 THEN 'smpte170m' ELSE 'bt470bg' END AS primaries FROM lineitem)"""
_ID = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def _samples(load):
    return load("lineitem").select(
        *_ID, (F.col("l_quantity") / 51).alias("c0"), (F.col("l_discount") * 10).alias("c1"), (F.col("l_tax") * 12.5).alias("c2"),
        F.expr("CASE l_suppkey % 4 WHEN 0 THEN 'bt709' WHEN 1 THEN 'bt2020' WHEN 2 THEN 'smpte170m' ELSE 'bt470bg' END").alias("primaries"))


def _rounded(df, names=("r", "g", "b"), digits=4):
    # Adding zero turns a negative zero into a positive one
    return df.select(*_ID, *[(F.round(name, digits) + 0.0).alias(name) for name in names])


def _sql_out(r, g, b, digits=4):
    return f"l_orderkey, l_partkey, l_suppkey, l_linenumber, round({r}, {digits}) + 0 AS r, round({g}, {digits}) + 0 AS g, round({b}, {digits}) + 0 AS b"


def _pq(x):
    p = f"pow(least(greatest({x}, 0), 1), 1 / 78.84375::DOUBLE)"
    return (f"10000 * pow(greatest({p} - 0.8359375::DOUBLE, 0) / greatest(18.8515625::DOUBLE - 18.6875::DOUBLE * {p}, 2.220446049250313e-16::DOUBLE), 1 / 0.1593017578125::DOUBLE)")


def _code(x):
    p = f"pow(least(greatest(({x}) / 10000, 0), 1), 0.1593017578125::DOUBLE)"
    return f"pow((0.8359375::DOUBLE + 18.8515625::DOUBLE * {p}) / (1 + 18.6875::DOUBLE * {p}), 78.84375::DOUBLE)"


_PEAK = f"""{_SAMPLES}, ln AS (SELECT l_suppkey, l_partkey % 64 // 16 AS tx, l_orderkey % 64 // 16 AS ty, {_pq("c0")} / 10000 AS a, {_pq("c1")} / 10000 AS b, {_pq("c2")} / 10000 AS c FROM sm),
lt AS (SELECT *, 0.2627::DOUBLE * a + 0.678::DOUBLE * b + 0.0593::DOUBLE * c AS y, least(greatest(a, b, c, 0), 1) AS mx FROM ln),
pq AS (SELECT *, {_code("least(greatest(y, 0), 1) * 10000")} AS p FROM lt),
cd AS (SELECT *, CAST(floor(16383 * (p * least(p / 0.01::DOUBLE, 1) * least(p / 0.01::DOUBLE, 1) * (3 - 2 * least(p / 0.01::DOUBLE, 1)))) AS BIGINT) AS code, CAST(floor(65535 * mx) AS BIGINT) AS lin FROM pq),
tl AS (SELECT l_suppkey, tx, ty, count(*) FILTER (code > 0) AS act, CAST(sum(code) AS BIGINT) AS s, max(lin) AS top FROM cd GROUP BY ALL),
fr AS (SELECT l_suppkey, count(*) AS tiles, count(*) FILTER (act > 0) AS active_tiles, CAST(coalesce(sum(s // act) FILTER (act > 0), 0) AS BIGINT) AS pq_sum, coalesce(max(top) FILTER (act > 0), 0) AS max_code FROM tl GROUP BY ALL)"""


@query("peak_measure", f"WITH {_PEAK} SELECT l_suppkey, tiles, active_tiles, pq_sum, max_code FROM fr")
def peak_measure(load):
    return op.peak_measure(_pixels(load), ["l_suppkey"], "x", "y", ("c0", "c1", "c2")).select(
        "l_suppkey", "tiles", "active_tiles", "pq_sum", "max_code")


def _pixels(load):
    return _samples(load).withColumn("x", F.col("l_partkey") % 64).withColumn("y", F.col("l_orderkey") % 64)


@query("peak_measure_percentile", f"""WITH {_PEAK},
bn AS (SELECT l_suppkey, least(greatest((CAST(floor(16383 * {_code("mx * 10000")}) AS BIGINT) >> 7) - 64, 0), 63) AS bin FROM cd WHERE code > 0),
ct AS (SELECT l_suppkey, bin, count(*) AS n FROM bn GROUP BY ALL),
cu AS (SELECT *, sum(n) OVER (PARTITION BY l_suppkey ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY l_suppkey) AS total FROM ct),
ht AS (SELECT l_suppkey, min({{'bin': bin, 'upto': upto, 'n': n, 'total': total}}) AS h FROM cu WHERE upto >= ceil(0.9::DOUBLE * total) AND ceil(0.9::DOUBLE * total) < total GROUP BY ALL),
pk AS (SELECT fr.l_suppkey, {_code("max_code / 65535 * 10000")} AS top, h, ceil(0.9::DOUBLE * h.total) AS want, ((h.bin + 64) << 7) / 16383 AS low, ((h.bin + 65) << 7) / 16383 AS edge FROM fr LEFT JOIN ht USING (l_suppkey))
SELECT l_suppkey, round(CASE WHEN h IS NULL THEN top ELSE low + (CASE WHEN h.upto + 1 > h.total THEN greatest(top, low) ELSE edge END - low) * ((want - (h.upto - h.n)) / CAST(h.upto + 1 - (h.upto - h.n) AS DOUBLE)) END, 6) AS frame_peak_pq FROM pk""")
def peak_measure_percentile(load):
    measured = op.peak_measure(_pixels(load), ["l_suppkey"], "x", "y", ("c0", "c1", "c2"), percentile=90)
    return measured.select("l_suppkey", F.round("frame_peak_pq", 6).alias("frame_peak_pq"))


def _nits(code):
    p = f"pow(least(greatest({code}, 0), 1), 1 / 78.84375::DOUBLE)"
    return f"(10000 * pow(greatest({p} - 0.8359375::DOUBLE, 0) / greatest(18.8515625::DOUBLE - 18.6875::DOUBLE * {p}, 1e-7::DOUBLE), 1 / 0.1593017578125::DOUBLE))"


# A twentieth's decay smooths; a jump of one to three hundredths, weighted by the active tiles, fades the smoothing out
@query("peak_smooth", f"""WITH RECURSIVE {_PEAK},
ms AS (SELECT l_suppkey // 10 AS stream_id, l_suppkey, row_number() OVER (PARTITION BY l_suppkey // 10 ORDER BY l_suppkey) AS n, active_tiles / tiles::DOUBLE AS share,
  CASE WHEN active_tiles > 0 THEN pq_sum::DOUBLE / (active_tiles * 16383) ELSE 1e-6::DOUBLE END AS a,
  CASE WHEN active_tiles > 0 THEN {_code("max_code / 65535 * 10000")} ELSE 1e-6::DOUBLE END AS p FROM fr),
sp AS (
  SELECT stream_id, l_suppkey, n, a, p FROM ms WHERE n = 1
  UNION ALL
  SELECT stream_id, l_suppkey, n, sa + (na - sa) * mix, sp + (np - sp) * mix
  FROM (SELECT *, near * near * (3 - 2 * near) AS mix
    FROM (SELECT *, least(greatest((share * abs(na - sa) - 0.01::DOUBLE) / 0.02::DOUBLE, 0), 1) AS near
      FROM (SELECT *, oa + (1 - exp(-1 / 20::DOUBLE)) * (na - oa) AS sa, op + (1 - exp(-1 / 20::DOUBLE)) * (np - op) AS sp
        FROM (SELECT ms.stream_id, ms.l_suppkey, ms.n, share, sp.a AS oa, sp.p AS op, CASE WHEN abs(ms.a - sp.a) < 1 / 16383::DOUBLE THEN sp.a ELSE ms.a END AS na,
            CASE WHEN abs(ms.p - sp.p) < 1 / 16383::DOUBLE THEN sp.p ELSE ms.p END AS np FROM sp JOIN ms ON ms.stream_id = sp.stream_id AND ms.n = sp.n + 1)))))
SELECT stream_id, l_suppkey, round(a, 6) AS average_pq, round(p, 6) AS peak_pq, round(greatest(203, {_nits("p")}), 3) AS scene_peak_nits,
  round(least(greatest(203, {_nits("p")}), {_nits("a")}), 3) AS scene_average_nits FROM sp""")
def peak_smooth(load):
    """Ten frames to a stream, from the peak measurement of every frame."""
    measured = op.peak_measure(_pixels(load), ["l_suppkey"], "x", "y", ("c0", "c1", "c2")).withColumn(
        "stream_id", F.expr("l_suppkey div 10"))
    smoothed = op.peak_smooth(measured, "stream_id", "l_suppkey")
    return smoothed.withColumns({name: F.round(name, digits) for name, digits in (
        ("average_pq", 6), ("peak_pq", 6), ("scene_peak_nits", 3), ("scene_average_nits", 3))})


_YUV = """yv AS (SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN 'full' ELSE 'limited' END AS range, CASE WHEN l_linenumber % 3 = 0 THEN 8 ELSE 10 END AS depth,
  CASE l_linenumber % 3 WHEN 0 THEN 'bt709' WHEN 1 THEN 'bt2020-ncl' ELSE 'smpte170m' END AS m FROM sm),
ex AS (SELECT *, pow(2::DOUBLE, depth) - 1 AS top, pow(2::DOUBLE, depth - 1) AS mid, pow(2::DOUBLE, depth - 8) AS sc FROM yv),
en AS (SELECT *, CASE WHEN range = 'full' THEN c0 ELSE (c0 * top - 16 * sc) / (219 * sc) END AS y, CASE WHEN range = 'full' THEN c1 - mid / top ELSE (c1 * top - mid) / (224 * sc) END AS u,
  CASE WHEN range = 'full' THEN c2 - mid / top ELSE (c2 * top - mid) / (224 * sc) END AS v FROM ex),
wt AS (SELECT *, CASE m WHEN 'bt709' THEN 0.2126::DOUBLE WHEN 'bt2020-ncl' THEN 0.2627::DOUBLE ELSE 0.299::DOUBLE END AS wr, CASE m WHEN 'bt709' THEN 0.7152::DOUBLE WHEN 'bt2020-ncl' THEN 0.678::DOUBLE ELSE 0.587::DOUBLE END AS wg,
  CASE m WHEN 'bt709' THEN 0.0722::DOUBLE WHEN 'bt2020-ncl' THEN 0.0593::DOUBLE ELSE 0.114::DOUBLE END AS wb FROM en),
rb AS (SELECT *, y + 2 * (1 - wr) * v AS rr, y + 2 * (1 - wb) * u AS bb FROM wt)"""


@query("yuv_to_rgb", f"WITH {_SAMPLES}, {_YUV} SELECT {_sql_out('rr', '(y - wr * rr - wb * bb) / wg', 'bb')} FROM rb")
def yuv_to_rgb(load):
    samples = _samples(load).withColumn("range", F.when(F.col("l_linenumber") % 2 == 0, "full").otherwise("limited")).withColumn(
        "depth", F.when(F.col("l_linenumber") % 3 == 0, 8).otherwise(10)).withColumn(
        "m", F.expr("CASE l_linenumber % 3 WHEN 0 THEN 'bt709' WHEN 1 THEN 'bt2020-ncl' ELSE 'smpte170m' END"))
    return _rounded(color.yuv_to_rgb(samples, ("c0", "c1", "c2"), "range", "depth", "m"))


_LUM = {"bt709": (0.2126, 0.7152, 0.0722), "bt2020": (0.2627, 0.678, 0.0593), "smpte170m": (0.212376, 0.70106, 0.086564), "bt470bg": (0.222004, 0.706655, 0.071341)}
_HLG = "(CASE WHEN {c} <= 0.5 THEN {c} * {c} / 3 ELSE (exp(({c} - 0.559910729529562::DOUBLE) / 0.17883277::DOUBLE) + 0.28466892::DOUBLE) / 12 END)"


def _sql_case(column, choices, otherwise="NULL"):
    return f"CASE {column} " + " ".join(f"WHEN '{name}' THEN {text}" for name, text in choices.items()) + f" ELSE {otherwise} END"


def _sql_row(row, names):
    return "(" + " + ".join(f"{name} * {weight!r}::DOUBLE" for name, weight in zip(names, row)) + ")"


def _sdr(x):
    return f"(100 * CASE WHEN {x} < 0.081::DOUBLE THEN {x} / 4.5::DOUBLE ELSE pow(({x} + 0.099::DOUBLE) / 1.099::DOUBLE, 1 / 0.45::DOUBLE) END)"


_NITS = f"""tr AS (SELECT *, CASE l_linenumber % 3 WHEN 0 THEN 'pq' WHEN 1 THEN 'sdr' ELSE 'hlg' END AS tf, {_HLG.format(c="least(greatest(c0, 0), 1)")} AS h0, {_HLG.format(c="least(greatest(c1, 0), 1)")} AS h1, {_HLG.format(c="least(greatest(c2, 0), 1)")} AS h2 FROM sm),
sl AS (SELECT *, {_sql_case("primaries", {n: _sql_row(w, ("h0", "h1", "h2")) for n, w in _LUM.items()})} AS y FROM tr),
sc AS (SELECT *, CASE WHEN y > 0 THEN 1000 * pow(y, 0.2::DOUBLE) ELSE 0 END AS k FROM sl)"""


@query("to_nits", f"""WITH {_SAMPLES}, {_NITS} SELECT {_sql_out(*[f"CASE tf WHEN 'pq' THEN {_pq(c)} WHEN 'sdr' THEN {_sdr(c)} ELSE {h} * k END" for c, h in zip(("c0", "c1", "c2"), ("h0", "h1", "h2"))])} FROM sc""")
def to_nits(load):
    samples = _samples(load).withColumn("tf", F.expr("CASE l_linenumber % 3 WHEN 0 THEN 'pq' WHEN 1 THEN 'sdr' ELSE 'hlg' END")).withColumn(
        "white", F.lit(100.0)).withColumn("peak", F.lit(1000.0))
    return _rounded(color.to_nits(samples, ("c0", "c1", "c2"), "tf", "primaries", "white", "peak"))


@query("pq_oetf", f"WITH {_SAMPLES} SELECT {_sql_out(*[_code(f'{c} * 1000') for c in ('c0', 'c1', 'c2')], digits=6)} FROM sm")
def pq_oetf(load):
    nits = _samples(load).withColumns({f"n{n}": F.col(f"c{n}") * 1000 for n in range(3)})
    return _rounded(color.pq_oetf(nits, ("n0", "n1", "n2")), digits=6)


def _sql_matrix(column, matrices, names, otherwise):
    return [_sql_case(column, {n: _sql_row(rows[i], names) for n, rows in matrices.items()}, otherwise[i]) for i in range(3)]


def _sql_gamut():
    from ..functions import color as c
    to = _sql_matrix("primaries", c.TO_BT709, ("c0", "c1", "c2"), ("c0", "c1", "c2"))
    back = _sql_matrix("target", c.FROM_BT709, ("t0", "t1", "t2"), ("t0", "t1", "t2"))
    return f"""tg AS (SELECT *, CASE l_linenumber % 3 WHEN 0 THEN 'bt709' WHEN 1 THEN 'bt2020' ELSE 'smpte170m' END AS target, {to[0]} AS t0, {to[1]} AS t1, {to[2]} AS t2 FROM sm),
gm AS (SELECT *, CASE WHEN primaries = target THEN c0 ELSE {back[0]} END AS x, CASE WHEN primaries = target THEN c1 ELSE {back[1]} END AS y, CASE WHEN primaries = target THEN c2 ELSE {back[2]} END AS z FROM tg)"""


@query("convert_gamut", f"WITH {_SAMPLES}, {_sql_gamut()} SELECT {_sql_out('x', 'y', 'z', digits=9)} FROM gm")
def convert_gamut(load):
    samples = _samples(load).withColumn("target", F.expr("CASE l_linenumber % 3 WHEN 0 THEN 'bt709' WHEN 1 THEN 'bt2020' ELSE 'smpte170m' END"))
    return _rounded(color.convert_gamut(samples, ("c0", "c1", "c2"), "primaries", "target"), digits=9)


# Each primaries' weights to cone responses, and back
_CONES = """cn AS (SELECT * FROM (VALUES
  ('bt709', [0.295764080594::DOUBLE, 0.623072450736, 0.081166749035, 0.156191976513, 0.727251644307, 0.116557934317, 0.035102284710, 0.156589948771, 0.808303025242],
    [6.173532657683::DOUBLE, -5.320898820809, 0.147354885063, -1.324031910094, 2.560269770177, -0.236238618417, -0.011598387923, -0.264921446713, 1.276526337036]),
  ('bt2020', [0.412036386719::DOUBLE, 0.523911912035, 0.064054981611, 0.166660218723, 0.720395213485, 0.112946122929, 0.024112358560, 0.075474962757, 0.900407937406],
    [3.436814829107::DOUBLE, -2.506773801082, 0.069951928006, -0.791058237834, 1.983601669423, -0.192544834310, -0.025726806109, -0.099141766410, 1.124874144431]),
  ('smpte170m', [0.288824557305::DOUBLE, 0.616246090240, 0.094932632820, 0.159484800122, 0.709703043629, 0.130813711386, 0.034452280391, 0.149462853268, 0.816080125064],
    [6.650620511838::DOUBLE, -5.807971795602, 0.157339245483, -1.493185948114, 2.762264193554, -0.269078918721, -0.007294884663, -0.260707262076, 1.268008588083]),
  ('bt470bg', [0.308790479740::DOUBLE, 0.611003281765, 0.080209518860, 0.163071172342, 0.721747060290, 0.115183322506, 0.036648301964, 0.164576554862, 0.798770401897],
    [5.857246129788::DOUBLE, -4.988429866809, 0.131172902735, -1.324031910094, 2.560269770177, -0.236238618417, 0.004064353714, -0.298637623081, 1.294579858417])) t(primaries, w, v))"""
_ROW = "({m}[{0}] * {a} + {m}[{1}] * {b} + {m}[{2}] * {c})"


def _rows(matrix, a, b, c):
    return [_ROW.format(3 * n + 1, 3 * n + 2, 3 * n + 3, m=matrix, a=a, b=b, c=c) for n in range(3)]


@query("ipt_round_trip", f"""WITH {_SAMPLES}, {_CONES},
nt AS (SELECT sm.primaries, w, v, c0 * 1000 AS n0, c1 * 1000 AS n1, c2 * 1000 AS n2 FROM sm JOIN cn ON sm.primaries = cn.primaries),
lm AS (SELECT *, {", ".join(f"{_code(x)} AS l{n}" for n, x in enumerate(_rows("w", "greatest(n0, 0)", "greatest(n1, 0)", "greatest(n2, 0)")))} FROM nt),
ip AS (SELECT *, 0.4::DOUBLE * l0 + 0.4::DOUBLE * l1 + 0.2::DOUBLE * l2 AS i, 4.455::DOUBLE * l0 - 4.851::DOUBLE * l1 + 0.396::DOUBLE * l2 AS p,
  0.8056::DOUBLE * l0 + 0.3572::DOUBLE * l1 - 1.1628::DOUBLE * l2 AS t FROM lm),
bk AS (SELECT *, {_nits("i + 0.0975689::DOUBLE * p + 0.205226::DOUBLE * t")} AS b0, {_nits("i - 0.113876::DOUBLE * p + 0.133217::DOUBLE * t")} AS b1,
  {_nits("i + 0.0326151::DOUBLE * p - 0.676887::DOUBLE * t")} AS b2 FROM ip),
er AS (SELECT primaries, greatest({", ".join(f"abs({x} - n{n})" for n, x in enumerate(_rows("v", "b0", "b1", "b2")))}) AS e FROM bk)
SELECT primaries, count(*) AS samples, round(max(e), 2) AS maximum_error_nits FROM er GROUP BY primaries""")
def ipt_round_trip(load):
    """Linear light to IPTPQc4 and back, with the greatest error per primaries."""
    samples = _samples(load).withColumns({f"n{n}": F.col(f"c{n}") * 1000 for n in range(3)})
    back = color.ipt_to_nits(color.nits_to_ipt(samples, ("n0", "n1", "n2"), "primaries"), ("i", "p", "t"), "primaries")
    error = F.greatest(*[F.abs(F.col(a) - F.col(b)) for a, b in zip(("r", "g", "b"), ("n0", "n1", "n2"))])
    return back.groupBy("primaries").agg(F.count(F.lit(1)).alias("samples"), F.round(F.max(error), 2).alias("maximum_error_nits"))


def _curve(x, operator):
    if operator == "reinhard":
        return f"(greatest({x}, 0) / (1 + greatest({x}, 0)))"
    return f"least(greatest(({x} * (2.51::DOUBLE * {x} + 0.03::DOUBLE)) / ({x} * (2.43::DOUBLE * {x} + 0.59::DOUBLE) + 0.14::DOUBLE), 0), 1)"


def _sql_tone(operator):
    from ..functions import color as c
    to = _sql_matrix("primaries", c.TO_BT709, ("n0", "n1", "n2"), ("n0", "n1", "n2"))
    peak = _curve("(1000 / 203::DOUBLE)", operator)
    light = _curve("(lum / 203::DOUBLE)", operator)
    parts = [f"CASE WHEN lum <= 0 THEN 0 ELSE least(greatest(e{n} * (mp / lum) + (mp - e{n} * (mp / lum)) * hi, 0), 100) END" for n in range(3)]
    return f"""nt AS (SELECT *, c0 * 1200 AS n0, c1 * 1200 AS n1, c2 * 1200 AS n2 FROM sm),
gt AS (SELECT *, {", ".join(f"greatest(({to[n]}), 0) AS e{n}" for n in range(3))} FROM nt),
lm AS (SELECT *, {_sql_row((0.2126, 0.7152, 0.0722), ("e0", "e1", "e2"))} AS lum FROM gt),
mp AS (SELECT *, 100 * least(greatest({light} / {peak}, 0), 1) AS mp, 0.5::DOUBLE * least(greatest((lum - 203) / 797::DOUBLE, 0), 1) AS hi FROM lm)
SELECT {_sql_out(*parts)} FROM mp"""


def _tone(load, operator):
    samples = _samples(load).withColumns({f"n{n}": F.col(f"c{n}") * 1200 for n in range(3)})
    return color.tone_map(samples, ("n0", "n1", "n2"), "primaries", operator)


@query("tone_map_aces", f"WITH {_SAMPLES}, {_sql_tone('aces')}")
def tone_map_aces(load):
    return _rounded(_tone(load, "aces"))


@query("tone_map_reinhard", f"WITH {_SAMPLES}, {_sql_tone('reinhard')}")
def tone_map_reinhard(load):
    return _rounded(_tone(load, "reinhard"))


def _oetf(nits):
    power = min(max(nits / 10_000, 0), 1) ** (2610 / 16384)
    return ((3424 / 4096 + 2413 / 128 * power) / (1 + 2392 / 128 * power)) ** (2523 / 32)


def _eotf(code):
    power = code ** (32 / 2523)
    return 10_000 * (max(power - 3424 / 4096, 0) / (2413 / 128 - 2392 / 128 * power)) ** (16384 / 2610)


def _knee_of(low, high, out_low, out_high):
    """The static knee between PQ ends: with both at 40 % the tuning is zero."""
    source = low + (high - low) * 0.4
    adapted = out_low + (out_high - out_low) * 0.4
    wanted = source + (adapted - source) * 0.4
    return source, min(max(wanted, out_low + (out_high - out_low) * 0.1), out_low + (out_high - out_low) * 0.8)


def _num(value):
    return f"({value!r}::DOUBLE)"


def _spline_sql():
    low, high, out_low, out_high = _oetf(1e-6), _oetf(1000), _oetf(0.1), _oetf(100)
    source, target = _knee_of(low, high, out_low, out_high)
    slope = ((target - out_low) / (source - low)) ** (0.5 * min(max(1.5 * (high / out_high - 1), 0.2), 1.2))
    a, b, x, y = low - source, high - source, out_low - target, out_high - target
    below, twice = (x - slope * a) / (a * a), 2 * b * b
    cubic, square = (slope * b - y) / (b * twice), -3 * (slope * b - y) / twice
    at = f"(least(greatest(i, {_num(low)}), {_num(high)}) - {_num(source)})"
    mapped = (f"CASE WHEN {at} > 0 THEN (({_num(cubic)} * {at} + {_num(square)}) * {at} + {_num(slope)}) * {at} "
              f"ELSE ({_num(below)} * {at} + {_num(slope)}) * {at} END")
    return f"least(greatest({mapped} + {_num(target)}, {_num(out_low)}), {_num(out_high)})"


def _bezier_sql():
    import math
    source, target = _knee_of(_oetf(1e-6), _oetf(1000), _oetf(0.1), _oetf(100))
    knee_x, knee_y = _eotf(source) / 1000, (_eotf(target) - 0.1) / 99.9
    slope = knee_y / knee_x * (1 - knee_x) / (1 - knee_y)
    degree = min(max(math.ceil(slope), 2), 16)
    intercept = min(slope / degree, 1)
    x = f"least(greatest({_pq('i')} / 1000, 0), 1)"
    at = f"least(greatest(({x} - {_num(knee_x)}) / {_num(1 - knee_x)}, 0), 1)"
    curve = (f"CASE WHEN {x} <= {_num(knee_x)} THEN {x} * {_num(knee_y / knee_x)} ELSE {_num(knee_y)} + {_num(1 - knee_y)} * "
             f"(1 - pow(1 - {at}, {degree}) - {degree} * {at} * pow(1 - {at}, {degree - 1}) * {_num(1 - intercept)}) END")
    return _code(f"({curve}) * 100")


def _sql_perceptual(mapped, floor):
    from ..functions import color as c
    lms = _sql_matrix("primaries", c.RGB_TO_LMS, ("n0", "n1", "n2"), ("NULL",) * 3)
    back = [_sql_row(row, ("q0", "q1", "q2")) for row in c.LMS_TO_RGB["bt709"]]
    grey = [_sql_row(row, ("g0", "g0", "g0")) for row in c.LMS_TO_RGB["bt709"]]
    fits = [f"CASE WHEN x{n} > 100 AND x{n} - z{n} > 0 THEN (100 - z{n}) / (x{n} - z{n}) WHEN x{n} < 0 AND x{n} - z{n} < 0 THEN -z{n} / (x{n} - z{n}) ELSE 1 END" for n in range(3)]
    out = [f"least(greatest(z{n} + (x{n} - z{n}) * (h * (1 - 0.5::DOUBLE * (1 - h) * (1 - h))), 0), 100)" for n in range(3)]
    if floor:
        out = [f"greatest({value} - {_num(0.1)}, 0) * {_num(100 / 99.9)}" for value in out]
    hull = "(({0} - 6) * {0} + 9) * {0}"
    return f"""nt AS (SELECT *, c0 * 1200 AS n0, c1 * 1200 AS n1, c2 * 1200 AS n2 FROM sm),
lm AS (SELECT *, {", ".join(f"{_code(lms[n])} AS l{n}" for n in range(3))} FROM nt),
ip AS (SELECT *, {", ".join(f"{_sql_row(row, ('l0', 'l1', 'l2'))} AS {name}" for row, name in zip(c.LMS_TO_IPT, "ipt"))} FROM lm),
mp AS (SELECT *, {mapped} AS m FROM ip),
ch AS (SELECT *, least(greatest(least(i / nullif(m, 0), {hull.format("m")} / greatest({hull.format("i")}, 2.220446049250313e-16::DOUBLE)), 0), 1) AS k FROM mp),
tq AS (SELECT *, {", ".join(f"{_pq(_sql_row(row, ('m', 'p * k', 't * k')))} AS q{n}" for n, row in enumerate(c.IPT_TO_LMS))}, {_pq("m")} AS g0 FROM ch),
xs AS (SELECT *, {", ".join(f"{back[n]} AS x{n}, {grey[n]} AS z{n}" for n in range(3))} FROM tq),
hd AS (SELECT *, least(greatest(least({", ".join(fits)}, 1), 0), 1) AS h FROM xs)
SELECT {_sql_out(*[f"CASE WHEN i <= 2.220446049250313e-16 OR m <= 2.220446049250313e-16 THEN 0 ELSE {value} END" for value in out])} FROM hd"""


@query("tone_map_spline", f"WITH {_SAMPLES}, {_sql_perceptual(_spline_sql(), True)}")
def tone_map_spline(load):
    return _rounded(_tone(load, "spline"))


@query("tone_map_st2094_40", f"WITH {_SAMPLES}, {_sql_perceptual(_bezier_sql(), False)}")
def tone_map_st2094_40(load):
    return _rounded(_tone(load, "st2094-40"))


_ENCODED = """rw AS (SELECT l_suppkey, c0 * 1.1::DOUBLE AS a, c1 AS b, c2 - 0.1::DOUBLE AS c FROM sm),
en AS (SELECT l_suppkey, a < 0 OR a > 1 OR b < 0 OR b > 1 OR c < 0 OR c > 1 AS cl, """ + ", ".join(
    f"CASE WHEN least(greatest({x}, 0), 1) <= 0.0031308::DOUBLE THEN 12.92::DOUBLE * least(greatest({x}, 0), 1) ELSE 1.055::DOUBLE * pow(least(greatest({x}, 0), 1), 1 / 2.4::DOUBLE) - 0.055::DOUBLE END AS e{x}"
    for x in "abc") + """ FROM rw),
lm AS (SELECT *, ea * 0.2126::DOUBLE + eb * 0.7152::DOUBLE + ec * 0.0722::DOUBLE AS y FROM en)"""


@query("encode_display", f"""WITH {_SAMPLES}, {_ENCODED} SELECT l_suppkey, count(*) AS samples, {", ".join(
    f"round(avg(least(greatest((y + (e{x} - y) * 1.2::DOUBLE - 0.5::DOUBLE) * 0.9::DOUBLE + 0.5::DOUBLE + 0.02::DOUBLE, 0), 1)), 6) AS mean_{n}" for x, n in zip("abc", "rgb"))},
  round(avg(cl::INTEGER), 6) AS clipped_share FROM lm GROUP BY l_suppkey""")
def encode_display(load):
    samples = _samples(load).withColumns({"n0": F.col("c0") * 1.1, "n1": F.col("c1"), "n2": F.col("c2") - 0.1})
    encoded = color.encode_display(samples, ("n0", "n1", "n2"), 1.0, saturation=1.2, contrast=0.9, brightness=0.02)
    summary = color.display_summary(encoded, "l_suppkey")
    return summary.select("l_suppkey", "samples", *[F.round(n, 6).alias(n) for n in ("mean_r", "mean_g", "mean_b", "clipped_share")])


@query("reshape", f"""WITH {_SAMPLES}, cv AS (SELECT s_suppkey, 0.2::DOUBLE + (s_suppkey % 5) * 0.1::DOUBLE AS p, s_acctbal / 100000 AS q FROM supplier),
j AS (SELECT sm.*, p, q FROM sm JOIN cv ON l_suppkey = s_suppkey)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {", ".join(f"least(greatest(CASE WHEN c{n} >= p THEN (q * c{n} + 0.5::DOUBLE) * c{n} + 0.1::DOUBLE ELSE (0.2::DOUBLE * c{n} + q) * c{n} + 0.05::DOUBLE END, 0.05::DOUBLE), 0.95::DOUBLE) AS {name}" for n, name in enumerate("rgb"))} FROM j""")
def reshape(load):
    cut = F.lit(0.2) + (F.col("s_suppkey") % 5) * 0.1
    q = F.col("s_acctbal") / 100000
    none = F.array().cast("array<array<double>>")
    segment = lambda *k: F.struct(F.array(*k).alias("coefficients"), none.alias("mmr"))
    curve = F.struct(
        F.array(F.lit(0.05), cut, F.lit(0.95)).alias("pivots"),
        F.array(segment(F.lit(0.05), q, F.lit(0.2)), segment(F.lit(0.1), F.lit(0.5), q)).alias("segments"))
    curves = load("supplier").select(F.col("s_suppkey").alias("l_suppkey"), *[curve.alias(f"curve{n}") for n in range(3)])
    shaped = color.reshape(_samples(load), curves, "l_suppkey", ("c0", "c1", "c2"), out=("r", "g", "b"))
    return shaped.select(*_ID, "r", "g", "b")


@query("apply_lut", f"""WITH {_SAMPLES}, lt AS (SELECT s_suppkey, s_acctbal / 10000 AS a FROM supplier WHERE s_suppkey % 7 IN (5, 6)),
j AS (SELECT sm.*, a, 0.1::DOUBLE * (least(c0 / 2, 1) + 2 * least(c1 / 2, 1) + 4 * least(c2 / 2, 1)) AS n FROM sm LEFT JOIN lt ON l_suppkey = s_suppkey)
SELECT {_sql_out('a + n', '2 * a + n', '3 * a + n', digits=6)} FROM j""")
def apply_lut(load):
    tables = luts(load).withColumnRenamed("s_suppkey", "l_suppkey")
    graded = color.apply_lut(
        _samples(load), read_lut(tables, "l_suppkey", "cube"), lut_headers(tables, "l_suppkey", "cube"), "l_suppkey", ("c0", "c1", "c2"))
    return _rounded(graded, digits=6)


_FIT = """rc AS (SELECT l_suppkey % 10 AS stream_id, c0 AS r, c1 AS g, c2 AS b, c0 * 0.2126::DOUBLE + c1 * 0.7152::DOUBLE + c2 * 0.0722::DOUBLE AS y FROM sm WHERE c0 > 0 AND c0 < 1 AND c1 > 0 AND c1 < 1 AND c2 > 0 AND c2 < 1),
cp AS (SELECT stream_id, 0 AS component, y * 876 + 64 AS x FROM rc UNION ALL SELECT stream_id, 1, (b - y) / 1.8556::DOUBLE * 896 + 512 FROM rc UNION ALL SELECT stream_id, 2, (r - y) / 1.5748::DOUBLE * 896 + 512 FROM rc),
cc AS (SELECT *, CASE WHEN stream_id = 3 THEN 500 WHEN stream_id = 4 THEN floor(x * 2) ELSE floor(x * 0.95::DOUBLE + 12.3::DOUBLE) END AS code FROM cp)"""


@query("fit_levels", f"""WITH {_SAMPLES}, {_FIT}, ft AS (SELECT stream_id, component, count(*) AS samples, min(code) AS lo, max(code) AS hi, regr_slope(code, x) AS gain, regr_intercept(code, x) AS o FROM cc GROUP BY ALL)
SELECT stream_id, component, samples, round(gain, 6) + 0 AS gain, round(o, 4) + 0 AS "offset", CASE WHEN lo = hi THEN 'few-codes' WHEN gain BETWEEN 0.8 AND 1.25 AND abs(o) <= 128 THEN 'ok' ELSE 'out-of-bounds' END AS fit_status FROM ft""")
def fit_levels(load):
    r, g, b = F.col("c0"), F.col("c1"), F.col("c2")
    luma = r * 0.2126 + g * 0.7152 + b * 0.0722
    recovered = [luma * 876 + 64, (b - luma) / 1.8556 * 896 + 512, (r - luma) / 1.5748 * 896 + 512]
    samples = _samples(load).withColumn("stream_id", F.col("l_suppkey") % 10)
    samples = samples.withColumns({f"code{n}": F.when(F.col("stream_id") == 3, 500.0).when(
        F.col("stream_id") == 4, F.floor(x * 2).cast("double")).otherwise(F.floor(x * 0.95 + 12.3).cast("double")) for n, x in enumerate(recovered)})
    fits = op.fit_levels(samples, "stream_id", ("c0", "c1", "c2"), ("code0", "code1", "code2"))
    return fits.select("stream_id", "component", "samples", (F.round("gain", 6) + 0.0).alias("gain"), (F.round("offset", 4) + 0.0).alias("offset"), "fit_status")


@query("compare_observations", f"""WITH {EVENTS}, ob AS (SELECT user_id AS run_id, event_id AS x, k AS y, value / 100 AS e, value / 100 + CASE WHEN user_id % 3 = 0 THEN (k % 5) * 0.01::DOUBLE ELSE 0 END AS a,
  user_id % 10 = 1 AND k % 50 = 0 AS gone, user_id % 10 = 2 AND k % 50 = 0 AS more, user_id % 10 = 4 AND k = 7 AS nan FROM ev),
jd AS (SELECT *, CASE WHEN NOT gone AND NOT more AND NOT nan THEN abs(e - a) END AS err FROM ob),
g AS (SELECT run_id, count(*) FILTER (gone) AS missing, count(*) FILTER (more) AS extra, count(*) FILTER (nan) AS non_finite, max(err) AS maximum_error,
  arg_min({{'x': x, 'y': y}}, {{'d': -err, 'x': x, 'y': y}}) FILTER (err IS NOT NULL) AS w FROM jd GROUP BY run_id)
SELECT run_id, missing, extra, non_finite, maximum_error, CASE WHEN maximum_error > 0 THEN w.x END AS worst_x, CASE WHEN maximum_error > 0 THEN w.y END AS worst_y,
  missing + extra + non_finite = 0 AND coalesce(maximum_error, 0) <= 3 / 255::DOUBLE AS accepted FROM g""")
def compare_observations(load):
    ev = events(load).select("user_id", "event_id", "k", (F.col("value") / 100).alias("e")).withColumnsRenamed({"user_id": "run_id", "event_id": "x", "k": "y"})
    run = F.col("run_id")
    expected = ev.where(~((run % 10 == 2) & (F.col("y") % 50 == 0))).select("run_id", "x", "y", *[F.col("e").alias(n) for n in "rgb"])
    a = F.col("e") + F.when(run % 3 == 0, (F.col("y") % 5) * 0.01).otherwise(0.0)
    actual = ev.where(~((run % 10 == 1) & (F.col("y") % 50 == 0))).select("run_id", "x", "y", F.when(
        (run % 10 == 4) & (F.col("y") == 7), float("nan")).otherwise(a).alias("r"), F.col("e").alias("g"), a.alias("b"))
    return op.compare_observations(expected, actual, "run_id", ["x", "y"], ("r", "g", "b"))


@query("golden_check", """WITH f AS (SELECT doc_id // 5 AS stream_id, doc_id % 5 AS frame_no, text FROM documents),
g AS (SELECT DISTINCT stream_id, 0 AS first_frame, stream_id % 7 AS last_frame FROM f WHERE stream_id % 6 > 0),
h AS (SELECT f.stream_id, count(*) AS n, sha256(string_agg(text, '' ORDER BY frame_no)) AS sha FROM f JOIN g ON f.stream_id = g.stream_id AND frame_no BETWEEN first_frame AND last_frame GROUP BY f.stream_id),
s AS (SELECT DISTINCT stream_id FROM f)
SELECT s.stream_id, CASE WHEN g.stream_id IS NULL THEN 'unverified' WHEN coalesce(n, 0) < last_frame + 1 THEN 'frames-missing' WHEN s.stream_id % 2 = 0 THEN 'passed' ELSE 'hash-mismatch' END AS code, sha AS measured_sha256
FROM s LEFT JOIN g ON s.stream_id = g.stream_id LEFT JOIN h ON s.stream_id = h.stream_id""")
def golden_check(load):
    frames = load("documents").select(
        F.expr("doc_id div 5").alias("stream_id"), (F.col("doc_id") % 5).alias("frame_no"), F.encode("text", "UTF-8").alias("bytes"), "text")
    shown = F.transform(F.array_sort(F.collect_list(F.when(
        F.col("frame_no") <= F.col("stream_id") % 7, F.struct("frame_no", "text")))), lambda frame: frame["text"])
    # The true hash for every other stream
    golden = frames.where("stream_id % 6 > 0").groupBy("stream_id").agg(F.sha2(F.array_join(shown, ""), 256).alias("sha")).select(
        "stream_id", F.lit(0).alias("first_frame"), (F.col("stream_id") % 7).alias("last_frame"),
        F.when(F.col("stream_id") % 2 == 0, F.col("sha")).otherwise("0" * 64).alias("sha256"))
    return op.golden_check(frames, golden, "stream_id", "frame_no", "bytes")

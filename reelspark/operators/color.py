"""Colour operators over sample tables (F8-F14): components stay columns, so a chain is one projection."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import color as c
from ..functions.numbers import clamp

RGB = ("r", "g", "b")


def _cols(names) -> list[Column]:
    return [F.col(name) for name in names]


def _with(df: DataFrame, names, values) -> DataFrame:
    return df.withColumns(dict(zip(names, values)))


def _temporary(name: str) -> list[str]:
    return [f"__{name}{n}" for n in range(3)]


def yuv_to_rgb(samples: DataFrame, yuv, range_: str, depth: str, matrix: str, out=RGB) -> DataFrame:
    """F8. Nonlinear RGB of normalised YUV codes, unclipped, by each row's range, bit depth and matrix."""
    staged = _with(samples, _temporary("yuv"), c.expand_range(_cols(yuv), F.col(range_), F.col(depth)))
    return _with(staged, out, c.yuv_to_rgb(_cols(_temporary("yuv")), F.col(matrix))).drop(*_temporary("yuv"))


def to_nits(samples: DataFrame, rgb, transfer: str, primaries: str, white: str, peak: str, out=RGB) -> DataFrame:
    """F9. Linear light in nits of nonlinear RGB, by each row's transfer pq, sdr or hlg."""
    kind = F.col(transfer)
    staged = _with(samples, _temporary("xyz"), [
        F.when(kind == "pq", c.pq_eotf(value)).when(kind == "sdr", c.sdr_eotf(value, F.col(white)))
        .when(kind == "hlg", c.hlg_inverse_oetf(value)) for value in _cols(rgb)])
    scene = _cols(_temporary("xyz"))
    staged = staged.withColumn("__k", F.when(kind == "hlg", c.hlg_scale(scene, F.col(primaries), F.col(peak))).otherwise(1.0))
    return _with(staged, out, [value * F.col("__k") for value in scene]).drop(*_temporary("xyz"), "__k")


def pq_oetf(samples: DataFrame, nits, out=RGB) -> DataFrame:
    """F9. PQ codes of linear light in nits."""
    return _with(samples, out, [c.pq_oetf(value) for value in _cols(nits)])


def convert_gamut(samples: DataFrame, rgb, source: str, target: str, out=RGB) -> DataFrame:
    """F10. Linear RGB between primaries, through BT.709; equal primaries pass unchanged."""
    own = _cols(rgb)
    staged = _with(samples, _temporary("xyz"), c.to_bt709(own, F.col(source)))
    converted = c.from_bt709(_cols(_temporary("xyz")), F.col(target))
    same = F.col(source) == F.col(target)
    return _with(staged, out, [F.when(same, a).otherwise(b) for a, b in zip(own, converted)]).drop(*_temporary("xyz"))


def nits_to_ipt(samples: DataFrame, rgb, primaries: str, out=("i", "p", "t")) -> DataFrame:
    """F10. IPTPQc4 coordinates of linear RGB in nits."""
    positive = [F.greatest(value, F.lit(0.0)) for value in _cols(rgb)]
    staged = _with(samples, _temporary("lms"), c.matrix_by_name(F.col(primaries), c.RGB_TO_LMS, positive, None))
    staged = _with(staged, _temporary("lms"), [c.pq_oetf(value) for value in _cols(_temporary("lms"))])
    return _with(staged, out, c.matrix(c.LMS_TO_IPT, _cols(_temporary("lms")))).drop(*_temporary("lms"))


def ipt_to_nits(samples: DataFrame, ipt, primaries: str | None, out=RGB) -> DataFrame:
    """F10. Linear RGB in nits of IPTPQc4 coordinates; BT.709 without a primaries column."""
    staged = _with(samples, _temporary("lms"), [c.pq_eotf(value) for value in c.matrix(c.IPT_TO_LMS, _cols(ipt))])
    lms = _cols(_temporary("lms"))
    rgb = c.matrix_by_name(F.col(primaries), c.LMS_TO_RGB, lms, None) if primaries else c.matrix(c.LMS_TO_RGB["bt709"], lms)
    return _with(staged, out, rgb).drop(*_temporary("lms"))


DEFAULT_TONE = {"input_peak": 1000.0, "output_peak": 100.0, "paper_white": 203.0, "exposure": 0.0, "desaturation": 0.5}


def tone_map(samples: DataFrame, rgb, primaries: str, operator: str, settings: dict | None = None, out=RGB) -> DataFrame:
    """F11. Linear light in nits as BT.709 linear light up to the output peak.

    ``operator`` is aces, reinhard, spline or st2094-40. Settings are numbers or names of columns, such as a stream's
    measured peak; numbers fold to constants, so the curve is not rebuilt per sample. The perceptual operators work
    through temporary columns, so that no step is computed twice.
    """
    s = {name: F.col(value) if isinstance(value, str) else F.lit(float(value))
         for name, value in {**DEFAULT_TONE, **(settings or {})}.items()}
    exposure = F.pow(F.lit(2.0), s["exposure"])
    if operator in ("aces", "reinhard"):
        staged = _with(samples, ("__x", "__y", "__z"), [
            F.greatest(value * exposure, F.lit(0.0)) for value in c.to_bt709(_cols(rgb), F.col(primaries))])
        exposed = _cols(("__x", "__y", "__z"))
        staged = staged.withColumn("__light", c.weighted(exposed, c.LUMINANCE["bt709"]))
        light = F.col("__light")
        ratio = clamp(c.curve(light / s["paper_white"], operator) / c.curve(s["input_peak"] / s["paper_white"], operator), 0.0, 1.0)
        staged = staged.withColumn("__mapped", s["output_peak"] * ratio)
        highlight = s["desaturation"] * clamp(
            (light - s["paper_white"]) / F.greatest(s["input_peak"] - s["paper_white"], F.lit(c.EPSILON)), 0.0, 1.0)
        scaled = [value * F.try_divide(F.col("__mapped"), light) for value in exposed]
        values = [F.when(light <= 0, 0.0).otherwise(clamp(
            value + (F.col("__mapped") - value) * highlight, F.lit(0.0), s["output_peak"])) for value in scaled]
        return _with(staged, out, values).drop("__x", "__y", "__z", "__light", "__mapped")
    return _perceptual(samples, rgb, primaries, operator, s, exposure, out)


def _perceptual(samples, rgb, primaries, operator, s, exposure, out) -> DataFrame:
    staged = _with(samples, ("__x", "__y", "__z"), [F.greatest(value * exposure, F.lit(0.0)) for value in _cols(rgb)])
    staged = nits_to_ipt(staged, ("__x", "__y", "__z"), primaries, ("__i", "__p", "__t"))
    own = F.col("__i")
    if operator == "spline":
        mapped = c.spline_pq(own, s["input_peak"], s["output_peak"])
    else:
        staged = staged.withColumn("__relative", c.pq_eotf(own) / s["input_peak"])
        mapped = c.brightness_curve(F.col("__relative"), s["input_peak"], s["output_peak"])
        staged = staged.withColumn("__relative", mapped * s["output_peak"])
        mapped = c.pq_oetf(F.col("__relative"))
    staged = staged.withColumn("__m", mapped)
    now = F.col("__m")
    black = (own <= c.EPSILON) | (now <= c.EPSILON)
    chroma = clamp(F.least(
        F.try_divide(own, now), c.chroma_hull(now) / F.greatest(c.chroma_hull(own), F.lit(c.EPSILON))), 0.0, 1.0)
    staged = staged.withColumn("__chroma", chroma)
    staged = _with(staged, ("__p", "__t", "__zero"), [F.col("__p") * F.col("__chroma"), F.col("__t") * F.col("__chroma"), F.lit(0.0)])
    staged = ipt_to_nits(staged, ("__m", "__p", "__t"), None, ("__x", "__y", "__z"))
    staged = ipt_to_nits(staged, ("__m", "__zero", "__zero"), None, ("__nx", "__ny", "__nz"))
    full, grey = _cols(("__x", "__y", "__z")), _cols(("__nx", "__ny", "__nz"))

    def fit(value, base):
        delta = value - base
        return (
            F.when((value > s["output_peak"]) & (delta > 0), F.try_divide(s["output_peak"] - base, delta))
            .when((value < 0) & (delta < 0), F.try_divide(-base, delta)).otherwise(1.0))

    hard = clamp(reduce(F.least, [fit(v, n) for v, n in zip(full, grey)], F.lit(1.0)), 0.0, 1.0)
    staged = staged.withColumn("__hard", hard)
    beyond = 1 - F.col("__hard")
    scale = F.col("__hard") * (1 - s["desaturation"] * beyond * beyond)
    values = [clamp(n + (v - n) * scale, F.lit(0.0), s["output_peak"]) for v, n in zip(full, grey)]
    values = [F.when(black, 0.0).otherwise(value) for value in values]
    if operator == "spline":
        # The spline ends at the output's floor, which black point compensation takes off again
        floor = s["output_peak"] / c.SDR_CONTRAST
        values = [F.greatest(value - floor, F.lit(0.0)) * (s["output_peak"] / (s["output_peak"] - floor)) for value in values]
    return _with(staged, out, values).drop(
        "__i", "__p", "__t", "__m", "__chroma", "__x", "__y", "__z", "__nx", "__ny", "__nz", "__hard",
        "__zero", "__relative")


def encode_display(
    samples: DataFrame, nits, output_peak: float, transfer: str = "srgb", saturation: float = 1.0, contrast: float = 1.0,
    brightness: float = 0.0, out=RGB,
) -> DataFrame:
    """F12. Display codes in [0, 1], with ``clipped`` where a component was outside the output's range."""
    raw = [value / output_peak for value in _cols(nits)]
    clipped = reduce(lambda a, b: a | b, [(value < 0) | (value > 1) for value in raw])

    def encode(value):
        value = clamp(value, 0.0, 1.0)
        if transfer == "bt709":
            return F.when(value < 0.018, 4.5 * value).otherwise(1.099 * F.pow(value, F.lit(0.45)) - 0.099)
        return F.when(value <= 0.0031308, 12.92 * value).otherwise(1.055 * F.pow(value, F.lit(1 / 2.4)) - 0.055)

    staged = _with(samples.withColumn("clipped", clipped), ("__x", "__y", "__z"), [encode(value) for value in raw])
    encoded = _cols(("__x", "__y", "__z"))
    luma = c.weighted(encoded, c.LUMINANCE["bt709"])
    values = [clamp((luma + (value - luma) * saturation - 0.5) * contrast + 0.5 + brightness, 0.0, 1.0) for value in encoded]
    return _with(staged, out, values).drop("__x", "__y", "__z")


def display_summary(encoded: DataFrame, key, rgb=RGB) -> DataFrame:
    """F12. Samples, mean codes and the share out of range per frame."""
    key = [key] if isinstance(key, str) else list(key)
    return encoded.groupBy(*key).agg(
        F.count(F.lit(1)).alias("samples"), *[F.avg(name).alias(f"mean_{name}") for name in rgb],
        F.avg(F.col("clipped").cast("int")).alias("clipped_share"))


def reshape(samples: DataFrame, curves: DataFrame, key, signal, out=("s0", "s1", "s2")) -> DataFrame:
    """F13. Piecewise reshaping of a base signal by its frame's curves; null for samples without curves.

    ``curves`` has one row per key with ``curve0`` to ``curve2``: struct<pivots array<double>, segments
    array<struct<coefficients array<double>, mmr array<array<double>>>>>. A segment begins at the last inner pivot at
    or below the value; with ``mmr`` rows (order 1 to 3, seven terms each) it is cross-term, else quadratic.
    """
    key = [key] if isinstance(key, str) else list(key)
    joined = samples.join(curves, key, "left")
    source = [clamp(value, 0.0, 1.0) for value in _cols(signal)]
    joined = _with(joined, ("__s0", "__s1", "__s2"), source)
    s0, s1, s2 = _cols(("__s0", "__s1", "__s2"))
    terms = F.array(s0, s1, s2, s0 * s1, s0 * s2, s1 * s2, s0 * s1 * s2)

    def component(n):
        value, pivots = F.col(f"__s{n}"), F.col(f"curve{n}.pivots")
        inner = F.slice(pivots, 2, F.greatest(F.size(pivots) - 2, F.lit(0)))
        position = F.size(F.filter(inner, lambda pivot: pivot <= value)) + 1
        return F.element_at(F.col(f"curve{n}.segments"), position)

    joined = _with(joined, ("__g0", "__g1", "__g2"), [component(n) for n in range(3)])

    def shaped(n):
        segment, value, pivots = F.col(f"__g{n}"), F.col(f"__s{n}"), F.col(f"curve{n}.pivots")
        k = segment["coefficients"]
        polynomial = (k[2] * value + k[1]) * value + k[0]
        powers = F.transform(segment["mmr"], lambda row, order: F.aggregate(
            F.zip_with(row, terms, lambda weight, term: weight * F.pow(term, order + 1)), F.lit(0.0), lambda a, b: a + b))
        cross = F.aggregate(powers, k[0], lambda a, b: a + b)
        result = F.when(F.size(F.coalesce(segment["mmr"], F.array().cast("array<array<double>>"))) > 0, cross).otherwise(polynomial)
        return clamp(result, F.element_at(pivots, 1), F.element_at(pivots, -1))

    return _with(joined, out, [shaped(n) for n in range(3)]).select(*samples.columns, *out)


def lut_cells(grid: DataFrame, lut: str) -> DataFrame:
    """F14. One row per cell of a grid with its eight corners, from the points of :func:`sources.lut.read_lut`."""
    shifts = F.explode(F.array(*[F.struct(*[F.lit(n >> i & 1).alias(axis) for i, axis in enumerate("xyz")]) for n in range(8)]))
    spread = grid.select(lut, "r", "g", "b", F.array("out_r", "out_g", "out_b").alias("__v"), shifts.alias("__c")).select(
        lut, (F.col("r") - F.col("__c.x")).alias("__r"), (F.col("g") - F.col("__c.y")).alias("__g"),
        (F.col("b") - F.col("__c.z")).alias("__b"), (F.col("__c.x") + 2 * F.col("__c.y") + 4 * F.col("__c.z")).alias("__n"), "__v")
    cells = spread.where("__r >= 0 AND __g >= 0 AND __b >= 0").groupBy(lut, "__r", "__g", "__b").agg(
        *[F.max(F.when(F.col("__n") == n, F.col("__v"))).alias(f"__v{n}") for n in range(8)])
    # Cells past the last point have no far corners
    return cells.where(F.col("__v7").isNotNull())


def apply_lut(samples: DataFrame, grid: DataFrame, headers: DataFrame, lut: str, rgb, out=RGB) -> DataFrame:
    """F14. Trilinear interpolation of a colour table over its input domain, clamped at the edges; null for samples without
    a valid table.

    Each sample meets exactly one cell row, which already holds its eight corners, so nothing is aggregated after the
    join and the sample table is not repeated.
    """
    facts = headers.where("lut_status = 'ok'").select(lut, "size", "domain_min", "domain_max")
    placed = samples.join(facts, lut, "left")
    for n, (name, axis) in enumerate(zip(rgb, "rgb")):
        low, high = F.col("domain_min")[n], F.col("domain_max")[n]
        at = clamp((F.col(name) - low) / (high - low), 0.0, 1.0) * (F.col("size") - 1)
        placed = placed.withColumn(f"__at_{axis}", at).withColumn(
            f"__{axis}", F.least(F.floor(f"__at_{axis}").cast("int"), F.col("size") - 2))
    joined = placed.join(lut_cells(grid, lut), [lut, "__r", "__g", "__b"], "left")
    weight = {axis: F.col(f"__at_{axis}") - F.col(f"__{axis}") for axis in "rgb"}

    def blend(component):
        corner = [F.col(f"__v{n}")[component] for n in range(8)]
        along_r = [corner[n] + (corner[n + 1] - corner[n]) * weight["r"] for n in (0, 2, 4, 6)]
        along_g = [along_r[n] + (along_r[n + 1] - along_r[n]) * weight["g"] for n in (0, 2)]
        return along_g[0] + (along_g[1] - along_g[0]) * weight["b"]

    return _with(joined, out, [blend(n) for n in range(3)]).select(
        *[name for name in samples.columns if name not in out], *out)

"""Sources and expressions on the edge cases their formats allow."""
import math

import pytest
from pyspark.sql import functions as F

from reelspark.operators import catalog, color, frames
from reelspark.sources.cues import read_cues
from reelspark.sources.library import scan_library


def test_scan_library(spark, tmp_path):
    for name in ["Show/S1/e2.MKV", "Show/S1/e2.en.srt", "Show/.hidden/x.mp4", "Show/.x.mp4", "notes.txt", "noext", "a b.mp4"]:
        path = tmp_path / "lib" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"12345")
    rows = {row["path"]: (row["size_bytes"], row["kind"]) for row in scan_library(spark, str(tmp_path / "lib")).collect()}
    assert rows == {"Show/S1/e2.MKV": (5, "media"), "Show/S1/e2.en.srt": (5, "subtitle"), "a b.mp4": (5, "media")}


@pytest.mark.parametrize("tasks", [1, 3, 1_000])
def test_scan_library_keeps_underscores_however_it_is_dealt(spark, tmp_path, tasks):
    names = [f"{top}/{below}/{file}" for top in ("_a", "b c", "d") for below in ("_x/y/z", "w") for file in ("_1.mp4", "2.srt", ".3.mp4")]
    for name in names + ["top.mkv"]:
        path = tmp_path / "lib" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"123")
    rows = [row["path"] for row in scan_library(spark, f"file:{tmp_path}/lib", tasks).collect()]
    assert sorted(rows) == sorted([name for name in names if "/." not in name] + ["top.mkv"])
    (tmp_path / "none").mkdir()
    assert scan_library(spark, str(tmp_path / "none"), tasks).count() == 0


def test_cues(spark):
    text = (
        "WEBVTT\r\n\r\n1\r\n00:05.000 --> 00:06.500 position:10%\r\n<i>one</i> <b unclosed\r\nsecond --> line\r\n\r\n"
        "01:00:00.000 --> 01:00:01.000\n&amp;lt; &lt;x&gt;&nbsp;y\n \t\n00:03.000 --> 00:02.000\nbackwards\n\n00:01.000 --> 00:02.000\n\n"
        "00:01.000 --> 00:02.000\n<c.yellow>first\n\n0:01.000 --> 00:02.000\nbad time")
    got = [row[1:] for row in read_cues(spark.createDataFrame([(1, text)], "f int, t string"), "f", "t").orderBy("cue_no").collect()]
    assert got == [
        (0, 1_000_000, 2_000_000, "first"), (1, 5_000_000, 6_500_000, "one \nsecond --> line"),
        (2, 3_600_000_000, 3_601_000_000, "&lt; <x> y")]


def test_rules(spark):
    facts = spark.createDataFrame([(1, 8.0, 0.0), (2, 3.0, None)], "id int, w double, h double").withColumnRenamed("w", "in.w")
    rules = {"a": "!in.w == 0", "b": "in.w / h", "c": "-in.w % 5", "d": "min(in.w, 4) * 2 >= 8 || 1 / 0 > 0", "e": "in.w + nope"}
    got = {(row["id"], row["rule"]): (row["value"], row["status"]) for row in catalog.apply_rules(facts, ["id"], rules).collect()}
    assert got[(1, "a")] == (1.0, "ok") and got[(1, "b")] == (None, "division-by-zero") and got[(2, "b")] == (None, "unknown-name")
    # The remainder takes its dividend's sign, and both sides of a logical operator are evaluated
    assert got[(1, "c")] == (-3.0, "ok") and got[(1, "d")] == (None, "division-by-zero") and got[(1, "e")][1] == "unknown-name"
    with pytest.raises(ValueError):
        catalog.rule_columns("__import__('os')", {"w"})


def test_seconds_and_rates(spark):
    df = spark.createDataFrame([("12.5", "24000/1001"), ("7", "0/0"), ("1.23456789", "25"), ("-1", "x/2"), (None, None)], "s string, r string")
    rows = df.select(catalog.seconds_to_micros("s"), catalog.rate_of("r")).collect()
    assert [row[0] for row in rows] == [12_500_000, 7_000_000, 1_234_567, None, None]
    assert rows[0][1] == 24000 / 1001 and [row[1] for row in rows[1:]] == [None] * 4


def test_natural_order(spark):
    names = ["e10", "e2", "E1", "e02b"]
    df = spark.createDataFrame([(name,) for name in names], "n string").orderBy(catalog.natural_key(F.col("n")))
    assert [row[0] for row in df.collect()] == ["E1", "e2", "e02b", "e10"]


def test_standard_ratio(spark):
    rows = [(1080, 1920, 140, 0), (1080, 1920, 138, 0), (1080, 1920, 0, 240), (1080, 1920, 300, 0), (1080, 1920, 0, 0)]
    crops = spark.createDataFrame(rows, "rows long, columns long, top long, left_bar long").withColumn("w", F.lit(1920)).withColumn("h", F.lit(1080))
    got = frames.standard_ratio(crops, "rows", "columns", "top", "left_bar", "w", "h").collect()
    names = {(row["top"], row["left_bar"]): row["ratio_name"] for row in got}
    assert names == {(140, 0): "Blu-ray Scope", (138, 0): "Modern Anamorphic Scope", (0, 240): "4:3 Standard TV", (300, 0): None, (0, 0): None}


def test_cross_term_reshape(spark):
    samples = spark.createDataFrame([(1, 0.2, 0.5, 1.5)], "k int, a double, b double, c double")
    none = "CAST(array() AS array<array<double>>)"
    plain = f"named_struct('pivots', array(0D, 1D), 'segments', array(named_struct('coefficients', array(0D, 1D, 0D), 'mmr', {none})))"
    weights = "array(1D, 2D, 3D, 4D, 5D, 6D, 7D)"
    cross = f"named_struct('pivots', array(-100D, 100D), 'segments', array(named_struct('coefficients', array(0.5D), 'mmr', array({weights}, {weights}))))"
    curves = spark.range(1).selectExpr("1 AS k", f"{cross} AS curve0", f"{plain} AS curve1", f"{plain} AS curve2")
    row = color.reshape(samples, curves, "k", ("a", "b", "c")).collect()[0]
    terms = [0.2, 0.5, 1.0, 0.1, 0.2, 0.5, 0.1]
    want = 0.5 + sum((n + 1) * (t + t * t) for n, t in enumerate(terms))
    assert math.isclose(row["s0"], want) and row["s1"] == 0.5 and row["s2"] == 1.0


def test_peak_measure_of_black_and_of_one_bright_pixel(spark):
    rows = [(1, x, y, 0.0) for x in range(32) for y in range(16)] + [(2, x, y, 0.75 if (x, y) == (3, 3) else 0.0) for x in range(32) for y in range(16)]
    pixels = spark.createDataFrame(rows, "f int, x int, y int, v double")
    got = {row["f"]: row for row in frames.peak_measure(pixels, ["f"], "x", "y", ("v", "v", "v")).collect()}
    assert got[1]["active_tiles"] == 0 and got[1]["frame_peak_pq"] == 1e-6
    assert got[2]["tiles"] == 2 and got[2]["active_tiles"] == 1 and abs(got[2]["frame_peak_pq"] - 0.75) < 1e-3
    assert abs(got[2]["pq_sum"] - 0.75 * 16383) <= 1

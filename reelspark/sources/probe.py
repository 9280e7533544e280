"""S2. Stream rows of media probe reports in JSON."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The fields of a report, numbers printed as numbers or as digit strings
_SIDE_NUMBERS = ["bl_present_flag", "dv_bl_signal_compatibility_id", "dv_level", "dv_profile", "el_present_flag", "rotation",
                 "rpu_present_flag"]
_TEXTS = ["codec_type", "codec_name", "codec_tag_string", "profile", "pix_fmt", "avg_frame_rate", "r_frame_rate", "field_order",
          "color_transfer", "color_primaries", "color_range", "color_space", "channel_layout", "sample_rate", "bit_rate"]
_NUMBERS = ["width", "height", "coded_width", "coded_height", "level", "bits_per_raw_sample", "bits_per_sample", "channels"]
_SIDE = "STRUCT<side_data_type: STRING, " + ", ".join(f"{name}: STRING" for name in _SIDE_NUMBERS) + ">"
_STREAM = ("STRUCT<index: STRING, " + ", ".join(f"{name}: STRING" for name in [*_TEXTS, *_NUMBERS])
           + f", tags: MAP<STRING, STRING>, disposition: MAP<STRING, STRING>, side_data_list: ARRAY<{_SIDE}>>")
REPORT = (f"format STRUCT<duration: STRING, format_name: STRING>, streams ARRAY<{_STREAM}>, "
          "error STRUCT<string: STRING, code: STRING>")
DOLBY_VISION_RECORD = "DOVI configuration record"


def _text(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def _integer(value: Column) -> Column:
    return F.when(value.rlike(r"^-?\d+$"), value.try_cast("long"))


def report_status(report: Column, parsed: Column) -> Column:
    """ok, error (the probe could not read the file) or invalid (not a JSON object)."""
    return F.when(~F.coalesce(F.ltrim(report).startswith("{"), F.lit(False)) | F.try_parse_json(report).isNull(), "invalid").when(
        parsed["error"].isNotNull(), "error").otherwise("ok")


def read_probe_reports(reports: DataFrame, file: str, text: str) -> DataFrame:
    """One row per stream with an index; a report that is no JSON object or names an error gives one row with its status.

    Empty strings are null, integers may be printed as numbers or as digit strings, and side data without a type is
    dropped. ``has_dv`` and ``dv_compatibility_id`` come from the configuration record in the side data.
    """
    parsed = reports.select(file, F.col(text).alias("__text"), F.from_json(text, REPORT).alias("__r")).withColumn(
        "report_status", report_status(F.col("__text"), F.col("__r")))
    streams = F.when(F.col("report_status") == "ok", F.filter(
        F.coalesce("__r.streams", F.array().cast(f"ARRAY<{_STREAM}>")), lambda s: _integer(s["index"]).isNotNull()))
    rows = parsed.select(
        file, "report_status", _text(F.col("__r.format.duration")).alias("duration"),
        _text(F.col("__r.format.format_name")).alias("format_name"), F.explode_outer(streams).alias("s"),
    ).where((F.col("report_status") != "ok") | F.col("s").isNotNull())
    typed = F.transform(
        F.filter("s.side_data_list", lambda d: _text(d["side_data_type"]).isNotNull()),
        lambda d: F.struct(d["side_data_type"].alias("side_data_type"), *[_integer(d[name]).alias(name) for name in _SIDE_NUMBERS]))
    record = F.get(F.filter("side_data", lambda d: d["side_data_type"] == DOLBY_VISION_RECORD), F.lit(0))
    pairs = F.map_filter(F.transform_values("s.disposition", lambda _, v: _integer(v).cast("int")), lambda _, v: v.isNotNull())
    return rows.select(
        file, "report_status", "duration", "format_name", _integer(F.col("s.index")).cast("int").alias("stream_index"),
        *[_text(F.col(f"s.{name}")).alias(name) for name in _TEXTS],
        *[_integer(F.col(f"s.{name}")).cast("int").alias(name) for name in _NUMBERS],
        F.map_filter("s.tags", lambda _, v: _text(v).isNotNull()).alias("tags"), pairs.alias("disposition"),
        F.coalesce(typed, F.array().cast(f"ARRAY<{_SIDE.replace('STRING', 'BIGINT').replace('side_data_type: BIGINT', 'side_data_type: STRING')}>")).alias("side_data"),
    ).withColumn("has_dv", record.isNotNull()).withColumn("dv_compatibility_id", record["dv_bl_signal_compatibility_id"])

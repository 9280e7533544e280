"""Media catalogues (C)."""
from __future__ import annotations

import ast
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numbers import clamp, half_up
from ..functions.tables import (
    CHANNEL_LAYOUTS, KNOWN_CONTAINERS, LAYOUT_BY_COUNT, VIDEO_CODEC_ALIASES, VIDEO_CODECS_WITHOUT_ROUTE,
)
from ..plans import RunningSum, Timeline

# Fixed values
MEBIBYTE = 1024 * 1024
ENHANCEMENT_FULL_SIZE_WIDTH = 1920
RATE_TOLERANCE = 0.001
MAXIMUM_RANGE_HEADER = 128
#: Media that receive their sidecars from one copy of a list
MEDIA_PER_LIST = 1000


# ---- C1 -------------------------------------------------------------------------------------------------------
def rate_of(text) -> Column:
    """A frame rate written n/d; null for 0/0 and malformed text."""
    text = F.col(text) if isinstance(text, str) else text
    parts = F.split(text, "/")
    whole = text.rlike(r"^\s*-?\d+\s*/\s*\d+\s*(/.*)?$")
    return F.when(whole, F.try_divide(
        F.trim(parts[0]).try_cast("double"), F.nullif(F.trim(F.get(parts, F.lit(1))).try_cast("double"), F.lit(0.0))))


def seconds_to_micros(text) -> Column:
    """Decimal seconds as whole microseconds, digit by digit; digits past microseconds are dropped."""
    text = F.col(text) if isinstance(text, str) else text
    whole = F.regexp_extract(text, r"^(\d+)(?:\.(\d+))?$", 1)
    digits = F.rpad(F.substring(F.regexp_extract(text, r"^(\d+)(?:\.(\d+))?$", 2), 1, 6), 6, "0")
    return F.when(text.rlike(r"^(\d+)(?:\.(\d+))?$"), whole.try_cast("long") * 1_000_000 + digits.try_cast("long"))


def stream_facts(streams: DataFrame, first_frames: DataFrame, file: str) -> DataFrame:
    """C1. Depth, frame rate, duration, dynamic range and container names of video streams.

    ``streams`` has (file, stream_index, bits_per_raw_sample, pix_fmt, avg_frame_rate, duration, color_transfer,
    has_dv, dv_compatibility_id, format_name); ``first_frames`` the (file, stream_index) whose first frame carries
    HDR10+ metadata.
    """
    named = F.regexp_extract("pix_fmt", r"(\d+)(?:le|be)$", 1)
    depth_of_format = F.coalesce(F.nullif(named, F.lit("")).try_cast("int"), F.lit(8))
    depth = F.when(F.col("bits_per_raw_sample") > 0, F.col("bits_per_raw_sample")).otherwise(
        F.when(F.col("pix_fmt").isNotNull() & depth_of_format.between(8, 16), depth_of_format))
    flagged = first_frames.select(file, "stream_index").distinct().withColumn("__hdr10_plus", F.lit(True))
    kind = (
        F.when(F.col("has_dv"), "DOVI")
        .when(F.col("color_transfer") == "smpte2084", F.when(F.col("__hdr10_plus"), "HDR10PLUS").otherwise("HDR10"))
        .when(F.col("color_transfer") == "arib-std-b67", "HLG").otherwise("SDR"))
    sdr_base = F.coalesce(F.col("dv_compatibility_id") == 2, F.lit(False))
    containers = F.transform(F.split("format_name", ","), lambda name: F.when(name == "mpegts", "ts").otherwise(name))
    return (
        streams.join(flagged, [file, "stream_index"], "left")
        .withColumn("bit_depth", depth.cast("int")).withColumn("frame_rate", rate_of("avg_frame_rate"))
        .withColumn("duration_us", seconds_to_micros("duration")).withColumn("range_type", kind)
        .withColumn("range", F.when((F.col("range_type") == "SDR") | ((F.col("range_type") == "DOVI") & sdr_base), "SDR").otherwise("HDR"))
        .withColumn("containers", F.array_join(containers, ",")).drop("__hdr10_plus"))


# ---- C2, C3 ---------------------------------------------------------------------------------------------------
def folder_of(path) -> Column:
    return F.regexp_extract(path, r"^(?:(.*)/)?[^/]*$", 1)


def name_of(path) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def base_name(name: Column) -> Column:
    """A file name without its extension; a leading dot starts none."""
    return F.regexp_replace(name, r"(?s)^(.+)\.[^.]*$", "$1")


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(?s)^.+\.([^.]*)$", 1))


def natural_key(name: Column) -> Column:
    """Sort key under which digit runs of any length compare as numbers and case is ignored.

    A run comes after the number of its digits, leading zeros aside.
    """
    def counted(part: Column) -> Column:
        digits = F.regexp_replace(part, r"^0+(?=[0-9])", "")
        return F.when(part.rlike("^[0-9]"), F.concat(F.lpad(F.length(digits).cast("string"), 9, "0"), digits)).otherwise(part)

    parts = F.regexp_extract_all(F.lower(name), F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    return F.array_join(F.transform(parts, counted), "")


def sidecar_join(media: DataFrame, subs: DataFrame, media_id: str, path: str, sub_path: str) -> DataFrame:
    """C2. Each media file with the sorted list of subtitle files beside it, empty when it has none.

    A subtitle fits when its base name is the media's, or continues it after a dot, ignoring case. So its base name cut
    at each of its dots is looked up among the media of the folder: an equi join, however many files a folder holds.

    Media of one folder and base name have the same list: it is collected and sorted once, and each of them receives it. A list that
    many media share is dealt out in copies, so that they spread over tasks.
    """
    owners = media.withColumn("__folder", folder_of(path)).withColumn("__base", F.lower(base_name(name_of(path))))
    place = ["__folder", "__base"]
    parts = F.split(F.lower(base_name(name_of(sub_path))), r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    item = F.struct(natural_key(name_of(sub_path)).alias("k"), F.col(sub_path).alias("path"))
    offered = subs.select(folder_of(sub_path).alias("__folder"), item.alias("__item"), F.explode(F.array_distinct(prefixes)).alias("__base"))
    shared = owners.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / MEDIA_PER_LIST).alias("__copies"))
    lists = (
        offered.join(shared, place).groupBy(*place, "__copies")
        .agg(F.transform(F.sort_array(F.collect_set("__item")), lambda item: item["path"]).alias("__list"))
        .withColumn("__copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__copies") - 1))).drop("__copies"))
    many = shared.where("__copies > 1")
    dealt = owners.join(many, place, "left").withColumn(
        "__copy", F.coalesce(F.pmod(F.xxhash64(media_id, path), F.col("__copies")), F.lit(0))).drop("__copies").repartition(*place, "__copy")
    return dealt.join(lists, [*place, "__copy"], "left").select(
        *[F.col(name) for name in media.columns], F.coalesce("__list", F.array().cast("array<string>")).alias("subtitles"))


def directory_rollup(media: DataFrame, path: str, size: str) -> DataFrame:
    """C3. Every folder with media below it: depth (0 for the root), files, bytes and a natural sort key."""
    parts = F.split(F.col(path), "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    folders = media.select(F.explode(above).alias("folder"), F.col(size).alias("__bytes"))
    totals = folders.groupBy("folder").agg(F.count(F.lit(1)).alias("files"), F.sum("__bytes").alias("bytes"))
    depth = F.when(F.col("folder") == "", 0).otherwise(F.size(F.split("folder", "/")))
    return totals.withColumn("depth", depth).withColumn("sort_key", natural_key(F.col("folder")))


# ---- C4, C7 ---------------------------------------------------------------------------------------------------
def container_support(items: DataFrame, rules: DataFrame, containers: str, video: str, audio: str) -> DataFrame:
    """C4. ``supported``: one rule carries a container of the item, its video codec and, if any, its audio codec.

    ``rules`` is regrouped to the containers each (video, audio) pair may sit in, so an item needs one equi join and
    no explosion; tracks allowed only by different rules do not combine.
    """
    pairs = rules.select(
        F.explode("video_codecs").alias("__video"), F.array_append("audio_codecs", F.lit("")).alias("__audios"), "containers",
    ).select("__video", F.explode("__audios").alias("__audio"), "containers")
    allowed = pairs.groupBy("__video", "__audio").agg(
        F.array_distinct(F.flatten(F.collect_list(F.transform("containers", lambda name: F.upper(name))))).alias("__allowed"))
    tokens = F.transform(F.split(F.coalesce(F.col(containers), F.lit("")), ","), lambda token: F.upper(F.trim(token)))
    asked = items.withColumn("__audio", F.coalesce(F.col(audio), F.lit("")))
    joined = asked.join(allowed, (asked[video] == allowed["__video"]) & (asked["__audio"] == allowed["__audio"]), "left")
    return joined.withColumn("supported", F.coalesce(F.arrays_overlap(tokens, F.col("__allowed")), F.lit(False))).select(
        *items.columns, "supported")


def video_codec_of(name) -> Column:
    """Codec of a metadata name, null when unknown."""
    name = F.upper(F.trim(F.col(name) if isinstance(name, str) else name))
    table = F.create_map(*[F.lit(part) for pair in VIDEO_CODEC_ALIASES.items() for part in pair])
    return F.try_element_at(table, name)


def eligibility_gates() -> list[tuple[str, Column]]:
    """C7. The ladder as (reason, failing condition) in order, over the fact columns of :func:`eligibility_funnel`."""
    known = F.exists(
        F.split(F.coalesce("containers", F.lit("")), ","), lambda token: F.lower(F.trim(token)).isin(KNOWN_CONTAINERS))
    codec = video_codec_of("video_codec")
    bare = F.coalesce(F.upper(F.trim("video_codec")), F.lit(""))
    return [
        ("runtime-unavailable", ~F.col("runtime_available")),
        ("invalid-options", ~F.col("has_options")),
        ("play-method-unsupported", F.upper(F.trim(F.col("play_method"))) != "DIRECTPLAY"),
        ("invalid-options", ~F.col("has_source")),
        ("live-stream-unsupported", F.col("is_live")),
        ("container-unsupported", ~known),
        ("invalid-options", ~F.col("start_valid") | ~F.col("source_valid")),
        ("url-unsupported", ~F.col("url_supported")),
        ("video-track-unavailable", ~F.col("has_video")),
        ("video-codec-without-route", codec.isNull() & bare.isin(VIDEO_CODECS_WITHOUT_ROUTE)),
        ("codec-unsupported", codec.isNull()),
        ("rotation-unsupported", F.coalesce(F.col("rotation"), F.lit(0)) != 0),
        ("interlaced-video-unsupported", F.col("fields_apart")),
        ("video_reason", F.col("video_reason").isNotNull()),
        ("interlaced-video-unsupported", F.col("scan_refused")),
        ("audio_reason", F.col("audio_reason").isNotNull()),
        ("container-unsupported", ~F.col("container_supported")),
        ("runtime-unavailable", ~F.col("source_runtime_available")),
    ]


def eligibility_funnel(items: DataFrame, gates: Sequence[tuple[str, Column]] | None = None) -> DataFrame:
    """C7. The first failing gate as ``reason``, null for an eligible item; a missing fact fails its gate.

    The gates ``video_reason`` and ``audio_reason`` report the reason their own column holds.
    """
    gates = gates or eligibility_gates()
    missing_passes = {"video_reason", "audio_reason"}
    reasons = [
        F.when(failing if reason in missing_passes else F.coalesce(failing, F.lit(True)),
               F.col(reason) if reason in missing_passes else F.lit(reason))
        for reason, failing in gates]
    return items.withColumn("reason", F.coalesce(*reasons)).withColumn("eligible", F.col("reason").isNull())


def reason_counts(decided: DataFrame) -> DataFrame:
    """C7. Items per reason with their share of all items."""
    counts = decided.groupBy(F.coalesce("reason", F.lit("eligible")).alias("reason")).agg(F.count(F.lit(1)).alias("items"))
    # One row per reason of a fixed ladder, so the window over all of them is small
    total = F.sum("items").over(Window.partitionBy(F.lit(1)))
    return counts.withColumn("share", F.col("items") / total)


# ---- C5, C6 ---------------------------------------------------------------------------------------------------
def select_track(files: DataFrame, streams: DataFrame, file: str, requested: str) -> DataFrame:
    """C5. The audio track of each file: ``status`` none, invalid, external or selected, with its ``track_index`` and
    ``track_ordinal`` among the tracks inside the container.

    ``streams`` has (file, position, stream_index, type, external); a stream without an index takes its position.
    """
    audio = streams.where(F.upper(F.trim("type")) == "AUDIO").select(
        file, "position", F.coalesce("stream_index", "position").cast("long").alias("__index"),
        F.coalesce("external", F.lit(False)).alias("__external"))
    numbered = Timeline(audio, file, ["__index", "position"]).scan(
        __inside=RunningSum((~F.col("__external")).cast("int"))).df
    asked = numbered.join(files.select(file, F.col(requested).alias("__asked")), file)
    wanted = F.col("__asked").isNull() | (F.col("__index") == F.col("__asked"))
    chosen = asked.groupBy(file).agg(
        F.max((F.col("__index") < 0).cast("int")).alias("__bad"),
        F.min(F.when(wanted, F.struct("__index", "position", "__external", "__inside"))).alias("__pick"))
    joined = files.join(chosen, file, "left")
    status = (
        F.when(F.col("__bad") == 1, "invalid").when(F.col("__bad").isNull(), "none")
        .when((F.col(requested) < 0) | F.col("__pick").isNull(), "invalid")
        .when(F.col("__pick.__external"), "external").otherwise("selected"))
    selected = F.col("status") == "selected"
    return joined.withColumn("status", status).select(
        *files.columns, "status", F.when(selected, F.col("__pick.__index")).alias("track_index"),
        F.when(selected, F.col("__pick.__inside") - 1).cast("int").alias("track_ordinal"))


def layer_track_pairs(streams: DataFrame, file: str) -> DataFrame:
    """C6. Files whose two video streams are a base layer and a matching profile-7 enhancement layer.

    ``streams`` holds video streams with (file, stream_index, width, height, average_rate, real_rate, is_base,
    is_enhancement).
    """
    facts = F.struct("stream_index", "width", "height", "average_rate", "real_rate")
    found = streams.groupBy(file).agg(
        F.count(F.lit(1)).alias("__n"), F.min(F.when(F.col("is_base"), facts)).alias("b"),
        F.min(F.when(F.col("is_enhancement"), facts)).alias("e"))
    halves = F.when(F.col("b.width") > ENHANCEMENT_FULL_SIZE_WIDTH, 2).otherwise(1)

    def agree(name):
        known = F.col(f"b.{name}").isNotNull() & F.col(f"e.{name}").isNotNull()
        unknown = F.col(f"b.{name}").isNull() & F.col(f"e.{name}").isNull()
        return unknown | (known & (F.abs(F.col(f"b.{name}") - F.col(f"e.{name}")) <= RATE_TOLERANCE))

    some = F.col("b.average_rate").isNotNull() | F.col("b.real_rate").isNotNull()
    fits = (
        (F.col("e.width") == F.ceil(F.col("b.width") / halves)) & (F.col("e.height") == F.ceil(F.col("b.height") / halves))
        & agree("average_rate") & agree("real_rate") & some)
    return found.where(
        (F.col("__n") == 2) & F.col("b").isNotNull() & F.col("e").isNotNull() & (F.col("b.stream_index") != F.col("e.stream_index")) & fits
    ).select(file, F.col("b.stream_index").alias("base_index"), F.col("e.stream_index").alias("enhancement_index"))


# ---- C8 -------------------------------------------------------------------------------------------------------
def browser_identity(df: DataFrame, agent: str, vendor: str, has_audio_decoder: str) -> DataFrame:
    """C8. ``engine`` (webkit or other) and ``engine_major`` of a user agent.

    An iOS major of 18 is the frozen one when the browser has an audio decoder, which no real iOS 18 has.
    """
    ios = F.col(agent).rlike(r"\b(?:iPhone|iPad|iPod)\b")
    webkit = (
        F.col(agent).rlike(r"\bAppleWebKit/") & ~F.col(agent).rlike(r"\b(?:Chrome|Chromium|Edg|Firefox)/")
        & (F.col(vendor).isNull() | F.col(vendor).rlike(r"\bApple\b")))
    safari = F.nullif(F.regexp_extract(agent, r"\bVersion/(\d+)", 1), F.lit("")).try_cast("int")
    system = F.nullif(F.regexp_extract(agent, r"\bOS (\d+)_\d+", 1), F.lit("")).try_cast("int")
    frozen = (system == 18) & F.coalesce(F.col(has_audio_decoder), F.lit(False))
    major = F.when(ios, F.coalesce(safari, F.when(~frozen, system))).when(webkit, safari)
    return df.withColumn("engine", F.when(ios | webkit, "webkit").otherwise("other")).withColumn("engine_major", major)


def known_defects(calls: DataFrame, defects: DataFrame, call_id: str) -> DataFrame:
    """C8. Calls with the first declared defect that applies (``defect_no``, null when the call is safe).

    ``calls`` has (engine, engine_major, media, kind, codec, channels); ``defects`` has (defect_no, engine,
    fixed_major, media, kind, codec_prefix, above_channels). An unknown major counts as affected. Defects are joined
    by engine, media and kind; those few that share all three are compared in turn.
    """
    on = ["engine", "media", "kind"]
    grouped = defects.groupBy(*on).agg(F.sort_array(F.collect_list(
        F.struct("defect_no", "fixed_major", "codec_prefix", "above_channels"))).alias("__defects"))
    joined = calls.join(grouped, on, "left")
    matching = F.filter("__defects", lambda d: (
        (d["fixed_major"].isNull() | F.col("engine_major").isNull() | (F.col("engine_major") < d["fixed_major"]))
        & F.col("codec").startswith(d["codec_prefix"]) & (F.col("channels") > d["above_channels"])))
    return joined.select(*calls.columns, F.get(matching, F.lit(0))["defect_no"].alias("defect_no"))


# ---- C9 -------------------------------------------------------------------------------------------------------
class _Rule:
    """A numeric rule as Columns: its value and whether it divides by zero."""

    def __init__(self, facts: set[str], spelled: dict[str, str]):
        self.facts, self.spelled, self.unknown, self.divisors, self.names = facts, spelled, False, [], []

    def build(self, node: ast.AST) -> Column:
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return F.lit(float(node.value))
        if isinstance(node, ast.Name):
            name = self.spelled.get(node.id, "")
            if name not in self.facts:
                self.unknown = True
                return F.lit(None).cast("double")
            value = F.col(f"`{name}`").cast("double")
            self.names.append(value)
            return value
        if isinstance(node, ast.UnaryOp):
            value = self.build(node.operand)
            return -value if isinstance(node.op, ast.USub) else (value == 0).cast("double")
        if isinstance(node, ast.BinOp):
            left, right = self.build(node.left), self.build(node.right)
            if isinstance(node.op, (ast.Div, ast.Mod)):
                self.divisors.append(right)
                safe = F.when(right != 0, right)
                return left / safe if isinstance(node.op, ast.Div) else left % safe
            return {ast.Add: left + right, ast.Sub: left - right, ast.Mult: left * right}[type(node.op)]
        if isinstance(node, ast.BoolOp):
            truths = [self.build(value) != 0 for value in node.values]
            both = isinstance(node.op, ast.And)
            return reduce(lambda a, b: a & b if both else a | b, truths).cast("double")
        if isinstance(node, ast.Compare) and len(node.ops) == 1:
            left, right = self.build(node.left), self.build(node.comparators[0])
            return {ast.Lt: left < right, ast.LtE: left <= right, ast.Gt: left > right, ast.GtE: left >= right,
                    ast.Eq: left == right, ast.NotEq: left != right}[type(node.ops[0])].cast("double")
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name):
            arguments = [self.build(argument) for argument in node.args]
            one = {"abs": F.abs, "ceil": F.ceil, "floor": F.floor, "round": lambda v: F.floor(v + 0.5)}
            if node.func.id in one and len(arguments) == 1:
                return one[node.func.id](arguments[0]).cast("double")
            if node.func.id in ("max", "min") and len(arguments) == 2:
                return (F.greatest if node.func.id == "max" else F.least)(*arguments)
        raise ValueError(f"rule uses {ast.dump(node)[:60]}")


def rule_columns(text: str, facts: set[str]) -> tuple[Column, Column]:
    """Value and status of a rule: ok, division-by-zero, unknown-name or not-finite.

    Rules use ``+ - * / %``, comparisons, ``&& || !``, abs, ceil, floor, max, min, round and dotted fact names.
    """
    names: dict[str, str] = {}

    def placeholder(match: re.Match) -> str:
        if match[2]:
            return match[0]
        return names.setdefault(match[1], f"v{len(names)}")

    # Fact names may be dotted or Python keywords, so they are read as placeholders
    spelled = re.sub(r"(?<![\w.])([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*)(\s*\()?", placeholder, text)
    spelled = re.sub(r"!(?!=)", "~", spelled.replace("&&", " and ").replace("||", " or ")).strip()
    rule = _Rule(facts, {short: name for name, short in names.items()})
    value = rule.build(ast.parse(spelled, mode="eval").body)
    zero = reduce(lambda a, b: a | b, [F.coalesce(d == 0, F.lit(False)) for d in rule.divisors], F.lit(False))
    missing = reduce(lambda a, b: a | b, [name.isNull() for name in rule.names], F.lit(rule.unknown))
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    status = F.when(missing, "unknown-name").when(zero, "division-by-zero").when(~finite, "not-finite").otherwise("ok")
    return F.when(status == "ok", value), status


def apply_rules(facts: DataFrame, key: list[str], rules: dict[str, str]) -> DataFrame:
    """C9. One row per facts row and rule: (key, ``rule``, ``value``, ``status``); the facts are scanned once."""
    names = set(facts.columns) - set(key)
    rows = []
    for name, text in rules.items():
        value, status = rule_columns(text, names)
        rows.append(F.struct(F.lit(name).alias("rule"), value.alias("value"), status.alias("status")))
    return facts.select(*key, F.explode(F.array(*rows)).alias("__rule")).select(*key, "__rule.*")


# ---- C10-C12 --------------------------------------------------------------------------------------------------
def buffer_plan(files: DataFrame, size: str, duration: str) -> DataFrame:
    """C10. Read-ahead and cache bytes for 5 s and 15 s of media within bounds, and the average bitrate."""

    def span(micros, low, high):
        return F.when(F.col(duration) > 0, clamp(
            half_up(F.col(size).cast("double") * micros / F.col(duration)), F.lit(low * MEBIBYTE), F.lit(high * MEBIBYTE)))

    return (
        files.withColumn("read_ahead_bytes", span(5_000_000, 8, 64)).withColumn("cache_bytes", span(15_000_000, 32, 192))
        .withColumn("bits_per_second", F.when(F.col(duration) > 0, F.col(size).cast("double") * 8_000_000 / F.col(duration))))


def buffer_plan_summary(planned: DataFrame, group: str) -> DataFrame:
    """C10. Totals and means per container."""
    return planned.groupBy(group).agg(
        F.count(F.lit(1)).alias("files"), F.sum("read_ahead_bytes").alias("read_ahead_bytes"),
        F.sum("cache_bytes").alias("cache_bytes"), F.avg("bits_per_second").alias("mean_bits_per_second"))


def declared_layout(tracks: DataFrame, channels: str, mask: str, meta_channels: str, meta_mask: str) -> DataFrame:
    """C11. The layout a track is screened with: ``layout``, ``layout_channels``, ``layout_mask``, ``layout_status``.

    The container's mask decides; else the metadata's mask if it names the container's count; else the count; else the
    metadata's count.
    """
    masks = F.create_map(*[part for wave, layout, speakers in CHANNEL_LAYOUTS for part in (
        F.lit(wave).cast("long"), F.struct(F.lit(layout).alias("layout"), F.lit(len(speakers)).alias("n")))])
    counts = F.create_map(*[F.lit(part) for pair in LAYOUT_BY_COUNT.items() for part in pair])
    own, meta = F.try_element_at(masks, F.col(mask).cast("long")), F.try_element_at(masks, F.col(meta_mask).cast("long"))
    by_count = F.try_element_at(counts, F.col(channels).cast("int"))
    by_meta = F.try_element_at(counts, F.col(meta_channels).cast("int"))

    def answer(layout, count, wave):
        return F.struct(layout.alias("layout"), count.cast("int").alias("n"), wave.cast("long").alias("mask"))

    none = F.lit(None).cast("long")
    declared = F.coalesce(F.col(mask), F.lit(0)) != 0
    found = F.when(declared, F.when(own["n"] == F.col(channels), answer(own["layout"], F.col(channels), F.col(mask)))).otherwise(
        F.coalesce(
            F.when(meta["n"] == F.col(channels), answer(meta["layout"], F.col(channels), F.col(meta_mask))),
            F.when(by_count.isNotNull(), answer(by_count, F.col(channels), none)),
            F.when(by_meta.isNotNull(), answer(by_meta, F.col(meta_channels), none))))
    return tracks.withColumn("__found", found).select(
        *tracks.columns, F.col("__found.layout").alias("layout"), F.col("__found.n").alias("layout_channels"),
        F.col("__found.mask").alias("layout_mask"),
        F.when(F.col("__found").isNotNull(), "resolved").when(declared, "mask-unqualified").otherwise("unavailable").alias("layout_status"))


def range_response_audit(
    log: DataFrame, requested: str, status: str, content_range: str, transport_error: str, *,
    path: str | None = None, content_length: str | None = None, cors: str | None = None, hidden_path: str | None = None,
) -> DataFrame:
    """C12. ``range_status`` of each response to a byte-range request, and whether it may be retried.

    ``ok`` needs status 206 and a Content-Range equal to the requested interval; ``ok-hidden`` is a cross-origin 206 on
    a path that hides the header whose Content-Length fits. Others: transport-error, not-partial, invalid-request,
    missing-range, invalid-range, mismatch; no-range for a request without one.
    """
    asked = F.trim(requested)
    usable = F.length(asked).between(1, MAXIMUM_RANGE_HEADER)
    bounded = r"(?i)^bytes=(\d+)-(\d*)$"

    def number(text):
        return F.nullif(text, F.lit("")).try_cast("long")

    first, last = number(F.regexp_extract(asked, bounded, 1)), number(F.regexp_extract(asked, bounded, 2))
    suffix = number(F.regexp_extract(asked, r"(?i)^bytes=-(\d+)$", 1))
    valid_request = usable & ((first.isNotNull() & (last.isNull() | (last >= first))) | (suffix > 0))
    answered = F.trim(content_range)
    shape = r"(?i)^bytes (\d+)-(\d+)/(\d+|\*)$"
    from_, to = number(F.regexp_extract(answered, shape, 1)), number(F.regexp_extract(answered, shape, 2))
    total = F.regexp_extract(answered, shape, 3).try_cast("long")
    valid_answer = (
        F.length(answered).between(1, MAXIMUM_RANGE_HEADER) & (to >= from_) & (total.isNull() | ((total > 0) & (to < total))))
    matches = (
        F.when(suffix.isNotNull(), total.isNotNull() & (from_ == F.greatest(F.lit(0), total - suffix)) & (to == total - 1))
        .when(last.isNotNull(), (from_ == first) & (to == F.least(last, total - 1)))
        .otherwise((from_ == first) & (total.isNull() | (to == total - 1))))
    hidden = F.lit(False)
    if hidden_path:
        length = F.when(F.col(content_length) > 0, F.col(content_length))
        fits = F.when(suffix.isNotNull(), length <= suffix).when(last.isNotNull(), length <= last - first + 1).otherwise(length.isNotNull())
        hidden = F.coalesce(F.col(cors) & F.col(path).rlike(hidden_path) & fits, F.lit(False))
    yes = lambda condition: F.coalesce(condition, F.lit(False))
    result = (
        F.when(yes(F.col(transport_error)), "transport-error").when(F.col(requested).isNull(), "no-range")
        .when(~yes(valid_request), "invalid-request").when(~yes(F.col(status) == 206), "not-partial")
        .when(F.col(content_range).isNull(), F.when(hidden, "ok-hidden").otherwise("missing-range"))
        .when(~yes(valid_answer), "invalid-range").when(yes(matches), "ok").otherwise("mismatch"))
    retry = yes(F.col(transport_error)) | yes(F.col(status).isin(408, 429)) | yes(F.col(status).between(500, 599))
    return log.withColumn("range_status", result).withColumn("retryable", retry)


def range_audit_rates(audited: DataFrame, group: list[str], at: str, width_us: int) -> DataFrame:
    """C12. Responses, and shares that were accepted and retryable, per group and time window."""
    accepted = F.col("range_status").isin("ok", "ok-hidden").cast("int")
    return audited.groupBy(*group, (F.floor(F.col(at) / width_us) * width_us).cast("long").alias("window_us")).agg(
        F.count(F.lit(1)).alias("responses"), F.avg(accepted).alias("accepted_share"),
        F.avg(F.col("retryable").cast("int")).alias("retryable_share"))

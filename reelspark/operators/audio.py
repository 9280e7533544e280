"""Audio timelines and mixes (A).

A chunk is one row with ``channels``, an array of one sample array per channel. Samples are never exploded: mixes are
array expressions, and filters that reach across chunks work on blocks of a fixed number of frames that carry the frames
they need of their neighbours, so a stream of any length spreads over all tasks.
"""
from __future__ import annotations

import bisect
import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.mixing import downmix_weights, routing
from ..functions.numbers import frames_to_micros
from ..functions.tables import LAYOUT_SPEAKERS
from ..plans import Fold, Lag, LastKnown, RowNumber, RunningMax, RunningSum, Timeline
from ..plans.fold import parse_schema, run_sorted
from ..plans.skew import same_key

# Fixed values
CORRECTION_BOUND_US = 2_000_000
RAMP_MS = 20
BLOCK_FRAMES = 16_384
CUTOFF_HEADROOM, PHASES, RADIUS, QUALIFIED_RATE = 0.94, 2_048, 32, 192_000
CEILING = 10 ** (-1 / 20)
ATTACK_MS, RELEASE_MS, FULL_ATTACK_DB = (3, 10), 100, 12.0
LIMITED_EPSILON = 1e-7

SAMPLES = "array<array<float>>"


# ---- A1, A2 ---------------------------------------------------------------------------------------------------
def _micros(frames: int, rate: int) -> int:
    return (2 * frames * 1_000_000 + rate) // (2 * rate)


class ReconcileFold(Fold):
    """A1, one chunk after another. State: anchor time, accepted frames, the previous raw time, whether the stream was rejected."""

    schema = ("decision string, silence_frames bigint, discarded_frames bigint, accepted_frames bigint, "
              "start_frame bigint, deviation_us bigint")

    def __init__(self, ts: str, frames: str, rate: str, quantisation_us: int, bound_us: int):
        self.inputs, self.quantisation, self.bound = [ts, frames, rate], quantisation_us, bound_us

    def initial(self):
        return [None, 0, None, False]

    def step(self, state, row):
        anchor, total, previous, rejected = state
        ts, frames, rate = row
        frames = frames or 0
        if rejected:
            return state, ("ended", 0, frames, 0, None, None)
        if ts is None:
            return [anchor, total + frames, previous, False], ("absorb", 0, 0, frames, total, None)
        if anchor is None:
            # Chunks without a time before the first one with a time count from that one
            return [ts - _micros(total, rate), total + frames, ts, False], ("anchor", 0, 0, frames, total, 0)
        deviation = ts - (anchor + _micros(total, rate))
        size = abs(deviation)
        tolerance = self.quantisation + -(-1_000_000 // rate)
        silence = discarded = 0
        if size <= tolerance:
            decision = "absorb" if size else "contiguous"
        elif ts <= previous:
            decision = "absorb"
        elif size > self.bound:
            return [anchor, total, ts, True], ("reject", 0, frames, 0, None, deviation)
        else:
            correction = (2 * size * rate + 1_000_000) // 2_000_000
            if deviation > 0:
                decision, silence = "fill", correction
            elif frames - correction <= 0 or _micros(frames - correction, rate) <= tolerance:
                decision, discarded = "drop", frames
            else:
                decision, discarded = "trim", correction
        accepted = frames - discarded
        return ([anchor, total + silence + accepted, ts, False],
                (decision, silence, discarded, accepted, total + silence, deviation))

    def shifted(self, offsets: np.ndarray, row: tuple) -> np.ndarray:
        """Offsets after a chunk, for many offsets before it at once. An offset is how far the accepted frames are ahead of all raw
        frames so far; the row has time since the anchor, whether time advances, frames, rate and raw frames before it."""
        elapsed, advances, frames, rate, before = row
        if not advances:
            return offsets
        deviation = elapsed - (2 * (before + offsets) * 1_000_000 + rate) // (2 * rate)
        size = np.abs(deviation)
        tolerance = self.quantisation + -(-1_000_000 // rate)
        correction = (2 * size * rate + 1_000_000) // 2_000_000
        left = frames - correction
        dropped = (left <= 0) | ((2 * left * 1_000_000 + rate) // (2 * rate) <= tolerance)
        moved = np.where(deviation > 0, offsets + correction, np.where(dropped, offsets - frames, offsets - correction))
        moved = np.where(size <= tolerance, offsets, np.where(size > self.bound, _REJECTED, moved))
        return np.where(offsets == _REJECTED, _REJECTED, moved)


#: The offset of a rejected stream
_REJECTED = -(1 << 40)
#: Chunks of a run whose effect on the offset is summed up by one task
RUN_CHUNKS = 4_096


def run_effect(rule: ReconcileFold, rows: list[tuple]) -> tuple[list[int], list[int], list[int]]:
    """A run's offset after it as a function of the offset before it: starts of pieces, values there, and slopes 0 or 1.

    The first chunk whose time advances rejects all offsets but those within the bound, so no other needs to be followed. Corrections
    bring most of these together, and the offsets still apart are few after some chunks. Offsets below the first piece and from
    the last piece on are rejected.
    """
    first = next((row for row in rows if row[1]), None)
    if first is None:
        return [_REJECTED + 1], [_REJECTED + 1], [1]
    elapsed, _, _, rate, before = first
    reach = rule.bound * rate // 1_000_000 + 2
    centre = elapsed * rate // 1_000_000 - before
    begin = np.arange(centre - reach, centre + reach + 1, dtype=np.int64)
    apart, which = begin, np.arange(len(begin))
    for row in rows:
        moved = rule.shifted(apart, row)
        if moved is not apart and not np.array_equal(moved, apart):
            apart, merged = np.unique(moved, return_inverse=True)
            which = merged[which]
    after = apart[which]
    # A piece goes on while the value stays, or while it grows with the offset
    steps = np.diff(after)
    changes = np.append(np.flatnonzero(np.diff(steps) != 0) + 1, len(steps))
    pieces, at = [], 0
    while at < len(begin):
        slope = int(steps[at]) if at < len(steps) else -1
        pieces.append((int(begin[at]), int(after[at]), max(slope, 0) if slope < 2 else 0))
        at = int(changes[np.searchsorted(changes, at, "right")]) + 1 if slope in (0, 1) else at + 1
    starts, values, slopes = map(list, zip(*pieces, (int(begin[-1]) + 1, _REJECTED, 0)))
    return starts, values, slopes


def apply_effect(effect: tuple[list[int], list[int], list[int]], offset: int) -> int:
    """The offset after a run."""
    starts, values, slopes = effect
    at = bisect.bisect_right(starts, offset) - 1
    if offset == _REJECTED or at < 0:
        return _REJECTED
    return values[at] + slopes[at] * (offset - starts[at])


def reconcile_timeline(
    chunks: DataFrame, key, seq: str, ts: str, frames: str, rate: str, quantisation_us: int = 1_000,
    bound_us: int = CORRECTION_BOUND_US, run_chunks: int = RUN_CHUNKS,
) -> DataFrame:
    """A1. Place of each chunk on its stream's accepted timeline, by the first rule that applies: anchor, jitter within
    tolerance or a time that does not advance absorbed, too large a deviation rejected (the stream ends), a gap filled
    with silence, an overlap trimmed or dropped. Only times and counts are worked on.

    What earlier chunks decided reaches later ones as one number, the offset of accepted against raw frames. A long stream is cut
    into runs: each run's effect on the offset is worked out on its own, for every offset it may meet; effects follow one another over
    the runs of a stream, one short row each, and give every run the offset it starts from. Then all runs decide at once.
    """
    key = [key] if isinstance(key, str) else list(key)
    rule = ReconcileFold(ts, frames, rate, quantisation_us, bound_us)
    narrow = chunks.select(*dict.fromkeys([*key, seq, ts, frames, rate]))
    carried = list(dict.fromkeys([*key, seq]))
    schema = T.StructType([chunks.schema[name] for name in carried] + list(parse_schema(rule.schema)))
    arrow = to_arrow_schema(schema)

    def decide(rows: DataFrame, together: list[str]) -> DataFrame:
        laid = rows.repartition(*together).sortWithinPartitions(*together, seq)
        return laid.mapInArrow(lambda batches: run_sorted(batches, rule, together, carried, arrow, enter=_entered), schema)

    # Streams of several runs; where there are none, every stream is one run from its start
    long = narrow.groupBy(*key).agg(F.count(F.lit(1)).alias("__chunks")).where(F.col("__chunks") > run_chunks).select(
        *[F.col(name).alias(f"__of_{name}") for name in key])
    if long.isEmpty():
        return decide(narrow, key)
    short = narrow.join(long, same_key(key, "__of_"), "left_anti")
    entered = _entered_runs(narrow.join(long, same_key(key, "__of_"), "left_semi"), key, seq, rule, run_chunks)
    return decide(entered, [*key, "__run"]).unionByName(decide(short, key))


def _entered_runs(chunks: DataFrame, key: list[str], seq: str, rule: ReconcileFold, run_chunks: int) -> DataFrame:
    """The chunks of long streams with their run and, in ``__entry``, the state that it starts from (null at a stream's start)."""
    ts, frames, rate = rule.inputs
    raw = F.coalesce(frames, F.lit(0)).cast("long")
    placed = Timeline(chunks, key, seq).scan(__n=RowNumber(), __sum=RunningSum(raw), __latest=LastKnown(ts, inclusive=False))
    placed = placed.apply(lambda df: df.withColumn("__raw", F.col("__sum") - raw).withColumn("__run", F.floor((F.col("__n") - 1) / run_chunks)))
    # The anchor's time less the frames before it
    at_start = F.col(ts) - F.floor((2 * F.col("__raw") * 1_000_000 + F.col(rate)).cast("long") / (2 * F.col(rate))).cast("long")
    placed = placed.scan(__anchor=LastKnown(F.when(F.col("__latest").isNull() & F.col(ts).isNotNull(), at_start))).df
    advances = F.coalesce((F.col(ts) > F.col("__latest")) & F.col("__anchor").isNotNull(), F.lit(False))
    entries = _run_entries(placed.select(
        *key, "__run", "__n", (F.col(ts) - F.col("__anchor")).cast("long").alias("elapsed"), advances.alias("advances"), raw.alias("frames"),
        F.col(rate).cast("long").alias("rate"), "__raw"), key, rule)
    state = F.when(F.col("__run") > 0, F.to_json(F.struct(
        F.col("__anchor").alias("a"), (F.col("__raw") + F.col("__offset")).alias("t"), F.col("__latest").alias("p"), (F.col("__offset") == _REJECTED).alias("r"))))
    return placed.join(entries, same_key(key, "__of_") & (F.col("__run") == F.col("__of_run"))).select(
        *dict.fromkeys([*key, seq, *rule.inputs]), "__run", state.alias("__entry"))


def _entered(text: str) -> list:
    state = json.loads(text)
    return [state.get("a"), state["t"], state.get("p"), state["r"]]


def _run_entries(narrow: DataFrame, key: list[str], rule: ReconcileFold) -> DataFrame:
    """The offset that each run of the streams with several starts from."""
    width = len(key)
    fields = [narrow.schema[name] for name in key]
    numbers = T.ArrayType(T.LongType())
    effect_schema = T.StructType([*fields, T.StructField("__run", T.LongType()), *[T.StructField(name, numbers) for name in ("starts", "values", "slopes")]])
    entry_schema = T.StructType([*[T.StructField(f"__of_{field.name}", field.dataType) for field in fields], T.StructField("__of_run", T.LongType()), T.StructField("__offset", T.LongType())])

    def effects(batches):
        arrow = to_arrow_schema(effect_schema)
        for name, rows in _groups(batches, width + 1):
            # The row's number within its stream comes first
            yield _one_row([*name, *run_effect(rule, [row[1:] for row in rows])], arrow)

    def entries(batches):
        arrow = to_arrow_schema(entry_schema)
        current, offset = None, 0
        for batch in batches:
            for row in zip(*[column.to_pylist() for column in batch.columns]):
                if row[:width] != current:
                    current, offset = row[:width], 0
                yield _one_row([*current, row[width], offset], arrow)
                offset = apply_effect(row[width + 1:], offset)

    by_run = [*key, "__run"]
    found = narrow.repartition(*by_run).sortWithinPartitions(*by_run, "__n").mapInArrow(effects, effect_schema)
    return found.repartition(*key).sortWithinPartitions(*by_run).mapInArrow(entries, entry_schema)


def _groups(batches, width: int):
    """Consecutive rows with equal first values, at most a run of them at a time."""
    name, held = None, []
    for batch in batches:
        for row in zip(*[column.to_pylist() for column in batch.columns]):
            if row[:width] != name:
                if held:
                    yield name, held
                name, held = row[:width], []
            held.append(row[width:])
    if held:
        yield name, held


def _one_row(values: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([value], field.type) for value, field in zip(values, schema)], schema=schema)


def reconcile_summary(decisions: DataFrame, key: str) -> DataFrame:
    """A1. Corrections of each stream."""
    return decisions.groupBy(key).agg(
        F.count(F.lit(1)).alias("chunks"),
        *[F.count_if(F.col("decision") == name).alias(f"{name}_chunks") for name in ("absorb", "fill", "trim", "drop", "reject")],
        F.sum("silence_frames").alias("silence_frames"), F.sum("discarded_frames").alias("discarded_frames"))


def apply_window(chunks: DataFrame, decisions: DataFrame, key: list[str], channels: str = "channels") -> DataFrame:
    """A2. Chunks with the decided silence before them and the decided frames cut off; dropped chunks are left out."""
    joined = chunks.join(decisions.select(*key, "decision", "silence_frames", "discarded_frames", "start_frame"), key)
    kept = joined.where(~F.col("decision").isin("drop", "reject", "ended"))

    def window(channel):
        cut = F.slice(channel, F.col("discarded_frames").cast("int") + 1, F.greatest(
            F.size(channel) - F.col("discarded_frames").cast("int"), F.lit(0)))
        return F.concat(F.array_repeat(F.lit(0.0).cast("float"), F.col("silence_frames").cast("int")), cut)

    return kept.withColumn(channels, F.transform(channels, window)).withColumn(
        "start_frame", F.col("start_frame") - F.col("silence_frames")).drop("decision", "silence_frames", "discarded_frames")


def seek_trim(chunks: DataFrame, ts: str, rate: str, start: str, channels: str = "channels") -> DataFrame:
    """A2. Whole frames at or after a seek time: leading frames are cut, chunks wholly before it dropped, and no chunk
    starts before it."""
    frames = F.size(F.col(channels)[0]).cast("long")
    lead = F.greatest(F.col(start) - F.col(ts), F.lit(0))
    offset = F.ceil(lead * F.col(rate) / 1_000_000).cast("long")
    before = (lead > 0) & (lead >= F.ceil(frames * 1_000_000 / F.col(rate)))
    trimmed = chunks.withColumn("__offset", offset).where(~before & (offset < frames))
    moved = F.greatest(F.col(ts) + frames_to_micros(F.col("__offset"), F.col(rate)), F.col(start))
    return trimmed.withColumn(
        ts, F.when(F.col("__offset") > 0, moved).otherwise(F.col(ts))).withColumn(
        channels, F.transform(channels, lambda c: F.slice(c, F.col("__offset").cast("int") + 1, F.size(c)))).drop("__offset")


# ---- A3, A4 ---------------------------------------------------------------------------------------------------
def _mix(channels: Column, weights: Column) -> Column:
    """One array: the sum of the channels by their weights, skipping channels without weight."""
    used = F.filter(F.zip_with(channels, weights, lambda c, w: F.struct(c.alias("c"), w.alias("w"))), lambda item: item["w"] != 0)
    silence = F.array_repeat(F.lit(0.0), F.size(channels[0]))
    return F.aggregate(used, silence, lambda total, item: F.zip_with(
        total, item["c"], lambda a, x: a + x.cast("double") * item["w"]))


def _literal(rows) -> Column:
    return F.array(*[F.array(*[F.lit(float(w)) for w in row]) for row in rows])


def downmix(
    chunks: DataFrame, layout: str, algorithm: str = "standard-loro", center: float = 1.0, surround: float = 1.0,
    output: float = 1.0, ramp_from: tuple[float, float, float] | None = None, rate: str | None = None,
    position: str | None = None, channels: str = "channels",
) -> DataFrame:
    """A3. ``left`` and ``right`` of each chunk by its layout, with user gains for centre, surrounds and output.

    With ``ramp_from`` the gains move in a straight line from those values over 20 ms; ``position`` counts a chunk's
    first frame from the start of the ramp.
    """
    levels = ["none", "center", "surround", "fixed"]
    table = F.create_map(*[part for name in LAYOUT_SPEAKERS for part in (
        F.lit(name), F.array(*[_literal([
            [w[side] if w[2] == level else 0.0 for w in downmix_weights(name, algorithm)] for level in levels]) for side in (0, 1)]))])
    staged = chunks.withColumn("__weights", F.try_element_at(table, F.col(layout)))
    now = (center, surround, output)

    def gain(n, index):
        if ramp_from is None:
            return F.lit(float(now[n]))
        length = F.greatest(F.lit(1.0), F.ceil(F.col(rate) * RAMP_MS / 1000).cast("double"))
        done = F.least((index + 1 + F.coalesce(F.col(position), F.lit(0))).cast("double") / length, F.lit(1.0))
        return F.lit(float(ramp_from[n])) + done * (now[n] - ramp_from[n])

    for n, name in enumerate(("left", "right")):
        parts = {f"__p{level}": _mix(F.col(channels), F.col("__weights")[n][level]) for level in range(4)}
        staged = staged.withColumns(parts)
        zipped = F.arrays_zip("__p0", "__p1", "__p2", "__p3")
        staged = staged.withColumn(name, F.transform(zipped, lambda p, i: (
            p["__p3"] + (p["__p0"] + p["__p1"] * gain(0, i) + p["__p2"] * gain(1, i)) * gain(2, i)).cast("float")))
        staged = staged.drop(*parts)
    return staged.drop("__weights")


def route_channels(chunks: DataFrame, layout: str, output: str, channels: str = "channels") -> DataFrame:
    """A4. Channels of each chunk routed by speaker name into an output layout, with ``needs_limiter`` where speakers sum
    several channels."""
    routes = {name: routing(name, output) for name in LAYOUT_SPEAKERS}
    weights = F.create_map(*[part for name, (rows, _) in routes.items() for part in (F.lit(name), _literal(rows))])
    sums = F.create_map(*[part for name, (_, total) in routes.items() for part in (F.lit(name), F.lit(total))])
    routed = F.transform(F.try_element_at(weights, F.col(layout)), lambda row: _mix(F.col(channels), row))
    return chunks.withColumn("needs_limiter", F.try_element_at(sums, F.col(layout))).withColumn(
        channels, routed.cast(SAMPLES))


# ---- blocks ---------------------------------------------------------------------------------------------------
def _blocks(chunks: DataFrame, key: list[str], start: str, channels: str, before: int, after: int, block: int) -> DataFrame:
    """Blocks of ``block`` frames with the pieces of chunks within ``before`` frames ahead of them and ``after`` behind.

    The number of frames that meet in one row is bounded by the block, however long a stream is.
    """
    size = F.size(F.col(channels)[0])
    first = F.floor((F.col(start) - after) / block).cast("long")
    last = F.floor((F.col(start) + size - 1 + before) / block).cast("long")
    spread = chunks.where(size > 0).select(
        *key, F.col(start).cast("long").alias("__s"), F.col(channels).alias("__c"),
        F.explode(F.sequence(F.greatest(first, F.lit(0).cast("long")), last)).alias("__block"))
    low = F.greatest(F.col("__block") * block - before, F.col("__s"))
    high = F.least((F.col("__block") + 1) * block + after, F.col("__s") + F.size(F.col("__c")[0]))
    piece = F.transform("__c", lambda c: F.slice(c, (low - F.col("__s")).cast("int") + 1, (high - low).cast("int")))
    pieces = spread.where(high > low).select(*key, "__block", F.struct(low.alias("at"), piece.alias("c")).alias("__piece"))
    return pieces.groupBy(*key, "__block").agg(F.sort_array(F.collect_list("__piece")).alias("__pieces"))


def _assemble(pieces) -> tuple[int, np.ndarray]:
    """First frame and samples (channels x frames) of a block's pieces; a gap between pieces is silent."""
    at = int(pieces[0]["at"])
    end = max(int(p["at"]) + len(p["c"][0]) for p in pieces)
    samples = np.zeros((len(pieces[0]["c"]), end - at))
    for piece in pieces:
        offset = int(piece["at"]) - at
        for n, channel in enumerate(piece["c"]):
            samples[n, offset:offset + len(channel)] = channel
    return at, samples


# ---- A5 -------------------------------------------------------------------------------------------------------
def filter_table(source: int, target: int) -> tuple[int, np.ndarray]:
    """Radius and taps (phases x taps) of the windowed sinc between two rates."""
    radius = math.ceil(RADIUS * max(1, source / QUALIFIED_RATE))
    cutoff = min(1, target / source) * CUTOFF_HEADROOM
    distance = np.arange(2 * radius)[None, :] - radius + 1 - np.arange(PHASES + 1)[:, None] / PHASES
    x = distance / radius
    window = np.where(np.abs(x) >= 1, 0.0, 0.42 + 0.5 * np.cos(np.pi * x) + 0.08 * np.cos(2 * np.pi * x))
    taps = cutoff * np.sinc(cutoff * distance) * window
    return radius, taps / taps.sum(axis=1, keepdims=True)


def _rate(rate: int | str) -> Column:
    return (F.col(rate) if isinstance(rate, str) else F.lit(rate)).cast("long")


def resample(
    chunks: DataFrame, key, start: str, source: int | str, target: int | str, channels: str = "channels", block: int = BLOCK_FRAMES,
) -> DataFrame:
    """A5. Streams at another rate: (key, ``out_start``, ``channels``), one row per block.

    Rates are numbers for all streams or columns, equal within a stream. Output frame j lies at source frame j * source / target, so
    every block works out its own frames from the samples within the filter's radius; the ends of a stream are extended by
    their last sample. A task makes a filter once for each ratio of rates that it meets.
    """
    key = [key] if isinstance(key, str) else list(key)
    rated = chunks.withColumns({"__source": _rate(source), "__target": _rate(target)})
    radius = F.ceil(RADIUS * F.greatest(F.lit(1.0), F.col("__source") / QUALIFIED_RATE))
    blocks = _blocks(rated, [*key, "__source", "__target"], start, channels, radius, radius, block)
    schema = T.StructType([blocks.schema[name] for name in key] + list(T.StructType.fromDDL(f"out_start bigint, channels {SAMPLES}")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bank: dict[tuple, tuple[int, np.ndarray]] = {}
        for pdf in batches:
            rows = []
            for *name, source, target, number, pieces in pdf.itertuples(index=False):
                at, samples = _assemble(pieces)
                end = at + samples.shape[1]
                low, high = int(number) * block, min((int(number) + 1) * block, end)
                if high <= low:
                    continue
                first = -(-low * target // source)
                outputs = np.arange(first, -(-high * target // source), dtype=np.int64)
                if not len(outputs):
                    continue
                if source == target:
                    rows.append((*name, int(first), samples[:, low - at:high - at].astype(np.float32).tolist()))
                    continue
                shared = math.gcd(source, target)
                # Above the rate up to which filters are alike their length follows the source's
                ratio = (source // shared, target // shared, max(source, QUALIFIED_RATE))
                if ratio not in bank:
                    bank[ratio] = filter_table(source, target)
                radius, taps = bank[ratio]
                position = outputs * source
                frame = position // target
                phase = np.floor((position - frame * target) * PHASES / target + 0.5).astype(np.int64)
                index = np.clip(frame[:, None] - radius + 1 + np.arange(2 * radius)[None, :] - at, 0, samples.shape[1] - 1)
                weights = taps[phase]
                rows.append((*name, int(first), [
                    np.einsum("ij,ij->i", channel[index], weights).astype(np.float32).tolist() for channel in samples]))
            yield pd.DataFrame(rows, columns=schema.names)

    return blocks.select(*key, "__source", "__target", "__block", "__pieces").mapInPandas(run, schema)


# ---- A6, A7 ---------------------------------------------------------------------------------------------------
def signal_stats(chunks: DataFrame, group: list[str], ts: str, width_us: int, channels: str = "channels") -> DataFrame:
    """A6. Peak, RMS and crest factor in decibels, clipped and non-finite samples per group and time window."""

    def finite(x):
        return ~F.isnan(x) & (F.abs(x) != float("inf"))

    flat = F.transform(F.flatten(channels), lambda x: x.cast("double"))
    staged = chunks.select(*group, (F.floor(F.col(ts) / width_us) * width_us).cast("long").alias("window_us"), flat.alias("__x"))
    staged = staged.withColumn("__ok", F.filter("__x", finite))
    per_chunk = staged.select(
        *group, "window_us", F.size("__ok").cast("long").alias("__n"), (F.size("__x") - F.size("__ok")).cast("long").alias("__bad"),
        F.array_max(F.transform("__ok", F.abs)).alias("__peak"),
        F.aggregate("__ok", F.lit(0.0), lambda a, x: a + x * x).alias("__squares"),
        F.size(F.filter("__ok", lambda x: F.abs(x) > 1)).cast("long").alias("__clipped"))
    stats = per_chunk.groupBy(*group, "window_us").agg(
        F.sum("__n").alias("samples"), F.max("__peak").alias("peak"), F.sum("__squares").alias("square_sum"),
        F.sum("__clipped").alias("clipped"), F.sum("__bad").alias("non_finite"))
    mean = F.try_divide("square_sum", F.col("samples").cast("double"))
    return stats.withColumn("rms_dbfs", F.when(mean > 0, 10 * F.log10(mean))).withColumn(
        "crest_db", F.when((mean > 0) & (F.col("peak") > 0), 20 * F.log10(F.col("peak") / F.sqrt(mean))))


def normalization_gain(items: DataFrame, track: str, album: str, mode: str) -> DataFrame:
    """A7. ``linear_gain`` of each item's metadata gain in decibels: the mode's own gain, else the other, else 1."""
    chosen = F.when(F.col(mode) == "TrackGain", F.coalesce(track, album)).when(F.col(mode) == "AlbumGain", F.coalesce(album, track))
    usable = chosen.isNotNull() & ~F.isnan(chosen) & (F.abs(chosen) != float("inf"))
    gain = F.pow(F.lit(10.0), chosen / 20)
    return items.withColumn("linear_gain", F.when(usable & (gain < float("inf")), gain).otherwise(1.0))


# ---- A8 -------------------------------------------------------------------------------------------------------
def _frames_of(milliseconds: float, rate: int) -> int:
    return max(1, math.ceil(milliseconds * rate / 1000))


def attack_constraint(peaks: np.ndarray, count: int, rate: int) -> np.ndarray:
    """Gain each of the first ``count`` frames may have at most: its own ceiling, and quintic ramps before later peaks."""
    low, high = (_frames_of(ms, rate) for ms in ATTACK_MS)
    allowed = np.ones(count)
    for peak in np.flatnonzero(peaks > CEILING):
        needed = CEILING / peaks[peak]
        severity = min(1.0, -20 * math.log10(needed) / FULL_ATTACK_DB)
        length = math.floor(low + (high - low) * severity + 0.5)
        first, last = max(0, peak - length), min(count - 1, peak)
        if first > last:
            continue
        t = np.clip(1 - (peak - np.arange(first, last + 1)) / length, 0, 1)
        ramp = 1 - (1 - needed) * t * t * t * (t * (6 * t - 15) + 10)
        allowed[first:last + 1] = np.minimum(allowed[first:last + 1], ramp)
        if peak < count:
            allowed[peak] = min(allowed[peak], needed)
    return allowed


def release(reduction: np.ndarray, decay: float, entry: float) -> np.ndarray:
    """Running maximum of reductions that decay by ``decay`` per frame, from an entry reduction.

    Taken in logarithms over spans short enough that the decay never underflows.
    """
    result = np.empty_like(reduction)
    slope = -math.log(decay)
    for begin in range(0, len(reduction), 65_536):
        part = reduction[begin:begin + 65_536]
        steps = np.arange(1, len(part) + 1) * slope
        with np.errstate(divide="ignore"):
            grown = np.maximum.accumulate(np.log(part) + steps)
            carried = np.log(entry) if entry > 0 else -np.inf
        result[begin:begin + len(part)] = np.exp(np.maximum(grown, carried) - steps)
        entry = result[begin + len(part) - 1]
    return np.maximum(result, reduction)


def limit_peaks(
    chunks: DataFrame, key, start: str, rate: int | str, channels: str = "channels", block: int = BLOCK_FRAMES,
) -> DataFrame:
    """A8. Streams held below -1 dBFS by one gain for all channels: (key, ``block_no``, ``start_frame``, ``channels``,
    ``limited_frames``, ``minimum_gain``, ``input_peak``, ``output_peak``).

    The rate is a number for all streams or a column, equal within a stream. The attack needs the next 10 ms, which a block carries. The release is a maximum of decaying reductions, so each
    block first tells the reduction it ends with, a running maximum over those few numbers gives every block the one it
    starts from, and no pass over samples is sequential.
    """
    key = [key] if isinstance(key, str) else list(key)
    rated = chunks.withColumn("__rate", _rate(rate))
    reach = F.greatest(F.lit(1), F.ceil(F.col("__rate") * ATTACK_MS[1] / 1000))
    blocks = _blocks(rated, [*key, "__rate"], start, channels, 0, reach, block)

    def fall(rate):
        """What a reduction's logarithm loses in a frame."""
        return 1 / (RELEASE_MS / 1000 * rate)

    def prepare(number, rate, pieces):
        at, samples = _assemble(pieces)
        low = int(number) * block
        count = min((int(number) + 1) * block, at + samples.shape[1]) - max(low, at)
        if at >= low + block or count <= 0:
            return None
        peaks = np.abs(samples).max(axis=0)
        return at, samples[:, :count], peaks[:count], 1 - attack_constraint(peaks, count, rate)

    names = [blocks.schema[name] for name in key]
    ends_schema = T.StructType(names + list(T.StructType.fromDDL("block_no bigint, __end bigint, __log double")))

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for *name, rate, number, pieces in pdf.itertuples(index=False):
                ready = prepare(number, rate, pieces)
                if ready is not None:
                    left = release(ready[3], math.exp(-fall(rate)), 0.0)[-1]
                    end = ready[0] + len(ready[2])
                    rows.append((*name, int(number), end, math.log(left) + fall(rate) * end if left > 0 else None))
            yield pd.DataFrame(rows, columns=ends_schema.names)

    told = blocks.select(*key, "__rate", "__block", "__pieces").mapInPandas(ends, ends_schema)
    carried = Timeline(told, key, "block_no").scan(__reached=RunningMax("__log")).scan(__log_so_far=Lag("__reached")).df
    entries = carried.select(*key, F.col("block_no").alias("__block"), "__log_so_far")
    joined = blocks.join(entries, [*key, "__block"], "left")
    schema = T.StructType(names + list(T.StructType.fromDDL(
        f"block_no bigint, start_frame bigint, channels {SAMPLES}, limited_frames bigint, minimum_gain double, "
        "input_peak double, output_peak double")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for *name, rate, number, pieces, log_so_far in pdf.itertuples(index=False):
                ready = prepare(number, rate, pieces)
                if ready is None:
                    continue
                at, samples, peaks, reduction = ready
                known = log_so_far is not None and log_so_far == log_so_far
                entry = math.exp(log_so_far - fall(rate) * at) if known else 0.0
                gain = 1 - release(reduction, math.exp(-fall(rate)), entry)
                out = samples * gain
                rows.append((*name, int(number), at, out.astype(np.float32).tolist(), int((gain < 1 - LIMITED_EPSILON).sum()),
                             float(gain.min()), float(peaks.max()), float(np.abs(out).max())))
            yield pd.DataFrame(rows, columns=schema.names)

    return joined.select(*key, "__rate", "__block", "__pieces", "__log_so_far").mapInPandas(run, schema)


# ---- A9 -------------------------------------------------------------------------------------------------------
def content_identity(rows: DataFrame, seq: str, payload: str) -> DataFrame:
    """A9. ``content_hash`` of each row's payload, the copies of it and whether the row is the first."""
    hashed = rows.withColumn("content_hash", F.sha2(F.col(payload).cast("binary"), 256)).drop(payload)
    groups = content_groups(hashed, seq)
    return hashed.join(groups, "content_hash").withColumn("is_first", F.col(seq) == F.col("first_seq"))


def content_groups(hashed: DataFrame, seq: str) -> DataFrame:
    """A9. One row per distinct content: copies and the first occurrence."""
    return hashed.groupBy("content_hash").agg(F.count(F.lit(1)).alias("copies"), F.min(seq).alias("first_seq"))

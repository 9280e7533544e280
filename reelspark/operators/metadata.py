"""Association of metadata and layers with frames (M)."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..plans import Fold, Framed, Lag, LastKnown, Lead, RowNumber, RunningMax, RunningSum, Timeline, fold
from ..plans.skew import find_chunks

# Fixed values
MAXIMUM_LUMINANCE_NITS = 10_000.0
BT2020_LUMA = (0.2627, 0.6780, 0.0593)
STATIC_FIELDS = ["max_nits", "min_nits", "cll", "fall"]


class PairFold(Fold):
    """M1. Over both layers in time order; state: the frames of one side still waiting for a partner.

    Each row yields the waiting frame of the other side it completes, if any. Only one side can be waiting, since a
    frame takes the earliest partner within the tolerance as soon as it comes.
    """

    inputs = ["__t", "__side", "__seq", "__back"]
    schema = "__own_back boolean, __p_seq bigint, __p_t bigint, __p_back boolean"

    def __init__(self, tolerance: int):
        self.tolerance = tolerance

    def initial(self):
        return [0, []]

    def step(self, state, row):
        waiting_side, waiting = state
        at, side, seq, back = row
        waiting = [item for item in waiting if item[1] >= at - self.tolerance]
        if waiting and waiting_side != side:
            return [waiting_side, waiting[1:]], (back, *waiting[0])
        return [side, waiting + [[seq, at, back]]], (back, None, None, None)


def pair_layers(
    base: DataFrame, enhancement: DataFrame, key, base_seq: str, base_ts: str, enh_seq: str, enh_ts: str, tolerance: int = 1,
) -> DataFrame:
    """M1. One-to-one pairs of base and enhancement frames in time order within ``tolerance``.

    Returns (key, ``base_no``, ``base_us``, ``enh_no``, ``enh_us``, ``status``): paired, base-only, or enhancement-only
    for a frame that was discarded; ``out-of-order`` where a frame's number falls behind its side's times.

    Frames whose neighbours are within the tolerance form an island. A frame alone, or one frame of each side, is
    settled by looking at its neighbours; only larger islands go through the sequential rule.
    """
    key = [key] if isinstance(key, str) else list(key)

    def side(df: DataFrame, seq: str, ts: str, number: int) -> DataFrame:
        return df.select(
            *key, F.col(seq).cast("long").alias("__seq"), F.col(ts).cast("long").alias("__t"), F.lit(number).alias("__side"))

    both = side(base, base_seq, base_ts, 0).unionByName(side(enhancement, enh_seq, enh_ts, 1))
    order = ["__t", "__side", "__seq"]
    chunks = find_chunks(both, key, order).unless_small(both)
    line = Timeline(both, key, order, chunks).scan(
        __near=Lag("__t"), __top0=RunningMax(F.when(F.col("__side") == 0, F.col("__seq"))),
        __top1=RunningMax(F.when(F.col("__side") == 1, F.col("__seq"))))
    line = line.apply(lambda df: df.withColumn(
        "__opens", F.coalesce((F.col("__t") - F.col("__near") > tolerance).cast("int"), F.lit(1))).withColumn(
        "__back", F.col("__seq") < F.when(F.col("__side") == 0, F.col("__top0")).otherwise(F.col("__top1"))))
    line = line.scan(
        __island=RunningSum("__opens"), __before=Lag(F.struct("__opens", "__side")),
        __after=Lead(F.struct("__opens", "__side", "__seq", "__t", "__back")),
        __then=Framed(lambda w: F.lead("__opens", 2, 1).over(w), 0, 2))
    ends = F.coalesce(F.col("__after.__opens"), F.lit(1)) == 1
    opens = F.col("__opens") == 1
    alone = opens & ends
    leads = opens & ~ends & (F.col("__then") == 1) & (F.col("__after.__side") != F.col("__side"))
    follows = ~opens & ends & (F.col("__before.__opens") == 1) & (F.col("__before.__side") != F.col("__side"))
    rows = line.df.select(
        *key, *order, "__back", "__island",
        F.when(leads, F.struct("__after.__seq", "__after.__t", "__after.__back")).alias("__partner"),
        F.when(alone | leads, "settled").when(follows, "done").otherwise("crowded").alias("__path"))
    own = F.struct("__seq", "__t", "__back")
    settled = rows.where("__path = 'settled'").select(*key, "__side", own.alias("__own"), "__partner")

    group = [*key, "__island"]
    folded = fold(rows.where("__path = 'crowded'"), group, order, PairFold(tolerance), small_keys=not chunks)
    mine = F.struct(F.col("__seq"), F.col("__t"), F.col("__own_back").alias("__back"))
    other = F.struct(F.col("__p_seq").alias("__seq"), F.col("__p_t").alias("__t"), F.col("__p_back").alias("__back"))
    matched = F.when(F.col("__p_seq").isNotNull(), other)
    # A completed pair is told to both of its frames, so each frame ends up with its partner or with none
    told = F.filter(F.array(
        F.struct(F.col("__side"), mine.alias("__own"), matched.alias("__partner")),
        F.when(F.col("__p_seq").isNotNull(), F.struct(
            (1 - F.col("__side")).alias("__side"), other.alias("__own"), mine.alias("__partner"))),
    ), lambda item: item.isNotNull())
    frames = (
        folded.select(*group, F.explode(told).alias("__told")).select(*group, "__told.*")
        .groupBy(*group, "__side", "__own").agg(F.max("__partner").alias("__partner")))
    # A pair is reported from its base
    greedy = frames.where("__side = 0 OR __partner IS NULL").select(*key, "__side", "__own", "__partner")
    found = settled.unionByName(greedy)
    is_base = F.col("__side") == 0
    result = found.select(
        *key, F.when(is_base, F.col("__own")).otherwise(F.col("__partner")).alias("__b"),
        F.when(is_base, F.col("__partner")).otherwise(F.col("__own")).alias("__e"))
    back = F.coalesce(F.col("__b.__back"), F.lit(False)) | F.coalesce(F.col("__e.__back"), F.lit(False))
    status = (
        F.when(back, "out-of-order").when(F.col("__e").isNull(), "base-only")
        .when(F.col("__b").isNull(), "enhancement-only").otherwise("paired"))
    return result.select(
        *key, F.col("__b.__seq").alias("base_no"), F.col("__b.__t").alias("base_us"),
        F.col("__e.__seq").alias("enh_no"), F.col("__e.__t").alias("enh_us"), status.alias("status"))


def align_layers(
    base: DataFrame, enhancement: DataFrame, key, base_seq: str, base_ts: str, enh_seq: str, enh_ts: str, tolerance: int = 1,
) -> DataFrame:
    """M2. The n-th enhancement packet beside the n-th base packet in decode order, flagging times that differ."""
    key = [key] if isinstance(key, str) else list(key)

    def numbered(df: DataFrame, seq: str, ts: str, name: str) -> DataFrame:
        counted = Timeline(df, key, seq).scan(ordinal=RowNumber()).df
        return counted.select(*key, "ordinal", F.col(seq).alias(f"{name}_no"), F.col(ts).alias(f"{name}_us"))

    joined = numbered(base, base_seq, base_ts, "base").join(
        numbered(enhancement, enh_seq, enh_ts, "enh"), [*key, "ordinal"], "left")
    return joined.withColumn("misaligned", F.coalesce(F.abs(F.col("enh_us") - F.col("base_us")) > tolerance, F.lit(False)))


def static_metadata_scan(units: DataFrame, stream: str, unit_no: str, malformed: str = "malformed", n: int = 16) -> DataFrame:
    """M3. Static HDR metadata of a stream from its first ``n`` units, columns ``max_nits, min_nits, cll, fall``.

    The earliest unit that is malformed or differs from an earlier one decides the status and discards every value.
    """
    at = Window.partitionBy(stream).orderBy(unit_no)
    head = units.withColumn("__rank", F.row_number().over(at)).where(F.col("__rank") <= n)
    for name in ("cll", "fall"):
        head = head.withColumn(name, F.when(F.col(name) != 0, F.col(name)))

    def outside(name, low):
        return F.coalesce(F.isnan(name) | (F.col(name) < low) | (F.col(name) > MAXIMUM_LUMINANCE_NITS), F.lit(False))

    bad = (
        F.coalesce(F.col(malformed), F.lit(False)) | outside("max_nits", 1) | outside("min_nits", 0) | outside("cll", 1)
        | outside("fall", 1) | F.coalesce(F.col("min_nits") >= F.col("max_nits"), F.lit(False)))
    so_far = at.rowsBetween(Window.unboundedPreceding, 0)
    differs = reduce(lambda a, b: a | b, [
        F.coalesce(F.min(name).over(so_far) != F.max(name).over(so_far), F.lit(False)) for name in STATIC_FIELDS])
    some = reduce(lambda a, b: a | b, [F.col(name).isNotNull() for name in STATIC_FIELDS])
    marked = head.select(
        stream, "__rank", *STATIC_FIELDS, some.alias("__some"),
        F.when(bad, F.col("__rank")).alias("__bad"), F.when(differs, F.col("__rank")).alias("__differs"))
    merged = marked.groupBy(stream).agg(
        F.count(F.lit(1)).alias("scanned_units"), F.min("__bad").alias("__bad"), F.min("__differs").alias("__differs"),
        F.min(F.when(F.col("__some"), F.col("__rank") - 1)).alias("__first"),
        *[F.max(name).alias(name) for name in STATIC_FIELDS])
    crossed = F.coalesce(F.col("min_nits") >= F.col("max_nits"), F.lit(False))
    status = (
        F.when(F.coalesce(F.col("__differs") < F.coalesce("__bad", F.lit(n + 1)), F.lit(False)), "conflicting")
        .when(F.col("__bad").isNotNull(), "malformed").when(F.col("__first").isNull(), "absent")
        .when(crossed, "malformed").otherwise("valid"))
    valid = F.col("status") == "valid"
    return merged.withColumn("status", status).select(
        stream, "scanned_units", "status", F.when(valid, F.col("__first")).alias("first_unit"),
        *[F.when(valid, F.col(name)).alias(name) for name in STATIC_FIELDS],
        F.when(valid, F.coalesce("max_nits", "cll")).alias("peak_nits"))


def message_state(units: DataFrame, messages: DataFrame, key, status: str, payload: str) -> DataFrame:
    """M4. One state per access unit from its messages' statuses (parsed, unsupported, malformed, ignored)."""
    key = [key] if isinstance(key, str) else list(key)
    parsed = F.col(status).isin("parsed", "unsupported")
    states = messages.groupBy(*key).agg(
        F.max((F.col(status) == "malformed").cast("int")).alias("__bad"), F.count_if(parsed).alias("__parsed"),
        F.min(F.when(parsed, F.col(payload))).alias("__low"), F.max(F.when(parsed, F.col(payload))).alias("__high"),
        F.max((F.col(status) == "unsupported").cast("int")).alias("__unsupported"))
    state = (
        F.when(F.col("__bad") == 1, "malformed").when(F.coalesce("__parsed", F.lit(0)) == 0, "absent")
        .when(F.col("__low") != F.col("__high"), "conflicting").when(F.col("__unsupported") == 1, "unsupported").otherwise("valid"))
    joined = units.select(*key).join(states, key, "left").withColumn("status", state)
    return joined.select(*key, "status", F.when(F.col("status") == "valid", F.col("__low")).alias("payload"))


def carry_metadata(packets: DataFrame, frames: DataFrame, key, seq: str, ts: str, status: str, payload: str, frame_no: str) -> DataFrame:
    """M5. The metadata in force at each frame.

    In decode order a valid payload holds until the next valid, conflicting or unsupported one; frames take the payload
    of the packet with their time and ordinal within that time. Rows without a partner are reported.
    """
    key = [key] if isinstance(key, str) else list(key)
    change = F.when(F.col(status).isin("valid", "conflicting", "unsupported"),
                    F.struct(F.when(F.col(status) == "valid", F.col(payload)).alias("payload")))
    carried = Timeline(packets, key, seq).scan(__held=LastKnown(change)).df
    ordinal = [*key, ts]
    left = Timeline(carried, ordinal, seq).scan(ordinal=RowNumber()).df.select(
        *ordinal, "ordinal", F.col(seq).alias("packet_no"), F.col("__held.payload").alias("payload"))
    right = Timeline(frames.select(*ordinal, frame_no), ordinal, frame_no).scan(ordinal=RowNumber()).df.withColumnRenamed(
        frame_no, "frame_no")
    match = F.when(F.col("packet_no").isNull(), "frame-only").when(F.col("frame_no").isNull(), "packet-only").otherwise("matched")
    return left.join(right, [*ordinal, "ordinal"], "full_outer").withColumn("match", match)


def scene_luminance(meta: DataFrame, average: str, scl: str, percentiles: str) -> DataFrame:
    """M6. Whole-frame peak and average nits from a dynamic-metadata payload."""
    brightest = F.array_max(scl)
    weighted = sum((F.element_at(scl, n + 1) * weight for n, weight in enumerate(BT2020_LUMA[1:], 1)),
                   F.element_at(scl, 1) * BT2020_LUMA[0])
    listed = F.coalesce(F.array_max(F.transform(percentiles, lambda item: item["nits"])), F.lit(0.0))
    by_scl = brightest > 0
    peak = F.when(by_scl, weighted).otherwise(listed)
    mean = F.when(by_scl, F.try_divide(F.col(average) * weighted, brightest)).otherwise(F.col(average))
    return meta.withColumn("peak_nits", F.when(peak > 0, peak)).withColumn("average_nits", F.when(mean > 0, mean))

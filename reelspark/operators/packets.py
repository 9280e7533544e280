"""Packets, units and pictures (P)."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.framing import STATUSES, find_units
from ..plans import Framed, Lag, Lead, RunningSum, Timeline, asof_join

# Fixed values
PROGRAM_CLOCK_CONTAINERS = ["ts", "m2ts", "mts", "mpeg", "mpg", "vob"]
INDEXED_CONTAINERS = ["avi"]
HEVC_LAST_VCL_TYPE = 31
HEVC_LAST_SUB_LAYER_NON_REFERENCE_TYPE = 14
HEVC_SPS_TYPE = 33
AV1_FRAME_TYPES = [3, 6, 7]

UNIT_COLUMNS = T.StructType().add("unit_no", "integer").add("offset", "long").add("size", "long").add("type", "integer").add(
    "layer", "integer").add("temporal_id", "integer").add("hidden", "boolean").add("status", "string")


# ---- P1 -------------------------------------------------------------------------------------------------------
_SLICE_BYTES = 16 << 20


def _unit_batch(keys: list[pa.Array], payload: pa.Array, framing: str, schema: pa.Schema) -> pa.RecordBatch:
    """Units of some packets, each with its packet's keys; a malformed packet is one row with its status."""
    payload = payload.fill_null(b"")
    edges = np.frombuffer(payload.buffers()[1], np.int32)[payload.offset:payload.offset + len(payload) + 1].astype(np.int64)
    data = np.frombuffer(payload.buffers()[2] or b"", np.uint8)[edges[0]:edges[-1]]
    edges = edges - edges[0]
    units = find_units(data, edges[:-1], edges[1:], framing)
    bad = np.flatnonzero(units.status)
    packet = np.concatenate([units.packet, bad])
    order = np.argsort(packet, kind="stable")
    packet, is_unit = packet[order], order < len(units.packet)

    def column(values, kind):
        if values is None:
            return pa.nulls(len(packet), kind)
        return pa.array(np.concatenate([values, np.zeros(len(bad), values.dtype)])[order], mask=~is_unit).cast(kind)

    units_before = np.searchsorted(units.packet, units.packet)
    values = {
        "unit_no": np.arange(len(units.packet)) - units_before, "offset": units.begin - edges[units.packet],
        "size": units.end - units.begin, "type": units.type, "layer": units.layer, "temporal_id": units.temporal_id,
        "hidden": units.hidden}
    rows = pa.array(packet)
    columns = [key.take(rows) for key in keys] + [column(values[name], schema.field(name).type) for name in values]
    return pa.RecordBatch.from_arrays([*columns, pa.array(STATUSES).take(pa.array(units.status[packet]))], schema=schema)


def split_units(data: bytes, framing: str) -> list[tuple]:
    """Units of one packet as UNIT_COLUMNS rows; a malformed packet is one row with its status.

    ``framing`` is ``annex-b``, ``length-1`` to ``length-4``, ``av1`` or ``vp9``.
    """
    batch = _unit_batch([], pa.array([data], pa.binary()), framing, to_arrow_schema(UNIT_COLUMNS))
    return list(zip(*(column.to_pylist() for column in batch.columns)))


def unit_inventory(packets: DataFrame, key: list[str], payload: str, framing: str) -> DataFrame:
    """P1. One row per unit of each packet (type, layer and temporal id for NAL units), payload left out.

    Packets are split where they lie, some megabytes of them at once; a malformed packet gives one row with its status, and
    a null payload counts as an empty one.
    """
    own = packets.select(*key, F.col(payload).alias("__payload"))
    schema = T.StructType([own.schema[name] for name in key] + UNIT_COLUMNS.fields)
    wide = to_arrow_schema(UNIT_COLUMNS)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = pa.schema([batch.schema.field(n) for n in range(len(key))] + list(wide))
            reach = np.cumsum(pc.fill_null(pc.binary_length(batch.column(len(key))), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                limit = _SLICE_BYTES + (reach[at - 1] if at else 0)
                stop = max(at + 1, int(np.searchsorted(reach, limit, side="right")))
                part = batch.slice(at, stop - at)
                yield _unit_batch(part.columns[:-1], part.column(len(key)), framing, out)
                at = stop

    return own.mapInArrow(explode, schema)


def unit_summary(units: DataFrame, file: str, packet: str, framing: str) -> DataFrame:
    """P1. Per file and unit type: units and bytes, with the file's packets and the share that show a frame."""
    if framing == "av1":
        shows = F.col("type").isin(AV1_FRAME_TYPES)
    elif framing == "vp9":
        shows = ~F.col("hidden")
    else:
        shows = F.col("type") <= HEVC_LAST_VCL_TYPE
    shows = F.coalesce(shows, F.lit(False)) & (F.col("status") == "ok")
    per_packet = units.groupBy(file, packet).agg(F.max(shows.cast("int")).alias("shows"))
    per_file = per_packet.groupBy(file).agg(F.count(F.lit(1)).alias("packets"), F.avg("shows").alias("shown_share"))
    return (
        units.groupBy(file, "type", "status").agg(F.count(F.lit(1)).alias("units"), F.sum("size").alias("bytes"))
        .join(per_file, file)
    )


# ---- P2-P4 ----------------------------------------------------------------------------------------------------
def presentation_order(
    packets: DataFrame, key, seq: str, ts: str, duration: str, picture: str,
    metadata_only: str | None = None, n: int = 17, none_outputs: bool = False,
) -> DataFrame:
    """P2. Presentation time of decode-order packets, as ``presented_us``.

    An anchor takes the time of the first of the next ``n`` packets that outputs it, else the end of the last packet
    looked at; every other packet keeps its own time.
    """
    bare = F.coalesce(F.col(metadata_only), F.lit(False)) if metadata_only else F.lit(False)
    outputs = (F.col(picture) == "anchor") | bare
    if none_outputs:
        outputs = outputs | (F.col(picture) == "none")
    scanned = Timeline(packets, key, seq).scan(
        __output=Framed(lambda w: F.first(F.when(outputs, F.col(ts)), ignorenulls=True).over(w.rowsBetween(1, n)), 0, n),
        __end=Framed(lambda w: F.last(F.col(ts) + F.col(duration)).over(w.rowsBetween(0, n)), 0, n),
    ).df
    presented = F.when((F.col(picture) == "anchor") & ~bare, F.coalesce("__output", "__end")).otherwise(F.col(ts))
    return scanned.withColumn("presented_us", presented).drop("__output", "__end")


def seek_key_packet(
    requests: DataFrame, packets: DataFrame, key, at: str, seq: str, ts: str, presented: str, is_key: str,
) -> DataFrame:
    """P3. For each requested time: the latest key packet presented by then (``key_seq``, ``key_us``).

    When every key packet presents later, the earliest one; null when no key packet is stamped by then.
    """
    key = [key] if isinstance(key, str) else list(key)
    keys = packets.where(F.col(is_key)).select(*key, F.col(seq).alias("key_seq"), F.col(presented).alias("key_us"), ts)
    found = asof_join(requests, keys, key, at, "key_us", tie="key_seq", right_columns=["key_seq", "key_us"])
    first = keys.groupBy(*key).agg(
        F.min(ts).alias("__first_ts"),
        F.min_by(F.struct("key_seq", "key_us"), F.col("key_seq")).alias("__first"),
    )
    usable = F.col("key_seq").isNull() & (F.col("__first_ts") <= F.col(at))
    return found.join(first, key, "left").select(
        *[name for name in found.columns if name not in ("key_seq", "key_us")],
        F.when(usable, F.col("__first.key_seq")).otherwise(F.col("key_seq")).alias("key_seq"),
        F.when(usable, F.col("__first.key_us")).otherwise(F.col("key_us")).alias("key_us"),
    )


def start_packet(
    requests: DataFrame, packets: DataFrame, key, at: str, seq: str, ts: str, origin: str, preroll: int,
) -> DataFrame:
    """P4. Where to start reading audio: the packet at or before max(origin, time - preroll), else the first one."""
    key = [key] if isinstance(key, str) else list(key)
    asked = requests.withColumn("lookup_us", F.greatest(F.col(origin), F.col(at) - F.lit(preroll)))
    own = packets.select(*key, F.col(seq).alias("start_seq"), F.col(ts).alias("start_us"))
    found = asof_join(asked, own, key, "lookup_us", "start_us", tie="start_seq", right_columns=["start_seq", "start_us"])
    first = own.groupBy(*key).agg(F.min(F.struct("start_us", "start_seq")).alias("__first"))
    head = (F.col("lookup_us") <= F.col(origin)) | F.col("start_seq").isNull()
    return found.join(first, key, "left").select(
        *[name for name in found.columns if not name.startswith("start_")],
        F.when(head, F.col("__first.start_seq")).otherwise(F.col("start_seq")).alias("start_seq"),
        F.when(head, F.col("__first.start_us")).otherwise(F.col("start_us")).alias("start_us"),
    )


# ---- P5-P7 ----------------------------------------------------------------------------------------------------
def rebase_timeline(packets: DataFrame, files: DataFrame, file: str, ts: str, container: str) -> DataFrame:
    """P5. Packets with times counted from their file's origin: the first time on a program clock, else zero.

    A packet of a file that is not listed keeps its row, with null origin and time.
    """
    first = packets.groupBy(file).agg(F.min(ts).alias("__first"))
    origin = F.when(
        F.lower(container).isin(PROGRAM_CLOCK_CONTAINERS), F.greatest(F.lit(0), F.col("__first").cast("long"))
    ).otherwise(F.lit(0).cast("long"))
    origins = files.join(first, file).select(file, origin.alias("origin_us"))
    return packets.join(origins, file, "left").withColumn("rebased_us", F.col(ts) - F.col("origin_us"))


def index_coverage(
    files: DataFrame, packets: DataFrame, file: str, container: str, duration: str, ts: str, packet_duration: str,
    tolerance: int = 1_000_000,
) -> DataFrame:
    """P6. Files of an indexed container whose packets end more than ``tolerance`` before the declared duration."""
    ends = packets.groupBy(file).agg(F.max(F.col(ts) + F.col(packet_duration)).alias("__end"))
    indexed = files.where(F.lower(container).isin(INDEXED_CONTAINERS))
    return (
        indexed.join(ends, file, "left")
        .withColumn("end_us", F.coalesce("__end", F.lit(0).cast("long"))).drop("__end")
        .withColumn("missing_us", F.col(duration) - F.col("end_us"))
        .where(F.col("missing_us") > tolerance)
    )


def presentable(frames: DataFrame, ts: str, duration: str, interval: str) -> DataFrame:
    """P7. Flag the frames on screen at a multiple of the presentation interval; without one all are kept."""
    step = F.col(interval)
    ahead = F.pmod(-F.col(ts), F.when(step > 0, step))
    kept = F.when(F.col(interval).isNull() | (F.col(duration) <= 0), F.lit(True)).otherwise(
        F.coalesce(ahead < F.col(duration), F.lit(True)))
    return frames.withColumn("kept", kept)


def presentable_summary(frames: DataFrame, key: str) -> DataFrame:
    """P7. Kept and decimated frames per stream."""
    return frames.groupBy(key).agg(
        F.count_if("kept").alias("kept_frames"), F.count_if(~F.col("kept")).alias("decimated_frames"))


# ---- P8-P10 ---------------------------------------------------------------------------------------------------
def unreferenced_pictures(units: DataFrame, stream: str, au: str, unit_no: str, *, kind="type", layer="layer",
                          temporal="temporal_id", sps_id="sps_id", top="sps_max_sub_layer",
                          readable="readable") -> DataFrame:
    """P8. Access units whose picture no later picture references, with the highest temporal id known so far.

    The highest id is known while the latest parameter set of every id agrees and none was unreadable. Agreement is
    kept as running sums over the latest value of each id: they agree when n * sum(v^2) = (sum v)^2.
    """
    is_set = (F.col(kind) == HEVC_SPS_TYPE) & (F.col(layer) == 0)
    sets = units.where(is_set & F.col(readable)).select(stream, au, unit_no, sps_id, F.col(top).cast("long").alias("v"))
    changes = Timeline(
        sets.withColumn("__at", F.col(au).cast("long")), [stream, sps_id], ["__at", unit_no]
    ).scan(__was=Lag("v")).df
    was = F.coalesce("__was", F.lit(0).cast("long"))
    per_change = changes.groupBy(stream, au).agg(
        F.sum(F.when(F.col("__was").isNull(), 1).otherwise(0)).alias("__dn"),
        F.sum(F.col("v") - was).alias("__ds"), F.sum(F.col("v") * F.col("v") - was * was).alias("__dq"))
    base = (F.col(layer) == 0) & (F.col(kind) <= HEVC_LAST_VCL_TYPE)
    droppable = (F.col(kind) <= HEVC_LAST_SUB_LAYER_NON_REFERENCE_TYPE) & (F.col(kind) % 2 == 0)
    pictures = units.groupBy(stream, au).agg(
        F.count_if(is_set & ~F.col(readable)).alias("__bad"),
        F.count_if(base).alias("vcl_units"),
        F.count_if(base & ~droppable).alias("__kept"),
        F.min(F.when(base, F.col(temporal))).alias("__low"), F.max(F.when(base, F.col(temporal))).alias("__high"))
    joined = pictures.join(per_change, [stream, au], "left")
    scanned = Timeline(joined, stream, au).scan(
        n=RunningSum("__dn"), s=RunningSum("__ds"), q=RunningSum("__dq"), bad=RunningSum("__bad")).df
    known = (F.col("bad") == 0) & (F.col("n") > 0) & (F.col("n") * F.col("q") == F.col("s") * F.col("s"))
    highest = F.when(known, (F.col("s") / F.col("n")).cast("int"))
    result = scanned.select(stream, au, "vcl_units", highest.alias("highest_temporal_id"), "__kept", "__low", "__high")
    unreferenced = (F.col("vcl_units") > 0) & (F.col("__kept") == 0) & (
        F.col("__low") == F.col("highest_temporal_id")) & (F.col("__high") == F.col("highest_temporal_id"))
    return result.withColumn("unreferenced", F.coalesce(unreferenced, F.lit(False))).drop("__kept", "__low", "__high")


REPORTED_BIT, INTERLACED_BIT, TOP_FIRST_BIT, REPEAT_BIT = 1, 2, 4, 8


def decode_fields(frames: DataFrame, word: str, stream_scan: str) -> DataFrame:
    """P9. Scan and repeated field of a picture-fields word, else of the stream's scan.

    ``fields_status`` is reported, stream, unknown or invalid; an order nobody named presents its top field first.
    """
    bits = F.coalesce(F.col(word), F.lit(0))

    def has(bit):
        return bits.bitwiseAND(bit) != 0

    invalid = (bits != 0) & (~has(REPORTED_BIT) | (bits < 0) | (bits > 15))
    known_scan = F.when(F.col(stream_scan).isin("bottom-first", "interlaced", "progressive", "top-first"), F.col(stream_scan))
    own_scan = F.when(has(INTERLACED_BIT), F.when(has(TOP_FIRST_BIT), "top-first").otherwise("bottom-first")).otherwise("progressive")
    reported = ~invalid & has(REPORTED_BIT)
    scan = F.when(reported, own_scan).when(~invalid, known_scan)
    return (
        frames.withColumn("scan", scan)
        .withColumn("repeat_first_field", F.when(reported, ~has(INTERLACED_BIT) & has(REPEAT_BIT)).when(
            F.col("scan").isNotNull(), F.lit(False)))
        .withColumn("top_first", F.when(F.col("scan").isin("interlaced", "top-first", "bottom-first"), F.col("scan") != "bottom-first"))
        .withColumn("fields_status", F.when(invalid, "invalid").when(reported, "reported").when(
            F.col("scan").isNotNull(), "stream").otherwise("unknown"))
    )


def field_timeline(frames: DataFrame, key, ts: str, seq: str, duration: str, mode: str = "double-rate") -> DataFrame:
    """P10. The fields that present, from frames with P9's columns: ``field_no`` 1 or 2, ``field_us`` and
    ``top_field`` (null for a frame that presents whole)."""
    own = F.struct(F.col("scan").alias("scan"), F.col("repeat_first_field").alias("rff"))
    scanned = Timeline(frames, key, [ts, seq]).scan(
        __before=Lag(own), __after=Lead(own), __next=Lead(ts)).df

    def repeats(side: str):
        return F.coalesce((F.col(f"{side}.scan") == "progressive") & F.col(f"{side}.rff"), F.lit(False))

    interlaced = F.coalesce(F.col("scan") != "progressive", F.lit(False)) & ~repeats("__before") & ~repeats("__after")
    end = F.coalesce(F.col("__next"), F.col(ts) + F.col(duration))
    second_at = F.col(ts) + F.floor((end - F.col(ts)) / 2).cast("long")
    top_first = F.col("scan") != "bottom-first"
    second = F.when(
        interlaced & (F.lit(mode) == "double-rate") & (end > F.col(ts)),
        F.struct(F.lit(2).alias("field_no"), second_at.alias("field_us"), (~top_first).alias("top_field")))
    first = F.struct(F.lit(1).alias("field_no"), F.col(ts).alias("field_us"), F.when(interlaced, top_first).alias("top_field"))
    fields = F.filter(F.array(first, second), lambda field: field.isNotNull())
    return (
        scanned.withColumn("__field", F.explode(fields))
        .select(*frames.columns, "__field.*")
    )

"""Capability verdicts (V)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..plans import Fold, NextKnown, RunningSum, Timeline, fold

# Fixed values
DEFINITIVE = ["supported", "unsupported"]
TIMEOUT_REASON = "probe-timeout"


def canonical_json(text) -> Column:
    """V2. JSON text with every object's keys sorted and no spaces; null for text that is not JSON."""
    return F.to_json(F.try_parse_json(text))


def canonical_fingerprint(df: DataFrame, json: str) -> DataFrame:
    """V2. ``canonical`` text and its SHA-256 ``fingerprint``, equal for equal values whatever their key order."""
    return df.withColumn("canonical", canonical_json(json)).withColumn("fingerprint", F.sha2("canonical", 256))


def definitive(results: DataFrame, json: str) -> DataFrame:
    """V1. ``is_definitive``: the result holds at least one status, at any depth, and each is supported or
    unsupported. ``timed_out``: some reason beside a status is a timeout."""
    text = canonical_json(json)
    # In canonical text a quote inside a string is escaped, so these only match keys
    statuses = F.regexp_extract_all(F.col("__text"), F.lit(r'(?<!\\)"status":("(?:[^"\\]|\\.)*"|[^",}\]]*)'), F.lit(1))
    known = [f'"{status}"' for status in DEFINITIVE]
    return (
        results.withColumn("__text", text).withColumn("__statuses", F.coalesce(statuses, F.array().cast("array<string>")))
        .withColumn("is_definitive", (F.size("__statuses") > 0) & F.forall("__statuses", lambda status: status.isin(known)))
        .withColumn("timed_out", F.coalesce(F.col("__text").contains(f'"reason":"{TIMEOUT_REASON}"'), F.lit(False)))
        .drop("__text", "__statuses"))


VERDICT = ["host", "probe", "fingerprint", "schema_version", "result", "written_at"]


def upsert_verdicts(current: DataFrame, updates: DataFrame) -> DataFrame:
    """V3. The verdict table after an update: per host and probe the latest definitive result under the host's
    current fingerprint and schema. A change of either discards what the host had before it.

    Both tables have the VERDICT columns; ``written_at`` orders a host's rows. Every step is a hash aggregate or an
    equi join with at most one row per host on the other side.
    """
    both = current.select(*VERDICT).unionByName(updates.select(*VERDICT))
    known = definitive(both, "result").where("is_definitive").drop("is_definitive", "timed_out")
    # The newest result under each version of a host decides for that version, so all older ones go first
    kept = known.groupBy("host", "probe", "fingerprint", "schema_version").agg(
        F.max_by("result", "written_at").alias("result"), F.max("written_at").alias("written_at"))
    eras = kept.groupBy("host", "fingerprint", "schema_version").agg(F.max("written_at").alias("__last"))
    version = F.struct("fingerprint", "schema_version")
    latest = eras.groupBy("host").agg(F.max_by(version, F.col("__last")).alias("__now"))
    cutoffs = eras.join(latest, "host").groupBy("host").agg(
        F.first("__now").alias("__now"), F.max(F.when(version != F.col("__now"), F.col("__last"))).alias("__cutoff"))
    live = kept.join(cutoffs, "host").where(
        (version == F.col("__now")) & (F.col("__cutoff").isNull() | (F.col("written_at") > F.col("__cutoff"))))
    return live.select(*VERDICT)


def in_flight(calls: DataFrame, page: str, call: str, start: str, end: str, bytes_: str, decoders: str) -> DataFrame:
    """V4. Bytes, decoders and calls open on the page once each call starts, and whether another call overlaps it.

    A call that ends when another starts does not overlap it; a call without an end stays open.
    """
    opens = F.struct(F.col(start).alias("__t"), F.lit(1).alias("__kind"))
    closes = F.when(F.col(end).isNotNull(), F.struct(F.col(end).alias("__t"), F.lit(0).alias("__kind")))
    edges = (
        calls.select(page, call, start, end, bytes_, decoders, F.explode(F.filter(F.array(opens, closes), lambda e: e.isNotNull())).alias("__edge"))
        .select("*", "__edge.*").drop("__edge")
        .withColumn("__sign", F.when(F.col("__kind") == 1, 1).otherwise(-1)))
    swept = Timeline(edges, page, ["__t", "__kind", call]).scan(
        open_bytes=RunningSum(F.col(bytes_) * F.col("__sign")), open_decoders=RunningSum(F.col(decoders) * F.col("__sign")),
        open_calls=RunningSum("__sign"),
        __next=NextKnown(F.when(F.col("__kind") == 1, F.col("__t")), inclusive=False)).df
    later = F.col("__next").isNotNull() & (F.col(end).isNull() | (F.col("__next") < F.col(end)))
    return swept.where("__kind = 1").select(
        page, call, start, end, "open_bytes", "open_decoders", "open_calls",
        ((F.col("open_calls") > 1) | later).alias("overlapped"))


def in_flight_peaks(swept: DataFrame, page: str) -> DataFrame:
    """V4. The most each page ever held in flight."""
    return swept.groupBy(page).agg(
        F.max("open_bytes").alias("peak_bytes"), F.max("open_decoders").alias("peak_decoders"),
        F.max("open_calls").alias("peak_calls"), F.count_if("overlapped").alias("overlapped_calls"))


class QuarantineFold(Fold):
    """V5. State: blocked steps, suspects, the least an unexplained crash held (null when none is open), whether a
    culprit of it is known, and the ceiling.

    A record is told as events on sets: steps that are proven (open alone at a crash), cleared (resolved) or suspected (open with
    others). Proven and cleared steps leave the suspects; when the last one leaves, the open crash is settled.
    """

    inputs = ["kind", "steps", "bytes", "decoders"]
    schema = ("blocked array<string>, suspects array<string>, bisecting boolean, "
              "ceiling_bytes bigint, ceiling_decoders bigint")

    def initial(self):
        return {"blocked": [], "suspects": [], "held": None, "explained": False, "ceiling": [None, None]}

    def step(self, state, row):
        kind, steps, *held = row
        steps, blocked, suspects = set(steps or ()), set(state["blocked"]), set(state["suspects"])
        proven = steps if kind != "resolved" and len(steps) == 1 else set()
        cleared = {min(steps)} if kind == "resolved" and steps else set()
        suspected = set() if kind == "resolved" or proven else steps - blocked
        explained = state["explained"] or bool(proven & suspects)
        leaving = (proven | cleared) & suspects
        ceiling, open_held = state["ceiling"], state["held"]
        if suspected:
            # A crash whose culprit is known no longer counts; an unexplained one joins with the new one
            open_held = held if open_held is None or state["explained"] else [min(pair) for pair in zip(open_held, held)]
            explained = False
        elif leaving and leaving == suspects and open_held is not None:
            if not explained:
                ceiling = [self._lower(cap, total) for cap, total in zip(ceiling, open_held)]
            open_held = None
        blocked |= proven
        suspects = (suspects | suspected) - leaving
        state = {"blocked": sorted(blocked), "suspects": sorted(suspects), "held": open_held,
                 "explained": explained and open_held is not None, "ceiling": ceiling}
        return state, (state["blocked"], state["suspects"], open_held is not None, *ceiling)

    @staticmethod
    def _lower(cap, total):
        """Below what was held when it crashed; a total of zero says nothing."""
        return cap if total == 0 else min(value for value in (cap, total - 1) if value is not None)


def crash_records(calls: DataFrame, key, crash: str, step: str, bytes_: str, decoders: str) -> DataFrame:
    """V5. One row per stopped page: the steps it had open and what they held."""
    key = [key] if isinstance(key, str) else list(key)
    return calls.groupBy(*key, crash).agg(
        F.lit("crash").alias("kind"), F.sort_array(F.collect_set(step)).alias("steps"),
        F.sum(bytes_).cast("long").alias("bytes"), F.sum(decoders).cast("long").alias("decoders"))


def quarantine(records: DataFrame, key, seq: str) -> DataFrame:
    """V5. Quarantine of each fingerprint after every record (kind crash or resolved, steps, bytes, decoders)."""
    return fold(records, key, seq, QuarantineFold())


def quarantine_now(history: DataFrame, key, seq: str) -> DataFrame:
    """V5. The quarantine after the last record."""
    key = [key] if isinstance(key, str) else list(key)
    columns = [name for name in history.columns if name not in key]
    return history.groupBy(*key).agg(F.max_by(F.struct(*columns), F.col(seq)).alias("__row")).select(*key, "__row.*")


def unblocked_calls(calls: DataFrame, now: DataFrame, key, step: str) -> DataFrame:
    """V5. Calls whose step is not blocked for their fingerprint."""
    key = [key] if isinstance(key, str) else list(key)
    blocked = now.select(*key, F.explode("blocked").alias(step))
    return calls.join(blocked, [*key, step], "left_anti")

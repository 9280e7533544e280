"""S3. Events of playback trace exports in JSON, valid and quarantined."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.tables import MAXIMUM_TRACE_FIELDS, MAXIMUM_TRACE_STRING, TRACE_KINDS


def _scalar(value: Column) -> Column:
    """Whether a field is a boolean, a finite number, null, or a string within the limit."""
    kind = F.schema_of_variant(value)
    short = F.length(F.try_variant_get(value, "$", "string")) <= MAXIMUM_TRACE_STRING
    number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    return value.isNull() | kind.isin("BOOLEAN", "VOID") | number | ((kind == "STRING") & short)


def read_trace_exports(exports: DataFrame, export_id: str, text: str, kinds: list[str] | None = None) -> DataFrame:
    """Every event of every export: (export, event_no, kind, realm, epoch_ms, fields, problem).

    ``problem`` is null for a valid event; quarantined events name the first check they fail: unknown-kind, bad-time,
    bad-fields, too-many-fields or bad-value. Split with :func:`valid_events` and :func:`quarantined_events`.
    """
    parsed = exports.select(export_id, F.from_json(text, "events ARRAY<VARIANT>")["events"].alias("__events"))
    rows = parsed.select(export_id, F.posexplode("__events").alias("event_no", "__e"))
    time_kind = F.coalesce(F.schema_of_variant(F.try_variant_get("__e", "$.epochMilliseconds", "variant")), F.lit("VOID"))
    kind_kind = F.coalesce(F.schema_of_variant(F.try_variant_get("__e", "$.kind", "variant")), F.lit("VOID"))
    read = rows.select(
        export_id, "event_no", F.when(kind_kind == "STRING", F.try_variant_get("__e", "$.kind", "string")).alias("kind"),
        F.try_variant_get("__e", "$.realm", "string").alias("realm"),
        F.when(time_kind != "STRING", F.try_variant_get("__e", "$.epochMilliseconds", "double")).alias("epoch_ms"),
        F.try_variant_get("__e", "$.fields", "map<string, variant>").alias("fields"))
    values = F.map_values("fields")
    problem = (
        F.when(~F.coalesce(F.col("kind").isin(kinds or TRACE_KINDS), F.lit(False)), "unknown-kind")
        .when(~F.coalesce((F.col("epoch_ms") > 0) & (F.col("epoch_ms") < float("inf")), F.lit(False)), "bad-time")
        .when(F.col("fields").isNull(), "bad-fields").when(F.size("fields") > MAXIMUM_TRACE_FIELDS, "too-many-fields")
        .when(~F.forall(values, _scalar), "bad-value"))
    return read.withColumn("problem", problem)


def valid_events(events: DataFrame) -> DataFrame:
    return events.where(F.col("problem").isNull()).drop("problem")


def quarantined_events(events: DataFrame) -> DataFrame:
    return events.where(F.col("problem").isNotNull())

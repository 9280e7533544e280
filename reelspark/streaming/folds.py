"""Folds on a stream: the same step functions, applied in order once the watermark has passed."""
from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..plans.fold import Fold, fold_rows, parse_schema
from .closing import timed

_KINDS = {"bigint": "Int64", "int": "Int32", "boolean": "boolean", "double": "Float64"}
_AT = "__at_us"


def _is_whole(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.IntegralType)


def _native(value, whole: bool):
    value = value.tolist() if hasattr(value, "tolist") else value
    if value is None or value is pd.NaT or value != value:
        return None
    return int(value) if whole else value


def _frame(rows: list[tuple], schema: T.StructType) -> pd.DataFrame:
    """Rows as a frame of nullable types."""
    columns = {}
    for field, values in zip(schema, zip(*rows)):
        kind = _KINDS.get(field.dataType.simpleString())
        columns[field.name] = pd.array(list(values), dtype=kind) if kind else pd.Series(list(values), dtype="object")
    return pd.DataFrame(columns)


class _Waiting(StatefulProcessor):
    """Rows wait in a list until a timer says that the watermark has passed the earliest of them."""

    def __init__(self, rule: Fold, key: list[str], order: list[str], carried: list[str], given: list[int], held: T.StructType, schema: T.StructType, idle_ms: int | None):
        self.rule, self.key, self.order, self.carried, self.schema, self.idle_ms = rule, key, order, carried, schema, idle_ms
        self.given, self.held = given, held
        self.whole = [_is_whole(field) for field in held]
        self.places = {name: place for place, name in enumerate(held.names)}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", self.held)
        self.entry = handle.getValueState("entry", "state string, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # Columns are taken by place: workers rename those that begin with an underscore
        added = [row for pdf in rows for row in zip(*[
            [_native(value, whole) for value in pdf.iloc[:, place].tolist()] for place, whole in zip(self.given, self.whole)])]
        if added:
            self.rows.appendList(added)
            self.handle.registerTimer(min(row[self.places[_AT]] for row in added) // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        at = self.places[_AT]
        waiting = sorted((tuple(row) for row in self.rows.get()), key=lambda row: (row[at], *[row[self.places[name]] for name in self.order]))
        ready = [row for row in waiting if row[at] <= watermark]
        rest = waiting[len(ready):]
        if ready:
            state = json.loads(self.entry.get()[0]) if self.entry.exists() else self.rule.initial()
            state, produced = fold_rows(self.rule, state, [[row[self.places[name]] for row in ready] for name in self.rule.inputs])
            self.entry.update((json.dumps(state), ready[-1][at]))
            known = [[key[self.key.index(name)] if name in self.key else row[self.places[name]] for name in self.carried] for row in ready]
            yield _frame([(*left, *right) for left, right in zip(known, produced)], self.schema)
            if rest:
                self.rows.put(rest)
            else:
                self.rows.clear()
            if self.idle_ms is not None:
                self.handle.registerTimer(ready[-1][at] // 1000 + 1 + self.idle_ms)
        if rest:
            self.handle.registerTimer(rest[0][at] // 1000 + 1)
        elif self.idle_ms is not None and self.entry.exists() and self.entry.get()[1] + self.idle_ms * 1000 < watermark:
            self.entry.clear()

    def close(self) -> None:
        pass


def fold_stream(stream: DataFrame, key, ts: str, order: list[str], rule: Fold, delay: str, idle_ms: int | None = None) -> DataFrame:
    """The columns of :func:`plans.fold.fold` on a stream with event time ``ts``.

    Rows wait in their key's state until the watermark has passed their time, so that rows which come late take their
    place; then they are applied in (time, order). A key's state is the fold's own state and the rows of the last
    ``delay``; once nothing came for ``idle_ms`` of event time, if that is given, the key is over and its state goes. Rows later than
    the watermark are dropped by Spark, as for any event-time state.
    """
    key = [key] if isinstance(key, str) else list(key)
    carried = list(dict.fromkeys([*key, *order]))
    columns = list(dict.fromkeys([*carried, *rule.inputs]))
    schema = T.StructType([stream.schema[name] for name in carried] + list(parse_schema(rule.schema)))
    held = T.StructType([stream.schema[name] for name in columns if name not in key] + [T.StructField(_AT, T.LongType())])
    known = timed(stream, ts, delay)
    rows = known.withColumn(_AT, F.unix_micros(ts)).select(*dict.fromkeys([*columns, _AT, ts]))
    # pandas would make whole numbers beside nulls inexact: they travel as text
    rows = rows.withColumns({field.name: F.col(field.name).cast("string") for field in held if _is_whole(field)})
    given = [rows.columns.index(name) for name in held.names]
    return rows.groupBy(*key).transformWithStateInPandas(
        _Waiting(rule, key, order, carried, given, held, schema, idle_ms), schema, "Append", "EventTime")

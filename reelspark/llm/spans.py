"""Places of pattern matches in texts, by DataFrame functions whose work stays near-linear in the number of matches."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), use)[0]


def _scan(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """0 and what ``step`` makes of it and each value of a short array after another: each step copies what is there."""
    start = F.array(F.lit(0).cast("bigint"))
    return F.aggregate(values, start, lambda acc, value: F.array_append(acc, step(F.element_at(acc, -1), value)))


def _running(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """An associative step's running results over an array of BIGINT from 0 up: within about as many pieces as a piece has values,
    on top of the pieces' own."""
    def results(whole):
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(whole)))).cast("int")
        starts = F.when(F.size(whole) > 0, F.sequence(F.lit(1), F.size(whole), width)).otherwise(F.array().cast("array<int>"))
        pieces = F.transform(starts, lambda at: _scan(F.slice(whole, at, width), step))
        return bound(pieces, lambda inner: bound(
            _scan(F.transform(inner, lambda piece: F.element_at(piece, -1)), step),
            lambda before: F.flatten(F.transform(inner, lambda piece, at: F.transform(
                F.slice(piece, F.lit(2), F.size(piece) - 1), lambda value: step(before[at], value))))))
    return bound(values, results)


def running_totals(values: Column) -> Column:
    """Running totals."""
    return _running(values, lambda total, value: total + value)


def running_greatest(values: Column) -> Column:
    """The greatest value so far, 0 at least."""
    return _running(values, lambda most, value: F.greatest(most, value))


def placed_matches(text: Column, pattern: str) -> Column:
    """Leftmost matches that do not overlap, as structs ``start``, ``end`` (code points, end exclusive) and ``value``.

    What lies between the matches and the matches themselves alternate, so their lengths add up to the places. A pattern must
    not match the empty text.
    """
    def placed(found):
        lengths = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, lambda gap, value: (
            F.length(gap) + F.length(value)).cast("bigint"))
        return F.zip_with(running_totals(lengths), found, lambda end, value: F.struct(
            (end - F.length(value)).alias("start"), end.alias("end"), value.alias("value")))
    return bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

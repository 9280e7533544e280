"""Number helpers whose rounding matters."""
from __future__ import annotations

from pyspark.sql import Column, functions as F


def half_up(value: Column) -> Column:
    """Round half toward positive infinity, also for negative values (Spark's round goes away from zero)."""
    return F.floor(value + F.lit(0.5)).cast("long")


def frames_to_micros(frames: Column, rate: Column) -> Column:
    """Media time of a frame count at a rate."""
    return half_up(frames.cast("double") * F.lit(1e6) / rate)


def clamp(value: Column, low, high) -> Column:
    low = F.lit(low) if not isinstance(low, Column) else low
    high = F.lit(high) if not isinstance(high, Column) else high
    return F.least(F.greatest(value, low), high)


def smoothstep(edge0, edge1, value: Column) -> Column:
    """Cubic step from 0 at ``edge0`` to 1 at ``edge1``."""
    edge0 = F.lit(edge0) if not isinstance(edge0, Column) else edge0
    edge1 = F.lit(edge1) if not isinstance(edge1, Column) else edge1
    position = clamp(F.try_divide(value - edge0, edge1 - edge0), 0.0, 1.0)
    return F.when(edge0 == edge1, F.when(value >= edge0, 1.0).otherwise(0.0)).otherwise(
        position * position * (3.0 - 2.0 * position))

"""M1. Layer pairing on two streams."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def pair_layers_stream(
    base: DataFrame, enhancement: DataFrame, key: list[str], base_ts: str, enh_ts: str, delay: str, tolerance_us: int = 1,
) -> DataFrame:
    """Base frames with the enhancement frame within the tolerance, or with none once the watermark rules one out.

    For streams whose frames lie more than twice the tolerance apart, where the one-to-one pairing and the interval join
    agree; both state stores hold only what the watermark still allows to match.
    """
    left = base.withWatermark(base_ts, delay)
    right = enhancement.withColumnsRenamed({name: f"__e_{name}" for name in key}).withWatermark(enh_ts, delay)
    near = F.expr(f"{enh_ts} BETWEEN {base_ts} - INTERVAL {tolerance_us} MICROSECOND AND {base_ts} + INTERVAL {tolerance_us} MICROSECOND")
    for name in key:
        near = near & (F.col(name) == F.col(f"__e_{name}"))
    return left.join(right, near, "leftOuter").drop(*[f"__e_{name}" for name in key])

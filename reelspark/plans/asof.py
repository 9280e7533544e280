"""As-of join: for each left row, the nearest right row at or before (or after) its time."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .timeline import LastKnown, NextKnown, Timeline


def asof_join(
    left: DataFrame, right: DataFrame, key, left_at: str, right_at: str, *,
    direction: str = "backward", tie: str | None = None, tolerance: int | None = None, right_columns=None,
) -> DataFrame:
    """Left rows with the columns of the latest right row whose time is <= theirs (``backward``), or of the
    earliest whose time is >= theirs (``forward``); null where there is none.

    Both sides are unioned and shuffled once by key; the match is a running value in time order, so the work is
    linear and no pair is ever built. Right rows that share a time resolve to the greatest ``tie`` (the least when
    looking forward). ``tolerance`` bounds the distance.
    """
    key = [key] if isinstance(key, str) else list(key)
    backward = direction == "backward"
    right_columns = list(right_columns or [name for name in right.columns if name not in key])
    taken = F.struct(*[F.col(name) for name in right_columns], F.col(right_at).alias("__at"))
    tie_column = F.col(tie) if tie else F.lit(0)
    rights = right.where(F.col(right_at).isNotNull()).select(
        *key, F.col(right_at).cast("long").alias("__t"), F.lit(0 if backward else 1).alias("__side"),
        tie_column.cast("long").alias("__tie"), taken.alias("__right"),
    )
    payload = [name for name in left.columns if name not in key]
    lefts = left.select(
        *key, F.col(left_at).cast("long").alias("__t"), F.lit(1 if backward else 0).alias("__side"),
        F.lit(None).cast("long").alias("__tie"), F.struct(*payload).alias("__left"),
    )
    both = lefts.unionByName(rights, allowMissingColumns=True)
    scan = LastKnown("__right") if backward else NextKnown("__right")
    matched = Timeline(both, key, ["__t", "__side", "__tie"]).scan(__match=scan).df.where(F.col("__left").isNotNull())
    near = F.lit(True) if tolerance is None else F.abs(F.col("__t") - F.col("__match.__at")) <= tolerance
    return matched.select(
        *key, *[F.col(f"__left.{name}").alias(name) for name in payload],
        *[F.when(near, F.col(f"__match.{name}")).alias(name) for name in right_columns],
    )

"""Interval-overlap join as an equi join on time buckets of several widths."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .skew import same_key


def _level(start: str, end: str, width: int) -> Column:
    """How often the width must double to reach the span's length."""
    return F.greatest(F.ceil(F.log2((F.col(end) - F.col(start)) / F.lit(width))), F.lit(0)).cast("int")


def _levels(df: DataFrame, side: str) -> list[int]:
    """The levels that occur: no more numbers than a BIGINT has bits."""
    return sorted(row[0] for row in df.select(f"__level_{side}").distinct().collect())


def interval_join(
    left: DataFrame, right: DataFrame, key, left_span: tuple[str, str], right_span: tuple[str, str], width: int,
) -> DataFrame:
    """Pairs of one key whose half-open spans [start, end) overlap; null keys are equal to each other.

    Buckets of ``width``, about the usual span length, double from level to level. A span lies in one or two buckets of its own level,
    the first whose buckets are as long as it is, and in one or two of each longer level that occurs on the other side: a pair meets on the
    longer span's level, where adaptive execution can split a skewed bucket. So a span of any length makes few rows, two for each
    level. A pair that shares two buckets is kept in the first of them, so no ``distinct`` is needed. Columns other than the
    key must differ.
    """
    key = [key] if isinstance(key, str) else list(key)
    (ls, le), (rs, re) = left_span, right_span
    left = left.where(F.col(le) > F.col(ls)).withColumn("__level_l", _level(ls, le, width))
    right = right.where(F.col(re) > F.col(rs)).withColumn("__level_r", _level(rs, re, width))

    def spread(df: DataFrame, start: str, end: str, side: str, others: list[int]) -> DataFrame:
        own = F.col(f"__level_{side}")
        levels = F.concat(F.array(own), F.filter(F.array(*[F.lit(level) for level in others]).cast("array<int>"), lambda level: level > own))
        places = F.flatten(F.transform(levels, lambda level: F.transform(
            F.sequence(_bucket(F.col(start), level), _bucket(F.col(end) - 1, level)), lambda bucket: F.struct(
                level.alias("level"), bucket.alias("bucket")))))
        return df.withColumn("__place", F.explode(places)).withColumns({
            f"__at_{side}": F.col("__place.level"), f"__bucket_{side}": F.col("__place.bucket")}).drop("__place")

    def _bucket(at: Column, level: Column) -> Column:
        return F.floor(at / (F.lit(width) * F.pow(F.lit(2.0), level))).cast("long")

    rights = right.select(*[F.col(name).alias(f"__of_{name}") if name in key else F.col(name) for name in right.columns])
    joined = spread(left, ls, le, "l", _levels(right, "r")).join(
        spread(rights, rs, re, "r", _levels(left, "l")),
        same_key(key, "__of_") & (F.col("__at_l") == F.col("__at_r")) & (F.col("__bucket_l") == F.col("__bucket_r")))
    level = F.greatest("__level_l", "__level_r")
    first = F.greatest(_bucket(F.col(ls), level), _bucket(F.col(rs), level))
    return joined.where(
        (F.col("__at_l") == level) & (F.col("__bucket_l") == first) & (F.col(ls) < F.col(re)) & (F.col(rs) < F.col(le))
    ).drop(*[f"__{name}_{side}" for name in ("at", "bucket", "level") for side in "lr"], *[f"__of_{name}" for name in key])

"""Splitting of keys that hold too many rows for one task.

A window or a fold by key puts each key into one task. So where there are more than ``spark.reelspark.hotKeyRows`` rows, every
key is cut, in its order, into chunks of about that many. The cut points are the rows that a hash of key and order picks, one in
that many: a key with fewer rows usually has no cut at all, and the number of cuts is the number of rows divided by the
setting. They stay a table, joined by key like any other.

The rows are counted when the plan is built, by key and order columns alone; nothing is estimated. Plans over fewer rows than the
setting need no chunks, and without them take a half to a fifth of the time on small tables.

All order columns count, so rows tied in the first one are split too. Only rows equal in key and all order columns stay together.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

HOT_ROWS_SETTING = "spark.reelspark.hotKeyRows"
CHUNK = "__chunk"
HOT = "__hot"

DEFAULT_HOT_ROWS = 4_000_000
#: Cut points are searched in two steps: among the first of every so many, then among those
STRIDE = 512


def hot_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(HOT_ROWS_SETTING, str(DEFAULT_HOT_ROWS)))


#: Row counts by what is counted, so that several scans of one table count it once
_COUNTS: dict[tuple, int] = {}


def counted_rows(df: DataFrame) -> int:
    name = (df.sparkSession.sparkContext.applicationId, df.semanticHash())
    if name not in _COUNTS:
        _COUNTS[name] = df.count()
    return _COUNTS[name]


def same_key(key: list[str], prefix: str = "__hot_") -> Column:
    """Key columns equal those of a table whose copies carry a prefix, nulls being equal."""
    return reduce(lambda a, b: a & b, [F.col(name).eqNullSafe(F.col(f"{prefix}{name}")) for name in key])


class Chunks:
    """The cut points of a DataFrame's keys; falsy where keys are not cut: for few rows, and on a stream."""

    def __init__(self, df: DataFrame, key: list[str], order: list[str], at_most: int | None = None):
        self.key, self.order = list(key), list(order)
        narrow = df.select(*key, *[name for name in order if name not in key])
        few = at_most is not None and at_most <= hot_rows(df)
        self.cut = not df.isStreaming and not few and counted_rows(narrow) > hot_rows(df)
        if not self.cut:
            return
        place = F.struct(*[F.col(name).alias(f"o{i}") for i, name in enumerate(order)])
        picked = F.pmod(F.xxhash64(*key, *order), F.lit(hot_rows(df))) == 0
        cuts = narrow.where(picked).groupBy(*key).agg(
            F.array_sort(F.collect_set(place)).alias("__cuts"))
        steps = F.transform(F.sequence(F.lit(1), F.size("__cuts"), F.lit(STRIDE)), lambda at: F.slice("__cuts", at, STRIDE))
        self.cuts = cuts.select(*[F.col(name).alias(f"__hot_{name}") for name in key], steps.alias("__cuts"))

    def __bool__(self) -> bool:
        return self.cut

    def unless_small(self, df: DataFrame) -> "Chunks":
        """These chunks, or none where no key that was cut has more rows than the setting: among very many small keys some are cut too.

        The rows of the keys with cuts are counted, so ``df`` should be cheap to read again.
        """
        if self.cut:
            cut_keys = F.broadcast(self.cuts.select(*self.hot_names()))
            sizes = df.join(cut_keys, same_key(self.key), "left_semi").groupBy(*self.key).agg(F.count(F.lit(1)).alias("__n"))
            self.cut = not sizes.where(F.col("__n") > hot_rows(df)).isEmpty()
        return self

    def hot_names(self) -> list[str]:
        return [f"__hot_{name}" for name in self.key]

    def assign(self, df: DataFrame) -> DataFrame:
        """Add the chunk number, 0 for every row of a key without cuts, and a flag for the keys with cuts."""
        place = F.struct(*[F.col(name).alias(f"o{i}") for i, name in enumerate(self.order)])
        step = F.size(F.filter("__cuts", lambda part: part[0] < place))
        within = F.size(F.filter(F.element_at("__cuts", step), lambda cut: cut < place))
        chunk = F.when(F.col("__cuts").isNull() | (step == 0), F.lit(0)).otherwise((step - 1) * STRIDE + within)
        return (
            df.join(self.cuts, same_key(self.key), "left")
            .withColumn(CHUNK, chunk).withColumn(HOT, F.col("__cuts").isNotNull())
            .drop("__cuts", *self.hot_names())
        )


def find_chunks(df: DataFrame, key: list[str], order, at_most: int | None = None) -> Chunks:
    """The chunks of a DataFrame's keys by one or several order columns.

    ``at_most`` is a number of rows that it cannot exceed, if one is known from a table it is made of: where that is
    small enough the rows themselves, and all that they are made from, are not counted.
    """
    return Chunks(df, key, [order] if isinstance(order, str) else list(order), at_most)

"""Running and neighbouring values over each key's rows in order.

A :class:`Timeline` evaluates scans such as :class:`Lag` or :class:`RunningSum` as windows by (key, chunk), see
:mod:`reelspark.plans.skew`. Where a key has several chunks, each receives what it needs of the chunks around it: one
small summary row per chunk, combined over chunks and joined back. The summary is an aggregate, so a hot key never
meets in one task, and results are the same either way. Scans that look ahead run over the reversed order, so every scan is linear.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from .skew import CHUNK, HOT, Chunks, find_chunks, same_key

_START, _END = Window.unboundedPreceding, Window.unboundedFollowing


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


class Scan:
    """One value per row that depends on other rows of its key."""

    #: Whether the windows given run from the key's last row to its first
    reverse = False

    def local(self, window: WindowSpec) -> Column:
        raise NotImplementedError

    def summary(self, position: Column) -> Column:
        """The chunk's contribution, as an aggregate."""
        raise NotImplementedError

    def carry(self, window: WindowSpec, summary: Column) -> Column:
        """What the chunks before or after contribute, over the summaries in chunk order."""
        raise NotImplementedError

    def combine(self, local: Column, carry: Column | None) -> Column:
        return local if carry is None else F.coalesce(local, carry)


class Lag(Scan):
    """The previous row's value, or a default on the first row."""

    def __init__(self, value, default=None):
        self.value, self.default = _col(value), default

    def local(self, window):
        return F.lag(F.struct(self.value.alias("v")), 1).over(window)

    def summary(self, position):
        return F.max_by(F.struct(self.value.alias("v")), position)

    def carry(self, window, summary):
        return F.lag(summary, 1).over(window)

    def combine(self, local, carry):
        found = super().combine(local, carry)
        if self.default is None:
            return found["v"]
        return F.when(found.isNull(), self.default).otherwise(found["v"])


class Lead(Lag):
    """The next row's value, or a default on the last row."""

    def local(self, window):
        return F.lead(F.struct(self.value.alias("v")), 1).over(window)

    def summary(self, position):
        return F.min_by(F.struct(self.value.alias("v")), position)

    def carry(self, window, summary):
        return F.lead(summary, 1).over(window)


class RunningSum(Scan):
    """Sum of the values up to and including this row, null counting as zero."""

    def __init__(self, value):
        self.value = F.coalesce(_col(value), F.lit(0))

    def local(self, window):
        return F.sum(self.value).over(window.rowsBetween(_START, 0))

    def summary(self, position):
        return F.sum(self.value)

    def carry(self, window, summary):
        return F.sum(summary).over(window.rowsBetween(_START, -1))

    def combine(self, local, carry):
        return local if carry is None else local + F.coalesce(carry, F.lit(0))


class RowNumber(RunningSum):
    """Position of the row within its key, from 1."""

    def __init__(self):
        super().__init__(F.lit(1))


class RunningMax(Scan):
    """Greatest value so far, this row included."""

    aggregate = staticmethod(F.max)
    pick = staticmethod(F.greatest)

    def __init__(self, value):
        self.value = _col(value)

    def local(self, window):
        return self.aggregate(self.value).over(window.rowsBetween(_START, 0))

    def summary(self, position):
        return self.aggregate(self.value)

    def carry(self, window, summary):
        return self.aggregate(summary).over(window.rowsBetween(_START, -1))

    def combine(self, local, carry):
        return local if carry is None else self.pick(local, carry)


class RunningMin(RunningMax):
    """Least value so far, this row included."""

    aggregate = staticmethod(F.min)
    pick = staticmethod(F.least)


class LastKnown(Scan):
    """The latest non-null value at or before this row, or strictly before it."""

    def __init__(self, value, inclusive: bool = True):
        self.value, self.inclusive = _col(value), inclusive

    def local(self, window):
        return F.last(self.value, ignorenulls=True).over(window.rowsBetween(_START, 0 if self.inclusive else -1))

    def summary(self, position):
        return F.max_by(self.value, F.when(self.value.isNotNull(), position))

    def carry(self, window, summary):
        return F.last(summary, ignorenulls=True).over(window.rowsBetween(_START, -1))


class NextKnown(LastKnown):
    """The next non-null value at or after this row, or strictly after it: the latest one in the reversed order."""

    reverse = True

    def summary(self, position):
        return F.min_by(self.value, F.when(self.value.isNotNull(), position))


class Framed(Scan):
    """A window expression over a bounded frame of ``before`` rows back to ``after`` rows ahead.

    ``build`` receives the ordered window spec without a frame. In a key with several chunks each chunk also holds copies
    of the rows that its frames reach in the chunks around it, however many those are; they are dropped afterwards.
    """

    def __init__(self, build: Callable[[WindowSpec], Column], before: int = 0, after: int = 0):
        self.build, self.before, self.after = build, before, after


class Timeline:
    """The rows of ``df`` ordered by ``order`` within ``key``; ``at_most`` as for :func:`~reelspark.plans.skew.find_chunks`."""

    def __init__(self, df: DataFrame, key, order, chunks: Chunks | None = None, at_most: int | None = None):
        self.key = [key] if isinstance(key, str) else list(key)
        self.order = [order] if isinstance(order, str) else list(order)
        self.chunks = find_chunks(df, self.key, self.order, at_most) if chunks is None else chunks
        if self.chunks and CHUNK not in df.columns:
            df = self.chunks.assign(df)
        self._df = df

    @property
    def df(self) -> DataFrame:
        return self._df.drop(CHUNK, HOT)

    def apply(self, change: Callable[[DataFrame], DataFrame]) -> "Timeline":
        """Derive columns or drop rows, keeping key and order."""
        return Timeline(change(self._df), self.key, self.order, self.chunks)

    def window(self, reverse: bool = False) -> WindowSpec:
        # The flag depends on the key alone; as a partition column it lets a filter on it pass below the window
        partition = [*self.key, CHUNK, HOT] if self.chunks else self.key
        return Window.partitionBy(*partition).orderBy(*[F.desc(name) if reverse else F.col(name) for name in self.order])

    def scan(self, **scans: Scan) -> "Timeline":
        """Add one column per scan."""
        framed = {name: scan for name, scan in scans.items() if isinstance(scan, Framed)}
        carried = {name: scan for name, scan in scans.items() if not isinstance(scan, Framed)}
        df = self._df
        # Frames first: they repeat rows, which is cheaper and plans better before structs of neighbours are added
        if framed:
            df = self._framed(df, framed)
        if carried:
            df = self._carried(df, carried)
        return Timeline(df, self.key, self.order, self.chunks)

    def _carried(self, df: DataFrame, scans: dict[str, Scan]) -> DataFrame:
        windows = {reverse: self.window(reverse) for reverse in (False, True)}
        if not self.chunks:
            return df.select("*", *[scan.combine(scan.local(windows[scan.reverse]), None).alias(name) for name, scan in scans.items()])
        position = F.struct(*self.order)
        summaries = (
            df.where(HOT).groupBy(*self.key, CHUNK)
            .agg(*[scan.summary(position).alias(f"__s_{name}") for name, scan in scans.items()])
        )
        by_chunk = Window.partitionBy(*self.key)
        over = {False: by_chunk.orderBy(CHUNK), True: by_chunk.orderBy(F.desc(CHUNK))}
        # One row per chunk of the keys that have several
        carries = summaries.select(
            *[F.col(name).alias(f"__hot_{name}") for name in self.key], F.col(CHUNK).alias("__hot_chunk"),
            *[scan.carry(over[scan.reverse], F.col(f"__s_{name}")).alias(f"__c_{name}") for name, scan in scans.items()],
        )
        kept = df.columns
        df = df.select("*", *[scan.local(windows[scan.reverse]).alias(f"__l_{name}") for name, scan in scans.items()])
        return df.join(carries, same_key(self.key) & (F.col(CHUNK) == F.col("__hot_chunk")), "left").select(
            *kept, *[scan.combine(F.col(f"__l_{name}"), F.col(f"__c_{name}")).alias(name) for name, scan in scans.items()]
        )

    def _framed(self, df: DataFrame, scans: dict[str, Framed]) -> DataFrame:
        window = self.window()
        built = [scan.build(window).alias(name) for name, scan in scans.items()]
        if not self.chunks:
            return df.select("*", *built)
        before = max(scan.before for scan in scans.values())
        after = max(scan.after for scan in scans.values())
        ranked = df.select(
            "*", F.row_number().over(window).alias("__from_start"),
            F.row_number().over(self.window(reverse=True)).alias("__from_end"),
        )
        # How many rows the chunks ahead and behind hold; every chunk has one or more
        around = Window.partitionBy(*self.key).orderBy(CHUNK)
        sizes = df.where(HOT).groupBy(*self.key, CHUNK).agg(F.count(F.lit(1)).alias("__n")).select(
            *[F.col(name).alias(f"__hot_{name}") for name in self.key], F.col(CHUNK).alias("__hot_chunk"),
            F.collect_list("__n").over(around.rowsBetween(1, max(1, before))).alias("__ahead"),
            F.reverse(F.collect_list("__n").over(around.rowsBetween(-max(1, after), -1))).alias("__behind"),
        )
        known = ranked.join(sizes, same_key(self.key) & (F.col(CHUNK) == F.col("__hot_chunk")), "left")
        ahead = self._reached(F.col("__ahead"), F.col("__from_end"), before, 1)
        behind = self._reached(F.col("__behind"), F.col("__from_start"), after, -1)
        shifts = F.when(F.col("__hot_chunk").isNull(), F.array(F.lit(0))).otherwise(F.concat(F.array(F.lit(0)), ahead, behind))
        spread = (
            known.select(*df.columns, F.explode(shifts).alias("__shift"))
            .withColumn(CHUNK, F.col(CHUNK) + F.col("__shift"))
        )
        # The copies' chunk numbers are not the rows' own: they come back with the shift, which is 0 for the rows kept
        return spread.select("*", *built).where("__shift = 0").drop("__shift")

    @staticmethod
    def _reached(sizes: Column, rank: Column, reach: int, sign: int) -> Column:
        """The chunks, as shifts, whose frames of ``reach`` rows hold the row that is ``rank``-th from its chunk's edge."""
        if reach == 0:
            return F.array().cast("array<int>")
        # The chunk at distance d starts after the d - 1 chunks between
        between = F.transform(F.sequence(F.lit(1), F.size(sizes)), lambda d: F.aggregate(
            F.slice(sizes, 1, d - 1), F.lit(0).cast("bigint"), lambda total, n: total + n))
        near = F.filter(F.transform(between, lambda total, at: F.when(rank + total <= reach, at + 1)), lambda d: d.isNotNull())
        return F.when(F.size(sizes) == 0, F.array().cast("array<int>")).otherwise(F.transform(near, lambda d: (d * sign).cast("int")))

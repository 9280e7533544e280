"""Mixing sources to target weights by weighted fair queueing; DataFrame functions only.

Each source sends its shuffled documents, over and over up to ``repeats`` times. A copy's virtual finish time is the
words its source has sent by then, divided by the source's target. All copies are ordered by finish time and taken
while their words fit the total budget, so that at every moment each source has sent about its share.

No source and no budget prefix is ever gathered in one task: running sums are taken within ranges of bounded expected
size (of the shuffle hash within a source, of the finish time overall) on top of a running sum over the ranges.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import Scratch, plainly, quoted

#: Rows that one range of a running sum holds on average
RANGE_ROWS = 20_000
WORD = r"[^\x20\x09-\x0D]+"
#: A digest's first digits that name a range: up to 16**4 ranges of a source
RANGE_DIGITS = 4


def word_count(text: Column) -> Column:
    """Words of a text, null and empty texts counting 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: list[int], repeats: int) -> DataFrame:
    """One row per ``source``: ``source_rank``, ``source_size``, ``budget`` (all sizes) and ``target``.

    Targets share the budget by weight; none exceeds ``repeats`` times its source, and what is above goes to the others by
    weight. With sources in order of repeats * size / weight, a capped one is followed only by sources with more room, so
    the water level is what the uncapped rest shares: it is found in one pass over the sources.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row per source from here on
    named = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), F.pmod(F.col("source_rank") - 1, F.lit(len(weights))) + 1)
    ranked = (
        totals.withColumn("source_rank", F.row_number().over(named)).withColumn("weight", weight.cast("bigint"))
        .withColumn("room", F.col("source_size") * repeats).withColumn("depth", F.col("room") / F.col("weight"))
    )
    filling = Window.orderBy("depth", "source_rank")
    everything = filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    leveled = ranked.select(
        "*", F.sum("source_size").over(everything).alias("budget"),
        F.coalesce(F.sum("room").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("filled"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("open_weight"),
    ).withColumn("level", (F.col("budget") - F.col("filled")) / F.col("open_weight"))
    # The level rises while sources fill up and falls once one is counted as full that is not
    level = F.max("level").over(everything)
    return leveled.select(
        "source", "source_rank", "source_size", "budget",
        F.least(F.col("room").cast("double"), level * F.col("weight")).alias("target"))


def mix(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", *,
    weights: list[int] = (5, 2, 1), repeats: int = 3, seed: str = "mix", row_column: str | None = None,
) -> DataFrame:
    """Per row: ``id``, ``source``, ``size``, ``source_size``, ``target``, ``copies`` (0 to ``repeats``) and ``taken``.

    Sources take the weights in code-point order, null last, over and over. The budget is the number of words of all
    documents. The shuffle orders a source by MD5 of the seed and the id, so a run on the same rows gives the same mix.
    Null and empty texts have size 0 and are never taken; null sources are a source; a null id has its own place in the
    shuffle. Repeated rows are separate documents that lie side by side. An empty table gives no rows. ``row_column``, a
    number that differs in every row, comes back as ``row`` if given.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(quoted(id_column).cast("string"), F.lit("null"))))
    rows = scratch.keep(docs.select(
        quoted(id_column).alias("id"), quoted(source_column).cast("string").alias("source"),
        word_count(quoted(text_column)).alias("size"), digest.alias("digest"), *([quoted(row_column).alias("row")] if row_column else [])), "sizes")
    row = ["row"] if row_column else []
    counted = rows.count()
    targets = scratch.keep(source_targets(rows, list(weights), repeats), "targets")
    # A range of a source is named by the digest's first bits, enough for RANGE_ROWS rows to a range if all rows are one source's
    bits = min(4 * RANGE_DIGITS, max(6, math.ceil(math.log2(max(1, counted) / RANGE_ROWS + 1))))
    cut = F.shiftright(F.conv(F.substring("digest", 1, RANGE_DIGITS), 16, 10).cast("int"), 4 * RANGE_DIGITS - bits)
    sent = rows.where("size > 0").withColumn("cut", cut)
    before = _sums_before(sent.groupBy("source", "cut").agg(F.sum("size").alias("words")), ["source"], "cut")
    inside = Window.partitionBy("source", "cut").orderBy("digest", "id").rowsBetween(Window.unboundedPreceding, 0)
    queued = sent.select("*", F.sum("size").over(inside).alias("so_far"))
    queued = _null_safe(queued, scratch.keep(before, "ranges"), ["source", "cut"])
    queued = _null_safe(queued, targets, ["source"])
    copies = queued.select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("copy"),
    ).withColumn("finish", (F.col("copy") * F.col("source_size") + F.col("words_before") + F.col("so_far")) / F.col("target"))
    # Sources send at an even pace, so equal spans of time hold about equal numbers of words
    spans = max(256, math.ceil(repeats * counted / RANGE_ROWS))
    copies = scratch.keep(copies.select(
        "id", "digest", "source_rank", "copy", "size", "budget", "finish",
        F.floor(F.col("finish") * spans).alias("span")), "queue")
    earlier = _sums_before(copies.groupBy("span").agg(F.sum("size").alias("words")), [], "span")
    order = Window.partitionBy("span").orderBy("finish", "source_rank", "copy", "digest", "id").rowsBetween(Window.unboundedPreceding, 0)
    spent = copies.select("*", F.sum("size").over(order).alias("so_far")).join(scratch.keep(earlier, "spans"), "span")
    chosen = spent.where(F.col("words_before") + F.col("so_far") <= F.col("budget"))
    # Rows that repeat an id share its copies evenly: each got the same offers
    taken = chosen.groupBy(F.col("digest").alias("__digest"), F.col("source_rank").alias("__rank"), F.col("size").alias("__size")).agg(
        F.count(F.lit(1)).alias("copies"))
    listed = _null_safe(rows, targets, ["source"])
    twins = Window.partitionBy("digest", "source_rank", "size")
    numbered = listed.select("*", F.count(F.lit(1)).over(twins).alias("twins"), F.row_number().over(twins.orderBy("id", *row)).alias("twin"))
    joined = numbered.join(
        taken, (F.col("digest") == F.col("__digest")) & (F.col("source_rank") == F.col("__rank")) & (F.col("size") == F.col("__size")), "left")
    share = F.coalesce(F.floor((F.col("copies") + F.col("twins") - F.col("twin")) / F.col("twins")), F.lit(0)).cast("bigint")
    return joined.select(
        "id", "source", "size", "source_size", "target", share.alias("copies"), (share * F.col("size")).alias("taken"), *row)


def _sums_before(ranges: DataFrame, key: list[str], order: str) -> DataFrame:
    """Words of all earlier ranges; one row per range."""
    window = (Window.partitionBy(*key) if key else Window).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return ranges.select(*key, order, F.coalesce(F.sum("words").over(window), F.lit(0)).alias("words_before"))


def _null_safe(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Join each left row with the one right row of its key, nulls being equal."""
    renamed = right.select(*[F.col(name).alias(f"__{name}") for name in key], *[name for name in right.columns if name not in key])
    condition = F.lit(True)
    for name in key:
        condition = condition & F.col(name).eqNullSafe(F.col(f"__{name}"))
    return left.join(renamed, condition).drop(*[f"__{name}" for name in key])


def take_mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", **options) -> DataFrame:
    """The documents of the mix: the columns of ``docs`` and ``mix_copies``, how often the mix takes the row.

    Rows with a null or repeated id each have their own copies. Columns of any name come back as they were, but for one called
    ``mix_copies``, whose place the new one takes.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    plain, (id_name, text_name, source_name) = plainly(docs, id_column, text_column, source_column)
    numbered = scratch.keep(plain.withColumn("__row", F.monotonically_increasing_id()), "documents", compression="zstd")
    mixed = mix(numbered, id_name, text_name, source_name, row_column="__row", **options).where("copies > 0")
    chosen = mixed.select(F.col("row").alias("__taken"), "copies")
    joined = numbered.join(chosen, F.col("__row") == F.col("__taken"))
    own = [(place, name) for place, name in zip(plain.columns, docs.columns) if name != "mix_copies"]
    return joined.select(*[place for place, _ in own], "copies").toDF(*[name for _, name in own], "mix_copies")

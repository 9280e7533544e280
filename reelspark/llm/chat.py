"""Chat formatting: logged snapshots of growing conversations collapse to the longest, which are then rendered.

Each turn has a hash of its place, role and text; the exclusive or of a conversation's first k turn hashes names that
prefix. A conversation whose own name is the name of another one's prefix is a snapshot of it. Names are compared as aggregates and
joins, never pairs of conversations.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..plans import Timeline
from ..plans.timeline import RowNumber, Scan
from .common import Scratch, quoted

#: Fixed format of the rendered turns
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


class RunningXor(Scan):
    """Exclusive or of the values up to and including this row."""

    def __init__(self, value: Column):
        self.value = value

    def local(self, window):
        return F.bit_xor(self.value).over(window.rowsBetween(-(1 << 63), 0))

    def summary(self, position):
        return F.bit_xor(self.value)

    def carry(self, window, summary):
        return F.bit_xor(summary).over(window.rowsBetween(-(1 << 63), -1))

    def combine(self, local, carry):
        return local if carry is None else local.bitwiseXOR(F.coalesce(carry, F.lit(0)))


def maximal_turns(
    turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """``conversation``, ``turn_no`` (from 1), ``n_turns``, ``role`` and ``text`` of the conversations that no other one begins with.

    Turns go by turn number (null first), then role and text, so ties and repeated rows are turns one after another. Of equal
    conversations the one with the smallest id stays, null coming last. Null roles and texts are equal to each other
    and to nothing else. Turns with a null conversation are one conversation. An empty table gives no rows.
    """
    scratch = Scratch(turns.sparkSession, "chat")
    rows = turns.select(
        quoted(conversation).alias("conversation"), F.coalesce(quoted(turn).cast("long"), F.lit(-(1 << 63))).alias("at"),
        quoted(role).cast("string").alias("role"), quoted(text).cast("string").alias("text"))
    # Columns order the turns; the texts themselves need not be carried through the windows
    numbered = scratch.keep(Timeline(rows, "conversation", ["at", "role", "text"]).scan(turn_no=RowNumber()).df, "turns")
    parts = [F.col("turn_no"), F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    narrow = numbered.select(
        "conversation", "turn_no", F.xxhash64(F.lit(1), *parts).alias("one"), F.xxhash64(F.lit(2), *parts[::-1]).alias("two"))
    prefixes = Timeline(narrow, "conversation", ["turn_no"]).scan(a=RunningXor(F.col("one")), b=RunningXor(F.col("two"))).df
    prefixes = scratch.keep(prefixes.select("conversation", "turn_no", "a", "b"), "prefixes")
    sizes = prefixes.groupBy("conversation").agg(F.max("turn_no").alias("n_turns"))
    sized = prefixes.join(
        sizes.withColumnRenamed("conversation", "__c"), F.col("conversation").eqNullSafe(F.col("__c"))).drop("__c")
    whole = scratch.keep(sized.where("turn_no = n_turns").select("conversation", "n_turns", "a", "b"), "whole")
    # Of each name: how long the longest conversation with that prefix is, and the first conversation that is just that
    place = F.struct(F.col("conversation").isNull().alias("no_id"), F.col("conversation").alias("id"))
    named = sized.groupBy("turn_no", "a", "b").agg(
        F.max("n_turns").alias("longest"), F.min(F.when(F.col("turn_no") == F.col("n_turns"), place)).alias("first"))
    snapshots = whole.join(
        named.where("longest > turn_no OR first IS NOT NULL").select(
            F.col("turn_no").alias("k"), F.col("a").alias("a2"), F.col("b").alias("b2"), "longest", "first"),
        (F.col("n_turns") == F.col("k")) & (F.col("a") == F.col("a2")) & (F.col("b") == F.col("b2")),
    ).where((F.col("longest") > F.col("n_turns")) | (place > F.col("first")))
    kept = whole.join(
        snapshots.select(F.col("conversation").alias("__c")), F.col("conversation").eqNullSafe(F.col("__c")), "left_anti")
    kept = scratch.keep(kept.select(F.col("conversation").alias("__c"), "n_turns"), "kept")
    return numbered.join(kept, F.col("conversation").eqNullSafe(F.col("__c"))).select(
        "conversation", F.col("turn_no").cast("long").alias("turn_no"), "n_turns", "role", "text")


def rendered(role: Column, text: Column) -> Column:
    """One turn in the chat format; null roles are ``unknown`` and null texts empty."""
    return F.concat(F.lit(OPEN), F.coalesce(role, F.lit("unknown")), F.lit(MIDDLE), F.coalesce(text, F.lit("")), F.lit(CLOSE))


def render_turns(turns: DataFrame, **columns: str) -> DataFrame:
    """:func:`maximal_turns` with ``segment``, each turn's part of its conversation's rendered text.

    A conversation's text is its segments in the order of ``turn_no``; a conversation of any length spreads over all tasks.
    """
    kept = maximal_turns(turns, **columns)
    return kept.select("conversation", "turn_no", "n_turns", rendered(F.col("role"), F.col("text")).alias("segment"))


def render(turns: DataFrame, **columns: str) -> DataFrame:
    """``conversation``, ``n_turns`` and the rendered ``text``: one row, hence one task's memory, for each conversation."""
    pieces = F.array_sort(F.collect_list(F.struct("turn_no", "segment")))
    return render_turns(turns, **columns).groupBy("conversation").agg(
        F.max("n_turns").alias("n_turns"), F.array_join(F.transform(pieces, lambda piece: piece["segment"]), "").alias("text"))

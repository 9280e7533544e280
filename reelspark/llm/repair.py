"""Repair of conversation structure by the cheapest edits.

Roles must read ``(system? (user assistant)+)?`` by their initials. A row is kept, given another role or deleted, and rows without text
are inserted; the edits of least total cost are found by dynamic programming over four states: nothing read, system read, user
read, assistant read. Backward vectors hold, for each state, the least cost of the rest.

Vectors are stored at square-root checkpoints only. Within a stretch of rows every square root of its length keeps one, and the
blocks between are computed again on the way forward, which picks of all edits that keep the cost tight the letter that comes
first. A long conversation is cut into stretches of about the square root of its rows; each stretch's effect on the vectors is a
4 x 4 table of least costs, so the checkpoints between stretches follow from as many small tables as a stretch has rows, and
all stretches are walked at once, from each state that may enter them.
"""
from __future__ import annotations

import hashlib
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch, quoted
from .ranks import batched, ranked, runs

#: Rows of a stretch, or the square root of the conversation's rows if that is more
STRETCH = 4_096
#: Fixed costs of inserting, changing the role, deleting, and keeping a truncated row
INSERT, REROLE, DELETE, CUT_OFF = 3, 3, 4, 3
SPACE = " \t\n\x0b\x0c\r"

_FAR = 1 << 50
#: The state after the role that a state waits for, that role's initial, and the state after each initial that may be kept
_NEXT, _WANTED = (2, 2, 3, 2), ("u", "u", "a", "u")
_KEPT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}


def _with_inserts(costs: list[int]) -> list[int]:
    """Least costs if rows may be inserted first: at most three inserts lead anywhere."""
    for _ in range(3):
        costs = [min(cost, INSERT + costs[_NEXT[state]]) for state, cost in enumerate(costs)]
    return costs


#: Costs after the last row: nothing and whole exchanges are fine
END = _with_inserts([0, _FAR, _FAR, 0])


def _edits(row: tuple[str, str | None], state: int):
    """Letter, cost and next state of what may be done with a row of an initial and a fault."""
    initial, fault = row
    yield "D", DELETE, state
    if fault in (None, "truncated"):
        extra = CUT_OFF if fault else 0
        kept = _KEPT.get(initial, (None,) * 4)[state]
        if kept is not None:
            yield "K", extra, kept
        yield "R", REROLE + extra, _NEXT[state]


def _before(row: tuple[str, str | None], after: list[int]) -> list[int]:
    return _with_inserts([min(cost + after[to] for _, cost, to in _edits(row, state)) for state in range(4)])


def stretch_table(rows: list[tuple[str, str | None]]) -> list[int]:
    """Least costs from each state before the rows to each state after them, row by row."""
    columns = []
    for last in range(4):
        vector = [0 if state == last else _FAR for state in range(4)]
        for row in reversed(rows):
            vector = _before(row, vector)
        columns.append(vector)
    return [columns[last][first] for first in range(4) for last in range(4)]


def apply_table(table: list[int], after: list[int]) -> list[int]:
    return [min(table[4 * first + last] + after[last] for last in range(4)) for first in range(4)]


def tight_edits(rows: list[tuple[str, str | None]], after: list[int], entries: list[int], last: bool) -> list[tuple[list[str], int]]:
    """For each entry state, the ASCII-least cheapest edits of every row and the state they end in.

    A row's edits are its letter, ``R`` with the new role's initial, after ``I`` and initial of each row inserted before it. Rows
    inserted after the last row of the conversation are in its own edits.
    """
    size = max(1, math.isqrt(len(rows)))
    stored, vector = {len(rows): after}, after
    for at in range(len(rows) - 1, -1, -1):
        vector = _before(rows[at], vector)
        if at % size == 0:
            stored[at] = vector
    walks = [([], state) for state in entries]
    for begin in range(0, len(rows), size):
        end = min(begin + size, len(rows))
        block = [stored[end]]
        for at in range(end - 1, begin - 1, -1):
            block.append(_before(rows[at], block[-1]))
        block.reverse()
        for number, (edits, state) in enumerate(walks):
            for at in range(begin, end):
                here, then, done = block[at - begin], block[at - begin + 1], ""
                while True:
                    letters = [(letter, to) for letter, cost, to in _edits(rows[at], state) if cost + then[to] == here[state]]
                    insert = INSERT + here[_NEXT[state]] == here[state]
                    letter, to = min(letters, default=("Z", state))
                    if insert and letter > "I":
                        done += "I" + _WANTED[state]
                        state = _NEXT[state]
                        continue
                    done += letter + (_WANTED[state] if letter == "R" else "")
                    state = to
                    break
                edits.append(done)
            walks[number] = (edits, state)
    if last:
        for number, (edits, state) in enumerate(walks):
            while state not in (0, 3):
                edits[-1] += "I" + _WANTED[state]
                state = _NEXT[state]
            walks[number] = (edits, state)
    return walks


def _tables(batches):
    schema = pa.schema([("key", pa.int64()), ("stretch", pa.int64()), ("table", pa.list_(pa.int64()))])
    yield from batched(((key, stretch, stretch_table([(initial, fault) for _, initial, fault in rows]))
                        for (key, stretch), rows in runs(batches, 2)), schema)


def _checkpoints(batches):
    """Stretches come last first; each gets the vector after it."""
    schema = pa.schema([("key", pa.int64()), ("stretch", pa.int64()), ("after", pa.list_(pa.int64()))])

    def rows():
        for (key,), stretches in runs(batches, 1):
            vector = END
            for _, stretch, table in stretches:
                yield key, stretch, vector
                vector = apply_table(table, vector)

    yield from batched(rows(), schema)


_WALKED = "row long, key long, stretch long, edits array<string>, ends array<int>, jumps long, first string, final string"


def _walks(batches):
    """A stretch's vector comes first (position -1) if it is not the conversation's only stretch."""
    schema = pa.schema([("row", pa.int64()), ("key", pa.int64()), ("stretch", pa.int64()), ("edits", pa.list_(pa.string())),
                        ("ends", pa.list_(pa.int32())), ("jumps", pa.int64()), ("first", pa.string()), ("final", pa.string())])

    def rows():
        for (key, stretch), held in runs(batches, 2):
            after = held.pop(0)[5] if held[0][0] < 0 else END
            turns = [(initial, fault) for _, _, _, initial, fault, _ in held]
            position, total = held[-1][0], held[0][2]
            whole = len(held) == total
            walks = tight_edits(turns, after, [0] if whole else [0, 1, 2, 3], position == total - 1)
            jumps = sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(turns, turns[1:]))
            for at, turn in enumerate(held):
                head = at == 0
                yield (turn[1], key, stretch, [edits[at] for edits, _ in walks], None if whole or not head else [state for _, state in walks],
                       jumps if head else 0, turns[0][0] if head and not whole else None, turns[-1][0] if head and not whole else None)

    yield from batched(rows(), schema)


def _entries(batches):
    """Stretches in order; each gets the state that enters it, and whether its first row follows on the one before."""
    schema = pa.schema([("key", pa.int64()), ("stretch", pa.int64()), ("entry", pa.int32()), ("jump", pa.int64())])

    def rows():
        for (key,), stretches in runs(batches, 1):
            state, before = 0, None
            for stretch, ends, first, final in stretches:
                yield key, stretch, state, int(before is not None and before + first not in ("su", "ua", "au"))
                state, before = ends[state], final

    yield from batched(rows(), schema)


def repair_rows(
    turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """Every row with its ``fault`` and ``edits``: ``conversation``, ``position`` (from 0), ``turn``, ``role``, ``text``, ``jumps``.

    Rows go by turn (null first), then role and the text's MD5, so ties and repeated rows follow one another in a fixed order. A
    row's first fault counts: ``blank`` (no character but spaces), ``duplicate`` (role and text of an earlier row of the conversation),
    ``truncated`` (the last such character is not one of ``.!?``); blank rows and duplicates must go. ``edits`` is described at
    :func:`tight_edits`; ``jumps`` adds up, over a conversation, to the pairs of adjacent rows whose roles do not follow on each other.
    Null roles and texts count as empty, and an empty role is none of the three. Rows with a null conversation are one conversation.
    Texts are compared by MD5. Columns of other names are not read; an empty table gives no rows.
    """
    scratch = Scratch(turns.sparkSession, "repair")
    rows = scratch.keep(turns.select(
        quoted(conversation).alias("conversation"), quoted(turn).alias("turn"), F.coalesce(quoted(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(quoted(text).cast("string"), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row")), "rows", compression="zstd")
    final = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    narrow = rows.select(
        "conversation", "turn", "role", F.md5("text").alias("digest"), "row", F.substring("role", 1, 1).alias("initial"),
        F.when(final == "", "blank").when(~final.isin(".", "!", "?"), "truncated").alias("own"))
    order = [F.col("turn").asc_nulls_first(), "role", "digest", "row"]
    placed = scratch.keep(ranked(scratch, narrow, "conversation", order, "turns"), "placed")
    firsts = placed.groupBy(F.col("conversation").alias("__c"), "role", "digest").agg(F.min("position").alias("__p")).select("__c", "__p")
    seen = placed.join(firsts, F.col("conversation").eqNullSafe(F.col("__c")) & (F.col("position") == F.col("__p")), "left")
    fault = F.when(F.col("own") == "blank", "blank").when(F.col("__p").isNull(), "duplicate").otherwise(F.col("own"))
    # A conversation is named by the number of its first row from here on: short, and never null
    names = placed.where("position = 0").select(F.col("conversation").alias("__k"), F.col("row").alias("key"))
    stretch = F.floor(F.col("position") / F.greatest(F.lit(STRETCH), F.ceil(F.sqrt("total")))).alias("stretch")
    faults = scratch.keep(seen.select("conversation", "turn", "position", "total", "row", "initial", fault.alias("fault")).join(
        names, F.col("conversation").eqNullSafe(F.col("__k"))).select("*", stretch).drop("__k"), "faults")
    edits = _edits_of_rows(scratch, faults)
    found = faults.join(edits.withColumnRenamed("row", "__row"), F.col("row") == F.col("__row")).select(
        F.col("row").alias("__row"), "position", "fault", "edits", "jumps")
    return rows.join(found, F.col("row") == F.col("__row")).select(
        "conversation", "position", "turn", "role", "text", "fault", "edits", "jumps")


def _edits_of_rows(scratch: Scratch, faults: DataFrame) -> DataFrame:
    """``row``, ``edits`` and ``jumps``."""
    sorted_by = ["key", "stretch", "position"]
    many = faults.where("total > " + str(STRETCH))
    tables = many.select("key", "stretch", "position", "initial", "fault").repartition("key", "stretch").sortWithinPartitions(*sorted_by)
    tables = scratch.keep(tables.mapInArrow(_tables, "key long, stretch long, table array<long>"), "tables")
    # At most about the square root of a conversation's rows
    steps = tables.select("key", (-F.col("stretch")).alias("late"), "stretch", "table").repartition("key").sortWithinPartitions("key", "late")
    vectors = scratch.keep(steps.mapInArrow(_checkpoints, "key long, stretch long, after array<long>"), "checkpoints")
    nothing = F.lit(None).cast("string")
    both = faults.select("key", "stretch", "position", "row", "total", "initial", "fault", F.lit(None).cast("array<bigint>").alias("after"))
    both = both.unionByName(vectors.select(
        "key", "stretch", F.lit(-1).cast("long").alias("position"), F.lit(-1).cast("long").alias("row"), F.lit(0).cast("long").alias("total"),
        nothing.alias("initial"), nothing.alias("fault"), "after"))
    both = both.repartition("key", "stretch").sortWithinPartitions(*sorted_by)
    walked = scratch.keep(both.mapInArrow(_walks, _WALKED), "walked")
    ends = walked.where("ends IS NOT NULL").select("key", "stretch", "ends", "first", "final").repartition("key").sortWithinPartitions("key", "stretch")
    entries = scratch.keep(ends.mapInArrow(_entries, "key long, stretch long, entry int, jump long"), "entries")
    entries = entries.select(F.col("key").alias("__key"), F.col("stretch").alias("__stretch"), "entry", "jump")
    joined = walked.join(entries, (F.col("key") == F.col("__key")) & (F.col("stretch") == F.col("__stretch")), "left")
    # The pair across two stretches is counted with the later one's first row
    jumps = F.col("jumps") + F.when(F.col("ends").isNotNull(), F.coalesce("jump", F.lit(0))).otherwise(0)
    return joined.select("row", F.element_at("edits", F.coalesce("entry", F.lit(0)) + 1).alias("edits"), jumps.alias("jumps"))


def edit_cost(edits: Column, fault: Column) -> Column:
    """What a row's edits cost."""
    count = lambda letter: F.length(F.regexp_replace(edits, f"[^{letter}]", ""))
    cut_off = F.when((fault == "truncated") & ~edits.contains("D"), CUT_OFF).otherwise(0)
    return (INSERT * count("I") + REROLE * count("R") + DELETE * count("D") + cut_off).cast("bigint")


def repaired_turns(rows: DataFrame) -> DataFrame:
    """The repaired conversations of :func:`repair_rows`: ``conversation``, ``position``, ``part``, ``role`` and ``text``.

    ``position`` and ``part`` order them; ``part`` tells rows inserted at a position from the row that stands there.
    """
    steps = rows.select("conversation", "position", "role", "text", F.posexplode(F.regexp_extract_all("edits", F.lit("[DIKR][ua]?"), F.lit(0))).alias("part", "edit"))
    named = F.when(F.right("edit", F.lit(1)) == "u", "user").when(F.right("edit", F.lit(1)) == "a", "assistant").otherwise(F.col("role"))
    return steps.where("edit <> 'D'").select(
        "conversation", "position", "part", named.alias("role"), F.when(F.col("edit").startswith("I"), "").otherwise(F.col("text")).alias("text"))


def _digests(batches):
    schema = pa.schema([("conversation", pa.string()), ("missing", pa.bool_()), ("audit", pa.string()), ("digest", pa.string())])

    def rows():
        # Hash and letters go on from row to row, so no conversation's texts are held
        held, digest, audit, empty = None, None, [], True
        for batch in batches:
            for conversation, _, edits, role, text in zip(*[column.to_pylist() for column in batch.columns]):
                key = (conversation,)
                if key != held:
                    if held:
                        yield held[0], held[0] is None, "".join(audit), digest.hexdigest()
                    held, digest, audit, empty = key, hashlib.sha256(), [], True
                at = 0
                while at < len(edits):
                    letter, at = edits[at], at + 1
                    audit.append(letter)
                    named = {"u": "user", "a": "assistant"}.get(edits[at:at + 1])
                    at += named is not None
                    if letter != "D":
                        digest.update((("" if empty else "\n") + f"{named or role}:{'' if letter == 'I' else text}").encode())
                        empty = False
        if held:
            yield held[0], held[0] is None, "".join(audit), digest.hexdigest()

    yield from batched(rows(), schema)


def repair_digests(rows: DataFrame) -> DataFrame:
    """``conversation`` (as text), ``audit`` (its edits' letters in order) and ``digest``: SHA-256 of its repaired ``role:text`` lines.

    A digest reads its conversation from end to end, so each is one task's stream; it holds the letters but never the texts.
    """
    laid = rows.select(F.col("conversation").cast("string").alias("conversation"), "position", "edits", "role", "text")
    laid = laid.repartition("conversation").sortWithinPartitions("conversation", "position")
    return laid.mapInArrow(_digests, "conversation string, missing boolean, audit string, digest string").drop("missing")


def repair_summary(turns: DataFrame, conversation: str = "conv_id", **columns: str) -> DataFrame:
    """Per conversation: ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit`` and ``digest``.

    ``gaps`` is how many whole turn numbers between the least and the greatest are missing; without turn numbers it is 0.
    """
    scratch = Scratch(turns.sparkSession, "repaired")
    rows = scratch.keep(repair_rows(turns, conversation, **columns), "edits", compression="zstd")
    sums = [F.sum((F.col("fault") == fault).cast("bigint")).alias(fault) for fault in ("blank", "duplicate", "truncated")]
    by_turn = rows.groupBy("conversation", "turn").agg(
        *[F.coalesce(total, F.lit(0)).alias(name) for total, name in zip(sums, ("blank", "duplicate", "truncated"))], F.sum("jumps").alias("illegal"),
        F.sum(edit_cost(F.col("edits"), F.coalesce("fault", F.lit("")))).alias("cost"))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("bigint")
    counted = by_turn.groupBy("conversation").agg(
        gaps.alias("gaps"), *[F.sum(name).alias(name) for name in ("blank", "duplicate", "truncated", "illegal", "cost")])
    digests = repair_digests(rows).withColumnRenamed("conversation", "__c")
    return counted.join(digests, F.col("conversation").cast("string").eqNullSafe(F.col("__c"))).drop("__c")

"""Line deduplication by a deletion-neighbourhood join.

A line is the sequence of its words. Two lines are within one edit (a word put in, left out or replaced) if and only if
one of these keys is common to both: a line without its word p, with p, for replaced words; or a line without one of
its words against the other whole line. A key that holds the place of the deletion is met by close lines only, so each
group of equal keys is settled by its earliest member: an aggregate, whatever the group's size, and no pairs.

A line of n words has n + 1 keys, so they are made only for lines that can have a partner: one edit leaves the first or
the last half of a line as it was, and lines that share no half with another line are left out first.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, broadcast_if_small, plainly, quoted, text_bytes
from .spans import bound

#: Lines of fewer words have only exact duplicates: one word is too much of them
FUZZY_WORDS = 8
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_MASK = (1 << 64) - 1


def half_keys(words: list[bytes]) -> list[int]:
    """Keys of which lines within one edit share at least one: their first or last words, as many as both halves hold.

    The number of words in a half is fixed for four lengths in a row; the first of the four also takes the class below, since its
    partner may be one word shorter.
    """
    count, keys = len(words), []
    if count < FUZZY_WORDS:
        return keys
    classes = [count // 4] + ([count // 4 - 1] if count % 4 == 0 and count > FUZZY_WORDS else [])
    for size in classes:
        for side, part in enumerate((words[:2 * size], words[count - 2 * size:])):
            value = xxhash.xxh64_intdigest(b" ".join(part), 2 * size + side)
            keys.append(value - (1 << 64) if value >> 63 else value)
    return keys


def edit_keys(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """128-bit keys of a line of at least ``FUZZY_WORDS`` words, and their roles: 0 the whole line, 1 a word left out, 2 a word left out at its place."""
    count = len(words)
    hashes = np.array([xxhash.xxh64_intdigest(word) for word in words], np.uint64)
    roles = np.concatenate(([0], np.full(count, 1), np.full(count, 2))).astype(np.int8)
    out = []
    for base in _BASES:
        powers = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(count, np.uint64(base)))))
        down = np.uint64(pow(base, -1, 1 << 64))
        sums = np.concatenate(([np.uint64(0)], np.cumsum(hashes * powers[:count])))
        without = sums[:-1] + (sums[-1] - sums[1:]) * down
        # Length and place are mixed in, so that keys of different roles never meet by their words alone
        whole = sums[-1:] * np.uint64(3) + np.uint64(count)
        shorter = without * np.uint64(3) + np.uint64(count - 1)
        placed = (without * np.uint64(5) + np.uint64(count)) ^ (powers[1:] * np.uint64(0xA24BAED4963EE407) + np.uint64(1))
        out.append(np.concatenate((whole, shorter, placed)).view(np.int64))
    return np.stack(out), roles


def _lines_of(texts: pa.Array):
    data, offsets = text_bytes(texts)
    raw = data.tobytes()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield [line.split() for line in raw[a:b].split(b"\n")]


def _spread_lines(docs: DataFrame, kind: str) -> DataFrame:
    """One row per line that has words: id, twin, line number, 128-bit hash of its words and its half keys."""

    def run(batches):
        for batch in batches:
            owner, number, digest, keys = [], [], [], []
            for row, lines in enumerate(_lines_of(batch.column(2))):
                for at, words in enumerate(lines):
                    if words:
                        owner.append(row)
                        number.append(at)
                        digest.append(xxhash.xxh3_128_digest(b" ".join(words)))
                        keys.append(half_keys(words))
            line = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
            owner = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(owner), batch.column(1).take(owner), pa.array(number, pa.int32()), pa.array(line[:, 0]),
                pa.array(line[:, 1]), pa.array(keys, pa.list_(pa.int64()))], ["id", "twin", "n", "la", "lb", "keys"])

    return docs.mapInArrow(run, f"id {kind}, twin bigint, n int, la bigint, lb bigint, keys array<bigint>")


def _packed(docs: DataFrame, kind: str) -> DataFrame:
    """Texts as compressed bytes, for the shuffles they go through."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            raw = data.tobytes()
            packed = [pack(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["id", "twin", "packed"])

    return docs.mapInArrow(run, f"id {kind}, twin bigint, packed binary")


def _edit_rows(held: DataFrame, kind: str) -> DataFrame:
    """The edit keys of the listed lines of each text, with the line's place."""

    def run(batches):
        for batch in batches:
            unpack = zstandard.ZstdDecompressor().decompress
            keys, roles, rows, places, size = [], [], [], [], 0

            def done():
                joined = np.concatenate(keys, axis=1)
                counts = [len(role) for role in roles]
                owner = pa.array(np.repeat(rows, counts))
                return pa.RecordBatch.from_arrays([
                    pa.array(joined[0]), pa.array(joined[1]), pa.array(np.concatenate(roles)), batch.column(0).take(owner),
                    batch.column(1).take(owner), pa.array(np.repeat(places, counts).astype(np.int32))],
                    ["a", "b", "role", "id", "twin", "n"])

            for row in range(batch.num_rows):
                split = unpack(batch.column(2)[row].as_py()).split(b"\n")
                for n in batch.column(3)[row].as_py():
                    words = split[n].split()
                    if len(words) < FUZZY_WORDS:
                        continue
                    found, role = edit_keys(words)
                    keys.append(found)
                    roles.append(role)
                    rows.append(row)
                    places.append(n)
                    size += len(role)
                    if size > 100_000:
                        yield done()
                        keys, roles, rows, places, size = [], [], [], [], 0
            if keys:
                yield done()

    return held.mapInArrow(run, f"a bigint, b bigint, role byte, id {kind}, twin bigint, n int")


def _numbered(docs: DataFrame, scratch: Scratch, id_column: str, text_column: str) -> DataFrame:
    """``docs``, written once, with ``__twin``: with the id it names a document. Of a null id it is the row's number."""
    twin = F.when(quoted(id_column).isNull(), F.monotonically_increasing_id()).otherwise(F.xxhash64(quoted(text_column)))
    return scratch.keep(docs.withColumn("__twin", twin), "documents", compression="zstd")


def repeated_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id`` and ``drop``: the numbers (from 0) of each document's lines of which an equal or close line lies earlier.

    Earlier means a smaller id, then an earlier document of the same id, then a smaller line number; null ids come last. Lines are
    judged on the input, not on what is left. Lines are equal if their words are, and close within one edit if both have at
    least ``FUZZY_WORDS`` words. Blank lines are never dropped. Rows with a null id are a document each, in the order they were written;
    so are rows that repeat an id with another text, in the order of a hash of it. Rows that repeat both id and text are one
    document and keep the same lines. Documents that lose nothing have no row.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    return _repeated(_numbered(docs, scratch, id_column, text_column), scratch, id_column, text_column).select("id", "drop")


def _repeated(numbered: DataFrame, scratch: Scratch, id_column: str, text_column: str) -> DataFrame:
    """``id``, ``twin`` and ``drop`` of each document that loses lines."""
    narrow = numbered.select(quoted(id_column).alias("id"), F.col("__twin").alias("twin"), quoted(text_column).alias("text")).where("text IS NOT NULL")
    kind = narrow.schema["id"].dataType.simpleString()
    place = F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("twin"), F.col("n"))
    lines = scratch.keep(_spread_lines(narrow, kind), "lines")
    known = scratch.keep(lines.groupBy("la", "lb").agg(F.min(place).alias("first"), F.any_value("keys").alias("keys")), "distinct")
    halves = known.where(F.size("keys") > 0).select("la", "lb", F.explode("keys").alias("key"))
    shared = halves.groupBy("key").agg(F.count(F.lit(1)).alias("lines")).where("lines > 1")
    partners = scratch.keep(halves.join(shared, "key").select("la", "lb").distinct(), "partners")
    # The words of a line are read where it first occurs
    wanted = known.select("la", "lb", "first").join(broadcast_if_small(partners), ["la", "lb"], "left_semi")
    wanted = scratch.keep(wanted.groupBy(F.col("first.id").alias("__id"), F.col("first.twin").alias("__twin")).agg(
        F.sort_array(F.collect_list("first.n")).alias("numbers")), "wanted")
    same = F.col("id").eqNullSafe(F.col("__id")) & (F.col("twin") == F.col("__twin"))
    held = _packed(narrow, kind).join(broadcast_if_small(wanted, values="numbers"), same)
    edits = scratch.keep(_edit_rows(held.select("id", "twin", "packed", "numbers"), kind), "edits")
    # Nearly all keys are of one line: they go before anything is gathered
    met = edits.groupBy("a").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("a")
    edits = scratch.keep(edits.join(met, "a"), "met").withColumn("place", place)
    # A whole line and those one word longer meet in one key, lines with a word left out at the same place in another
    groups = edits.groupBy("a", "b").agg(F.min("place").alias("least"), F.min(F.when(F.col("role") == 0, F.col("place"))).alias("whole"))
    close = edits.join(groups, ["a", "b"]).groupBy("place").agg(
        F.min(F.when(F.col("role") == 1, F.col("whole")).otherwise(F.col("least"))).alias("close"))
    close = scratch.keep(close.where("close < place"), "close").select(F.col("place").alias("__place"), "close")
    earliest = known.join(broadcast_if_small(close), F.col("first") == F.col("__place"), "left").select(
        "la", "lb", F.least("first", "close").alias("earliest"))
    return (
        lines.select("id", "twin", "n", "la", "lb").join(earliest, ["la", "lb"]).where(place > F.col("earliest")).groupBy("id", "twin")
        .agg(F.sort_array(F.collect_set("n")).alias("drop"))
    )


def dedup_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length_column: str | None = None) -> DataFrame:
    """``docs`` without the lines that :func:`repeated_lines` names; all rows and columns stay.

    A text that loses all its lines becomes empty; null texts stay null. Columns of any name, ``__twin`` too, come back as they were. ``length_column`` is set to the new
    number of characters if given.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    plain, (id_name, text_name) = plainly(docs, id_column, text_column)
    numbered = _numbered(plain, scratch, id_name, text_name)
    drops = scratch.keep(_repeated(numbered, scratch, id_name, text_name), "drops")
    drops = drops.select(F.col("id").alias("__id"), F.col("twin").alias("__of"), F.col("drop").alias("__drop"))
    same = F.col(id_name).eqNullSafe(F.col("__id")) & (F.col("__twin") == F.col("__of"))
    joined = numbered.join(broadcast_if_small(drops, values="__drop"), same, "left")
    # Numbers that stay, by hash, so that a text's lines are not compared with each number that goes
    lines = F.split(F.col(text_name), "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__drop").cast("array<int>"))
    left = bound(lines, lambda whole: F.array_join(F.transform(kept, lambda at: whole[at]), "\n"))
    out = joined.withColumn(text_name, F.when(F.col("__drop").isNull(), F.col(text_name)).otherwise(left))
    if length_column:
        _, (length_name,) = plainly(docs, length_column)
        out = out.withColumn(length_name, F.length(text_name).cast(docs.schema[length_column].dataType))
    return out.select(*plain.columns).toDF(*docs.columns)

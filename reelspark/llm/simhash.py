"""SimHash near-duplicates: block keys by the pigeonhole principle, then the Hamming distance.

A fingerprint is cut into k blocks. Two fingerprints that differ in at most d bits differ in at most d blocks, so they
agree in at least k - d of them: every choice of k - d blocks is a join key, and each pair that may link meets under one.
"""
from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, plainly, quoted, text_bytes
from .components import connected_components

SEED = 42
BITS = 64
#: Fingerprints of one key that one step compares with each other; keys with more are cut into tiles
TILE = 1024
#: Hashes whose bits are counted at a time
COUNTED = 1 << 15


def simhash(text: bytes, words: int = 4) -> int:
    """The fingerprint of a UTF-8 text as an unsigned integer."""
    parts = text.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(part) + 1 for part in parts]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(parts) > words:
        starts, ends = starts[:len(parts) - words + 1], ends[words - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends.tolist())], "<u8")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), COUNTED):
        part = hashes[at:at + COUNTED].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 4) -> DataFrame:
    """``id`` and ``fingerprint`` (the 64 bits as a BIGINT) of every row.

    A-Z count as a-z; words are runs of anything but space, tab, newline, vertical tab, form feed and carriage return.
    The fingerprint's bits are set where over half of the hashes of the ``words``-word shingles, repeats included, have them.
    A text of fewer words is one shingle; a null text or one without words has fingerprint 0. Rows with a null or
    repeated id each keep their row.
    """
    narrow = docs.select(quoted(id_column).alias("id"), quoted(text_column).alias("text"))
    kind = narrow.schema["id"].dataType

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            raw = data.tobytes()
            found = np.array([simhash(raw[a:b], words) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fingerprint"])

    return narrow.mapInArrow(run, f"id {kind.simpleString()}, fingerprint bigint")


def block_masks(blocks: int, distance: int) -> list[int]:
    """One mask, as a signed 64-bit integer, for each choice of blocks that a close pair may agree in."""
    edges = [round(BITS * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    masks = [sum(chosen) for chosen in combinations(parts, blocks - distance)]
    return [mask - (1 << BITS) if mask >> (BITS - 1) else mask for mask in masks]


def block_count(prints: int, distance: int) -> int:
    """The fewest blocks by which a fingerprint meets about one other by chance; any count finds every close pair."""
    for blocks in range(distance + 1, 3 * distance + 4):
        bits = BITS * (blocks - distance) / blocks
        if prints * comb(blocks, distance) / 2 ** (bits + 1) <= 1:
            return blocks
    return 3 * distance + 4


def close_links(prints: DataFrame, distance: int, blocks: int) -> DataFrame:
    """Links ``u`` < ``v`` between distinct fingerprints of at most ``distance`` differing bits, enough to join each group.

    Within a block key a link is left out only where others already connect its ends, so a group of m close fingerprints
    gives fewer than m links for each key and tile, never all its pairs.
    """
    keys = F.array(*[
        F.struct(F.lit(i).cast("short").alias("c"), F.col("fingerprint").bitwiseAND(F.lit(mask)).alias("part"))
        for i, mask in enumerate(block_masks(blocks, distance))
    ])
    keyed = prints.select("fingerprint", F.explode(keys).alias("k")).select("fingerprint", "k.c", "k.part")
    sizes = keyed.groupBy("c", "part").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    shared = keyed.join(sizes, ["c", "part"]).select(
        "c", "part", "fingerprint", tiles.alias("tiles"),
        F.pmod(F.xxhash64("fingerprint"), tiles).cast("int").alias("own"),
    )
    # A key of n fingerprints: each goes to one tile with every cut of the key, its own included
    tiled = shared.select("c", "part", "fingerprint", "own", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")).select(
        "c", "part", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "fingerprint")
    key = ["c", "part", "a", "b"]
    ordered = tiled.repartition(*key).sortWithinPartitions(*key)

    def run(batches):
        held = None
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            if held is not None:
                columns = [np.concatenate(pair) for pair in zip(held, columns)]
            fresh = np.zeros(len(columns[0]), bool)
            for column in columns[:4]:
                fresh[1:] |= column[1:] != column[:-1]
            cut = int(np.flatnonzero(fresh)[-1]) if fresh.any() else 0
            held = [column[cut:] for column in columns]
            if cut:
                yield _links(np.cumsum(fresh[:cut]), columns[4][:cut], distance)
        if held is not None and len(held[0]):
            fresh = np.zeros(len(held[0]), bool)
            yield _links(np.cumsum(fresh), held[4], distance)

    return ordered.mapInArrow(run, "u bigint, v bigint").distinct()


def _links(group: np.ndarray, prints: np.ndarray, distance: int) -> pa.RecordBatch:
    """A spanning forest of the close pairs of each group; equal groups lie together."""
    parent = np.arange(len(prints))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    bits, left, right = prints.view(np.uint64), [], []
    shift, at = 1, np.arange(len(prints))
    while True:
        at = at[at + shift < len(prints)]
        at = at[group[at] == group[at + shift]]
        if not len(at):
            break
        near = at[np.bitwise_count(bits[at] ^ bits[at + shift]) <= distance]
        near = near[parent[near] != parent[near + shift]]
        for i in near.tolist():
            a, b = root(i), root(i + shift)
            if a != b:
                parent[max(a, b)] = min(a, b)
                left.append(prints[i])
                right.append(prints[i + shift])
        if len(near):
            # Point nodes at their roots, so that ends already joined are told apart by one comparison
            while (parent[parent] != parent).any():
                parent = parent[parent]
        shift += 1
    u, v = np.array(left, np.int64), np.array(right, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])


def simhash_groups(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", *, distance: int = 4, words: int = 4, blocks: int | None = None,
) -> DataFrame:
    """``id``, ``fingerprint`` (BIGINT) and ``component``: the smallest id reachable over links of at most ``distance`` bits.

    Equal fingerprints are one node, so copies are never paired. Null ids stay in the result and lend their fingerprint to
    links, but name no component unless a component has no other id (then it is null). Empty tables give no rows. ``blocks``
    is chosen from the number of distinct fingerprints unless given; it changes the work, not the result.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.keep(fingerprints(docs, id_column, text_column, words), "fingerprints")
    mapping = _components(rows, scratch, distance, blocks)
    return rows.join(mapping, rows.fingerprint == mapping.print).select("id", "fingerprint", "component")


def _components(rows: DataFrame, scratch: Scratch, distance: int, blocks: int | None) -> DataFrame:
    """The smallest id (``component``) of the group of each fingerprint (``print``)."""
    prints = scratch.keep(rows.groupBy("fingerprint").agg(F.min("id").alias("first")), "distinct")
    if blocks is None:
        blocks = block_count(prints.count(), distance)
    links = close_links(prints.select("fingerprint"), distance, blocks)
    members = connected_components(links, "u", "v", scratch)
    named = prints.join(members, prints.fingerprint == members.node, "left").select(
        "fingerprint", "first", F.coalesce("component", "fingerprint").alias("root"))
    firsts = named.groupBy("root").agg(F.min("first").alias("component"))
    return scratch.keep(named.join(firsts, "root").select(F.col("fingerprint").alias("print"), "component"), "mapping")


def keep_first(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", *, distance: int = 4, words: int = 4, blocks: int | None = None,
) -> DataFrame:
    """``docs`` with exactly one row of each group: that of the smallest id, null last, and of equal ids the first as written.

    Columns of any name, ``__row`` too, come back as they were.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    plain, (id_name, text_name) = plainly(docs, id_column, text_column)
    numbered = scratch.keep(plain.withColumn("__row", F.monotonically_increasing_id()), "documents", compression="zstd")
    named = numbered.select(F.struct(F.col(id_name).isNull().alias("no_id"), F.col(id_name).alias("id"), F.col("__row").alias("row")).alias("id"),
                            F.col(text_name).alias("text"))
    rows = scratch.keep(fingerprints(named, "id", "text", words), "fingerprints")
    firsts = _components(rows, scratch, distance, blocks).select(F.col("component.row").alias("__first")).distinct()
    return numbered.join(firsts, F.col("__row") == F.col("__first"), "left_semi").drop("__row").toDF(*docs.columns)

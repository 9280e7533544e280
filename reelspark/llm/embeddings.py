"""Near-duplicate embeddings: int8 tile products with an error bound per vector, and double precision where it matters.

Each unit vector x is stored as s * q with q in int8 and a known error e >= |x - s * q|. For two of them
|<x, y> - s t <q, r>| <= e_x |t r| + e_y, so a tile's integer product settles nearly all pairs; those that may reach the threshold
are computed again from the doubles. A tile keeps counts and a spanning forest of its links, not its pairs.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, quoted
from .components import connected_components

THRESHOLD = 0.9
#: Vectors of a block hold about so many bytes of doubles, and at most so many vectors
BLOCK_BYTES = 2 << 20
BLOCK_ROWS = 2_048
#: Rows of a tile whose products are held at a time
STRIP = 512
#: Integer products of float32 are exact below 2**24: so many dimensions of 127 * 127
EXACT_DIMENSIONS = (1 << 24) // (127 * 127)
#: More than what rounding can add to a bound
SLACK = 1e-6


def quantise(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Integers of at most 127 (as float32), scales, and the norm of what they miss, of each row."""
    scale = np.maximum(np.abs(units).max(axis=1), 1e-300) / 127
    whole = np.rint(units / scale[:, None])
    error = np.sqrt(((units - whole * scale[:, None]) ** 2).sum(axis=1))
    return whole.astype(np.float32), scale, error


def tile_links(left: np.ndarray, right: np.ndarray | None, threshold: float):
    """Row pairs whose cosine reaches the threshold: of ``left`` and ``right``, or within ``left``; a strip at a time."""
    units = [rows / np.sqrt((rows * rows).sum(axis=1))[:, None] for rows in (left, left if right is None else right)]
    (qa, sa, ea), (qb, sb, eb) = quantise(units[0]), quantise(units[1])
    reach = np.sqrt((qb.astype(np.float64) ** 2).sum(axis=1)) * sb
    other = left if right is None else right
    norms = [np.sqrt((rows * rows).sum(axis=1)) for rows in (left, other)]
    for at in range(0, len(left), STRIP):
        product = np.zeros((min(STRIP, len(left) - at), len(other)))
        for d in range(0, left.shape[1], EXACT_DIMENSIONS):
            product += qa[at:at + STRIP, d:d + EXACT_DIMENSIONS] @ qb[:, d:d + EXACT_DIMENSIONS].T
        product *= sa[at:at + STRIP, None] * sb
        product += ea[at:at + STRIP, None] * reach + (eb + SLACK)
        i, j = np.nonzero(product >= threshold)
        i += at
        if right is None:
            i, j = i[i < j], j[i < j]
        for cut in range(0, len(i), 1 << 16):
            a, b = i[cut:cut + (1 << 16)], j[cut:cut + (1 << 16)]
            cosine = (left[a] * other[b]).sum(axis=1) / (norms[0][a] * norms[1][b])
            linked = cosine >= threshold
            yield a[linked], b[linked]


def _forest(links, count: int):
    """The links that join what earlier ones left apart."""
    parent = list(range(count))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in links:
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            yield a, b


def near_vectors(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", *, threshold: float = THRESHOLD,
) -> DataFrame:
    """``id``, ``n_links``, ``component`` (the smallest id reachable) and ``kept`` (the id is the component's) of every row.

    Vectors link at a cosine of ``threshold`` or more, in double precision, however long or short they are. Null and empty vectors, zeros, and vectors with null or
    non-finite components link with nothing, and vectors of different lengths do not link. Equal vectors are compared once: each links with
    its copies, and shares its class's links. A null id counts as a vector but names no component unless there is no other.
    """
    scratch = Scratch(vectors.sparkSession, "embeddings")
    rows = vectors.select(quoted(id_column).alias("id"), quoted(vector_column).cast("array<double>").alias("vector"))
    good = F.col("vector").isNotNull() & (F.size("vector") > 0) & F.exists("vector", lambda x: x != 0) & F.forall(
        "vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # Signed zeros are equal
    key = F.when(F.coalesce(good, F.lit(False)), F.sha2(F.to_binary(F.array_join(F.transform("vector", lambda x: F.hex((x + 0.0).cast("string"))), ","), F.lit("utf-8")), 256))
    rows = scratch.keep(rows.withColumn("class", key), "rows")
    classes = rows.where("class IS NOT NULL").groupBy("class").agg(
        F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"), F.any_value("vector").alias("vector"))
    # A class's number says its block; blocks of one length of vector are tiled with each other
    block = _numbered(classes, scratch)
    packed = _packed(block, scratch)
    tiles = _tiles(packed)
    found = scratch.keep(tiles.mapInArrow(
        lambda batches: _compare(batches, threshold), "kind string, u string, v string, n bigint"), "links")
    linked = found.where("kind = 'count'").groupBy(F.col("u").alias("class")).agg(F.sum("n").alias("others"))
    members = connected_components(found.where("kind = 'link'"), "u", "v", scratch)
    named = classes.select("class", "first", "copies").join(linked, "class", "left").join(
        members, F.col("class") == F.col("node"), "left").select("class", "first", "copies", "others", F.coalesce("component", "class").alias("root"))
    firsts = named.groupBy("root").agg(F.min("first").alias("component"))
    table = scratch.keep(named.join(firsts, "root").select(
        F.col("class").alias("__class"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component"), "classes")
    joined = rows.join(table, rows["class"] == F.col("__class"), "left")
    alone = F.col("__class").isNull()
    component = F.when(alone, F.col("id")).otherwise(F.col("component"))
    return joined.select(
        "id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component"),
        component.eqNullSafe(F.col("id")).alias("kept"))


def _numbered(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """Classes with ``dimension`` and a ``block`` of bounded expected size, by a hash."""
    classes = scratch.keep(classes, "distinct").withColumn("dimension", F.size("vector"))
    per_block = F.greatest(F.lit(16), F.least(F.lit(BLOCK_ROWS), F.floor(F.lit(BLOCK_BYTES) / (8 * F.col("dimension")))))
    counts = classes.groupBy("dimension").agg(F.count(F.lit(1)).alias("classes"))
    blocks = counts.select(F.col("dimension").alias("__d"), F.ceil(F.col("classes") / per_block).cast("int").alias("blocks"))
    return classes.join(blocks, F.col("dimension") == F.col("__d")).withColumn(
        "block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))


def _packed(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per block: its classes, their copies and their vectors end to end."""
    narrow = classes.select("dimension", "blocks", "block", "class", "copies", "vector")
    ordered = narrow.repartition("dimension", "block").sortWithinPartitions("dimension", "block", "class")

    def run(batches):
        held, current = [], None
        for batch in batches:
            dimension, blocks, block = (batch.column(i).to_pylist() for i in range(3))
            names, copies = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            vectors = batch.column(5).to_pylist()
            for row in zip(dimension, blocks, block, names, copies, vectors):
                if row[:3] != current:
                    if held:
                        yield done(current, held)
                    held, current = [], row[:3]
                held.append(row[3:])
        if held:
            yield done(current, held)

    def done(key, held):
        matrix = _scaled(np.array([vector for _, _, vector in held], np.float64))
        return pa.RecordBatch.from_arrays([
            pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([key[2]], pa.int32()),
            pa.array([[name for name, _, _ in held]], pa.list_(pa.string())), pa.array([[n for _, n, _ in held]], pa.list_(pa.int64())),
            pa.array([matrix.tobytes()], pa.binary())], ["dimension", "blocks", "block", "names", "copies", "matrix"])

    schema = "dimension int, blocks int, block int, names array<string>, copies array<bigint>, matrix binary"
    return scratch.keep(ordered.mapInArrow(run, schema), "blocks")


def _scaled(matrix: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest component to 0.5 to 1: no square over- or underflows, and no cosine changes."""
    _, exponent = np.frexp(np.abs(matrix).max(axis=1))
    return np.ldexp(matrix, -exponent[:, None])


def _tiles(packed: DataFrame) -> DataFrame:
    """One row per pair of blocks of one dimension, a block with itself included; each pair lies in one partition."""
    pairs = packed.select("dimension", F.col("block").alias("a"), F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("b"))
    left = packed.select(F.col("dimension").alias("d1"), F.col("block").alias("b1"), F.col("names").alias("names1"), F.col("copies").alias("copies1"), F.col("matrix").alias("matrix1"))
    right = packed.select(F.col("dimension").alias("d2"), F.col("block").alias("b2"), F.col("names").alias("names2"), F.col("copies").alias("copies2"), F.col("matrix").alias("matrix2"))
    first = pairs.join(left, (F.col("dimension") == F.col("d1")) & (F.col("a") == F.col("b1")))
    both = first.join(right, (F.col("dimension") == F.col("d2")) & (F.col("b") == F.col("b2")))
    return both.select("dimension", "a", "b", "names1", "copies1", "matrix1", "names2", "copies2", "matrix2")


def _compare(batches, threshold):
    for batch in batches:
        for at in range(batch.num_rows):
            dimension, a, b, names1, copies1, matrix1, names2, copies2, matrix2 = (
                batch.column(i)[at].as_py() for i in range(9))
            left = np.frombuffer(matrix1, np.float64).reshape(-1, dimension)
            right = None if a == b else np.frombuffer(matrix2, np.float64).reshape(-1, dimension)
            names, offset = (names1, 0) if right is None else (names1 + names2, len(names1))
            sizes = np.array(copies1 if right is None else copies1 + copies2, np.int64)
            counts, forest = np.zeros(len(names), np.int64), []
            for i, j in tile_links(left, right, threshold):
                j = j + offset
                np.add.at(counts, i, sizes[j])
                np.add.at(counts, j, sizes[i])
                forest += zip(i.tolist(), j.tolist())
                if len(forest) > 1 << 17:
                    forest = list(_forest(forest, len(names)))
            forest = list(_forest(forest, len(names)))
            some = np.flatnonzero(counts)
            none = pa.nulls(len(some), pa.string())
            table = pa.array(names, pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(["count"] * len(some), pa.string()), table.take(pa.array(some)), none, pa.array(counts[some])], ["kind", "u", "v", "n"])
            ends = np.array(forest, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(["link"] * len(ends), pa.string()), table.take(pa.array(ends[:, 0])), table.take(pa.array(ends[:, 1])),
                 pa.nulls(len(ends), pa.int64())], ["kind", "u", "v", "n"])

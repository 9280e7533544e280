"""A Merkle manifest of a dataset, and versions of it by path copying.

Each source is a tree of runs of 16 nodes over its rows, and the sources' roots are the leaves of one more tree. The tree is
built and walked in aligned blocks of 4,096 nodes (three levels): a block's nodes below its top are hashed in one task, the tops
are the nodes of the next round, and so on until a source has one. Going back down, a block receives the path from its top to
the root, so no task holds more than a block and a path.

The tree is persistent. A changed leaf makes a version that shares every node of the first version but the changed leaf's
ancestors: those are copied, first within the leaf's block, then along the path that the block received. ``copies`` lists them,
from leaf to root; any other node of the version is that of the first one.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch, quoted
from .ranks import batched, ranked, runs

#: Nodes of a run, levels that a block spans, and its nodes
FAN, LEVELS = 16, 3
BLOCK = FAN ** LEVELS

_PATH = "left array<string>, right array<string>, subroot string, root string"


def digest_of(values: list[Column]) -> Column:
    """Lower-case hex SHA-256 of the values one after another: ``-`` for null, else UTF-8 length, a colon and the value."""
    def field(value: Column) -> Column:
        value = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))
    return F.sha2(F.concat(*[field(value) for value in values]), 256)


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _levels(nodes: list[str], total: int) -> list[list[str]]:
    """A block's levels from its nodes to its top; ``total`` is the number of nodes that its tree has on the lowest."""
    levels = [nodes]
    while len(levels) <= LEVELS and total > 1:
        below = levels[-1]
        levels.append([_hash("".join(below[i:i + FAN])) for i in range(0, len(below), FAN)])
        total = -(-total // FAN)
    return levels


def _siblings(levels: list[list[str]], at: int) -> Iterator[tuple[str, str]]:
    """What stands left and right of node ``at`` and of its ancestors in their runs, up to the block's top."""
    for level in levels[:-1]:
        begin = at - at % FAN
        yield "".join(level[begin:at]), "".join(level[at + 1:begin + FAN])
        at //= FAN


def _blocks(nodes: DataFrame, *columns: str) -> DataFrame:
    """The columns sorted by tree and block, each block in one partition."""
    block = F.floor(F.col("position") / BLOCK).alias("block")
    dealt = nodes.select("tree", block, "position", *columns).repartition("tree", "block")
    return dealt.sortWithinPartitions("tree", "block", "position")


def _tops(batches):
    schema = pa.schema([("tree", pa.string()), ("position", pa.int64()), ("total", pa.int64()), ("digest", pa.string())])

    def rows():
        for (tree, block), nodes in runs(batches, 2):
            total = nodes[0][1]
            yield tree, block, -(-total // BLOCK), _levels([digest for _, _, digest in nodes], total)[-1][0]

    yield from batched(rows(), schema)


def _paths(batches):
    """A block's path row comes first (position -1), then its nodes; each node gets its own path to the root."""
    schema = pa.schema([("tree", pa.string()), ("position", pa.int64()), ("left", pa.list_(pa.string())), ("right", pa.list_(pa.string())),
                        ("subroot", pa.string()), ("root", pa.string())])

    def rows():
        for (tree, _), (path, *nodes) in runs(batches, 2):
            left, right, subroot, root = path[3:]
            levels = _levels([node[2] for node in nodes], nodes[0][1])
            for at, node in enumerate(nodes):
                own = list(_siblings(levels, at))
                yield tree, node[0], [a for a, _ in own] + left, [b for _, b in own] + right, subroot, root

    yield from batched(rows(), schema)


def _versions(batches):
    schema = pa.schema([("row", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()),
                        ("proof", pa.string()), ("folded_root", pa.string()), ("copies", pa.list_(pa.string()))])

    def rows():
        for _, (path, *leaves) in runs(batches, 2):
            above, (subroot, root) = list(zip(path[3], path[4])), path[5:7]
            upper = "".join(a + b for a, b in above)
            levels = _levels([leaf[2] for leaf in leaves], leaves[0][1])
            for at, (_, _, leaf, _, _, _, _, row, changed) in enumerate(leaves):
                own = list(_siblings(levels, at))
                copies = [changed or leaf]
                for a, b in own + above:
                    copies.append(_hash(a + copies[-1] + b))
                yield (row, leaf, subroot, root, _hash("".join(a + b for a, b in own) + upper), copies[-1],
                       copies if changed else None)

    yield from batched(rows(), schema)


def _climb(scratch: Scratch, nodes: DataFrame) -> list[DataFrame]:
    """The nodes of each round, ``tree``, ``position``, ``total`` and ``digest``; in the last one each tree has one."""
    rounds, widest = [nodes], nodes.agg(F.max("total")).first()[0] or 0
    while widest > 1:
        tops = _blocks(rounds[-1], "total", "digest").mapInArrow(_tops, "tree string, position long, total long, digest string")
        rounds.append(scratch.keep(tops, "tops"))
        widest = -(-widest // BLOCK)
    return rounds


def _headed(nodes: DataFrame, above: DataFrame, *extra: str) -> DataFrame:
    """Blocks with their tops' paths before their nodes."""
    empty = [F.lit(None).cast(kind).alias(name) for name, kind in zip(("left", "right", "subroot", "root"), ("array<string>",) * 2 + ("string",) * 2)]
    below = nodes.select("tree", "position", F.floor(F.col("position") / BLOCK).alias("block"), F.col("total"), "digest", *empty, *extra)
    heads = above.select(
        "tree", F.lit(-1).cast("long").alias("position"), F.col("position").alias("block"), F.lit(0).cast("long").alias("total"),
        F.lit("").alias("digest"), "left", "right", "subroot", "root", *[F.lit(None).cast(nodes.schema[name].dataType).alias(name) for name in extra])
    both = below.unionByName(heads).select("tree", "block", "position", "total", "digest", "left", "right", "subroot", "root", *extra)
    return both.repartition("tree", "block").sortWithinPartitions("tree", "block", "position")


def _descend(scratch: Scratch, rounds: list[DataFrame], paths: DataFrame, stop: int) -> DataFrame:
    """Paths of the nodes of round ``stop``, from those of the last round's."""
    for nodes in reversed(rounds[stop:-1]):
        paths = scratch.keep(_headed(nodes, paths).mapInArrow(_paths, f"tree string, position long, {_PATH}"), "paths")
    return paths


def manifest(
    docs: DataFrame, id_column: str = "doc_id", source_column: str = "source",
    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), changes: dict[str, Column] | None = None,
    changed: Column | None = None,
) -> DataFrame:
    """Per row: ``id``, ``source``, ``leaf``, ``subroot``, ``root``, ``proof``, ``folded_root``, ``verified`` and ``copies``.

    ``leaf`` is :func:`digest_of` the fields. Within a source leaves ascend by id (null first, then equal ids by leaf); sources by
    their bytes, null first. ``proof`` is the digest of all siblings from leaf to root. Rows where ``changed`` is true get a version
    with the ``changes`` of fields: ``folded_root`` is its root, ``copies`` its copied nodes and ``verified`` whether the root is
    the first version's; other rows fold their own leaf and have null ``copies``. Null and empty values of all fields have
    digests of their own; repeated rows are leaves side by side; columns of other names are not read; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "merkle")
    changes = changes or {}
    amended = digest_of([changes.get(name, quoted(name)) for name in fields])
    leaves = scratch.keep(docs.select(
        quoted(id_column).alias("id"), quoted(source_column).cast("string").alias("tree"), F.monotonically_increasing_id().alias("row"),
        digest_of([quoted(name) for name in fields]).alias("digest"),
        F.when(F.lit(False) if changed is None else changed, amended).alias("changed")), "leaves")
    placed = scratch.keep(ranked(scratch, leaves, "tree", [F.col("id").asc_nulls_first(), "digest", "row"]), "placed")
    rounds = _climb(scratch, placed.select("tree", "position", "total", "digest"))
    # One node a source is left; the sources are the leaves of the tree above them
    roots = rounds[-1].select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest")
    roots = scratch.keep(ranked(scratch, roots, "tree", [F.col("source").asc_nulls_first()]), "roots")
    above = _climb(scratch, roots.select("tree", "position", "total", "digest"))
    none = F.array().cast("array<string>")
    top = above[-1].select("tree", "position", none.alias("left"), none.alias("right"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    listed = _descend(scratch, above, top, 0).drop("tree", "subroot").withColumnRenamed("position", "__at")
    paths = roots.join(listed, F.col("position") == F.col("__at")).select(
        F.col("source").alias("tree"), F.lit(0).cast("long").alias("position"), "left", "right", F.col("digest").alias("subroot"), "root")
    # A tree of one leaf has no round of its own: its path still reaches it as a block's
    if len(rounds) > 1:
        paths = _descend(scratch, rounds, paths, 1)
    headed = _headed(placed, paths, "row", "changed")
    versions = scratch.keep(headed.mapInArrow(
        _versions, "row long, leaf string, subroot string, root string, proof string, folded_root string, copies array<string>"), "versions")
    named = leaves.select("id", F.col("tree").alias("source"), F.col("row").alias("__row"))
    return versions.join(named, F.col("row") == F.col("__row")).select(
        "id", "source", "leaf", "subroot", "root", "proof", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), "copies")

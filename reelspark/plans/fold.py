"""Order-dependent decisions: a step function applied to each key's rows in order.

Only rules whose next decision depends on their own earlier decisions are folded, over narrow rows. Rows are partitioned
by key, sorted, and stream through the step function in Arrow batches, so no key's rows are held in memory. Hot keys are cut into
chunks that run in parallel: every chunk is folded from a guessed entry state, and re-folded while the state its
predecessor ends in differs from the state it started from. The first chunk is right at once and each round settles
at least one more, so the result is exactly the sequential one; rules that forget their past settle in two rounds. The chunks' states
are written tables, joined by key and chunk like any other.
"""
from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import work_dir
from .skew import CHUNK, find_chunks, same_key

#: Chunks' last states that a task holds before it hands them on
ENDED_STATES = 100


class Fold:
    """A step function with its state, which must survive JSON."""

    #: Input columns the step reads, besides key and order.
    inputs: list[str] = []
    #: Output columns as a DDL schema.
    schema: str = ""

    def initial(self) -> Any:
        raise NotImplementedError

    def step(self, state: Any, row: tuple) -> tuple[Any, tuple]:
        """Take one row, ordered as ``inputs``; return the next state and the output values."""
        raise NotImplementedError


def parse_schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def fold_rows(rule: Fold, state: Any, columns: list[list]) -> tuple[Any, list[tuple]]:
    """Run a rule over rows of one key given as columns."""
    out = []
    for row in zip(*columns):
        state, produced = rule.step(state, row)
        out.append(produced)
    return state, out


def run_sorted(
    batches: Iterator[pa.RecordBatch], rule: Fold, key: list[str], carried: list[str], schema: pa.Schema,
    finished: Callable[[tuple, Any], None] | None = None, enter: Callable[[str], Any] = json.loads,
) -> Iterator[pa.RecordBatch]:
    """Fold a partition whose rows lie in key and order; a key may span batches and a batch many keys.

    Yields the carried columns beside the rule's outputs; ``finished`` is told each key's last state. A column
    ``__entry`` holds the state a key starts from, in JSON or whatever ``enter`` reads.
    """
    current, state = None, None
    produced = schema.names[len(carried):]
    for batch in batches:
        inputs = [batch.column(name).to_pylist() for name in rule.inputs]
        keys = list(zip(*[batch.column(name).to_pylist() for name in key]))
        entries = batch.column("__entry").to_pylist() if "__entry" in batch.schema.names else None
        out = []
        for n, row in enumerate(zip(*inputs)):
            if keys[n] != current:
                if current is not None and finished:
                    finished(current, state)
                current = keys[n]
                state = enter(entries[n]) if entries and entries[n] else rule.initial()
            state, values = rule.step(state, row)
            out.append(values)
        columns = zip(*out) if out else [()] * len(produced)
        yield pa.RecordBatch.from_arrays(
            [batch.column(name).cast(schema.field(name).type) for name in carried]
            + [pa.array(list(values), schema.field(name).type) for name, values in zip(produced, columns)], schema=schema)
    if current is not None and finished:
        finished(current, state)


def fold(df: DataFrame, key, order, rule: Fold, small_keys: bool = False) -> DataFrame:
    """Key and order columns with the rule's outputs, one row per input row.

    ``small_keys`` says that no key needs chunks, as where the caller found none for a key that this one divides further: then
    ``df`` is not run to find out.
    """
    key = [key] if isinstance(key, str) else list(key)
    order = [order] if isinstance(order, str) else list(order)
    columns = list(dict.fromkeys([*key, *order, *rule.inputs]))
    narrow = df.select(*columns)
    carried = list(dict.fromkeys([*key, *order]))
    produced = parse_schema(rule.schema)
    schema = T.StructType([narrow.schema[name] for name in carried] + list(produced))
    arrow_schema = to_arrow_schema(schema)

    def laid_out_plainly() -> DataFrame:
        laid_out = narrow.repartition(*key).sortWithinPartitions(*key, *order)
        return laid_out.mapInArrow(lambda batches: run_sorted(batches, rule, key, carried, arrow_schema), schema)

    chunks = None if small_keys else find_chunks(narrow, key, order)
    if not chunks:
        return laid_out_plainly()
    spark, folder = df.sparkSession, f"{work_dir(df.sparkSession)}/fold-{uuid.uuid4().hex}"

    def keep(table: DataFrame, name: str) -> DataFrame:
        """A table of states, written where every executor reaches it; states never pass the driver."""
        table.write.parquet(f"{folder}/{name}")
        return spark.read.schema(table.schema).parquet(f"{folder}/{name}")

    hot_names, place = chunks.hot_names(), [*chunks.hot_names(), "__hot_chunk"]
    total = F.aggregate("__cuts", F.lit(0), lambda count, part: count + F.size(part))
    start = json.dumps(rule.initial())
    entries = keep(chunks.cuts.select(*hot_names, F.explode(F.sequence(F.lit(0), total)).alias("__hot_chunk"), F.lit(start).alias("__entry")), "entries")
    if entries.isEmpty():
        return laid_out_plainly()

    chunked = chunks.assign(narrow)
    hot_key = [*key, CHUNK]

    def with_entries(rows: DataFrame, table: DataFrame, how: str) -> DataFrame:
        return rows.join(table, same_key(key) & (F.col(CHUNK) == F.col("__hot_chunk")), how).drop("__hot_chunk", *hot_names)

    def laid_out(rows: DataFrame) -> DataFrame:
        return rows.repartition(*hot_key).sortWithinPartitions(*hot_key, *order)

    final_schema = T.StructType([T.StructField(f"__hot_{name}", narrow.schema[name].dataType) for name in key] + [
        T.StructField("__hot_chunk", T.IntegerType()), T.StructField("__final", T.StringType())])
    final_arrow = to_arrow_schema(final_schema)

    def finals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ended: list[tuple] = []
        for _ in run_sorted(batches, rule, hot_key, carried, arrow_schema, lambda name, state: ended.append((*name, json.dumps(state)))):
            if len(ended) >= ENDED_STATES:
                yield as_batch(ended)
                ended.clear()
        if ended:
            yield as_batch(ended)

    def as_batch(ended: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(values), field.type) for values, field in zip(zip(*ended), final_arrow)], schema=final_arrow)

    def updated(old: DataFrame, new: DataFrame) -> DataFrame:
        """``old`` with the rows of ``new`` in the place of its own."""
        names = [F.col(name).alias(f"__new_{name}") for name in place]
        return old.join(new.select(*names), same_key(place, "__new_"), "left_anti").unionByName(new)

    pending, ended, number = entries, None, 0
    while True:
        number += 1
        rows = with_entries(chunked.where("__hot"), pending, "inner")
        found = keep(laid_out(rows).mapInArrow(finals, final_schema), f"finals-{number}")
        ended = found if ended is None else keep(updated(ended, found), f"ended-{number}")
        # A chunk starts anew where the one before it ended in another state than it was started from
        before = ended.select(*[F.col(name).alias(f"__new_{name}") for name in hot_names], (F.col("__hot_chunk") + 1).alias("__new___hot_chunk"), "__final")
        pending = keep(entries.join(before, same_key(place, "__new_")).where("__final <> __entry").select(
            *place, F.col("__final").alias("__entry")), f"pending-{number}")
        if pending.isEmpty():
            break
        entries = keep(updated(entries, pending), f"entries-{number}")
    rows = with_entries(chunked, entries, "left")
    return laid_out(rows).mapInArrow(lambda batches: run_sorted(batches, rule, hot_key, carried, arrow_schema), schema)

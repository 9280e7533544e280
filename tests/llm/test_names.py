"""Columns named like an operator's own, and texts of very many lines."""
import time

from reelspark.llm import lines, mixing, simhash

SCHEMA = "doc_id long, text string, source string, __row long, __twin string, __id long, mix_copies string, row long"


def documents(spark):
    words = "one two three four five six seven eight"
    rows = [(i, f"{words} {i // 2}", f"s{i % 3}", 100 + i, f"t{i}", -i, f"m{i}", 7) for i in range(12)]
    return spark.createDataFrame(rows + [(None, None, None, None, None, None, None, None)], SCHEMA)


def test_operators_keep_columns_of_their_own_names(spark):
    docs = documents(spark)
    known = {row["doc_id"]: row for row in docs.collect()}
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert 0 < len(rows) < 13 and all(row == known[row["doc_id"]] for row in rows)
    deduped = lines.dedup_lines(docs)
    assert deduped.columns == docs.columns
    rows = deduped.collect()
    assert len(rows) == 13
    for row in rows:
        assert row.asDict() | {"text": 0} == known[row["doc_id"]].asDict() | {"text": 0}
    mixed = mixing.take_mix(docs)
    assert mixed.columns == [name for name in docs.columns if name != "mix_copies"] + ["mix_copies"]
    for row in mixed.collect():
        own = known[row["doc_id"]].asDict() | {"mix_copies": 0}
        assert row.asDict() | {"mix_copies": 0} == own and row["mix_copies"] > 0


def test_a_text_of_many_repeated_lines(spark):
    repeated = [f"line {i % 100_000} of a very long text" for i in range(200_000)]
    docs = spark.createDataFrame([(1, "\n".join(repeated)), (2, "\n".join(repeated[:50_000]) + "\nown")], "doc_id long, text string")
    began = time.perf_counter()
    rows = {row["doc_id"]: row["text"] for row in lines.dedup_lines(docs).collect()}
    assert time.perf_counter() - began < 120
    assert rows[2] == "own" and len(rows[1].split("\n")) <= 100_000

"""Compare registered queries with their SQL: python tests/oracle.py SF [name ...]"""
import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
DATA = "/root/testdata"


def connect(sf):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/sf{sf}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return repr(value + 0.0) if value == value else "nan"
    if isinstance(value, (list, tuple)):
        return [plain(item) for item in value]
    if isinstance(value, dict):
        return {name: plain(item) for name, item in value.items()}
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    if isinstance(value, bytearray):
        return bytes(value)
    return value


def compare(spark, con, name, sf, queries, oracle):
    """None when the query equals its SQL, else what differs."""
    df = queries[name](spark, f"{DATA}/sf{sf}")
    columns = sorted(df.columns)
    got = sorted((str([plain(row[c]) for c in columns]) for row in df.collect()))
    if name not in oracle:
        return None if got else "no rows"
    relation = con.sql(oracle[name])
    if sorted(relation.columns) != columns:
        return f"columns {columns} != {sorted(relation.columns)}"
    where = [relation.columns.index(c) for c in columns]
    types = {c: str(relation.types[relation.columns.index(c)]) for c in columns}
    spark_types = dict(df.dtypes)
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
             "float": "FLOAT", "timestamp": "TIMESTAMP WITH TIME ZONE", "timestamp_ntz": "TIMESTAMP"}
    odd = {c: (spark_types[c], types[c]) for c in columns if kinds.get(spark_types[c], types[c]) != types[c]}
    want = sorted(str([plain(row[i]) for i in where]) for row in relation.fetchall())
    if got != want:
        has, wants = set(got), set(want)
        left, right = [r for r in got if r not in wants][:3], [r for r in want if r not in has][:3]
        return f"{len(got)} rows against {len(want)}; {columns}\n  spark {left}\n  sql   {right}"
    return f"types {odd}" if odd else (None if got else "no rows")


def main():
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from reelspark.session import local_session
    sf, names = sys.argv[1], sys.argv[2:]
    spark, con = local_session(8, "12g"), connect(sf)
    queries, oracle = entry.queries(), entry.oracle_sql()
    for name in queries:
        if names and not any(name.startswith(prefix) for prefix in names):
            continue
        began = time.time()
        try:
            result = compare(spark, con, name, sf, queries, oracle)
        except Exception as error:
            result = f"{type(error).__name__}: {str(error)[:900]}"
        print(f"\n{'ok  ' if result is None else 'FAIL'} {name} {time.time() - began:.2f}s {'' if name in oracle else '(rows)'} {result or ''}", flush=True)


if __name__ == "__main__":
    main()

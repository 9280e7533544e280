"""The test tables as media tables, in Spark and as SQL fragments."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.numbers import half_up
from ..session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query over the test tables, with the SQL it must equal where SQL can say it."""

    def register(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return build(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        QUERIES[name] = run
        if oracle:
            ORACLE[name] = oracle
        return build

    return register


def micros(name: str):
    return F.unix_micros(F.col(name).cast("timestamp"))


def events(load) -> DataFrame:
    """``events`` as a packet or trace stream: one stream per user, ordered by event id, times in microseconds."""
    return load("events").select(
        "user_id", "event_id", micros("ts").alias("us"), "event_type", "value",
        half_up(F.col("value") * 1000).alias("dur"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


EVENTS = """ev AS (
  SELECT user_id, event_id, epoch_us(ts) AS us, event_type, value,
         CAST(floor(value * 1000 + 0.5) AS BIGINT) AS dur,
         CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k
  FROM events)"""

#: Event types as picture classes
PICTURE = "CASE WHEN event_type IN ('signup', 'purchase') THEN 'anchor' WHEN event_type = 'error' THEN 'none' ELSE 'bidirectional' END"


def packets(load) -> DataFrame:
    return events(load).withColumn("picture", F.expr(PICTURE))


PACKETS = EVENTS + f""", pk AS (SELECT *, {PICTURE} AS picture FROM ev)"""


def lines(load) -> DataFrame:
    """``lineitem`` as the packets of a file per order."""
    return load("lineitem").select(
        "l_orderkey", half_up(F.col("l_extendedprice") * 100).alias("us"),
        half_up(F.col("l_quantity") * 1000).alias("dur"))


LINES = """li AS (
  SELECT l_orderkey, CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS us,
         CAST(floor(l_quantity * 1000 + 0.5) AS BIGINT) AS dur FROM lineitem)"""

CONTAINER = """CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'ts' WHEN '2' THEN 'avi' WHEN '3' THEN 'mpeg'
  WHEN '4' THEN 'mkv' ELSE 'mp4' END"""


def files(load) -> DataFrame:
    """``orders`` as media files."""
    return load("orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.expr(CONTAINER).alias("container"),
        half_up(F.col("o_totalprice") * 100).alias("size_bytes"),
        F.when(F.col("o_orderstatus") != "P", half_up(F.col("o_totalprice") * 50)).alias("duration_us"))


FILES = f"""fl AS (
  SELECT o_orderkey AS l_orderkey, {CONTAINER} AS container,
         CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS size_bytes,
         CASE WHEN o_orderstatus <> 'P' THEN CAST(floor(o_totalprice * 50 + 0.5) AS BIGINT) END AS duration_us
  FROM orders)"""

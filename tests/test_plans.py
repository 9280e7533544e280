"""Scans, as-of joins, interval joins and folds give the same result whether or not hot keys are split."""
import random
import time

from pyspark.sql import functions as F

from reelspark.plans import (
    Fold, Framed, Lag, LastKnown, Lead, NextKnown, RowNumber, RunningMax, RunningMin, RunningSum, Timeline,
    asof_join, find_chunks, fold, interval_join,
)


def rows(seed, n=1500):
    random.seed(seed)
    out = []
    for i in range(n):
        key = random.choice([1, 1, 1, 2, None])
        out.append((key, random.randint(0, 4000), i, random.choice([None, random.randint(-50, 50)])))
    return out


class Wander(Fold):
    inputs = ["v"]
    schema = "seen bigint, total double"

    def initial(self):
        return [0, 0.0]

    def step(self, state, row):
        value = row[0]
        if value is not None and value > 45:
            state = self.initial()
        count, total = state[0] + 1, state[1] * 0.5 + (value or 0)
        return [count, total], (count, total)


def scans_of():
    return dict(
        before=Lag("v", F.lit(-999)), after=Lead("v"), total=RunningSum("v"), n=RowNumber(), top=RunningMax("v"),
        low=RunningMin("v"), last=LastKnown("v"), last_x=LastKnown("v", inclusive=False),
        nxt=NextKnown("v"), nxt_x=NextKnown("v", inclusive=False),
        span=Framed(lambda w: F.sum("v").over(w.rowsBetween(-3, 5)), 3, 5),
        far=Framed(lambda w: F.lead("i", 7).over(w), 0, 7),
    )


def evaluate(spark, data):
    df = spark.createDataFrame(data, "k long, t long, i long, v long")
    scans = Timeline(df, "k", ["t", "i"]).scan(**scans_of()).df
    left, right = df.where("i % 2 = 0"), df.where("i % 2 = 1").select("k", F.col("t").alias("rt"), F.col("i").alias("ri"))
    back = asof_join(left, right, "k", "t", "rt", tie="ri")
    ahead = asof_join(left, right, "k", "t", "rt", direction="forward", tie="ri")
    folded = fold(df, "k", ["t", "i"], Wander())
    return [sorted(map(str, part.collect())) for part in (scans, back, ahead, folded)]


def test_hot_keys_do_not_change_results(spark, request):
    data = rows(1)
    plain = evaluate(spark, data)
    request.getfixturevalue("split_hot_keys")
    df = spark.createDataFrame(data, "k long, t long, i long, v long")
    chunks = find_chunks(df, ["k"], "t")
    cuts = {row[0]: sum(map(len, row[1])) for row in chunks.cuts.collect()}
    assert cuts[1] >= 2
    assert evaluate(spark, data) == plain


def test_scans_match_plain_python(spark):
    data = [row for row in rows(2, 300) if row[0] == 1]
    df = spark.createDataFrame(data, "k long, t long, i long, v long")
    got = {row["i"]: row for row in Timeline(df, "k", ["t", "i"]).scan(**scans_of()).df.collect()}
    ordered = sorted(data, key=lambda row: (row[1], row[2]))
    values = [row[3] for row in ordered]
    for n, row in enumerate(ordered):
        known = [value for value in values[:n + 1] if value is not None]
        later = [value for value in values[n + 1:] if value is not None]
        actual = got[row[2]]
        assert actual["before"] == (values[n - 1] if n else -999)
        assert actual["after"] == (values[n + 1] if n + 1 < len(values) else None)
        assert actual["total"] == sum(known) and actual["n"] == n + 1
        assert actual["last"] == (known[-1] if known else None)
        assert actual["nxt_x"] == (later[0] if later else None)
        assert actual["top"] == (max(known) if known else None)


def test_asof_matches_brute_force(spark):
    data = rows(3, 400)
    df = spark.createDataFrame(data, "k long, t long, i long, v long")
    left, right = df.where("i % 2 = 0"), df.where("i % 2 = 1").select("k", F.col("t").alias("rt"), F.col("i").alias("ri"))
    got = {row["i"]: row["ri"] for row in asof_join(left, right, "k", "t", "rt", tie="ri", tolerance=100).collect()}
    for k, t, i, _ in data:
        if i % 2 == 0:
            found = [(rt, ri) for rk, rt, ri, _ in data if ri % 2 == 1 and rk == k and rt <= t]
            best = max(found) if found else None
            assert got[i] == (best[1] if best and t - best[0] <= 100 else None)


def test_interval_join_matches_brute_force(spark):
    random.seed(4)
    spans = [(random.choice([1, 2]), i, s, s + random.randint(0, 90)) for i, s in
             ((i, random.randint(-200, 500)) for i in range(120))]
    df = spark.createDataFrame(spans, "k long, i long, s long, e long")
    left = df.where("i % 2 = 0").select("k", "i", "s", "e")
    right = df.where("i % 2 = 1").select("k", F.col("i").alias("j"), F.col("s").alias("rs"), F.col("e").alias("re"))
    got = sorted((row["i"], row["j"]) for row in interval_join(left, right, "k", ("s", "e"), ("rs", "re"), 25).collect())
    want = sorted((a[1], b[1]) for a in spans for b in spans if a[1] % 2 == 0 and b[1] % 2 == 1 and a[0] == b[0]
                  and a[2] < b[3] and b[2] < a[3] and a[2] < a[3] and b[2] < b[3])
    assert got == want and want


def test_interval_join_of_long_spans(spark):
    # A span of billions of buckets makes one or two rows a level
    left = spark.createDataFrame([(None, 0, 0, 10**12), (1, 1, 5, 10**9), (1, 2, -40, -3), (1, 3, 7, 7)], "k long, i long, s long, e long")
    right = spark.createDataFrame([(None, 9, 3, 4), (1, 10, 10**8, 10**8 + 30), (1, 11, -10**11, 6), (2, 12, 0, 9)], "k long, j long, rs long, re long")
    got = sorted((row["i"], row["j"]) for row in interval_join(left, right, "k", ("s", "e"), ("rs", "re"), 25).collect())
    assert got == [(0, 9), (1, 10), (1, 11), (2, 11)]


def test_ties_and_frames_over_many_chunks(spark):
    df = spark.range(3000).selectExpr("id % 2 AS k", "7 AS t", "pmod(hash(id), 100000) AS i", "id AS v")
    scan = lambda: sorted(map(str, Timeline(df, "k", ["t", "i", "v"]).scan(
        wide=Framed(lambda w: F.sum("v").over(w.rowsBetween(-150, 90)), 150, 90), total=RunningSum("v"), nxt=Lead("v")).df.collect()))
    whole = scan()
    exploded = df.withColumn("v", F.explode(F.sequence(F.lit(1), F.lit(20))))
    counted = lambda: Timeline(exploded, "k", ["t", "i", "v"]).scan(n=RowNumber()).df.groupBy("k").agg(F.max("n"), F.sum("n")).collect()
    before = sorted(map(str, counted()))
    spark.conf.set("spark.reelspark.hotKeyRows", "40")
    try:
        assert scan() == whole
        assert sorted(map(str, counted())) == before
    finally:
        spark.conf.unset("spark.reelspark.hotKeyRows")


def test_a_table_is_counted_once(spark):
    spark.sparkContext.setJobGroup("planning", "")
    df = spark.range(1000).selectExpr("id % 3 AS k", "id AS t", "id AS v")
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("planning"))
    Timeline(df, "k", "t").scan(a=LastKnown("v"), b=NextKnown("v"))
    once = jobs()
    Timeline(df, "k", "t").scan(c=Framed(lambda w: F.sum("v").over(w.rowsBetween(-2, 0)), 2, 0))
    assert jobs() == once
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_forward_scans_are_linear(spark):
    df = spark.range(300_000).selectExpr("1 AS k", "id AS t", "CASE WHEN id % 100000 = 7 THEN id END AS v")

    def seconds(scan):
        began = time.perf_counter()
        Timeline(df, "k", "t").scan(found=scan).df.write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    seconds(LastKnown("v"))
    # Looking ahead row by row from each of 300,000 rows would take the better part of an hour
    assert seconds(NextKnown("v")) < 5 * seconds(LastKnown("v")) + 5

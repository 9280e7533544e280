"""Queries over tables whose sizes no group divides, against their SQL."""
import glob

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from oracle import DATA, plain
from reelspark.operators import catalog
from reelspark.operators.metadata import pair_layers
from reelspark.plans.skew import HOT_ROWS_SETTING
from reelspark.session import work_dir

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


def equal_to_sql(spark, name, folder, **tables):
    """Whether a query over the tables, written to the folder, equals its SQL; and its rows."""
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for table, df in tables.items():
        df.toPandas().to_parquet(f"{folder}/{table}.parquet", coerce_timestamps="us")
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    rows = QUERIES[name](spark, str(folder)).collect()
    relation = con.sql(ORACLE[name])
    want = sorted(str([plain(value) for value in row]) for row in relation.fetchall())
    assert sorted(str([plain(row[c]) for c in relation.columns]) for row in rows) == want
    return rows


def test_shots_of_frames_cut_short_or_lost(spark, tmp_path):
    vectors = spark.read.parquet(f"{DATA}/sf0.1/embeddings.parquet")
    frame = F.expr("vec_id div 20")
    # Frames 42 and 68 are lost, frame 51 has rows alone, and the last one ends after six of its columns
    kept = vectors.where((F.col("vec_id") < 1496) & ~frame.isin(42, 68) & ((frame != 51) | (F.col("vec_id") % 20 < 10)))
    found = {row["frame_no"]: row for row in equal_to_sql(spark, "shots", tmp_path, embeddings=kept)}
    assert found[74]["starts_shot"] and found[74]["level_change"] is None and found[73]["picture"]
    assert found[43]["level_change"] is not None and not found[51]["picture"]


def test_streamed_percentiles_are_exact(spark, tmp_path):
    # 60,000 distinct waits of one kind on one day
    events = spark.range(60_000).selectExpr(
        "id AS event_id", "timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id % 80000) AS ts", "id % 7 AS user_id", "'view' AS event_type",
        "(id * 7919 % 60000) * (id * 7919 % 60000) / 1000D AS value", "'{\"k\": 1}' AS props")
    row, = equal_to_sql(spark, "stream_event_summary", tmp_path, events=events)
    assert row["events"] == 60_000 and row["wait_p95_us"] == 56_999 ** 2


def test_media_of_one_name_share_a_list(spark, monkeypatch):
    monkeypatch.setattr(catalog, "MEDIA_PER_LIST", 3, raising=False)
    names = [f"a/{'Film' if n % 3 else 'film.cut'}.mkv" for n in range(40)] + ["a/other.mp4", "film.mkv"]
    media = spark.createDataFrame(list(enumerate(names)), "id long, path string")
    subs = [f"a/FILM.cut.{n}.srt" for n in range(12)] + ["a/film.srt", "a/films.srt", "film.en.srt", "a/film.cut.srt"]
    joined = catalog.sidecar_join(media, spark.createDataFrame([(sub,) for sub in subs], "sub string"), "id", "path", "sub")
    found = {row["id"]: row["subtitles"] for row in joined.collect()}
    assert len(found) == len(names)
    for number, name in enumerate(names):
        folder, base = name.rpartition("/")[0], name.rpartition("/")[2].rpartition(".")[0].lower()
        fits = {sub for sub in subs if sub.rpartition("/")[0] == folder and (sub.rpartition("/")[2].lower() + ".").startswith(base + ".")}
        assert len(found[number]) == len(fits) and set(found[number]) == fits
    assert found[0].index("a/FILM.cut.9.srt") < found[0].index("a/FILM.cut.10.srt")
    # Pairs of media and subtitles are never collected
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    collects = [line for line in plan.splitlines() if "collect_set" in line]
    assert collects and all(line.split("Aggregate [", 1)[1].startswith("__folder") for line in collects)


def test_small_keys_are_paired_without_chunks(spark):
    # Every key has 80 rows, some of which are cut points
    frames = spark.range(2000).selectExpr("id div 40 AS k", "id % 40 AS seq", "id % 40 * 41 AS ts")
    late = frames.selectExpr("k", "seq", "ts + seq % 7 * 9 AS ts")

    def pairs():
        paired = pair_layers(frames, late, "k", "seq", "ts", "seq", "ts", tolerance=50)
        return sorted(map(str, paired.collect()))

    def states():
        return glob.glob(f"{work_dir(spark).removeprefix('file:')}/fold-*")

    whole, before = pairs(), states()
    spark.conf.set(HOT_ROWS_SETTING, "100")
    try:
        assert pairs() == whole and states() == before
        # Keys with more rows than the setting still are
        spark.conf.set(HOT_ROWS_SETTING, "30")
        assert pairs() == whole and len(states()) == len(before) + 1
    finally:
        spark.conf.unset(HOT_ROWS_SETTING)

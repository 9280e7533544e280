"""Streaming forms give their batch results on shuffled, late and repeated input over several micro-batches."""
import datetime as dt
import random

from pyspark.sql import functions as F

from reelspark.operators.audio import ReconcileFold
from reelspark.operators.telemetry import event_summary
from reelspark.operators.timing import FrameIntervalFold
from reelspark.operators.verdicts import upsert_verdicts
from reelspark.plans import fold
from reelspark.session import work_dir
from reelspark.streaming.verdicts import SCHEMA, merge_verdicts
from reelspark.streaming import (
    closable, fold_stream, late_counts, mark, pair_layers_stream, read_snapshot, stream_event_summary, upsert_verdict_stream,
)

START = dt.datetime(2024, 1, 1)


def write_batches(spark, rows, schema, folder, parts=4):
    """One file per micro-batch, read in order of name."""
    size = -(-len(rows) // parts)
    for n in range(parts):
        spark.createDataFrame(rows[n * size:(n + 1) * size], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def drain(spark, result, folder, name="out"):
    query = (result.writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/c-{name}")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{folder}/{name}")


def shuffled(rows, reach=20):
    """Rows out of order, none by more than ``reach`` places."""
    random.seed(3)
    return [row for _, row in sorted(((n + random.uniform(0, reach), row) for n, row in enumerate(rows)), key=lambda item: item[0])]


def closing(rows, make):
    """Rows far ahead that let the watermark pass everything else."""
    return rows + [make(START + dt.timedelta(days=30))]


def test_folds(spark, tmp_path):
    rows = [(n % 3, n, START + dt.timedelta(milliseconds=100 * n), (n // 3) * 41_708 + (n % 7) * 400, 1024, 48_000) for n in range(600)]
    schema = "k int, n long, at timestamp, us long, frames int, rate int"
    batch = spark.createDataFrame(rows, schema)
    stream = write_batches(spark, closing(shuffled(rows), lambda at: (9, 0, at, 0, 1, 48_000)), schema, str(tmp_path))
    for name, rule in [("t1", FrameIntervalFold("us", "frames")), ("a1", ReconcileFold("us", "frames", "rate", 1000, 2_000_000))]:
        got = drain(spark, fold_stream(stream, "k", "at", ["n"], rule, "5 seconds"), str(tmp_path), name).where("k < 9")
        want = fold(batch, "k", "n", rule)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_event_summary(spark, tmp_path):
    rows = [(f"e{n}", n % 2, START + dt.timedelta(seconds=n), n % 50) for n in range(900)]
    schema = "id string, kind int, at timestamp, wait long"
    arriving = shuffled(rows + rows[100:160])
    stream = write_batches(spark, closing(arriving, lambda at: ("last", 7, at, 0)), schema, str(tmp_path))
    got = drain(spark, stream_event_summary(stream, ["kind"], "at", "id", "wait", "10 minutes", "1 minute"), str(tmp_path)).where("kind < 7")
    batch = spark.createDataFrame(rows, schema).withColumn("us", F.unix_micros("at"))
    want = event_summary(batch, ["kind"], "us", "wait", 60_000_000).select(got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_late_events_are_counted(spark, tmp_path):
    rows = [(n % 2, START + dt.timedelta(seconds=n), START + dt.timedelta(seconds=n + (400 if n % 10 == 0 else 1))) for n in range(200)]
    schema = "kind int, at timestamp, arrival timestamp"
    stream = write_batches(spark, closing(sorted(rows, key=lambda r: r[2]), lambda at: (7, at, at)), schema, str(tmp_path))
    got = drain(spark, late_counts(stream, ["kind"], "at", "arrival", 60_000_000, "1 hour"), str(tmp_path)).where("kind < 7")
    assert got.agg(F.sum("arrived"), F.sum("late")).collect()[0][:] == (200, 20)


def test_layer_pairs(spark, tmp_path):
    base = [(n % 2, n, START + dt.timedelta(milliseconds=40 * n)) for n in range(200)]
    enh = [(k, n + 1000, at + dt.timedelta(microseconds=(n % 4) - 1)) for k, n, at in base if n % 5]
    left = write_batches(spark, closing(base, lambda at: (9, 0, at)), "k int, n long, b_at timestamp", f"{tmp_path}/b")
    right = write_batches(spark, closing(enh, lambda at: (9, 0, at)), "k int, m long, e_at timestamp", f"{tmp_path}/e")
    got = drain(spark, pair_layers_stream(left, right, ["k"], "b_at", "e_at", "2 seconds"), str(tmp_path)).where("k < 9")
    want = {n: n + 1000 if n % 5 and (n % 4) - 1 <= 1 else None for _, n, _ in base}
    assert {row["n"]: row["m"] for row in got.collect()} == want


def test_verdict_snapshots(spark, tmp_path):
    random.seed(6)
    status = ["supported", "unsupported", "unknown"]
    rows = [(f"h{n % 5}", f"p{random.randint(0, 3)}", f"f{n // 70 if n % 5 == 0 else 0}", 1, '{"status":"%s"}' % random.choice(status), n) for n in range(300)]
    schema = "host string, probe string, fingerprint string, schema_version int, result string, written_at long"
    stream = write_batches(spark, rows, schema, str(tmp_path))
    table = f"{tmp_path}/table"
    upsert_verdict_stream(stream, table, f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    whole = spark.createDataFrame(rows, schema)
    want = upsert_verdicts(whole.where("written_at < 0"), whole)
    got = read_snapshot(spark, table)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 10


def test_a_batch_writes_the_buckets_of_its_hosts(spark, tmp_path):
    def rows(hosts, at, status="supported"):
        return spark.createDataFrame([(host, "p", "f", 1, '{"status":"%s"}' % status, at) for host in hosts], SCHEMA)

    table = f"{tmp_path}/table"
    hosts = [f"h{n}" for n in range(200)]
    for number in range(6):
        merge_verdicts(rows(hosts if number == 0 else ["h7"], number, "unsupported" if number else "supported"), table, number)
        found = {row["host"]: row["written_at"] for row in read_snapshot(spark, table).collect()}
        assert found == {host: number if host == "h7" else 0 for host in hosts}
        if number:
            assert len(list((tmp_path / "table/data" / f"version={number}").glob("bucket=*"))) == 1
    # The manifests and files of the last version and the one before it
    assert sorted(path.name for path in (tmp_path / "table/manifests").glob("*.json")) == ["4.json", "5.json"]
    assert sorted(path.name for path in (tmp_path / "table/data").glob("version=*")) == ["version=0", "version=4", "version=5"]
    merge_verdicts(rows(["h7"], 5, "unsupported"), table, 5)
    assert read_snapshot(spark, table).count() == 200


def test_idle_keys_leave_no_state(spark, tmp_path):
    rows = [(n % 3, n, START + dt.timedelta(milliseconds=100 * n), n * 41_708, 1024) for n in range(60)]
    schema = "k int, n long, at timestamp, us long, frames int"
    rows += [(9, 0, START + dt.timedelta(hours=2), 0, 1)]
    stream = write_batches(spark, rows, schema, str(tmp_path), parts=2)
    folded = fold_stream(closable(stream, "at", f"{tmp_path}/markers"), "k", "at", ["n"], FrameIntervalFold("us", "frames"), "5 seconds", 60_000)
    held = []
    for _ in range(2):
        query = (folded.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c")
                 .trigger(availableNow=True).start())
        query.awaitTermination()
        held.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
        mark(spark, f"{tmp_path}/markers", "at")
    assert spark.read.parquet(f"{tmp_path}/out").count() == len(rows) and held[0] > 0 and held[1] == 0


def test_a_marker_ends_a_stream(spark, tmp_path):
    rows = [(f"e{n}", n % 2, START + dt.timedelta(seconds=n), n % 50) for n in range(900)]
    stream = write_batches(spark, rows, "id string, kind int, at timestamp, wait long", str(tmp_path))
    summary = stream_event_summary(closable(stream, "at", f"{tmp_path}/markers"), ["kind"], "at", "id", "wait", "10 minutes", "1 minute")
    early = drain(spark, summary, str(tmp_path)).agg(F.sum("events")).first()[0]
    mark(spark, f"{tmp_path}/markers", "at")
    whole = drain(spark, summary, str(tmp_path)).agg(F.sum("events")).first()[0]
    assert (early or 0) < whole == len(rows)


def test_work_dir_is_the_sessions_own(spark):
    assert work_dir(spark) == work_dir(spark)

"""V3. Verdict updates from a stream into a snapshot table.

The table lies in buckets of hosts. A batch reads and writes the buckets of its own hosts only, next to the old ones; a manifest
then names the version of every bucket, and what neither it nor the one before it names is removed. So a batch costs what its
hosts' buckets hold, and neither files nor listings grow with the number of batches.
"""
from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.verdicts import VERDICT, upsert_verdicts

SCHEMA = "host string, probe string, fingerprint string, schema_version int, result string, written_at bigint"
#: Buckets of a table; a manifest has as many entries
BUCKETS = 64


def _bucket(host: str) -> Column:
    return F.pmod(F.xxhash64(host), F.lit(BUCKETS)).cast("int")


class _Folder:
    """Small files and folders of the table on whatever file system it lies."""

    def __init__(self, spark: SparkSession, root: str):
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.io = spark._jvm.org.apache.commons.io.IOUtils
        self.root = root
        self.files = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.hadoop.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, name: str) -> list[str]:
        return [status.getPath().getName() for status in self.files.listStatus(self.path(name))] if self.files.exists(self.path(name)) else []

    def read(self, name: str) -> str:
        stream = self.files.open(self.path(name))
        try:
            return self.io.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """A reader sees the whole file or none."""
        stream = self.files.create(self.path(f"{name}.part"), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self.files.delete(self.path(name), False)
        self.files.rename(self.path(f"{name}.part"), self.path(name))

    def remove(self, name: str) -> None:
        self.files.delete(self.path(name), True)


def _manifests(folder: _Folder) -> list[int]:
    names = [name for name in folder.names("manifests") if name.endswith(".json")]
    return sorted(int(name.removesuffix(".json")) for name in names)


def _manifest(folder: _Folder, number: int | None) -> dict[str, int]:
    """The version of each bucket that has rows."""
    return json.loads(folder.read(f"manifests/{number}.json")) if number is not None else {}


def _read(spark: SparkSession, table: str, buckets: dict[str, int]) -> DataFrame:
    paths = [f"{table}/data/version={version}/bucket={bucket}" for bucket, version in buckets.items()]
    return spark.read.schema(SCHEMA).parquet(*paths) if paths else spark.createDataFrame([], SCHEMA)


def read_snapshot(spark: SparkSession, table: str, before: int | None = None) -> DataFrame:
    """The latest verdict table, or the latest before a version."""
    folder = _Folder(spark, table)
    numbers = [number for number in _manifests(folder) if before is None or number < before]
    return _read(spark, table, _manifest(folder, numbers[-1] if numbers else None))


def merge_verdicts(updates: DataFrame, table: str, number: int) -> None:
    """Merge updates into the table as version ``number``. A version that is written again, after a failure, comes out the same."""
    spark = updates.sparkSession
    folder = _Folder(spark, table)
    earlier = [found for found in _manifests(folder) if found < number]
    base = _manifest(folder, earlier[-1] if earlier else None)
    updates = updates.select(*VERDICT)
    touched = [str(row[0]) for row in updates.select(_bucket("host")).distinct().collect()]
    current = _read(spark, table, {bucket: base[bucket] for bucket in touched if bucket in base})
    merged = upsert_verdicts(current, updates).withColumn("bucket", _bucket("host"))
    merged.repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{table}/data/version={number}")
    written = {name.removeprefix("bucket=") for name in folder.names(f"data/version={number}") if name.startswith("bucket=")}
    manifest = {bucket: version for bucket, version in base.items() if bucket not in touched} | {bucket: number for bucket in written}
    folder.write(f"manifests/{number}.json", json.dumps(manifest, sort_keys=True))
    # Readers of the manifest before still find their files
    for old in earlier[:-1]:
        folder.remove(f"manifests/{old}.json")
    used = set(base.values()) | set(manifest.values())
    for name in folder.names("data"):
        version = int(name.removeprefix("version="))
        if version < number and version not in used:
            folder.remove(f"data/{name}")
    for version in used - {number}:
        for name in folder.names(f"data/version={version}"):
            if name.startswith("bucket=") and version not in (base.get(name.removeprefix("bucket=")), manifest.get(name.removeprefix("bucket="))):
                folder.remove(f"data/version={version}/{name}")


def upsert_verdict_stream(updates: DataFrame, table: str, checkpoint: str) -> DataStreamWriter:
    """A writer that merges each micro-batch into the snapshot under ``table``, see :func:`merge_verdicts`."""
    return updates.writeStream.foreachBatch(lambda batch, number: merge_verdicts(batch, table, number)).option("checkpointLocation", checkpoint)

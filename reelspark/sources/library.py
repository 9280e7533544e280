"""S1. Listing of a media library."""
from __future__ import annotations

import re
from collections import deque

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.tables import KNOWN_CONTAINERS, SUBTITLE_EXTENSIONS
from ..operators.catalog import extension, name_of


def classify_library(listing: DataFrame, path: str, size: str) -> DataFrame:
    """Media and subtitle files of a listing of relative paths, as (path, size_bytes, kind).

    Everything at or below a name that starts with a dot is hidden; a file is kept by its lower-case extension.
    """
    ending = extension(name_of(path))
    kind = F.when(ending.isin(KNOWN_CONTAINERS), "media").when(ending.isin(SUBTITLE_EXTENSIONS), "subtitle")
    return (
        listing.where(~F.col(path).rlike(r"(^|/)\."))
        .select(F.col(path).alias("path"), F.col(size).alias("size_bytes"), kind.alias("kind")).where(F.col("kind").isNotNull()))


class _Folders(InputPartition):
    """Folders of one task, each with whether everything below it belongs to the task too."""

    def __init__(self, folders: list[tuple[str, bool]]):
        self.folders = folders


class _LibraryReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.tasks = options["path"], int(options["tasks"])

    def _open(self) -> tuple[fs.FileSystem, str]:
        local = re.fullmatch(r"(?:file:)?/+(.*)", self.root)
        system, root = (fs.LocalFileSystem(), "/" + local[1]) if local else fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", self.root))
        return system, root.rstrip("/")

    def _list(self, system: fs.FileSystem, root: str, folder: str):
        """Names in a folder that do not start with a dot, as (path below the root, its facts)."""
        for entry in system.get_file_info(fs.FileSelector(f"{root}/{folder}".rstrip("/") or "/")):
            if not entry.base_name.startswith("."):
                yield f"{folder}/{entry.base_name}".lstrip("/"), entry

    def partitions(self) -> list[_Folders]:
        system, root = self._open()
        opened, waiting = [], deque([""])
        while waiting and len(waiting) < self.tasks:
            folder = waiting.popleft()
            opened.append((folder, False))
            waiting.extend(path for path, entry in self._list(system, root, folder) if entry.type == fs.FileType.Directory)
        folders = opened + [(folder, True) for folder in waiting]
        return [_Folders(folders[first::self.tasks]) for first in range(min(self.tasks, len(folders)))]

    def read(self, partition: _Folders):
        system, root = self._open()
        waiting = list(partition.folders)
        while waiting:
            folder, whole = waiting.pop()
            for path, entry in self._list(system, root, folder):
                if entry.type == fs.FileType.File:
                    yield path, entry.size
                elif whole and entry.type == fs.FileType.Directory:
                    waiting.append((path, True))


class LibrarySource(DataSource):
    """Files below a folder as (path, size_bytes). Its partitions are folders, so that tasks do the listing."""

    @classmethod
    def name(cls) -> str:
        return "library"

    def schema(self) -> str:
        return "path string, size_bytes long"

    def reader(self, schema) -> DataSourceReader:
        return _LibraryReader(dict(self.options))


def scan_library(spark: SparkSession, root: str, tasks: int | None = None) -> DataFrame:
    """S1. Media and subtitle files below a folder. Only names and lengths are read, no content.

    ``root`` is a path or the address of a file system that Arrow knows (``hdfs:``, ``s3:``, ``gs:``), reachable from every
    task. Folders are opened breadth first until ``tasks`` of them (two for each of the session's slots) wait; those, and the
    ones already opened, are dealt to that many tasks. Names that start with an underscore are kept, names that start with a dot are hidden; an empty folder
    gives no rows and a missing one fails.
    """
    spark.dataSource.register(LibrarySource)
    tasks = tasks or 2 * spark.sparkContext.defaultParallelism
    listing = spark.read.format("library").option("tasks", tasks).load(root)
    return classify_library(listing, "path", "size_bytes")

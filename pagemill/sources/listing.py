"""Folder listings as a data source of our own: names, sizes and times, empty files too, without reading contents.

Spark's file readers leave empty files out. This one lists folders through the file system of their address: the folders
next to the root are dealt over tasks, each of which walks its own. As a stream it gives the files that were changed
since the last batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from pagemill.session import ship

SCHEMA = "path string, size bigint, modified_us bigint"
#: Folders that the driver opens at most to deal out what is below them.
SPREAD = 64


@dataclass
class Folder(InputPartition):
    path: str
    deep: bool


def opened(root: str):
    """The file system of an address, the place in it, and what stands before places in full addresses."""
    from pyarrow import fs

    if "://" not in root:
        return fs.LocalFileSystem(), root.removeprefix("file:"), "file://"
    system, place = fs.FileSystem.from_uri(root)
    return system, place, root.rstrip("/").removesuffix(place.rstrip("/"))


def entries(root: str, place: str, deep: bool) -> list:
    from pyarrow import fs

    system, _, _ = opened(root)
    return system.get_file_info(fs.FileSelector(place, recursive=deep, allow_not_found=False))


def rows(root: str, place: str, deep: bool) -> Iterator[tuple]:
    _, _, prefix = opened(root)
    for e in entries(root, place, deep):
        if e.is_file:
            yield prefix + e.path, e.size, (e.mtime_ns or 0) // 1000


class ListingReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[Folder]:
        """Folders are opened level by level until there are enough of them; an opened one gives its own files, the others all below."""
        _, place, _ = opened(self.root)
        flat, waiting = [], [place]
        while waiting and len(flat) + len(waiting) < SPREAD and len(flat) < SPREAD:
            now = waiting.pop(0)
            flat.append(Folder(now, False))
            waiting += [e.path for e in entries(self.root, now, False) if not e.is_file]
        return flat + [Folder(p, True) for p in waiting]

    def read(self, partition: Folder) -> Iterator[tuple]:
        yield from rows(self.root, partition.path, partition.deep)


class ListingStream(SimpleDataSourceStreamReader):
    """Files by the time of their last change; those of the newest instant come with the next change or not before it has passed."""

    def __init__(self, root: str):
        self.root = root

    def initialOffset(self) -> dict:
        return {"us": -1}

    def _between(self, after: int, upto: int) -> Iterator[tuple]:
        _, place, _ = opened(self.root)
        return iter([r for r in rows(self.root, place, True) if after < r[2] <= upto])

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        import time

        upto = max(start["us"], int(time.time() * 1e6) - 1_000_000)  # a second, for files that are still being written
        return self._between(start["us"], upto), {"us": upto}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return self._between(start["us"], end["us"])


class FolderListing(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folder_listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ListingReader:
        return ListingReader(self.options["path"])

    def simpleStreamReader(self, schema) -> ListingStream:
        return ListingStream(self.options["path"])


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, modified_us) of every file below a folder."""
    ship(spark)
    spark.dataSource.register(FolderListing)
    return spark.read.format("folder_listing").load(root)


def listing_stream(spark: SparkSession, root: str) -> DataFrame:
    ship(spark)
    spark.dataSource.register(FolderListing)
    return spark.readStream.format("folder_listing").load(root)

"""A Python data source for origins that Spark has no reader for: a subclass says what there is and how it is read.

``spark.dataSource.register(FolderSource)`` and ``spark.read.format("pagewright_folder").load(path)`` read a POSIX folder,
empty files included, a partition for each ``filesPerPartition`` files.
"""

from __future__ import annotations

import datetime
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


class Blobs(InputPartition):
    def __init__(self, names: list[str]):
        super().__init__(names)
        self.names = names


class BlobReader(DataSourceReader):
    """Override ``names`` and ``blob`` for another origin."""

    def __init__(self, options: dict):
        self.root = options.get("path", ".")
        self.each = int(options.get("filesPerPartition", 64))

    def names(self) -> Iterator[str]:
        for folder, _, files in sorted(os.walk(self.root)):
            for f in sorted(files):
                yield os.path.join(folder, f)

    def blob(self, name: str) -> tuple:
        s = os.stat(name)
        with open(name, "rb") as f:
            return name, datetime.datetime.fromtimestamp(s.st_mtime), s.st_size, f.read()

    def partitions(self) -> list[InputPartition]:
        names = list(self.names())
        return [Blobs(names[i : i + self.each]) for i in range(0, len(names), self.each)] or [Blobs([])]

    def read(self, partition: Blobs) -> Iterator[tuple]:
        for name in partition.names:
            yield self.blob(name)


class FolderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pagewright_folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return BlobReader(self.options)

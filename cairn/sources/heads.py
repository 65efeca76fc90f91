"""Leading bytes of many files: ``spark.read.format("file_head")``, at most 16 KiB of each.

``names`` limits it to files of these names (hidden ones too, which Spark's file sources pass over);
``bytes`` 0 reads them whole. A file that cannot be read is a row without length and head.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions import fixed
from .parquet_footer import _filesystem


class Paths(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class FileHeadSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_head"

    def schema(self) -> str:
        return "path string, length bigint, head binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return HeadReader(self.options)


class HeadReader(DataSourceReader):
    def __init__(self, options):
        self.root = options.get("path")
        self.size = int(options.get("bytes", str(fixed.HEAD_BYTES)))
        self.names = set(filter(None, options.get("names", "").split(",")))
        self.per_task = int(options.get("filesPerTask", "64"))

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, inner = _filesystem(self.root)
        prefix = self.root[: len(self.root) - len(inner)] if self.root.endswith(inner) else ""
        if store.get_file_info(inner).type == fs.FileType.File:
            paths = [prefix + inner]
        else:
            paths = sorted(prefix + f.path for f in store.get_file_info(fs.FileSelector(inner, recursive=True)) if f.type == fs.FileType.File)
        paths = [p for p in paths if not self.names or p.rsplit("/", 1)[-1] in self.names]
        return [Paths(paths[i : i + self.per_task]) for i in range(0, len(paths), self.per_task)] or [Paths([])]

    def read(self, partition: Paths) -> Iterator[tuple]:
        for path in partition.paths:
            store, inner = _filesystem(path)
            try:
                with store.open_input_file(inner) as f:
                    row = path, f.size(), f.read(self.size or None)
            except OSError:
                row = path, None, None
            yield row


def heads(spark: SparkSession, root: str, **options: str) -> DataFrame:
    spark.dataSource.register(FileHeadSource)
    return spark.read.format("file_head").options(**options).load(root)

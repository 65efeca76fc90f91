"""Parquet footers as a table: ``spark.read.format("parquet_footer").load(path)``.

One input partition reads the footers of a few files; no data page is touched. Row per
file, row group and leaf column. Paths may be globs or folders; a folder named
``*.parquet`` counts as one asset of several files.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = (
    "asset_id string, file string, row_group int, ordinal int, name string, dtype string, num_rows bigint, "
    "total_compressed_size bigint, codec string, has_stats boolean, footer_bytes bigint"
)


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class ParquetFooterSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "parquet_footer"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return FooterReader(self.options)


class FooterReader(DataSourceReader):
    def __init__(self, options):
        self.path = options.get("path")
        self.per_task = int(options.get("filesPerTask", "16"))
        if not self.path:
            raise ValueError("parquet_footer needs a path")

    def partitions(self) -> list[InputPartition]:
        found = list_files(self.path)
        return [Files(found[i : i + self.per_task]) for i in range(0, len(found), self.per_task)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        for asset, file in partition.files:
            yield from footer_rows(asset, file)


def _filesystem(path: str):
    """Arrow's filesystem and inner path, also for the forms that Spark's listings use (``file:/x``, ``s3a://x``)."""
    from pyarrow import fs

    path = re.sub(r"^s3[an]://", "s3://", re.sub(r"^file:/+", "/", path))
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


def list_files(path: str) -> list[tuple[str, str]]:
    """(asset, file) of every Parquet file at a file or folder, or of what a pattern (``*``, ``?``, ``[..]`` in any part) matches.

    An asset is a file, or a folder named ``*.parquet`` or matched by the pattern. Files of a folder
    count if they end in ``.parquet``; those that a pattern names count whatever their ending.
    """
    from fnmatch import fnmatchcase

    from pyarrow import fs

    parts = path.rstrip("/").split("/")
    wild = next((i for i, p in enumerate(parts) if any(c in p for c in "*?[")), len(parts))
    root = "/".join(parts[:wild]) or ("/" if path.startswith("/") else ".")
    pattern = parts[wild:]
    store, inner = _filesystem(root)
    prefix = root[: len(root) - len(inner)] if root.endswith(inner) else ""
    info = store.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [(os.path.basename(inner), prefix + inner)]
    out = []
    for f in store.get_file_info(fs.FileSelector(inner, recursive=True)):
        if f.type != fs.FileType.File:
            continue
        rel = f.path[len(inner.rstrip("/")) :].strip("/").split("/")
        if len(rel) < len(pattern) or not all(fnmatchcase(r, p) for r, p in zip(rel, pattern, strict=False)):
            continue
        named = pattern and len(rel) == len(pattern)
        if named or f.path.endswith(".parquet"):
            top = rel[len(pattern) - 1] if pattern else rel[0] if rel[0].endswith(".parquet") else os.path.basename(inner)
            out.append((top, prefix + f.path))
    return sorted(out)


def footer_rows(asset: str, file: str) -> Iterator[tuple]:
    import pyarrow.parquet as pq

    store, inner = _filesystem(file)
    with store.open_input_file(inner) as f:
        meta = pq.read_metadata(f)
    types = meta.schema.to_arrow_schema()
    for g in range(meta.num_row_groups):
        group = meta.row_group(g)
        for c in range(group.num_columns):
            col = group.column(c)
            # Leaves are matched to their top column by path, so nested columns do not shift the rest.
            top = col.path_in_schema.split(".")[0]
            kind = str(types.field(top).type) if top in types.names else col.physical_type
            yield (asset, file, g, c, col.path_in_schema, kind, group.num_rows, col.total_compressed_size, col.compression, col.statistics is not None, meta.serialized_size)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ParquetFooterSource)


def footers(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("parquet_footer").load(path)


def variables(rows: DataFrame) -> DataFrame:
    """The inventory: one row per asset and leaf column, sizes added over files and row groups."""
    out = rows.groupBy("asset_id", "name").agg(
        F.min("ordinal").cast("bigint").alias("ordinal"), F.min_by("dtype", F.struct("file", "row_group")).alias("dtype"), F.sum("num_rows").alias("n_rows"),
        F.sum("total_compressed_size").alias("size_bytes"), F.min_by("codec", F.struct("file", "row_group")).alias("codec"),
    )
    return out.select(
        "asset_id", "ordinal", "name", F.array().cast("array<string>").alias("dims"), F.array("n_rows").alias("shape"), "dtype",
        F.lit(None).cast("array<bigint>").alias("chunks"), F.create_map().cast("map<string,string>").alias("attrs"), "size_bytes", F.lower("codec").alias("codec"),
    )


def assets(rows: DataFrame) -> DataFrame:
    """One row per asset: format, and one request and the bytes of each footer."""
    from ..schema import ASSETS, conform

    out = rows.groupBy("asset_id").agg(F.countDistinct("file").alias("requests_to_open"), F.sum(F.when((F.col("row_group") == 0) & (F.col("ordinal") == 0), F.col("footer_bytes"))).alias("bytes_to_open"))
    return conform(out.withColumn("format", F.lit("parquet")).withColumn("smoke_status", F.lit("pass")), ASSETS)

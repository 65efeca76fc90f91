"""Decoded samples of Zarr stores: the stored chunk at the centre of each asset's first selected array."""

from __future__ import annotations

import gzip
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import sampling
from .counting import opened

_ARROW = pa.schema([("asset_id", pa.string()), ("name", pa.string()), ("codec", pa.string()), ("values", pa.list_(pa.float64())), ("reason", pa.string())])


def codec_names(codec: str | None) -> list[str]:
    """The names in a codec column: ``{"id": ..}`` documents, or ``name(configuration)`` joined by commas."""
    if not codec:
        return []
    return re.findall(r'"id"\s*:\s*"([^"]+)"', codec) or re.findall(r"(?:^|,)([a-z0-9_.]+)(?=\(|,|$)", codec)


def decode(raw: bytes, codec: str | None, dtype: str, chunks: list[int], idx: list[int], shape: list[int]) -> np.ndarray:
    """The values of a stored chunk inside the array. One codec of zstd, gzip, zlib or LZ4 is undone; row order is taken."""
    kind = np.dtype(dtype)
    if kind.kind not in "iufb":
        raise ValueError(f"{dtype} values are not real numbers")
    size = int(np.prod(chunks)) * kind.itemsize
    match codec_names(codec):
        case []:
            data = raw
        case ["zstd"]:
            data = pa.Codec("zstd").decompress(raw, decompressed_size=size, asbytes=True)
        case ["gzip"]:
            data = gzip.decompress(raw)
        case ["zlib"]:
            data = zlib.decompress(raw)
        case ["lz4"]:
            data = pa.Codec("lz4_raw").decompress(raw[4:], decompressed_size=size, asbytes=True)
        case names:
            raise ValueError(f"no decoder for {'+'.join(names)}")
    cells = np.frombuffer(data, kind).reshape(chunks)
    return cells[tuple(slice(0, max(0, min(c, s - i * c))) for i, c, s in zip(idx, chunks, shape, strict=True))]


def samples(variables: DataFrame, keys: DataFrame) -> DataFrame:
    """(``asset_id``, ``name``, ``codec``, ``values``, ``reason``): at most one row per asset.

    ``variables`` are the selected ones, ``keys`` a listing (``asset_id``, ``key``, ``path``, ``length``). The chunk is that
    nearest to the centre of the array of least ``ordinal``; an asset without it has no row. A chunk that cannot be
    decoded has no ``values`` but a ``reason``. One chunk is held by a task at a time.
    """
    first = variables.groupBy("asset_id").agg(F.min("ordinal").alias("ordinal"))
    one = variables.join(first, ["asset_id", "ordinal"]).select("asset_id", "ordinal", "name", "shape", "chunks", "dtype", "codec")
    met = sampling.interior_chunks(one, 1).join(sampling.listed_chunks(keys, one), ["asset_id", "name", "idx"]).join(one, ["asset_id", "name", "ordinal"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                values, reason = None, None
                try:
                    with opened(r["path"]) as file:
                        cells = decode(file.readall(), r["codec"], r["dtype"], r["chunks"], r["idx"], r["shape"])
                    values = cells.astype("f8").ravel().tolist()
                except Exception as e:  # a chunk that cannot be decoded is not sampled
                    reason = f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_pylist([{"asset_id": r["asset_id"], "name": r["name"], "codec": r["codec"], "values": values, "reason": reason}], schema=_ARROW)

    return met.select("asset_id", "name", "codec", "dtype", "chunks", "idx", "shape", "path").mapInArrow(run, "asset_id string, name string, codec string, values array<double>, reason string")


def bearing(found: DataFrame) -> DataFrame:
    """The samples that hold data, as ``benchmark`` takes them."""
    return found.filter(F.col("values").isNotNull()).filter(geometry.data_bearing(F.col("values"), None)).drop("reason")

"""Readers that need libraries which may be absent: HDF5/NetCDF-4 and COG.

Each asset gives its inventory, or one row whose ``status`` is ``skipped`` with the reason.
"""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from .counting import CountedFile, is_auth_error, opened

SCHEMA = (
    "asset_id string, status string, reason string, ordinal bigint, name string, dims array<string>, shape array<bigint>, dtype string, "
    "chunks array<bigint>, attrs map<string,string>, size_bytes bigint, codec string"
)
_ARROW = pa.schema([
    ("asset_id", pa.string()), ("status", pa.string()), ("reason", pa.string()), ("ordinal", pa.int64()), ("name", pa.string()), ("dims", pa.list_(pa.string())),
    ("shape", pa.list_(pa.int64())), ("dtype", pa.string()), ("chunks", pa.list_(pa.int64())), ("attrs", pa.map_(pa.string(), pa.string())), ("size_bytes", pa.int64()), ("codec", pa.string()),
])


def _row(asset: str, status: str, reason: str | None = None, **more) -> dict:
    return {n: None for n in _ARROW.names} | {"asset_id": asset, "status": status, "reason": reason} | more


def _failure(asset: str, error: Exception) -> dict:
    """An unreadable asset is a finding, not a failed job; one that needs a sign-in was not looked at."""
    said = f"{type(error).__name__}: {error}"
    return _row(asset, "skipped", f"auth: {said}") if is_auth_error(error) else _row(asset, "fail", said)


def _walk(h, most: int, seconds: float) -> Iterator[tuple[object, str | None]]:
    """(object, None) breadth-first, all below the groups of metadata before the rest; (number seen, cap) at the end.

    The clock is read after every 25th object; the cap is ``objects``, ``time`` or null for a whole walk.
    """
    began, seen = time.monotonic(), 0
    top = list(h.items())
    first = [item for name, item in top if name.lower() in fixed.PRIORITY_GROUPS]
    rest = [item for name, item in top if name.lower() not in fixed.PRIORITY_GROUPS]
    for waiting in (deque(first), deque(rest)):
        while waiting:
            late = seen and seen % 25 == 0 and time.monotonic() - began > seconds
            if seen == most or late:
                yield seen, "objects" if seen == most else "time"
                return
            item = waiting.popleft()
            seen += 1
            yield item, None
            if not hasattr(item, "shape"):
                waiting.extend(child for _, child in item.items())
    yield seen, "complete"


def hdf5_rows(asset: str, source, most: int = fixed.MAX_OBJECTS, seconds: float = fixed.MAX_SECONDS, facts: dict | None = None) -> Iterator[dict]:
    """The arrays of a file (a local path or an open file), and a row ``capped`` if the walk ended early.

    ``facts`` receives the file's own attributes and how far the walk came.
    """
    try:
        import h5py
    except ImportError:
        yield _row(asset, "skipped", "h5py is not installed")
        return
    facts = {} if facts is None else facts
    try:
        with h5py.File(source, "r") as h:
            if isinstance(source, CountedFile):
                if source.bytes <= 0:
                    yield _row(asset, "fail", "the file was opened without a byte read; the measurement is wrong")
                    return
                facts |= {"cairn:requests_to_open": str(source.requests), "cairn:bytes_to_open": str(source.bytes)}
            facts |= {k: decoded(v) for k, v in h.attrs.items()}
            n = 0
            for item, end in _walk(h, most, seconds):
                if end is not None:
                    facts |= {"cairn:objects_visited": str(item), "cairn:complete": str(end == "complete").lower()}
                    if end != "complete":
                        facts["cairn:capped_at"] = end
                        yield _row(asset, "capped", f"the walk ended after {item} objects ({end}); the inventory is not complete")
                elif hasattr(item, "shape"):
                    attrs = [(k, decoded(v)) for k, v in list(item.attrs.items())[: fixed.MAX_ATTRS]]
                    codec = "+".join(x for x in (item.compression, "shuffle" if item.shuffle else None) if x) or None
                    yield _row(asset, "ok", ordinal=n, name=item.name, dims=[f"dim_{i}" for i in range(item.ndim)], shape=list(item.shape), dtype=str(item.dtype), chunks=list(item.chunks) if item.chunks else None, attrs=attrs, size_bytes=int(item.size * item.dtype.itemsize), codec=codec)
                    n += 1
    except Exception as e:
        yield _failure(asset, e)


def hdf5_asset(asset: str, path: str) -> Iterator[dict]:
    """``hdf5_rows`` of a file opened through a counter, local or remote, then a row ``root`` unless it failed.

    The attributes of ``root`` are the file's own; names with ``cairn:`` in front hold what opening and the walk took.
    """
    facts: dict[str, str] = {}
    try:
        file = opened(path, fixed.MAX_BYTES)
    except Exception as e:
        yield _failure(asset, e)
        return
    with file:
        rows = list(hdf5_rows(asset, file, facts=facts))
    yield from rows
    if not any(r["status"] in ("fail", "skipped") for r in rows):
        yield _row(asset, "root", attrs=list(facts.items()))


def decoded(value) -> str:
    """The text of an attribute: bytes as UTF-8, arrays of one value as that value."""
    if isinstance(value, bytes):
        return value.decode("utf-8", "replace")
    if getattr(value, "size", 0) == 1 and hasattr(value, "item"):
        value = value.item()
        return decoded(value) if isinstance(value, bytes) else str(value)
    return str(value.tolist() if hasattr(value, "tolist") else value)


def refine_hdf5(path: str) -> tuple[str, str]:
    """(format, why): NetCDF-4 if the root has its marker or any top-level item is a dimension scale."""
    try:
        import h5py
    except ImportError:
        return "hdf5", "skipped: h5py is not installed"
    try:
        with h5py.File(path, "r") as h:
            if "_NCProperties" in h.attrs:
                return "netcdf4", "_NCProperties"
            text = lambda v: v.decode() if isinstance(v, bytes) else str(v)
            if any(text(item.attrs.get("CLASS", "")) == "DIMENSION_SCALE" for item in h.values()):
                return "netcdf4", "DIMENSION_SCALE"
            return "hdf5", "no marker of NetCDF-4"
    except Exception as e:  # the file stays what its signature says
        return "hdf5", f"failed: {type(e).__name__}: {e}"


def cog_rows(asset: str, path: str) -> Iterator[dict]:
    """The bands of a raster and a row ``root`` with its reference system, overviews of band 1 and, with ``rio_cogeo``, validity."""
    try:
        import rasterio
    except ImportError:
        yield _row(asset, "skipped", "rasterio is not installed")
        return
    try:
        with rasterio.open(path) as r:
            codec = r.profile.get("compress")
            for i, dtype in enumerate(r.dtypes):
                yield _row(asset, "ok", ordinal=i, name=f"/band_{i + 1}", dims=["dim_0", "dim_1"], shape=[r.height, r.width], dtype=str(dtype), chunks=list(r.block_shapes[i]), attrs=[], codec=str(codec) if codec else None)
            facts = [("cairn:overviews", ",".join(str(x) for x in r.overviews(1)))]
            if r.crs:
                facts.append(("cairn:crs", str(r.crs)))
        try:
            from rio_cogeo.cogeo import cog_validate

            facts.append(("cairn:cog_valid", str(bool(cog_validate(path, quiet=True)[0])).lower()))
        except Exception as e:  # without the check its result stays null
            facts.append(("cairn:cog_validate", f"skipped: {type(e).__name__}: {e}"))
        yield _row(asset, "root", attrs=facts)
    except Exception as e:
        yield _failure(asset, e)


READERS = {"hdf5": hdf5_asset, "netcdf4": hdf5_asset, "cog": cog_rows}


def open_assets(assets: DataFrame) -> DataFrame:
    """The inventory of assets (``asset_id``, ``path``, ``format``) by the reader of their format; ``n/a`` without one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                reader = READERS.get(r["format"])
                rows = list(reader(r["asset_id"], r["path"])) if reader else [_row(r["asset_id"], "n/a", f"no reader for {r['format']}")]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return assets.select("asset_id", "path", F.col("format")).mapInArrow(run, SCHEMA)


def asset_rows(rows: DataFrame) -> DataFrame:
    """One row per asset of ``open_assets``: ``smoke_status`` and the facts of its row ``root``."""
    one = rows.groupBy("asset_id").agg(
        F.when(F.bool_or(F.col("status") == "fail"), "fail").when(F.bool_or(F.col("status").isin("ok", "root")), "pass").otherwise("skipped").alias("smoke_status"),
        F.max_by("attrs", F.when(F.col("status") == "root", 1)).alias("attrs"), F.max_by("reason", F.when(F.col("status").isin("fail", "skipped", "capped"), 1)).alias("reason"),
    )
    fact = lambda name: F.try_element_at("attrs", F.lit(f"cairn:{name}"))
    overviews = F.when(fact("overviews").isNotNull(), F.transform(F.filter(F.split(fact("overviews"), ","), lambda x: x != ""), lambda x: x.cast("int")))
    return one.select(
        "asset_id", "smoke_status", "reason", F.map_filter("attrs", lambda k, _: ~k.startswith("cairn:")).alias("global_attrs"),
        fact("requests_to_open").cast("bigint").alias("requests_to_open"), fact("bytes_to_open").cast("bigint").alias("bytes_to_open"), fact("crs").alias("crs"), fact("cog_valid").cast("boolean").alias("cog_valid"),
        overviews.alias("overviews"), fact("objects_visited").cast("bigint").alias("objects_visited"), fact("complete").cast("boolean").alias("complete"), fact("capped_at").alias("capped_at"),
    )

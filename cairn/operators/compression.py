"""Judge codecs and try a grid of them on sampled chunks."""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codecs, fixed


def inspect_codecs(variables: DataFrame) -> DataFrame:
    """``status``, ``note`` and ``remediation`` for each variable's own codec."""
    codec = F.col("codec")
    return variables.select(
        "asset_id", "ordinal", "name", "codec", codecs.judge_codec(codec).alias("status"), codecs.codec_note(codec).alias("note"), codecs.codec_remedy(codec).alias("remediation")
    )


def assess_compression(variables: DataFrame, samples: DataFrame | None = None, max_abs_error: float | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(``inspect_codecs``, ``benchmark``) of the selected variables; no samples, no trials.

    With ``max_abs_error`` each sample is also tried after rounding to as few mantissa bits as stay within it.
    """
    if samples is not None and max_abs_error is not None:
        samples = samples.withColumn("keepbits", codecs.keepbits(F.col("values"), F.lit(max_abs_error)))
    return inspect_codecs(variables), benchmark(samples) if samples is not None else None


def grid() -> list[tuple[str, str, str | None, int, bool]]:
    """(config, family, cname, level, shuffle) of the ten lossless trials, in order."""
    out = []
    for level in fixed.ZSTD_LEVELS:
        out += [(f"zstd-{level}{'+shuffle' if s else ''}", "zstd", None, level, s) for s in (True, False)]
    for cname, level in fixed.BLOSC_VARIANTS:
        out += [(f"blosc-{cname}-{level}{'+shuffle' if s else ''}", "blosc", cname, level, s) for s in (True, False)]
    return out


def shuffled(raw: bytes, itemsize: int) -> bytes:
    """The bytes of equal rank in each element together."""
    whole = len(raw) // itemsize * itemsize
    return np.frombuffer(raw[:whole], np.uint8).reshape(-1, itemsize).T.tobytes() + raw[whole:]


def bit_round(values: np.ndarray, keep: int) -> np.ndarray:
    """Float32 or float64 values with all but ``keep`` mantissa bits rounded away, halves to even."""
    kind, bits = (np.uint32, 23) if values.dtype == np.float32 else (np.uint64, 52)
    if keep >= bits:
        return values
    drop = bits - keep
    raw = values.view(kind)
    half = ((raw >> kind(drop)) & kind(1)) + kind((1 << (drop - 1)) - 1)
    rounded = ((raw + half) >> kind(drop)) << kind(drop)
    return np.where(np.isfinite(values), rounded.view(values.dtype), values)


def unshuffled(raw: bytes, itemsize: int) -> bytes:
    whole = len(raw) // itemsize * itemsize
    return np.frombuffer(raw[:whole], np.uint8).reshape(itemsize, -1).T.tobytes() + raw[whole:]


def trial(raw: bytes, family: str, cname: str | None, level: int, shuffle: bool, itemsize: int) -> tuple[int, float, float]:
    """Bytes after compression, and MB a second of compression and decompression, with the codec that stands behind a configuration."""
    if family == "blosc":
        family, level = ("lz4", None) if cname == "lz4" else ("zstd", level)
    if family == "zlib":
        family = "gzip"
    codec = pa.Codec(family, compression_level=level) if family in ("zstd", "gzip") else pa.Codec("lz4_raw")
    began = time.perf_counter()
    packed = codec.compress(shuffled(raw, itemsize) if shuffle else raw, asbytes=True)
    middle = time.perf_counter()
    data = codec.decompress(packed, decompressed_size=len(raw), asbytes=True)
    if (unshuffled(data, itemsize) if shuffle else data) != raw:
        raise ValueError("the codec did not return what it was given")
    mb = len(raw) / fixed.MIB
    return len(packed), round(mb / max(middle - began, 1e-9), 1), round(mb / max(time.perf_counter() - middle, 1e-9), 1)


def benchmark(samples: DataFrame, keepbits: int | None = None, min_bytes: int = fixed.MIN_SAMPLE_BYTES) -> DataFrame:
    """(``asset_id``, ``name``, ``seq``, ``config``, ``ratio``, ``compress_mbps``, ``decompress_mbps``, ``is_current``, ``lossy``, ``max_abs_error``, ``error``).

    ``samples`` has ``asset_id``, ``name``, ``codec`` and ``values`` (a decoded float chunk).
    Row 0 repeats the current codec; samples under ``min_bytes`` give no row. Each sample
    is tried where it lies, one row at a time. A column ``keepbits`` of the samples goes before the parameter. Codecs run through Arrow, so Blosc trials
    are its inner codec after a byte shuffle, without Blosc's blocks.
    """
    current = codecs.parse_codec(F.col("codec")).alias("now")
    source = samples.select("asset_id", "name", "codec", current, F.col("values").cast("array<float>").alias("values"), (F.col("keepbits") if "keepbits" in samples.columns else F.lit(keepbits)).cast("int").alias("keepbits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for row in batch.to_pylist() for r in _trials(row, row["keepbits"], min_bytes)]
            yield pa.RecordBatch.from_pylist(rows, schema=_TRIALS)

    return source.mapInArrow(run, "asset_id string, name string, seq int, config string, ratio double, compress_mbps double, decompress_mbps double, is_current boolean, lossy boolean, max_abs_error double, error string")


_TRIALS = pa.schema([
    ("asset_id", pa.string()), ("name", pa.string()), ("seq", pa.int32()), ("config", pa.string()), ("ratio", pa.float64()), ("compress_mbps", pa.float64()), ("decompress_mbps", pa.float64()),
    ("is_current", pa.bool_()), ("lossy", pa.bool_()), ("max_abs_error", pa.float64()), ("error", pa.string()),
])


def _trials(row: dict, keepbits: int | None, min_bytes: int) -> list[dict]:
    values = np.array([np.nan if v is None else v for v in row["values"] or []], np.float32)
    raw = values.tobytes()
    if len(raw) < min_bytes:
        return []
    now, seq, out = row["now"], 0, []
    base = {"asset_id": row["asset_id"], "name": row["name"], "is_current": False, "lossy": False, "ratio": None, "compress_mbps": None, "decompress_mbps": None, "max_abs_error": None, "error": None}

    def tried(config: str, data: bytes, family: str, cname: str | None, level: int, shuffle: bool, **more) -> dict:
        try:
            size, packing, unpacking = trial(data, family, cname, level, shuffle, 4)
            return {**base, "config": config, "ratio": round(len(raw) / size, 3), "compress_mbps": packing, "decompress_mbps": unpacking, **more}
        except Exception as e:  # one codec's failure is a row of the result
            return {**base, "config": config, "error": f"{type(e).__name__}: {e}", **more}

    label = "uncompressed" if now["family"] == "uncompressed" else row["codec"]
    if now["family"] == "uncompressed":
        out.append({**base, "config": f"current ({label})", "ratio": 1.0, "is_current": True})
    elif now["family"] == "exotic":
        out.append({**base, "config": f"current ({label})", "error": "cannot be reproduced here", "is_current": True})
    else:
        out.append(tried(f"current ({label})", raw, now["family"], now["cname"], now["level"], bool(now["shuffle"]), is_current=True))
    for config, family, cname, level, shuffle in grid():
        out.append(tried(config, raw, family, cname, level, shuffle))
    if keepbits is not None:
        rounded = bit_round(values, keepbits)
        finite = np.isfinite(values)
        worst = float(np.abs(rounded[finite].astype("f8") - values[finite].astype("f8")).max(initial=0.0))
        for config, family, cname, level, shuffle in grid():
            out.append(tried(f"bitround{keepbits}+{config}", rounded.tobytes(), family, cname, level, shuffle, lossy=True, max_abs_error=worst))
    for r in out:
        r["seq"] = seq
        seq += 1
    return out

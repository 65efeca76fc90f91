"""Column expressions over codec names and sample values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def _uncompressed(codec: Column) -> Column:
    return codec.isNull() | F.lower(F.trim(codec)).isin(*fixed.UNCOMPRESSED)


def judge_codec(codec: Column) -> Column:
    """``fail`` uncompressed, ``warn`` weak or unknown, ``pass`` modern; a weak name counts before a modern one."""
    return (
        F.when(_uncompressed(codec), "fail").when(codec.rlike(f"(?i){fixed.WEAK_CODECS}"), "warn")
        .when(codec.rlike(f"(?i){fixed.MODERN_CODECS}"), "pass").otherwise("warn")
    )


def codec_note(codec: Column) -> Column:
    status = judge_codec(codec)
    return (
        F.when(status == "fail", "stored without compression").when(status == "pass", F.concat(codec, F.lit(": reads fast")))
        .when(codec.rlike(f"(?i){fixed.WEAK_CODECS}"), F.concat(codec, F.lit(": zstd or blosc do better in every respect")))
        .otherwise(F.concat(codec, F.lit(": not a codec that can be judged here")))
    )


def codec_remedy(codec: Column) -> Column:
    status = judge_codec(codec)
    return F.when(status == "fail", "turn compression on: zstd level 3 with shuffle").when(
        (status == "warn") & codec.rlike(f"(?i){fixed.WEAK_CODECS}"), "recompress with zstd and shuffle"
    )


def _number(text: Column, pattern: str) -> Column:
    return F.try_to_number(F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")), F.lit("999999")).cast("int")


def parse_codec(codec: Column) -> Column:
    """A struct (family, cname, level, shuffle) that reproduces a codec name of either grammar.

    ``gzip+shuffle`` or ``blosc-zstd-3+shuffle``, and constructor-like names such as
    ``Blosc(cname='zstd', clevel=3, shuffle=SHUFFLE)``. Family ``exotic`` cannot be reproduced.
    """
    low = F.lower(F.coalesce(codec, F.lit("")))
    shuffle = low.contains("shuffle") & ~low.contains("noshuffle")
    family = (
        F.when(_uncompressed(codec), "uncompressed").when(low.contains("blosc"), "blosc").when(low.contains("zstd"), "zstd")
        .when(low.rlike(fixed.WEAK_CODECS), "zlib").otherwise("exotic")
    )
    named = F.regexp_extract(low, r"cname=['\"]?(\w+)", 1)
    dashed = F.regexp_extract(low, "blosc-(lz4|zstd)", 1)
    cname = F.when(named != "", named).when(dashed != "", dashed).otherwise("zstd")
    after = F.when(cname == "lz4", _number(low, r"blosc-lz4-(\d+)")).when(cname == "zstd", _number(low, r"blosc-zstd-(\d+)"))
    level = (
        F.when(family == "blosc", F.coalesce(_number(low, r"clevel=(\d+)"), after, F.when(cname == "lz4", 5).otherwise(3)))
        .when(family == "zstd", F.coalesce(_number(low, r"level=(\d+)"), _number(low, r"zstd[-_(]?(\d+)"), F.lit(3)))
        .when(family == "zlib", F.coalesce(_number(low, r"level=(\d+)"), F.lit(4)))
    )
    lossless = family.isin("blosc", "zstd", "zlib")
    return F.struct(
        family.alias("family"), F.when(family == "blosc", cname).alias("cname"), level.cast("int").alias("level"), F.when(lossless, shuffle).alias("shuffle")
    )


def keepbits(values: Column, max_error: Column, dtype: str = "float32") -> Column:
    """Mantissa bits that keep the rounding error of every value within ``max_error``."""
    most = fixed.MANTISSA_BITS.get(dtype, 23)
    peak = F.array_max(F.transform(F.filter(values, lambda x: x.isNotNull() & ~F.isnan(x)), lambda x: F.abs(x.cast("double"))))
    bits = F.ceil(F.log2(peak) - F.log2(max_error.cast("double"))) - 1
    return F.when(max_error <= 0, most).when(peak.isNull() | (peak <= 0), 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(most), bits))).cast("int")

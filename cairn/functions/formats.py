"""Column expressions that classify inputs, file heads and formats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def detect_input(text: Column) -> Column:
    """``granule-id``, ``url`` (a known scheme) or ``local``."""
    scheme = F.lower(F.regexp_extract(text, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    return F.when(text.rlike(fixed.GRANULE_ID), "granule-id").when(scheme.isin(*fixed.URL_SCHEMES), "url").otherwise("local")


def path_of(text: Column) -> Column:
    """The path of an address, without query and fragment; other texts as they are."""
    rest = F.regexp_replace(text, r"^[^:]*://[^/?#]*", "")
    return F.when(text.contains("://"), F.regexp_extract(rest, r"^([^?#;]*)", 1)).otherwise(text)


def ext_hint(text: Column) -> Column:
    """The format that the longest known extension suggests; null if none does."""
    low = F.lower(path_of(text))
    longest = sorted(fixed.EXTENSIONS.items(), key=lambda x: -len(x[0]))
    return reduce(lambda case, e: case.when(F.endswith(low, F.lit(e[0])), F.lit(e[1])), longest, F.when(F.lit(False), F.lit(""))).otherwise(F.lit(None))


def _at(data: Column, magic: bytes, offset: int = 0) -> Column:
    return F.substring(data, offset + 1, len(magic)) == F.lit(magic)


def sniff_bytes(head: Column) -> Column:
    """The format of a file from its first bytes (16 KiB reach every offset that is looked at).

    The order of the tests is part of the result: signatures at the start, the HDF5
    signature behind a user block, JSON, the other signatures, tar, shapefile.
    """
    text = F.decode(head, "ISO-8859-1")
    refs = text.contains('"refs"') | (text.contains('"version"') & text.contains('"templates"'))
    case = F.when(head.isNull(), F.lit(None).cast("string"))
    for magic, fmt in fixed.MAGIC_FIRST:
        case = case.when(_at(head, magic), fmt)
    for offset in fixed.HDF5_LATER_OFFSETS:
        case = case.when(_at(head, fixed.HDF5_MAGIC, offset), "hdf5")
    case = case.when(text.rlike(r"^[{\[]") & refs, "kerchunk").when(text.rlike(r"^[{\[]"), "unknown")
    for magic, fmt in fixed.MAGIC_LATER:
        case = case.when(_at(head, magic), fmt)
    return case.when(_at(head, fixed.TAR_MAGIC, fixed.TAR_OFFSET), "tar").when(_at(head, fixed.SHAPEFILE_MAGIC), "shapefile").otherwise("unknown")


def format_class(fmt: Column) -> Column:
    return (
        F.when(fmt.isin(*fixed.CLOUD_NATIVE), "cloud-native")
        .when(fmt.isin(*fixed.CLOUD_OPTIMIZABLE), "cloud-optimizable")
        .when(fmt.isin(*fixed.CLOUD_HOSTILE), "cloud-hostile")
        .otherwise("unknown")
    )


def out_dirname(text: Column) -> Column:
    """A folder name for an input: its last part with everything but letters, digits, dot, underscore and hyphen replaced."""
    last = F.substring_index(F.regexp_replace(text, "/+$", ""), "/", -1)
    return F.concat(F.lit("cloud-readiness-"), F.regexp_replace(last, r"[^A-Za-z0-9._-]", "-"))


def supported_formats() -> list[str]:
    return sorted({*fixed.CLOUD_NATIVE, *fixed.CLOUD_OPTIMIZABLE, *fixed.CLOUD_HOSTILE})

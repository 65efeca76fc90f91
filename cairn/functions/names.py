"""Column expressions over variable names and types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def basename(name: Column) -> Column:
    return F.substring_index(name, "/", -1)


def any_of(text: Column, patterns) -> Column:
    """Whether any of the literal patterns is in ``text``."""
    return text.rlike("|".join(p.replace(".", r"\.") for p in patterns))


def token_matches(name: Column, token: Column) -> Column:
    """Equal, equal but for leading slashes, equal to the last part, or contained whatever the case."""
    bare = lambda c: F.regexp_replace(c, "^/+", "")
    return (name == token) | (bare(name) == bare(token)) | (basename(name) == token) | F.contains(F.lower(name), F.lower(token))


def string_or_bool(dtype: Column) -> Column:
    return F.coalesce(F.contains(dtype, F.lit("|S")) | F.contains(dtype, F.lit("<U")) | F.contains(F.lower(dtype), F.lit("bool")), F.lit(False))


def exclusion_reasons(name: Column, dims: Column, shape: Column, dtype: Column) -> Column:
    """Why a variable is not offered as a data variable; an empty list if nothing speaks against it."""
    low, base = F.lower(name), basename(name)
    tests = [
        ("quality", any_of(low, fixed.QA_PATTERNS)),
        ("bounds", any_of(low, fixed.BOUNDS_PATTERNS)),
        ("crs", any_of(low, fixed.CRS_PATTERNS)),
        ("own-dimension", F.coalesce(F.array_contains(dims, base), F.lit(False))),
        ("coordinate-name", F.lower(base).isin(*fixed.COMMON_COORDINATES)),
        ("string-or-bool", string_or_bool(dtype)),
        ("scalar", F.coalesce(F.size(shape), F.lit(0)) <= 0),
    ]
    return F.array_compact(F.array(*[F.when(test, reason) for reason, test in tests]))


def is_excluded(name: Column, dims: Column, shape: Column, dtype: Column) -> Column:
    return F.size(exclusion_reasons(name, dims, shape, dtype)) > 0


def is_coordinate(name: Column, dims: Column, axis: Column, axis_type: Column) -> Column:
    base = basename(name)
    return (
        F.coalesce(F.array_contains(dims, base), F.lit(False))
        | F.lower(base).isin(*fixed.COMMON_COORDINATES)
        | F.coalesce(F.lower(F.trim(axis)).isin("t", "x", "y", "z"), F.lit(False))
        | (F.coalesce(axis_type, F.lit("")) != "")
    )


def is_crs_container(name: Column) -> Column:
    return F.lower(basename(name)).isin(*fixed.CRS_CONTAINERS)


def is_bounds(name: Column) -> Column:
    return any_of(F.lower(basename(name)), fixed.BOUNDS_PATTERNS)

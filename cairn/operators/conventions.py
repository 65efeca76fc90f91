"""Conformance checks over attributes: CF for any inventory, and three more for Zarr stores.

Each check is a row (``asset_id``, ``id``, ``ok``, ``evidence``); ``ok`` is null where the check
does not apply, and SQL aggregates leave nulls out, which is the rule of the roll-up.
Attributes are text; numbers are recognised by their JSON form, and a text attribute that
must not count as a number is quoted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.names import basename, is_bounds, is_coordinate, is_crs_container
from .inventory import resolvable

CF_CHECKS = ("conventions_attr", "units_and_name", "coordinate_identification", "grid_mapping", "fill_value_consistency", "scale_offset_typing", "bounds")
INT_RANGES = {
    "int8": (-(2**7), 2**7 - 1), "uint8": (0, 2**8 - 1), "int16": (-(2**15), 2**15 - 1), "uint16": (0, 2**16 - 1),
    "int32": (-(2**31), 2**31 - 1), "uint32": (0, 2**32 - 1), "int64": (-(2**63), 2**63 - 1), "uint64": (0, 2**64 - 1),
}
NUMBER = r"^\s*-?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def attr(name: str) -> Column:
    """An attribute of the row; null if absent or empty."""
    return F.nullif(F.col("attrs")[name], F.lit(""))


def coordinate_kind(name: Column, standard: Column, axis: Column, axis_type: Column) -> Column:
    """``time``, ``latitude``, ``longitude``, ``vertical`` or ``generic``; each kind is tried with all four hints in turn."""
    base, std = F.lower(basename(name)), F.lower(F.coalesce(standard, F.lit("")))
    ax, kind = F.lower(F.trim(F.coalesce(axis, F.lit("")))), F.lower(F.trim(F.coalesce(axis_type, F.lit(""))))
    return (
        F.when((base == "time") | (std == "time") | (ax == "t") | (kind == "time"), "time")
        .when(base.isin("lat", "latitude") | (std == "latitude") | (ax == "y") | kind.isin("lat", "latitude"), "latitude")
        .when(base.isin("lon", "longitude") | (std == "longitude") | (ax == "x") | kind.isin("lon", "longitude"), "longitude")
        .when((ax == "z") | (kind != ""), "vertical").otherwise("generic")
    )


def coordinate_ok(kind: Column, units: Column, standard: Column, axis_type: Column) -> Column:
    unit, std, at = (F.lower(F.coalesce(c, F.lit(""))) for c in (units, standard, axis_type))
    degrees = unit.contains("degree")
    return (
        F.when(kind == "time", unit.rlike(r"\bsince\b"))
        .when(kind == "latitude", degrees | (std == "latitude") | F.trim(at).isin("lat", "latitude"))
        .when(kind == "longitude", degrees | (std == "longitude") | F.trim(at).isin("lon", "longitude")).otherwise(True)
    )


#: Attributes that point to other variables, and the check that each belongs to.
REFERENCES = {"coordinates": "coordinate_identification", "grid_mapping": "grid_mapping", "bounds": "bounds"}


def references(variables: DataFrame) -> DataFrame:
    """(``asset_id``, ``name``, ``id``, ``ref``, ``ok``): what attributes point to, and whether that exists in the asset.

    A reference is met by a full name or by its last part. All kinds go through the same two
    equality joins within the asset; ``coordinates`` may hold several names.
    """
    targets = resolvable(variables).select("asset_id", F.col("ref").alias("target")).distinct().withColumn("found", F.lit(True))
    listed = [F.when(attr(a).isNotNull(), F.struct(F.lit(c).alias("id"), F.split(F.trim(attr(a)), r"\s+") if a == "coordinates" else F.array(attr(a)))) for a, c in REFERENCES.items()]
    refs = variables.select("asset_id", "name", F.explode(F.array_compact(F.array(*[x.cast("struct<id:string,refs:array<string>>") for x in listed]))).alias("r"))
    refs = refs.select("asset_id", "name", "r.id", F.explode("r.refs").alias("ref")).filter("ref <> ''")
    full = refs.withColumn("target", F.col("ref")).join(targets, ["asset_id", "target"], "left").withColumnRenamed("found", "whole").drop("target")
    both = full.withColumn("target", basename(F.col("ref"))).join(targets, ["asset_id", "target"], "left")
    return both.select("asset_id", "name", "id", "ref", (F.col("whole").isNotNull() | F.col("found").isNotNull()).alias("ok"))


def own_rows(variables: DataFrame) -> DataFrame:
    """(``asset_id``, ``name``, ``id``, ``ok``): what each variable's own attributes say for each check, from one pass."""
    name = F.col("name")
    coordinate = is_coordinate(name, F.col("dims"), attr("axis"), attr("_CoordinateAxisType"))
    data = ~F.col("__c") & ~is_crs_container(name) & ~is_bounds(name)
    named = attr("units").isNotNull() & (attr("standard_name").isNotNull() | attr("long_name").isNotNull())
    kind = coordinate_kind(name, attr("standard_name"), attr("axis"), attr("_CoordinateAxisType"))
    known = coordinate_ok(F.col("__k"), attr("units"), attr("standard_name"), attr("_CoordinateAxisType"))
    row = lambda test, check, ok: F.when(test, F.struct(F.lit(check).alias("id"), ok.alias("ok")))
    rows = [
        row(data, "units_and_name", named), row(F.col("__c"), "coordinate_identification", known),
        row(F.coalesce(attr("_FillValue"), attr("missing_value")).isNotNull(), "fill_value_consistency", fill_ok()),
        *[row(attr(a).isNotNull(), "scale_offset_typing", F.coalesce(attr(a).rlike(NUMBER), F.lit(False))) for a in ("scale_factor", "add_offset")],
    ]
    marked = variables.withColumn("__c", coordinate).withColumn("__k", kind)
    return marked.select("asset_id", "name", F.explode(F.array_compact(F.array(*rows))).alias("r")).select("asset_id", "name", "r.id", "r.ok")


def fill_ok() -> Column:
    """Whether ``_FillValue`` and ``missing_value`` agree and the value is in an integer type's range."""
    fill, missing = attr("_FillValue"), attr("missing_value")
    value = lambda c: F.when(c.rlike(NUMBER), c.try_cast("double"))
    same = F.coalesce(value(fill) == value(missing), fill == missing)
    used = F.coalesce(fill, missing)
    low = F.create_map(*[F.lit(x) for k, (a, _) in INT_RANGES.items() for x in (k, float(a))])
    high = F.create_map(*[F.lit(x) for k, (_, b) in INT_RANGES.items() for x in (k, float(b))])
    inside = F.coalesce((value(used) >= F.try_element_at(low, F.col("dtype"))) & (value(used) <= F.try_element_at(high, F.col("dtype"))), F.lit(True))
    return F.when(fill.isNotNull() & missing.isNotNull() & ~same, False).otherwise(inside)


TOLD = {
    "units_and_name": "variables with units and a name", "coordinate_identification": "coordinates identified", "grid_mapping": "references met",
    "fill_value_consistency": "fill values consistent", "scale_offset_typing": "numeric factors and offsets", "bounds": "bounds met",
}


def variable_checks(variables: DataFrame) -> DataFrame:
    """(``asset_id``, ``id``, ``ok``, ``evidence``) of the six checks over variables, where they apply: one aggregation for all.

    A check holds if each of its rows does. Without any reference to a grid mapping, a
    container by name stands in for one.
    """
    held = variables.filter(is_crs_container(F.col("name"))).select("asset_id", "name", F.lit("container").alias("id"), F.lit(True).alias("ok"))
    rows = own_rows(variables).unionByName(references(variables).drop("ref")).unionByName(held)
    # A container is a row of its own until it is known whether the asset has references.
    bad = F.array_sort(F.collect_set(F.when(~F.col("ok"), F.col("name"))))
    check = F.when(F.col("id") == "container", "grid_mapping").otherwise(F.col("id"))
    true_rows = F.col("id") != "container"
    out = rows.groupBy("asset_id", check.alias("check")).agg(F.every("ok").alias("ok"), F.count_if(true_rows).alias("n"), bad.alias("bad"))
    told = F.try_element_at(F.create_map(*[F.lit(x) for kv in TOLD.items() for x in kv]), F.col("check"))
    text = F.when(~F.col("ok"), F.concat(F.lit("gaps in "), F.array_join("bad", ", "))).when(F.col("n") == 0, "a container by name, no reference").otherwise(F.concat(F.col("n").cast("string"), F.lit(" "), told))
    return out.select("asset_id", F.col("check").alias("id"), "ok", text.alias("evidence"))


def check(variables: DataFrame, cid: str) -> DataFrame:
    """One of the six checks."""
    return variable_checks(variables).filter(F.col("id") == cid)


def check_conventions(assets: DataFrame) -> DataFrame:
    held = F.coalesce(F.nullif(F.col("global_attrs")["Conventions"], F.lit("")), F.nullif(F.col("global_attrs")["conventions"], F.lit("")))
    version = F.regexp_extract(F.coalesce(held, F.lit("")), r"(?i)CF[- ]?(\d+(?:\.\d+)?)", 1)
    evidence = F.when(held.isNull(), "no Conventions attribute").when(version == "", "Conventions without CF").otherwise(F.concat(F.lit("CF "), version))
    return assets.select("asset_id", F.lit("conventions_attr").alias("id"), (version != "").alias("ok"), evidence.alias("evidence"))


def cf_checks(assets: DataFrame, variables: DataFrame) -> DataFrame:
    """All seven checks for every asset, in order (``pos``)."""
    found = check_conventions(assets).union(variable_checks(variables))
    every = assets.select("asset_id", F.posexplode(F.array(*[F.lit(c) for c in CF_CHECKS])).alias("pos", "id"))
    return every.join(found, ["asset_id", "id"], "left").select("asset_id", "pos", "id", "ok", F.coalesce("evidence", F.lit("does not apply")).alias("evidence"))


def _status(some_attrs: Column) -> Column:
    return F.when(~some_attrs, "skipped").when(F.col("all_ok"), "pass").when(F.col("any_ok"), "warn").otherwise("fail")


def check_cf(assets: DataFrame, variables: DataFrame) -> DataFrame:
    """One row per asset: ``status`` and the list of ``checks``.

    ``skipped`` if neither the asset nor a variable has attributes; else ``pass`` if all
    checks that apply hold, ``warn`` if some do, ``fail`` if none does.
    """
    checks = cf_checks(assets, variables)
    summed = checks.groupBy("asset_id").agg(
        F.every("ok").alias("all_ok"), F.some("ok").alias("any_ok"), F.count("ok").alias("applicable"),
        F.array_sort(F.collect_list(F.struct("pos", "id", "ok", "evidence"))).alias("checks"),
    )
    attrs = variables.groupBy("asset_id").agg(F.some(F.coalesce(F.size("attrs"), F.lit(0)) > 0).alias("own"))
    joined = summed.join(assets.select("asset_id", (F.coalesce(F.size("global_attrs"), F.lit(0)) > 0).alias("globals")), "asset_id").join(attrs, "asset_id", "left")
    return joined.select("asset_id", _status(F.col("globals") | F.coalesce("own", F.lit(False))).alias("status"), "applicable", "checks")


def check_geozarr(assets: DataFrame, arrays: DataFrame) -> DataFrame:
    """One row per Zarr store: ``pass`` or ``warn`` from the CF checks and three of the store's layout.

    ``arrays`` are its variables, with ``attrs`` holding ``_ARRAY_DIMENSIONS`` or ``multiscales``
    as JSON text where the store has them, and ``dims`` the declared dimension names.
    """
    cf = cf_checks(assets, arrays).select("asset_id", "id", "ok")
    whole = assets.select("asset_id", F.lit("consolidated_metadata").alias("id"), F.coalesce("consolidated", F.lit(False)).alias("ok"))
    named = (F.coalesce(F.size("dims"), F.lit(0)) > 0) | attr("_ARRAY_DIMENSIONS").isNotNull()
    dims = arrays.filter(~is_crs_container(F.col("name"))).groupBy("asset_id").agg(F.every(named).alias("ok")).select("asset_id", F.lit("dimension_names").alias("id"), "ok")
    own = arrays.filter(F.map_contains_key("attrs", "multiscales")).select("asset_id")
    scales = own.union(assets.filter(F.map_contains_key("global_attrs", "multiscales")).select("asset_id")).distinct()
    scales = scales.select("asset_id", F.lit("multiscales").alias("id"), F.lit(True).alias("ok"))
    summed = cf.union(whole).union(dims).union(scales).groupBy("asset_id").agg(F.every("ok").alias("all_ok"), F.count("ok").alias("applicable"))
    return summed.select("asset_id", F.when(F.col("all_ok"), "pass").otherwise("warn").alias("status"), "applicable")

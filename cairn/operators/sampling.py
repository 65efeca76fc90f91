"""Pick interior chunks, measure stored sizes and assess each variable's chunking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, geometry


def _nearest(grid: Column, most: int) -> Column:
    """The ``most`` cells of a grid nearest to its centre as (``shell``, ``far``, ``idx``), in order."""
    zero = F.lit(0).cast("bigint")

    def radius(centre: Column) -> Column:
        def box(r: Column) -> Column:
            spans = F.zip_with(centre, grid, lambda c, g: F.least(g - 1, c + r) - F.greatest(zero, c - r) + 1)
            return geometry.product(F.transform(spans, lambda s: F.least(s, F.lit(most))))

        widest = F.array_max(grid)
        found = F.aggregate(F.sequence(F.lit(0), F.lit(most)), F.lit(-1), lambda found, r: F.when(found >= 0, found).when((box(r) >= most) | (r >= widest), r).otherwise(found))
        return geometry.let(found, lambda r: F.when(r < 0, most).otherwise(r))

    def cells(centre: Column, r: Column) -> Column:
        ranges = F.zip_with(centre, grid, lambda c, g: F.sequence(F.greatest(zero, c - r), F.least(g - 1, c + r)))
        empty = F.array(F.array().cast("array<bigint>"))
        return F.aggregate(ranges, empty, lambda acc, axis: F.flatten(F.transform(acc, lambda p: F.transform(axis, lambda x: F.concat(p, F.array(x))))))

    def placed(centre: Column, idx: Column) -> Column:
        far = lambda gaps: F.aggregate(gaps, zero, lambda a, g: a + g * g)
        return geometry.let(F.zip_with(idx, centre, lambda x, c: F.abs(x - c)), lambda gaps: F.struct(F.array_max(gaps).alias("shell"), far(gaps).alias("far"), idx.alias("idx")))

    def sorted_cells(centre: Column) -> Column:
        return geometry.let(radius(centre), lambda r: F.slice(F.array_sort(F.transform(cells(centre, r), lambda idx: placed(centre, idx))), 1, most))

    return geometry.let(F.transform(grid, lambda g: F.floor(g / 2).cast("bigint")), sorted_cells)


def interior_chunks(variables: DataFrame, most: int = fixed.INTERIOR_CANDIDATES) -> DataFrame:
    """(``asset_id``, ``name``, ``rank``, ``idx``): the grid cells nearest to the centre of each array.

    Order: Chebyshev shell, squared distance, index. Only as many shells are generated as
    hold ``most`` cells: in a shell of radius r an axis has at most 2r + 1 places, so a box
    of at least ``most`` cells holds the nearest ones, whatever the size of the grid. Cells are
    ordered within the row of their variable; only its grid is moved. Rows that repeat a variable
    are ranked as one.
    """
    key = ["asset_id", "name", "ordinal"]
    grid = geometry.chunk_grid(F.col("shape"), F.col("chunks"))
    cells = variables.filter((F.size("shape") > 0) & (F.size("chunks") > 0)).select(*key, grid.alias("grid"))
    cells = cells.filter(F.forall("grid", lambda g: g.isNotNull() & (g > 0)))
    grids = cells.repartition(*key).groupBy(*key, "grid").agg(F.least(F.count("*"), F.lit(most)).cast("int").alias("n"))
    boxes = grids.groupBy(*key).agg(F.collect_list(F.struct("grid", "n")).alias("boxes"))
    near = F.flatten(F.transform("boxes", lambda b: F.flatten(F.transform(_nearest(b["grid"], most), lambda cell: F.array_repeat(cell, b["n"])))))
    ranked = boxes.select(*key, F.posexplode(F.slice(F.array_sort(near), 1, most)).alias("at", "cell"))
    return ranked.select(*key, (F.col("at") + 1).alias("rank"), F.col("cell.idx").alias("idx"))


def scan_interior(candidates: DataFrame, stored: DataFrame, most: int = fixed.INTERIOR_SAMPLES, byte_cap: int | None = fixed.MAX_BYTES) -> DataFrame:
    """One row per variable with candidates: the sizes that a walk over its candidates measures.

    The walk skips cells that are not stored, stops once the bytes read exceed the cap, and
    ends at the ``most``-th chunk that bears data. ``sizes``, ``measured``, ``data_bearing``
    and ``note`` tell the outcome. Both sides are sorted and merged: Spark estimates exploded
    candidates by the size of the file they came from, and would broadcast them all.
    """
    key = ["asset_id", "name"]
    bears = geometry.data_bearing(F.col("values"), F.col("fill") if "fill" in stored.columns else None)
    sized = stored.select(*key, "idx", "size_bytes", bears.alias("bears"), F.lit(True).alias("met"))
    met = candidates.select(*key, "idx", "rank").join(sized.hint("merge"), [*key, "idx"], "left")
    walk = Window.partitionBy(*key).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    walked = met.withColumn("read", F.sum("size_bytes").over(walk)).withColumn("within", F.lit(True) if byte_cap is None else F.col("read") <= byte_cap)
    walked = walked.withColumn("hits", F.sum((F.col("bears") & F.col("within")).cast("int")).over(walk))
    before = F.col("hits") - (F.col("bears") & F.col("within")).cast("int")
    seen = walked.withColumn("seen", F.coalesce(F.col("met") & (before < most), F.lit(False)))
    listed = lambda test: F.transform(F.array_sort(F.collect_list(F.when(F.col("seen") & test, F.struct("rank", "size_bytes")))), lambda x: x["size_bytes"])
    found = seen.groupBy(*key).agg(
        listed(F.col("within") & F.col("bears") & (F.col("size_bytes") > 0)).alias("good"), listed(F.col("within") & (F.col("size_bytes") > 0)).alias("every"),
        F.coalesce(F.max(F.when(F.col("seen"), ~F.col("within"))), F.lit(False)).alias("capped"), F.max("seen").alias("any"),
    )
    capped, good = F.col("capped"), F.size("good") > 0
    sizes = F.when(good, F.col("good")).otherwise(F.slice("every", 1, most))
    return found.select(
        *key, sizes.alias("sizes"), (F.size(sizes) > 0).alias("measured"),
        F.when(good, True).when(~F.col("any") | (capped & (F.size(sizes) == 0)), F.lit(None)).otherwise(False).alias("data_bearing"),
        F.when(capped, "stopped at the byte cap; the sizes measured before it are given")
        .when(~F.col("any"), "no stored chunk near the centre").when(~good, "all sampled chunks hold fill values").alias("note"),
    )


def size_stats(stored: DataFrame, key: list[str]) -> DataFrame:
    """Median, least and greatest MB (three places) and the number of sampled chunks by key."""
    mb = F.col("size_bytes") / F.lit(float(fixed.MIB))
    return stored.groupBy(*key).agg(F.median(mb).alias("median"), F.min(mb).alias("least"), F.max(mb).alias("most"), F.count("*").alias("n_sampled")).select(
        *key, *[geometry.half_even(F.col(a), 3).alias(b) for a, b in (("median", "median_mb"), ("least", "min_mb"), ("most", "max_mb"))], "n_sampled")


def parse_chunk_key(key: Column) -> Column:
    """The grid index of a stored chunk's key, ``c/0/1`` or ``0.1``; null for other keys."""
    bare = F.regexp_replace(key, "^/+|/+$", "")
    parts = F.when(bare.startswith("c/"), F.split(F.substring(bare, 3, 1 << 30), "/")).otherwise(F.split(bare, r"\."))
    return F.when(F.forall(parts, lambda p: p.rlike(r"^\d+$")), parts.cast("array<bigint>"))


def listed_chunks(keys: DataFrame, variables: DataFrame) -> DataFrame:
    """(``asset_id``, ``name``, ``idx``, ``size_bytes``) of the stored chunks in a listing (``asset_id``, ``key``, ``length``).

    A key is an array's path and a chunk's place in it, ``tas/c/0/1`` or ``tas/0.1``; a chunk of an
    array without axes is ``tas/c`` or ``tas/0``. Keys of metadata and of unknown arrays are left out.
    A column ``path`` of the listing is kept.
    """
    kept = ["path"] if "path" in keys.columns else []
    path = F.regexp_extract("key", r"^(.*?)/(c(/[0-9]+)*|[0-9]+([./][0-9]+)*)$", 1)
    rows = keys.select("asset_id", F.concat(F.lit("/"), F.regexp_replace(path, "^/+", "")).alias("name"), F.expr("substring(key, length(regexp_extract(key, '^(.*?)/(c(/[0-9]+)*|[0-9]+([./][0-9]+)*)$', 1)) + 2)").alias("place"), F.col("length").alias("size_bytes"), *kept)
    rows = rows.filter("place <> '' AND name <> '/'").withColumn("idx", parse_chunk_key(F.col("place")))
    return rows.filter("idx IS NOT NULL").join(variables.select("asset_id", "name").distinct(), ["asset_id", "name"], "left_semi").select("asset_id", "name", "idx", "size_bytes", *kept)


def sample_listed(variables: DataFrame, keys: DataFrame, most: int = fixed.INTERIOR_SAMPLES) -> DataFrame:
    """Sizes of each variable's stored chunks nearest to the centre, as ``assess_chunking`` takes them: no chunk is read.

    One row (``asset_id``, ``name``, ``median_mb``, ``min_mb``, ``max_mb``, ``n_sampled``) for each variable that has a
    stored chunk with bytes among its candidates; fill chunks are as a rule not stored.
    """
    near = interior_chunks(variables).join(listed_chunks(keys, variables).filter("size_bytes > 0"), ["asset_id", "name", "idx"])
    order = Window.partitionBy("asset_id", "name").orderBy("rank", "size_bytes")
    return size_stats(near.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= most), ["asset_id", "name"])


def assess_chunking(variables: DataFrame, measured: DataFrame | None = None, use_case: str | None = None) -> DataFrame:
    """Each variable with MB (measured before estimated), grade, orientation, profiles and notes.

    ``measured`` has one row (``asset_id``, ``name``, ``median_mb``, ...) per variable with sampled chunks.
    """
    if measured is None:
        rows = variables.withColumn("median_mb", F.lit(None).cast("double"))
    else:
        rows = variables.join(measured.select("asset_id", "name", "median_mb"), ["asset_id", "name"], "left")
    v = F.col
    has = F.coalesce(F.size("chunks"), F.lit(0)) > 0
    estimate = geometry.estimate_mb(F.when(has, v("chunks")).otherwise(v("shape")), v("dtype"))
    mb = F.coalesce(F.when(has, v("median_mb")), estimate)
    rows = rows.withColumn("mb", mb).withColumn("measured", has & v("median_mb").isNotNull())
    known = F.when(has, v("chunks")).otherwise(F.array().cast("array<bigint>"))
    found = geometry.orientation(v("dims"), v("shape"), known, v("mb"), use_case, geometry.itemsize(v("dtype")))
    rows = rows.withColumn("layout", found).withColumn("prose", geometry.orientation_prose(F.col("layout"), v("chunks")))
    notes = F.array_compact(F.array(F.when(~has, geometry.contiguous_note(v("codec"))), geometry.coordinate_note(v("name"), v("dims"), v("shape"), v("chunks"))))
    return rows.withColumn("grade", geometry.grade(v("mb"))).withColumn("grade_note", geometry.grade_note(v("mb"))).withColumn("profiles", geometry.profiles(v("mb"))).withColumn("notes", notes).drop("median_mb")

"""Column expressions over array shapes, chunk grids and chunk sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .names import basename


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def half_even(x: Column, places: int) -> Column:
    """``x`` rounded to ``places`` as its binary value lies: only exact ties go to the even digit.

    The product with the power of ten is taken with its error (the factors split into halves
    of 26 bits), so what lies just below or above a tie is not taken for one.
    """
    scale = float(10**places)
    high = scale * 134217729.0 - (scale * 134217729.0 - scale)
    low = scale - high

    def rounded(v: Column) -> Column:
        y = v * F.lit(scale)
        c = v * F.lit(134217729.0)
        top = c - (c - v)
        rest = v - top
        error = ((top * F.lit(high) - y) + top * F.lit(low) + rest * F.lit(high)) + rest * F.lit(low)
        whole = F.floor(y).cast("double")
        part = y - whole
        odd = whole - F.lit(2.0) * F.floor(whole / F.lit(2.0)).cast("double")
        up = (part > 0.5) | ((part == 0.5) & ((error > 0) | ((error == 0) & (odd == 1))))
        return F.when(F.abs(y) >= F.lit(2.0**52), v).otherwise((whole + up.cast("double")) / F.lit(scale))

    return let(x.cast("double"), rounded)


def product(values: Column) -> Column:
    return F.aggregate(values, F.lit(1).cast("bigint"), lambda a, x: a * x)


def element_count(shape: Column) -> Column:
    """Elements of an array; 0 without a shape."""
    return F.when(F.coalesce(F.size(shape), F.lit(0)) <= 0, F.lit(0).cast("bigint")).otherwise(product(shape))


def itemsize(dtype: Column) -> Column:
    pairs = [F.lit(x) for kv in fixed.ITEMSIZES.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), dtype), F.lit(8)).cast("bigint")


def estimate_mb(chunks: Column, dtype: Column, ratio: float = fixed.ASSUMED_RATIO) -> Column:
    """MB of one chunk at the assumed compression ratio, to three places, exact ties away from zero; null without chunks."""
    value = F.round(product(chunks) * itemsize(dtype) / F.lit(ratio) / F.lit(float(fixed.MIB)), 3)
    return F.when(F.size(chunks) > 0, value)


def _paired(shape: Column, chunks: Column, f) -> Column:
    """``f`` over the axes that both lists have."""
    n = F.least(F.size(shape), F.size(chunks))
    return F.zip_with(F.slice(shape, F.lit(1), n), F.slice(chunks, F.lit(1), n), f)


def chunk_grid(shape: Column, chunks: Column) -> Column:
    """Chunks along each axis; null entries where a chunk extent is zero."""
    return _paired(shape, chunks, lambda s, c: F.ceil(F.try_divide(s, c)).cast("bigint"))


def chunk_count(shape: Column, chunks: Column) -> Column:
    """Chunks of the whole array; null without shape or chunks or with a zero extent."""
    return F.when((F.size(shape) > 0) & (F.size(chunks) > 0), product(chunk_grid(shape, chunks)))


def grade(mb: Column) -> Column:
    return (
        F.when(mb.isNull(), "unknown").when(mb < fixed.GRADE_FAIL_BELOW, "fail").when(mb < fixed.GRADE_WARN_BELOW, "warn")
        .when(mb <= fixed.GRADE_LEAN_TO, "pass").otherwise("warn")
    )


def three_digits(x: Column) -> Column:
    """A number with three significant digits and no trailing zeros, as ``%.3g`` prints it between 0.0001 and 999."""
    places = F.greatest(F.lit(0), F.lit(2) - F.floor(F.log10(F.abs(x))).cast("int"))
    text = F.format_string("%.6f", F.round(x * F.pow(F.lit(10.0), places)) / F.pow(F.lit(10.0), places))
    return F.when(x == 0, "0").otherwise(F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", ""))


def grade_note(mb: Column) -> Column:
    size = F.concat(three_digits(mb), F.lit(" MB"))
    return (
        F.when(mb.isNull(), "no chunk size was measured or estimated")
        .when(mb < fixed.GRADE_FAIL_BELOW, F.concat(size, F.lit(": under 1 MB, requests cost more than the bytes they bring")))
        .when(mb < fixed.GRADE_WARN_BELOW, F.concat(size, F.lit(": 1-4 MB, below the 8-16 MB that suit the wire best")))
        .when(mb <= fixed.GRADE_PASS_TO, F.concat(size, F.lit(": 4-16 MB, suits the wire")))
        .when(mb <= fixed.GRADE_LEAN_TO, F.concat(size, F.lit(": 16-64 MB, fine, though partial reads would gain from less")))
        .otherwise(F.concat(size, F.lit(": over 64 MB, partial reads and retries pay for it")))
    )


def profile_status(mb: Column, low: Column, high: Column) -> Column:
    return F.when(mb.isNull(), "unknown").when(mb < low, "below").when(mb > high, "above").otherwise("within")


def profiles(mb: Column) -> Column:
    """A map from each profile to ``below``, ``within``, ``above`` or ``unknown``."""
    entries = [x for name, (lo, hi) in fixed.PROFILES.items() for x in (F.lit(name), profile_status(mb, F.lit(lo), F.lit(hi)))]
    return F.create_map(*entries)


def data_bearing(values: Column, fill: Column | None = None, share: float = fixed.FILL_SHARE) -> Column:
    """Whether NaN and fill values are less than ``share`` of a decoded chunk; false for an empty one."""
    empty = lambda x: F.coalesce(F.isnan(x), F.lit(False)) | (F.coalesce(x == fill, F.lit(False)) if fill is not None else F.lit(False))
    total = F.size(values)
    return F.when(F.coalesce(total, F.lit(0)) <= 0, False).otherwise(F.size(F.filter(values, empty)) / total < share)


# --- what a layout suits


def _known(*groups) -> list[str]:
    return [n for g in groups for n in g]


def classify_dims(dims: Column) -> Column:
    """A struct of the time axis (0-based, null if none), the spatial axes, and whether names told nothing.

    The first time-like name is the time axis; later time-like names count as spatial.
    Unknown names fall back to position: with two axes or more the first is time.
    """
    low = F.transform(F.coalesce(dims, F.array().cast("array<string>")), lambda d: F.lower(F.coalesce(d, F.lit(""))))
    return let(low, _axes)


def _axes(low: Column) -> Column:
    places = F.sequence(F.lit(0), F.size(low) - 1)
    every = F.when(F.size(low) > 0, places).otherwise(F.array().cast("array<int>"))
    times = F.filter(every, lambda i: F.get(low, i).isin(*fixed.TIME_NAMES))
    known = F.filter(every, lambda i: F.get(low, i).isin(*_known(fixed.TIME_NAMES, fixed.VERTICAL_NAMES, fixed.Y_NAMES, fixed.X_NAMES)))
    named = F.struct(F.get(times, F.lit(0)).alias("time"), known.alias("known"), every.alias("every"))

    def placed(n: Column) -> Column:
        time, hedged = n["time"], F.size(n["known"]) == 0
        spatial = F.filter(n["known"], lambda i: time.isNull() | (i != time))
        return F.struct(
            F.when(~hedged, time).when(F.size(low) >= 2, 0).alias("time"),
            F.when(~hedged, spatial).when(F.size(low) >= 2, F.filter(n["every"], lambda i: i > 0)).otherwise(n["every"]).alias("spatial"),
            hedged.alias("hedged"),
        )

    return let(named, placed)


def grade_amplification(amplification: Column) -> Column:
    return F.when(amplification > fixed.AMPLIFICATION_FAIL, "fail").when(amplification > fixed.AMPLIFICATION_WARN, "warn").when(amplification.isNotNull(), "pass")


def _read(touched: Column, mb: Column, needed: Column, target: str, use_case: str | None) -> Column:
    def told(x: Column) -> Column:
        moved = x["touched"] * x["mb"] * F.lit(float(fixed.MIB))
        ratio = F.try_divide(moved, x["needed"])
        return F.struct(
            x["touched"].alias("chunks_touched"), half_even(moved, 1).alias("bytes_transferred"), half_even(x["needed"], 1).alias("bytes_needed"), half_even(ratio, 2).alias("amplification"),
            (grade_amplification(ratio) if use_case == target else F.lit(None).cast("string")).alias("grade"),
        )

    return let(F.struct(touched.cast("bigint").alias("touched"), mb.alias("mb"), needed.alias("needed")), told)


def orientation(dims: Column, shape: Column, chunks: Column, mb: Column | None = None, use_case: str | None = None, bytes_each: Column | None = None) -> Column:
    """A struct with ``orientation`` and the reads ``map_read``, ``series_read`` or, without time axis, ``scene_read``.

    Null where an axis has a chunk extent of zero; ``unknown`` without dimensions, shape or chunks.
    """
    each = bytes_each if bytes_each is not None else F.lit(fixed.PLACEHOLDER_ITEMSIZE)
    guess = F.coalesce(F.nullif(estimate_mb(chunks, F.lit("float32")), F.lit(0.0)), F.lit(1.0))
    size = F.coalesce(mb, guess) if mb is not None else guess
    poor = (F.coalesce(F.size(dims), F.lit(0)) <= 0) | (F.coalesce(F.size(shape), F.lit(0)) <= 0) | (F.coalesce(F.size(chunks), F.lit(0)) <= 0)

    def spread(axes: Column) -> Column:
        """The axes with what follows from them alone: spatial places, chunk grid, shares."""
        time = axes["time"]
        own = F.filter(axes["spatial"], lambda i: i != time)
        rest = F.filter(F.sequence(F.lit(0), F.size(shape) - 1), lambda i: i != time)
        spatial = F.when(time.isNull(), axes["spatial"]).when(F.size(own) > 0, own).otherwise(rest)
        return F.struct(time.alias("time"), axes["hedged"].alias("hedged"), spatial.alias("spatial"), chunk_grid(shape, chunks).alias("grid"), size.alias("mb"), each.cast("bigint").alias("each"))

    def measured(a: Column) -> Column:
        shares = F.filter(F.transform(a["spatial"], lambda i: F.try_divide(F.get(chunks, i), F.get(shape, i))), lambda x: x.isNotNull())
        return F.struct(
            a.alias("a"), F.coalesce(F.array_min(shares), F.lit(0.0)).alias("low"), F.coalesce(F.array_max(shares), F.lit(0.0)).alias("high"),
            F.coalesce(F.try_divide(F.get(chunks, a["time"]), F.get(shape, a["time"])), F.lit(0.0)).alias("f_time"), F.get(chunks, a["time"]).alias("step"), F.get(shape, a["time"]).alias("length"),
        )

    def described(m: Column) -> Column:
        a, step = m["a"], m["step"]
        thin = (step == 1) | (m["f_time"] <= F.lit(fixed.TIME_THIN) * F.greatest(m["low"], F.lit(1e-12)))
        deep = (step >= fixed.TIME_STEPS) | (m["f_time"] >= fixed.TIME_SHARE)
        kind = (
            F.when(a["time"].isNull(), "tiled").when((m["low"] >= fixed.SPATIAL_LARGE) & thin, "map-optimized")
            .when((m["high"] < fixed.SPATIAL_SMALL) & deep, "timeseries-optimized").otherwise("balanced")
        )
        map_read = _read(product(F.transform(a["spatial"], lambda i: F.get(a["grid"], i))), a["mb"], product(F.transform(a["spatial"], lambda i: F.get(shape, i))) * a["each"], "maps", use_case)
        series_read = _read(F.get(a["grid"], a["time"]), a["mb"], m["length"] * a["each"], "timeseries", use_case)
        total = F.coalesce(product(a["grid"]), F.lit(1))
        scene = F.struct(
            total.cast("bigint").alias("chunks_touched"), half_even(total * a["mb"] * F.lit(float(fixed.MIB)), 1).alias("bytes_transferred"),
            half_even(product(shape) * a["each"], 1).alias("bytes_needed"),
        )
        timed = a["time"].isNotNull()
        return F.struct(kind.alias("orientation"), a["hedged"].alias("hedged"), F.when(timed, map_read).alias("map_read"), F.when(timed, series_read).alias("series_read"), F.when(~timed, scene).alias("scene_read"))

    found = let(let(let(classify_dims(dims), spread), measured), described)
    return F.when(~poor, found).otherwise(F.struct(F.lit("unknown").alias("orientation"), classify_dims(dims)["hedged"].alias("hedged"), *[F.lit(None).cast(t).alias(n) for n, t in (("map_read", READ), ("series_read", READ), ("scene_read", SCENE))]))


READ = "struct<chunks_touched:bigint,bytes_transferred:double,bytes_needed:double,amplification:double,grade:string>"
SCENE = "struct<chunks_touched:bigint,bytes_transferred:double,bytes_needed:double>"


def orientation_prose(found: Column, chunks: Column) -> Column:
    """A sentence about a struct that ``orientation`` made."""
    kind = found["orientation"]
    hedge = F.when(found["hedged"], F.lit("(axis names tell nothing; the first axis is taken as time) ")).otherwise("")
    maps, series = found["map_read"]["chunks_touched"].cast("string"), found["series_read"]["chunks_touched"].cast("string")
    return (
        F.when(kind == "unknown", "too little is known of the dimensions to say what the layout suits")
        .when(kind == "tiled", F.concat(hedge, F.lit("tiles of "), F.array_join(chunks.cast("array<string>"), "x"), F.lit(" suit windowed reads; a whole scene takes "), found["scene_read"]["chunks_touched"].cast("string"), F.lit(" chunks")))
        .when(kind == "map-optimized", F.concat(hedge, F.lit("thin in time and wide in space: suits whole maps of one step; a series at a point takes "), series, F.lit(" chunks")))
        .when(kind == "timeseries-optimized", F.concat(hedge, F.lit("deep in time and small in space: suits series at a point; one whole map takes "), maps, F.lit(" chunks")))
        .otherwise(F.concat(hedge, F.lit("between both: a whole map takes "), maps, F.lit(" chunks, a series at a point "), series))
    )


def coordinate_note(name: Column, dims: Column, shape: Column, chunks: Column) -> Column:
    """A note for a one-dimensional coordinate that is cut into chunks though it is small; null otherwise."""
    first, base = F.lower(F.coalesce(F.get(dims, F.lit(0)), F.lit(""))), F.lower(basename(name))
    known = _known(fixed.TIME_NAMES, fixed.VERTICAL_NAMES, fixed.Y_NAMES, fixed.X_NAMES)
    coordinate = first.isin(*known) | (base == first) | base.isin(*known)
    n = F.ceil(F.try_divide(F.get(shape, F.lit(0)), F.get(chunks, F.lit(0))))
    whole = F.get(shape, F.lit(0)) * 8 / F.lit(float(fixed.MIB))
    split = (F.size(shape) == 1) & (F.size(chunks) > 0) & coordinate & (n > 1) & (whole < fixed.COORDINATE_MB)
    return F.when(split, F.concat(F.lit("a coordinate in "), n.cast("string"), F.lit(" chunks; it is read whole, so one chunk saves requests")))


def contiguous_note(codec: Column) -> Column:
    return F.when(codec.isNotNull(), "one piece: only whole reads, compression gives no subsets").otherwise("one piece: ranges can be read, but not chunk by chunk")

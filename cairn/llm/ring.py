"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns ``virtual`` points of a ring, and a key's hash is a place on it. The arc
before a point belongs to the point's shard. A shard takes rows up to its bound; what
exceeds it continues clockwise to the next shard with room. With the bounds floor(n/s) or
floor(n/s) + 1 (the first n mod s shards of a seeded order get the larger one) every shard
is exactly full, so counts are at most one apart (law ``rows``), and only overflow moves.

The overflow needs counts alone: rows per arc (shards x virtual numbers, whatever the data)
are summed before any shuffle, a walk around the ring turns them into ranges of each arc
that go to each shard, and a row finds its shard by its rank in the arc. Ranks come from
counts of fine cells of the arcs, so no task sorts more than a cell. An id with very many
rows has one place; a cell with over ``HOT_ROWS`` rows is cut by a hash of id, size and CRC, and rows
that are equal in all three are counted before they are ranked.

Defined cases: the text counts UTF-8 bytes, a null text none; null document ids share a
place on the ring; rows with equal ids are ordered by size and CRC, and rows equal in all
three are interchangeable; an empty table gives an empty table; fewer rows than shards
leave shards empty. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import hot_keys, stored, with_parts

#: The ring has 2**RING_BITS places.
RING_BITS = 48
#: Rows that one cell should hold; the number of cells follows the number of rows.
CELL_ROWS = 20_000
#: Rows beyond which a cell is cut further.
HOT_ROWS = 4 * CELL_ROWS


def place(key: Column) -> Column:
    """A key's place on the ring: the top bits of an MD5, alike in every engine."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, RING_BITS // 4), 16, 10).cast("long")


def points(shards: int, virtual: int) -> list[tuple[int, int]]:
    """(place, shard) of all virtual nodes, clockwise."""
    return sorted((int(hashlib.md5(f"shard {s} node {v}".encode()).hexdigest()[: RING_BITS // 4], 16), s) for s in range(shards) for v in range(virtual))


def bounds(rows: int, shards: int) -> list[int]:
    """How many rows each shard takes; they add up to ``rows`` and are at most one apart."""
    order = sorted(range(shards), key=lambda s: hashlib.md5(f"extra {s}".encode()).digest())
    out = [rows // shards] * shards
    for s in order[: rows % shards]:
        out[s] += 1
    return out


def flows(counts: list[int], ring: list[tuple[int, int]], room: list[int]) -> list[tuple[int, int, int, int]]:
    """(arc, first rank, end rank, shard): where each arc's rows go.

    Every shard first takes from its own arcs, clockwise, up to its bound. What is left
    continues: a walk around the ring carries the overflow until it meets room, twice
    around at most, as rooms and rows add up to the same.
    """
    free = list(room)
    taken: list[tuple[int, int, int, int]] = []
    left: list[tuple[int, int, int]] = []
    for arc, n in enumerate(counts):
        shard = ring[arc][1]
        own = min(n, free[shard])
        free[shard] -= own
        if own:
            taken.append((arc, 0, own, shard))
        if own < n:
            left.append((arc, own, n))
    carried: list[tuple[int, int, int]] = []
    over = {arc: (arc, a, b) for arc, a, b in left}
    for step in range(2 * len(ring)):
        arc = step % len(ring)
        shard = ring[arc][1]
        while carried and free[shard]:
            source, a, b = carried.pop(0)
            n = min(b - a, free[shard])
            free[shard] -= n
            taken.append((source, a, a + n, shard))
            if a + n < b:
                carried.insert(0, (source, a + n, b))
        if step < len(ring) and arc in over:
            carried.append(over[arc])
    if carried:
        raise ValueError("the bounds are too small for the rows")
    return sorted(taken)


def assign(docs: DataFrame, shards: int = 24, virtual: int = 64, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, ``keep`` and ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard`` of every row."""
    spark = docs.sparkSession
    ring = points(shards, virtual)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        *[F.col(c) for c in dict.fromkeys([id_col, *keep])],
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        place(F.col(id_col)).alias("__at"),
    )
    rows = stored(rows)
    total = rows.count()
    cells = max(1, total // CELL_ROWS)  # of a whole ring; each arc adds a boundary
    width = (1 << RING_BITS) // cells + 1
    # The first point at or after the place; past the last one the ring closes.
    places = F.array(*[F.lit(p) for p, _ in ring])
    steps = [1 << k for k in range(len(ring).bit_length() - 1, -1, -1)]
    found = F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda pos, step: F.when((pos + step <= len(ring)) & (F.try_element_at(places, pos + step) < F.col("__at")), pos + step).otherwise(pos),
    )
    arc = F.pmod(found, F.lit(len(ring)))
    # Places after the last point precede those before the first in the arc that closes the ring.
    turned = F.pmod(F.col("__at") - F.lit(ring[-1][0] + 1), F.lit(1 << RING_BITS))
    rows = rows.withColumn("__arc", arc.cast("int")).withColumn("__at", turned).withColumn("__cell", F.floor(F.col("__at") / F.lit(width)).cast("long"))
    keys = list(dict.fromkeys([id_col, *keep]))
    cut = hot_keys(rows.select("__arc", "__cell"), ["__arc", "__cell"], HOT_ROWS)
    rows = with_parts(rows, cut, ["__arc", "__cell"])
    rows = rows.withColumn("__sub", F.pmod(F.xxhash64(id_col, "size", "text_crc32"), F.col("parts").cast("long"))).drop("parts")
    rows = rows.groupBy("__arc", "__cell", "__sub", "__at", *keys, "size", "text_crc32").agg(F.count("*").alias("__times"))
    per_cell = stored(rows.groupBy("__arc", "__cell", "__sub").agg(F.sum("__times").alias("__n")))
    counts = [0] * len(ring)
    for r in per_cell.groupBy("__arc").agg(F.sum("__n").alias("n")).collect():  # at most shards x virtual rows
        counts[r["__arc"]] = r["n"]
    moves = flows(counts, ring, bounds(total, shards))
    base: dict[int, int] = {}
    schedule = []
    for a, lo, hi, s in moves:
        schedule.append((a, lo, hi, s, base.get(s, 0)))
        base[s] = base.get(s, 0) + hi - lo
    moves_type = T.StructType([T.StructField("__arc", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("__lo", "__hi", "__shard", "__base")]])
    # At most one range for each arc and one for each filled shard: small whatever the data.
    ranges = F.broadcast(spark.createDataFrame(schedule, moves_type))
    # Cells are rows of counts, fewer than rows / CELL_ROWS and the number of arcs together.
    running = Window.partitionBy("__arc").orderBy("__cell", "__sub").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.sum("__n").over(running) - F.col("__n")
    offsets = per_cell.select("__arc", "__cell", "__sub", before.alias("__before"))
    in_cell = Window.partitionBy("__arc", "__cell", "__sub").orderBy("__at", id_col, "size", "text_crc32", *keep).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = rows.withColumn("__rn", F.sum("__times").over(in_cell) - F.col("__times"))
    ranked = ranked.join(offsets, ["__arc", "__cell", "__sub"]).withColumn("__i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__times") - 1)))
    ranked = ranked.withColumn("__rank", F.col("__rn") + F.col("__before") + F.col("__i"))
    placed = ranked.join(ranges, "__arc").filter((F.col("__rank") >= F.col("__lo")) & (F.col("__rank") < F.col("__hi")))
    return placed.select(
        *dict.fromkeys([id_col, *keep]),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("__shard").cast("int").alias("shard"),
        (F.col("__base") + F.col("__rank") - F.col("__lo")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def owner(key: str, ring: list[tuple[int, int]]) -> int:
    """The shard of a key before any overflow (for tests and single lookups)."""
    at = int(hashlib.md5(key.encode()).hexdigest()[: RING_BITS // 4], 16)
    return ring[bisect_left(ring, (at, -1)) % len(ring)][1]

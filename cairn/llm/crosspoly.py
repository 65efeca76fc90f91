"""Approximate nearest neighbours by cross-polytope hashing.

A pseudo-rotation is three rounds of random signs and a fast Hadamard transform. It turns a
unit vector, and the signed axis nearest to the result is its hash: 2d values. A table
hashes with one rotation, and while tables are too coarse for the number of rows with a
second one on fewer axes, so buckets hold about ``bucket_rows`` rows at any size. A query
probes, in every table, the buckets whose axes come nearest to it. Candidates are ranked
by their exact cosine on the original vectors in double precision.

A bucket with more rows than a task should hold is split into parts, and its queries go to
every part: no candidate of a probed bucket is dropped.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite component
take no part, neither as rows nor as queries; shorter vectors count as filled with zeros; null ids take no part; rows that
repeat an id are candidates once, a repeated query id asks once (with the least of its usable vectors),
and a query skips all rows with its own id; equal scores go to the smaller id; fewer found
than k are completed from a stated set of rows, so tables smaller than that set are
answered exactly; empty tables give empty tables; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import group_starts, hot_keys, padded, stored, to_floats, usable_vectors, whole_groups, with_parts

#: Rows that complete answers of too few candidates (a constant, whatever the data).
SPARE_ROWS = 256
#: Rows of one bucket that a task ranks; larger buckets are split.
GROUP_LIMIT = 1024


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row; the width is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


class Rotations:
    """The pseudo-rotations of all tables, from a seed."""

    def __init__(self, width: int, tables: int, second: int, seed: int):
        self.width = 1 << max(1, (width - 1).bit_length())
        self.second = min(second, self.width)
        signs = np.random.default_rng(seed).integers(0, 2, (tables, 2, 3, self.width))
        self.signs = 2.0 * signs - 1

    def turned(self, x: np.ndarray, table: int, which: int) -> np.ndarray:
        for s in self.signs[table, which]:
            x = hadamard(x * s)
        return x

    def scores(self, x: np.ndarray, table: int, which: int) -> np.ndarray:
        """How near each signed axis is: plus axes first, then minus axes; the second rotation keeps few axes."""
        y = self.turned(x, table, which)
        if which:
            y = y[:, : self.second]
        return np.hstack([y, -y])

    def bucket(self, x: np.ndarray, table: int) -> np.ndarray:
        one = self.scores(x, table, 0).argmax(axis=1)
        return one if not self.second else one * (2 * self.second) + self.scores(x, table, 1).argmax(axis=1)

    def probes(self, x: np.ndarray, table: int, count: int) -> np.ndarray:
        """The ``count`` buckets of least cost for each row: the sum of what each axis lacks to the nearest one, squared gaps."""
        lack = lambda s: (s.max(axis=1, keepdims=True) - s) ** 2
        one = lack(self.scores(x, table, 0))
        if not self.second:
            return np.argsort(one, axis=1, kind="stable")[:, :count]
        two = lack(self.scores(x, table, 1))
        a = np.argsort(one, axis=1, kind="stable")[:, : min(count, one.shape[1])]
        b = np.argsort(two, axis=1, kind="stable")[:, : min(count, two.shape[1])]
        cost = np.take_along_axis(one, a, 1)[:, :, None] + np.take_along_axis(two, b, 1)[:, None, :]
        code = a[:, :, None] * (2 * self.second) + b[:, None, :]
        top = np.argsort(cost.reshape(len(x), -1), axis=1, kind="stable")[:, :count]
        return np.take_along_axis(code.reshape(len(x), -1), top, 1)


def second_axes(rows: int, width: int, bucket_rows: int) -> int:
    """Axes of the second rotation, a power of two or none, for buckets of about ``bucket_rows`` rows."""
    full = 1 << max(1, (width - 1).bit_length())
    need = rows / (bucket_rows * 2 * full)
    return 0 if need <= 1 else min(full, 1 << max(0, round(np.log2(need / 2)) if need > 2 else 0))


def default_probes(rows: int) -> int:
    """Buckets that a query looks into in each table: more as rows grow, to hold the recall (sublinear in the rows)."""
    return round(12 * max(1.0, rows / 20_000) ** 0.4)


def cosines(query: np.ndarray, points: np.ndarray, lengths: np.ndarray, length: float) -> np.ndarray:
    """Cosines of one vector with rows, each summed in the same order whatever the number of rows."""
    return (points * query).sum(axis=1) / (lengths * length)


def _units(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    values, good = to_floats(column)
    values = np.where(np.isfinite(values), values, 0.0)
    norm = np.sqrt((values * values).sum(axis=1)) if values.size else np.zeros(len(values))
    good &= norm > 0
    return values, values / np.where(norm > 0, norm, 1)[:, None], norm, good


def search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    tables: int = 12,
    probes: int | None = None,
    bucket_rows: int = 96,
    seed: int = 11,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    group_limit: int = GROUP_LIMIT,
) -> DataFrame:
    """(``query_id``, ``rank``, ``vec_id``, ``score``): the k nearest found of each query by cosine."""
    rows = usable_vectors(vectors, id_col, vector_col, nonzero=True)
    asked = usable_vectors(queries, id_col, vector_col, nonzero=True).groupBy("id").agg(F.min("v").alias("v"))
    shape = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    width, probes = int(shape["d"] or 1), probes or default_probes(shape["n"])
    turns = Rotations(width, tables, second_axes(shape["n"], width, bucket_rows), seed)
    spare = rows.orderBy(F.xxhash64("id"), "id").limit(SPARE_ROWS).toArrow().combine_chunks()

    def hashed(count: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    sub = batch.slice(at, 1024)
                    unit = padded(_units(sub.column("v"))[1], turns.width)
                    code = np.stack([turns.probes(unit, t, count) if count else turns.bucket(unit, t)[:, None] for t in range(tables)], axis=1)
                    codes = pa.array(code.reshape(len(unit), -1).astype(np.int64).tolist(), pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([sub.column("id"), sub.column("v"), codes], names=["id", "v", "codes"])

        return run

    def told(df: DataFrame, count: int) -> DataFrame:
        """One row for each table and bucket."""
        place = (F.col("place") / F.lit(max(count, 1))).cast("long").alias("tab")
        return df.select("id", "v", F.posexplode("codes").alias("place", "bucket")).select("id", "v", place, "bucket")

    key = ["tab", "bucket"]
    schema = lambda df: f"id long, v {df.schema['v'].dataType.simpleString()}, codes array<long>"
    # Hashed once and stored: hot buckets are counted on the codes alone.
    coded = stored(rows.mapInArrow(hashed(0), schema(rows)))
    hot = hot_keys(told(coded, 1).select(*key), key, group_limit)
    stored_rows, probing = told(coded, 1), told(asked.mapInArrow(hashed(probes), schema(asked)), probes).withColumn("v", F.col("v").cast(rows.schema["v"].dataType))
    own = F.pmod(F.xxhash64("id", F.lit(5)), F.col("parts").cast("long")).alias("part")
    stored_rows = with_parts(stored_rows, hot, key).select("id", "v", *key, own, F.lit(0).alias("asks"))
    probing = with_parts(probing, hot, key).select("id", "v", *key, F.explode(F.expr("sequence(0L, parts - 1L)")).alias("part"), F.lit(1).alias("asks"))
    group = [*key, "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in whole_groups(batches, group):
            yield from _ranked(found, group, k)

    near = stored_rows.union(probing).repartition(*group).sortWithinPartitions(*group, "asks").mapInArrow(run, "query_id long, vec_id long, score double")
    near = near.union(asked.mapInArrow(lambda batches: _against(batches, spare, k), "query_id long, vec_id long, score double"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _top(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, repeated ids once (with their best score)."""
    if len(scores) > 8 * k:  # only what reaches the kth score can be among the best, unless ids repeat
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        if len(set(ids[near].tolist())) >= k:
            return near[_sorted_top(ids[near], scores[near], k)]
    return _sorted_top(ids, scores, k)


def _sorted_top(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    order = np.lexsort((ids, -scores))
    _, first = np.unique(ids[order], return_index=True)
    return order[np.sort(first)][:k]


def _ranked(found: pa.Table, group: list[str], k: int) -> Iterator[pa.RecordBatch]:
    asks = found.column("asks").to_numpy()
    starts = group_starts(found, group)
    # Groups without both kinds hold no candidates.
    asked = np.add.reduceat(asks, starts[:-1])
    both = np.flatnonzero((asked > 0) & (asked < np.diff(starts)))
    if not len(both):
        return
    ids = found.column("id").to_numpy()
    values, _, norm, _ = _units(found.column("v"))
    out_q, out_v, out_s = [], [], []
    for g in both:
        mid = starts[g + 1] - asked[g]
        points, own, lengths = values[starts[g] : mid], ids[starts[g] : mid], norm[starts[g] : mid]
        for i in range(mid, starts[g + 1]):
            scores = cosines(values[i], points, lengths, norm[i])
            use = np.flatnonzero(own != ids[i])
            top = use[_top(own[use], scores[use], k)]
            out_q.append(np.full(len(top), ids[i]))
            out_v.append(own[top])
            out_s.append(scores[top])
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_q, out_v, out_s)], names=["query_id", "vec_id", "score"])


def _against(batches: Iterator[pa.RecordBatch], spare: pa.Table, k: int) -> Iterator[pa.RecordBatch]:
    points, _, lengths, good = _units(spare.column("v"))
    ids, points, lengths = spare.column("id").to_numpy()[good], points[good], lengths[good]
    for batch in batches:
        values, _, norm, fine = _units(batch.column("v"))
        width = max(values.shape[1], points.shape[1])
        values, wide = padded(values, width), padded(points, width)
        out = []
        for i in np.flatnonzero(fine):
            own = batch.column("id")[int(i)].as_py()
            use = np.flatnonzero(ids != own)
            scores = cosines(values[i], wide[use], lengths[use], norm[i])
            top = _top(ids[use], scores, k)
            out += [(own, int(ids[use][t]), float(scores[t])) for t in top]
        cols = list(zip(*out, strict=True)) if out else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["query_id", "vec_id", "score"])

"""Exact top-k by inner product with a dual-tree search over cover trees.

Vectors become integers, floor(scale * x). Rows are dealt to blocks by the nearest of a few
pivots; pivot and greatest distance of a block bound the inner product of a query with any
row of it. A query goes to the blocks whose bound reaches the lowest score that can still
be among its k best, which a stated set of ``seeds`` rows gives. A task builds a cover tree
over its block once; queries stream by in groups with a cover tree of their own, and pairs
of nodes are walked together. A pair is pruned when the best inner product that the
covering radii allow is below the worst kth score among the queries of the group. Blocks
return k rows a query, and these are merged. No row is copied, and nothing is missed.

Defined cases: vectors that are null, empty or hold a null or non-finite component take no
part, neither as rows nor as queries; shorter vectors count as filled with zeros; a null id
takes no part; rows that repeat an id are rows of their own, a repeated query id asks once
(with the least of its usable vectors), and a query skips all rows with its own id; equal
scores go to the smaller id; fewer candidates than k give fewer rows; empty tables give
empty tables; only the named columns are read. A score beyond 63 bits raises an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import padded, stored, to_floats, usable_vectors

#: Rows of a block: what one task holds. More rows make larger blocks, within these.
BLOCK_ROWS = (4_096, 65_536)
#: Queries of a block that are walked together.
BLOCK_QUERIES = 4_096
#: Rows that give every query a first bound (a constant, whatever the data), and how many of them are pivots at most.
SEEDS, PIVOTS = 512, 256
#: Points of a leaf: enough for a matrix product to outweigh the walk.
LEAF = 256
#: Marks a place without an answer.
NO_SCORE = -(2**63)


@dataclass
class Node:
    """A centre that is one of the points, the radius that covers all points below, and either children or points."""

    centre: np.ndarray
    norm: float
    radius: float
    rows: np.ndarray
    children: list[Node] = field(default_factory=list)
    worst: float = -np.inf


def cover_tree(points: np.ndarray, leaf: int = LEAF) -> Node | None:
    """A cover tree: a node's children are over half its radius apart, and each covers the points nearest to it."""
    if not len(points):
        return None
    return _grown(points, np.arange(len(points)), 0, leaf)


def _grown(points: np.ndarray, rows: np.ndarray, first: int, leaf: int) -> Node:
    centre = points[rows[first]]
    far = np.sqrt(((points[rows] - centre) ** 2).sum(axis=1))
    radius = float(far.max())
    node = Node(centre, float(np.sqrt((centre**2).sum())), radius, rows)
    if len(rows) <= leaf or radius == 0:
        return node
    # Farthest-first centres until each point is within half the radius of one.
    nearest, owner, centres = far.copy(), np.zeros(len(rows), np.int64), [first]
    while nearest.max() > radius / 2 and len(centres) < 16:
        at = int(nearest.argmax())
        gap = np.sqrt(((points[rows] - points[rows[at]]) ** 2).sum(axis=1))
        closer = gap < nearest
        nearest[closer], owner[closer] = gap[closer], len(centres)
        centres.append(at)
    for k, at in enumerate(centres):
        own = np.flatnonzero(owner == k)
        if len(own) == len(rows):
            return node
        if len(own):
            node.children.append(_grown(points, rows[own], int(np.searchsorted(own, at)), leaf))
    return node


class _Best:
    """The k best (score, id) of each query, highest score first, ties to the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = np.full((queries, k), -np.inf)
        self.id = np.full((queries, k), np.iinfo(np.int64).max)

    def offer(self, q: np.ndarray, scores: np.ndarray, ids: np.ndarray, floor: np.ndarray) -> None:
        """Take what reaches a query's kth score (equal scores too: their id may win)."""
        least = np.maximum(self.score[q, -1], floor[q])
        at, point = np.nonzero(scores >= least[:, None])
        if not len(at):
            return
        mine = np.unique(at)
        old = q[mine]
        who = np.concatenate([np.repeat(old, self.k), q[at]])
        score = np.concatenate([self.score[old].ravel(), scores[at, point]])
        every = np.concatenate([self.id[old].ravel(), ids[point]])
        order = np.lexsort((every, -score, who))
        who, score, every = who[order], score[order], every[order]
        first = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
        place = np.arange(len(who)) - np.repeat(first, np.diff(np.append(first, len(who))))
        top = place < self.k
        self.score[who[top], place[top]], self.id[who[top], place[top]] = score[top], every[top]


def dual_search(queries: np.ndarray, query_ids: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray, r_tree: Node | None = None) -> _Best:
    """The k best points of each query, at least where they reach the query's ``floor``; ``r_tree`` is the points' tree if there is one."""
    best = _Best(len(queries), k)
    q_tree, r_tree = cover_tree(queries), r_tree or cover_tree(points)
    if q_tree is None or r_tree is None:
        return best

    def bound(a: Node, b: Node) -> float:
        x = float(a.centre @ b.centre) + a.radius * b.norm + b.radius * a.norm + a.radius * b.radius
        return x + 1e-9 * (abs(x) + 1)

    def settle(node: Node) -> float:
        """The worst score that still counts in this query group."""
        if node.children:
            node.worst = min(c.worst for c in node.children)
        else:
            node.worst = float(np.maximum(best.score[node.rows, -1], floor[node.rows]).min())
        return node.worst

    def prepare(node: Node) -> None:
        for c in node.children:
            prepare(c)
        settle(node)

    prepare(q_tree)
    up: dict[int, Node] = {}

    def parents(node: Node) -> None:
        for c in node.children:
            up[id(c)] = node
            parents(c)

    parents(q_tree)
    stack = [(bound(q_tree, r_tree), q_tree, r_tree)]
    while stack:
        most, a, b = stack.pop()
        if most < a.worst:  # equal scores may still win by their id
            continue
        if not a.children and not b.children:
            scores = queries[a.rows] @ points[b.rows].T
            scores = np.where(query_ids[a.rows][:, None] == ids[b.rows][None, :], -np.inf, scores)
            best.offer(a.rows, scores, ids[b.rows], floor)
            node = a
            while node is not None:
                was = node.worst
                if settle(node) == was and node is not a:
                    break
                node = up.get(id(node))
            continue
        if b.children and (not a.children or b.radius >= a.radius):
            pairs = [(bound(a, c), a, c) for c in b.children]
        else:
            pairs = [(bound(c, b), c, b) for c in a.children]
        pairs.sort(key=lambda x: x[0])  # the most promising is walked first
        stack += pairs
    return best


def _integers(column: pa.Array | pa.ChunkedArray, scale: float) -> np.ndarray:
    return np.floor(scale * to_floats(column)[0])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int | None = None, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(``query_id``, ``rank``, ``vec_id``, ``score``): the k rows of highest integer inner product with each query."""
    rows, asked = usable_vectors(vectors, id_col, vector_col), usable_vectors(queries, id_col, vector_col)
    # A query id that repeats asks once, with the least of its vectors.
    asked = asked.groupBy("id").agg(F.min("v").alias("v"))
    kind = rows.schema["v"].dataType.simpleString()
    shape = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    block_rows = block_rows or min(max(shape["n"] // 64, BLOCK_ROWS[0]), BLOCK_ROWS[1])
    # The seeds are a constant number of rows; they only raise the first bounds and give the pivots.
    seeds = rows.orderBy(F.xxhash64("id"), "id").limit(SEEDS).toArrow().combine_chunks()
    seed_ids, seed_points = seeds.column("id").to_numpy(), _integers(seeds.column("v"), scale)
    pivots = seed_points[: min(PIVOTS, max(1, -(-shape["n"] // block_rows)))]

    def homed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = _integers(part.column("v"), scale)
                width = max(x.shape[1], pivots.shape[1])
                x, c = padded(x, width), padded(pivots, width)
                home = ((c**2).sum(axis=1) - 2 * (x @ c.T)).argmin(axis=1)
                far = np.sqrt(((x - c[home]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("v"), pa.array(home.astype(np.int32)), pa.array(far)], names=["id", "v", "home", "far"])

    # Stored, because the home of a row must not change if a task is run again elsewhere.
    dealt = stored(rows.mapInArrow(homed, f"id long, v {kind}, home int, far double"))
    # At most PIVOTS rows.
    stats = {r["home"]: (r["n"], r["far"]) for r in dealt.groupBy("home").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}
    homes = sorted(stats)
    parts = np.array([-(-stats[h][0] // block_rows) for h in homes], np.int64)
    first = np.cumsum(parts) - parts
    centres, radii = pivots[homes], np.array([stats[h][1] for h in homes])

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query once for each block that may hold one of its k best."""
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                q = _integers(part.column("v"), scale)
                width = max(q.shape[1], seed_points.shape[1])
                q, c = padded(q, width), padded(centres, width)
                floor = _floor(q, part.column("id").to_numpy(), padded(seed_points, width), seed_ids, k)
                most = q @ c.T + np.sqrt((q**2).sum(axis=1))[:, None] * radii
                ask, home = np.nonzero(most + 1e-9 * (np.abs(most) + 1) >= floor[:, None])
                copies = parts[home]
                ask, home = np.repeat(ask, copies), np.repeat(home, copies)
                block = first[home] + np.arange(len(home)) - np.repeat(np.cumsum(copies) - copies, copies)
                for cut in range(0, len(ask), 4096):
                    who = ask[cut : cut + 4096]
                    taken = part.take(pa.array(who))
                    yield pa.RecordBatch.from_arrays([taken.column("id"), taken.column("v"), pa.array(block[cut : cut + 4096]), pa.array(floor[who])], names=["id", "v", "block", "floor"])

    if not homes:
        return queries.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    spread = F.array(*[F.lit(int(x)) for x in parts]), F.array(*[F.lit(int(x)) for x in first])
    place = F.array_position(F.array(*[F.lit(h) for h in homes]), F.col("home")).cast("int")
    own = F.pmod(F.xxhash64("id", F.lit(3)), F.element_at(spread[0], place).cast("long"))
    held = dealt.select("id", "v", (F.element_at(spread[1], place) + own).cast("long").alias("block"), F.lit(None).cast("double").alias("floor"), F.lit(0).alias("asks"))
    probing = asked.mapInArrow(sent, f"id long, v {asked.schema['v'].dataType.simpleString()}, block long, floor double")
    probing = probing.select("id", F.col("v").cast(kind).alias("v"), "block", "floor", F.lit(1).alias("asks"))
    both = held.union(probing).repartition(int(parts.sum()), "block").sortWithinPartitions("block", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _walked(batches, scale, k, block_queries)

    near = both.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _walked(batches: Iterator[pa.RecordBatch], scale: float, k: int, block_queries: int) -> Iterator[pa.RecordBatch]:
    """Answers of a stream sorted by block, rows before queries: the rows of one block and some queries are held."""
    block, rows, waiting, tree = None, [], [], None
    points, ids = np.zeros((0, 0)), np.zeros(0, np.int64)

    def answered() -> Iterator[pa.RecordBatch]:
        nonlocal tree, points, ids
        if not waiting or not rows:
            waiting.clear()
            return
        if tree is None:
            table = pa.Table.from_batches(rows)
            points, ids = _integers(table.column("v"), scale), table.column("id").to_numpy()
            tree = cover_tree(points)
        asked = pa.Table.from_batches(waiting)
        waiting.clear()
        q, q_ids = _integers(asked.column("v"), scale), asked.column("id").to_numpy()
        width = max(q.shape[1], points.shape[1])
        q, mine = padded(q, width), padded(points, width)
        if np.abs(q).max() * np.abs(mine).max() * width >= 2.0**53:
            yield _rows(q_ids, *_by_integers(q, q_ids, mine, ids, k))
            return
        own = tree if width == points.shape[1] else None
        best = dual_search(q, q_ids, mine, ids, k, asked.column("floor").to_numpy(), own)
        yield _rows(q_ids, best.score, best.id)

    for batch in batches:
        blocks, asks = batch.column("block").to_numpy(), batch.column("asks").to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], (blocks[1:] != blocks[:-1]) | (asks[1:] != asks[:-1]), [True]])) if len(blocks) else [0]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if blocks[a] != block:
                yield from answered()
                block, tree = blocks[a], None
                rows.clear()
            if not asks[a]:
                rows.append(batch.slice(a, b - a))
                continue
            for at in range(a, b, block_queries):
                waiting.append(batch.slice(at, min(block_queries, b - at)))
                if sum(w.num_rows for w in waiting) >= block_queries:
                    yield from answered()
    yield from answered()


def _floor(queries: np.ndarray, query_ids: np.ndarray, seeds: np.ndarray, seed_ids: np.ndarray, k: int) -> np.ndarray:
    """A score that at least k candidates reach, for each query; minus infinity if the seeds are too few or products are not exact."""
    if len(seeds) <= k or np.abs(queries).max() * np.abs(seeds).max() * queries.shape[1] >= 2.0**53:
        return np.full(len(queries), -np.inf)
    scores = queries @ seeds.T
    scores = np.where(query_ids[:, None] == seed_ids[None, :], -np.inf, scores)
    return np.partition(scores, len(seeds) - k, axis=1)[:, len(seeds) - k]


def _by_integers(queries: np.ndarray, query_ids: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Products beyond 53 bits in whole numbers of any size, without pruning; a score must fit 63 bits."""
    score, found = np.full((len(queries), k), NO_SCORE, np.int64), np.zeros((len(queries), k), np.int64)
    whole, other = [[int(x) for x in row] for row in queries], [[int(x) for x in row] for row in points]
    for i, q in enumerate(whole):
        use = [j for j in range(len(ids)) if ids[j] != query_ids[i]]
        scores = sorted((-sum(x * y for x, y in zip(q, other[j], strict=True)), int(ids[j])) for j in use)[:k]
        for place, (less, who) in enumerate(scores):
            if not -(2**63) < -less < 2**63:
                raise OverflowError(f"the inner product of {query_ids[i]} and {who} does not fit 63 bits")
            score[i, place], found[i, place] = -less, who
    return score, found


def _rows(query_ids: np.ndarray, score: np.ndarray, found: np.ndarray) -> pa.RecordBatch:
    keep = np.isfinite(score) if score.dtype.kind == "f" else score != NO_SCORE
    who = np.repeat(query_ids, score.shape[1]).reshape(score.shape)[keep]
    return pa.RecordBatch.from_arrays([pa.array(who), pa.array(found[keep]), pa.array(score[keep].astype(np.int64))], names=["query_id", "vec_id", "score"])

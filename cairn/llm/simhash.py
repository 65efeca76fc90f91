"""SimHash near-duplicates by a self-join of binary tries.

A fingerprint has a bit set where over half of the document's shingle hashes have it set.
Two fingerprints link if they differ in at most ``budget`` bits. The trie of all
fingerprints is joined with itself: node pairs are walked together, each level adds the
bit in which the two nodes differ, and a pair is dropped once the sum exceeds the budget.

To spread the walk over tasks, the bits are cut into ``budget + r`` blocks. Fingerprints
within the budget agree on at least ``r`` whole blocks, so for each choice of ``r`` blocks
there is a trie with these blocks at its top, and a pair can only meet where the walk has
taken the same path through them. Each such subtrie is one group of one table. No pair is
lost and no partner is capped; subtries with too many fingerprints for a task are split
into parts that are joined part by part. A group returns a spanning forest of its links,
not the pairs themselves.

Defined cases: null and empty texts, and texts without words, have fingerprint zero, which
links like any other; null document ids are kept and count as larger than all others;
repeated rows give repeated results; an empty table gives an empty table; only the named
columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import discard, group_starts, hot_keys, joined_hot, stored, whole_groups, with_parts

#: Distinct fingerprints of one subtrie that a single task joins; larger ones are split.
GROUP_LIMIT = 8192
#: Node pairs of at most this many leaf pairs are finished by comparing the leaves.
LEAF_PAIRS = 64

_UPPER = bytes(range(0x41, 0x5B))
_LOWER = bytes(range(0x61, 0x7B))
_TO_LOWER = bytes.maketrans(_UPPER, _LOWER)


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """The fingerprint of one text; shingles are hashed a block at a time, so memory does not follow the text's length times 64."""
    # bytes.split() without an argument cuts at the six ASCII blanks, 0x09 to 0x0D and 0x20.
    parts = (text or "").encode().translate(_TO_LOWER).split()
    if not parts:
        return 0
    line = b" ".join(parts)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    n = max(1, len(parts) - words + 1)
    firsts, lasts = starts[:n].tolist(), (ends[words - 1 :] if len(parts) >= words else ends[-1:]).tolist()
    h = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 8192):
        ones += _ones(np.array([h(line[a:b], seed) for a, b in zip(firsts[at : at + 8192], lasts[at : at + 8192], strict=True)], dtype="<u8"))
    return _over_half(ones, n)


def _ones(hashes: np.ndarray) -> np.ndarray:
    """In how many hashes each bit is set."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def _over_half(ones: np.ndarray, n: int) -> int:
    return int(sum(1 << int(b) for b in np.flatnonzero(2 * ones > n)))


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of hashes: the bits that over half of them have set."""
    return _over_half(sum((_ones(hashes[at : at + 8192]) for at in range(0, len(hashes), 8192)), np.zeros(64, np.int64)), len(hashes))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, seed: int = 42) -> DataFrame:
    """(``doc_id``, ``fp``): the fingerprint of each whole text as a signed 64-bit integer; no shuffle."""
    source = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), words, seed) for t in batch.column("text")], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    return source.mapInArrow(run, "doc_id long, fp long")


def plan(n: int, budget: int) -> tuple[int, int]:
    """(blocks, blocks that must agree) with the least expected work for ``n`` distinct fingerprints.

    Every choice finds every pair; more agreeing blocks mean smaller subtries and more tables.
    """

    def cost(r: int) -> float:
        tables = len(list(combinations(range(budget + r), r)))
        return tables * n * (1 + 0.002 * n / 2.0 ** (64 * r // (budget + r)))

    r = min(range(1, 5), key=cost)
    return budget + r, r


def _tables(blocks: int, agree: int) -> list[np.ndarray]:
    """For each table, the bit numbers in trie order: the agreeing blocks first."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    own = [list(range(cuts[i], cuts[i + 1])) for i in range(blocks)]
    return [
        np.array([b for i in top for b in own[i]] + [b for i in range(blocks) if i not in top for b in own[i]])
        for top in combinations(range(blocks), agree)
    ]


def _depths(blocks: int, agree: int) -> list[int]:
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    return [sum(cuts[i + 1] - cuts[i] for i in top) for top in combinations(range(blocks), agree)]


def _permuted(fps: np.ndarray, order: np.ndarray) -> np.ndarray:
    """``fps`` with bit ``order[i]`` moved to place ``i`` from the top, so numeric order is trie order."""
    out = np.zeros_like(fps)
    for i, b in enumerate(order):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)) << np.uint64(63 - i)
    return out


class _Forest:
    """Labels of the least index in each component, kept by hooking and pointer jumping over whole arrays."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        label = self.label
        while len(i):
            a, b = label[i], label[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := label[label], label):
                label[:] = up


def trie_links(values: np.ndarray, starts: np.ndarray, depth: int, budget: int) -> np.ndarray:
    """Least linked index for each of ``values`` (sorted within groups that begin at ``starts`` and agree on ``depth`` top bits)."""
    forest = _Forest(len(values))
    lo, hi = starts[:-1], starts[1:]
    big = hi - lo > 1
    # Node pairs are ranges of the sorted values: (first a, end a, first b, end b, differing bits so far, depth).
    stack = [(lo[big], hi[big], lo[big], hi[big], np.zeros(int(big.sum()), np.int64), depth)]
    ones = {}
    while stack:
        al, ah, bl, bh, dist, d = stack.pop()
        if not len(al):
            continue
        if len(al) > 200_000:  # depth first in slices: the frontier stays bounded
            half = len(al) // 2
            stack += [tuple(x[half:] for x in (al, ah, bl, bh, dist)) + (d,), tuple(x[:half] for x in (al, ah, bl, bh, dist)) + (d,)]
            continue
        same = al == bl
        size = (ah - al) * (bh - bl)
        # All leaves below are within the budget: one link for each leaf is enough.
        sure = (64 - d) <= budget - dist
        if sure.any():
            _link_nodes(forest, al[sure], ah[sure], bl[sure], bh[sure])
        small = ~sure & (size <= LEAF_PAIRS)
        if small.any():
            _compare(forest, values, al[small], ah[small], bl[small], bh[small], budget)
        go = ~sure & ~small
        if not go.any():
            continue
        al, ah, bl, bh, dist, same = al[go], ah[go], bl[go], bh[go], dist[go], same[go]
        if d not in ones:
            ones[d] = np.concatenate([[0], np.cumsum((values >> np.uint64(63 - d)) & np.uint64(1), dtype=np.int64)])
        c = ones[d]
        am, bm = ah - (c[ah] - c[al]), bh - (c[bh] - c[bl])
        every = np.ones(len(al), bool)
        # A node joined with itself has one mixed child pair, two different nodes have two.
        children = [(al, am, bl, bm, dist, every), (am, ah, bm, bh, dist, every), (al, am, bm, bh, dist + 1, every), (am, ah, bl, bm, dist + 1, ~same)]
        kept = []
        for xl, xh, yl, yh, far, use in children:
            ok = use & (xh > xl) & (yh > yl) & (far <= budget) & ~((xl == yl) & (xh - xl == 1))
            kept.append((xl[ok], xh[ok], yl[ok], yh[ok], far[ok]))
        stack.append(tuple(np.concatenate(x) for x in zip(*kept, strict=True)) + (d + 1,))
    return forest.label


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All indices of the ranges, and the number of the range of each."""
    n = hi - lo
    which = np.repeat(np.arange(len(lo)), n)
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n), which


def _link_nodes(forest: _Forest, al: np.ndarray, ah: np.ndarray, bl: np.ndarray, bh: np.ndarray) -> None:
    for lo, hi, other in ((al, ah, bl), (bl, bh, al)):
        i, which = _ranges(lo, hi)
        forest.link(i, other[which])


def _compare(forest: _Forest, values: np.ndarray, al: np.ndarray, ah: np.ndarray, bl: np.ndarray, bh: np.ndarray, budget: int) -> None:
    for at in range(0, len(al), 32_768):
        s = slice(at, at + 32_768)
        i, which = _ranges(al[s], ah[s])
        n = (bh[s] - bl[s])[which]
        left = np.repeat(i, n)
        right = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(bl[s][which], n)
        apart = left < right
        left, right = left[apart], right[apart]
        near = np.bitwise_count(values[left] ^ values[right]) <= budget
        forest.link(left[near], right[near])


def links(distinct: DataFrame, budget: int = 4, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(``a``, ``b``) with a < b: for each subtrie a spanning forest of its links, so components are those of all links.

    ``distinct`` holds each fingerprint once in column ``fp`` and should be stored.
    """
    blocks, agree = plan(distinct.count(), budget)
    orders, depths = _tables(blocks, agree), _depths(blocks, agree)

    def keys(order: np.ndarray, depth: int):
        parts = [F.shiftleft(F.shiftrightunsigned("fp", int(b)).bitwiseAND(F.lit(1)), depth - 1 - i) for i, b in enumerate(order[:depth])]
        out = parts[0]
        for p in parts[1:]:
            out = out.bitwiseOR(p)
        return out

    rows = distinct.select(
        "fp", F.posexplode(F.array(*[keys(o, d).cast("long") for o, d in zip(orders, depths, strict=True)])).alias("tab", "value")
    )
    group = ["tab", "value"]
    rows = with_parts(rows, hot_keys(rows, group, group_limit), group)
    # A hot group in s parts becomes the joins of parts (p, q), p <= q.
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("parts").cast("long"))
    rows = rows.withColumn("own", own).select(
        "fp", "tab", "value", F.explode(F.expr("transform(sequence(0, parts - 1), t -> least(own, t) * parts + greatest(own, t))")).alias("part")
    )
    key = [*group, "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in whole_groups(batches, key):
            a, b = _joined(found, key, orders, depths, budget)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    dealt = rows.withColumn("tab", F.col("tab").cast("long")).withColumn("part", F.col("part").cast("long"))
    return dealt.repartition(*key).sortWithinPartitions(*key, "fp").mapInArrow(run, "a long, b long").distinct()


def _joined(found: pa.Table, key: list[str], orders: list[np.ndarray], depths: list[int], budget: int) -> tuple[np.ndarray, np.ndarray]:
    tab = found.column("tab").to_numpy()
    fps = found.column("fp").to_numpy().view(np.uint64)
    starts = group_starts(found, key)
    group = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    a, b = [], []
    for t in np.unique(tab):
        rows = np.flatnonzero(tab == t)
        own, values = group[rows], _permuted(fps[rows], orders[t])
        sort = np.lexsort((values, own))
        own, values, rows = own[sort], values[sort], rows[sort]
        edges = np.append(np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])), len(own))
        label = trie_links(values, edges, depths[t], budget)
        tied = np.flatnonzero(label != np.arange(len(label)))
        x, y = fps[rows[tied]].view(np.int64), fps[rows[label[tied]]].view(np.int64)
        a.append(np.minimum(x, y))
        b.append(np.maximum(x, y))
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(``node``, ``root``): the least node of each node's component, for nodes with an edge.

    Large-star and small-star steps alternate until nothing changes; each round is written
    to the shared folder, so neither lineage nor the driver's memory grows.
    """
    pairs = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    for _ in range(rounds):
        both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = joined_hot(both, least, "u", F.col("v")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = stored(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        old, pairs = pairs, stored(small.select("e.u", "e.v").filter("u <> v").distinct())
        discard(old, large)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, budget: int = 4, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(``doc_id``, ``fp``, ``component_id``) for each row; ``component_id`` is the least document id reachable over links."""
    fps = stored(fingerprints(docs, id_col, text_col, words))
    distinct = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct.select("fp"), budget, group_limit))
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = stored(named)
    tied = joined_hot(named, named.groupBy("root").agg(F.min("least").alias("component_id")), "root", F.col("fp")).select("fp", "component_id")
    return joined_hot(fps, tied, "fp", F.col("doc_id")).select("doc_id", "fp", "component_id")

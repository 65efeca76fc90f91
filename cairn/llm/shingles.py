"""Near-duplicates by the Jaccard similarity of word shingles, exact: every pair of texts at 0.8 or more is linked, no other.

Equal sets are one node. Nodes that SimHash links at ``budget`` bits, and nodes that share a
rare shingle with a neighbour of about their size, are compared first. What these miss is
found by prefix filtering: shingles have one global order, and two sets of similarity t
share a shingle among the first n - ceil(t n) + 1 of each, with enough behind it in both, so
in the last step nodes of one shingle that are not yet in one component meet there. The order puts shingles that are
frequent in a bounded sample last, so common passages bring few sets together; any order
finds every pair, so the sample decides nothing but the work.

Before sets are compared in full, sketches are: shingles are counted in buckets by hash, the
counts are kept by their last bits, and two sets differ in at least the sum of the circular
differences. A pair that differs in more than similarity 0.8 allows is left out, no other.

In the last step a task returns all its pairs while they are no more than its rows. Beyond
that it returns a spanning forest of them, nearest first, so a large group of similar texts
does not cost its square. If each edge of a forest proves similar, the pairs left out are
within components; edges that do not are noted and the step is repeated without them, after
``ROUNDS`` rounds with all pairs that are left.

A shingle that the sample shows to be in more than ``GROUP_LIMIT`` nodes is split into
parts that meet part by part.

Defined cases: texts without words are copies of each other; fewer words than a shingle has
are one shingle; null ids are kept and count as larger than all others; rows that share an
id but not a text have their own component; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from ._shared import discard, group_starts, joined_hot, stored, whole_groups

#: Similarity from which texts are near copies, as a fraction of whole numbers.
OVER, UNDER = 4, 5
#: Documents of the sample that orders shingles, and the frequent shingles that are told apart.
SAMPLE, FREQUENT = 20_000, 50_000
#: Buckets of the sketch that travels with each shingle, with counts modulo 16.
FEW_BUCKETS = 128
#: Bits for a shingle's place in the order, below its set's size in one number.
PLACE_BITS = 31
#: Times the last step returns spanning forests before it returns all pairs.
ROUNDS = 4
#: Nodes of one shingle that are compared in one task; more are split.
GROUP_LIMIT = 8192
#: Texts to compare whose keys are broadcast; beyond it texts are shuffled.
BROADCAST_ASKED = 200_000


def shingle_hashes(text: str | None, words: int = 5) -> np.ndarray:
    """The 64-bit hashes of all shingles of a text, repeats included; A-Z as a-z, words between ASCII blanks."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    line, sizes = b" ".join(parts), np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    n = max(1, len(parts) - words + 1)
    firsts, lasts = (ends - sizes)[:n].tolist(), (ends[words - 1 :] if len(parts) >= words else ends[-1:]).tolist()
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(line[a:b]) for a, b in zip(firsts, lasts, strict=True)), np.uint64, n)


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """The distinct shingle hashes of a text, as signed numbers in order."""
    return np.sort(np.unique(shingle_hashes(text, words)).view(np.int64))


def sketch(grams: np.ndarray, buckets: int, bits: int) -> bytes:
    """The number of shingles in each bucket modulo 2 ** bits, packed."""
    shift = np.uint64(65 - buckets.bit_length())
    counts = np.bincount((grams.view(np.uint64) >> shift).astype(np.int64), minlength=buckets) & ((1 << bits) - 1)
    places = np.arange(8 // bits) * bits
    return (counts.reshape(-1, 8 // bits) << places).sum(axis=1).astype(np.uint8).tobytes()


def _buckets(n: int) -> int:
    """About one bucket for each shingle."""
    return 1 << max(7, round(float(np.log2(max(n, 1)))))


def _counts(packed: np.ndarray, bits: int) -> np.ndarray:
    return ((packed[:, :, None] >> (np.arange(8 // bits, dtype=np.uint8) * bits).astype(np.uint8)) & np.uint8((1 << bits) - 1)).reshape(len(packed), -1)


def _apart(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """At least how many shingles each pair of rows differs in; more buckets are folded to fewer."""
    a, b, top = _counts(a, bits), _counts(b, bits), (1 << bits) - 1
    while a.shape[1] != b.shape[1]:
        fold = lambda x: ((x[:, 0::2] + x[:, 1::2]) & np.uint8(top))
        a, b = (fold(a), b) if a.shape[1] > b.shape[1] else (a, fold(b))
    gap = (a - b) & np.uint8(top)
    return np.minimum(gap, (top + 1 - gap) & np.uint8(top)).sum(axis=1, dtype=np.int64)


def _fit(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (UNDER * n >= OVER * m) & (UNDER * m >= OVER * n)


def _binary(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """A column of byte strings of one width as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    fixed = column.cast(pa.binary(width))
    return np.frombuffer(fixed.buffers()[1], np.uint8)[fixed.offset * width :][: len(fixed) * width].reshape(-1, width)


def _sets(rows: DataFrame, words: int) -> DataFrame:
    """(``node``, ``grams``) of rows with ``node`` and ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py(), words) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.list_(pa.int64()))], names=["node", "grams"])

    return rows.select("node", "text").mapInArrow(run, "node long, grams array<long>")


def _frequent(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Shingles that several documents of a bounded sample hold, in how many, and the sample's share of all."""
    share = min(1.0, SAMPLE / max(1, docs.count()))
    few = docs.filter(F.pmod(F.xxhash64("id", "key", F.lit(3)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select(F.col("key").alias("node"), "text")
    held = _sets(few.dropDuplicates(["node"]), words).select(F.explode("grams").alias("gram")).groupBy("gram").count()
    got = held.filter("count > 2").orderBy(F.desc("count"), "gram").limit(FREQUENT).toArrow()
    grams, counts = got.column("gram").to_numpy(), got.column("count").to_numpy()
    sort = np.argsort(grams)
    return grams[sort], counts[sort], share


def _marked(docs: DataFrame, words: int, known: np.ndarray, counts: np.ndarray) -> DataFrame:
    """(``id``, ``key``, ``node``, ``n``, ``fp``, ``sketch``, ``few``, ``prefix``) of each row; the node is a hash of the set."""

    def one(text: str | None) -> tuple[int, int, int, bytes, bytes, np.ndarray]:
        every = shingle_hashes(text, words)
        grams = np.sort(np.unique(every).view(np.int64))
        n = len(grams)
        node = int(np.uint64(xxhash.xxh64_intdigest(grams.tobytes())).view(np.int64))
        rank = np.zeros(n, np.int64)
        if len(known):
            at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
            rank = np.where(known[at] == grams, counts[at], 0)
        prefix = grams[np.lexsort((grams, rank))][: n - (OVER * n + UNDER - 1) // UNDER + 1]
        return node, n, simhash.majority(every), sketch(grams, _buckets(n), 2), sketch(grams, FEW_BUCKETS, 4), prefix

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(zip(*[one(t.as_py()) for t in batch.column("text")], strict=True)) if batch.num_rows else [[]] * 6
            fps = np.array(found[2], np.uint64).view(np.int64)
            columns = [pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(fps), *[pa.array(x, pa.binary()) for x in found[3:5]], pa.array(found[5], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), *columns], names=["id", "key", "node", "n", "fp", "sketch", "few", "prefix"])

    return docs.mapInArrow(run, "id long, key long, node long, n long, fp long, sketch binary, few binary, prefix array<long>")


def _split(rows: DataFrame, known: np.ndarray, counts: np.ndarray, share: float, limit: int) -> DataFrame:
    """``rows`` with ``parts``: how many parts a shingle is split into, over 1 where the sample shows more than ``limit`` nodes."""
    parts = np.ceil(counts / share / limit).astype(int)
    hot = [(int(g), int(p)) for g, p in zip(known, parts, strict=True) if p > 1]
    if not hot:
        return rows.withColumn("parts", F.lit(1))
    # At most FREQUENT rows.
    table = F.broadcast(rows.sparkSession.createDataFrame(hot, "gram long, parts int"))
    return rows.join(table, "gram", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by shingle and size those whose shingle another one has, with two neighbours that may be similar.

    ``hub`` is the first row of the shingle in a class of sizes, ``prior`` the row before.
    The stream is read once, whatever the size of a group: the last row and hub are carried.
    """
    held = None  # the last row, whose successor is not yet known, and its hub
    for batch in chain(batches, [None]):
        if batch is not None and batch.num_rows == 0:
            continue
        names = ("gram", "node", "at")
        new = [batch.column(c).to_numpy() for c in names] if batch is not None else [np.zeros(0, np.int64)] * 3
        if held is None and batch is None:
            return
        gram, node, size = ([np.concatenate([[h], x]) for h, x in zip(held[0], new, strict=True)] if held else new)
        n = size >> PLACE_BITS
        kind = np.floor(np.log(n) / np.log(UNDER / OVER)).astype(np.int64)
        same = gram[1:] == gram[:-1]
        first = np.concatenate([[True], ~(same & (kind[1:] == kind[:-1]))])
        at = np.maximum.accumulate(np.where(first, np.arange(len(gram)), 0))
        hub, hub_n = node[at], n[at]
        if held:  # rows that continue the carried row's class keep its hub
            mine = at == 0
            hub, hub_n = np.where(mine, held[1][0], hub), np.where(mine, held[1][1], hub_n)
        before = np.concatenate([[held[2] if held else False], same])
        after = np.concatenate([same, [False]])
        end = len(gram) if batch is None else len(gram) - 1
        prior, prior_n = np.concatenate([[held[3][0] if held else 0], node[:-1]]), np.concatenate([[held[3][1] if held else 1], n[:-1]])
        use = np.flatnonzero((before | after)[:end])
        to_hub = (hub != node) & _fit(n, hub_n)
        to_prior = before & (prior != node) & _fit(n, prior_n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(gram[use]), pa.array(node[use]), pa.array(size[use]), pa.array(hub[use], mask=~to_hub[use]), pa.array(prior[use], mask=~to_prior[use])],
            names=["gram", "node", "at", "hub", "prior"],
        )
        held = ((gram[-1], node[-1], size[-1]), (hub[-1], hub_n[-1]), bool(before[-1]), (prior[-1], prior_n[-1]))


def _spanning(up: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places of the edges (``x``, ``y``) that join two trees, in their order; ``up`` holds each node's parent."""
    kept = []
    for at in range(0, len(x), 4096):
        while not np.array_equal(top := up[up], up):
            up[:] = top
        for k in (at + np.flatnonzero(up[x[at : at + 4096]] != up[y[at : at + 4096]])).tolist():
            a, b = int(x[k]), int(y[k])
            while up[a] != a:
                a = int(up[a])
            while up[b] != b:
                b = int(up[b])
            if a != b:
                up[max(a, b)] = min(a, b)
                kept.append(k)
    return np.array(kept, np.int64)


def _rest(every: bool):
    """Pairs of one shingle and part that are in two components and may be similar, or a spanning forest of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in whole_groups(batches, ["gram", "part"], 65_536):
            yield from _rest_of(found, every)

    return run


def _rest_of(found: pa.Table, every: bool) -> Iterator[pa.RecordBatch]:
    gram, part, size, root, node, side = (found.column(c).to_numpy() for c in ("gram", "part", "at", "root", "node", "side"))
    # Groups whose rows are all in one component are done.
    starts = group_starts(found, ["gram", "part"])
    keep = np.repeat(np.minimum.reduceat(root, starts[:-1]) != np.maximum.reduceat(root, starts[:-1]), np.diff(starts))
    if not keep.any():
        return
    gram, part, size, root, node, side = (x[keep] for x in (gram, part, size, root, node, side))
    n, place = size >> PLACE_BITS, size & ((1 << PLACE_BITS) - 1)
    few = _binary(found.column("few"), FEW_BUCKETS // 2)[keep]
    names, where = np.unique(node, return_inverse=True)
    tree, of = np.unique(root, return_inverse=True)
    up, forest = np.arange(len(tree)), False
    no = found.column("no").combine_chunks().filter(pa.array(keep))
    known = np.searchsorted(names, flat := no.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
    known = np.minimum(known, len(names) - 1)
    first = np.repeat(where, no.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    refuted = np.unique((first * len(names) + known)[names[known] == flat])

    def table(at: np.ndarray) -> pa.RecordBatch:
        low, high = names[at // len(names)], names[at % len(names)]
        return pa.RecordBatch.from_arrays([pa.array(low), pa.array(high), pa.array(np.full(len(at), forest))], names=["a", "b", "forest"])

    # Pairs as one number each, with their distance and their components.
    held, count = [np.zeros((0, 4), np.int64)], 0
    i, lag = np.arange(len(gram) - 1), 1
    # Rows of a group are sorted by size, so once a row and the one ``lag`` later do not fit, later ones do not either.
    while len(i):
        i = i[i + lag < len(gram)]
        j = i + lag
        go = (gram[i] == gram[j]) & (part[i] == part[j]) & (UNDER * n[i] >= OVER * n[j])
        i, j = i[go], j[go]
        go = (root[i] != root[j]) & ((side[i] != side[j]) | (side[i] == 2))
        # All that two sets share comes at or after the first shingle they share, so each must have enough from there on.
        least = OVER * (n[i] + n[j])
        go &= ((OVER + UNDER) * (n[i] - place[i]) >= least) & ((OVER + UNDER) * (n[j] - place[j]) >= least)
        a, b = i[go], j[go]
        if forest and len(a):
            go = up[of[a]] != up[of[b]]
            a, b = a[go], b[go]
        for at in range(0, len(a), 65_536):
            x, y = a[at : at + 65_536], b[at : at + 65_536]
            gap = _apart(few[x], few[y], 4)
            near = (OVER + UNDER) * gap <= (UNDER - OVER) * (n[x] + n[y])
            x, y, gap = x[near], y[near], gap[near]
            pair = np.minimum(where[x], where[y]) * len(names) + np.maximum(where[x], where[y])
            new = ~np.isin(pair, refuted)
            held.append(np.stack([pair, gap, of[x], of[y]], axis=1)[new])
            count += int(new.sum())
        lag += 1
        if count > found.num_rows:
            rows = np.concatenate(held)
            rows = rows[np.unique(rows[:, 0], return_index=True)[1]]
            if len(rows) > found.num_rows:
                if every:
                    yield table(rows[:, 0])
                    rows = rows[:0]
                else:
                    forest = True
                    rows = rows[np.argsort(rows[:, 1], kind="stable")]
                    up = np.arange(len(tree))
                    rows = rows[_spanning(up, rows[:, 2], rows[:, 3])]
                    while not np.array_equal(top := up[up], up):
                        up = top
            held, count = [rows], len(rows) if not forest else 0
    rows = np.concatenate(held)
    rows = rows[np.unique(rows[:, 0], return_index=True)[1]]
    if forest:
        rows = rows[np.argsort(rows[:, 1], kind="stable")]
        rows = rows[_spanning(np.arange(len(tree)), rows[:, 2], rows[:, 3])]
    if len(rows):
        yield table(rows[:, 0])


def _possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of ``pairs`` (``a``, ``b``) whose sketches allow the similarity, each once."""
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    both = pairs.distinct().join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left, right = batch.column("sa"), batch.column("sb")
                sizes = np.stack([pc.binary_length(left).to_numpy(), pc.binary_length(right).to_numpy()], axis=1)
                gap = np.zeros(batch.num_rows, np.int64)
                for x, y in np.unique(sizes, axis=0).tolist():
                    at = np.flatnonzero((sizes == (x, y)).all(axis=1))
                    gap[at] = _apart(_binary(left.take(pa.array(at)), x), _binary(right.take(pa.array(at)), y), 2)
                total = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
                yield batch.select(["a", "b"]).filter(pa.array((OVER + UNDER) * gap <= (UNDER - OVER) * total))

    return both.mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """Those of ``pairs`` (``a``, ``b``) whose sets are similar, compared in full."""
    pairs = stored(_possible(pairs, nodes))
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    held = stored(nodes.join(asked, "node", "left_semi").select("node", F.col("first.id").alias("i"), F.col("first.key").alias("k")))
    small = F.broadcast(held) if held.count() <= BROADCAST_ASKED else held
    texts = docs.join(small, F.col("key").eqNullSafe(F.col("k")) & F.col("id").eqNullSafe(F.col("i"))).dropDuplicates(["node"])
    sets = stored(_sets(texts, words))
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("ga")), "a").join(sets.select(F.col("node").alias("b"), F.col("grams").alias("gb")), "b")
    shared = F.size(F.array_intersect("ga", "gb"))
    found = stored(both.filter((OVER + UNDER) * shared >= OVER * (F.size("ga") + F.size("gb"))).select("a", "b"))
    discard(pairs, held, sets)
    return found


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, budget: int = 4, group_limit: int | None = None) -> DataFrame:
    """(``id``, ``key``, ``component``, ``first``) of each row; ``key`` is xxhash64 of the text, ``first`` the least (null, id, key) of its component."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    group_limit = group_limit or GROUP_LIMIT
    known, counts, share = _frequent(docs, words)
    every = stored(_marked(docs, words, known, counts))
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first")
    whole = stored(every.groupBy("node").agg(least, F.min("n").alias("n"), F.min("fp").alias("fp"), F.min("sketch").alias("sketch"), F.min("few").alias("few"), F.min("prefix").alias("prefix")))
    marked = stored(every.select("id", "key", "node"))
    discard(every)
    nodes = stored(whole.drop("prefix"))
    pair = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))

    # By shingles of the prefixes; a set of up to three shingles is similar to none but its equal.
    at = F.shiftleft("n", PLACE_BITS).bitwiseOR(F.col("pos").cast("long")).alias("at")
    grams = whole.filter("n > 3").select("node", "n", F.posexplode("prefix").alias("pos", "gram")).select("gram", at, "node")
    salt = F.pmod(F.xxhash64("node"), F.col("parts").cast("long"))
    grams = _split(grams, known, counts, share, group_limit).withColumn("salt", salt).drop("parts")
    dealt = grams.repartition("gram", "salt").drop("salt").sortWithinPartitions("gram", "at", "node")
    shared = stored(dealt.mapInArrow(_met, "gram long, node long, at long, hub long, prior long"))
    discard(whole)
    stars = shared.select("node", F.explode(F.array("hub", "prior")).alias("of")).filter("of IS NOT NULL").select(*pair("node", "of"))

    # By SimHash: each fingerprint of a spanning forest stands for its least node.
    prints = stored(nodes.filter("n > 0").groupBy("fp").agg(F.min("node").alias("of")))
    forest = simhash.links(prints.select("fp"), budget)
    ends = forest.join(prints.select(F.col("fp").alias("a"), F.col("of").alias("x")), "a").join(prints.select(F.col("fp").alias("b"), F.col("of").alias("y")), "b")
    same = nodes.filter("n > 0").join(prints, "fp").select(*pair("node", "of")).filter("a < b")
    edges = _verified(ends.select(*pair("x", "y")).union(same).union(stars), nodes, docs, words)

    # What is left: nodes of one shingle in different components.
    refuted = None
    for turn in range(ROUNDS + 1):
        roots = simhash.components(edges)
        rooted = nodes.select("node", "few").join(roots, "node", "left").select("node", "few", F.coalesce("root", "node").alias("root"))
        if refuted is None:
            rooted = rooted.withColumn("no", F.array().cast("array<long>"))
        else:
            rooted = rooted.join(refuted.groupBy(F.col("a").alias("node")).agg(F.collect_set("b").alias("no")), "node", "left").withColumn("no", F.coalesce("no", F.array().cast("array<long>")))
        named = _split(shared.select("gram", "node", "at").join(rooted, "node"), known, counts, share, group_limit)
        # A shingle in s parts becomes the meetings of parts (p, q), p <= q; side 2 marks those of a part with itself.
        own = F.pmod(F.xxhash64("node"), F.col("parts").cast("long")).cast("int")
        named = named.withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
        part = (F.least("own", "other") * F.col("parts") + F.greatest("own", "other")).cast("long")
        side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
        named = named.select("gram", part.alias("part"), "at", "node", "root", "few", "no", side.alias("side"))
        dealt = named.repartition("gram", "part").sortWithinPartitions("gram", "part", "at", "node")
        met = stored(dealt.mapInArrow(_rest(turn == ROUNDS), "a long, b long, forest boolean"))
        true = _verified(met.select("a", "b"), nodes, docs, words)
        edges = edges.union(true)
        wrong = stored(met.filter("forest").select("a", "b").distinct().join(true, ["a", "b"], "left_anti"))
        discard(met)
        if wrong.isEmpty():
            break
        refuted = stored(wrong if refuted is None else wrong.union(refuted))

    tied = nodes.select("node", "first").join(simhash.components(edges), "node", "left").select("node", "first", F.coalesce("root", "node").alias("component"))
    tied = stored(tied)
    tied = joined_hot(tied.select("node", "component"), tied.groupBy("component").agg(F.min("first").alias("first")), "component", F.col("node"))
    return joined_hot(marked, tied, "node", F.struct("id", "key")).select("id", "key", "component", "first")

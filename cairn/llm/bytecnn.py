"""A quality classifier over raw bytes: a small convolutional network in numpy.

Bytes are embedded, together with a mark whether the five bytes from there on were seen
earlier in the chunk; learned filters slide over overlapping chunks that cover the whole
document, and each filter is max-pooled within a chunk. A document's features are the
greatest and the mean of its chunks' pooled values; a logistic unit combines them into one
probability.

Training uses a bounded sample: ``per_class`` labelled documents of each class, those with the
least hash of their id among the rows that are not held out, and the whole text of each.
The logistic unit's offset is corrected from the sample's classes to those of all labelled
training rows. Filters are looked up: each byte has its share of each filter's value at each
place of a window, and scoring adds these shares as whole numbers, so a score depends on
the text alone, whatever is scored with it and whatever the processor.

Defined cases: null and empty texts are one chunk of padding and get a score like any
other; labels other than 0 and 1, null ids and null labels are not learned from; a document
with several labels counts with the largest; without both classes in the training rows the
score is their share of label 1 (0.5 without any); a null document id counts as the text ''
in the held-out rule; repeated rows give repeated results; an empty table gives an empty
table; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import least_hashed

CHUNK, STEP = 256, 240
WIDTH, STRIDE, EMBED, FILTERS = 8, 2, 8, 32
#: Bytes that must recur for the mark of a repetition.
GRAM = 5
HELD_OUT_OF = 5


#: Filter values are whole multiples of 1 / SCALE when texts are scored, so sums are exact in any order.
SCALE = 1 << 16
WINDOWS = (CHUNK - WIDTH) // STRIDE + 1
#: Chunks that are worked on at once.
BLOCK = 96


@dataclass
class Net:
    embed: np.ndarray  # 512 x EMBED: bytes without and with the mark of a repetition
    filters: np.ndarray  # WIDTH x EMBED x FILTERS
    bias: np.ndarray  # FILTERS
    out: np.ndarray  # 2*FILTERS
    offset: float
    constant: float | None = None

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        """The tables and the bias in whole numbers."""
        return np.rint(tables(self.embed, self.filters) * SCALE).astype(np.int32), np.rint(self.bias.astype(np.float64) * SCALE).astype(np.int32)


def tables(embed: np.ndarray, filters: np.ndarray) -> np.ndarray:
    """What each byte adds to each filter at each place of a window: 2 x 512 x (WIDTH/2 * FILTERS), even places and odd ones.

    Only elementwise operations in a fixed order, here and in all of this module: matrix
    products differ in the last bits between processors and with the shape of a block.
    """
    out = np.zeros((WIDTH, 512, FILTERS), np.float64)
    for t in range(WIDTH):
        for e in range(EMBED):
            out[t] += embed[:, e, None].astype(np.float64) * filters[t, e].astype(np.float64)
    return np.ascontiguousarray(out.reshape(WIDTH // 2, 2, 512, FILTERS).transpose(1, 2, 0, 3).reshape(2, 512, -1))


def convolved(codes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """chunks x windows x filters: the sum of the table's rows over the bytes of each window."""
    pairs = table[0][codes[:, 0::2]]
    pairs += table[1][codes[:, 1::2]]
    y = pairs[:, :WINDOWS, :FILTERS] + pairs[:, 1 : WINDOWS + 1, FILTERS : 2 * FILTERS]
    for j in range(2, WIDTH // 2):
        y += pairs[:, j : WINDOWS + j, j * FILTERS : (j + 1) * FILTERS]
    return y


def marked(chunks: np.ndarray) -> np.ndarray:
    """Bytes as numbers below 512: over 255 where the next GRAM bytes were seen earlier in the chunk."""
    code = np.zeros((len(chunks), CHUNK - GRAM + 1), np.uint64)
    for i in range(GRAM):
        code |= chunks[:, i : CHUNK - GRAM + 1 + i].astype(np.uint64) << np.uint64(8 * i)
    # Place in the low bits: one plain sort groups equal grams in order of place.
    code = (code << np.uint64(8)) | np.arange(code.shape[1], dtype=np.uint64)
    code.sort(axis=1)
    again = (code[:, 1:] >> np.uint64(8)) == (code[:, :-1] >> np.uint64(8))
    out = chunks.astype(np.int16)
    row, at = np.nonzero(again)
    out[row, (code[row, at + 1] & np.uint64(255)).astype(np.int64)] += 256
    return out


def chunk_view(data: bytes) -> np.ndarray:
    """All chunks of one text as rows; the last one is filled with zero bytes."""
    n = max(1, -(-(len(data) - (CHUNK - STEP)) // STEP))
    buffer = np.zeros((n - 1) * STEP + CHUNK, np.uint8)
    buffer[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(buffer, CHUNK)[::STEP]


def features(net: Net, texts: Iterator[bytes]) -> np.ndarray:
    """Greatest and mean pooled values of each text, a bounded block of chunks at a time."""
    table, bias = net.whole()
    top: list[np.ndarray] = []
    total: list[np.ndarray] = []
    count: list[int] = []
    held: list[np.ndarray] = []
    owner: list[np.ndarray] = []
    rows = 0

    def flush() -> None:
        nonlocal rows
        if rows:
            mine = np.concatenate(owner)
            values = np.maximum(convolved(marked(np.concatenate(held)), table).max(axis=1) + bias, 0)
            edges = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
            for i, high, add in zip(mine[edges], np.maximum.reduceat(values, edges), np.add.reduceat(values.astype(np.int64), edges), strict=True):
                top[i] = np.maximum(top[i], high)
                total[i] += add
        held.clear()
        owner.clear()
        rows = 0

    for i, data in enumerate(texts):
        view = chunk_view(data)
        top.append(np.zeros(FILTERS, np.int64))
        total.append(np.zeros(FILTERS, np.int64))
        count.append(len(view))
        at = 0
        while at < len(view):
            part = view[at : at + BLOCK - rows]
            held.append(part)
            owner.append(np.full(len(part), i))
            rows += len(part)
            at += len(part)
            if rows >= BLOCK:
                flush()
    flush()
    if not count:
        return np.zeros((0, 2 * FILTERS))
    return np.hstack([np.array(top) / SCALE, np.array(total) / np.array(count)[:, None] / SCALE])


def _exp(x: np.ndarray) -> np.ndarray:
    """The exponential from sums and products alone, so it has the same bits on every processor."""
    y, out = x / 256, np.ones_like(x)
    for k in range(8, 0, -1):
        out = 1 + y * out / k
    for _ in range(8):
        out = out * out
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + _exp(-np.clip(x, -30, 30)))


def _weighed(x: np.ndarray, out: np.ndarray, offset: float) -> np.ndarray:
    """``x @ out + offset``, added from the first column to the last."""
    sums = np.full(len(x), float(offset))
    for j in range(x.shape[1]):
        sums += x[:, j] * float(out[j])
    return sums


def scores(net: Net, texts: list[bytes]) -> np.ndarray:
    if net.constant is not None:
        return np.full(len(texts), net.constant)
    return _sigmoid(_weighed(features(net, iter(texts)), net.out, net.offset))


def fit(texts: list[np.ndarray], labels: np.ndarray, share: float, epochs: int = 14, seed: int = 5) -> Net:
    """Train on the chunks of whole texts; ``share`` is the share of label 1 among all training rows."""
    if len(labels) == 0 or labels.min() == labels.max():
        return Net(np.zeros((512, EMBED)), np.zeros((WIDTH, EMBED, FILTERS)), np.zeros(FILTERS), np.zeros(2 * FILTERS), 0.0, constant=share)
    rng = np.random.default_rng(seed)
    p = {
        "embed": np.tile(rng.normal(0, 0.5, (256, EMBED)), (2, 1)),
        "filters": rng.normal(0, 0.2, (WIDTH, EMBED, FILTERS)),
        "bias": np.zeros(FILTERS),
        "out": rng.normal(0, 0.1, 2 * FILTERS),
        "offset": np.zeros(1),
    }
    p["embed"][256:, 0] += 1.0  # both kinds start apart in one direction
    first, second, t = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    codes = [marked(x) for x in texts]
    for epoch in range(epochs):
        rate = 0.01 * (0.5 ** (epoch / 4))
        order = rng.permutation(len(texts))
        for at in range(0, len(order), 32):
            chosen = order[at : at + 32]
            grads = _gradients(p, [codes[i] for i in chosen], labels[chosen].astype(np.float64))
            t += 1
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                p[k] -= rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    seen = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3))
    real = float(np.clip(share, 1e-3, 1 - 1e-3))
    shift = np.log(real / (1 - real)) - np.log(seen / (1 - seen))
    return Net(p["embed"], p["filters"], p["bias"], p["out"], float(p["offset"][0] + shift))


def _pooled(codes: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each chunk's greatest filter values, and the first windows where they are."""
    best, where = np.zeros((len(codes), FILTERS)), np.zeros((len(codes), FILTERS), np.int64)
    for at in range(0, len(codes), BLOCK):
        y = convolved(codes[at : at + BLOCK], table)
        best[at : at + BLOCK] = top = y.max(axis=1)
        where[at : at + BLOCK] = (y == top[:, None]).argmax(axis=1)
    return best, where


def _gradients(p: dict[str, np.ndarray], texts: list[np.ndarray], labels: np.ndarray) -> dict[str, np.ndarray]:
    codes = np.concatenate(texts)
    counts = np.array([len(x) for x in texts])
    edges = np.concatenate([[0], np.cumsum(counts)[:-1]])
    owner = np.repeat(np.arange(len(texts)), counts)
    values, where = _pooled(codes, tables(p["embed"], p["filters"]).astype(np.float32))
    values = np.maximum(values + p["bias"], 0)
    top = np.maximum.reduceat(values, edges)
    mean = np.add.reduceat(values, edges) / counts[:, None]
    x = np.hstack([top, mean])
    error = (_sigmoid(_weighed(x, p["out"], p["offset"][0])) - labels) / len(texts)
    g = {"out": (x * error[:, None]).sum(axis=0) + 1e-4 * p["out"], "offset": np.array([error.sum()])}
    back = error[:, None] * p["out"][None, :]
    dvalue = back[owner, FILTERS:] / counts[owner][:, None] + back[owner, :FILTERS] * (values == top[owner])
    dvalue = dvalue * (values > 0)
    g["bias"] = dvalue.sum(axis=0)
    # Only the window where a filter is greatest gets a gradient; it goes to the table's cell of each byte there.
    took = codes[np.arange(len(codes))[:, None, None], (where * STRIDE)[:, :, None] + np.arange(WIDTH)].astype(np.int64)  # chunk x filter x width
    cell = (np.arange(WIDTH) * 512 + took) * FILTERS + np.arange(FILTERS)[:, None]
    dtable = np.bincount(cell.ravel(), np.repeat(dvalue.ravel(), WIDTH), WIDTH * 512 * FILTERS).reshape(WIDTH, 512, FILTERS)
    g["filters"] = np.stack([(dtable * p["embed"][None, :, e, None]).sum(axis=1) for e in range(EMBED)], axis=1)
    by_cell = np.ascontiguousarray(dtable.transpose(0, 2, 1)).reshape(-1, 512)
    g["embed"] = np.stack([(by_cell * p["filters"][:, e].reshape(-1, 1)).sum(axis=0) for e in range(EMBED)], axis=1)
    return g


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % HELD_OUT_OF == 0


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", per_class: int = 800) -> Net:
    """Fit the network on the bounded sample that the module describes."""
    known = labels.select(labels[id_col].cast("long").alias("id"), labels[label_col].cast("int").alias("y"))
    known = known.filter("id IS NOT NULL AND y IN (0, 1)").filter(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}  # two numbers
    chosen = least_hashed(known, "y", sizes, per_class).select("id", "y")
    share = sizes.get(1, 0) / sum(sizes.values()) if sizes else None

    # Two times per_class ids at most are broadcast, and as many texts come back.
    texts = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    got = texts.join(F.broadcast(chosen), "id").select("id", "y", "text").toArrow()
    rows = sorted(zip(got.column("id").to_pylist(), got.column("y").to_pylist(), [(x or "").encode() for x in got.column("text").to_pylist()], strict=True))
    return fit([chunk_view(x) for _, _, x in rows], np.array([y for _, y, _ in rows], dtype=np.float64), 0.5 if share is None else float(share))


def score(docs: DataFrame, net: Net, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(``doc_id``, ``held_out``, ``score``, ``predicted``) for every row, from the whole text alone; no shuffle."""
    source = docs.select(docs[id_col].alias("doc_id"), held_out(docs[id_col]).alias("held_out"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = scores(net, [(t.as_py() or "").encode() for t in part.column("text")])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(found, pa.float64()), pa.array((found >= threshold).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")

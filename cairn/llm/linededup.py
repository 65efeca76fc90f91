"""Line deduplication against levelled sorted runs of line hashes.

The index is a list of runs. A run is a table of distinct line hashes, bucketed and sorted by
hash, one file a bucket, with the number of documents that hold the line and, for a line
that the run saw first, the document that owns it. A new batch is reduced to its own distinct
hashes, dealt like the runs, and merge-joined with each of them: what no run has is new and
gets an owner, the rest only adds to the counts. It becomes one more run of level 0.
Whenever a level has ``fan`` runs, they are merged in the order of their hashes into one run of
the next level, so a batch meets few runs. Runs are read as they lie: neither an added
batch nor a merge shuffles or sorts the index.

Batches go from the largest document ids to the smallest, so a line's owner is the largest
id that holds it. Afterwards every line that is long and frequent enough is dropped from
all documents but its owner.

Defined cases: null and empty texts are one empty line; a line's key is the line without
``[\\x20\\x09-\\x0D]`` at both ends and with A-Z lower-cased; a null document id counts as one
document below all others; rows that repeat a document id are one document, and all of
them keep the lines it owns; what a row drops is found by its id and its own text; an empty table gives an empty table. Hashes have 128 bits.
Columns other than id, text and those named in ``keep`` are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import delete, joined_hot, shared_dir, stored

_TO_LOWER = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))
_BLANK = b"\x20\x09\x0a\x0b\x0c\x0d"
NO_ID = -(2**63)
RUN = "h1 long, h2 long, docs long, owner long"


def line_hash(line: bytes, min_chars: int) -> bytes | None:
    """The 128-bit hash of a line's key, or None if the key is too short."""
    key = line.strip(_BLANK)
    if len(key) < min_chars:  # fewer bytes than code points asked for
        return None
    if len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key.translate(_TO_LOWER))


def line_hashes(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(``doc``, ``row``, ``h1``, ``h2``): the distinct long lines of each row; ``row`` is a hash of its text."""
    source = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(docs[text_col]).alias("row"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, counts = [], []
            for text in batch.column("text"):
                own = {line_hash(x, min_chars) for x in (text.as_py() or "").encode().split(b"\n")} - {None}
                found += own
                counts.append(len(own))
            h = np.frombuffer(b"".join(found), dtype="<i8").reshape(-1, 2)
            doc, row = (np.repeat(batch.column(c).to_numpy(), counts) for c in ("doc", "row"))
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(row, pa.int64()), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())], names=["doc", "row", "h1", "h2"])

    return source.mapInArrow(run, "doc long, row long, h1 long, h2 long")


ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


@contextmanager
def _sorted_buckets(spark: SparkSession) -> Iterator[None]:
    """While it lasts, plans take the files of a bucketed table as sorted: each bucket of a run is one sorted file."""
    old = spark.conf.get(ORDERED)
    spark.conf.set(ORDERED, "true")
    try:
        yield
    finally:
        spark.conf.set(ORDERED, old)


class LineRuns:
    """Levelled sorted runs, bucketed tables in the shared folder. They stay until ``drop``, so later batches can be added."""

    def __init__(self, spark: SparkSession, fan: int = 2, buckets: int | None = None):
        self.spark, self.fan = spark, fan
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self._paths: dict[str, str] = {}

    def _written(self, run: DataFrame) -> str:
        """``run``, dealt by hash to as many partitions as there are buckets, as a table of one file a bucket."""
        name = f"cairn_run_{uuid.uuid4().hex}"
        self._paths[name] = shared_dir(self.spark)
        run.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", self._paths[name]).saveAsTable(name)
        return name

    def _merged(self, older: str, newer: str) -> str:
        """Two runs as one, by a merge of their buckets: counts are added, the owner is the older run's if it has one."""
        a, b = (self.spark.table(x).select("h1", "h2", F.col("docs").alias(f"docs{i}"), F.col("owner").alias(f"owner{i}")) for i, x in enumerate((older, newer)))
        docs = F.coalesce("docs0", F.lit(0)) + F.coalesce("docs1", F.lit(0))
        out = self._written(a.hint("merge").join(b, ["h1", "h2"], "full").select("h1", "h2", docs.alias("docs"), F.coalesce("owner0", "owner1").alias("owner")))
        self._forget(older, newer)
        return out

    def _forget(self, *names: str) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")  # of an external table: the files stay
            delete(self.spark, [self._paths.pop(name)])

    def merged(self) -> DataFrame:
        """All runs as one row per hash; they become one run."""
        names = [name for level in reversed(self.levels) for name in level]
        if not names:
            return self.spark.createDataFrame([], RUN)
        with _sorted_buckets(self.spark):
            while len(names) > 1:
                names = [self._merged(names[0], names[1]), *names[2:]]
        self.levels = [[] for _ in self.levels[:-1]] + [names]
        return self.spark.table(names[0])

    def add(self, batch: DataFrame) -> None:
        """Add a batch of (``doc``, ``h1``, ``h2``); documents of a batch must not be in earlier ones."""
        own = batch.groupBy("h1", "h2", "doc").agg(F.lit(1)).groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.max("doc").alias("owner"))
        with _sorted_buckets(self.spark):
            for i, name in enumerate(name for level in self.levels for name in level):
                seen = self.spark.table(name).select("h1", "h2", F.lit(True).alias(f"seen{i}"))
                own = own.join(seen.hint("merge"), ["h1", "h2"], "left")
            marks = [F.col(c) for c in own.columns if c.startswith("seen")]
            owner = F.when(F.coalesce(*marks, F.lit(False)), None).otherwise(F.col("owner")) if marks else F.col("owner")
            self.levels = self.levels or [[]]
            self.levels[0].append(self._written(own.select("h1", "h2", "docs", owner.alias("owner"))))
            level = 0
            while len(self.levels[level]) >= self.fan:
                run, *rest = self.levels[level]
                for other in rest:
                    run = self._merged(run, other)
                self.levels[level] = []
                if level + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[level + 1].append(run)
                level += 1

    def drop(self) -> None:
        self._forget(*[name for level in self.levels for name in level])
        self.levels = []


def _cuts(docs: DataFrame, id_col: str, batches: int) -> list[int]:
    share = [i / batches for i in range(1, batches)]
    found = docs.select(F.percentile_approx(F.col(id_col).cast("long"), share, 1000).alias("q")).first()["q"] if share else []
    return sorted(set(found or []))


def frequent_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int, batches: int = 4, runs: LineRuns | None = None) -> DataFrame:
    """(``doc``, ``row``, ``drops``): for each document that loses lines, the 16-byte hashes of these lines.

    With ``runs``, the documents are added to an index that is kept; those added before are
    counted, and as they come first they own the lines they hold.
    """
    lines = stored(line_hashes(docs, id_col, text_col, min_chars))
    cuts = _cuts(docs, id_col, batches)
    index = runs or LineRuns(docs.sparkSession)
    edges = [None, *cuts, None]
    for low, high in reversed(list(zip(edges[:-1], edges[1:], strict=True))):
        part = lines
        if low is not None:
            part = part.filter(F.col("doc") > low)
        if high is not None:
            part = part.filter(F.col("doc") <= high)
        index.add(part)
    frequent = stored(index.merged().filter(F.col("docs") >= min_docs).select("h1", "h2", "owner"))
    if runs is None:
        index.drop()
    pairs = joined_hot(lines, frequent, ["h1", "h2"], F.col("doc")).filter(F.col("doc") != F.col("owner"))
    return pairs.groupBy("doc", "row").agg(F.collect_set(F.struct("h1", "h2")).alias("drops"))


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 40,
    min_docs: int = 5,
    batches: int = 4,
    keep: Sequence[str] = (),
    outputs: Sequence[str] = ("kept_text",),
    runs: LineRuns | None = None,
) -> DataFrame:
    """Each row's id, ``keep`` columns, ``n_lines``, ``n_dropped`` and the ``outputs`` ``kept_text`` and/or ``kept_sha256``."""
    drops = frequent_lines(docs, id_col, text_col, min_chars, min_docs, batches, runs)
    first = [id_col, *keep]
    source = docs.select(*first, docs[text_col].alias("__text"), F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)).alias("__doc"), F.xxhash64(docs[text_col]).alias("__row"))
    joined = source.join(drops.withColumnsRenamed({"doc": "__doc", "row": "__row"}), ["__doc", "__row"], "left").select(*first, "__text", F.col("drops").alias("__drops"))
    schema = T.StructType([*[docs.schema[c] for c in first], T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), *[T.StructField(o, T.StringType()) for o in outputs]])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            n, dropped, out = [], [], {o: [] for o in outputs}
            hashes, at = _drop_sets(batch.column("__drops"))
            for i, text in enumerate(batch.column("__text")):
                lines = (text.as_py() or "").encode().split(b"\n")
                gone = {hashes[k].tobytes() for k in range(at[i], at[i + 1])}
                kept = [x for x in lines if line_hash(x, min_chars) not in gone] if gone else lines
                n.append(len(lines))
                dropped.append(len(lines) - len(kept))
                data = b"\n".join(kept)
                for o in outputs:
                    out[o].append(hashlib.sha256(data).hexdigest() if o == "kept_sha256" else data.decode())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in first], pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), *[pa.array(out[o], pa.string()) for o in outputs]],
                names=[*first, "n_lines", "n_dropped", *outputs],
            )

    return joined.mapInArrow(run, schema)


def _drop_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all rows as pairs of integers, and where each row's begin."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    h = np.stack([flat.field("h1").to_numpy(zero_copy_only=False), flat.field("h2").to_numpy(zero_copy_only=False)], axis=1).astype("<i8")
    return np.ascontiguousarray(h), np.concatenate([[0], np.cumsum(sizes)])

"""What several operators of this subpackage need: the shared folder, lineage cuts, sorted group streams."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which every executor sees.

    The setting is required on a cluster. Only in a local session, where driver and executors
    are one process, an absent setting is set to a folder that goes with the process.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="cairn-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    _MADE.append(f"{base.rstrip('/')}/cairn-{uuid.uuid4().hex}")
    return _MADE[-1]


_MADE: list[str] = []


def delete(spark: SparkSession, paths: Iterable[str]) -> int:
    """Delete folders that ``shared_dir`` gave."""
    conf, n = spark.sparkContext._jsc.hadoopConfiguration(), 0
    for name in list(paths):
        _MADE.remove(name)
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n


def release(spark: SparkSession, *results: DataFrame) -> int:
    """Delete the intermediate tables that ``results`` read (all of this process if none is given), once they are written."""
    if not results:
        return delete(spark, _MADE)
    read = {f"/{part}/" for r in results for f in r.inputFiles() for part in f.split("/") if part.startswith("cairn-")}
    return delete(spark, [m for m in _MADE if f"/{m.rsplit('/', 1)[1]}/" in read])


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage ends there and no pass is repeated."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete ``stored`` tables that no later step reads."""
    for table in tables:
        delete(table.sparkSession, [table._stored_at])


def to_floats(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A list column as a float64 matrix and a mask of usable rows.

    Unusable: null, empty, holding a null or a non-finite component. Shorter vectors are
    filled with zeros up to the longest of the batch.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return np.zeros((0, 0)), np.zeros(0, bool)
    sizes = np.asarray(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    flat = column.flatten()
    values = np.asarray(flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False), dtype=np.float64)
    width = int(sizes.max()) if n else 0
    out = np.zeros((n, width))
    filled = np.arange(width)[None, :] < sizes[:, None]
    out[filled] = values
    good = (sizes > 0) & np.isfinite(out).all(axis=1)
    return out, good


def usable_vectors(df: DataFrame, id_col: str, vector_col: str, nonzero: bool = False) -> DataFrame:
    """(``id``, ``v``) of rows with an id and a vector without null or non-finite components (and not all zero); doubles stay doubles."""
    kind = df.schema[vector_col].dataType.simpleString()
    v = F.col(vector_col) if kind in ("array<float>", "array<double>") else F.col(vector_col).cast("array<double>")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    if nonzero:
        good &= F.exists("v", lambda x: x != 0)
    return df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & (F.size("v") > 0) & good)


def padded(matrix: np.ndarray, width: int) -> np.ndarray:
    if matrix.shape[1] >= width:
        return matrix
    return np.hstack([matrix, np.zeros((matrix.shape[0], width - matrix.shape[1]))])


def whole_groups(batches: Iterable[pa.RecordBatch], keys: Sequence[str], least: int = 4096) -> Iterator[pa.Table]:
    """Cut a stream that is sorted by integer ``keys`` into tables that hold whole groups only.

    Each table has at least ``least`` rows (but the last) and at most that plus one batch plus
    one group, so memory follows the largest group, which callers bound by splitting hot keys.
    """
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        table = pa.Table.from_batches(held)
        cols = [table.column(k).to_numpy() for k in keys]
        last = 0
        same = np.ones(rows, bool)
        for c in cols:
            same &= c == c[-1]
        last = rows - int(np.argmin(same[::-1])) if not same.all() else 0
        if last:
            yield table.slice(0, last)
            held = table.slice(last).to_batches()
            rows -= last
    if rows:
        yield pa.Table.from_batches(held)


def group_starts(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Offsets of the groups in a table sorted by ``keys``, with the row count at the end."""
    n = table.num_rows
    new = np.zeros(n, bool)
    if n:
        new[0] = True
    for k in keys:
        c = table.column(k).to_numpy()
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), n)


def hot_keys(df: DataFrame, keys: Sequence[str], limit: int) -> DataFrame | None:
    """Keys with over ``limit`` rows and the number of parts each is to be split into; None if there are none.

    There are at most rows/limit of them. The table is stored, so that its count is known
    before a join on it is planned.
    """
    parts = F.ceil(F.col("n") / F.lit(limit)).cast("int").alias("parts")
    hot = stored(df.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > limit).select(*keys, parts))
    return None if hot.isEmpty() else hot


def with_parts(df: DataFrame, hot: DataFrame | None, keys: Sequence[str], most: int = 10_000) -> DataFrame:
    """``df`` with the column ``parts`` (1 for keys that are not hot); a checked size decides on the broadcast."""
    if hot is None:
        return df.withColumn("parts", F.lit(1))
    small = F.broadcast(hot) if hot.count() <= most else hot
    return df.join(small, list(keys), "left").withColumn("parts", F.coalesce("parts", F.lit(1)))


def joined_hot(big: DataFrame, small: DataFrame, keys: Sequence[str] | str, salt: Column, limit: int = 1_000_000, how: str = "inner") -> DataFrame:
    """``big`` joined with ``small`` (one row a key), where one key may hold a large part of ``big``.

    Rows of a key with over ``limit`` rows are dealt by ``salt`` over parts, and its row of
    ``small`` goes to each part. Counting is a map-side aggregation of the key alone.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    hot = hot_keys(big.select(*keys), keys, limit)
    if hot is None:
        return big.join(small, keys, how)
    left = with_parts(big, hot, keys).withColumn("__part", F.pmod(F.xxhash64(salt, F.lit(9)), F.col("parts").cast("long"))).drop("parts")
    right = with_parts(small, hot, keys).withColumn("__part", F.explode(F.expr("sequence(0L, parts - 1L)"))).drop("parts")
    return left.join(right, [*keys, "__part"], how).drop("__part")


def least_hashed(df: DataFrame, by: str, sizes: dict, most: int, id_col: str = "id") -> DataFrame:
    """The ``most`` rows of each class with the least hashes of their ids; ``sizes`` has the rows of each class.

    Hashes are uniform, so all but about twice as many rows of a class are left out before
    anything is moved: what is ranked is bounded whatever the size of a class.
    """
    share = F.lit(1.0)
    for value, n in sizes.items():
        share = F.when(F.col(by) == F.lit(value), F.lit(min(1.0, (2.0 * most + 100) / max(n, 1)))).otherwise(share)
    place = F.pmod(F.xxhash64(id_col), F.lit(1 << 40)) / F.lit(float(1 << 40))
    order = Window.partitionBy(by).orderBy("__at", id_col)
    few = df.withColumn("__at", place).filter(F.col("__at") < share)
    return few.withColumn("__k", F.row_number().over(order)).filter(F.col("__k") <= most).drop("__at", "__k")

"""Mixing sources to target weights by Poisson replication, in DataFrame operations only.

A source with size n and target weight w gets the mean repetition rate w * N / n, N being
the size of all sources. Each document's copy count inverts the Poisson distribution of
that mean (above 500 the sum of equal parts) at a uniform number that is a hash of seed and document id, so expected totals
meet the weights, any subset of documents can be recomputed alone, and no state is shared.
Each document is exploded by its count, and the copies are put in the global order of a
hash of document id and copy number by a range-partitioned sort.

Defined cases: a null source is a source of its own; a null document id is hashed as an
empty text; a null text has size zero where size is measured on texts; sources without a
target weight get none of the documents when ``weights`` is given; rows that repeat an id get the
same count; an empty table gives an empty table; further columns named in ``keep`` are
carried along.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import stored

#: Sources up to this number are broadcast (each holds one array of thresholds); beyond it the join is left to Spark.
BROADCAST_SOURCES = 2000
#: Beyond it, rows of a source that are joined in one task; larger sources are split.
SOURCE_ROWS = 1_000_000
#: Hexadecimal digits of the MD5 that make the uniform number: 52 bits, exact in a double.
DIGITS = 13
#: Rates above this are the sum of equal parts, each a Poisson count of its own: exp(-rate) stays far above the smallest double.
PART_RATE = 500.0


def uniform(key: Column, seed: int, part: Column | None = None) -> Column:
    """A number in [0, 1) from the hash of seed and key; parts of a rate after the first have their own."""
    own = F.lit(f"{seed}:") if part is None else F.when(part == 0, f"{seed}:").otherwise(F.concat(F.lit(f"{seed}."), part.cast("string"), F.lit(":")))
    text = F.concat(own, F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, DIGITS), 16, 10).cast("long").cast("double") / F.lit(float(16**DIGITS))


def thresholds(rate: Column, most: Column) -> Column:
    """P(X <= k) of the Poisson distribution for k = 0 .. most."""
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.array(F.exp(-rate)).alias("all"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        c = acc["c"] + p
        return F.struct(p.alias("p"), c.alias("c"), F.concat(acc["all"], F.array(c)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), most), start, step, lambda acc: acc["all"])


def rates(docs: DataFrame, source_col: str = "source", weights: Mapping[str | None, float] | None = None, power: float = 0.5) -> DataFrame:
    """(source, ``n``, ``rate``, ``parts``, ``cdf``) per source, from counts over all documents.

    Target weights are ``weights``, or else proportional to n ** power. ``cdf`` is that of
    rate / parts, with parts of at most ``PART_RATE``; the tail beyond it is below 1e-12.
    """
    sizes = stored(docs.groupBy(F.col(source_col).alias("__source")).agg(F.count("*").alias("n")))
    if weights is None:
        sizes = sizes.withColumn("__w", F.sqrt(F.col("n").cast("double")) if power == 0.5 else F.pow(F.col("n").cast("double"), F.lit(power)))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "k string, w double")
        sizes = sizes.join(F.broadcast(given), F.col("__source").cast("string").eqNullSafe(F.col("k")), "left").select("__source", "n", F.coalesce("w", F.lit(0.0)).alias("__w"))
    totals = sizes.agg(F.sum("n").alias("N"), F.sum("__w").alias("W")).first()  # two numbers
    total, weight = float(totals["N"] or 0), float(totals["W"] or 0) or 1.0
    rate = F.col("__w") / F.lit(weight) * F.lit(total) / F.col("n")
    sized = sizes.withColumn("rate", rate).withColumn("parts", F.greatest(F.ceil(F.col("rate") / F.lit(PART_RATE)), F.lit(1)).cast("int"))
    one = F.col("rate") / F.col("parts")
    most = F.ceil(one + F.lit(10.0) * F.sqrt(one) + F.lit(12.0)).cast("int")
    return sized.withColumn("cdf", thresholds(one, most)).select("__source", "n", "rate", "parts", "cdf")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    weights: Mapping[str | None, float] | None = None,
    power: float = 0.5,
    seed: int = 17,
    keep: Sequence[str] = (),
    copy_col: str = "copy",
    order_col: str = "shuffle_key",
) -> DataFrame:
    """One row per copy: ``id_col``, ``source_col``, ``keep``, ``copy`` from 0 and ``shuffle_key``, sorted by the key."""
    per_source = rates(docs, source_col, weights, power)
    first = list(dict.fromkeys([id_col, source_col, *keep]))
    rows, same = docs.select(*first), F.col(source_col).eqNullSafe(F.col("__source"))
    if per_source.count() <= BROADCAST_SOURCES:  # counted over all documents above
        rows = rows.join(F.broadcast(per_source.select("__source", "parts", "cdf")), same)
    else:
        # Rows of large sources are dealt over several tasks by a hash of their ids.
        large = per_source.filter(F.col("n") > SOURCE_ROWS).select(F.col("__source").alias("__large"), F.ceil(F.col("n") / F.lit(SOURCE_ROWS)).alias("__tasks"))
        spread = lambda df, key: df.join(large, key.eqNullSafe(F.col("__large")), "left").withColumn("__tasks", F.coalesce("__tasks", F.lit(1))).drop("__large")
        dealt = spread(rows, F.col(source_col)).withColumn("__task", F.pmod(F.xxhash64(id_col), F.col("__tasks"))).drop("__tasks")
        each = spread(per_source, F.col("__source")).withColumn("__of", F.explode(F.expr("sequence(0L, __tasks - 1L)"))).select("__source", "parts", "cdf", "__of")
        rows = dealt.join(each, same & (F.col("__task") == F.col("__of"))).drop("__task", "__of")
    rows = rows.withColumn("__us", F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: uniform(F.col(id_col), seed, p)))
    rows = rows.withColumn("__n", F.aggregate("__us", F.lit(0), lambda n, u: n + F.size(F.filter("cdf", lambda c: c <= u))))
    rows = rows.filter("__n > 0").select(*first, F.explode(F.sequence(F.lit(0), F.col("__n") - 1)).alias(copy_col))
    key = F.md5(F.concat(F.lit(f"order {seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.col(copy_col).cast("string")).cast("binary"))
    return rows.withColumn(order_col, key).orderBy(order_col)


def mix_sql(seed: int = 17) -> str:
    """DuckDB SQL for ``mix`` with its defaults over ``documents``."""
    return f"""
WITH RECURSIVE sizes AS (SELECT source, count(*) AS n, sqrt(count(*)::DOUBLE) AS w FROM documents GROUP BY source),
totals AS (SELECT sum(n)::DOUBLE AS total, sum(w) AS weight FROM sizes),
rated AS (SELECT source, w / weight * total / n AS rate FROM sizes, totals),
cdf(source, rate, k, p, c) AS (
  SELECT source, rate, 0, exp(-rate), exp(-rate) FROM rated
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM cdf WHERE k < ceil(rate + 10.0 * sqrt(rate) + 12.0)),
drawn AS (
  SELECT doc_id, source, ('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, {DIGITS}))::BIGINT::DOUBLE / {16**DIGITS}.0 AS u FROM documents),
counted AS (
  SELECT d.doc_id, d.source, (SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM d.source AND cdf.c <= d.u) AS n FROM drawn d),
copies AS (SELECT doc_id, source, unnest(range(n))::INTEGER AS copy FROM counted WHERE n > 0)
SELECT doc_id, source, copy, md5('order {seed}:' || coalesce(doc_id::VARCHAR, '') || ':' || copy::VARCHAR) AS shuffle_key FROM copies"""

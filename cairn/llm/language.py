"""Language identification by Bayesian fusion of evidence.

For each document the logarithms of four kinds of evidence are added: the text under a
byte-trigram model of each language, the language that the markup (or the table) declares,
the address suffix, and a prior of the host. Host priors are smoothed level by level, from
all documents over the site (the host's last two labels) to the host; they and the
tables of declared languages and suffixes are grouped counts over all documents, whose
language is at that point the one that the text alone suggests.

The text model is fitted on a bounded sample: ``per_language`` documents of each declared
language, those with the least hashes of their ids. Languages are the declared ones of at least
``least_documents`` rows, however many rows other languages have. Rows that declare another
language are rejected, not judged among the languages that have a model.

A document is rejected if its text has no trigram of letters, if no language reaches
``confidence``, or if its trigrams fit every language worse than an even distribution over
all trigrams would (random letters, languages without a model). Numbers, addresses and keys in a text do not count.

Defined cases: null and empty texts are rejected (language ``und``); missing evidence is
left out of the sum; null hosts share one prior; a null id is kept; repeated rows give
repeated results; a table without declared languages rejects every row; an empty table
gives an empty table; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import joined_hot, least_hashed, stored

BITS = 15
#: Hosts up to this number are broadcast; beyond it the join is left to Spark.
BROADCAST_HOSTS = 50_000
#: Rows of a host that are joined in one task beyond it; larger hosts are split.
HOST_ROWS = 1_000_000
#: Declared languages or suffixes up to this number are literals of the plan; more are joined.
LITERALS = 256
#: A-Z become a-z; digits, signs and blanks become one blank, so numbers and addresses say nothing of a language.
_LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
#: Least mean log likelihood of a trigram, against an even distribution, of a text that is language at all.
LEAST_FIT = 0.0
#: Rows from which a declared language has a text model.
LEAST_DOCUMENTS = 20


def trigrams(data: bytes) -> np.ndarray:
    """The hashed byte trigrams of a text's letters, words a blank apart."""
    raw = np.frombuffer(data.translate(_LETTERS), np.uint8)
    raw = raw[np.concatenate([[True], (raw[1:] != 0x20) | (raw[:-1] != 0x20)])] if len(raw) else raw
    raw = raw.astype(np.uint32)
    if len(raw) < 3:
        return np.zeros(0, np.uint32)
    return (((raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]) * np.uint32(2654435761)) >> np.uint32(32 - BITS)


@dataclass
class TextModel:
    languages: list[str]
    logs: np.ndarray  # 2**BITS x languages, float32

    def score(self, data: bytes, block: int = 1 << 20) -> tuple[np.ndarray, int]:
        """Log likelihood under each language, less that of an even distribution, and the number of trigrams."""
        total, n = np.zeros(len(self.languages)), 0
        for at in range(0, max(1, len(data)), block):
            g = trigrams(data[at : at + block + 2])
            counts = np.bincount(g, minlength=1 << BITS) if len(g) > 4096 else None
            if counts is None:
                total += self.logs[g].sum(axis=0, dtype=np.float64)
            else:
                total += counts @ self.logs
            n += len(g)
        return total, n


def declared_in(html: Column) -> Column:
    """The primary language that the ``html`` element declares, lower-cased; null if none."""
    found = F.lower(F.regexp_extract(F.coalesce(html, F.lit("")), r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,3})""", 1))
    return F.when(found != "", found)


def host_in(url: Column) -> Column:
    found = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#:]*)", 1))
    return F.when(found != "", found)


def evidence(rows: DataFrame, id_col: str, text_col: str, declared: Column | None = None, url_col: str | None = None, host: Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """(``id``, ``text``, ``declared``, ``host``, ``site``, ``suffix``) from whichever columns there are, and ``carried``, a struct of the columns ``keep``."""
    none = F.lit(None).cast("string")
    host = host_in(F.col(url_col)) if url_col else host if host is not None else none
    labels = F.split(host, r"\.")
    site = F.when(F.size(labels) > 1, F.array_join(F.slice(labels, -2, 2), "."))
    suffix = F.when(F.size(labels) > 1, F.element_at(labels, -1))
    return rows.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), (none if declared is None else F.lower(declared)).alias("declared"),
        host.cast("string").alias("host"), site.alias("site"), suffix.alias("suffix"), F.struct(F.lit(0).alias("__"), *[F.col(c) for c in keep]).alias("carried"),
    )


def fit_text(seen: DataFrame, per_language: int = 1000, least_documents: int = LEAST_DOCUMENTS) -> TextModel:
    """Fit the trigram model on the bounded sample that the module describes."""
    sizes = seen.filter("declared IS NOT NULL").groupBy("declared").count().filter(F.col("count") >= least_documents).collect()
    languages = sorted(r["declared"] for r in sizes)
    if not languages:
        return TextModel([], np.zeros((1 << BITS, 0), np.float32))
    place = F.array_position(F.array(*[F.lit(x) for x in languages]), F.col("declared")).cast("int") - 1
    ids = seen.filter(F.col("declared").isin(languages) & F.col("id").isNotNull()).select("id", "declared")
    ids = least_hashed(ids, "declared", {r["declared"]: r["count"] for r in sizes}, per_language).select("id").distinct()
    texts = seen.select("id", "text", place.alias("place")).filter("place >= 0").join(F.broadcast(ids), "id", "left_semi")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(languages), 1 << BITS), np.int64)
        for batch in batches:
            for k, text in zip(batch.column("place").to_pylist(), batch.column("text"), strict=True):
                counts[k] += np.bincount(trigrams((text.as_py() or "").encode()), minlength=1 << BITS)
        k, g = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(g.astype(np.int32)), pa.array(counts[k, g])], names=["place", "gram", "n"])

    got = texts.select("place", "text").mapInArrow(counted, "place int, gram int, n long").groupBy("place", "gram").agg(F.sum("n").alias("n")).toArrow()
    counts = np.full((1 << BITS, len(languages)), 0.05)
    counts[got.column("gram").to_numpy(), got.column("place").to_numpy()] += got.column("n").to_numpy()
    logs = np.log(counts / counts.sum(axis=0)) + BITS * np.log(2)
    return TextModel(languages, logs.astype(np.float32))


def text_scores(seen: DataFrame, model: TextModel) -> DataFrame:
    """``seen`` without its text, with ``ll`` (a list in the order of the languages) and ``grams``; no shuffle."""
    kept = ["id", "declared", "host", "site", "suffix", "carried"]
    source = seen.select(*kept, "text")
    kind, carried = seen.schema["id"].dataType.simpleString(), seen.schema["carried"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.score((t.as_py() or "").encode()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array([x.tolist() for x, _ in found], pa.list_(pa.float64())), pa.array([n for _, n in found], pa.int64())],
                names=[*kept, "ll", "grams"],
            )

    return source.mapInArrow(run, f"id {kind}, declared string, host string, site string, suffix string, carried {carried}, ll array<double>, grams long")


def _counts(languages: int) -> list[Column]:
    return [F.count_if(F.col("top") == i + 1).alias(f"n{i}") for i in range(languages)]


def _smoothed(scored: DataFrame, keys: list[str], up: Column, languages: int, weight: float) -> DataFrame:
    """Shares of each language among the rows of a key, drawn to the parent's shares ``up`` by ``weight`` rows."""
    counts = scored.filter("top IS NOT NULL").groupBy(*keys).agg(*_counts(languages))
    n = reduce(lambda a, b: a + b, [F.col(f"n{i}") for i in range(languages)])
    return counts.withColumn("up", up).select(*keys, F.array(*[(F.col(f"n{i}") + weight * F.col("up")[i]) / (n + weight) for i in range(languages)]).alias("share"))


def identify(
    rows: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    declared: Column | None = None,
    url_col: str | None = None,
    host: Column | None = None,
    temper: float = 0.25,
    weight: float = 20.0,
    confidence: float = 0.5,
    per_language: int = 1000,
    keep: Sequence[str] = (),
) -> DataFrame:
    """(``id_col``, ``language``, ``confidence``, ``text_language``, ``kept``) and the columns ``keep`` for every row."""
    seen = evidence(rows, id_col, text_col, declared, url_col, host, keep)
    carried = [F.col(f"carried.{c}") for c in keep]
    model = fit_text(seen, per_language)
    names, count = model.languages, len(model.languages)
    if not count:
        und = F.lit("und")
        return seen.select(F.col("id").alias(id_col), und.alias("language"), F.lit(0.0).alias("confidence"), und.alias("text_language"), F.lit(False).alias("kept"), *carried)
    scored = text_scores(seen, model)
    scored = scored.withColumn("top", F.when(F.col("grams") > 0, F.array_position("ll", F.array_max("ll"))).cast("int"))
    scored = stored(scored)  # a few numbers a document, read for the counts and again for the sum

    total = scored.filter("top IS NOT NULL").agg(*_counts(count)).first()  # one number a language
    general = F.array(*[F.lit((total[f"n{i}"] + 1.0) / (sum(total) + count)) for i in range(count)])
    sites = _smoothed(scored.filter("site IS NOT NULL"), ["site"], general, count, weight).withColumnRenamed("share", "site_share")
    counted = scored.filter("host IS NOT NULL").join(sites, "site", "left")
    # The site's share is the same in all rows of a host, so it is carried as part of the key.
    hosts = stored(_smoothed(counted, ["host", "site_share"], F.coalesce("site_share", general), count, weight).select("host", "share"))
    few_hosts = hosts.count() <= BROADCAST_HOSTS

    def likelihood(col: str) -> tuple[DataFrame, int]:
        """(``col``, ``logs``) of every declared language or suffix with the logs of P(value | language), and their number."""
        found = stored(scored.filter(F.col(col).isNotNull() & F.col("top").isNotNull()).groupBy(col).agg(*_counts(count)))
        sums = found.agg(F.count("*").alias("rows"), *[F.sum(f"n{i}").alias(f"n{i}") for i in range(count)]).first()
        logs = [F.log((F.col(f"n{i}") + 1.0) / F.lit((sums[f"n{i}"] or 0) + sums["rows"] + 1.0)) for i in range(count)]
        return found.select(col, F.array(*logs).alias("logs")), sums["rows"]

    def added(rows: DataFrame, col: str, name: str) -> DataFrame:
        """``rows`` with the logs of ``col``: few values as literals, more by a join."""
        table, n = likelihood(col)
        none = F.array(*[F.lit(0.0)] * count)
        if n > LITERALS:
            table = table.withColumnRenamed("logs", name)
            return rows.join(F.broadcast(table) if n <= BROADCAST_HOSTS else table, col, "left").withColumn(name, F.coalesce(name, none))
        pairs = [x for r in table.collect() for x in (F.lit(r[col]), F.array(*[F.lit(v) for v in r["logs"]]))]
        return rows.withColumn(name, F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(col)), none) if pairs else none)

    if few_hosts:
        joined = scored.join(F.broadcast(hosts), "host", "left")
    else:  # a host may hold a large part of all rows, and rows without a host need no join
        joined = joined_hot(scored.filter("host IS NOT NULL"), hosts, "host", F.struct("id", "grams"), HOST_ROWS, "left")
        joined = joined.unionByName(scored.filter("host IS NULL").withColumn("share", F.lit(None).cast("array<double>")))
    joined = joined.withColumn("share", F.coalesce("share", general))
    joined = added(added(joined, "declared", "__d"), "suffix", "__s")
    logs = [F.lit(temper) * F.col("ll")[i] + F.log(F.col("share")[i]) + F.col("__d")[i] + F.col("__s")[i] for i in range(count)]
    joined = joined.withColumn("logs", F.array(*logs)).withColumn("most", F.array_max("logs"))
    joined = joined.withColumn("sure", F.lit(1.0) / F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("most"))))
    array = F.array(*[F.lit(x) for x in names])
    modelled = F.coalesce(F.col("declared").isin(names), F.lit(True))
    fits = modelled & (F.col("grams") > 0) & (F.array_max("ll") > F.lit(LEAST_FIT) * F.col("grams"))
    kept = fits & (F.col("sure") >= confidence)
    return joined.select(
        F.col("id").alias(id_col),
        F.when(fits, F.element_at(array, F.array_position("logs", F.col("most")).cast("int"))).otherwise("und").alias("language"),
        F.when(fits, F.col("sure")).otherwise(0.0).alias("confidence"),
        F.when(F.col("top").isNull(), "und").otherwise(F.try_element_at(array, "top")).alias("text_language"),
        kept.alias("kept"),
        *carried,
    )

"""The corpus pipeline: five stages, each on all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next one's documents. All but the last return the columns of
``documents``: doc_id, text, lang, source, n_chars.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import bpe, language, linededup, poisson_mix, shingles
from cairn.llm._shared import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not identified go; the others carry the language found.

    Rows are matched by id and by all that decides (text, declared language, source), so
    rows that share an id, or have none, follow their own decision.
    """
    keyed = docs.select(*COLUMNS).withColumn("__key", F.xxhash64("text", "lang", "source"))
    found = language.identify(keyed, declared=F.col("lang"), host=F.col("source"), keep=("__key",)).filter("kept")
    found = found.groupBy(F.col("doc_id").alias("id"), F.col("__key").alias("key")).agg(F.min("language").alias("found"))
    kept = keyed.join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("__key") == F.col("key")))
    return kept.select("doc_id", "text", F.col("found").alias("lang"), "source", "n_chars")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 code points that 5 documents hold stay in the document of the largest id; ``n_chars`` follows the text."""
    out = linededup.dedup_lines(docs, keep=("lang", "source"), outputs=("kept_text",))
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by near copies (five-word shingles, Jaccard 0.8 or more) one row of the least id stays; rows without id all stay."""
    found = shingles.near_copies(docs, words=5, budget=4).filter("NOT first.none AND id = first.id AND key = first.key")
    first = found.select(F.col("id").alias("doc_id"), F.col("key").alias("__key")).distinct()
    rows = docs.select(*COLUMNS).withColumn("__key", F.xxhash64("text"))
    kept = rows.join(first, ["doc_id", "__key"], "left_semi").dropDuplicates(["doc_id", "__key"]).select(*COLUMNS)
    return kept.union(rows.filter("doc_id IS NULL").select(*COLUMNS))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents in shuffled order, sources weighted by the square root of their size."""
    return poisson_mix.mix(docs, keep=("text", "lang", "n_chars")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every copy, with the digests of ids and decoded bytes."""
    return bpe.encode(
        docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
        keep=("lang", "source"), outputs=("n_tokens", "ids", "ids_sha256", "decoded_sha256"),
    )


STAGES = [("language ID", language_id), ("line dedup", line_dedup), ("SimHash near-dedup", near_dedup), ("source mix", source_mix), ("byte BPE", encode)]

#: Trigram models, fingerprints and tokens are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

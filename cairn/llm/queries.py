"""The queries of this subpackage by name, with their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, bytecnn, covertree, crosspoly, language, linededup, poisson_mix, ring, simhash, url_rules

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts to ids and back; the digests of both."""
    return bpe.encode(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
        outputs=("n_tokens", "ids_sha256", "decoded_sha256"),
    )


#: Rules of op2 in the order given.
URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest rule that fits each page's url, or the default ``allow``."""
    rules = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    return url_rules.filter_urls(table(spark, sf_dir, "pages"), rules, default="allow")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document from its text, its declared language and its source's prior; ``kept`` is false for rejected ones."""
    return language.identify(table(spark, sf_dir, "documents"), declared=F.col("lang"), host=F.col("source"))


def language_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each page from its text, the language its markup declares, its address suffix and the priors of site and host."""
    return language.identify(table(spark, sf_dir, "pages"), "page_id", "html", declared=language.declared_in(F.col("html")), url_col="url")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of 40 code points or more that 5 documents hold stay in the largest one only."""
    return linededup.dedup_lines(table(spark, sf_dir, "documents"), min_chars=40, min_docs=5, outputs=("kept_sha256",))


def op5_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 24 shards with bounded loads; the law that holds is ``rows``."""
    return ring.assign(table(spark, sf_dir, "documents"), shards=24)


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest integer inner products of every 50th vector."""
    rows = table(spark, sf_dir, "embeddings")
    return covertree.top_k(rows, rows.filter(F.col("vec_id") % 50 == 0), k=5)


def op7_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of documents so that sources are mixed in proportion to the square root of their size, in shuffled order."""
    return poisson_mix.mix(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints over 4-word shingles, linked at 4 differing bits or fewer."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, budget=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document from a network trained on rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    net = bytecnn.train(docs, table(spark, sf_dir, "labels"))
    return bytecnn.score(docs, net, threshold=0.3)


def op10_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest found of every 50th vector by cosine."""
    rows = table(spark, sf_dir, "embeddings")
    return crosspoly.search(rows, rows.filter(F.col("vec_id") % 50 == 0), k=5)


QUERIES: dict[str, Query] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_url_filters": op2_url_filters,
    "op3_language": op3_language,
    "op4_line_dedup": op4_line_dedup,
    "op5_ring_shards": op5_ring_shards,
    "op6_exact_top_k": op6_exact_top_k,
    "op7_poisson_mix": op7_poisson_mix,
    "op8_simhash": op8_simhash,
    "op9_byte_cnn": op9_byte_cnn,
    "op10_cross_polytope": op10_cross_polytope,
    "language_of_pages": language_of_pages,
}

SQL: dict[str, str] = {
    "op2_url_filters": """
WITH rules(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
cut AS (
  SELECT page_id, row_number() OVER () AS i, CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, i, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
fits AS (
  SELECT p.i, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY p.i ORDER BY length(r.host || r.path) DESC) AS k
  FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN (SELECT * FROM fits WHERE k = 1) f USING (i)""",
    "op4_line_dedup": """
WITH split AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
frequent AS (
  SELECT key, max(doc_id) AS owner FROM split WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT s.doc_id, s.pos, s.line, f.key IS NOT NULL AND s.doc_id <> f.owner AS gone FROM split s LEFT JOIN frequent f ON s.key = f.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op6_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM scored
QUALIFY rank <= 5""",
    "op7_poisson_mix": poisson_mix.mix_sql(),
}

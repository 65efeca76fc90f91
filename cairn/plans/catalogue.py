"""The registered queries over the reference's operators, with the DuckDB SQL of each.

Queries without SQL: the codec trials and the rendered documents, which are held against
brute force or golden structure in tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import access, codecs, fixed, formats, geometry, names
from ..operators import access as resolving
from ..operators import compression, conventions, inventory, rendering, sampling, scoring, telemetry
from ..sources import parquet_footer, store_layout
from . import assess, frames
from . import catalogue_sql as sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(text: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if text is not None:
            SQL[f.__name__] = text
        return f

    return add


def _footers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parquet_footer.footers(spark, f"{sf_dir}/*.parquet")


@query(sql.ASSET_SCORECARD)
def asset_scorecard(spark, sf_dir):
    """How ready is each table of this directory? One row per table."""
    rows = _footers(spark, sf_dir)
    assets, variables = parquet_footer.assets(rows), parquet_footer.variables(rows)
    found = assess.assess(assets, variables)
    return found.scores.select("asset_id", "dim_a", "dim_b", "dim_c", "dim_d", "dim_e", "score", "tier", "verdict", "confidence")


@query(sql.PARQUET_INVENTORY)
def parquet_inventory(spark, sf_dir):
    found = parquet_footer.variables(_footers(spark, sf_dir))
    return found.select("asset_id", F.substring_index("name", ".", 1).alias("name"), "ordinal", "size_bytes", F.element_at("shape", 1).alias("n_rows"))


@query(sql.PARQUET_CODEC_AUDIT)
def parquet_codec_audit(spark, sf_dir):
    found = compression.inspect_codecs(parquet_footer.variables(_footers(spark, sf_dir)))
    return found.groupBy("asset_id", "codec", "status").agg(F.count("*").alias("n_columns"))


@query(sql.DETECT_INPUT)
def detect_input(spark, sf_dir):
    pages = frames.table(spark, sf_dir, "pages")
    text = F.expr("CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN concat('G', page_id, '-PROV.A_1') WHEN 2 THEN concat('/data/f', page_id, '.nc') ELSE concat('s3://b/', page_id) END")
    return pages.select("page_id", formats.detect_input(text).alias("kind"))


@query(sql.EXT_HINT)
def ext_hint_longest(spark, sf_dir):
    ext = F.expr("CASE ordinal % 6 WHEN 0 THEN '.copc.laz' WHEN 1 THEN '.NC4' WHEN 2 THEN '.zarr' WHEN 3 THEN '' WHEN 4 THEN '.tif' ELSE '.laz' END")
    path = F.when(F.col("ordinal") % 2 == 0, F.concat(F.lit("https://h.example/p"), "name", ext, F.lit("?v=.csv"))).otherwise(F.concat("name", ext))
    return frames.variables(spark, sf_dir).select("ordinal", formats.ext_hint(path).alias("hint"))


@query(sql.FORMAT_CLASSES)
def format_class_counts(spark, sf_dir):
    return frames.variables(spark, sf_dir).groupBy("format", formats.format_class(F.col("format")).alias("class")).agg(F.count("*").alias("n"))


@query(sql.SNIFF_MAGIC)
def sniff_magic(spark, sf_dir):
    docs = frames.table(spark, sf_dir, "documents")
    magic = [b"\x89HDF\r\n\x1a\n", b"CDF\x02", b"\x0e\x03\x13\x01", b"{", b'{"refs":', b"PAR1", b"II*\x00", b"GRIB", b"fgb", b"LASF", b"PMTiles", b"PK\x03\x04", b"\x1f\x8b", b"\x00\x00\x27\x0a", b""]
    chosen = F.element_at(F.array(*[F.lit(m) for m in magic]), (F.col("doc_id") % len(magic) + 1).cast("int"))
    pad = F.when(F.col("doc_id") % 31 == 30, F.lit(512)).otherwise(0)
    head = F.concat(F.unhex(F.repeat(F.lit("00"), pad)), chosen, F.substring(F.col("text").cast("binary"), 1, fixed.HEAD_BYTES))
    return docs.select("doc_id", formats.sniff_bytes(head).alias("format"))


@query(sql.MATCH)
def match_variables_semi(spark, sf_dir):
    tokens = spark.createDataFrame([("RED",), ("small_ring",), ("/promo/",), ("absent_token",)], "token string")
    return inventory.match_variables(frames.variables(spark, sf_dir), tokens).select("asset_id", "ordinal", "name")


@query(sql.UNMATCHED)
def match_unmatched_anti(spark, sf_dir):
    tokens = spark.createDataFrame([("RED",), ("small_ring",), ("absent_token",), ("100%",), ("_",)], "token string")
    return inventory.unmatched_tokens(frames.variables(spark, sf_dir), tokens)


@query(sql.RANK)
def rank_variables_topk(spark, sf_dir):
    return inventory.rank_variables(frames.variables(spark, sf_dir), 3).select("asset_id", "rank", "ordinal", "name")


@query(sql.EXCLUDED)
def excluded_reasons(spark, sf_dir):
    rows = frames.variables(spark, sf_dir)
    name = F.expr("CASE ordinal % 8 WHEN 0 THEN concat('/quality', name) WHEN 1 THEN concat(name, '_bnds') WHEN 2 THEN '/g/lat' WHEN 3 THEN '/g/x' WHEN 4 THEN concat(name, '_CRS') ELSE name END")
    reasons = names.exclusion_reasons(name, F.col("dims"), F.col("shape"), F.col("dtype"))
    return rows.select("ordinal", F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(sql.SELECTION)
def parse_selection(spark, sf_dir):
    answers = spark.createDataFrame([("1", "0, 2,ring ,99"), ("2", " ALL "), ("3", "")], "asset_id string, raw string")
    return inventory.parse_selection(frames.variables(spark, sf_dir), answers)


@query(sql.INVENTORY_LINES)
def inventory_table(spark, sf_dir):
    return inventory.inventory_lines(frames.variables(spark, sf_dir))


@query(sql.ELEMENTS)
def element_count(spark, sf_dir):
    return frames.variables(spark, sf_dir).select("ordinal", geometry.element_count(F.col("shape")).alias("elements"))


@query(sql.CHUNK_COUNT)
def chunk_count(spark, sf_dir):
    return frames.variables(spark, sf_dir).select("ordinal", geometry.chunk_count(F.col("shape"), F.col("chunks")).alias("n_chunks"))


@query(sql.ESTIMATE)
def estimate_mb(spark, sf_dir):
    return frames.variables(spark, sf_dir).select("ordinal", geometry.estimate_mb(F.col("chunks"), F.col("dtype")).alias("mb"))


@query(sql.GRADES)
def grade_bands(spark, sf_dir):
    mb = F.col("size_bytes") / F.lit(float(fixed.MIB))
    return frames.stored_chunks(spark, sf_dir).groupBy(geometry.grade(mb).alias("grade")).agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"))


@query(sql.SIZE_STATS)
def chunk_size_stats(spark, sf_dir):
    return sampling.size_stats(frames.stored_chunks(spark, sf_dir), ["asset_id"])


@query(sql.PROFILES)
def profile_fit(spark, sf_dir):
    mb = F.col("size_bytes") / F.lit(float(fixed.MIB))
    rows = frames.stored_chunks(spark, sf_dir).select(F.explode(geometry.profiles(mb)).alias("profile", "status"))
    return rows.groupBy("profile", "status").agg(F.count("*").alias("n"))


@query(sql.INTERIOR)
def interior_chunks_top8(spark, sf_dir):
    found = sampling.interior_chunks(frames.variables(spark, sf_dir), 8)
    return found.select("ordinal", "rank", F.array_join(F.col("idx").cast("array<string>"), ",").alias("idx"))


@query(sql.DATA_BEARING)
def data_bearing(spark, sf_dir):
    masked = F.transform("embedding", lambda x: F.when(F.abs(x) < 0.05 * (F.col("vec_id") % 9), F.lit(0.0)).otherwise(x.cast("double")))
    return frames.table(spark, sf_dir, "embeddings").select("vec_id", geometry.data_bearing(masked, F.lit(0.0)).alias("bears"))


def _interior_store(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    found = sampling.interior_chunks(frames.variables(spark, sf_dir), 32)
    flat = F.aggregate("idx", F.lit(0).cast("bigint"), lambda a, x: a + x)
    kept = found.withColumn("flat", flat).filter("flat % 3 <> 0")
    values = F.when(F.col("flat") % 2 == 0, F.array(F.lit(0.0), F.lit(0.0))).otherwise(F.array(F.lit(1.0), F.lit(0.0)))
    return found, kept.select("asset_id", "name", "ordinal", "idx", (F.col("flat") * 1000 + 1).alias("size_bytes"), values.alias("values"), F.lit(0.0).alias("fill"))


@query(sql.SCAN_INTERIOR)
def budget_capped_sample(spark, sf_dir):
    """The walk over interior candidates under a byte cap; names are made unique by their ordinal."""
    found, stored = _interior_store(spark, sf_dir)
    unique = F.concat("name", F.lit("#"), F.col("ordinal").cast("string"))
    walked = sampling.scan_interior(found.withColumn("name", unique), stored.withColumn("name", unique).drop("ordinal"), most=4, byte_cap=200_000)
    return walked.select(F.substring_index("name", "#", -1).cast("bigint").alias("ordinal"), F.size("sizes").cast("bigint").alias("n_sizes"), F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("bytes"), "data_bearing")


@query(sql.ORIENTATION)
def orientation_class(spark, sf_dir):
    found = geometry.orientation(F.col("dims"), F.col("shape"), F.col("chunks"))
    return frames.variables(spark, sf_dir).select("ordinal", found["orientation"].alias("orientation"), found["hedged"].alias("hedged"))


@query(sql.AMPLIFICATION)
def amplification_graded(spark, sf_dir):
    rows = frames.variables(spark, sf_dir).withColumn("o", geometry.orientation(F.col("dims"), F.col("shape"), F.col("chunks"), F.lit(2.0), "timeseries", geometry.itemsize(F.col("dtype"))))
    rows = rows.filter("o.series_read IS NOT NULL")
    return rows.select("ordinal", F.col("o.map_read.chunks_touched").alias("map_chunks"), F.col("o.series_read.chunks_touched").alias("series_chunks"), F.col("o.series_read.amplification").alias("series_amplification"), F.col("o.series_read.grade").alias("grade"))


@query(sql.COORDINATES)
def coord_chunk_notes(spark, sf_dir):
    rows = frames.variables(spark, sf_dir).withColumn("d", F.slice("dims", 1, 1)).withColumn("s", F.slice("shape", 2, 1)).withColumn("c", F.slice("chunks", 2, 1))
    return rows.select("ordinal", geometry.coordinate_note(F.col("name"), F.col("d"), F.col("s"), F.col("c")).isNotNull().alias("noted"))


@query(sql.CODEC_GRAMMAR)
def codec_grammar(spark, sf_dir):
    text = F.expr("CASE ordinal % 9 WHEN 0 THEN \"Blosc(cname='zstd', clevel=7, shuffle=SHUFFLE, blocksize=0)\" WHEN 1 THEN 'ZstdCodec(level=9, checksum=False)' WHEN 2 THEN \"BloscCodec(cname='lz4', shuffle='noshuffle')\" WHEN 3 THEN 'None' ELSE codec END")
    now = codecs.parse_codec(text)
    return frames.variables(spark, sf_dir).select("ordinal", now["family"].alias("family"), now["cname"].alias("cname"), now["level"].cast("bigint").alias("level"), now["shuffle"].alias("shuffle"), codecs.judge_codec(text).alias("status"))


@query(sql.KEEPBITS)
def keepbits(spark, sf_dir):
    error = F.expr("CASE vec_id % 4 WHEN 0 THEN 0.001D WHEN 1 THEN 0.1D WHEN 2 THEN 0D ELSE 10D END")
    return frames.table(spark, sf_dir, "embeddings").select("vec_id", codecs.keepbits(F.col("embedding"), error).cast("bigint").alias("bits"))


@query()
def codec_grid_ratio(spark, sf_dir):
    """Ten lossless and ten rounded trials on each embedding, repeated to the least sample size."""
    rows = frames.table(spark, sf_dir, "embeddings")
    samples = rows.select(F.col("vec_id").cast("string").alias("asset_id"), F.lit("/embedding").alias("name"), F.lit("gzip+shuffle").alias("codec"), F.flatten(F.array_repeat("embedding", 256)).alias("values"))
    return compression.benchmark(samples, keepbits=8).drop("compress_mbps", "decompress_mbps")  # timings differ from run to run


def _cf(cid: str) -> Query:
    return lambda spark, sf_dir: conventions.check(frames.attributed(spark, sf_dir), cid).select("asset_id", "id", "ok")


for _name, _id, _text in (
    ("cf_units_and_name", "units_and_name", sql.CF_UNITS), ("cf_coordinates", "coordinate_identification", sql.CF_COORDINATES),
    ("cf_grid_mapping_dangling", "grid_mapping", sql.CF_GRID_MAPPING), ("cf_bounds_dangling", "bounds", sql.CF_BOUNDS),
    ("cf_fill_values", "fill_value_consistency", sql.CF_FILL), ("cf_scale_offset", "scale_offset_typing", sql.CF_SCALE),
):
    QUERIES[_name], SQL[_name] = _cf(_id), _text


@query(sql.CF_ROLLUP)
def cf_rollup(spark, sf_dir):
    return conventions.check_cf(frames.assets(spark, sf_dir), frames.attributed(spark, sf_dir)).select("asset_id", "status", "applicable")


@query(sql.GEOZARR)
def geozarr_rollup(spark, sf_dir):
    arrays = frames.attributed(spark, sf_dir).withColumn("dims", F.when(F.col("ordinal") % 100 % 2 == 0, F.col("dims")).otherwise(F.array().cast("array<string>")))
    return conventions.check_geozarr(frames.assets(spark, sf_dir), arrays)


@query(sql.CRS)
def crs_containers(spark, sf_dir):
    return inventory.crs_containers(frames.attributed(spark, sf_dir)).select("asset_id", "ordinal", "name")


@query(sql.ACCESS)
def access_classify(spark, sf_dir):
    found = access.classify_access(F.col("stage"), F.col("status_code"), F.lit(None).cast("string"))
    return frames.request_log(spark, sf_dir).groupBy("stage", "status_code", found.alias("classification")).agg(F.count("*").alias("n"))


@query(sql.ACCESS_COMBINED)
def access_combined(spark, sf_dir):
    return assess.findings_from_log(frames.request_log(spark, sf_dir)).select("asset_id", "id", "status", "evidence")


@query(sql.STORE_ERRORS)
def store_errors(spark, sf_dir):
    text = F.expr("CASE page_id % 5 WHEN 0 THEN concat('403 from ', url, '/s3credentials') WHEN 1 THEN 'AccessDenied: no' WHEN 2 THEN concat('timeout at ', url) WHEN 3 THEN 'Forbidden by URS.EARTHDATA.example' ELSE 'https://data.lpdaac.example/x' END")
    return frames.table(spark, sf_dir, "pages").select("page_id", access.classify_store_error(text).alias("kind"), access.looks_like_archive(text).alias("archive"), access.infer_archive(text).alias("short_name"))


@query(sql.RESOLVE)
def resolve_inputs(spark, sf_dir):
    """Routes, sign-in and findings of addresses, granules and local paths with probe rows and records."""
    pages = frames.table(spark, sf_dir, "pages").select("page_id", "url", F.col("page_id").cast("string").alias("asset_id"))
    text = F.expr("CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN concat('G', page_id, '-P') WHEN 2 THEN concat('/d/', page_id) ELSE concat('s3://b/', page_id) END")
    record = F.expr("""concat('{"RelatedUrls": [{"URL": "s3://g/', page_id, '", "Type": "GET DATA VIA DIRECT ACCESS"}, {"URL": "https://h/s3credentials", "Type": "V"}]}')""")
    head = F.expr("CASE page_id % 3 WHEN 0 THEN 200 WHEN 1 THEN 200 ELSE 403 END")
    ranged = F.expr("CASE page_id % 3 WHEN 0 THEN 206 WHEN 1 THEN 200 ELSE 403 END")
    row = lambda n, stage, code: F.struct(F.lit(n).cast("bigint").alias("seq"), F.lit(stage).alias("stage"), code.cast("int").alias("status_code"))
    probes = pages.select("asset_id", F.inline(F.array(row(1, "head", head), row(2, "range-get", ranged)))).select("*", F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("etag"), F.lit(0.1).alias("seconds"))
    found = resolving.resolve_access(pages.select("asset_id", text.alias("input")), probes, pages.filter("page_id % 8 = 1").select("asset_id", record.alias("record")))
    return found.select("asset_id", "input_kind", "auth", "url", F.array_join(F.transform("findings", lambda f: F.concat(f["id"], F.lit("="), f["status"])), ";").alias("findings"))


@query(sql.STORES)
def store_layouts(spark, sf_dir):
    docs = frames.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("asset_id"), (F.col("doc_id") % 6).alias("k"))
    listed = F.expr("CASE k WHEN 0 THEN array('zarr.json', '.zgroup') WHEN 1 THEN array('zarr.json') WHEN 2 THEN array('.zmetadata', '.zgroup') WHEN 3 THEN array('.zarray') WHEN 4 THEN array('refs', 'snapshots') ELSE array('refs') END")
    document = F.expr("""CASE k WHEN 0 THEN '{"consolidated_metadata": {"metadata": {}}}' ELSE '{}' END""")
    return store_layout.sniff_store(docs.select("asset_id", F.explode(listed).alias("key"), document.alias("document")))


@query(sql.BREACHES)
def budget_breaches(spark, sf_dir):
    return telemetry.first_breaches(frames.request_log(spark, sf_dir), 1_000_000).select("asset_id", "seq", "total_bytes", "requests")


def _findings(spark, sf_dir) -> DataFrame:
    log = frames.request_log(spark, sf_dir)
    cid = F.expr("CASE seq % 7 WHEN 0 THEN 'D1-range' WHEN 1 THEN 'D2-auth' WHEN 2 THEN 'D0-hosting' WHEN 3 THEN 'D3-https-cors' ELSE 'other' END")
    status = F.expr("CASE seq % 4 WHEN 0 THEN 'pass' WHEN 1 THEN 'warn' WHEN 2 THEN 'fail' ELSE 'skipped' END")
    return log.select("asset_id", "seq", cid.alias("id"), status.alias("status"), F.concat(F.lit("e"), F.col("seq").cast("string")).alias("evidence"), F.lit(None).cast("string").alias("remediation"))


def _assessment(spark, sf_dir) -> assess.Assessment:
    return assess.assess(frames.assets(spark, sf_dir), frames.attributed(spark, sf_dir), findings=_findings(spark, sf_dir))


@query(sql.D_CHECKS)
def d_checks_first_per_id(spark, sf_dir):
    rows = _assessment(spark, sf_dir).checks.filter("dimension = 'D'")
    return rows.select("asset_id", "id", "status", "points_awarded", "evidence")


@query(sql.CHECKS_ALL)
def checks_all(spark, sf_dir):
    return _assessment(spark, sf_dir).checks.select("asset_id", F.col("seq").cast("bigint").alias("seq"), "id", "dimension", "points_possible", "points_awarded", "status")


@query(sql.DIMENSIONS)
def dimension_rollup(spark, sf_dir):
    return scoring.dimension_scores(_assessment(spark, sf_dir).checks)


@query(sql.GROUPING_SETS)
def rollup_grouping_sets(spark, sf_dir):
    rows = _assessment(spark, sf_dir).checks.filter("status <> 'n/a'")
    return rows.rollup("asset_id", "dimension").agg(F.round(F.sum("points_awarded"), 4).alias("got"), F.sum("points_possible").alias("possible"), F.count("*").alias("n"))


@query(sql.SCORES)
def score_tier_verdict(spark, sf_dir):
    return _assessment(spark, sf_dir).scores.select("asset_id", "dim_a", "dim_b", "dim_c", "dim_d", "dim_e", "score", "tier", "verdict", "confidence", F.col("n_skipped").alias("n_skipped"))


@query(sql.REMEDIATIONS)
def remediation_priority(spark, sf_dir):
    return scoring.remediations(_assessment(spark, sf_dir).checks).select("asset_id", "rank", "id", "points_possible")


def _records(spark, sf_dir) -> DataFrame:
    docs = frames.table(spark, sf_dir, "documents")
    link = lambda url, kind: F.struct(url.alias("URL"), F.lit(kind).alias("Type"))
    number = F.col("doc_id").cast("string")
    links = F.array(link(F.concat(F.lit("s3://b/"), number), "GET DATA VIA DIRECT ACCESS"), link(F.concat(F.lit("https://h/"), number), "GET DATA"), link(F.concat(F.lit("https://h/S3credentials/")), "VIEW RELATED INFORMATION"), link(F.concat(F.lit("https://d/"), F.col("source")), "USER DOCUMENTATION"))
    record = F.struct(F.slice(links, 1, F.expr("CAST(doc_id % 4 + 1 AS INT)")).alias("RelatedUrls"), F.when(F.col("doc_id") % 3 == 0, F.lit("CC0")).alias("License"), F.struct(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("10.1/"), number)).alias("DOI")).alias("DOI"), F.col("source").alias("Abstract"), F.when(F.col("doc_id") % 5 > 0, F.array_repeat(F.lit("k"), F.expr("CAST(doc_id % 5 AS INT)"))).alias("ScienceKeywords"))
    return docs.select("doc_id", F.to_json(record).alias("record"))


@query(sql.CMR)
def cmr_meta(spark, sf_dir):
    rows = _records(spark, sf_dir).withColumn("m", access.catalogue_meta(F.col("record"))).withColumn("u", access.related_urls(F.col("record")))
    return rows.select("doc_id", F.col("m.license").alias("license"), F.col("m.doi").alias("doi"), F.size("m.doc_links").cast("bigint").alias("n_docs"), F.col("m.n_keywords").cast("bigint").alias("n_keywords"), F.col("m.description_len").cast("bigint").alias("description_len"), F.get("u.s3_urls", F.lit(0)).alias("s3_url"), F.size("u.https_urls").cast("bigint").alias("n_https"), F.col("u.credentials_url").alias("credentials_url"))


@query()
def report_markdown(spark, sf_dir):
    found = _assessment(spark, sf_dir)
    return rendering.render(found.scores, found.checks, frames.assets(spark, sf_dir), found.assessed, found.inspected)


@query()
def findings_documents(spark, sf_dir):
    found = _assessment(spark, sf_dir)
    return rendering.findings_json(found.scores, found.checks)


@query(sql.RUNNING)
def request_totals(spark, sf_dir):
    """The five largest requests of each asset by bytes, with the running totals of its log at each."""
    rows = telemetry.running_bytes(frames.request_log(spark, sf_dir))
    by_size = Window.partitionBy("asset_id").orderBy(F.desc("bytes"), "seq")
    return rows.withColumn("place", F.row_number().over(by_size)).filter("place <= 5").select("asset_id", "seq", "bytes", "total_bytes", "requests", F.col("place").cast("bigint").alias("place"))

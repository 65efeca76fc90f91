"""Inventory-shaped frames derived from the driver's tables, in Spark and as DuckDB CTEs.

The tables hold no array metadata, so these are synthetic: the same formula in both
engines. They show that operators agree, not anything about real datasets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


FORMATS = ("zarr", "hdf5", "netcdf3", "parquet", "icechunk", "cog", "kerchunk")
CODECS = (None, "gzip+shuffle", "zstd-3", "blosc-lz4-5+shuffle", "lzf")

_V = """
SELECT CAST(p_partkey % 100 AS STRING) AS asset_id, p_partkey AS ordinal, CONCAT('/', LOWER(p_type), '/', REPLACE(p_name, ' ', '_')) AS name,
  CASE p_partkey % 3 WHEN 0 THEN array('time','lat','lon') WHEN 1 THEN array('dim_0','dim_1','dim_2') ELSE array('z','y','x') END AS dims,
  array(365L, p_size * 40L, p_size * 80L) AS shape,
  CASE p_type WHEN 'STANDARD' THEN 'float32' WHEN 'ECONOMY' THEN 'int16' WHEN 'PROMO' THEN 'float64' WHEN 'LARGE' THEN 'complex64' WHEN 'SMALL' THEN '|S10' ELSE 'uint8' END AS dtype,
  CASE p_partkey % 4 WHEN 0 THEN array(1L, p_size * 40L, p_size * 80L) WHEN 1 THEN array(365L, 8L, 8L) WHEN 2 THEN array(73L, p_size * 10L, p_size * 20L) END AS chunks,
  CAST(p_retailprice * 10000 AS BIGINT) AS size_bytes,
  CASE CAST(SUBSTR(p_brand, 7) AS INT) % 5 WHEN 1 THEN 'gzip+shuffle' WHEN 2 THEN 'zstd-3' WHEN 3 THEN 'blosc-lz4-5+shuffle' WHEN 4 THEN 'lzf' END AS codec,
  CASE (p_partkey % 100) % 7 WHEN 0 THEN 'zarr' WHEN 1 THEN 'hdf5' WHEN 2 THEN 'netcdf3' WHEN 3 THEN 'parquet' WHEN 4 THEN 'icechunk' WHEN 5 THEN 'cog' ELSE 'kerchunk' END AS format,
  p_name, p_size, p_brand
FROM {part}"""

#: Attributes by modulus; some references dangle on purpose.
_ATTRS = {
    "units": "CASE WHEN p_partkey % 5 < 4 THEN 'K' END",
    "standard_name": "CASE WHEN p_partkey % 7 < 5 THEN CONCAT('v_', p_type) END",
    "grid_mapping": "CASE p_partkey % 11 WHEN 0 THEN CONCAT('/', LOWER(p_type), '/', REPLACE(p_name, ' ', '_')) WHEN 1 THEN REPLACE(p_name, ' ', '_') WHEN 2 THEN 'nowhere' END",
    "bounds": "CASE p_partkey % 13 WHEN 0 THEN REPLACE(p_name, ' ', '_') WHEN 1 THEN 'missing_bnds' END",
    "coordinates": "CASE p_partkey % 17 WHEN 0 THEN CONCAT(REPLACE(p_name, ' ', '_'), ' nowhere') WHEN 1 THEN REPLACE(p_name, ' ', '_') END",
    "_FillValue": "CASE p_partkey % 19 WHEN 0 THEN '-9999' WHEN 1 THEN '255' END",
    "missing_value": "CASE p_partkey % 19 WHEN 0 THEN '-9999' WHEN 1 THEN '254' END",
    "scale_factor": "CASE p_partkey % 23 WHEN 0 THEN '0.1' WHEN 1 THEN 'tenth' END",
}


def variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V: one row per part, about 20 variables in each of 100 assets."""
    return spark.sql(_V.format(part="{p}"), p=table(spark, sf_dir, "part")).withColumn("attrs", F.create_map().cast("map<string,string>"))


def attributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K: V with attributes, from the same pass over the parts."""
    marks = ", ".join(f"{e} AS `{n}`" for n, e in _ATTRS.items())
    rows = spark.sql(_V.format(part="{p}").replace("  p_name, p_size, p_brand\n", f"  p_name, p_size, p_brand, {marks}\n"), p=table(spark, sf_dir, "part"))
    pairs = F.array(*[F.struct(F.lit(n).alias("k"), F.col(n).alias("v")) for n in _ATTRS])
    return rows.withColumn("attrs", F.map_from_entries(F.filter(pairs, lambda x: x["v"].isNotNull()))).drop(*_ATTRS)


def stored_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S: one row per line item."""
    rows = table(spark, sf_dir, "lineitem")
    size = F.floor(F.col("l_extendedprice") * F.col("l_quantity") * 32).cast("bigint")
    return rows.select((F.col("l_partkey") % 100).cast("string").alias("asset_id"), F.col("l_partkey").alias("ordinal"), size.alias("size_bytes"))


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L: one row per event."""
    status = "CASE event_type WHEN 'view' THEN 206 WHEN 'click' THEN 200 WHEN 'purchase' THEN 206 WHEN 'signup' THEN 401 ELSE 403 END"
    stage = "CASE event_id % 3 WHEN 0 THEN 'head' WHEN 1 THEN 'range-get' ELSE 'open' END"
    return table(spark, sf_dir, "events").selectExpr("CAST(user_id AS STRING) AS asset_id", "event_id AS seq", f"{status} AS status_code", f"{stage} AS stage", "CAST(ROUND(value * 1000) AS BIGINT) AS bytes")


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each of the 100 assets of V, with telemetry and catalogue facts by modulus."""
    from ..schema import ASSETS, conform

    number = F.col("asset_id").cast("int")
    rows = variables(spark, sf_dir).groupBy("asset_id").agg(F.first("format").alias("format"))
    cmr = F.when(number % 4 == 0, F.struct(
        F.when(number % 8 == 0, "CC0").alias("license"), F.lit(None).cast("string").alias("doi"), (number % 3 == 0).alias("contact"), F.array().cast("array<string>").alias("doc_links"), (number % 5).cast("int").alias("n_keywords"), F.lit(0).alias("description_len")))
    rows = rows.select(
        "asset_id", "format", F.when(number % 9 == 0, "fail").when(number % 9 < 7, "pass").otherwise("skipped").alias("smoke_status"),
        F.when(number % 3 == 0, '"tag"').when(number % 3 == 1, 'W/"weak"').alias("etag"), F.when(number % 2 == 0, number % 13).cast("bigint").alias("requests_to_open"),
        F.when(number % 5 < 2, number % 5 == 0).alias("consolidated"), cmr.alias("cmr"),
        F.when(number % 6 != 0, F.create_map(F.lit("Conventions"), F.when(number % 4 < 3, "CF-1.8").otherwise("none"))).otherwise(F.create_map().cast("map<string,string>")).alias("global_attrs"),
    )
    return conform(rows, ASSETS)


# --- the same in DuckDB

_list = lambda s: s.replace("array(", "list_value(").replace("L,", ",").replace("L)", ")").replace("STRING", "VARCHAR")

V_SQL = "V AS (" + _list(_V.format(part="part")).replace("365,", "365::BIGINT,").replace("list_value(1,", "list_value(1::BIGINT,").replace("list_value(73,", "list_value(73::BIGINT,").replace("CAST(p_retailprice * 10000 AS BIGINT)", "CAST(trunc(p_retailprice * 10000) AS BIGINT)") + ")"
K_SQL = V_SQL + ",\nK AS (SELECT V.*, " + ", ".join(f'{e} AS "{n}"' for n, e in _ATTRS.items()) + ", p_partkey FROM V JOIN (SELECT p_partkey, p_type FROM part) ON p_partkey = ordinal)"
S_SQL = "S AS (SELECT CAST(l_partkey % 100 AS VARCHAR) AS asset_id, l_partkey AS ordinal, CAST(floor(l_extendedprice * l_quantity * 32) AS BIGINT) AS size_bytes FROM lineitem)"
L_SQL = (
    "L AS (SELECT CAST(user_id AS VARCHAR) AS asset_id, event_id AS seq, CASE event_type WHEN 'view' THEN 206 WHEN 'click' THEN 200 WHEN 'purchase' THEN 206 WHEN 'signup' THEN 401 ELSE 403 END AS status_code, "
    "CASE event_id % 3 WHEN 0 THEN 'head' WHEN 1 THEN 'range-get' ELSE 'open' END AS stage, CAST(round(value * 1000) AS BIGINT) AS bytes FROM events)"
)
A_SQL = """A AS (
  SELECT asset_id, n, format, CASE WHEN n % 9 = 0 THEN 'fail' WHEN n % 9 < 7 THEN 'pass' ELSE 'skipped' END AS smoke_status,
    CASE WHEN n % 3 = 0 THEN '"tag"' WHEN n % 3 = 1 THEN 'W/"weak"' END AS etag, CASE WHEN n % 2 = 0 THEN n % 13 END AS requests_to_open,
    CASE WHEN n % 5 < 2 THEN n % 5 = 0 END AS consolidated, n % 4 = 0 AS has_cmr, n % 8 = 0 AS cmr_license, n % 3 = 0 AS cmr_contact, n % 5 AS cmr_keywords,
    CASE WHEN n % 6 <> 0 THEN CASE WHEN n % 4 < 3 THEN 'CF-1.8' ELSE 'none' END END AS conventions
  FROM (SELECT asset_id, CAST(asset_id AS INTEGER) AS n, any_value(format) AS format FROM V GROUP BY asset_id))"""

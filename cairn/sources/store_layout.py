"""Store layouts and Zarr metadata from key listings and JSON documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .heads import heads

META_KEYS = ("zarr.json", ".zmetadata", ".zgroup", ".zarray", ".zattrs", "refs", "snapshots", "manifests")


def list_keys(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(``path``, ``length``) of the files below ``root``; their contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path", "length")


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """(``path``, ``document``) of the metadata documents below ``root``."""
    rows = heads(spark, root, names="zarr.json,.zmetadata,.zgroup,.zarray,.zattrs", bytes="0")
    return rows.select("path", F.decode("head", "UTF-8").alias("document"))


def sniff_store(keys: DataFrame) -> DataFrame:
    """(``asset_id``, ``format``, ``zarr_version``, ``consolidated``) from root keys (``asset_id``, ``key``, ``document``).

    The first that is there decides: ``zarr.json``, ``.zmetadata``, ``.zgroup`` or ``.zarray``,
    and ``refs`` with ``snapshots`` or ``manifests``.
    """
    has = {k: F.bool_or(F.col("key") == k).alias(k) for k in META_KEYS}
    document = F.max(F.when(F.col("key") == "zarr.json", F.col("document"))).alias("zarr_document")
    found = keys.groupBy("asset_id").agg(*has.values(), document)
    col = lambda k: F.col(f"`{k}`")
    v2 = col(".zgroup") | col(".zarray")
    ice = col("refs") & (col("snapshots") | col("manifests"))
    merged = F.get_json_object("zarr_document", "$.consolidated_metadata")
    return found.select(
        "asset_id",
        F.when(col("zarr.json") | col(".zmetadata") | v2, "zarr").when(ice, "icechunk").otherwise("unknown").alias("format"),
        F.when(col("zarr.json"), "v3").when(col(".zmetadata") | v2, "v2").alias("zarr_version"),
        F.when(col("zarr.json"), merged.isNotNull() & (merged != "null")).when(col(".zmetadata"), True).when(v2, False).alias("consolidated"),
    )


NODE = "struct<node_type:string,shape:array<bigint>,data_type:string,dimension_names:array<string>,chunk_grid:struct<configuration:struct<chunk_shape:array<bigint>>>,codecs:array<struct<name:string,configuration:string>>,attributes:map<string,string>>"
ARRAY_V2 = "struct<shape:array<bigint>,chunks:array<bigint>,dtype:string,compressor:string,filters:array<string>>"


def _codec_v3(node: Column) -> Column:
    return F.array_join(F.transform(F.filter(node["codecs"], lambda c: ~c["name"].isin("bytes", "transpose", "crc32c")), lambda c: F.concat(c["name"], F.coalesce(F.concat(F.lit("("), c["configuration"], F.lit(")")), F.lit("")))), ",")


def zarr_variables(documents: DataFrame) -> DataFrame:
    """The inventory of Zarr stores from their documents (``asset_id``, ``key``, ``document``).

    Reads the consolidated metadata of ``zarr.json`` (keys with or without ``/zarr.json`` at the end) and of
    ``.zmetadata``. Stores without it are read document by document: ``a/b/zarr.json``, or ``a/b/.zarray`` with
    ``a/b/.zattrs``, in the order of their paths. Array shapes, dtypes, chunks, codecs, dimension names and
    attributes come from JSON alone.
    """
    merged = F.get_json_object("document", "$.consolidated_metadata.metadata")
    whole = documents.groupBy("asset_id").agg(F.bool_or((F.col("key") == ".zmetadata") | ((F.col("key") == "zarr.json") & merged.isNotNull())).alias("whole"))
    loose = documents.join(whole.filter("NOT whole"), "asset_id", "left_semi")
    place = Window.partitionBy("asset_id").orderBy("key")
    v3 = documents.filter("key = 'zarr.json'").select("asset_id", F.from_json(F.get_json_object("document", "$.consolidated_metadata.metadata"), f"map<string,{NODE}>").alias("m"))
    v3 = v3.select("asset_id", F.posexplode(F.map_entries("m")).alias("ordinal", "e")).select("asset_id", "ordinal", F.col("e.key").alias("key"), F.col("e.value").alias("node"))
    single = loose.filter("key LIKE '%/zarr.json' OR key = 'zarr.json'").select("asset_id", "key", F.from_json("document", NODE).alias("node")).filter("node.node_type = 'array'")
    v3 = v3.filter("node.node_type = 'array'").union(single.select("asset_id", F.row_number().over(place) - 1, "key", "node"))
    n = F.col("node")
    one = v3.select(
        "asset_id", F.col("ordinal").cast("bigint").alias("ordinal"), F.concat(F.lit("/"), F.regexp_replace("key", "(^/+)|(/?zarr\\.json$)", "")).alias("name"),
        F.coalesce(n["dimension_names"], F.array().cast("array<string>")).alias("dims"), n["shape"].alias("shape"), n["data_type"].alias("dtype"),
        n["chunk_grid"]["configuration"]["chunk_shape"].alias("chunks"), F.coalesce(n["attributes"], F.create_map().cast("map<string,string>")).alias("attrs"),
        F.lit(None).cast("bigint").alias("size_bytes"), F.nullif(_codec_v3(n), F.lit("")).alias("codec"),
    )
    v2 = documents.filter("key = '.zmetadata'").select("asset_id", F.posexplode(F.map_entries(F.from_json(F.get_json_object("document", "$.metadata"), "map<string,string>"))).alias("ordinal", "e"))
    parts = v2.select("asset_id", "ordinal", F.regexp_extract("e.key", r"^(.*)/(\.zarray|\.zattrs)$", 1).alias("path"), F.regexp_extract("e.key", r"(\.zarray|\.zattrs)$", 1).alias("kind"), F.col("e.value").alias("text")).filter("path <> ''")
    split = loose.filter("key LIKE '%/.zarray' OR key LIKE '%/.zattrs'").select("asset_id", (F.row_number().over(place) - 1).alias("ordinal"), "key", "document")
    parts = parts.union(split.select("asset_id", "ordinal", F.regexp_extract("key", r"^(.*)/(\.zarray|\.zattrs)$", 1), F.regexp_extract("key", r"(\.zarray|\.zattrs)$", 1), "document"))
    both = parts.groupBy("asset_id", "path").agg(F.min("ordinal").alias("ordinal"), F.max(F.when(F.col("kind") == ".zarray", F.col("text"))).alias("a"), F.max(F.when(F.col("kind") == ".zattrs", F.col("text"))).alias("t"))
    both = both.filter("a IS NOT NULL").withColumn("node", F.from_json("a", ARRAY_V2)).withColumn("attrs", F.coalesce(F.from_json("t", "map<string,string>"), F.create_map().cast("map<string,string>")))
    named = F.from_json(F.col("attrs")["_ARRAY_DIMENSIONS"], "array<string>")
    codec = F.array_join(F.concat(F.coalesce(n["filters"], F.array().cast("array<string>")), F.array_compact(F.array(n["compressor"]))), ",")
    two = both.select(
        "asset_id", F.col("ordinal").cast("bigint").alias("ordinal"), F.concat(F.lit("/"), F.regexp_replace("path", "^/+", "")).alias("name"), F.coalesce(named, F.array().cast("array<string>")).alias("dims"),
        n["shape"].alias("shape"), n["dtype"].alias("dtype"), n["chunks"].alias("chunks"), "attrs", F.lit(None).cast("bigint").alias("size_bytes"), F.nullif(codec, F.lit("")).alias("codec"),
    )
    return one.union(two)


def root_attributes(documents: DataFrame) -> DataFrame:
    """(``asset_id``, ``global_attrs``): the root group's attributes."""
    text = (
        F.when(F.col("key") == "zarr.json", F.get_json_object("document", "$.attributes"))
        .when(F.col("key") == ".zmetadata", F.get_json_object("document", "$.metadata['.zattrs']")).when(F.col("key") == ".zattrs", F.col("document"))
    )
    order = F.when(F.col("key") == "zarr.json", 0).when(F.col("key") == ".zmetadata", 1).otherwise(2)
    rows = documents.select("asset_id", order.alias("o"), F.from_json(text, "map<string,string>").alias("m")).filter("m IS NOT NULL")
    return rows.groupBy("asset_id").agg(F.min_by("m", "o").alias("global_attrs"))


def open_cost(documents: DataFrame) -> DataFrame:
    """(``asset_id``, ``requests_to_open``, ``bytes_to_open``): one document if the metadata are consolidated, else all of them."""
    merged = F.get_json_object("document", "$.consolidated_metadata.metadata")
    whole = (F.col("key") == ".zmetadata") | ((F.col("key") == "zarr.json") & merged.isNotNull())
    size = F.octet_length("document").cast("bigint")
    rows = documents.groupBy("asset_id").agg(F.max(F.when(whole, size)).alias("one"), F.count("*").alias("n"), F.sum(size).alias("every"))
    return rows.select("asset_id", F.when(F.col("one").isNotNull(), 1).otherwise(F.col("n")).cast("bigint").alias("requests_to_open"), F.coalesce("one", "every").alias("bytes_to_open"))

"""Schemas of the tables that operators read; every column may be null, and a missing measurement degrades to ``skipped``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: One row per array or column; ``ordinal`` carries the order in which they were found.
VARIABLES = (
    "asset_id string, ordinal long, name string, dims array<string>, shape array<bigint>, dtype string, chunks array<bigint>, "
    "attrs map<string,string>, size_bytes bigint, codec string"
)
#: One row per asset.
ASSETS = (
    "asset_id string, format string, smoke_status string, etag string, requests_to_open bigint, bytes_to_open bigint, consolidated boolean, "
    "zarr_version string, crs string, cog_valid boolean, overviews array<int>, global_attrs map<string,string>, "
    "cmr struct<license:string,doi:string,contact:boolean,doc_links:array<string>,n_keywords:int,description_len:int>"
)
FINDINGS = "asset_id string, seq long, id string, status string, evidence string, remediation string"
STORED_CHUNKS = "asset_id string, name string, idx array<bigint>, size_bytes bigint, values array<double>"
CHECKS = "asset_id string, seq int, id string, dimension string, points_possible double, points_awarded double, status string, evidence string, remediation string"


def conform(df: DataFrame, schema: str) -> DataFrame:
    """``df`` with exactly the columns of ``schema``; columns that it lacks are null."""
    from pyspark.sql.types import StructType

    wanted = StructType.fromDDL(schema)
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])

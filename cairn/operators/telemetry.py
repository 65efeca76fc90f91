"""Budgets over request logs: where an asset's reads passed a cap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed


def running_bytes(log: DataFrame) -> DataFrame:
    """``log`` (``asset_id``, ``seq``, ``bytes``) with ``total_bytes`` and ``requests`` so far."""
    so_far = Window.partitionBy("asset_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return log.withColumn("total_bytes", F.sum(F.coalesce("bytes", F.lit(0))).over(so_far)).withColumn("requests", F.count("*").over(so_far))


def first_breaches(log: DataFrame, byte_cap: int = fixed.MAX_BYTES) -> DataFrame:
    """(``asset_id``, ``seq``, ``total_bytes``, ``requests``, ``message``): the request that passed the byte cap first."""
    over = running_bytes(log).filter(F.col("total_bytes") > byte_cap)
    first = over.groupBy("asset_id").agg(F.min("seq").alias("seq"), F.min_by("total_bytes", "seq").alias("total_bytes"), F.min_by("requests", "seq").alias("requests"))
    return first.withColumn("message", F.concat(F.lit(f"byte cap {byte_cap} passed ("), F.col("total_bytes").cast("string"), F.lit(")")))


def stage_breaches(stages: DataFrame, seconds: float = fixed.MAX_SECONDS) -> DataFrame:
    """Stage ends (``asset_id``, ``stage``, ``elapsed_s``) with ``breached``; time is only looked at there."""
    return stages.withColumn("breached", F.col("elapsed_s") > F.lit(float(seconds)))


def unmeasured_opens(opens: DataFrame) -> DataFrame:
    """Opens (``status``, ``bytes_to_open``) that succeeded without a byte read: the measurement is wrong."""
    return opens.filter((F.col("status") == "ok") & (F.coalesce("bytes_to_open", F.lit(0)) <= 0))

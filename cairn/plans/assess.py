"""The assessment of many assets as one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import compression, conventions, inventory, sampling, scoring


@dataclass
class Assessment:
    """The tables of an assessment, all keyed by ``asset_id``; each is a plan until an action runs it."""

    selected: DataFrame
    assessed: DataFrame
    inspected: DataFrame
    cf: DataFrame
    checks: DataFrame
    scores: DataFrame


def assess(assets: DataFrame, variables: DataFrame, findings: DataFrame | None = None, measured: DataFrame | None = None, tokens: DataFrame | None = None, every: bool = False, use_case: str | None = None) -> Assessment:
    """Select variables, assess their chunking and codecs, check conventions and score.

    Selection: all with ``every``, else those that ``tokens`` fit, else each asset's best-ranked one. Conventions look
    at the full inventory, chunking and codecs at the selection.
    """
    if every:
        selected = variables
    elif tokens is not None:
        selected = inventory.match_variables(variables, tokens)
    else:
        selected = inventory.rank_variables(variables, 1).drop("rank")
    assessed = sampling.assess_chunking(selected, measured, use_case)
    cf = conventions.check_cf(assets, variables)
    facts = scoring.facts(assets, variables, assessed, cf, inventory.crs_containers(variables), findings)
    checks = scoring.checks(facts)
    return Assessment(selected, assessed, compression.inspect_codecs(selected), cf, checks, scoring.score(checks))


def findings_from_log(log: DataFrame) -> DataFrame:
    """D1 findings from request rows (``asset_id``, ``seq``, ``stage``, ``status_code``): head and ranged read combined."""
    from ..functions.access import classify_access, combine_access, range_status

    found = log.withColumn("c", classify_access(F.col("stage"), F.col("status_code"), F.lit(None).cast("string")))
    last = lambda stage: F.max_by(F.when(F.col("stage") == stage, F.col("c")), F.when(F.col("stage") == stage, F.col("seq")))
    both = found.groupBy("asset_id").agg(last("head").alias("head"), last("range-get").alias("ranged"))
    kind = combine_access(F.col("head"), F.col("ranged"))
    return both.select("asset_id", F.lit(0).cast("bigint").alias("seq"), F.lit("D1-range").alias("id"), range_status(kind).alias("status"), F.concat(F.lit("probe: "), F.coalesce(kind, F.lit("none"))).alias("evidence"), F.lit(None).cast("string").alias("remediation"))

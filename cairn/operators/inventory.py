"""Match, rank, select and show the variables of many assets at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import element_count
from ..functions.names import basename, is_crs_container, is_excluded, token_matches


def match_variables(variables: DataFrame, tokens: DataFrame) -> DataFrame:
    """Variables that at least one token fits, each once, as they are.

    ``tokens`` has a column ``token`` (a request's few tokens) and may have ``asset_id`` to
    hold for one asset only.
    """
    v, t = variables.alias("v"), tokens.alias("t")
    fits = token_matches(F.col("v.name"), F.col("t.token"))
    if "asset_id" in tokens.columns:
        fits = (F.col("v.asset_id") == F.col("t.asset_id")) & fits
    return v.join(t, fits, "left_semi")


def unmatched_tokens(variables: DataFrame, tokens: DataFrame) -> DataFrame:
    """Tokens that fit no variable: a request with any of them is refused."""
    scoped = "asset_id" in tokens.columns
    asked = tokens.select(*(["asset_id"] if scoped else []), "token").distinct()
    # The few tokens go to the variables, not the inventory to the tokens.
    t, v = (asked if scoped else F.broadcast(asked)).alias("t"), variables.alias("v")
    fits = token_matches(F.col("v.name"), F.col("t.token"))
    found = v.join(t, (F.col("v.asset_id") == F.col("t.asset_id")) & fits if scoped else fits).select("t.*").distinct()
    return tokens.join(found, found.columns, "left_anti")


def rank_variables(variables: DataFrame, most: int | None = None) -> DataFrame:
    """Data variables with their ``rank`` in the asset: more axes, then more elements, then the name."""
    kept = variables.filter(~is_excluded(F.col("name"), F.col("dims"), F.col("shape"), F.col("dtype")))
    order = Window.partitionBy("asset_id").orderBy(F.desc(F.size("shape")), F.desc(element_count(F.col("shape"))), "name", "ordinal")
    ranked = kept.withColumn("rank", F.row_number().over(order))
    return ranked if most is None else ranked.filter(F.col("rank") <= most)


def parse_selection(variables: DataFrame, answers: DataFrame) -> DataFrame:
    """(``asset_id``, ``pos``, ``token``) for answers (``asset_id``, ``raw``): ``all``, or numbers and names between commas."""
    parts = answers.select("asset_id", F.trim("raw").alias("raw"))
    parts = parts.select("asset_id", "raw", F.posexplode(F.split("raw", ",")).alias("pos", "part")).withColumn("part", F.trim("part")).filter("part <> ''")
    place = Window.partitionBy("asset_id").orderBy("ordinal")
    numbered = variables.select("asset_id", "name", (F.row_number().over(place) - 1).alias("number"))
    every = parts.filter("lower(raw) = 'all'").join(numbered, "asset_id").select("asset_id", F.col("number").alias("pos"), F.col("name").alias("token"))
    own = parts.filter("lower(raw) <> 'all'").withColumn("number", F.when(F.col("part").rlike(r"^\d{1,9}$"), F.col("part").cast("int")))
    named = own.join(numbered, ["asset_id", "number"], "left").select("asset_id", "pos", F.coalesce("name", "part").alias("token"))
    return every.union(named)


def inventory_lines(variables: DataFrame) -> DataFrame:
    """(``asset_id``, ``number``, ``line``): the numbered list that a person selects from."""
    place = Window.partitionBy("asset_id").orderBy("ordinal")
    joined = lambda c: F.array_join(F.coalesce(F.col(c).cast("array<string>"), F.array().cast("array<string>")), ",")
    number = (F.row_number().over(place) - 1).alias("number")
    rows = variables.select("asset_id", number, "name", joined("dims").alias("d"), joined("shape").alias("s"), F.coalesce("dtype", F.lit("")).alias("t"))
    return rows.select("asset_id", "number", F.concat(F.col("number").cast("string"), F.lit("  "), "name", F.lit("  ("), "d", F.lit(")×("), "s", F.lit(")  "), "t").alias("line"))


def resolvable(variables: DataFrame) -> DataFrame:
    """(``asset_id``, ``ref``, ``name``): what a reference may be called, full names first, then the first holder of a last part."""
    full = variables.select("asset_id", F.col("name").alias("ref"), "name", F.lit(0).alias("how"), "ordinal")
    last = variables.select("asset_id", basename(F.col("name")).alias("ref"), "name", F.lit(1).alias("how"), "ordinal")
    first = F.min_by("name", F.struct("how", "ordinal")).alias("name")
    return full.union(last).groupBy("asset_id", "ref").agg(first)


def crs_containers(variables: DataFrame) -> DataFrame:
    """Variables that hold a reference system: by their name, or because a ``grid_mapping`` names them.

    A reference means the variable of that full name or, without one, the first with that last part.
    """
    by_name = variables.filter(is_crs_container(F.col("name"))).select("asset_id", "name")
    refs = variables.select("asset_id", F.col("attrs")["grid_mapping"].alias("wanted")).filter("coalesce(wanted, '') <> ''").distinct()
    tried = refs.select("asset_id", "wanted", F.posexplode(F.array("wanted", basename(F.col("wanted")))).alias("how", "ref"))
    met = tried.join(resolvable(variables), ["asset_id", "ref"]).groupBy("asset_id", "wanted").agg(F.min_by("name", "how").alias("name"))
    names = by_name.union(met.select("asset_id", "name")).distinct()
    return variables.join(names, ["asset_id", "name"], "left_semi")

"""Resolve many inputs at once from tables of what probes and catalogues answered.

No request is made here. A probe run elsewhere leaves request rows, a catalogue lookup a
record; this turns them into one access row and the findings of each input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import access, formats

FINDING = "struct<id:string,status:string,evidence:string,remediation:string>"


def _finding(cid: str, status, evidence, remedy=None) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(cid).alias("id"), lit(status).alias("status"), lit(evidence).alias("evidence"), lit(remedy).alias("remediation")).cast(FINDING)


def range_finding(kind: Column) -> Column:
    """Finding D1-range for a probe's classification; without a probe it is skipped."""
    evidence = (
        F.when(kind == "ok", "ranged reads work").when(kind == "no-range-support", "the endpoint answers but ignores ranges")
        .when(kind == "auth-required", "sign-in is needed before ranges can be tried").otherwise("no probe")
    )
    return _finding("D1-range", access.range_status(kind), evidence, F.when(kind == "no-range-support", "serve the data where range requests are honoured"))


def store_error_finding(text: Column) -> Column:
    """Finding D2-auth, skipped, for the text of an access error."""
    kind = access.classify_store_error(text)
    evidence = (
        F.when(kind == "credentials-endpoint-auth", "sign-in credentials are missing, expired or without access")
        .when(kind == "in-region-only", "credentials were given but the read was denied: most likely it must run in the data's region")
        .otherwise(F.concat(F.lit("access failed: "), text))
    )
    remedy = F.when(kind == "credentials-endpoint-auth", "check token, user name and password").when(kind == "in-region-only", "run in the data's region")
    return _finding("D2-auth", "skipped", evidence, remedy)


def probe_summary(probes: DataFrame) -> DataFrame:
    """(``asset_id``, ``kind``, ``etag``, ``ttfb_s``, ``error``) from request rows (``asset_id``, ``seq``, ``stage``, ``status_code``, ``error``, ``etag``, ``seconds``)."""
    found = probes.withColumn("c", access.classify_access(F.col("stage"), F.col("status_code"), F.col("error")))
    at = lambda stage, what: F.max_by(F.when(F.col("stage") == stage, F.col(what)), F.when(F.col("stage") == stage, F.col("seq")))
    one = found.groupBy("asset_id").agg(at("head", "c").alias("head"), at("range-get", "c").alias("ranged"), F.max_by("etag", F.when(F.col("etag").isNotNull(), F.col("seq"))).alias("etag"), at("range-get", "seconds").alias("ttfb_s"), F.max_by("error", F.when(F.col("error").isNotNull(), F.col("seq"))).alias("error"))
    return one.select("asset_id", access.combine_access(F.col("head"), F.col("ranged")).alias("kind"), "etag", "ttfb_s", "error")


def resolve_access(inputs: DataFrame, probes: DataFrame | None = None, records: DataFrame | None = None, no_network: bool = False) -> DataFrame:
    """One row per input (``asset_id``, ``input``): ``kind``, ``url``, ``auth``, ``etag``, ``cmr`` and ``findings``.

    ``auth`` is ``local``, ``no-network``, ``anonymous``, ``credentials`` (a granule whose record names an
    endpoint) or ``error``. A granule resolves to its first S3 address, else its first HTTPS one.
    """
    spark = inputs.sparkSession
    probes = probes if probes is not None else spark.createDataFrame([], "asset_id string, seq long, stage string, status_code int, error string, etag string, seconds double")
    records = records if records is not None else spark.createDataFrame([], "asset_id string, record string")
    rows = inputs.select("asset_id", "input", formats.detect_input(F.col("input")).alias("input_kind")).join(records.select("asset_id", "record"), "asset_id", "left").join(probe_summary(probes), "asset_id", "left")
    rows = rows.withColumn("urls", access.related_urls(F.col("record")))
    granule, local = F.col("input_kind") == "granule-id", F.col("input_kind") == "local"
    url = F.when(granule, F.coalesce(F.get("urls.s3_urls", F.lit(0)), F.get("urls.https_urls", F.lit(0)))).otherwise(F.col("input"))
    rows = rows.withColumn("url", url)
    offline = F.lit(no_network) & ~local
    lost = granule & F.col("url").isNull()
    denied = F.col("kind") == "auth-required"
    auth = (
        F.when(local, "local").when(offline, "no-network").when(lost, "error").when(granule & F.col("urls.credentials_url").isNotNull() & F.col("url").startswith("s3://"), "credentials")
        .when(F.coalesce(denied, F.lit(False)), "error").otherwise("anonymous")
    )
    findings = (
        F.when(local, F.array(_finding("D0-hosting", "skipped", "a local copy; hosting cannot be assessed", "assess the hosted address instead")))
        .when(offline, F.array(_finding("D0-network", "skipped", "no network: nothing was probed")))
        .when(lost, F.array(_finding("D2-auth", "fail", F.when(F.col("record").isNull(), "the granule was not found").otherwise("the granule has no data address"), "check the granule's id or give an address")))
        .otherwise(F.array_compact(F.array(range_finding(F.col("kind")), F.when(F.coalesce(denied, F.lit(False)) & F.col("error").isNotNull(), store_error_finding(F.col("error"))), F.when(F.col("auth") == "credentials", _finding("D2-auth", "pass", "signed in through the catalogue's endpoint")))))
    )
    rows = rows.withColumn("auth", auth).withColumn("findings", findings)
    return rows.select("asset_id", "input", "input_kind", F.coalesce("url", "input").alias("url"), "auth", "etag", access.catalogue_meta(F.col("record")).alias("cmr"), "findings")


def finding_rows(resolved: DataFrame) -> DataFrame:
    """The findings as rows (``asset_id``, ``seq``, ``id``, ``status``, ``evidence``, ``remediation``)."""
    return resolved.select("asset_id", F.posexplode("findings").alias("seq", "f")).select("asset_id", F.col("seq").cast("bigint").alias("seq"), "f.*")

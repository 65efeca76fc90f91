"""The rubric: facts of an asset, 21 checks, roll-up, caps, tier, verdict, confidence.

Everything is keyed by ``asset_id``. Child tables are reduced to one row per asset before
they are joined, so the only shuffles are the aggregations by asset; the checks are then a
list of structs built from one row, without a join per check.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codecs, fixed, geometry

PARTS = {c: (d, p) for c, d, p in fixed.CHECKS}

#: What to do for a format that hampers reads over the network.
MIGRATIONS = {
    "netcdf3": "required: convert to chunked, compressed NetCDF-4 or consolidated Zarr; reference files in the meantime",
    "grib2": "required: publish reference or index files now and convert to Zarr for good",
    "shapefile": "required: convert to Parquet for analysis or FlatGeobuf for the web",
    "csv": "required: rewrite as Parquet with zstd",
    "hdf4": "required: convert to HDF5 with paged metadata, to COG, or to consolidated Zarr",
    "zip": "required: unpack and publish the members themselves",
    "tar": "required: unpack and publish the members themselves",
    "gzip": "required: unpack and publish the members themselves",
}
D_REMEDIES = {
    "D1-range": "let the endpoint answer range requests with 206",
    "D2-auth": "document the sign-in and check credentials and requester-pays settings",
    "D3-https-cors": "serve over HTTPS with a valid certificate and CORS headers for browsers",
    "D4-cleanpath": "take redirects and interstitial pages out of the data addresses",
}
GENERIC_REMEDY = "no remedy recorded; look into the finding"


def variable_facts(variables: DataFrame) -> DataFrame:
    """One row per asset from its inventory."""
    chunked = F.coalesce(F.size("chunks"), F.lit(0)) > 0
    elements = F.when(F.coalesce(F.size("shape"), F.lit(0)) > 0, geometry.product(F.col("shape")))
    chunk_bytes = F.col("size_bytes") / F.greatest(F.coalesce(elements, F.lit(1)), F.lit(1)) * geometry.product(F.col("chunks"))
    return variables.groupBy("asset_id").agg(
        F.count("*").alias("n_variables"),
        F.count_if(chunked).alias("n_chunked"),
        F.coalesce(F.some(chunked & elements.isNotNull() & (chunk_bytes < 1_000_000)), F.lit(False)).alias("tiny_chunks"),
        F.min_by(F.struct(F.lower(F.coalesce("codec", F.lit(""))).alias("codec")), "ordinal").alias("first"),
        F.some(F.coalesce(F.size("attrs"), F.lit(0)) > 0).alias("any_attrs"),
    )


def assessed_facts(assessed: DataFrame) -> DataFrame:
    """One row per asset from its assessed variables (``grade``, ``profiles``, ``shape``, ``chunks``, ``codec``)."""
    graded = F.when(F.col("grade") != "unknown", F.col("grade"))
    agentic = F.nullif(F.col("profiles")["agentic"], F.lit("unknown"))
    known = (F.coalesce(F.size("shape"), F.lit(0)) > 0) & (F.coalesce(F.size("chunks"), F.lit(0)) > 0)
    rows = assessed.select(
        "asset_id", "ordinal", "codec", graded.alias("graded"), agentic.alias("agentic"), known.alias("known"),
        F.when(known, geometry.chunk_count(F.col("shape"), F.col("chunks"))).alias("grid"), codecs.judge_codec(F.col("codec")).alias("judged"), codecs.codec_remedy(F.col("codec")).alias("remedy"),
    )
    c = F.col
    return rows.groupBy("asset_id").agg(
        F.count("graded").alias("n_graded"), F.every(c("graded") == "pass").alias("grades_pass"), F.every(c("graded") == "fail").alias("grades_fail"),
        F.count("agentic").alias("n_agentic"), F.every(c("agentic") == "within").alias("agentic_within"), F.max("known").alias("grid_known"), F.coalesce(F.sum("grid"), F.lit(0)).alias("n_chunks"),
        F.count("*").alias("n_codecs"), F.every(c("judged") == "pass").alias("codecs_pass"), F.every(c("judged") == "fail").alias("codecs_fail"),
        F.array_join(F.array_sort(F.collect_set("codec")), ", ").alias("codec_names"), F.min_by("remedy", F.when(c("remedy").isNotNull(), c("ordinal"))).alias("codec_remedy"),
    )


def finding_facts(findings: DataFrame) -> DataFrame:
    """Per asset a map from id to its first finding, and the evidence of the first ``D0-`` finding."""
    first = findings.groupBy("asset_id", F.when(F.col("id").startswith("D0-"), F.lit("D0")).otherwise(F.col("id")).alias("id")).agg(
        F.min_by(F.struct("status", "evidence", "remediation"), "seq").alias("f")
    )
    return first.groupBy("asset_id").agg(F.map_from_entries(F.collect_list(F.struct("id", "f"))).alias("findings"))


def facts(assets: DataFrame, variables: DataFrame, assessed: DataFrame, cf: DataFrame | None = None, containers: DataFrame | None = None, findings: DataFrame | None = None) -> DataFrame:
    """One row per asset with everything that the checks look at.

    ``variables`` is the full inventory, ``assessed`` its selected part after ``assess_chunking``.
    """
    out = assets.join(variable_facts(variables), "asset_id", "left").join(assessed_facts(assessed), "asset_id", "left")
    if cf is None:
        out = out.withColumn("cf_status", F.lit(None).cast("string")).withColumn("grid_mapping_ok", F.lit(False)).withColumn("cf_evidence", F.lit(None).cast("string"))
    else:
        mapped = F.coalesce(F.exists("checks", lambda c: (c["id"] == "grid_mapping") & F.coalesce(c["ok"], F.lit(False))), F.lit(False))
        told = F.array_join(F.transform("checks", lambda c: F.concat(c["id"], F.lit("="), F.coalesce(c["ok"].cast("string"), F.lit("n/a")))), "; ")
        out = out.join(cf.select("asset_id", F.col("status").alias("cf_status"), mapped.alias("grid_mapping_ok"), told.alias("cf_evidence")), "asset_id", "left")
    if containers is None:
        out = out.withColumn("n_containers", F.lit(0))
    else:
        out = out.join(containers.groupBy("asset_id").agg(F.count("*").alias("n_containers")), "asset_id", "left")
    if findings is None:
        return out.withColumn("findings", F.lit(None).cast("map<string,struct<status:string,evidence:string,remediation:string>>"))
    return out.join(finding_facts(findings), "asset_id", "left")


@dataclass
class Check:
    """The columns of one check. Points, evidence and remedy may refer to the status by ``_status(cid)``."""

    cid: str
    awarded: Column
    status: Column
    evidence: Column
    remedy: Column | None = None


def _status(cid: str) -> Column:
    return F.col(f"s_{cid}")


def _check(cid: str, awarded: Column, status: Column, evidence: Column, remedy: Column | None = None) -> Check:
    return Check(cid, awarded, status, evidence, remedy)


def _unless_pass(cid: str, text: str) -> Column:
    return F.when(_status(cid) != "pass", text)


def _case(pairs, otherwise) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    first, *rest = pairs
    return reduce(lambda c, p: c.when(p[0], lit(p[1])), rest, F.when(first[0], lit(first[1]))).otherwise(lit(otherwise))


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _has(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)) > 0


def class_check() -> Check:
    fmt, codec = F.col("format"), F.coalesce(F.col("first")["codec"], F.lit(""))
    base = _case([(_yes(fmt.isin(*fixed.CLOUD_NATIVE)), 26), (_yes(fmt.isin(*fixed.CLOUD_OPTIMIZABLE)), 14), (_yes(fmt.isin(*fixed.CLOUD_HOSTILE)), 4)], 10)
    no_overviews = _yes(F.size("overviews") == 0)
    cog = _case([(_yes(F.col("cog_valid")), 4), (_yes(~F.col("cog_valid")), -12)], 0) + F.when(no_overviews, -4).otherwise(0) + F.when(codec.isin("", "none"), -2).otherwise(0)
    zarr = _case([(_yes(F.col("consolidated")), 4), (_yes(~F.col("consolidated")), -4)], 0)
    hdf5 = _case([(_has("n_variables") & ~_has("n_chunked"), -6), (_yes(F.col("tiny_chunks")), -4), (_has("n_chunked"), 4)], 0)
    is_in = lambda *f: _yes(fmt.isin(*f))
    adjust = _case([(is_in("cog"), cog), (is_in("zarr", "icechunk", "kerchunk"), zarr), (is_in("hdf5", "netcdf4"), hdf5)], 0)
    score = F.greatest(F.lit(0.0), F.least(F.lit(30.0), (base + adjust).cast("double")))
    status = F.when(F.col("p_A-class") >= 22, "pass").when(F.col("p_A-class") >= 10, "partial").otherwise("fail")
    remedy = _case(
        [
            (is_in("cog") & _yes(~F.col("cog_valid")), "rewrite as a valid COG with compression and overviews"),
            (is_in("cog") & no_overviews, "add overviews"),
            (is_in("zarr", "icechunk", "kerchunk") & _yes(~F.col("consolidated")), "consolidate the store's metadata"),
            (is_in("hdf5", "netcdf4") & _has("n_variables") & ~_has("n_chunked"), "repack with chunks"),
            (is_in("hdf5", "netcdf4") & _yes(F.col("tiny_chunks")), "repack with chunks of 1 MB or more"),
            *[(is_in(f), text) for f, text in MIGRATIONS.items()],
        ],
        F.lit(None).cast("string"),
    )
    return _check("A-class", score, status, F.concat(F.lit("format="), F.coalesce(fmt, F.lit("none")), F.lit(", points="), F.col("p_A-class").cast("string")), remedy)


def open_status() -> tuple[Column, Column]:
    r, fmt = F.col("requests_to_open"), F.col("format")
    cases = [
        (_yes(r <= 3), 8, "pass"), (_yes(r <= 10), 5, "partial"), (r.isNotNull(), 1, "fail"),
        (_yes(fmt.isin(*fixed.FRONT_LOADED)), 7, "pass"), (_yes(fmt == "zarr") & _yes(F.col("consolidated")), 8, "pass"), (_yes(fmt.isin(*fixed.CLOUD_HOSTILE)), 1, "fail"),
    ]
    return _case([(c, p) for c, p, _ in cases], 4), _case([(c, s) for c, _, s in cases], "skipped")


def locality_checks() -> list[Check]:
    points, status = open_status()
    r = F.col("requests_to_open")
    b1 = _check("B1-open", points, status, F.when(r.isNotNull(), F.concat(F.lit("requests_to_open="), r.cast("string"))).otherwise("not measured; inferred from the format"), _unless_pass("B1-open", "bring metadata to the front or consolidate it"))
    found = (F.coalesce(F.col("crs"), F.lit("")) != "") | _has("n_containers") | _yes(F.col("grid_mapping_ok"))
    ran = _yes(F.col("smoke_status").isin("pass", "fail"))
    s2 = F.when(found, "pass").when(ran, "fail").otherwise("skipped")
    b2 = _check("B2-crs", F.when(found, 3.0).when(ran, 0.0).otherwise(1.5), s2, F.when(found, "a reference system was found").otherwise("no machine-readable reference system"), _unless_pass("B2-crs", "store the reference system in the file or name it with grid_mapping"))
    cf = F.col("cf_status")
    s3 = _case([(_yes(cf == "pass"), "pass"), (_yes(cf == "warn"), "partial"), (_yes(cf == "fail"), "fail")], "skipped")
    p3 = _case([(_yes(cf == "pass"), 5.0), (_yes(cf == "warn"), 3.0), (_yes(cf == "fail"), 1.0)], 2.5)
    b3 = _check("B3-semantics", p3, s3, F.coalesce(F.nullif("cf_evidence", F.lit("")), F.lit("not evaluated")), _unless_pass("B3-semantics", "declare units, names, fill values, scale and grid mapping"))
    fmt = F.col("format")
    p4 = F.when(F.coalesce(fmt, F.lit("unknown")).isin("unknown", ""), 0.0).otherwise(1.5) + F.when(_yes(cf.isin("pass", "warn")), 1.5).otherwise(0.0) + F.when(_yes(F.col("any_attrs")), 1.0).otherwise(0.0)
    got = F.col("p_B4-catalog")
    s4 = F.when(got == 0, "n/a").when(got >= 3, "pass").otherwise("partial")
    b4 = _check("B4-catalog", p4, s4, F.concat(F.lit("evidence points="), got.cast("string")), F.when(_status("B4-catalog") == "partial", "add a media type, roles and richer attributes to the file"))
    return [b1, b2, b3, b4]


def chunk_checks() -> list[Check]:
    n, every, none = _has("n_graded"), _yes(F.col("grades_pass")), _yes(F.col("grades_fail"))
    by_grade = lambda a, b, c, d: _case([(~n, a), (every, b), (none, c)], d)
    evidence = F.concat(F.lit("graded variables="), F.coalesce("n_graded", F.lit(0)).cast("string"))
    flat = _yes(F.col("format") == "cog") & _yes(F.size("overviews") == 0)
    status = by_grade("skipped", "pass", "fail", "partial")
    s1 = F.when(flat, "fail").otherwise(status)
    c1 = _check("C1-interactive", F.when(flat, 0.0).otherwise(by_grade(2.5, 5.0, 0.0, 2.0)), s1, F.when(flat, F.concat(evidence, F.lit("; no overviews"))).otherwise(evidence), _unless_pass("C1-interactive", "aim at chunks of 1-4 MB and overviews"))
    c2 = _check("C2-training", by_grade(3.5, 7.0, 0.0, 2.8), status, evidence, _unless_pass("C2-training", "rechunk to 32-64 MB chunks or shards along the sampling pattern"))
    fit, opened = _yes(F.col("agentic_within")), _status("B1-open")
    cases = [(~_has("n_agentic"), 3.5, "skipped"), (fit & (opened == "pass"), 7.0, "pass"), (fit & (opened == "partial"), 4.2, "partial"), (~fit & (opened == "pass"), 2.8, "partial")]
    s3 = _case([(c, s) for c, _, s in cases], "fail")
    c3 = _check("C3-agentic", _case([(c, p) for c, p, _ in cases], 1.0), s3, F.concat(F.lit("fit="), fit.cast("string"), F.lit("; open="), opened), _unless_pass("C3-agentic", "consolidate metadata, keep addresses stable, 1-16 MB chunks"))
    known, few = _yes(F.col("grid_known")), F.coalesce(F.col("n_chunks"), F.lit(0)) < fixed.MAX_CHUNKS
    s4 = F.when(~known, "skipped").when(few, "pass").otherwise("fail")
    c4 = _check("C4-count", F.when(~known, 1.5).when(few, 3.0).otherwise(0.0), s4, F.when(known, F.concat(F.lit("chunks="), F.col("n_chunks").cast("string"))).otherwise("no chunk grid"), F.when(_status("C4-count") == "fail", "put chunks into shards of 64-256 MB"))
    seen, modern, bare = _has("n_codecs"), _yes(F.col("codecs_pass")), _yes(F.col("codecs_fail"))
    s5 = F.when(~seen, "skipped").when(modern, "pass").when(bare, "fail").otherwise("partial")
    c5 = _check("C5-codec", F.when(~seen, 1.5).when(modern, 3.0).when(bare, 0.0).otherwise(1.8), s5, F.when(seen, F.concat(F.lit("codecs="), F.coalesce("codec_names", F.lit("")))).otherwise("no codec seen"), F.when(_status("C5-codec").isin("fail", "partial"), F.coalesce("codec_remedy", F.lit("recompress with zstd level 3 and shuffle"))))
    return [c1, c2, c3, c4, c5]


def access_checks() -> list[Check]:
    out = []
    for cid in D_REMEDIES:
        points = float(PARTS[cid][1])
        f = F.try_element_at(F.col("findings"), F.lit(cid))
        reason = F.coalesce(F.concat(F.lit("not verified live: "), F.try_element_at(F.col("findings"), F.lit("D0"))["evidence"]), F.lit("not verified live"))
        status = F.when(f.isNull(), "skipped").when(f["status"].isin("warn", "partial"), "partial").when(f["status"].isin("pass", "skipped"), f["status"]).otherwise("fail")
        awarded = F.when(_status(cid) == "pass", points).when(_status(cid) == "fail", 0.0).otherwise(points / 2)
        out.append(_check(cid, awarded, status, F.coalesce(F.nullif(f["evidence"], F.lit("")), reason), f["remediation"]))
    return out


def reproducibility_checks() -> list[Check]:
    ice, tag = _yes(F.col("format") == "icechunk"), F.coalesce(F.col("etag"), F.lit("")) != ""
    strong = tag & ~F.coalesce(F.col("etag").startswith("W/"), F.lit(False))
    told = F.concat(F.lit("etag="), F.coalesce("etag", F.lit("none")))
    e1 = _check("E1-version", F.when(ice, 2.0).when(tag, 1.0).otherwise(0.5), F.when(ice, "pass").when(tag, "partial").otherwise("fail"), told, F.when(~ice & ~tag, "version the data: snapshots or stable ETags"))
    e2 = _check("E2-checksums", F.when(ice, 2.0).when(strong, 1.0).otherwise(0.0), F.when(ice, "pass").when(strong, "partial").otherwise("fail"), told, F.when(~ice & ~strong, "publish checksums or serve strong ETags"))
    cmr = F.col("cmr")

    def listed(cid: str, held: Column, remedy: str) -> Check:
        points = float(PARTS[cid][1])
        held = F.coalesce(held, F.lit(False))
        status = F.when(cmr.isNull(), "skipped").when(held, "pass").otherwise("fail")
        return _check(cid, F.when(cmr.isNull(), points / 2).when(held, points).otherwise(0.0), status, F.when(cmr.isNull(), "no catalogue record").when(held, "in the catalogue record").otherwise("not in the catalogue record"), _unless_pass(cid, remedy))

    keywords, words = F.coalesce(cmr["n_keywords"], F.lit(0)), F.coalesce(cmr["description_len"], F.lit(0))
    rich, thin = (keywords >= 3) | (words >= 200), (keywords > 0) | (words > 0)
    s7 = F.when(cmr.isNull(), "skipped").when(rich, "pass").when(thin, "partial").otherwise("fail")
    e7 = _check("E7-applications", F.when(rich & cmr.isNotNull(), 1.0).when(cmr.isNull() | thin, 0.5).otherwise(0.0), s7, F.concat(F.lit("keywords="), keywords.cast("string"), F.lit(", description="), words.cast("string")), _unless_pass("E7-applications", "describe the data and its uses in the catalogue"))
    return [
        e1, e2, listed("E3-license", F.coalesce(cmr["license"], F.lit("")) != "", "add a machine-readable license"),
        listed("E4-citation", F.coalesce(cmr["doi"], F.lit("")) != "", "add a DOI or citation"), listed("E5-contact", cmr["contact"], "add a contact"),
        listed("E6-usage", F.size(cmr["doc_links"]) > 0, "link examples or notebooks in the catalogue"), e7,
    ]


def checks(fact_rows: DataFrame) -> DataFrame:
    """21 rows per asset in order (``seq``); every failed or partial check has a remedy.

    Statuses and points are columns of their own before the rows are built, so that what
    refers to them is not expanded again and the generated code stays small. Points are rounded
    once the rows are there, but for those that a status follows from.
    """
    by_points = ("A-class", "B4-catalog")  # their status follows from their points
    built = [class_check(), *locality_checks(), *chunk_checks(), *access_checks(), *reproducibility_checks()]
    rows = fact_rows.withColumns({f"p_{c.cid}": geometry.half_even(c.awarded, 1) for c in built if c.cid in by_points})
    rows = rows.withColumns({f"s_{c.cid}": c.status.cast("string") for c in built if c.cid != "C3-agentic"})
    rows = rows.withColumns({f"s_{c.cid}": c.status.cast("string") for c in built if c.cid == "C3-agentic"})
    rows = rows.withColumns({f"p_{c.cid}": c.awarded.cast("double") for c in built if c.cid not in by_points})
    rows = rows.withColumns({f"e_{c.cid}": c.evidence.cast("string") for c in built} | {f"r_{c.cid}": (F.lit(None) if c.remedy is None else c.remedy).cast("string") for c in built})
    listed = [
        F.struct(
            F.lit(c.cid).alias("id"), F.lit(PARTS[c.cid][0]).alias("dimension"), F.lit(float(PARTS[c.cid][1])).alias("points_possible"), F.col(f"p_{c.cid}").alias("points_awarded"),
            _status(c.cid).alias("status"), F.col(f"e_{c.cid}").alias("evidence"), F.col(f"r_{c.cid}").alias("remediation"),
        )
        for c in built
    ]
    rows = rows.select("asset_id", "format", "smoke_status", F.posexplode(F.array(*listed)).alias("seq", "c")).select("asset_id", "format", "smoke_status", "seq", "c.*")
    rows = rows.withColumn("points_awarded", geometry.half_even(F.col("points_awarded"), 1))
    lookup = lambda table, key: F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)
    missing = F.col("status").isin("fail", "partial") & (F.coalesce("remediation", F.lit("")) == "")
    filled = F.coalesce(F.when(F.col("id") == "A-class", lookup(MIGRATIONS, F.col("format"))), lookup(D_REMEDIES, F.col("id")), F.lit(GENERIC_REMEDY))
    return rows.withColumn("remediation", F.when(missing, filled).otherwise(F.col("remediation")))


def tier(score: Column) -> Column:
    return reduce(lambda c, t: c.when(score >= t[0], t[1]), fixed.TIERS[1:], F.when(score >= fixed.TIERS[0][0], fixed.TIERS[0][1])).otherwise("F")


def dimension_scores(check_rows: DataFrame) -> DataFrame:
    """Five rows per asset: points of the checks that apply, scaled to the dimension's weight; 0 without any."""
    counted = check_rows.filter("status <> 'n/a'").groupBy("asset_id", "dimension").agg(F.sum("points_awarded").alias("got"), F.sum("points_possible").alias("possible"))
    weights = F.array(*[F.struct(F.lit(d).alias("dimension"), F.lit(float(w)).alias("weight")) for d, w, _ in fixed.DIMENSIONS])
    every = check_rows.select("asset_id").distinct().select("asset_id", F.inline(weights))
    return every.join(counted, ["asset_id", "dimension"], "left").select("asset_id", "dimension", "weight", geometry.half_even(F.coalesce(F.try_divide("got", "possible") * F.col("weight"), F.lit(0.0)), 1).alias("score"))


def score(check_rows: DataFrame) -> DataFrame:
    """One row per asset: raw score, caps, score, tier, verdict with reason, confidence and the five dimensions."""
    scaled = []
    for d, w, _ in fixed.DIMENSIONS:
        own = (F.col("dimension") == d) & (F.col("status") != "n/a")
        got, possible = F.sum(F.when(own, F.col("points_awarded"))), F.sum(F.when(own, F.col("points_possible")))
        scaled.append(F.coalesce(F.try_divide(got, possible) * F.lit(float(w)), F.lit(0.0)))
    blocking = F.col("id").isin(*fixed.CONSUMER_VISIBLE) & (F.col("status") == "fail")
    one = check_rows.groupBy("asset_id").agg(
        F.array(*scaled).alias("scaled"), F.first("smoke_status").alias("smoke"), F.count_if(F.col("status") == "skipped").alias("n_skipped"), F.count_if(F.col("status").isin("partial", "fail")).alias("n_gaps"),
        F.transform(F.array_sort(F.collect_list(F.when(blocking, F.struct("seq", "id")))), lambda x: x["id"]).alias("blocking"),
    )
    one = one.withColumn("scaled", F.transform("scaled", lambda x: geometry.half_even(x, 1)))
    one = one.withColumns({f"dim_{d.lower()}": F.col("scaled")[i] for i, (d, _, _) in enumerate(fixed.DIMENSIONS)})
    raw = geometry.half_even(reduce(lambda a, b: a + b, [F.col(f"dim_{d.lower()}") for d, _, _ in fixed.DIMENSIONS]), 1)
    smoke, blocked = F.coalesce(F.col("smoke") == "fail", F.lit(False)), F.size("blocking") > 0
    one = one.withColumn("raw_score", raw).withColumn("score", F.when((smoke | blocked) & (F.col("raw_score") > fixed.CAP), fixed.CAP).otherwise(F.col("raw_score")))
    over = F.col("raw_score") > fixed.CAP
    cap = F.array_compact(F.array(F.when(smoke & over, "smoke_fail_cap_74"), F.when(~smoke & blocked & over, "consumer_visible_fail_cap_74")))
    verdict = F.when(smoke | blocked, "NOT READY").when(F.col("n_gaps") > 0, "READY WITH CAVEATS").otherwise("READY")
    reason = F.when(smoke, "the smoke test failed: the data could not be read").when(blocked, F.concat(F.lit("failures that readers meet: "), F.array_join("blocking", ", "))).when(F.col("n_gaps") > 0, "nothing blocks readers, but some checks have gaps").otherwise("all assessed checks pass")
    confidence = F.when(F.col("n_skipped") == 0, "High").when(F.col("n_skipped") <= 3, "Reduced").otherwise("Low")
    return one.select("asset_id", *[f"dim_{d.lower()}" for d, _, _ in fixed.DIMENSIONS], "raw_score", "score", tier(F.col("score")).alias("tier"), verdict.alias("verdict"), reason.alias("verdict_reason"), confidence.alias("confidence"), "n_skipped", cap.alias("caps"))


def remediations(check_rows: DataFrame) -> DataFrame:
    """(``asset_id``, ``rank``, ``id``, ``points_possible``, ``remediation``): gaps by points at stake, each text of a check once."""
    gaps = check_rows.filter(F.col("status").isin("fail", "partial") & (F.coalesce("remediation", F.lit("")) != ""))
    once = gaps.groupBy("asset_id", "id", "remediation").agg(F.max("points_possible").alias("points_possible"), F.min("seq").alias("seq"))
    order = Window.partitionBy("asset_id").orderBy(F.desc("points_possible"), "seq")
    return once.withColumn("rank", F.row_number().over(order)).select("asset_id", "rank", "id", "points_possible", "remediation")

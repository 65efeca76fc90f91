"""Band edges, scenarios and determinism of the assessment operators."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.functions import access, codecs, fixed, formats, geometry, names
from cairn.operators import compression, conventions, inventory, rendering, sampling, scoring, telemetry
from cairn.plans import assess
from cairn.schema import ASSETS, FINDINGS, VARIABLES, conform

L, S = "array<bigint>", "array<string>"


def column(spark, rows, schema, expression):
    """Values of an expression over rows, in order."""
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}").coalesce(1)
    return [r.x for r in frame.select("i", expression.alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize("mb, band", [(0.9, "fail"), (1.0, "warn"), (3.9, "warn"), (4.0, "pass"), (16.0, "pass"), (63.9, "pass"), (64.1, "warn"), (None, "unknown")])
def test_grade_bands(spark, mb, band):
    assert column(spark, [(mb,)], "m double", geometry.grade(F.col("m"))) == [band]


def test_three_digits(spark):
    got = column(spark, [(0.5,), (8.0,), (12.345,), (123.4,), (0.01234,), (63.96,)], "m double", geometry.three_digits(F.col("m")))
    assert got == ["0.5", "8", "12.3", "123", "0.0123", "64"]


def test_tiers(spark):
    edges = [(100.0, "A"), (90.0, "A"), (89.9, "B"), (75.0, "B"), (74.9, "C"), (55.0, "C"), (54.9, "D"), (35.0, "D"), (34.9, "F"), (0.0, "F")]
    assert column(spark, [(s,) for s, _ in edges], "s double", scoring.tier(F.col("s"))) == [t for _, t in edges]


def test_orientation(spark):
    rows = [
        (["time", "lat", "lon"], [8760, 720, 1440], [8760, 32, 32], "timeseries-optimized"), (["time", "lat", "lon"], [8760, 720, 1440], [1, 720, 1440], "map-optimized"),
        (["time", "lat", "lon"], [8760, 720, 1440], [168, 180, 360], "balanced"), (["y", "x"], [10980, 10980], [512, 512], "tiled"),
        ([], [], [], "unknown"), (["time", "lat"], [10, 10], None, "unknown"), (["a"], [100], [10], "tiled"), (["a", "b"], [100, 10], [1, 10], "map-optimized"),
    ]
    got = column(spark, [r[:3] for r in rows], f"d {S}, s {L}, c {L}", geometry.orientation(F.col("d"), F.col("s"), F.col("c"), F.lit(1.0), "timeseries"))
    assert [g.orientation for g in got] == [r[3] for r in rows]
    assert got[0].series_read.chunks_touched == 1 and got[1].series_read.chunks_touched == 8760 and got[1].series_read.grade == "fail"
    assert got[1].map_read.chunks_touched == 1 and got[1].map_read.grade is None and got[3].scene_read.chunks_touched == 22 * 22
    assert [g.hedged for g in got][6:] == [True, True]


def test_zero_extents_do_not_fail(spark):
    got = column(spark, [([0, 5], [0, 5]), ([5], [0]), ([], []), (None, None)], f"s {L}, c {L}", geometry.chunk_count(F.col("s"), F.col("c")))
    assert got == [None, None, None, None]


def test_geometry_values(spark):
    assert column(spark, [([100, 50], "float32"), ([2], "decimal128(15, 2)"), ([], "int8"), (None, "int8")], f"c {L}, d string", geometry.estimate_mb(F.col("c"), F.col("d"))) == [0.01, 0.0, None, None]
    assert column(spark, [([3, 4],), ([],), (None,)], f"s {L}", geometry.element_count(F.col("s"))) == [12, 0, 0]
    nan = float("nan")
    assert column(spark, [([nan] * 9 + [1.0],), ([nan] * 8 + [1.0] * 2,), ([],), (None,), ([0.0] * 10,)], "v array<double>", geometry.data_bearing(F.col("v"), F.lit(0.0))) == [False, True, False, False, False]


@pytest.mark.parametrize("shape, chunks, most", [([100, 100], [10, 10], 9), ([20, 20], [10, 10], 100), ([100], [10], 3), ([4, 1000, 3], [1, 1, 1], 40), ([10**9], [7], 32), ([2, 2, 10**6], [1, 1, 10], 32)])
def test_interior_chunks(spark, shape, chunks, most):
    grid = [-(-s // c) for s, c in zip(shape, chunks, strict=True)]
    centre = [g // 2 for g in grid]
    near = [range(max(0, c - 40), min(g, c + 41)) for g, c in zip(grid, centre, strict=True)]
    cells = [[]]
    for axis in near:
        cells = [p + [x] for p in cells for x in axis]
    cells.sort(key=lambda p: (max(abs(x - c) for x, c in zip(p, centre, strict=True)), sum((x - c) ** 2 for x, c in zip(p, centre, strict=True)), p))
    frame = spark.createDataFrame([("a", 0, "v", shape, chunks)], f"asset_id string, ordinal long, name string, shape {L}, chunks {L}")
    got = [r.idx for r in sampling.interior_chunks(frame, most).orderBy("rank").collect()]
    assert got == cells[:most]


def test_scan_interior_outcomes(spark):
    candidates = spark.createDataFrame([(a, "v", 0, r, [r]) for a in "pqrs" for r in range(1, 7)], f"asset_id string, name string, ordinal long, rank int, idx {L}")
    good, fill = [1.0, 2.0], [0.0, 0.0]
    rows = [("p", "v", [r], 10 * r, good if r != 2 else fill) for r in range(1, 7)] + [("q", "v", [3], 30, fill)] + [("s", "v", [1], 900, good), ("s", "v", [2], 200, good)]
    stored = spark.createDataFrame(rows, f"asset_id string, name string, idx {L}, size_bytes long, values array<double>").withColumn("fill", F.lit(0.0))
    got = {r.asset_id: r for r in sampling.scan_interior(candidates, stored, most=3, byte_cap=1000).collect()}
    assert (got["p"].sizes, got["p"].data_bearing) == ([10, 30, 40], True)
    assert (got["q"].sizes, got["q"].data_bearing, got["q"].measured) == ([30], False, True)
    assert (got["r"].sizes, got["r"].data_bearing, got["r"].measured) == ([], None, False)
    assert got["s"].sizes == [900] and "cap" in got["s"].note


def test_chunk_keys(spark):
    assert column(spark, [("c/0/12",), ("3.4",), ("/5/",), (".zarray",), ("a.b",), ("",)], "k string", sampling.parse_chunk_key(F.col("k"))) == [[0, 12], [3, 4], [5], None, None, None]


def test_sniffing(spark):
    head = lambda b: (bytearray(b),)
    cases = [
        (b"\x89HDF\r\n\x1a\n" + b"x" * 9, "hdf5"), (b"\0" * 512 + b"\x89HDF\r\n\x1a\n", "hdf5"), (b"CDF\x01", "netcdf3"), (b"CDF\x03", "unknown"), (b"\x0e\x03\x13\x01", "hdf4"),
        (b'{"refs": {}}', "kerchunk"), (b'{"version": 1, "templates": {}}', "kerchunk"), (b'["a"]', "unknown"), (b"PAR1", "parquet"), (b"II+\0", "cog"), (b"GRIB", "grib2"), (b"PK\x03\x04", "zip"),
        (b"\x1f\x8b", "gzip"), (b"\x01" * 257 + b"ustar" + b"\0" * 9, "tar"), (b"\x00\x00\x27\x0a", "shapefile"), (b"", "unknown"), (b"fgb", "flatgeobuf"), (b"LASF", "las"), (b"PMTiles", "pmtiles"),
    ]
    assert column(spark, [head(b) for b, _ in cases], "h binary", formats.sniff_bytes(F.col("h"))) == [f for _, f in cases]


def test_inputs_and_extensions(spark):
    texts = ["G123-PROV.A", "G-1", "HTTPS://x/y", "s3://b/k.zarr?x=.csv", "c:\\x", "/d/a.copc.laz", "https://h/p.NC4#f.csv", "plain", "ftp://h/x.tif"]
    kinds = column(spark, [(t,) for t in texts], "t string", formats.detect_input(F.col("t")))
    assert kinds == ["granule-id", "local", "url", "url", "local", "local", "url", "local", "local"]
    assert column(spark, [(t,) for t in texts], "t string", formats.ext_hint(F.col("t"))) == [None, None, None, "zarr", None, "copc", "hdf5", None, "cog"]
    assert column(spark, [("/a/b c/",)], "t string", formats.out_dirname(F.col("t"))) == ["cloud-readiness-b-c"]


def test_token_matching(spark):
    rows = [("/g/tas", "tas"), ("/g/tas", "/g/tas"), ("g/tas", "/g/tas"), ("/g/tas", "TA"), ("/g/tas", "x_"), ("/g/t%s", "%"), ("/g/tas", "%")]
    assert column(spark, rows, "n string, t string", names.token_matches(F.col("n"), F.col("t"))) == [True, True, True, True, False, True, False]


def variables(spark, rows):
    """Rows of (asset, name, dims, shape, dtype, chunks, attrs, size, codec)."""
    data = [(a, i, n, d, s, t, c, at, z, k) for i, (a, n, d, s, t, c, at, z, k) in enumerate(rows)]
    return spark.createDataFrame(data, VARIABLES)


def climate(spark, **changes):
    """A small well-described inventory; ``changes`` replace attributes by variable name."""
    base = {
        "tas": (["time", "lat", "lon"], [12, 180, 360], {"units": "K", "standard_name": "air_temperature", "grid_mapping": "crs"}), "time": (["time"], [12], {"units": "days since 2000-01-01"}),
        "lat": (["lat"], [180], {"units": "degrees_north"}), "lon": (["lon"], [360], {"units": "degrees_east"}), "crs": ([], [], {"grid_mapping_name": "latitude_longitude"}),
    }
    return variables(spark, [("a", f"/{n}", d, s, "float32", None, changes.get(n, at), None, None) for n, (d, s, at) in base.items()])


def one_asset(spark, **values):
    frame = spark.createDataFrame([("a",)], "asset_id string")
    for k, v in values.items():
        frame = frame.withColumn(k, v if not isinstance(v, (str, int, float, bool)) else F.lit(v))
    return conform(frame, ASSETS)


def cf(spark, rows, version="CF-1.7"):
    assets = one_asset(spark, global_attrs=F.create_map(F.lit("Conventions"), F.lit(version)))
    row = conventions.check_cf(assets, rows).first()
    return row.status, {c.id: c.ok for c in row.checks}


def test_cf_passes_and_mutations(spark):
    assert cf(spark, climate(spark)) == ("pass", {"conventions_attr": True, "units_and_name": True, "coordinate_identification": True, "grid_mapping": True, "fill_value_consistency": None, "scale_offset_typing": None, "bounds": None})
    assert cf(spark, climate(spark, tas={"units": "K"}))[1]["units_and_name"] is False
    assert cf(spark, climate(spark, time={"units": "days"}))[1]["coordinate_identification"] is False
    assert cf(spark, climate(spark, tas={"units": "K", "long_name": "t", "grid_mapping": "/nowhere"}))[1]["grid_mapping"] is False
    assert cf(spark, climate(spark, tas={"coordinates": "lat lon gone"}))[1]["coordinate_identification"] is False
    assert cf(spark, climate(spark, tas={"bounds": "lat"}))[1]["bounds"] is True
    assert cf(spark, climate(spark, tas={"scale_factor": "0.5", "add_offset": "x"}))[1]["scale_offset_typing"] is False
    assert cf(spark, climate(spark, tas={"_FillValue": "1.0", "missing_value": "1"}))[1]["fill_value_consistency"] is True
    assert cf(spark, climate(spark), "ACDD")[1]["conventions_attr"] is False
    bare = one_asset(spark, global_attrs=F.create_map().cast("map<string,string>"))
    assert conventions.check_cf(bare, climate(spark).withColumn("attrs", F.create_map().cast("map<string,string>"))).first().status == "skipped"


def test_rank_and_select(spark):
    rows = variables(spark, [
        ("a", "/g/HHHH", ["y", "x"], [8000, 6000], "complex64", [512, 512], {}, None, None), ("a", "/g/VVVV", ["y", "x"], [8000, 6000], "complex64", [512, 512], {}, None, None),
        ("a", "/quality/m", ["y", "x"], [9000, 9000], "int8", None, {}, None, None), ("a", "/g/lat_bnds", ["y"], [9], "f", None, {}, None, None), ("a", "/g/x", ["x"], [6000], "f", None, {}, None, None),
        ("a", "/g/projection", [], [], "int", None, {}, None, None), ("a", "/g/name", ["n"], [4], "|S10", None, {}, None, None), ("a", "/g/boundaryLayerHeight", ["y"], [8000], "float32", None, {}, None, None),
    ])
    for shuffled in (rows, rows.repartition(5), rows.orderBy(F.desc("name"))):
        assert [r.name for r in inventory.rank_variables(shuffled).orderBy("rank").collect()] == ["/g/HHHH", "/g/VVVV", "/g/boundaryLayerHeight"]
    answers = spark.createDataFrame([("a", " 1, HHHH,,42")], "asset_id string, raw string")
    tokens = inventory.parse_selection(rows, answers)
    assert [r.token for r in tokens.orderBy("pos").collect()] == ["/g/VVVV", "HHHH", "42"]
    assert [r.token for r in inventory.unmatched_tokens(rows, tokens.select("asset_id", "token")).collect()] == ["42"]
    assert inventory.inventory_lines(rows).filter("number = 0").first().line == "0  /g/HHHH  (y,x)×(8000,6000)  complex64"


def test_codecs(spark):
    text = [None, "", "NONE", "gzip+shuffle", "Zlib(level=7)", "blosc-gzip", "zstd-9", "ZstdCodec(level=3, checksum=False)", "blosc-zstd-4+shuffle", "Blosc(cname='lz4', clevel=2, shuffle=NOSHUFFLE)", "lzf"]
    assert column(spark, [(t,) for t in text], "c string", codecs.judge_codec(F.col("c"))) == ["fail"] * 3 + ["warn"] * 3 + ["pass"] * 4 + ["warn"]
    got = column(spark, [(t,) for t in text], "c string", codecs.parse_codec(F.col("c")))
    assert [(g.family, g.cname, g.level, g.shuffle) for g in got] == [("uncompressed", None, None, None)] * 3 + [("zlib", None, 4, True), ("zlib", None, 7, False), ("blosc", "zstd", 3, False), ("zstd", None, 9, False), ("zstd", None, 3, False), ("blosc", "zstd", 4, True), ("blosc", "lz4", 2, False), ("exotic", None, None, None)]


def test_keepbits_bound(spark):
    values = np.random.default_rng(1).normal(0, 50, 5000).astype(np.float32)
    for error in (0.001, 0.1, 5.0):
        keep = column(spark, [(values.astype(float).tolist(), error)], "v array<double>, e double", codecs.keepbits(F.col("v"), F.col("e")))[0]
        assert np.abs(compression.bit_round(values, keep) - values).max() <= error
    assert column(spark, [([], 1.0), ([1.0], 0.0), ([0.0], 1.0), ([float("nan")], 1.0), ([1.0, None], 0.5)], "v array<double>, e double", codecs.keepbits(F.col("v"), F.col("e"))) == [0, 23, 0, 0, 0]


def test_benchmark_rows(spark):
    ramp = [float(i // 50) for i in range(20_000)]
    rows = [("a", "v", "gzip+shuffle", ramp), ("b", "v", "lzf", ramp), ("c", "v", None, ramp), ("d", "v", None, ramp[:100])]
    got = compression.benchmark(spark.createDataFrame(rows, "asset_id string, name string, codec string, values array<double>"), keepbits=4).collect()
    by = {a: sorted((r for r in got if r.asset_id == a), key=lambda r: r.seq) for a in "abcd"}
    assert [len(by[a]) for a in "abcd"] == [21, 21, 21, 0]
    assert by["a"][0].ratio > 5 and by["b"][0].error and by["c"][0].ratio == 1.0 and all(by[a][0].is_current for a in "abc")
    assert all(r.ratio > 1 for r in by["a"][1:]) and all(r.lossy and r.max_abs_error >= 0 for r in by["a"][11:])


def test_access(spark):
    rows = [("head", 401, None), ("range-get", 403, None), ("range-get", 200, None), ("range-get", 206, None), ("head", 200, None), ("open", None, "AccessDenied"), ("range-get", None, "timeout"), ("head", None, "timeout"), ("range-get", None, "-> https://urs.earthdata.nasa.gov/x")]
    got = column(spark, rows, "s string, c int, t string", access.classify_access(F.col("s"), F.col("c"), F.col("t")))
    assert got == ["auth-required", "auth-required", "no-range-support", "ok", "ok", "auth-required", "no-range-support", "ok", "auth-required"]
    both = [("auth-required", "ok"), ("ok", "no-range-support"), ("auth-required", "no-range-support"), (None, "auth-required")]
    assert column(spark, both, "h string, r string", access.combine_access(F.col("h"), F.col("r"))) == ["ok", "no-range-support", "auth-required", "auth-required"]
    errors = ["403 at urs.earthdata login", "Access Denied", "forbidden s3credentials", "reset", None]
    assert column(spark, [(e,) for e in errors], "t string", access.classify_store_error(F.col("t"))) == ["credentials-endpoint-auth", "in-region-only", "unknown", "unknown", "unknown"]


def test_catalogue_records(spark):
    record = {"RelatedUrls": [{"URL": "s3://b/x", "Type": "GET DATA VIA DIRECT ACCESS"}, {"URL": "https://b/x", "Type": "GET DATA"}, {"URL": "https://b/s3credentials", "Type": "VIEW"}, {"URL": "https://d", "Type": "Project documentation"}], "DOI": {"DOI": "10.5/x"}, "Abstract": "abc", "License": "CC0", "ContactPersons": [{"n": 1}]}
    rows = [(json.dumps(record),), (json.dumps({"DOI": "10.5/y"}),), (None,)]
    urls = column(spark, rows, "r string", access.related_urls(F.col("r")))
    assert (urls[0].s3_urls, urls[0].https_urls, urls[0].credentials_url) == (["s3://b/x"], ["https://b/x"], "https://b/s3credentials")
    meta = column(spark, rows, "r string", access.catalogue_meta(F.col("r")))
    assert (meta[0].doi, meta[0].contact, meta[0].doc_links, meta[0].description_len, meta[1].doi, meta[2]) == ("10.5/x", True, ["https://d"], 3, "10.5/y", None)


def test_budgets(spark):
    log = spark.createDataFrame([("a", 1, 60), ("a", 2, 40), ("a", 3, 1), ("a", 4, 9), ("b", 1, 100)], "asset_id string, seq long, bytes long").repartition(3)
    assert [tuple(r)[:4] for r in telemetry.first_breaches(log, 100).collect()] == [("a", 3, 101, 3)]
    assert telemetry.unmeasured_opens(spark.createDataFrame([("ok", 0), ("ok", 5), ("fail", 0)], "status string, bytes_to_open long")).count() == 1


# --- scoring: one excellent asset and changes to it


def excellent(spark, fmt="icechunk", mb=8.0, codec="zstd-3", smoke="pass", d=("pass",) * 4, drop_cmr=False, requests=2):
    meta = F.struct(F.lit("CC0").alias("license"), F.lit("10.1/x").alias("doi"), F.lit(True).alias("contact"), F.array(F.lit("u")).alias("doc_links"), F.lit(5).alias("n_keywords"), F.lit(300).alias("description_len"))
    assets = one_asset(spark, format=fmt, smoke_status=smoke, etag='"s"', requests_to_open=requests, consolidated=True, crs="EPSG:4326", global_attrs=F.create_map(F.lit("Conventions"), F.lit("CF-1.8")), **({} if drop_cmr else {"cmr": meta}))
    attrs = {"units": "K", "standard_name": "t", "grid_mapping": "crs"}
    rows = variables(spark, [("a", "/tas", ["time", "lat", "lon"], [100, 100, 100], "float32", [10, 100, 100], attrs, None, codec), ("a", "/crs", [], [], "int32", None, {"grid_mapping_name": "x"}, None, None)])
    measured = spark.createDataFrame([("a", "/tas", mb)], "asset_id string, name string, median_mb double")
    found = [("a", i, cid, s, "seen", None) for i, (cid, s) in enumerate(zip(("D1-range", "D2-auth", "D3-https-cors", "D4-cleanpath"), d, strict=True)) if s]
    return assess.assess(assets, rows, findings=spark.createDataFrame(found, FINDINGS), measured=measured)


@pytest.mark.parametrize("changes, verdict, tier, confidence", [
    ({}, "READY", "A", "High"),
    ({"mb": 0.5}, "NOT READY", "C", "High"),
    ({"smoke": "fail"}, "NOT READY", "C", "High"),
    ({"d": ("fail", "pass", "pass", "pass")}, "NOT READY", "C", "High"),
    ({"d": ("warn", "pass", "pass", "pass")}, "READY WITH CAVEATS", "A", "High"),
    ({"d": ("pass", None, None, None)}, "READY", "A", "Reduced"),
    ({"drop_cmr": True}, "READY", "A", "Low"),
    ({"codec": None}, "READY WITH CAVEATS", "A", "High"),
    ({"fmt": "netcdf3"}, "READY WITH CAVEATS", "C", "High"),
    ({"requests": 50}, "READY WITH CAVEATS", "B", "High"),
])
def test_scenarios(spark, changes, verdict, tier, confidence):
    found = excellent(spark, **changes)
    row = found.scores.first()
    assert (row.verdict, row.tier, row.confidence) == (verdict, tier, confidence)
    rows = found.checks.orderBy("seq").collect()
    assert [r.id for r in rows] == [c for c, _, _ in fixed.CHECKS]
    assert all(r.remediation for r in rows if r.status in ("partial", "fail"))
    if not changes:
        assert row.score == 100.0 and row.caps == []
    if changes.get("mb"):
        assert {r.id for r in rows if r.status == "fail"} >= {"C1-interactive", "C2-training"}


def test_parquet_anchor(spark):
    """The smallest tables: one request, a contiguous estimate under 1 MB, codec not judged."""
    from cairn.plans import catalogue

    rows = {r.asset_id: r for r in catalogue.asset_scorecard(spark, "/root/testdata/sf0.001").collect()}
    assert len(rows) == 14
    r = rows["region.parquet"]
    assert (r.dim_a, r.dim_b, r.dim_c, r.dim_d, r.dim_e, r.score, r.tier, r.verdict, r.confidence) == (26.0, 12.0, 6.1, 7.5, 3.5, 55.1, "C", "NOT READY", "Low")


def test_reports(spark):
    found = excellent(spark, mb=0.5, d=("pass", "warn", "pass", "pass"))
    assets = one_asset(spark, format="icechunk", requests_to_open=2)
    for style, has, lacks in (("verdict", "## Criteria", "## Scorecard"), ("score", "## Scorecard", "## Criteria"), ("both", "## Criteria", "## nothing")):
        text = rendering.render(found.scores, found.checks, assets, found.assessed, found.inspected, style=style).first().report
        assert text.startswith("**Verdict: NOT READY") and has in text and lacks not in text and "## Prioritized remediation\n\n1. **[" in text
    least = rendering.render(found.scores, found.checks, assets).first().report
    assert "_not assessed" in least
    document = json.loads(rendering.findings_json(found.scores, found.checks).first().findings)
    assert len(document["checks"]) == 21 and document["dimensions"]["A"]["max"] == 30
    with pytest.raises(ValueError):
        rendering.render(found.scores, found.checks, assets, style="other")


def test_remediations_order(spark):
    rows = [("a", 0, "X", "A", 3.0, "fail", "r"), ("a", 1, "Y", "A", 9.0, "partial", "s"), ("a", 2, "Z", "B", 3.0, "fail", "t"), ("a", 3, "X", "A", 3.0, "fail", "r"), ("a", 4, "W", "B", 9.0, "pass", "u")]
    frame = spark.createDataFrame(rows, "asset_id string, seq int, id string, dimension string, points_possible double, status string, remediation string")
    assert [(r.rank, r.id) for r in scoring.remediations(frame).orderBy("rank").collect()] == [(1, "Y"), (2, "X"), (3, "Z")]


def test_resolve_access(spark):
    from cairn.operators import access as op

    record = json.dumps({"RelatedUrls": [{"URL": "s3://b/x", "Type": "GET DATA VIA DIRECT ACCESS"}, {"URL": "https://b/s3credentials", "Type": "V"}], "License": "CC0"})
    inputs = [("l", "/data/x.nc"), ("g", "G1-P"), ("n", "G2-P"), ("e", "G3-P"), ("o", "https://h/x"), ("r", "https://h/y"), ("d", "s3://b/k"), ("u", "https://h/z")]
    probes = [("o", 1, "head", 403, None, None, 0.1), ("o", 2, "range-get", 206, None, '"t"', 0.2), ("r", 1, "head", 200, None, None, 0.1), ("r", 2, "range-get", 200, None, None, 0.3), ("d", 1, "range-get", None, "AccessDenied on read", None, None)]
    args = (spark.createDataFrame(inputs, "asset_id string, input string"), spark.createDataFrame(probes, "asset_id string, seq long, stage string, status_code int, error string, etag string, seconds double"), spark.createDataFrame([("g", record), ("e", "{}")], "asset_id string, record string"))
    got = {r.asset_id: r for r in op.resolve_access(*args).collect()}
    assert {k: r.auth for k, r in got.items()} == {"l": "local", "g": "credentials", "n": "error", "e": "error", "o": "anonymous", "r": "anonymous", "d": "error", "u": "anonymous"}
    told = {k: [(f.id, f.status) for f in r.findings] for k, r in got.items()}
    assert told["l"] == [("D0-hosting", "skipped")] and told["n"] == told["e"] == [("D2-auth", "fail")] and told["o"] == [("D1-range", "pass")] and told["r"] == [("D1-range", "warn")]
    assert told["d"] == [("D1-range", "skipped"), ("D2-auth", "skipped")] and told["g"] == [("D1-range", "skipped"), ("D2-auth", "pass")] and (got["g"].url, got["g"].cmr.license, got["o"].etag) == ("s3://b/x", "CC0", '"t"')
    assert {r.auth for r in op.resolve_access(*args, no_network=True).collect()} == {"local", "no-network"}
    assert op.finding_rows(op.resolve_access(*args)).count() == 10


def test_report_with_every_part(spark):
    found = excellent(spark)
    assets = one_asset(spark, format="icechunk", requests_to_open=2)
    smoke = spark.createDataFrame([("a", "skipped", 2, 4096, 0.2, 0.1, 42.3, None, "no network")], "asset_id string, status string, requests_to_open int, bytes_to_open long, time_to_open_s double, ttfb_s double, throughput_mbps double, total_bytes long, reason string")
    breaches = spark.createDataFrame([("a", 1, "open", "byte cap|passed")], "asset_id string, seq int, stage string, message string")
    samples = spark.createDataFrame([("a", "/tas", "gzip", [float(i % 7) for i in range(20_000)])], "asset_id string, name string, codec string, values array<double>")
    frame = spark.createDataFrame([("a", '{"n": 8}')], "asset_id string, frame string")
    text = rendering.render(found.scores, found.checks, assets, found.assessed, found.inspected, compression.benchmark(samples), breaches, smoke, frame, "training").first().report
    for part in ("| skipped | 2 | 4096 | 0.2 s | 0.1 s | 42.3 MB/s", "Reason: no network", "byte cap\\|passed", "**current (gzip) (current)**", '```json\n{"n": 8}\n```', "**training**", "No check failed"):
        assert part in text, part


def test_interior_walk_never_broadcasts_cells(spark):
    from cairn.plans import catalogue

    tree = catalogue.budget_capped_sample(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in tree and "SortMergeJoin" in tree
    for branch in tree.split("Generate posexplode")[1:]:  # below the cells are the grids of variables, moved once
        assert branch.split("Generate posexplode")[0].count("Exchange hashpartitioning(asset_id") >= 1
    assert tree.count("Window [row_number") == 0


def test_interior_chunks_of_repeated_rows_are_ranked_as_one(spark):
    rows = [("a", 0, "v", [3, 3], [1, 1])] * 2 + [("a", 0, "v", [5], [1]), (None, 1, "w", [1], [1])]
    frame = spark.createDataFrame(rows, f"asset_id string, ordinal long, name string, shape {L}, chunks {L}")
    got = [(r.rank, r.idx) for r in sampling.interior_chunks(frame, 5).filter("ordinal = 0").orderBy("rank").collect()]
    assert got == [(1, [1, 1]), (2, [1, 1]), (3, [2]), (4, [0, 1]), (5, [0, 1])]
    assert [(r.asset_id, r.rank, r.idx) for r in sampling.interior_chunks(frame, 5).filter("ordinal = 1").collect()] == [(None, 1, [0])]

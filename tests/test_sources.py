"""Readers, the command line and streaming."""

import gzip
import json
import os
import sys
import types
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cairn import cli
from cairn.functions import fixed, formats, geometry
from cairn.operators import sampling, scoring
from cairn.sources import counting, heads, optional, parquet_footer, store_layout, zarr_chunks
from cairn.streaming import telemetry as streaming


@pytest.fixture
def parquet_folder(tmp_path):
    table = pa.table({"a": range(1000), "s": [{"x": i, "y": str(i)} for i in range(1000)], "b": [0.5] * 1000})
    pq.write_table(table, tmp_path / "one.parquet", row_group_size=300)
    (tmp_path / "many.parquet").mkdir()
    for i in range(3):
        pq.write_table(table.slice(i * 100, 100), tmp_path / "many.parquet" / f"p{i}.parquet", compression="zstd")
    return str(tmp_path)


def test_footers(spark, parquet_folder):
    rows = parquet_footer.footers(spark, f"{parquet_folder}/*.parquet")
    assert rows.filter("asset_id = 'one.parquet'").select("row_group").distinct().count() == 4
    found = {(r.asset_id, r.name): r for r in parquet_footer.variables(rows).collect()}
    assert {n for a, n in found if a == "one.parquet"} == {"a", "s.x", "s.y", "b"}
    meta = pq.read_metadata(f"{parquet_folder}/one.parquet")
    assert found["one.parquet", "b"].size_bytes == sum(meta.row_group(g).column(3).total_compressed_size for g in range(4))
    assert (found["one.parquet", "a"].shape, found["many.parquet", "b"].shape, found["many.parquet", "b"].codec, found["many.parquet", "b"].dtype) == ([1000], [300], "zstd", "double")
    assert {r.asset_id: r.requests_to_open for r in parquet_footer.assets(rows).collect()} == {"one.parquet": 1, "many.parquet": 3}
    assert parquet_footer.footers(spark, f"{parquet_folder}/one.parquet").select("asset_id").distinct().count() == 1


def test_heads(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"GRIB" + b"\0" * 40_000)
    (tmp_path / "empty").write_bytes(b"")
    got = {os.path.basename(r.path): r for r in heads.heads(spark, str(tmp_path)).withColumn("f", formats.sniff_bytes(F.col("head"))).collect()}
    assert (got["a.bin"].length, len(got["a.bin"].head), got["a.bin"].f) == (40_004, 16_384, "grib2") and got["empty"].f == "unknown"


V3 = {
    "zarr_format": 3, "node_type": "group", "attributes": {"Conventions": "CF-1.8"},
    "consolidated_metadata": {"metadata": {
        "temperature": {"node_type": "array", "shape": [24, 10, 10], "data_type": "float32", "dimension_names": ["time", "y", "x"], "chunk_grid": {"configuration": {"chunk_shape": [24, 5, 5]}}, "codecs": [{"name": "bytes"}, {"name": "zstd", "configuration": {"level": 3}}], "attributes": {"units": "K"}},
        "g": {"node_type": "group"}, "g/time/zarr.json": {"node_type": "array", "shape": [24], "data_type": "float64", "chunk_grid": {"configuration": {"chunk_shape": [24]}}, "attributes": {}},
    }},
}
V2 = {"metadata": {".zattrs": {"title": "t"}, ".zgroup": {}, "tas/.zarray": {"shape": [4, 4], "chunks": [2, 2], "dtype": "<f4", "compressor": {"id": "blosc", "cname": "zstd"}}, "tas/.zattrs": {"_ARRAY_DIMENSIONS": ["y", "x"], "units": "K"}}}


def test_zarr_documents(spark):
    rows = [("v3", "zarr.json", json.dumps(V3)), ("v2", ".zmetadata", json.dumps(V2)), ("v2", ".zgroup", "{}"), ("bare", ".zgroup", "{}"), ("ice", "refs", None), ("ice", "manifests", None), ("none", "x", None), ("plain3", "zarr.json", "{}")]
    frame = spark.createDataFrame(rows, "asset_id string, key string, document string")
    layout = {r.asset_id: (r.format, r.zarr_version, r.consolidated) for r in store_layout.sniff_store(frame).collect()}
    assert layout == {"v3": ("zarr", "v3", True), "v2": ("zarr", "v2", True), "bare": ("zarr", "v2", False), "ice": ("icechunk", None, None), "none": ("unknown", None, None), "plain3": ("zarr", "v3", False)}
    got = {(r.asset_id, r.name): r for r in store_layout.zarr_variables(frame).collect()}
    assert set(got) == {("v3", "/temperature"), ("v3", "/g/time"), ("v2", "/tas")}
    t = got["v3", "/temperature"]
    assert (t.dims, t.shape, t.chunks, t.dtype, t.attrs) == (["time", "y", "x"], [24, 10, 10], [24, 5, 5], "float32", {"units": "K"}) and t.codec.startswith("zstd")
    assert (got["v2", "/tas"].dims, got["v2", "/tas"].chunks) == (["y", "x"], [2, 2]) and "blosc" in got["v2", "/tas"].codec
    assert {r.asset_id: r.global_attrs for r in store_layout.root_attributes(frame).collect() if r.global_attrs} == {"v3": {"Conventions": "CF-1.8"}, "v2": {"title": "t"}}


def test_missing_libraries_are_findings(spark):
    frame = spark.createDataFrame([("a", "/nowhere.h5", "hdf5"), ("b", "/nowhere.tif", "cog"), ("c", "/x", "grib2")], "asset_id string, path string, format string")
    got = {r.asset_id: r.status for r in optional.open_assets(frame).collect()}
    assert got["c"] == "n/a" and got["a"] in ("skipped", "fail") and got["b"] in ("skipped", "fail")


def test_command_line(spark, parquet_folder, tmp_path, capsys):
    out = str(tmp_path / "out")
    assert cli.main([f"{parquet_folder}/one.parquet", "--out", out, "--variables", "a,b"]) == 0
    reports = [f for _, _, files in os.walk(f"{out}/reports") for f in files if f.endswith(".txt")]
    assert reports and spark.read.text(f"{out}/findings").count() == 1
    assert cli.main([f"{parquet_folder}/one.parquet", "--variables", "nothing_like_it"]) == 4
    (tmp_path / "odd").mkdir()
    (tmp_path / "odd" / "x.odd").write_bytes(b"??")
    assert cli.main([str(tmp_path / "odd")]) == 3
    assert cli.main([str(tmp_path / "absent")]) == 2
    store = tmp_path / "s.zarr"
    store.mkdir()
    (store / "zarr.json").write_text(json.dumps(V3))
    assert cli.main([str(store), "--all-variables"]) == 0
    assert "s.zarr" in capsys.readouterr().out


def test_streams(spark, sf_dir, tmp_path):
    from cairn.operators.telemetry import first_breaches
    from cairn.plans import frames

    log = frames.request_log(spark, sf_dir)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id AS seq", "CAST(ts AS timestamp) AS ts")
    whole = log.join(events, "seq").repartition(1).sortWithinPartitions("seq")
    whole.write.option("maxRecordsPerFile", 2500).parquet(str(tmp_path / "log"))
    stream = lambda: spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    q = streaming.breach_stream(stream(), 1_000_000).writeStream.format("memory").queryName("breaches").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    want = {(r.asset_id, r.seq, r.total_bytes) for r in first_breaches(log, 1_000_000).collect()}
    assert {tuple(r) for r in spark.table("breaches").collect()} == want and want
    q = streaming.windowed_access(stream(), late="1 day").writeStream.format("memory").queryName("windows").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("windows").agg(F.sum("n")).first()[0] == whole.count()


def test_footer_patterns(spark, parquet_folder):
    names = lambda p: {r.asset_id for r in parquet_footer.footers(spark, f"{parquet_folder}/{p}").select("asset_id").distinct().collect()}
    assert names("o*.parquet") == {"one.parquet"} and names("m*.parquet") == {"many.parquet"} and names("*.parquet") == {"one.parquet", "many.parquet"}
    assert names("many.parquet/p[01].parquet") == {"p0.parquet", "p1.parquet"} and names("ma*/p?.parquet") == {"p0.parquet", "p1.parquet", "p2.parquet"}
    assert names("none*.parquet") == set()
    found = {r.asset_id: r.bytes_to_open for r in parquet_footer.assets(parquet_footer.footers(spark, parquet_folder)).collect()}
    sizes = [pq.read_metadata(f"{parquet_folder}/many.parquet/p{i}.parquet").serialized_size for i in range(3)]
    assert found["many.parquet"] == sum(sizes)


ARRAY3 = {"node_type": "array", "shape": [40, 40], "data_type": "float32", "chunk_grid": {"configuration": {"chunk_shape": [10, 10]}}, "codecs": [{"name": "bytes"}, {"name": "zstd"}], "attributes": {}}
ARRAY2 = {"shape": [40, 40], "chunks": [10, 10], "dtype": "<f4", "compressor": {"id": "zlib"}}


def write_store(root, version):
    """A store without consolidated metadata; only the four chunks around the centre and one corner are stored."""
    (root / "g" / "x").mkdir(parents=True)
    for i, (a, b) in enumerate([(1, 1), (1, 2), (2, 1), (2, 2), (0, 0)]):
        chunk = root / "g" / "x" / ("c" if version == 3 else "") / (f"{a}/{b}" if version == 3 else f"{a}.{b}")
        chunk.parent.mkdir(parents=True, exist_ok=True)
        chunk.write_bytes(b"\1" * ((i + 1) << 20))
    if version == 3:
        (root / "zarr.json").write_text(json.dumps({"zarr_format": 3, "node_type": "group", "attributes": {"Conventions": "CF-1.8"}}))
        (root / "g" / "zarr.json").write_text(json.dumps({"zarr_format": 3, "node_type": "group"}))
        (root / "g" / "x" / "zarr.json").write_text(json.dumps(ARRAY3))
    else:
        (root / ".zgroup").write_text("{}")
        (root / "g" / "x" / ".zarray").write_text(json.dumps(ARRAY2))
        (root / "g" / "x" / ".zattrs").write_text(json.dumps({"_ARRAY_DIMENSIONS": ["y", "x"], "units": "K"}))


@pytest.mark.parametrize("version", [2, 3])
def test_unconsolidated_stores_and_measured_chunks(spark, tmp_path, version, capsys):
    root = tmp_path / "store.zarr"
    write_store(root, version)
    assets, variables = cli.load(spark, str(root), "zarr")
    one = variables.collect()
    assert [(r.asset_id, r.name, r.shape, r.chunks) for r in one] == [("store.zarr", "/g/x", [40, 40], [10, 10])]
    assert one[0].dims == (["y", "x"] if version == 2 else [])
    assert assets.first().format == "zarr" and not assets.first().consolidated
    keys = cli.keyed(store_layout.list_keys(spark, str(root)), str(root))
    got = sampling.sample_listed(variables, keys).collect()
    # The corner is a candidate too: the five stored chunks in the order of their distance.
    assert [(r.name, r.median_mb, r.min_mb, r.max_mb, r.n_sampled) for r in got] == [("/g/x", 3.0, 1.0, 5.0, 5)]
    assert sampling.sample_listed(variables, keys, most=1).first().median_mb == 4.0  # the chunk (2, 2) is the centre
    assessed = sampling.assess_chunking(variables, sampling.sample_listed(variables, keys)).first()
    assert (assessed.mb, assessed.measured, assessed.grade) == (3.0, True, "warn")
    assert cli.sniff(spark, str(root)) == "zarr" and cli.main([str(root)]) == 0 and "store.zarr" in capsys.readouterr().out


def test_bare_icechunk_is_sniffed(spark, tmp_path):
    root = tmp_path / "ice"
    for folder in ("refs", "snapshots"):
        (root / folder).mkdir(parents=True)
        (root / folder / "a").write_bytes(b"x")
    assert cli.sniff(spark, str(root)) == "icechunk"


def test_a_walk_that_ends_early_says_so(monkeypatch, tmp_path):
    class Item:
        def __init__(self, name, items=None):
            self.name, self.items_, self.attrs = name, items, {}
            if items is None:
                self.shape, self.dtype, self.ndim, self.size, self.chunks, self.compression, self.shuffle = (2,), np.dtype("f4"), 1, 2, None, None, False

        def items(self):
            return self.items_.items()

        def __enter__(self):
            return self

        def __exit__(self, *_):
            return False

    flat = Item("/", {f"v{i}": Item(f"/v{i}") for i in range(7)})
    monkeypatch.setitem(sys.modules, "h5py", types.SimpleNamespace(File=lambda *_: flat))
    assert [r["status"] for r in optional.hdf5_rows("a", "x", most=5)] == ["ok"] * 5 + ["capped"]
    assert [r["status"] for r in optional.hdf5_rows("a", "x", most=7)] == ["ok"] * 7


def test_rounding_is_that_of_the_binary_value(spark):
    rng = np.random.default_rng(0)
    values = [11.25, 11.35, 0.0625, 2.675, 0.5, 1.5, 2.5, -0.25, -11.25, 0.0, 1e300, 12345678.0005, 0.15, 0.45, *(rng.integers(0, 10**6, 3000) / 2000).tolist(), *(rng.integers(0, 2**16, 3000) / 256).tolist(), *rng.normal(0, 50, 1000).tolist()]
    frame = spark.createDataFrame([(v,) for v in values], "x double")
    for places in (1, 2, 3):
        got = [r.y for r in frame.select(F.col("x"), geometry.half_even(F.col("x"), places).alias("y")).collect()]
        assert got == [round(v, places) for v in values]


def test_scores_round_to_even(spark):
    rows = [("a", "B", "ok", float(p), 9.0 if p == 16 else 0.0, "partial", "x", i) for i, p in enumerate([16])]
    frame = spark.createDataFrame(rows, "asset_id string, dimension string, smoke_status string, points_possible double, points_awarded double, status string, id string, seq int")
    weight = {d: w for d, w, _ in fixed.DIMENSIONS}["B"]
    got = {r.dimension: r.score for r in scoring.dimension_scores(frame).collect()}
    assert got["B"] == round(9 / 16 * weight, 1) and scoring.score(frame).first()["dim_b"] == got["B"]


class Tree:
    """A stand-in for a file of the absent library: groups hold items, arrays have a shape; opening reads four bytes."""

    def __init__(self, name="/", items=None, attrs=None):
        self.name, self.held, self.attrs = name, items, attrs or {}
        if items is None:
            self.shape, self.dtype, self.ndim, self.size, self.chunks, self.compression, self.shuffle = (4, 2), np.dtype("f4"), 2, 8, (2, 2), "gzip", True

    def items(self):
        return self.held.items()

    def __enter__(self):
        return self

    def __exit__(self, *_):
        return False


def as_frame(spark, rows):
    return spark.createDataFrame([{**r, "attrs": None if r["attrs"] is None else dict(r["attrs"])} for r in rows], optional.SCHEMA)


def fake_h5py(monkeypatch, tree, reads=4):
    def opened(file, mode):
        if reads:
            file.read(reads)
        return tree

    monkeypatch.setitem(sys.modules, "h5py", types.SimpleNamespace(File=opened))


def test_hdf5_walk_and_its_facts(spark, monkeypatch, tmp_path):
    path = str(tmp_path / "a.h5")
    (tmp_path / "a.h5").write_bytes(b"12345678")
    deep = Tree("/Metadata", {"sub": Tree("/Metadata/sub", {"m": Tree("/Metadata/sub/m")})})
    tree = Tree("/", {"x": Tree("/x"), "Metadata": deep}, {"Conventions": b"CF-1.8", "one": np.array([2.5])})
    fake_h5py(monkeypatch, tree)
    rows = list(optional.hdf5_asset("a", path))
    assert [(r["status"], r["name"]) for r in rows] == [("ok", "/Metadata/sub/m"), ("ok", "/x"), ("root", None)]
    facts = dict(rows[-1]["attrs"])
    assert facts == {"Conventions": "CF-1.8", "one": "2.5", "cairn:requests_to_open": "1", "cairn:bytes_to_open": "4", "cairn:objects_visited": "4", "cairn:complete": "true"}
    got = optional.asset_rows(as_frame(spark, rows)).first()
    assert (got.smoke_status, got.global_attrs, got.requests_to_open, got.bytes_to_open, got.complete) == ("pass", {"Conventions": "CF-1.8", "one": "2.5"}, 1, 4, True)
    many = Tree("/", {f"v{i}": Tree(f"/v{i}") for i in range(60)})
    fake_h5py(monkeypatch, many)
    with counting.opened(path) as file:
        late = list(optional.hdf5_rows("a", file, seconds=-1.0))
    assert len(late) == 26 and late[-1]["status"] == "capped" and "time" in late[-1]["reason"]
    fake_h5py(monkeypatch, tree, reads=0)
    assert [r["status"] for r in optional.hdf5_asset("a", path)] == ["fail"]
    assert [r["status"] for r in optional.hdf5_asset("a", str(tmp_path / "absent.h5"))] == ["fail"]

    def refused(file, mode):
        raise OSError("AWS Error ACCESS_DENIED: 403 Forbidden")

    monkeypatch.setitem(sys.modules, "h5py", types.SimpleNamespace(File=refused))
    assert [r["status"] for r in optional.hdf5_asset("a", path)] == ["skipped"]


def test_raster_facts(spark, monkeypatch):
    raster = types.SimpleNamespace(dtypes=["uint8"], height=20, width=30, block_shapes=[(8, 8)], profile={"compress": "deflate"}, crs="EPSG:4326", overviews=lambda _: [2, 4])

    class Opened:
        def __enter__(self):
            return raster

        def __exit__(self, *_):
            return False

    monkeypatch.setitem(sys.modules, "rasterio", types.SimpleNamespace(open=lambda _: Opened()))
    got = optional.asset_rows(as_frame(spark, optional.cog_rows("a", "x"))).first()
    assert (got.crs, got.overviews, got.smoke_status, got.cog_valid) == ("EPSG:4326", [2, 4], "pass", None)
    raster.overviews, raster.crs = lambda _: [], None
    got = optional.asset_rows(as_frame(spark, optional.cog_rows("a", "x"))).first()
    assert (got.crs, got.overviews) == (None, [])


def test_counted_reads(tmp_path):
    (tmp_path / "f").write_bytes(b"0123456789")
    with counting.opened(str(tmp_path / "f"), cap=8) as file:
        assert file.read(3) == b"012" and file.seek(2) == 2 and file.read(5) == b"23456" and (file.requests, file.bytes) == (2, 8)
        with pytest.raises(counting.CapPassed):
            file.read(1)
    assert counting.is_auth_error(OSError("HTTP 401")) and not counting.is_auth_error(OSError("no such file"))


@pytest.mark.parametrize("codec, pack", [
    (None, bytes), ('{"id":"zlib","level":1}', zlib.compress), ("gzip({\"level\":5})", gzip.compress),
    ('zstd({"level":3,"checksum":false})', lambda b: pa.Codec("zstd").compress(b, asbytes=True)), ('{"id":"lz4"}', lambda b: len(b).to_bytes(4, "little") + pa.Codec("lz4_raw").compress(b, asbytes=True)),
])
def test_chunks_are_decoded(codec, pack):
    cells = np.arange(12, dtype=">f4").reshape(3, 4)
    got = zarr_chunks.decode(pack(cells.tobytes()), codec, ">f4", [3, 4], [1, 0], [5, 4])
    assert (got == cells[:2]).all()  # the last chunk ends with the array
    with pytest.raises(ValueError):
        zarr_chunks.decode(b"", '{"id":"blosc","cname":"lz4"}', "<f4", [1], [0], [1])


def test_command_line_runs_trials_and_access(spark, tmp_path, capsys):
    assert cli.main([]) == 5
    probes, records = str(tmp_path / "probes"), str(tmp_path / "records")
    root = tmp_path / "s.zarr"
    (root / "tas" / "c" / "0").mkdir(parents=True)
    cells = np.random.default_rng(0).normal(size=(200, 200)).astype("<f4")
    (root / "tas" / "c" / "0" / "0").write_bytes(pa.Codec("zstd").compress(cells.tobytes(), asbytes=True))
    (root / "zarr.json").write_text(json.dumps({"zarr_format": 3, "node_type": "group", "attributes": {"Conventions": "CF-1.8"}}))
    array = {"node_type": "array", "shape": [200, 200], "data_type": "float32", "dimension_names": ["y", "x"], "chunk_grid": {"configuration": {"chunk_shape": [200, 200]}}, "codecs": [{"name": "bytes"}, {"name": "zstd", "configuration": {"level": 3}}], "attributes": {}}
    (root / "tas" / "zarr.json").write_text(json.dumps(array))
    record = {"RelatedUrls": [{"URL": str(root), "Type": "GET DATA"}], "License": "CC0"}
    spark.createDataFrame([("G123-ABC", json.dumps(record))], "asset_id string, record string").write.parquet(records)
    probe = [("G123-ABC", 1, "range-get", 206, None, "e1", 0.1)]
    spark.createDataFrame(probe, "asset_id string, seq long, stage string, status_code int, error string, etag string, seconds double").write.parquet(probes)
    out = str(tmp_path / "out")
    assert cli.main(["--granule-id", "G123-ABC", "--records", records, "--probes", probes, "--benchmark", "--bitround-max-abs-error", "0.01", "--byte-cap", "0.0001", "--json", "--out", out]) == 0
    document = json.loads([x for x in capsys.readouterr().out.splitlines() if x.startswith("{")][-1])
    status = {c["id"]: c["status"] for c in document["checks"]}
    assert status["D1-range"] == "pass" and document["geozarr_status"] in ("pass", "warn")
    assert document["sample_frame"]["variables_assessed"] == ["/tas"] and document["budget_breaches"][0]["stage"] == "open"
    assert any(t["config"].startswith("bitround") for t in document["codec_trials"]) and all("error" not in t for t in document["codec_trials"])
    report = "".join(open(os.path.join(d, f)).read() for d, _, files in os.walk(f"{out}/reports") for f in files if f.endswith(".txt"))
    assert "(current)" in report and "byte cap 104 passed" in report
    denied = [("G123-ABC", 1, "head", 403, "AccessDenied", None, 0.1)]
    spark.createDataFrame(denied, "asset_id string, seq long, stage string, status_code int, error string, etag string, seconds double").write.mode("overwrite").parquet(probes)
    assert cli.main(["--granule-id", "G123-ABC", "--records", records, "--probes", probes]) == 2

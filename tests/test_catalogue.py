"""Every registered query that has SQL against DuckDB on the same tables; the rest for shape."""

import json
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


def plain(frame: pd.DataFrame) -> list[str]:
    def value(x):
        if x is None or x is pd.NA or (isinstance(x, float) and x != x):
            return None
        x = x.item() if hasattr(x, "item") else x
        return int(x) if isinstance(x, float) and x == int(x) else x

    columns = sorted(frame.columns)
    return sorted(json.dumps([value(x) for x in row], default=str) for row in frame[columns].itertuples(index=False))


@pytest.fixture(scope="module")
def tables(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(SQL)))
def test_against_sql(spark, sf_dir, tables, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), tables.execute(SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want) and len(got)


@pytest.mark.parametrize("name", ["codec_grid_ratio", "report_markdown", "findings_documents"])
def test_without_sql(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 14


def test_library_does_not_need_the_optional_part():
    import pathlib

    root = pathlib.Path(entry.__file__).parent / "cairn"
    for file in root.rglob("*.py"):
        if "llm" not in file.parts:
            text = file.read_text()
            assert "cairn.llm" not in text and "from ..llm" not in text and "from .llm" not in text


def test_every_embedding_is_benchmarked(spark, tmp_path):
    import numpy as np
    import pyarrow as pa

    from cairn.operators import compression

    rows = np.random.default_rng(2).normal(size=(7, 64)).astype(np.float32)
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r.asset_id, r.config): r for r in QUERIES["codec_grid_ratio"](spark, str(tmp_path)).collect()}
    assert len(got) == 7 * 21
    for i, v in enumerate(rows):
        raw = np.tile(v, 256)
        for level in (1, 3):
            config = f"zstd-{level}+shuffle"
            for name, data in ((config, raw), (f"bitround8+{config}", compression.bit_round(raw, 8))):
                packed = pa.Codec("zstd", compression_level=level).compress(data.view(np.uint8).reshape(-1, 4).T.tobytes(), asbytes=True)
                assert got[str(i), name].ratio == round(raw.nbytes / len(packed), 3)

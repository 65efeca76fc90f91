"""Each stage of the pipeline against brute force on its own input."""

import hashlib
import re
from collections import Counter

import corpus_pipeline as pipeline
import numpy as np
import public_tokenizers
import pytest
from tests_llm_hand import dedup_texts

from cairn.llm import bpe, shingles


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in pipeline.STAGES]
    frames = [docs]
    for _, stage in pipeline.STAGES:
        frames.append(stage(spark, frames[-1], sf_dir).cache())
    assert len(names) == 5 and all(set(f.columns) == set(columns) for f in frames[:-1])
    found, lined, near, mixed, encoded = ({}, {}, {}, {}, {})
    found, lined, near = ({r.doc_id: r for r in f.collect()} for f in frames[1:4])
    mixed, encoded = frames[4].collect(), frames[5].collect()
    assert len(found) >= 0.99 * docs.count()
    assert {i: r.text for i, r in lined.items()} == dedup_texts([(i, r.text) for i, r in found.items()])
    assert all(r.n_chars == len(r.text) for r in lined.values())
    assert set(near) == kept_by_hand(sorted(lined), [lined[i].text for i in sorted(lined)])
    assert all(r.text == near[r.doc_id].text for r in mixed)
    model = bpe.model(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert Counter(r.doc_id for r in encoded) == Counter(r.doc_id for r in mixed)
    for r in encoded:
        assert model.decode(r.ids) == near[r.doc_id].text.encode() and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(near[r.doc_id].text.encode()).hexdigest()


def test_stages_on_no_rows_and_nulls(spark, sf_dir):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "the of and that", "en", "s", 15)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (frame, frame.filter("n_chars > 99")):
        for _, stage in pipeline.STAGES:
            assert stage(spark, docs, sf_dir).count() <= 12
    many = spark.createDataFrame([(i % 5 if i < 40 else None, "the of and that with this " * 4, "en", "s", 100) for i in range(43)], frame.schema)
    assert pipeline.language_id(spark, many, sf_dir).count() == 43
    assert sorted(str(r.doc_id) for r in pipeline.near_dedup(spark, many, sf_dir).collect()) == ["0", "None", "None", "None"]


def similar_by_hand(texts):
    """Pairs of places whose five-word shingle sets have Jaccard similarity 0.8 or more."""
    sets = []
    for t in texts:
        w = [x for x in re.split("[\t\n\v\f\r ]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if x]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a == b or 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b)]


def kept_by_hand(ids, texts):
    """The least id of each component of similar texts; ``ids`` ascend."""
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in similar_by_hand(texts):
        a, b = root(i), root(j)
        up[max(a, b)] = min(a, b)
    return {ids[root(i)] for i in up}


@pytest.mark.parametrize("limit", [8192, 6])
def test_near_dedup_is_exact(spark, sf_dir, limit, monkeypatch):
    monkeypatch.setattr(shingles, "GROUP_LIMIT", limit)
    rng = np.random.default_rng(8)
    base = [rng.integers(0, 5000, 200).tolist() for _ in range(4)]
    made = [b[:at] + [9000 + k] + b[at + 1 :] for b in base for k, at in enumerate(rng.integers(0, 200, 12))]
    made += [b[: 200 - cut] + rng.integers(0, 5000, cut).tolist() for b in base for cut in (10, 18, 20, 22, 24, 30)]
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()] + [" ".join(map(str, x)) for x in made] + [None, "", "A b", "a B", "a b c d e f g h", "a b c d e f g h i"]
    frame = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    got = pipeline.near_dedup(spark, frame, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(kept_by_hand(range(len(texts)), texts))


def test_rows_of_one_id_follow_their_own_text(spark, sf_dir):
    text = "the of and that with this is a plain text in one language that all know "
    rows = [(1, text, "en", "s", 1), (1, "12 345 !", "en", "s", 2), (None, text, "en", "s", 3), (None, "#", "en", "s", 4), *[(10 + i, text * 3, "en", "s", 5) for i in range(30)]]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert Counter(r.n_chars for r in pipeline.language_id(spark, frame, sf_dir).collect()) == {1: 1, 3: 1, 5: 30}
    two = spark.createDataFrame([(5, "a b c d e f", "en", "s", 1), (5, "g h i j k l", "en", "s", 2), (7, "G h i j k l", "en", "s", 3)], frame.schema)
    assert sorted(r.n_chars for r in pipeline.near_dedup(spark, two, sf_dir).collect()) == [1, 2]

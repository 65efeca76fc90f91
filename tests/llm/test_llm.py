"""Each operator against brute force, an exact round trip or held-out accuracy, and its defined cases."""

import base64
import bisect
import hashlib
import os
import subprocess
import sys
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tests_llm_hand import components_by_hand, dedup_by_hand, fingerprint_by_hand

from cairn.llm import bpe, bytecnn, covertree, crosspoly, language, linededup, poisson_mix, queries, ring, simhash, url_rules

LONG = "word " * 60_000 + "é" * 5000
DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, score string, key string, verdict string"


def docs(spark, texts, ids=None):
    rows = [(i, t, "en", "s", 0, "x", "x", "x", "x") for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- 1: byte-level BPE

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def exact():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = ["", None, "a", " ", "\n \n  x", "it's <|endoftext|> 'll", "日本語 😀😀é", "\u0085\u00a0\u3000 x\u1680y", "0123 4567", "aaaa" * 50, "\x00\x1c\x1f", LONG]


def test_bpe_equals_ranks(spark, exact):
    got = {r.doc_id: r for r in bpe.encode(docs(spark, ODD), PATH, PATTERN, outputs=("ids", "n_tokens", "decoded", "ids_sha256")).collect()}
    for i, text in enumerate(ODD):
        ids = exact.encode_ordinary(text or "")
        assert got[i].ids == ids and got[i].n_tokens == len(ids) and got[i].decoded == (text or "")
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_bpe_offsets_of_split_characters(spark):
    text = "a😀 日本 é"
    row = bpe.encode(docs(spark, [text]), PATH, PATTERN).first()
    data = text.encode()
    model = bpe.model(PATH, PATTERN)
    for i, at, first, end in zip(row.ids, row.byte_starts, row.char_starts, row.char_ends, strict=True):
        token = model.decode([i])
        assert data[at : at + len(token)] == token
        assert text.encode()[: at].decode("utf-8", "ignore") == text[:first] and token in text[first:end].encode()
    assert any(b"\xef\xbf\xbd" == model.decode([i]).decode("utf-8", "replace").encode() for i in row.ids)


def test_bpe_decode_and_whole_table(spark, sf_dir, exact):
    encoded = bpe.encode(read(spark, sf_dir, "documents"), PATH, PATTERN, outputs=("ids",))
    decoded = {r.doc_id: r.text for r in bpe.decode(encoded, PATH, PATTERN).collect()}
    texts = {r.doc_id: r.text for r in read(spark, sf_dir, "documents").collect()}
    assert decoded == {k: v or "" for k, v in texts.items()}
    assert bpe.encode(docs(spark, ["x"]).filter("doc_id < 0"), PATH, PATTERN).count() == 0
    found = {r.doc_id: r for r in queries.op1_byte_bpe(spark, sf_dir).collect()}
    for i, text in texts.items():
        ids = exact.encode_ordinary(text or "")
        assert (found[i].n_tokens, found[i].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())


# --- 2: url filters


def rule_of(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fit = [(len(r), len(r.split("/")[0]), r) for r, _ in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[len(r.split("/")[0]) :])]
    best = max(fit)[2] if fit else None
    return host, path, best, dict(rules).get(best, "allow")


def test_url_rules(spark):
    rng = np.random.default_rng(1)
    words, paths = ["a", "b", "com", "x-y"], ["", "/", "/en", "/en/", "/en/a", "/fr/b", "/En/"]
    urls = [None, "", "nothing", "http://", "http://COM/En/?q", "x://com#f", "http://a.com/en/?x=://b", "http://.com/", "http://com:80/", "http://a..com/en"] + [
        f"http://{'.'.join(rng.choice(words, rng.integers(1, 4)))}{rng.choice(paths)}{rng.choice(['', '?q=/en/', '#t'])}" for _ in range(400)
    ]
    urls += ["http://a.com/en/hot"] * 300
    rules = sorted({("com/", "allow"), ("a.com/en/", "block"), ("a.com/en/a", "allow"), ("b/", "block"), ("com/en", "block"), ("x-y.com", "block"), ("b.a.com/", "allow"), ("com/en/a", "block")})
    pages = spark.createDataFrame([(i, u, "x", "x") for i, u in enumerate(urls)] + [(0, None, "x", "x")], "page_id long, url string, host string, verdict string")
    got = Counter(tuple(r) for r in url_rules.filter_urls(pages, spark.createDataFrame(rules, "rule string, verdict string"), ranges=7).collect())
    want = Counter((i, *rule_of(u, rules)) for i, u in enumerate(urls)) + Counter([(0, "", "", None, "allow")])
    assert got == want


def test_url_rules_of_the_highest_characters(spark):
    rules = [("com/", "allow"), ("a.com/en/", "block"), ("a.com/en/\U0010ffff", "allow")]
    urls = [f"http://a.com/en/{x}" for x in ("\U0010ffffx", "\U0010ffff", "\U0010fffex", "\uffff", "\ud7ff", "\x7f", "")] + ["http://a.com/en0", "http://a.com/\U0010ffff", "http://a.con/en/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for ranges in (1, 9):
        got = {tuple(r) for r in url_rules.filter_urls(pages, spark.createDataFrame(rules, "rule string, verdict string"), ranges=ranges).collect()}
        assert got == {(i, *rule_of(u, rules)) for i, u in enumerate(urls)}


def test_url_rules_empty(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    none = spark.createDataFrame([], "rule string, verdict string")
    assert [tuple(r) for r in url_rules.filter_urls(pages, none, default="block").collect()] == [(1, "a.com", "/", None, "block")]
    assert url_rules.filter_urls(pages.filter("page_id > 1"), none).count() == 0


# --- 3: language


def test_language_of_documents(spark, sf_dir):
    found = queries.op3_language(spark, sf_dir).toPandas().set_index("doc_id")
    truth = read(spark, sf_dir, "documents").toPandas().set_index("doc_id")
    assert len(found) == len(truth)
    assert found.kept.mean() > 0.99
    text_only = language.identify(read(spark, sf_dir, "documents"), declared=None, host=None).toPandas()
    assert not text_only.kept.any()  # no declared language: nothing to learn from
    assert (found.language == truth.lang.loc[found.index])[found.kept].mean() > 0.97


def test_language_evidence(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    from pyspark.sql import functions as F

    found = language.identify(pages, "page_id", "html", declared=language.declared_in(F.col("html")), url_col="url")
    both = found.join(pages.select("page_id", language.declared_in(F.col("html")).alias("d")), "page_id").toPandas()
    assert (both.language == both.d).mean() > 0.95
    # Declared languages and host priors move a text that the trigrams leave open.
    rows = [(i, "der die und nicht " * 5, "de", "h.de") for i in range(50)] + [(100 + i, "the of and that " * 5, "en", "g.en") for i in range(50)]
    rows += [(900, "xq", "de", "h.de"), (901, "xqz", "de", "h.de"), (902, "xqz", "en", "g.en"), (903, None, "de", None), (904, "the of and that", None, None), (905, "", None, "h.de"), (905, "", None, "h.de")]
    frame = spark.createDataFrame([(*r, "x", "x") for r in rows], "doc_id long, text string, lang string, source string, language string, kept string")
    got = defaultdict(list)
    for r in language.identify(frame, declared=F.col("lang"), host=F.col("source"), per_language=20).collect():
        got[r.doc_id].append((r.language, r.kept))
    assert got[1] == [("de", True)] and got[100] == [("en", True)] and got[904] == [("en", True)]
    assert got[901][0][0] in ("de", "und") and got[902][0][0] in ("en", "und")
    assert got[903] == got[900] == [("und", False)] and got[905] == [("und", False)] * 2
    assert language.identify(frame.filter("doc_id < 0"), declared=F.col("lang"), host=F.col("source")).count() == 0


def test_rare_languages_have_a_model(spark, sf_dir):
    from pyspark.sql import functions as F

    rows = read(spark, sf_dir, "documents").select("doc_id", "text", "lang").collect()
    rare = [r for r in rows if r.lang == "es"][:24]
    most = [r for r in rows if r.lang != "es"] * 10  # the rare language holds less than half a percent
    texts = [(i, r.text, r.lang) for i, r in enumerate(rare + most)] + [(10**6 + i, rare[i].text, "gl") for i in range(5)]
    frame = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.identify(frame, declared=F.col("lang")).filter("doc_id < 24 OR doc_id >= 1000000").collect()}
    assert len(rare) == 24 and len(rare) < 0.005 * len(texts)
    assert sum(got[i].language == "es" for i in range(24)) >= 23
    assert all(got[10**6 + i].language == "und" and not got[10**6 + i].kept for i in range(5))  # declared, but too few for a model


def test_languages_without_a_model_are_rejected(spark, sf_dir):
    from pyspark.sql import functions as F

    rows = read(spark, sf_dir, "documents").withColumn("known", F.when(F.col("lang") != "es", F.col("lang")))
    found = language.identify(rows, declared=F.col("known")).join(rows.select("doc_id", "known"), "doc_id").toPandas()
    assert found[found.known.isna()].kept.mean() < 0.05
    assert found[found.known.notna()].kept.mean() > 0.99


def test_every_suffix_counts(spark, sf_dir, monkeypatch):
    from pyspark.sql import functions as F

    rows = read(spark, sf_dir, "documents").withColumn("url", F.concat(F.lit("http://h."), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise(F.concat(F.lit("s"), F.col("doc_id"))), F.lit("/")))
    sure = lambda: {r.doc_id: (r.language, round(r.confidence, 9), r.kept) for r in language.identify(rows, declared=F.col("lang"), url_col="url").collect()}
    joined = sure()
    monkeypatch.setattr(language, "LITERALS", 10_000)
    assert joined == sure()  # over 256 suffixes: the join gives what literals of all would
    monkeypatch.setattr(language, "BROADCAST_HOSTS", 3)
    monkeypatch.setattr(language, "LITERALS", 2)
    assert joined == sure()


def test_evidence_is_summed(spark, sf_dir, monkeypatch):
    """Whole ``pages`` with markup, suffix, site and host, against a plain sum; the truth is the language that the path names."""
    from pyspark.sql import functions as F

    rows = read(spark, sf_dir, "pages")
    found = {r.page_id: r for r in queries.language_of_pages(spark, sf_dir).collect()}
    seen = language.evidence(rows, "page_id", "html", language.declared_in(F.col("html")), "url")
    model = language.fit_text(seen)
    data = [(r, *model.score((r.text or "").encode())) for r in seen.collect()]
    top = [int(np.argmax(ll)) if n else None for _, ll, n in data]
    k = len(model.languages)
    count = lambda use: np.array([sum(t == i and use(r) for (r, _, _), t in zip(data, top, strict=True)) for i in range(k)], float)
    total = count(lambda r: True)
    general = (total + 1) / (total.sum() + k)
    assert k == 4 and any(r.suffix for r, _, _ in data) and any(r.site for r, _, _ in data) and any(r.declared for r, _, _ in data)
    shares = {}
    for r in {(r.site, r.host) for r, _, _ in data}:
        at_site = count(lambda x, s=r[0]: s is not None and x.site == s)
        site = (at_site + 20 * general) / (at_site.sum() + 20) if r[0] else general
        at_host = count(lambda x, h=r[1]: h is not None and x.host == h)
        shares[r] = (at_host + 20 * site) / (at_host.sum() + 20) if r[1] else general
    tables = {}
    for col in ("declared", "suffix"):
        per = {v: count(lambda x, c=col, v=v: getattr(x, c) == v) for v in {getattr(r, col) for r, _, _ in data} - {None}}
        per = {v: n for v, n in per.items() if n.sum()}
        tables[col] = {v: np.log((n + 1) / (sum(per.values()) + len(per) + 1)) for v, n in per.items()}
    for (r, ll, n), _ in zip(data, top, strict=True):
        logs = 0.25 * ll + np.log(shares[r.site, r.host]) + sum(tables[c].get(getattr(r, c), np.zeros(k)) for c in ("declared", "suffix"))
        sure = 1 / np.exp(logs - logs.max()).sum()
        fits = (r.declared is None or r.declared in model.languages) and n > 0 and ll.max() > 0
        got = found[r.id]
        assert got.kept == (fits and sure >= 0.5) and got.language == (model.languages[int(np.argmax(logs))] if fits else "und")
        assert got.confidence == pytest.approx(sure if fits else 0.0, abs=1e-6)
    named = {r.page_id: r.url.split("/")[3] for r in rows.collect() if r.url and r.url.count("/") > 3}
    truth = [(found[i].language, x) for i, x in named.items() if x in model.languages]
    assert len(truth) > 50 and np.mean([a == b for a, b in truth]) > 0.95


def test_hot_hosts_are_split(spark, sf_dir, monkeypatch):
    from pyspark.sql import functions as F

    host = F.when(F.col("doc_id") % 4 != 0, F.lit("h.de")).when(F.col("doc_id") % 8 == 0, F.concat(F.lit("g.x"), F.col("doc_id")))
    rows = read(spark, sf_dir, "documents")
    found = lambda: {r.doc_id: (r.language, round(r.confidence, 9), r.kept) for r in language.identify(rows, declared=F.col("lang"), host=host).collect()}
    whole = found()
    monkeypatch.setattr(language, "BROADCAST_HOSTS", 3)
    monkeypatch.setattr(language, "HOST_ROWS", 100)
    assert found() == whole


# --- 4: line dedup


def test_line_dedup_cases(spark):
    line = "This Is a Line of More than forty code points, ok"
    other = "é" * 40
    short = "é" * 39
    texts = [f"{line}\nown {i}\n  {line.upper()} \t\n{other}\n{short}\n\n" for i in range(6)] + [None, "", line, f"\x1c{line}", f"{line}\r", LONG, "É" * 40]
    texts += ["four times only, but over forty code points long"] * 4
    rows = [*enumerate(texts), (2, texts[2]), (3, "another row of the same id\n" + line)]
    frame = docs(spark, [t for _, t in rows], [i for i, _ in rows])
    got = linededup.dedup_lines(frame, batches=3, keep=("shard",), outputs=("kept_sha256",))
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in got.collect()) == dedup_by_hand(rows)
    assert linededup.dedup_lines(frame.filter("doc_id < 0")).count() == 0
    kept = {r.doc_id: r.kept_text for r in linededup.dedup_lines(frame).collect()}
    assert kept[0] == f"own 0\n{other}\n{short}\n\n" or kept[0] == f"own 0\n{short}\n\n"


def test_runs_are_levelled(spark):
    runs = linededup.LineRuns(spark, fan=2)
    for b in range(5):
        runs.add(spark.createDataFrame([(9 - b, h, 0) for h in range(b, b + 3)], "doc long, h1 long, h2 long"))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert {r.h1: (r.docs, r.owner) for r in runs.merged().collect()} == {h: (sum(b <= h < b + 3 for b in range(5)), 9 - min(b for b in range(5) if b <= h < b + 3)) for h in range(7)}


def test_runs_are_merged_as_they_lie(spark, capsys):
    runs = linededup.LineRuns(spark, fan=9)
    for b in range(2):
        runs.add(spark.createDataFrame([(9 - b, h, 0) for h in range(b, b + 300)], "doc long, h1 long, h2 long"))
    a, b = (spark.table(x) for x in runs.levels[0])
    with linededup._sorted_buckets(spark):
        a.hint("merge").join(b.withColumnsRenamed({"docs": "d", "owner": "o"}), ["h1", "h2"], "full").explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan and "Exchange" not in plan and " Sort [" not in plan
    files = [x.rsplit("/", 1)[1] for x in a.inputFiles()]
    assert len(files) == len({x.split("_")[-1] for x in files})  # one file a bucket
    runs.drop()


def test_an_index_outlives_a_call(spark):
    line = "a line of more than forty code points that comes back"
    first = docs(spark, [f"{line}\nown {i}" for i in range(3)], [10, 11, 12])
    later = docs(spark, [f"{line}\nown {i}" for i in range(3)], [5, 6, 7])
    runs = linededup.LineRuns(spark)
    assert all(r.n_dropped == 0 for r in linededup.dedup_lines(first, runs=runs).collect())
    assert {r.doc_id: r.kept_text for r in linededup.dedup_lines(later, runs=runs).collect()} == {5: "own 0", 6: "own 1", 7: "own 2"}
    runs.drop()


# --- 5: sharding


def walked_by_hand(rows, shards, virtual):
    """(id, size, crc) to shard: rows fill their own shard clockwise, what is over goes on to the next with room."""
    nodes = ring.points(shards, virtual)
    places = [p for p, _ in nodes]
    arcs = [[] for _ in nodes]
    for r in rows:
        at = int(hashlib.md5(("" if r[0] is None else str(r[0])).encode()).hexdigest()[:12], 16)
        arcs[bisect.bisect_left(places, at) % len(nodes)].append(((at - places[-1] - 1) % 2**48, r))
    room, out, left = ring.bounds(len(rows), shards), {}, []
    for arc, (_, shard) in zip(arcs, nodes, strict=True):
        own = [r for _, r in sorted(arc)]
        taken = min(len(own), room[shard])
        room[shard] -= taken
        out.update(dict.fromkeys(own[:taken], shard))
        left.append(own[taken:])
    waiting = []
    for i in range(2 * len(nodes)):
        shard = nodes[i % len(nodes)][1]
        while waiting and room[shard]:
            room[shard] -= 1
            out[waiting.pop(0)] = shard
        waiting += left[i] if i < len(nodes) else []
    return out


def test_ring_equals_a_plain_walk_and_moves_little(spark, sf_dir):
    rows = read(spark, sf_dir, "documents")
    shard = lambda s: {(r.doc_id, r["size"], r.text_crc32): r.shard for r in ring.assign(rows, shards=s).collect()}
    few, more = shard(24), shard(25)
    assert few == walked_by_hand(list(few), 24, 64) and more == walked_by_hand(list(more), 25, 64)
    new = sum(more[r] == 24 for r in few)
    moved = sum(few[r] != more[r] for r in few)
    assert new == len(few) // 25 and moved < 0.5 * len(few)


def test_ring_of_a_hot_id(spark, monkeypatch):
    monkeypatch.setattr(ring, "HOT_ROWS", 20)
    monkeypatch.setattr(ring, "CELL_ROWS", 10)
    texts = [f"text {i % 60}" for i in range(200)] + ["x"] * 100
    ids = [None] * 150 + [7] * 50 + list(range(100, 200))
    got = ring.assign(docs(spark, texts, ids), shards=7, virtual=5).collect()
    count = Counter(r.shard for r in got)
    assert len(got) == 300 and max(count.values()) - min(count.values()) <= 1
    assert sorted((r.shard, r.slot) for r in got) == [(s, i) for s in sorted(count) for i in range(count[s])]
    assert Counter((r.doc_id, r.text_crc32) for r in got) == Counter((i, zlib.crc32(t.encode())) for i, t in zip(ids, texts, strict=True))




def test_ring_bounds_and_overflow(spark, sf_dir):
    rows = queries.op5_ring_shards(spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in read(spark, sf_dir, "documents").collect()}
    slots = defaultdict(list)
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "rows", None)
        slots[r.shard].append(r.slot)
    assert len(rows) == len(texts) and set(slots) == set(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    nodes = ring.points(24, 64)
    stayed = sum(ring.owner(str(r.doc_id), nodes) == r.shard for r in rows)
    assert stayed > 0.75 * len(rows)  # only overflow moves


def test_ring_cases(spark, monkeypatch):
    monkeypatch.setattr(ring, "CELL_ROWS", 3)
    texts = [None, "", "a", "é", LONG, *["same"] * 40]
    ids = [None, 1, 2, 2, 2, *range(100, 140)]
    got = ring.assign(docs(spark, texts, ids), shards=7, virtual=5).collect()
    count = Counter(r.shard for r in got)
    assert sum(count.values()) == 45 and max(count.values()) - min(count.values()) <= 1 and len(count) == 7
    assert sorted((r.shard, r.slot) for r in got) == [(s, i) for s in sorted(count) for i in range(count[s])]
    again = ring.assign(docs(spark, texts, ids).repartition(7), shards=7, virtual=5).collect()
    key = lambda r: (r.doc_id or -1, r["size"], r.text_crc32, r.shard, r.slot)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert ring.assign(docs(spark, ["x"]).filter("doc_id > 5"), shards=7).count() == 0
    assert {r.shard for r in ring.assign(docs(spark, ["x", "y"]), shards=24).collect()} <= set(range(24))


# --- 6: exact top-k


def brute_top(ids, values, asked, k, score):
    out = []
    for q in asked:
        s = score(values, values[list(ids).index(q)])
        best = sorted(((-x, i) for x, i in zip(s, ids, strict=True) if i != q))[:k]
        out += [(q, n + 1, i, -x) for n, (x, i) in enumerate(best)]
    return out


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", "x") for i, v in rows], "vec_id long, embedding array<float>, score string, rank string")


@pytest.mark.parametrize("blocks", [(16_384, 4096), (40, 3)])
def test_cover_tree_is_exact(spark, blocks):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 16))
    values = np.vstack([(centres[rng.integers(0, 6, 300)] + rng.normal(0, 0.2, (300, 16))), np.tile(centres[0], (40, 1)), np.zeros((3, 16))]).astype(np.float32)
    frame = vectors(spark, [(i, v.tolist()) for i, v in enumerate(values)] + [(1000, None), (1050, []), (1100, [float("nan")] * 16), (1150, [None] * 16), (1200, [float("inf")] * 16)])
    got = covertree.top_k(frame, frame.filter("vec_id % 50 = 0"), block_rows=blocks[0], block_queries=blocks[1])
    whole = np.floor(256 * values.astype(float)).astype(int)
    want = brute_top(range(len(values)), whole, range(0, len(values), 50), 5, lambda v, q: v @ q)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_top_k_small(spark):
    few = vectors(spark, [(0, [1.0, 0.0]), (50, [0.5]), (7, [2.0, 1.0])])
    assert sorted(map(tuple, covertree.top_k(few, few.filter("vec_id % 50 = 0")).collect())) == [(0, 1, 7, 512 * 256), (0, 2, 50, 128 * 256), (50, 1, 7, 512 * 128), (50, 2, 0, 256 * 128)]
    large = vectors(spark, [(0, [3e6, 1.0]), (1, [3e6, 2.0]), (2, [3e6, 3.0])])
    assert [r.vec_id for r in covertree.top_k(large, large.filter("vec_id = 0")).orderBy("rank").collect()] == [2, 1]
    assert covertree.top_k(few.filter("vec_id < 0"), few.filter("vec_id < 0")).count() == 0


@pytest.mark.parametrize("kind", ["float", "double"])
def test_unusable_vectors_leave_good_ones_of_their_id(spark, kind):
    rows = [(0, [1.0, 2.0]), (0, [None, 1.0]), (0, [float("nan"), 1.0]), (0, [0.0, 0.0]), (7, [2.0, 1.0]), (8, [3.0, -1.0]), (8, [None, 9.0])]
    frame = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    asked = frame.filter("vec_id = 0")
    # The least usable vector asks: (0, 0) for inner products, (1, 2) for cosines, where a zero vector takes no part.
    assert sorted(map(tuple, covertree.top_k(frame, asked).collect())) == [(0, 1, 7, 0), (0, 2, 8, 0)]
    assert [(r.query_id, r["rank"], r.vec_id) for r in sorted(crosspoly.search(frame, asked).collect())] == [(0, 1, 7), (0, 2, 8)]
    one = frame.filter("vec_id <> 0 OR embedding[0] = 1")
    assert sorted(map(tuple, covertree.top_k(one, one.filter("vec_id = 0")).collect())) == [(0, 1, 7, 4 * 256 * 256), (0, 2, 8, 256 * 256)]


def test_top_k_of_doubles_and_overflow(spark):
    under = np.nextafter(3 / 256, 0)  # as a float it would be 3 / 256
    frame = spark.createDataFrame([(0, [1.0]), (1, [float(under)])], "vec_id long, embedding array<double>")
    assert [r.score for r in covertree.top_k(frame, frame.filter("vec_id = 0")).collect()] == [2 * 256]
    cos = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1e-9]), (2, [1.0, 2e-9])], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in crosspoly.search(cos, cos.filter("vec_id = 2")).orderBy("rank").collect()] in ([0, 1], [1, 0])
    big = spark.createDataFrame([(0, [4e7] * 64), (1, [4e7] * 64), (2, [-1.0] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="63 bits"):
        covertree.top_k(big, big.filter("vec_id = 0")).collect()
    large = spark.createDataFrame([(0, [1e7, 1.0]), (1, [1e7, 2.0]), (2, [1e7, 3.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in covertree.top_k(large, large.filter("vec_id = 0")).orderBy("rank").collect()] == [(i, (256 * 10_000_000) ** 2 + 65536 * (i + 1)) for i in (2, 1)]


def test_cover_tree_on_clusters(spark):
    rng = np.random.default_rng(6)
    centres = 40 * rng.normal(size=(8, 12))
    values = (centres[np.arange(800) % 8] + rng.normal(0, 0.1, (800, 12))).astype(np.float32)
    frame = vectors(spark, [(i, v.tolist()) for i, v in enumerate(values)])
    got = covertree.top_k(frame, frame.filter("vec_id % 50 = 0"), block_rows=25)
    whole = np.floor(256 * values.astype(float)).astype(int)
    assert sorted(map(tuple, got.collect())) == sorted(brute_top(range(800), whole, range(0, 800, 50), 5, lambda v, q: v @ q))


# --- 7: mixing


def test_mix_counts_and_order(spark, sf_dir):
    source = read(spark, sf_dir, "documents")
    got = queries.op7_poisson_mix(spark, sf_dir)
    keys = [r.shuffle_key for r in got.select("shuffle_key").collect()]
    assert keys == sorted(keys)
    sizes = Counter(r.source for r in source.select("source").collect())
    copies = Counter(r.source for r in got.collect())
    total = sum(sizes.values())
    weight = sum(np.sqrt(n) for n in sizes.values())
    for s, n in sizes.items():
        mean = np.sqrt(n) / weight * total
        assert abs(copies[s] - mean) < 5 * np.sqrt(mean) + 3


def test_mix_inverts_poisson(spark):
    frame = docs(spark, ["x"] * 4000 + [None, "y"], [*range(4000), None, 7])
    from pyspark.sql import functions as F

    frame = frame.withColumn("source", F.when(F.col("doc_id") % 3 == 0, None).when(F.col("doc_id") % 3 == 1, "a").otherwise("b"))
    got = poisson_mix.mix(frame, weights={None: 1.0, "a": 3.0}, keep=("text",)).collect()
    sizes = Counter(r.source for r in frame.collect())
    by = Counter((r.doc_id, r.source) for r in got)
    times = Counter((r.doc_id, r.source) for r in frame.collect())
    assert all(r.source != "b" for r in got)  # no target weight
    for (i, s), n in times.items():
        u = int(hashlib.md5(f"17:{'' if i is None else i}".encode()).hexdigest()[:13], 16) / 16**13
        rate = {None: 0.25, "a": 0.75}.get(s, 0) * 4002 / sizes[s]
        if s == "b" and i is not None or not rate:
            continue
        p = c = np.exp(-rate)
        k = 0
        while c <= u:
            k += 1
            p *= rate / k
            c += p
        assert by[i, s] == k * n
    assert poisson_mix.mix(frame.filter("doc_id < 0")).count() == 0


def test_mix_of_large_rates(spark):
    from pyspark.sql import functions as F

    for n, rate in ((1, 400), (1, 936), (1, 1500), (2, 1500)):
        many = spark.range(n * rate).select(F.col("id").alias("doc_id"), F.when(F.col("id") < n, "a").otherwise("b").alias("source"))
        got = Counter(r.doc_id for r in poisson_mix.mix(many, weights={"a": 1.0}).collect())
        assert all(abs(got[i] - rate) < 5 * np.sqrt(rate) for i in range(n)) and len({got[i] for i in range(n)}) == n


def test_mix_of_many_sources(spark, monkeypatch):
    from pyspark.sql import functions as F

    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 40).cast("string"))).alias("source"))
    got = lambda: sorted((r.doc_id, r.copy) for r in poisson_mix.mix(many).collect())
    whole = got()
    monkeypatch.setattr(poisson_mix, "BROADCAST_SOURCES", 2)
    monkeypatch.setattr(poisson_mix, "SOURCE_ROWS", 90)
    assert got() == whole


def test_mix_of_large_rates_is_a_sum_of_inversions(spark):
    from pyspark.sql import functions as F

    rate, ids = 1250.0, list(range(6))
    many = spark.range(int(6 * rate)).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 6, "a").otherwise("b").alias("source"))
    got = Counter(r.doc_id for r in poisson_mix.mix(many, weights={"a": 1.0}).collect())
    one = Fraction(rate) / 3  # three parts of at most 500
    terms, p = [], Fraction(1)
    for k in range(900):
        terms.append(p)
        p = p * one / (k + 1)
    whole = sum(terms)  # e ** rate but for a tail far below the digits used
    for i in ids:
        copies = 0
        for part in ("17:", "17.1:", "17.2:"):
            u, total, k = Fraction(int(hashlib.md5(f"{part}{i}".encode()).hexdigest()[:13], 16), 16**13), Fraction(0), 0
            while (total := total + terms[k]) <= u * whole:
                k += 1
            copies += k
        assert got[i] == copies


# --- 8: SimHash


def test_simhash_of_documents(spark, sf_dir):
    texts = [(r.doc_id, r.text) for r in read(spark, sf_dir, "documents").collect()]
    rows = [(i, fingerprint_by_hand(t)) for i, t in texts]
    want = {(i, f"{f:016x}", c) for (i, f), c in components_by_hand(rows).items()}
    assert {tuple(r) for r in queries.op8_simhash(spark, sf_dir).collect()} == want


def test_simhash_cases(spark):
    texts = [None, "", " \t", "One two", "one  TWO", "a b c d", "A\nb\x0bc\rd", LONG, "x\x1cy z w v", "É é", "é é"]
    rows = [*enumerate(texts), (4, "one two"), (9, None)]
    frame = docs(spark, [t for _, t in rows], [i for i, _ in rows])
    got = Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(frame).collect())
    hand = [(i, fingerprint_by_hand(t)) for i, t in rows]
    least = components_by_hand(hand)
    assert got == Counter((i, f, least[i, f]) for i, f in hand)
    assert simhash.near_duplicates(frame.filter("doc_id > 99")).count() == 0


@pytest.mark.parametrize("limit", [8192, 50])
@pytest.mark.parametrize("agree", [1, 2])
def test_trie_join_finds_every_link(spark, monkeypatch, limit, agree):
    rng = np.random.default_rng(4)
    seeds = rng.integers(0, 2**64, 40, dtype=np.uint64)
    near = [int(s) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 9), replace=False)) for s in np.repeat(seeds, 12)]
    ball = [int(seeds[0]) ^ (1 << a) ^ (1 << b) for a in range(0, 64, 3) for b in range(a)]
    low = list(range(64)) + [2**64 - 1 - i for i in range(40)]  # whole subtries within the budget
    values = sorted({*near, *ball, *low})
    monkeypatch.setattr(simhash, "plan", lambda n, budget: (budget + agree, agree))
    frame = spark.createDataFrame([(v - 2**64 if v >= 2**63 else v,) for v in values], "fp long")
    edges = simhash.links(frame, 4, group_limit=limit)
    assert all(((r.a ^ r.b) % 2**64).bit_count() >= 1 for r in edges.collect())
    roots = {r.node % 2**64: r.root for r in simhash.components(edges).collect()}
    want = components_by_hand([(v, v) for v in values])
    groups, own = defaultdict(set), defaultdict(set)
    for v in values:
        groups[want[v, v]].add(v)
        own[roots.get(v, v - 2**64 if v >= 2**63 else v)].add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, own.values()))


def test_long_chains_settle(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1000)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == dict.fromkeys(range(n + 1), 0)


# --- 9: quality


def test_quality_held_out(spark, sf_dir):
    found = queries.op9_byte_cnn(spark, sf_dir).toPandas()
    labels = read(spark, sf_dir, "labels").toPandas()
    both = found.merge(labels, on="doc_id")
    assert len(found) == 1000 and ((found.score >= 0) & (found.score <= 1)).all() and (found.predicted == (found.score >= 0.3)).all()
    assert (both.held_out == both.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    held = both[both.held_out]
    assert (held.predicted == held.quality).mean() >= 0.9


def test_quality_cases(spark):
    net = bytecnn.fit([bytecnn.chunk_view(b"good text here " * 9), bytecnn.chunk_view(b"!!!! #### ")], np.array([1, 0], np.float32), 0.5, epochs=30)
    texts = ["", None, LONG, "good text here", "!!!! #### "]
    got = {r.doc_id: r.score for r in bytecnn.score(docs(spark, texts), net).collect()}
    assert len(got) == 5 and all(0 <= s <= 1 for s in got.values()) and got[3] > got[4] and got[0] == got[1]
    assert got[2] == pytest.approx(float(bytecnn.scores(net, [LONG.encode()])[0]))
    labels = spark.createDataFrame([(1, 1, "x"), (1, 0, "x"), (None, 0, "x"), (2, None, "x"), (3, 7, "x")], "doc_id long, quality int, text string")
    one = bytecnn.train(docs(spark, texts), labels)
    assert one.constant == 1.0
    assert bytecnn.train(docs(spark, texts), labels.filter("doc_id > 9")).constant == 0.5
    assert bytecnn.score(docs(spark, texts).filter("doc_id > 99"), net).count() == 0


def test_scores_do_not_depend_on_company(spark, sf_dir):
    texts = [(r.text or "").encode() for r in read(spark, sf_dir, "documents").limit(150).collect()] + [b"", b"x", LONG.encode()]
    net = bytecnn.fit([bytecnn.chunk_view(t) for t in texts[:20]], np.array([0, 1] * 10, np.float32), 0.5, epochs=2)
    alone = np.array([bytecnn.scores(net, [t])[0] for t in texts])
    order = np.random.default_rng(0).permutation(len(texts))
    mixed = np.empty(len(texts))
    for part in np.array_split(order, 7):
        mixed[part] = bytecnn.scores(net, [texts[i] for i in part])
    assert (alone == mixed).all()


def test_filters_equal_a_naive_convolution():
    texts = [b"", b"abcde abcde abcde", "é good text, twice a good text".encode() * 12, bytes(range(256)) * 3]
    net = bytecnn.fit([bytecnn.chunk_view(t) for t in texts], np.array([1, 0, 1, 0], np.float32), 0.5, epochs=3)
    for text, got in zip(texts, bytecnn.features(net, iter(texts)), strict=True):
        pooled = []
        for chunk in bytecnn.chunk_view(text):
            seen, codes = set(), []
            for i, byte in enumerate(chunk.tolist()):
                gram = bytes(chunk[i : i + 5])
                codes.append(byte + 256 * (len(gram) == 5 and gram in seen))
                seen.add(gram)
            windows = [sum(net.embed[codes[at + t]] @ net.filters[t] for t in range(8)) for at in range(0, 249, 2)]
            pooled.append(np.maximum(np.max(windows, axis=0) + net.bias, 0))
        assert np.allclose(got, np.hstack([np.max(pooled, axis=0), np.mean(pooled, axis=0)]), atol=1e-3)


def test_training_has_the_same_bits_on_every_processor():
    code = "import numpy as np; from cairn.llm import bytecnn as b; t = [bytes(np.random.default_rng(i).integers(32, 90, 700, dtype=np.uint8)) for i in range(40)]; net = b.fit([b.chunk_view(x) for x in t], np.arange(40) % 2, 0.4, epochs=2); print(b.scores(net, t).tobytes().hex())"
    root = os.path.dirname(os.path.dirname(bytecnn.__file__)).rsplit("/", 1)[0]
    kinds = [{"OPENBLAS_CORETYPE": k} for k in ("Haswell", "Zen", "Prescott")] + [{"NPY_DISABLE_CPU_FEATURES": "AVX512F AVX512CD AVX512_SKX"}]
    out = {subprocess.run([sys.executable, "-W", "ignore", "-c", code], env={**os.environ, "PYTHONPATH": root, **k}, capture_output=True, text=True, check=True).stdout for k in kinds}
    assert len(out) == 1


def test_chunks_cover_every_window():
    for n in (0, 1, 255, 256, 257, 495, 496, 497, 5000):
        data = bytes(np.random.default_rng(n).integers(1, 256, n, dtype=np.uint8))
        view = bytecnn.chunk_view(data)
        windows = {bytes(w) for row in view for w in np.lib.stride_tricks.sliding_window_view(row, 8)[::2]}
        assert all(data[i : i + 8] in windows for i in range(0, n - 7, 2))


# --- 10: approximate nearest neighbours


def cosine(v, q):
    return (v * q).sum(axis=1) / (np.sqrt((v * v).sum(axis=1)) * np.sqrt((q * q).sum()))


def test_cross_polytope_recall(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").collect()
    ids, values = [r.vec_id for r in rows], np.array([r.embedding for r in rows], float)
    want = brute_top(ids, values, [i for i in ids if i % 50 == 0], 5, cosine)
    got = queries.op10_cross_polytope(spark, sf_dir).collect()
    by = {(r.query_id, r.vec_id): r.score for r in got}
    assert len(got) == len(want)
    assert np.mean([(q, i) in by for q, _, i, _ in want]) >= 0.9
    assert all(by[q, i] == pytest.approx(s, abs=1e-12) for q, _, i, s in want if (q, i) in by)


def test_cross_polytope_cases(spark):
    rng = np.random.default_rng(2)
    same = rng.normal(size=8).tolist()
    rows = [(i, rng.normal(size=8).tolist()) for i in range(100)] + [(i, same) for i in range(100, 400)]
    bad = [(1000, None), (1050, []), (1100, [0.0] * 8), (1150, [float("nan")] * 8), (1200, [None] * 8), (None, same)]
    frame = vectors(spark, rows + bad)
    got = crosspoly.search(frame, frame.filter("vec_id % 50 = 0"), group_limit=20).collect()
    answer = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        answer[r.query_id].append(r.vec_id)
    assert set(answer) == set(range(0, 400, 50)) and all(len(v) == 5 and q not in v for q, v in answer.items())
    assert answer[200] == [100, 101, 102, 103, 104]
    few = vectors(spark, [(0, [1.0, 0.0]), (7, [2.0]), (50, [0.0, 1.0])])
    assert [(r.query_id, r.vec_id) for r in sorted(crosspoly.search(few, few.filter("vec_id % 50 = 0")).collect())] == [(0, 7), (0, 50), (50, 0), (50, 7)]
    assert crosspoly.search(few.filter("vec_id < 0"), few.filter("vec_id < 0")).count() == 0


def test_joins_of_hot_keys(spark):
    from pyspark.sql import functions as F

    from cairn.llm import _shared

    big = spark.createDataFrame([(1 if i < 70 else i % 5 if i < 90 else None, i) for i in range(100)], "k long, v long")
    small = spark.createDataFrame([(0, "a"), (1, "b"), (9, "c")], "k long, w string")
    for how in ("inner", "left"):
        plain = Counter(map(tuple, big.join(small, "k", how).select("k", "v", "w").collect()))
        assert Counter(map(tuple, _shared.joined_hot(big, small, "k", F.col("v"), 10, how).select("k", "v", "w").collect())) == plain


def test_release_deletes_intermediate_tables(spark):
    from cairn.llm import _shared

    table = _shared.stored(spark.range(3).toDF("id"))
    other = _shared.stored(spark.range(4).toDF("id"))
    assert table.count() == 3 and _shared.release(spark, other.filter("id > 1")) == 1 and table.count() == 3
    assert _shared.release(spark) >= 1 and not _shared._MADE
    with pytest.raises(Exception, match="(?i)not exist|FILE_NOT_EXIST|PATH_NOT_FOUND|No such file"):
        spark.read.parquet(table.inputFiles()[0]).count()

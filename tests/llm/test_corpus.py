"""Near-duplicates, shards, the mix and the pipeline."""

import re
import zlib
from itertools import combinations

import duckdb
import numpy as np
import pytest
from fixtures import KEY, messy_rows, sentence
from pyspark.sql import functions as F

import corpus_pipeline
from weftline.llm import bpe, hashing, mixing, neardup, sharding


def brute_components(rows, words, percent=80):
    """(set size, component) by doc_id, from all pairs."""
    low = str.maketrans({c: chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    top = {i: i for i in sets}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            top[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates(spark, words):
    rng = np.random.default_rng(words)
    rows = []
    for g in range(12):
        base = [f"w{x}" for x in rng.integers(0, 400, 80)]
        for k in range(8):  # a chain: each is near the one before, the ends need not be
            rows.append((len(rows), " ".join(base)))
            at = rng.integers(0, 80, 1 + g % 4)
            base = [f"n{g}-{k}-{i}" if i in at else w for i, w in enumerate(base)]
    rows += [(1000 + k, sentence("en", 5) + f" tail{k % 7}") for k in range(60)]  # a large group
    rows += [(2000, None), (2001, ""), (2002, " "), (2003, "one"), (2004, "ONE"), (2005, "long " * 30_000)]
    want = brute_components(rows, words)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), words=words).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and len(got) == len(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_messy_rows(spark, messy, nothing):
    got = neardup.near_duplicates(messy).collect()
    assert len(got) == len(messy_rows())
    by = {r.doc_id: r for r in got}
    assert by[103].component_id == 0 and by[113].component_id == 1 and by[120].component_id == 120 and by[125].component_id == 124
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)
    assert neardup.near_duplicates(nothing).collect() == []


def test_pruning_keeps_pairs_at_the_threshold():
    rng = np.random.default_rng(1)
    least = neardup.least_matches(80)
    a = np.zeros((1, neardup.HASHES), dtype=np.uint8)
    near = (rng.random((20_000, neardup.HASHES)) > 0.8).astype(np.uint8)
    far = (rng.random((2_000, neardup.HASHES)) > 0.3).astype(np.uint8)
    assert len(neardup.plausible(a, near, least)) >= 20_000 - 2 and len(neardup.plausible(a, far, least)) == 0


def test_shingles():
    a, b, c, d, e = hashing.shingle_sets(["A b  c", "a\tb c", None, "x", "a b a b a"], 2)
    assert (a == b).all() and len(a) == 2 and len(c) == 0 and len(d) == 1 and len(e) == 2


def test_shards(spark, messy, nothing):
    for docs in (messy, messy.limit(1), messy.where("doc_id in (0, 100, 101, 102, 103)")):
        rows = sharding.shard_by_bytes(docs).collect()
        assert len(rows) == docs.count() and {r.law for r in rows} == {"bytes"} and all(r.grown_shard is None for r in rows)
        for s in range(8):
            assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert sharding.shard_by_bytes(nothing).collect() == []
    plan = sharding.shard_by_bytes(messy)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    many = spark.createDataFrame([(i, "t" * (50 + i % 90) if i % 3 else "the same") for i in range(9000)] + [(9001, "long" * 20_000)], "doc_id long, text string")
    rows = sharding.shard_by_bytes(many).collect()
    sums = [sum(r.size for r in rows if r.shard == s) for s in range(8)]
    mean = sum(r.size for r in rows) / 8
    assert all(abs(x - mean) < 80_001 for x in sums)  # by less than the largest record
    assert all(r.text_crc32 == zlib.crc32(b"the same") for r in rows if r.doc_id % 3 == 0 and r.doc_id < 9000)


def test_records_alike_in_text_and_id_are_dealt_over_shards(spark):
    rows = spark.range(4_000).select(F.lit(None).cast("long").alias("doc_id"), F.when(F.col("id") % 4 == 0, F.lit(None)).when(F.col("id") % 4 == 1, "same").otherwise(F.col("id").cast("string")).alias("text"))
    got = sharding.shard_by_bytes(rows).collect()
    sums = [sum(r.size for r in got if r.shard == s) for s in range(8)]
    assert len(got) == 4_000 and max(sums) - min(sums) <= 12
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_the_shards_are_those_of_the_law(spark):
    rows = spark.createDataFrame([(i, f"{i} " * (1 + i * 7 % 40)) for i in range(700)], "doc_id long, text string")
    got = sharding.shard_by_bytes(rows).orderBy("shard", "slot").collect()
    total, before = sum(r.size for r in got), 0
    for r in got:  # in order of shard and slot, a record lies in the shard that its exact byte offset names
        assert r.shard == before * 8 // total
        before += r.size


def test_near_duplicates_need_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "MEMBERS", 5)
    monkeypatch.setattr(neardup, "SHINGLES", 400)
    rng = np.random.default_rng(9)
    rows = []
    for g in range(3):
        base = [f"w{x}" for x in rng.integers(0, 90, 60)]
        for k in range(25):
            rows.append((len(rows), " ".join(base)))
            at = rng.integers(0, 60, 3)
            base = [f"n{g}-{k}-{i}" if i in at else w for i, w in enumerate(base)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), words=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, 2)


def test_an_id_with_several_texts_has_the_least(spark):
    rows = [(1, "b c d e"), (1, "a b c d"), (1, None), (1, " "), (2, "a b c d"), (3, "b c d e"), (4, None), (4, ""), (4, None)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), words=2).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(1, 3, 1)] * 4 + [(2, 3, 1), (3, 3, 3)] + [(4, 0, 4)] * 3


def test_near_dedup_stage_takes_columns_of_any_kind(spark):
    rows = spark.createDataFrame([(1, "a b c d e f", {"k": "v"}), (1, "a b c d e f", {"k": "v"}), (2, "A b c d e f", {}), (None, "x", None), (3, None, {"z": None})], "doc_id long, text string, extra map<string,string>")
    got = corpus_pipeline.near_dedup(spark, rows, "").collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in got) == [(False, 0), (True, 1), (True, 3)]


def test_the_mix_is_that_of_the_sql(spark, messy, tmp_path):
    messy.select("doc_id", "text", "lang", "source", "n_chars").where("doc_id is not null").distinct().write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(f"SELECT doc_id, domain, lang, source, n_tokens, copies FROM ({mixing.OP9_SQL})").fetchall()
    assert sorted(map(tuple, mixing.op9_mixing(spark, str(tmp_path)).collect())) == sorted(want) and want


def test_budgets_go_to_siblings_first(spark, nothing):
    docs = [(f"{s}-{i}", "en" if s != "c" else "de", s, 10) for s, n in (("a", 100), ("b", 5), ("c", 100)) for i in range(n)]
    rows = spark.createDataFrame(docs, "doc_id string, lang string, source string, n int")
    got = mixing.mix(rows, share=0.5, epochs=1, domain=F.lit("d"), tokens=F.col("n").cast("long"), lang_weights={"en": 1.0, "de": 1.0}, source_weights={"a": 1.0, "b": 1.0})
    sums = {r.source: r.t for r in got.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    # half of 2050 is 1025, so 512 a language: b holds 50 and its sibling a takes the rest of theirs
    assert sums == {"a": 460, "b": 50, "c": 510}
    assert mixing.mix(nothing).collect() == []


def test_pipeline(spark, messy, nothing):
    columns = messy.columns
    docs = messy
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "").cache()
        seen[name] = docs.collect()
        if name != "tokenise":
            assert docs.columns == columns
    by = {k: {r.doc_id: r for r in v} for k, v in seen.items()}
    assert not {120, 121, 122, 123} & set(by["language_id"]) and {0, 1, 2, 130, 131, 140} <= set(by["language_id"])
    assert not {100, 101, 102, 103, 110, 111, 112, 113} & set(by["near_dedup"]) and {0, 1, 2} <= set(by["near_dedup"])
    assert KEY not in by["secret_scan"][130].text and len(seen["secret_scan"]) == len(seen["near_dedup"]) and by["secret_scan"][130].n_chars == len(by["secret_scan"][130].text)
    assert 0 < len(seen["mixing"]) <= len(seen["secret_scan"])
    enc = bpe.built(bpe.default_vocabulary(spark).value)[0]
    texts = {r.doc_id: r.text for r in seen["mixing"]}
    assert len(seen["tokenise"]) == len(seen["mixing"]) and all(r.ids == enc.encode_ordinary(texts[r.doc_id] or "") for r in seen["tokenise"])
    empty = nothing
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, "")
    assert empty.collect() == []

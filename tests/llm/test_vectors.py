"""Nearest neighbours and exact top-k against brute force."""

import numpy as np
import pytest

from weftline.llm.ann import nearest, op1_ann
from weftline.llm.topk import exact_top_k, finite_vectors, op8_exact_top_k


def _table(tmp_path, spark, rows):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, bucket string, v string, id string").write.parquet(str(tmp_path / "embeddings.parquet"))
    return str(tmp_path)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 24))
    x = (centres[rng.integers(0, 20, 600)] + 0.5 * rng.normal(size=(600, 24))).astype(np.float32)
    x[100:180] = x[100]  # a large group of equal vectors
    return x


def _rows(x):
    bad = [(900, None), (901, [0.0] * 24), (902, [1.0, None] + [0.0] * 22), (903, [float("nan")] * 24), (904, [float("inf")] + [0.0] * 23), (None, [1.0] * 24), (950, [1.0, 2.0])]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    return [(*r, 1, "b", "v", "i") for r in [*rows, rows[7], *bad]]


def test_nearest(spark, tmp_path, vectors):
    sf = _table(tmp_path, spark, _rows(vectors))
    got = {}
    for r in op1_ann(spark, sf).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    y = vectors.astype(float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 600, 50):
        s = y @ y[q]
        s[q] = -9
        want = np.lexsort((np.arange(600), -np.round(s, 12)))[:5]
        assert sorted(got[q]) == [1, 2, 3, 4, 5]
        hit += len({v for v, _ in got[q].values()} & set(want.tolist()))
        for v, score in got[q].values():
            assert abs(score - s[v]) < 1e-12
        assert [x for _, x in sorted(got[q].items())] == sorted(got[q].values(), key=lambda x: (-x[1], x[0]))
    assert hit >= 0.9 * 60
    assert not set(got) - set(range(0, 600, 50)) - {950}


def test_top_k_is_exact(spark, tmp_path, vectors):
    sf = _table(tmp_path, spark, _rows(vectors))
    got = {}
    for r in op8_exact_top_k(spark, sf).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    y = np.floor(vectors.astype(float) * 256).astype(np.int64)
    y = np.vstack([y, np.zeros((1, 24), dtype=np.int64)])  # 901 is a vector like others here
    ids = np.array([*range(600), 901])
    for q in range(0, 600, 50):
        s = y @ y[q]
        other = ids != q
        order = np.lexsort((ids[other], -s[other]))[:5]
        assert sorted(got[q]) == [(k + 1, int(ids[other][o]), int(s[other][o])) for k, o in enumerate(order)]
    assert 950 not in got  # alone in its dimension


def test_settings_are_as_before(spark, vectors):
    before = [spark.conf.get(k, None) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")]
    some = finite_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors[:60])], "vec_id long, embedding array<float>"))
    exact_top_k(some, some), nearest(some, some)
    assert before == [spark.conf.get(k, None) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")]


def test_a_bucket_of_several_blocks_is_searched_whole(spark, monkeypatch):
    from weftline.llm import ann

    monkeypatch.setattr(ann, "BLOCK", 50)
    monkeypatch.setattr(ann, "ASKED", 7)
    rng = np.random.default_rng(1)
    x = np.vstack([np.tile(rng.normal(size=16), (200, 1)), rng.normal(size=(100, 16))])
    vecs = finite_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"))
    got = nearest(vecs, vecs.where("id < 200")).collect()
    for q in (0, 3, 199):
        assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == [v for v in range(6) if v != q][:5]


def test_few_and_none(spark):
    schema = "vec_id long, embedding array<double>"
    few = finite_vectors(spark.createDataFrame([(0, [3.0, 4.0]), (1, [1.0, 0.0]), (50, [0.0, 2.0**40])], schema))
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in exact_top_k(few, few.where("id = 0")).orderBy("rank").collect()] == [(0, 1, 50, 4 * 2**40), (0, 2, 1, 3)]
    assert [(r.rank, r.vec_id, r.score) for r in nearest(few, few.where("id = 0")).orderBy("rank").collect()] == [(1, 50, pytest.approx(0.8)), (2, 1, pytest.approx(0.6))]
    # four vectors of 64 dimensions share few buckets: each still finds the other three
    rng = np.random.default_rng(0)
    four = finite_vectors(spark.createDataFrame([(i, rng.normal(size=64).tolist()) for i in range(4)], schema))
    assert sorted((r.query_id, r.vec_id) for r in nearest(four, four).collect()) == [(i, j) for i in range(4) for j in range(4) if i != j]
    # scores up to the ends of a long keep their order; what no long holds is held at its end
    wide = finite_vectors(spark.createDataFrame([(0, [2.0**31, 0.0]), (1, [2.0**31, 1.0]), (2, [2.0**31 - 1, 0.0]), (3, [2.0**40, 0.0]), (4, [-(2.0**40), 0.0])], schema))
    got = exact_top_k(wide, wide.where("id = 0")).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(3, 2**63 - 1), (1, 2**62), (2, 2**62 - 2**31), (4, -(2**63) + 1)]
    none = finite_vectors(spark.createDataFrame([], schema))
    assert exact_top_k(none, none).collect() == [] and nearest(none, none).collect() == []


COPIES = """
import sys
from pyspark.sql import SparkSession, functions as F
from weftline.llm.topk import exact_top_k

conf = {"spark.driver.memory": "640m", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "2", "spark.checkpoint.dir": sys.argv[1]}
spark = SparkSession.builder.master("local[2]").config(map=conf).getOrCreate()
spark.sparkContext.setLogLevel("OFF")
same = spark.range(600_000).select("id", F.array(*(F.lit(float(i % 37)) for i in range(64))).alias("v"))
got = exact_top_k(same, same.where("id % 100000 = 50")).orderBy("query_id", "rank").collect()
score = sum((i % 37) ** 2 for i in range(64))
assert [tuple(r) for r in got] == [(q, k + 1, k, score) for q in range(50, 600_000, 100_000) for k in range(5)]
spark.stop()
"""


def test_blocks_of_copies_are_held_a_few_at_a_time(tmp_path):
    """600,000 copies are 300 MB in blocks, though a few in their files; all of Spark has 640 MB here."""
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    done = subprocess.run([sys.executable, "-c", COPIES, str(tmp_path)], cwd=root, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-3000:]


def test_blocks_are_bounded_by_components(spark, vectors, monkeypatch):
    from weftline.llm import topk

    some = finite_vectors(spark.createDataFrame([(i, [float(int(x * 256)) for x in v]) for i, v in enumerate(vectors[:120])], "vec_id long, embedding array<double>"))
    want = sorted(map(tuple, exact_top_k(some, some).collect()))
    held = []
    monkeypatch.setattr(topk, "COMPONENTS", 24 * 16)  # of 24 dimensions: blocks of 16 candidates and 4 queries about, 4 tasks of queries
    monkeypatch.setattr(topk, "packed", lambda rows, keys, fields, prefix, f=topk.packed: held.append((prefix, rows.select(keys[0]).distinct().count())) or f(rows, keys, fields, prefix))
    assert sorted(map(tuple, exact_top_k(some, some).collect())) == want
    assert {p for p, n in held} == {"c", "q"} and all(n >= (6 if p == "c" else 20) for p, n in held)

"""Exact top-k inner products by distributed histogram selection.

Every query meets every candidate, block by block: each task reads some packed candidate blocks and a few packed query blocks,
so that neither is written once for each of the other. A round counts
scores into the bins of each query's current interval, sums the counts over all blocks and keeps the bin that holds the
k-th value; rounds go on until bins are one wide, so that the k-th value is known exactly. A last pass keeps the scores
above it and, at it, the least ids. Scores are integers, computed exactly, and never stored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, settings, table

TOP, EVERY = 5, 50
#: Vectors in a packed block of candidates and of queries at most, and bins of a histogram.
CANDIDATES, QUERIES, BINS = 4096, 1024, 512
#: Components in a packed block of candidates at most (8 MB; a quarter of that in one of queries), and query blocks of a task.
COMPONENTS, TOGETHER = 1 << 20, 8
#: Blocks that a file's writer holds before it looks at their size, and that its reader decodes at once. However well they are
#: compressed (copies are, to a hundredth), a task holds a few of them.
AT_ONCE = 2
BLOCK_FILE = {"parquet.page.size.row.check.min": AT_ONCE, "parquet.block.size.row.check.min": AT_ONCE, "parquet.page.size.row.check.max": AT_ONCE, "parquet.block.size.row.check.max": AT_ONCE}
#: The largest long. A score that no long can hold is held here (256 * x of unit vectors stays below 2**17).
HELD = 2**63 - 1


def sound(id_col: str, vec_col: str) -> Column:
    """Whether a row takes part: neither id nor vector is null, and no component is null or not finite."""
    v = F.col(vec_col)
    return F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))


def finite_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, v array<double>), one row an id: rows whose id or vector is null or whose vector holds a null or non-finite
    component are left out; of rows with one id (repeats) the least vector counts."""
    good = vectors.where(sound(id_col, vec_col))
    return good.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(F.col(vec_col).cast("array<double>")).alias("v"))


def packed(rows: DataFrame, keys: list[str], fields: list[str], prefix: str) -> DataFrame:
    """One row a key: each field as an array, in one order; vectors `v` and probes `p` are laid end to end. Callers bound the
    rows of a key."""
    got = rows.groupBy(*keys).agg(F.collect_list(F.struct(*fields)).alias("_p"))
    return got.select(*keys, *(F.flatten(F.col(f"_p.{f}")).alias(f"{prefix}{f}") if f in ("v", "p") else F.col(f"_p.{f}").alias(f"{prefix}{f}") for f in fields))


def blocks_of(n: int, size: int) -> int:
    return max(1, math.ceil(n / size))


def block(n: int, id_col: str = "id") -> Column:
    return F.pmod(F.xxhash64(id_col, F.lit(17)), F.lit(n)).cast("int")


def exact_dots(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of integral vectors, exact as int64; those beyond +-HELD are held there."""
    most = lambda x: float(np.abs(x).max(initial=0))
    if q.shape[1] * most(q) * most(c) < 2**53:
        return np.rint(q @ c.T).astype(np.int64)
    q, c = ([[int(x) for x in row] for row in m] for m in (q, c))
    return np.array([[max(-HELD, min(HELD, sum(map(int.__mul__, a, b)))) for b in c] for a in q], dtype=np.int64).reshape(len(q), len(c))


def _column(batch: pa.RecordBatch, name: str, row: int) -> np.ndarray:
    return batch.column(name)[row].values.to_numpy(zero_copy_only=False)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Query ids, their interval's start and count left, candidate ids, scores (own rows and unequal dimensions masked out)."""
    for b in batches:
        for r in range(b.num_rows):
            n = b.column("dim")[r].as_py()
            qid, lo, left, cid = (_column(b, x, r) for x in ("qid", "qlo", "qleft", "cid"))
            q, c = (_column(b, x, r).reshape(len(i), n) for x, i in (("qv", qid), ("cv", cid)))
            s = exact_dots(q, c)
            yield qid, lo, left, cid, s, qid[:, None] != cid[None, :]


def _histograms(width: int, bins: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for qid, lo, left, _, s, other in _pairs(batches):
            ids, at, n = [], [], []
            for i in range(len(qid)):
                x = s[i][other[i] & (s[i] >= lo[i])]
                x = (x.view(np.uint64) - lo[i : i + 1].view(np.uint64)) // np.uint64(width)  # of unsigned longs, which hold any difference
                v, c = np.unique(x[x < bins], return_counts=True)
                # bins under the one of this block's own k-th value can't hold the k-th of all
                keep = max(0, len(v) - 1 - int(np.searchsorted(np.cumsum(c[::-1]), left[i])))
                ids.append(np.full(len(v) - keep, qid[i])), at.append(v[keep:].astype(np.int64)), n.append(c[keep:])
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (ids, at, n)], names=["id", "bin", "n"])

    return run


def _selected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for qid, lo, left, cid, s, other in _pairs(batches):
        ids, to, score = [], [], []
        for i in range(len(qid)):
            above = np.nonzero(other[i] & (s[i] > lo[i]))[0]
            level = np.nonzero(other[i] & (s[i] == lo[i]))[0]
            pick = np.concatenate([above, level[np.argsort(cid[level], kind="stable")[: max(int(left[i]), 0)]]])
            ids.append(np.full(len(pick), qid[i])), to.append(cid[pick]), score.append(s[i][pick])
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (ids, to, score)], names=["query_id", "vec_id", "score"])


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k candidates with the highest integer inner product for each query.

    vectors and queries: (id, v) with integral components held as doubles, one row an id (see finite_vectors). A query's
    own id is no candidate; vectors of another dimension aren't either. Ties go to the smaller id. Fewer candidates than k:
    all of them. No queries or no candidates: no rows.
    """
    spark = vectors.sparkSession
    with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch=4, spark__sql__objectHashAggregate__sortBased__fallbackThreshold=4):
        n, dim, norm = vectors.agg(F.count("*"), F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
        nc = blocks_of(n, max(1, min(CANDIDATES, COMPONENTS // max(dim or 0, 1))))
        cand = cut(packed(vectors.withColumn("cb", block(nc)).withColumn("dim", F.size("v")), ["cb", "dim"], ["id", "v"], "c"), **BLOCK_FILE)
        queries = cut(queries)
        asked_dim = queries.agg(F.max(F.size("v"))).first()[0]
        nb = blocks_of(queries.count(), max(1, min(QUERIES, COMPONENTS // 4 // max(asked_dim or 0, 1))))
        with settings(spark, spark__sql__parquet__columnarReaderBatchSize=AT_ONCE):
            return _exact_top_k(cand, queries, nb, norm, k)


def _exact_top_k(cand: DataFrame, queries: DataFrame, nb: int, norm: float | None, k: int) -> DataFrame:
    span = int(min((norm or 0) * (1 + 1e-9) + 2, HELD))  # no score is beyond the largest square of a norm
    most = 2 * span + 1
    width = max(1, BINS ** max(0, math.ceil(math.log(most, BINS)) - 1))
    while width * BINS < most:
        width *= BINS
    state = queries.select("id", F.lit(-span).cast("long").alias("lo"), F.lit(k).cast("long").alias("left"))

    def met(run, schema: str) -> DataFrame:
        asked = queries.join(state, "id").withColumn("qb", block(nb)).withColumn("dim", F.size("v"))
        asked = packed(asked, ["qb", "dim"], ["id", "v", "lo", "left"], "q").repartition(blocks_of(nb, TOGETHER))
        # every task reads its share of either side; a file's size says little of its blocks, so neither is broadcast
        return cand.join(asked.hint("shuffle_replicate_nl"), ["dim"]).mapInArrow(run, schema)

    while True:
        counts = met(_histograms(width, BINS), "id long, bin long, n long").groupBy("id", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("id").orderBy(F.desc("bin"))
        counts = counts.withColumn("upto", F.sum("n").over(down)).join(state, "id").where(F.col("upto") - F.col("n") < F.col("left"))
        # of the bins from the top down, the last that is not past the k-th value (the lowest of all, if there are fewer)
        at = counts.groupBy("id").agg(F.min("bin").alias("bin"), F.max("upto").alias("upto"), F.min_by("n", "bin").alias("n"))
        state = cut(state.join(at, "id").select("id", (F.col("lo").cast("decimal(20,0)") + F.col("bin").cast("decimal(20,0)") * F.lit(str(width)).cast("decimal(20,0)")).cast("long").alias("lo"), (F.col("left") - F.col("upto") + F.col("n")).alias("left")))
        if width == 1:
            break
        width = max(1, math.ceil(width / BINS))
    found = met(_selected, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return cut(found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = finite_vectors(table(spark, sf_dir, "embeddings")).withColumn("v", F.transform("v", lambda x: F.floor(x * 256).cast("double")))
    whole = cut(whole)
    return exact_top_k(whole, whole.where(F.col("id") % EVERY == 0))


OP8_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5
"""

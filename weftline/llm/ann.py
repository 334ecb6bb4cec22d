"""Approximate nearest neighbours by cross-polytope hashing.

A pseudo-rotation turns a unit vector fast (random signs, then a Walsh-Hadamard transform, three times); the nearest signed
axis among AXES of its coordinates is its hash, and two such hashes side by side name one of (2 * AXES)**2 buckets of a table.
A query probes the buckets that its own rotations come nearest to, over all pairs of axes, in every table; what lies there is
reranked by exact cosines where it lies, so that candidate pairs never become rows. Neighbouring buckets share a cell of
bounded size and a crowded bucket is split over blocks, to each of which its probes go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, records, settings, table
from .topk import EVERY, TOP, _column, block, blocks_of, packed, sound

#: Hash tables, coordinates whose signed axes are told apart, and buckets that a query probes in each table. README has what
#: they give: recall, and the share of all pairs that is evaluated.
TABLES, AXES, PROBES = 4, 32, 352
#: A query whose k-th cosine found is under this is compared with all vectors: so far off, too many near ones share no bucket.
SURE = 0.31
#: Vectors, and queries, in one block of a cell.
BLOCK, ASKED = 4096, 2048
SEED, ROUNDS = 20_240, 3
#: Cosines this close are compared again by sums in one fixed order.
CLOSE = 1e-9


def rotated(x: np.ndarray, t: int) -> np.ndarray:
    """Rows x, padded to a power of two, under pseudo-rotation t (times the root of that power, each round)."""
    d = 1 << max(0, x.shape[1] - 1).bit_length()
    y = np.zeros((len(x), d), dtype=np.float32)
    y[:, : x.shape[1]] = x
    rng = np.random.default_rng([SEED, t, d])
    for _ in range(ROUNDS):
        y *= rng.choice(np.array([-1, 1], dtype=np.float32), d)
        h = 1
        while h < d:
            z = y.reshape(len(y), -1, 2, h)
            a, b = z[:, :, 0], z[:, :, 1]
            a += b
            b *= -2
            b += a
            h *= 2
    return y


def signed_axes(x: np.ndarray, t: int, axes: int) -> np.ndarray:
    """How far each row reaches along each signed axis: 2 * axis, plus 1 for its negative; of unit rows a cosine."""
    y = rotated(x, t)
    y /= np.float32(y.shape[1] ** (ROUNDS / 2))
    y = y[:, :axes]
    return np.stack([y, -y], axis=2).reshape(len(y), -1)


def buckets(x: np.ndarray, t: int, axes: int) -> np.ndarray:
    """The bucket of each row in table t."""
    a, b = (signed_axes(x, 2 * t + k, axes) for k in (0, 1))
    return a.argmax(axis=1) * a.shape[1] + b.argmax(axis=1)


def probed(x: np.ndarray, t: int, axes: int, probes: int) -> np.ndarray:
    """For each row the `probes` buckets of table t for which it has to move least to be nearest to both their axes."""
    a, b = (signed_axes(x, 2 * t + k, axes) for k in (0, 1))
    out = np.empty((len(x), min(probes, a.shape[1] ** 2)), dtype=np.int64)
    for i in range(len(x)):
        far = ((a[i].max() - a[i]) ** 2)[:, None] + ((b[i].max() - b[i]) ** 2)[None, :]
        out[i] = np.argsort(far, axis=None, kind="stable")[: out.shape[1]]
    return out


def _unit(flat: np.ndarray, n: int) -> np.ndarray:
    x = flat.astype(float).reshape(n, -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _by_dimension(v: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, rows, unit vectors) of the vectors of a batch."""
    ends, flat = v.offsets.to_numpy(), v.values.to_numpy(zero_copy_only=False)
    for d in np.unique(np.diff(ends)):
        at = np.nonzero(np.diff(ends) == d)[0]
        yield int(d), at, _unit(flat[(ends[at][:, None] + np.arange(d)).ravel()], len(at))


def _hashed(tables: int, axes: int, only: bool = False):
    """Adds the buckets `b` of each row; with `only` they come alone, with the dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in records(batches, BLOCK):
            code = np.empty((b.num_rows, tables), dtype=np.int32)
            for _, at, x in _by_dimension(b.column("v")):
                for t in range(tables):
                    code[at, t] = buckets(x, t, axes)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * tables, pa.int32()), pa.array(code.ravel()))
            if only:
                yield pa.RecordBatch.from_arrays([pa.array(np.diff(b.column("v").offsets.to_numpy()).astype(np.int32)), lists], names=["dim", "b"])
            else:
                yield pa.RecordBatch.from_arrays([*b.columns, lists], names=[*b.schema.names, "b"])

    return run


def _asking(tables: int, axes: int, probes: int, cells: dict[int, np.ndarray]):
    """For each query the cells it goes to, each with the probed buckets there; empty cells are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in records(batches, 256):
            sent: list[list[dict]] = [[] for _ in range(b.num_rows)]
            for d, at, x in _by_dimension(b.column("v")):
                for t in range(tables if d in cells else 0):
                    for i, p in zip(at, probed(x, t, axes, probes)):
                        p = np.sort(p)
                        cell = cells[d][t][p]
                        p, cell = p[cell >= 0], cell[cell >= 0]
                        starts = np.nonzero(np.diff(cell, prepend=-1))[0]
                        sent[i] += [{"cell": int(cell[s]), "p": part} for s, part in zip(starts, np.split(p, starts[1:]))]
            kind = pa.list_(pa.struct([("cell", pa.int64()), ("p", pa.list_(pa.int32()))]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sent, kind)], names=[*b.schema.names, "sent"])

    return run


def celled(sizes: list[tuple[int, int, int, int]], axes: int, tables: int) -> tuple[dict[int, np.ndarray], list[tuple[int, int]]]:
    """Cells of (dimension, table, bucket, vectors) rows: by dimension the cell of each bucket of each table (-1: empty), and
    (cell, blocks). Neighbouring buckets fill a cell up to BLOCK vectors; a larger bucket is a cell of several blocks."""
    cells: dict[int, np.ndarray] = {}
    held: list[int] = []
    last = None
    for d, t, bucket, n in sorted(sizes):
        if d not in cells:
            cells[d] = np.full((tables, (2 * axes) ** 2), -1, dtype=np.int64)
        if last == (d, t) and held[-1] + n <= BLOCK:
            held[-1] += n
        else:
            held.append(n)
        last = (d, t)
        cells[d][t, bucket] = len(held) - 1
    return cells, [(i, blocks_of(n, BLOCK)) for i, n in enumerate(held)]


def _reranked(k: int):
    def best(q: np.ndarray, c: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, ...]:
        o = np.lexsort((c, -s, q))
        q, c, s = q[o], c[o], s[o]
        keep = np.ones(len(q), dtype=bool)
        keep[1:] = (q[1:] != q[:-1]) | (c[1:] != c[:-1])
        q, c, s = q[keep], c[keep], s[keep]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < k
        return q[keep], c[keep], s[keep]

    def met(b: pa.RecordBatch, r: int) -> Iterator[tuple[np.ndarray, ...]]:
        """Of each bucket of a block, the pairs that can be among the k nearest there."""
        qid, cid, where = _column(b, "qid", r), _column(b, "cid", r), _column(b, "cb", r)
        q, c = _unit(_column(b, "qv", r), len(qid)), _unit(_column(b, "cv", r), len(cid))
        order = np.argsort(where, kind="stable")
        names, first = np.unique(where[order], return_index=True)
        asker, to = np.repeat(np.arange(len(qid)), _column(b, "qn", r)), _column(b, "qp", r)
        at = np.minimum(np.searchsorted(names, to), len(names) - 1)
        hit = names[at] == to
        asker, at = asker[hit], at[hit]
        turn = np.argsort(at, kind="stable")
        asker, at = asker[turn], at[turn]
        groups = np.nonzero(np.diff(at, prepend=-1))[0]
        ends = [*first[1:], len(order)]
        for g, e in zip(groups, [*groups[1:], len(at)]):
            i, j = asker[g:e], order[first[at[g]] : ends[at[g]]]
            s = q[i] @ c[j].T
            s[qid[i][:, None] == cid[j][None, :]] = -9
            nth = max(0, s.shape[1] - k)
            x, y = np.nonzero((s >= np.partition(s, nth, axis=1)[:, nth, None] - CLOSE) & (s > -9))
            for part in np.array_split(np.arange(len(x)), 1 + len(x) // 100_000):
                m, n = i[x[part]], j[y[part]]
                yield qid[m], cid[n], (q[m] * c[n]).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = tuple(np.empty(0, dtype=x) for x in (np.int64, np.int64, float))
        for b in batches:
            for r in range(b.num_rows):
                held, n = [none], 0
                for got in met(b, r):
                    held.append(got)
                    n += len(got[0])
                    if n > 500_000:
                        held = [best(*map(np.concatenate, zip(*held)))]
                        n = 0
                yield pa.RecordBatch.from_arrays(list(map(pa.array, best(*map(np.concatenate, zip(*held))))), names=["query_id", "vec_id", "score"])

    return run


def _top(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query among rows that may repeat a pair."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", rank).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = TOP, tables: int = TABLES, axes: int = AXES, probes: int = PROBES, sure: float = SURE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each query by cosine, ties to the smaller id.

    vectors and queries: (id, v array of float or double), finite and not zero; queries, one row an id, are found among
    vectors, less their own id. Vectors that share an id are one candidate with the best of their scores. Vectors of another
    dimension are no candidates. A query whose probes find fewer than k candidates, or a k-th cosine under `sure`, is compared
    with all vectors, so fewer than k come back only where there are fewer. No queries or no vectors: no rows.
    """
    with settings(vectors.sparkSession, spark__sql__execution__arrow__maxBytesPerBatch=1 << 24):
        return _nearest(vectors, queries, k, tables, axes, probes, sure)


def _nearest(vectors: DataFrame, queries: DataFrame, k: int, tables: int, axes: int, probes: int, sure: float) -> DataFrame:
    schema = vectors.schema.simpleString()[len("struct<") : -1].replace(":", " ")
    sizes = vectors.mapInArrow(_hashed(tables, axes, only=True), "dim int, b array<int>").select("dim", F.posexplode("b").alias("t", "b"))
    sizes = sizes.groupBy("dim", "t", "b").agg(F.count("*").alias("n")).collect()  # a row a bucket, whatever the rows
    cells, parts = celled([tuple(r) for r in sizes], axes, tables)
    if not parts:
        return cut(vectors.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0))
    spark = vectors.sparkSession
    where = spark.createDataFrame([(d, t, b, int(c[t, b])) for d, c in cells.items() for t, b in np.argwhere(c >= 0).tolist()], "dim int, t int, b int, cell long")
    many = F.broadcast(spark.createDataFrame([(c, n) for c, n in parts], "cell long, nb int"))
    hashed = vectors.mapInArrow(_hashed(tables, axes), f"{schema}, b array<int>")
    there = hashed.select("id", "v", F.size("v").alias("dim"), F.posexplode("b").alias("t", "b"))
    there = there.join(F.broadcast(where), ["dim", "t", "b"]).join(many, "cell")
    there = packed(there.withColumn("part", F.pmod(F.xxhash64("id", F.lit(3)), F.col("nb"))), ["cell", "part"], ["id", "v", "b"], "c")

    queries = cut(queries)
    asked = queries.mapInArrow(_asking(tables, axes, probes, cells), f"{schema}, sent array<struct<cell: long, p: array<int>>>")
    asked = cut(asked.select("id", "v", F.explode("sent").alias("s")).select("id", "v", "s.cell", "s.p", F.size("s.p").alias("n")))
    crowd = asked.groupBy("cell").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("mb"))  # a row a cell
    asked = asked.join(many, "cell").join(F.broadcast(crowd), "cell").withColumn("qpart", F.pmod(F.xxhash64("id", F.lit(5)), F.col("mb")))
    asked = packed(asked, ["cell", "qpart", "nb"], ["id", "v", "p", "n"], "q")
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb").cast("long") - 1))).drop("nb")
    found = cut(_top(there.join(asked, ["cell", "part"]).mapInArrow(_reranked(k), "query_id long, vec_id long, score double"), k))

    few = found.where((F.col("rank") == k) & (F.col("score") >= sure)).select(F.col("query_id").alias("id"))
    few = cut(queries.join(few, "id", "left_anti"))
    if not few.isEmpty():
        nc, nb = blocks_of(sum(r.n for r in sizes) // tables, BLOCK), blocks_of(few.count(), ASKED)
        there = packed(vectors.withColumn("part", block(nc)).withColumn("dim", F.size("v")).withColumn("b", F.lit(0)), ["part", "dim"], ["id", "v", "b"], "c")
        asked = few.withColumn("qb", block(nb)).withColumn("dim", F.size("v")).withColumn("p", F.array(F.lit(0))).withColumn("n", F.lit(1))
        asked = packed(asked, ["qb", "dim"], ["id", "v", "p", "n"], "q").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(nc - 1))))
        found = found.unionByName(_top(there.join(asked, ["part", "dim"]).mapInArrow(_reranked(k), "query_id long, vec_id long, score double"), k).select(*found.columns))
        found = cut(_top(found.drop("rank"), k))
    return found.select("query_id", "rank", "vec_id", "score")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that are null, zero or hold null or non-finite components take no part; of query rows that share an id the
    least vector asks."""
    rows = table(spark, sf_dir, "embeddings")
    whole = rows.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("v")).where(sound("id", "v") & F.exists("v", lambda x: x != 0))
    asked = whole.where(F.col("id") % EVERY == 0).groupBy("id").agg(F.min("v").alias("v"))
    return nearest(whole, asked)

"""Scratch tables in the folder the cluster shares, and helpers that several operators use."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch sent to a Python worker; keeps a batch of long texts within a worker's memory.
BATCH_ROWS = 256

_scratch: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one of this process only where that is unset (local tests)."""
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not named:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="weftline-")
        root = f"{named.rstrip('/')}/weftline-{uuid.uuid4().hex}"
        _scratch[app] = root
        atexit.register(_sweep, spark, root)
    return _scratch[app]


def _sweep(spark: SparkSession, root: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the JVM may be gone at exit
        return


def cut(df: DataFrame, **options: object) -> DataFrame:
    """df written once to the shared folder (by the writer's options) and read back: lineage ends here and survives lost
    executors."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


ARROW_ROWS, ARROW_BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int | None = None) -> None:
    """Bounds the rows (and with `size` the bytes) of an Arrow batch, for operators that send whole texts to Python. Their frames
    run later, under the session's settings of that time, so the bound stays; a lower one is left alone."""
    if not 0 < int(spark.conf.get(ARROW_ROWS)) <= rows:
        spark.conf.set(ARROW_ROWS, str(rows))
    if size and spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(ARROW_BYTES)) > size:
        spark.conf.set(ARROW_BYTES, str(size))


@contextmanager
def settings(spark: SparkSession, **values: object) -> Iterator[None]:
    """Session settings (dots as two underscores) for operators that write their result before they return."""
    names = {k.replace("__", "."): str(v) for k, v in values.items()}
    old = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def records(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of so many rows at most; a piece's lists begin at offset 0."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([c]) if b.num_rows <= rows else c.take(pa.array(np.arange(at, min(at + rows, b.num_rows)))) for c in b.columns], names=b.schema.names)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Consecutive rows with equal keys from batches of a partition that is sorted by them; a group may span batches."""
    held: list[pd.DataFrame] = []
    for pdf in frames:
        if not len(pdf):
            continue
        code = np.zeros(len(pdf), dtype=bool)
        for k in keys:
            v = pdf[k].to_numpy()
            code[1:] |= v[1:] != v[:-1]
        starts = [0, *np.nonzero(code)[0], len(pdf)]
        for a, b in zip(starts, starts[1:]):
            part = pdf.iloc[a:b]
            if a == 0 and held and all(held[0][k].iloc[0] == part[k].iloc[0] for k in keys):
                held.append(part)
                continue
            if held:
                yield pd.concat(held, ignore_index=True)
            held = [part]
    if held:
        yield pd.concat(held, ignore_index=True)


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, label): the smallest node reachable, for every node on an edge.

    Least labels pass along the edges, then each label takes its own label (pointer jumping), until none changes. Hubs
    only meet in joins that adaptive execution may split and in minima that are combined before the shuffle.
    """
    edges = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v")
    both = cut(edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = cut(both.groupBy(F.col("u").alias("node")).agg(F.least(F.first("u"), F.min("v")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        low = cut(labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")))
        jump = low.select(F.col("node").alias("label"), F.col("label").alias("top"))
        done = cut(low.join(jump, "label").select("node", "old", F.col("top").alias("label")))
        if done.where("label <> old").isEmpty():
            return done.select("node", "label")
        labels = done.select("node", "label")

"""Quality of documents by hierarchical empirical Bayes.

A logistic model on hashed words, fitted to a bounded sample of labelled documents, gives each document evidence in the
form of log odds. Sites (hosts) and paths within them have rates of good documents of their own: a host's posterior is a
beta posterior around the global rate, a path's around its host's, and the strengths of both priors come from the spread of
the groups (moments), so that sparse groups shrink to what is above them. A document's posterior adds the log odds of its
path, less those of the global rate that the classifier has seen already, to its own evidence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .hashing import word_hashes
from .shared import cut, small_batches, table

#: Labelled documents that the classifier is fitted to at most, hashed features, passes of the fit, its step and penalty.
SAMPLE, FEATURES, PASSES, STEP, PENALTY = 6_000, 1 << 14, 150, 1.0, 1e-3
#: How far a group's log odds count beside the document's own evidence.
TRUST = 0.5
#: Posterior under which a document is turned away.
KEEP = 0.5


def _features(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its features (hashed words, and dense ones at the end) and their values, of unit length in the words."""
    h, ends = word_hashes(texts)
    slot = (h >> np.uint64(40)).astype(np.int64) % FEATURES
    for t, a, b in zip(texts, ends, ends[1:]):
        f, n = np.unique(slot[a:b], return_counts=True)
        value = np.log1p(n) / max(1e-9, float(np.sqrt((np.log1p(n) ** 2).sum()))) if len(f) else np.empty(0)
        chars = max(1, len(t or ""))
        marks = np.frombuffer((t or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
        upper, odd = ((marks >= 65) & (marks <= 90)).sum() / chars, np.isin(marks, list(b"*#$%&|!=<>{}")).sum() / chars
        kinds = len(np.unique(h[a:b])) / max(1, b - a)
        dense = np.array([1.0, min(1.0, 4 * upper), min(1.0, 10 * odd), kinds, min(1.0, np.log1p(b - a) / 10)])
        yield np.concatenate([f, FEATURES + np.arange(5)]), np.concatenate([value, dense])


def fitted(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int]) -> np.ndarray:
    """Of documents' features and labels, weights of a logistic model by full-batch gradient steps scaled per feature; zeros if one of the classes is missing."""
    w = np.zeros(FEATURES + 5)
    y = np.array(labels, dtype=float)
    if not len(y) or y.min() == y.max():
        return w
    f = np.concatenate([a for a, _ in rows])
    v = np.concatenate([b for _, b in rows])
    r = np.repeat(np.arange(len(rows)), [len(a) for a, _ in rows])
    scale = np.full(len(w), 1e-8)
    for _ in range(PASSES):
        p = 1 / (1 + np.exp(-np.bincount(r, w[f] * v, len(y))))
        g = np.bincount(f, ((p - y) / len(y))[r] * v, len(w)) + PENALTY * w / len(y) ** 0.5
        scale += g * g
        w -= STEP * g / np.sqrt(scale)
    return w


def evidence(docs: DataFrame, weights: np.ndarray, text_col: str = "text", out: str = "evidence") -> DataFrame:
    """docs with `out`: log odds of the whole text under the model (a null text counts as empty)."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(weights)  # FEATURES + 5 numbers

    @F.pandas_udf("double")
    def judge(texts: pd.Series) -> pd.Series:
        w = model.value
        return pd.Series([float((w[f] * v).sum()) for f, v in _features(texts.tolist())])

    return docs.withColumn(out, judge(F.col(text_col)))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _rates(docs: DataFrame, keys: list[str]) -> DataFrame:
    """Soft counts of good documents a group; sums are combined before the shuffle, so a hot group sends one row a task."""
    return docs.groupBy(*keys).agg(F.sum("p").alias("good"), F.count("*").alias("n"))


def _strength(groups: DataFrame, mean: Column) -> float:
    """Prior strength by moments: the weighted spread of the groups' rates over what chance alone would give."""
    n = F.col("n").cast("double")
    rate = F.col("good") / n
    spread, noise, total = groups.agg(F.sum(n * (rate - mean) ** 2), F.sum(mean * (1 - mean)), F.sum(n)).first()
    if not total or noise is None:
        return 1.0
    between = max(1e-4, (spread - noise) / total)
    return float(min(1e6, max(1.0, noise / max(1, groups.count()) / between)))


def judged(docs: DataFrame, host_col: str = "host", path_col: str = "path", evidence_col: str = "evidence") -> DataFrame:
    """docs (with evidence, host and path) with host_rate, path_rate and quality, the posterior of being good.

    Columns of those three names are replaced, others are kept. Null hosts or paths form groups of their own (as ''), null
    evidence counts as none (log odds 0). One global prior is the mean of the documents' own odds; without documents there
    are no rows.
    """
    own = F.coalesce(F.col(evidence_col), F.lit(0.0))
    named = docs.select(F.struct(*docs.drop("host_rate", "path_rate", "quality").columns).alias("_doc"), own.alias("e"), F.coalesce(F.col(host_col), F.lit("")).alias("_host"), F.coalesce(F.col(path_col), F.lit("")).alias("_path"))
    paths = cut(_rates(named.select("_host", "_path", (1 / (1 + F.exp(-F.col("e")))).alias("p")), ["_host", "_path"]))
    good, total = paths.agg(F.sum("good"), F.sum("n")).first()
    rate = min(1 - 1e-3, max(1e-3, (good or 0.0) / (total or 1)))
    hosts = paths.groupBy("_host").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    s = _strength(hosts, F.lit(rate))
    hosts = cut(hosts.select("_host", ((F.col("good") + s * rate) / (F.col("n") + s)).alias("host_rate")))
    paths = paths.join(hosts, "_host")
    sp = _strength(paths, F.col("host_rate"))
    groups = paths.select("_host", "_path", "host_rate", ((F.col("good") + sp * F.col("host_rate")) / (F.col("n") + sp)).alias("path_rate"))
    shift = TRUST * (_logit(F.col("path_rate")) - float(np.log(rate / (1 - rate))))
    # groups are joined to documents by adaptive execution, which splits what a hot host holds
    out = named.join(groups, ["_host", "_path"])
    return out.select("_doc.*", "host_rate", "path_rate", (1 / (1 + F.exp(-(F.col("e") + shift)))).alias("quality"))


def site_of(source: Column, lang: Column) -> tuple[Column, Column]:
    """Documents of the test tables name a source and a language; they stand in for host and path."""
    return source.alias("host"), F.concat_ws("/", source, lang).alias("path")


def _taught(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        f, v = zip(*_features(pdf["text"].tolist())) if len(pdf) else ((), ())
        yield pd.DataFrame({"luck": pdf["luck"], "y": pdf["y"], "f": list(f), "v": list(v)})


def trained(docs: DataFrame, labels: DataFrame, label_col: str = "quality", each: int = SAMPLE) -> np.ndarray:
    """Weights from `each` labelled documents at most, drawn by a hash of the id; labels other than 0 and 1 don't teach. A
    document of two labels teaches both; of rows that share an id one teaches (that of the least hash). Whole texts teach:
    their features are made by the executors, and the driver gets FEATURES numbers a document at most."""
    small_batches(docs.sparkSession)
    labels = labels.where(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label_col).cast("int").alias("y"), F.xxhash64("doc_id", F.lit(5)).alias("luck")).distinct()
    drawn = labels.orderBy("luck", "doc_id", "y").limit(each)
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(drawn), "doc_id")  # `each` small rows are broadcast
    rows = rows.groupBy("luck", "doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("luck", "y", "text")
    got = rows.mapInPandas(_taught, "luck long, y int, f array<long>, v array<double>").toPandas().sort_values(["luck", "y"])
    return fitted(list(zip(got["f"], got["v"])), got["y"].tolist())


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights = trained(docs, table(spark, sf_dir, "labels"))
    host, path = site_of(F.col("source"), F.col("lang"))
    own = cut(evidence(docs.select("doc_id", host, path, "text"), weights).drop("text"))
    return judged(own).select("doc_id", "host", "path", "evidence", "host_rate", "path_rate", "quality", (F.col("quality") >= KEEP).alias("kept"))

"""Near-duplicates by MinHash banding and sequential Bayesian verification.

1. Texts with one shingle set form a class, held by its least doc_id; classes get MinHash signatures and band keys.
2. Each bucket of a band links its members to the one of least id (a star, not all pairs). A pair's signatures are compared
   a batch at a time and dropped once the posterior odds of reaching the threshold fall under MISS; what is left is verified
   on the full shingle sets. Connected components follow.
3. Buckets that still hold several components may hide links that no star tested. Their members meet block by block: those
   outside the bucket's main component against all others, under the same tests: signatures alone first, then the texts of
   those members that still have a plausible partner in their block. Pairs live inside a block only; a block gives the links
   that join components.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .hashing import mixed, shingle_sets
from .shared import BATCH_ROWS, components, cut, groups, settings, table

WORDS, PERCENT = 5, 80
#: At similarity 0.8 a pair shares no bucket with odds (1 - 0.8**ROWS)**BANDS = 3e-6.
BANDS, ROWS = 32, 5
#: Odds with which a pair at the threshold may be dropped unverified, and hashes compared at a time.
MISS, BATCH = 1e-7, 32
#: Members, and shingles, of one side of a block (expected).
MEMBERS, SHINGLES = 256, 500_000
HASHES = BANDS * ROWS
_rng = np.random.default_rng(0xB0B)
_A = _rng.integers(0, 2**31, HASHES, dtype=np.uint32) << np.uint32(1) | np.uint32(1)
_B = _rng.integers(0, 2**32, HASHES, dtype=np.uint32)


def signature(shingles: np.ndarray) -> np.ndarray:
    """HASHES least hash values of a set that isn't empty."""
    x = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    least = np.full(HASHES, 2**32 - 1, dtype=np.uint32)
    for i in range(0, len(x), 512):
        np.minimum(least, (_A[:, None] * x[None, i : i + 512] + _B[:, None]).min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    key = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
    for row in least.reshape(BANDS, ROWS).T.astype(np.uint64):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + row)
    return key.view(np.int64)


def least_matches(percent: int, miss: float = MISS) -> np.ndarray:
    """For each count of compared hash bytes, the fewest equal ones at which the posterior odds (from even odds for any
    similarity) of a similarity of percent / 100 or more are `miss` at least."""
    p = percent / 100 + (1 - percent / 100) / 256
    out = np.zeros(HASHES + 1, dtype=np.int64)
    for n in range(BATCH, HASHES + 1, BATCH):
        total = 0.0
        for m in range(n + 2):  # P(Beta(m + 1, n - m + 1) >= p) = P(Binomial(n + 1, p) <= m)
            total += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(p) + (n + 1 - m) * math.log1p(-p)) if p < 1 else float(m == n + 1)
            if total >= miss:
                out[n] = min(m, n)
                break
    return out


def plausible(a: np.ndarray, b: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Which rows of hash bytes a and b stay plausible, batch after batch."""
    alive = np.arange(len(b))
    same = np.zeros(len(b), dtype=np.int64)
    for n in range(BATCH, HASHES + 1, BATCH):
        at = slice(n - BATCH, n)
        same[alive] += ((a if len(a) == 1 else a[alive])[:, at] == b[alive][:, at]).sum(axis=1)
        alive = alive[same[alive] >= least[n]]
    return alive


def _signed(words: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            sets = shingle_sets(pdf["text"].tolist(), words)
            least = [signature(s) if len(s) else None for s in sets]
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"],
                "n": [len(s) for s in sets],
                "fp": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                "bands": [None if x is None else band_keys(x) for x in least],
                "sig": [None if x is None else ((x * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes() for x in least],
            })

    return run


def _bytes(sigs) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, sigs)), dtype=np.uint8).reshape(-1, HASHES)


def _hopeful(least: np.ndarray, percent: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            na, nb = pdf["na"].to_numpy(), pdf["nb"].to_numpy()
            pdf = pdf[100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)]
            if len(pdf):
                keep = plausible(_bytes(pdf["sa"]), _bytes(pdf["sb"]), least)
                yield pdf.iloc[keep][["a", "b", "parts"]]

    return run


def _linked(one: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the sorted sets reach the threshold with `one`."""
    size = np.array([len(x) for x in others], dtype=np.int64)
    flat = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    both = np.add.reduceat((one[at] == flat).astype(np.int64), np.cumsum([0, *size[:-1]]))
    return 100 * both >= percent * (len(one) + size - both)


def _stars(words: int, percent: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in groups(frames, ["g", "s"]):
            g = g.drop_duplicates("id")
            sets = shingle_sets(g["text"].tolist(), words)
            ids, a = g["id"].to_numpy(), g["g"].iloc[0]
            if len(g) < 2 or ids[0] != a:
                continue
            hit = _linked(sets[0], sets[1:], percent)
            yield pd.DataFrame({"u": a, "v": ids[1:][hit]})

    return run


class _Block:
    """Members of one block cell, those of the left side first: who may be a partner of whom, by labels, sizes, bands and signatures."""

    def __init__(self, g: pd.DataFrame, percent: int, least: np.ndarray):
        self.ids, self.label, self.n, self.sig = g["id"].to_numpy(), g["label"].to_numpy(), g["n"].to_numpy(), _bytes(g["sig"])
        self.bands, self.right = np.stack(g["bands"].to_numpy()), g["side"].to_numpy() == 1
        self.within, self.percent, self.least = g["i"].iloc[0] == g["j"].iloc[0], percent, least

    def left(self) -> np.ndarray:
        return np.nonzero(~self.right)[0]

    def partners(self, x: int, now: np.ndarray) -> np.ndarray:
        """Of member x, under the labels `now`."""
        n, after = self.n, np.arange(len(self.n)) > x
        at = np.nonzero((now != now[x]) & (100 * np.minimum(n, n[x]) >= self.percent * np.maximum(n, n[x])) & (after if self.within else self.right))[0]
        at = at[(self.bands[at] == self.bands[x]).any(axis=1)] if len(at) else at
        return at[plausible(self.sig[x : x + 1], self.sig[at], self.least)] if len(at) else at


def _hopeful_members(percent: int, least: np.ndarray):
    """Of each block cell the members that have a plausible partner there: only their texts are needed."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in groups(frames, ["g", "i", "j"]):
            g = g.drop_duplicates("id")
            block, keep = _Block(g, percent, least), np.zeros(len(g), dtype=bool)
            for x in block.left():
                at = block.partners(x, block.label)
                keep[at] = True
                keep[x] |= len(at) > 0
            if keep.any():
                yield g.loc[keep, ["g", "i", "j", "id", "label", "side"]]

    return run


def _blocks(words: int, percent: int, least: np.ndarray):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in groups(frames, ["g", "i", "j"]):
            g = g.drop_duplicates("id")
            block, sets = _Block(g, percent, least), shingle_sets(g["text"].tolist(), words)
            root: dict = {}

            def top(x):
                while (y := root.get(x, x)) != x:
                    x = y
                return x

            u, v = [], []
            for x in block.left():
                at = block.partners(x, np.array([top(y) for y in block.label]))
                if len(at):
                    for y in at[_linked(sets[x], [sets[k] for k in at], percent)]:
                        p, q = top(block.label[x]), top(block.label[y])
                        if p != q:
                            root[max(p, q)] = min(p, q)
                            u.append(block.ids[x]), v.append(block.ids[y])
            if u:
                yield pd.DataFrame({"u": u, "v": v})

    return run


def _parts(members: Column, shingles: Column, most: int) -> Column:
    return F.greatest(F.ceil(members / most), F.ceil(shingles / SHINGLES)).cast("int")


def _pick(id_col: str, parts: Column) -> Column:
    return F.pmod(F.xxhash64(id_col, F.lit(11)), parts).cast("int")


def _with_text(sent: DataFrame, docs: DataFrame) -> DataFrame:
    """sent (a written table with an id and a side) with each id's text.

    A Bloom filter of the ids (a few MB, whatever the input; Spark's own runtime filter) keeps most texts that nobody asks for
    out of the shuffle.
    """
    return sent.where("side >= 0").join(docs.withColumnRenamed("doc_id", "id"), "id")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of docs.

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z as a-z; a text's set holds its distinct shingles of `words` words (fewer words: one
    shingle of all; null, empty or blank: none). Texts are linked if 100 * common >= percent * united; component_id is the
    least doc_id reachable by links and kept says whether it is the row's own. Sets are held by 64-bit hashes of shingles.
    Empty sets are linked with nothing. Ids are integers (text that isn't one fails the query). Rows of one id are one document; if
    their texts differ, the least that isn't blank is that of all of them. Rows without an id stand alone, kept, with a null
    component_id. Other columns are not read.
    """
    with settings(docs.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch=BATCH_ROWS, spark__sql__optimizer__runtime__bloomFilter__applicationSideScanSizeThreshold=0):
        return _near_duplicates(docs, words, percent, id_col, text_col)


def _near_duplicates(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    bounds = least_matches(percent)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sign = lambda d: cut(d.mapInPandas(_signed(words), "doc_id long, n long, fp binary, bands array<long>, sig binary"))
    signed = sign(docs)
    same = (F.min("fp") == F.max("fp")) & (F.count("fp") == F.count("*"))
    torn = cut(signed.where("doc_id is not null").groupBy("doc_id").agg(F.count("fp").alias("k"), same.alias("same")).where("k > 0 and not same").select("doc_id"))
    if not torn.isEmpty():  # ids with several texts
        least = docs.join(torn, "doc_id").groupBy("doc_id").agg(F.min(F.when(F.length(F.trim("text")) > 0, F.col("text"))).alias("t"))
        docs = cut(docs.join(least, "doc_id", "left").select("doc_id", F.coalesce("t", "text").alias("text")))
        signed = sign(docs)
    has = F.col("fp").isNotNull() & F.col("doc_id").isNotNull()
    classes = signed.where(has).groupBy("fp").agg(F.min("doc_id").alias("id"), F.min_by(F.struct("n", "bands", "sig"), "doc_id").alias("r"))
    classes = cut(classes.select("fp", "id", "r.*"))
    whole = signed.where(has).select("doc_id", "n", "fp").join(classes.select("fp", F.col("id").alias("rep")), "fp").drop("fp")
    reps = classes.drop("fp")

    keys = reps.select("id", "n", F.explode("bands").alias("key"))
    centres = keys.groupBy("key").agg(F.count("*").alias("size"), F.sum("n").alias("held"), F.min("id").alias("centre")).where("size > 1")
    # a centre has a bucket a band at most; what they hold together bounds its star, which is dealt over as many parts
    centres = centres.withColumn("parts", _parts(F.sum("size").over(Window.partitionBy("centre")), F.sum("held").over(Window.partitionBy("centre")), MEMBERS))
    members = cut(keys.drop("n").join(cut(centres).drop("held"), "key"))

    stars = members.where("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b"), "parts").distinct()
    side = lambda x: reps.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"s{x}"))
    hopeful = cut(stars.join(side("b"), "b").join(side("a"), "a").mapInPandas(_hopeful(bounds, percent), "a long, b long, parts int"))
    sent = hopeful.select(F.col("a").alias("g"), _pick("b", F.col("parts")).alias("s"), F.col("b").alias("id"), F.lit(1).alias("side"))
    sent = sent.unionByName(sent.select("g", "s", F.col("g").alias("id"), F.lit(0).alias("side")).distinct())
    links = cut(_with_text(cut(sent), docs).repartition("g", "s").sortWithinPartitions("g", "s", "side").mapInPandas(_stars(words, percent), "u long, v long"))
    labels = components(links)

    named = members.where("size > 2").join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    named = cut(named.select("key", "id", "label"))
    mixed_up = named.groupBy("key", "label").agg(F.count("*").alias("c")).groupBy("key").agg(F.count("*").alias("labels"), F.max(F.struct("c", "label")).alias("most")).where("labels > 1")
    mixed_up = cut(mixed_up)
    rest = cut(named.join(mixed_up.select("key", F.col("most.label").alias("g")), "key").select("g", "id", "label").distinct().join(reps.select("id", "n"), "id"))
    main = F.col("label") == F.col("g")
    count = lambda c, x: _parts(F.count_if(c), F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)), MEMBERS).alias(x)
    rest = rest.join(rest.groupBy("g").agg(count(main, "nm"), count(~main, "ns")), "g").where("ns > 0")
    block = _pick("id", F.when(main, F.col("nm")).otherwise(F.col("ns")))
    rest = rest.withColumn("blk", block).withColumn("main", main)
    none = F.array().cast("array<int>")
    through = lambda a, b: F.when(b >= a, F.sequence(a, b)).otherwise(none)
    ns, nm, blk, zero = F.col("ns"), F.col("nm"), F.col("blk"), F.lit(0)
    cells = F.when(F.col("main"), F.transform(through(zero, ns - 1), lambda i: F.struct(i.alias("i"), (ns + blk).alias("j"), F.lit(1).alias("side")))).otherwise(
        F.concat(
            F.transform(through(blk, ns + nm - 1), lambda j: F.struct(blk.alias("i"), j.alias("j"), F.lit(0).alias("side"))),
            F.transform(through(zero, blk - 1), lambda i: F.struct(i.alias("i"), blk.alias("j"), F.lit(1).alias("side"))),
        )
    )
    met = rest.select("g", "id", "label", F.explode(cells).alias("x")).select("g", "id", "label", "x.i", "x.j", "x.side")
    dealt = lambda x: x.join(reps, "id").repartition("g", "i", "j").sortWithinPartitions("g", "i", "j", "side")
    met = cut(dealt(met).mapInPandas(_hopeful_members(percent, bounds), "g long, i int, j int, id long, label long, side int"))
    met = dealt(_with_text(met, docs))
    more = met.mapInPandas(_blocks(words, percent, bounds), "u long, v long")

    held = lambda x, y: labels.select(F.col("node").alias(x), F.col("label").alias(y))
    more = more.join(held("u", "lu"), "u", "left").join(held("v", "lv"), "v", "left").select(F.coalesce("lu", "u").alias("u"), F.coalesce("lv", "v").alias("v"))
    joined = components(cut(more)).select(F.col("node").alias("l1"), F.col("label").alias("l2"))
    merged = reps.select(F.col("id").alias("rep")).distinct().join(held("rep", "l"), "rep", "left").select("rep", F.coalesce("l", "rep").alias("l1"))
    merged = cut(merged.join(joined, "l1", "left").select("rep", F.coalesce("l2", "l1").alias("component_id")))
    out = whole.select("doc_id", F.col("n").alias("n_shingles"), "rep").join(merged, "rep").drop("rep")
    alone = signed.where(~has).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return cut(out.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=2)

"""Shards of near equal bytes by sampled splitters, with DataFrame functions only.

A record's key is (hash of its text, doc_id, number of its row), so that equal texts lie next to each other. A size-weighted sample of keys
gives the splitters of many ranges; ranges that turn out overfull are subdivided from samples of their own. Exact sizes of
the ranges then place every record at its exact byte offset in key order, and the offset decides the shard: a group of
equal texts stays whole unless it is larger than a WHOLE-th part of a shard; only such a group is parted where a shard's
end falls into it.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, table

SHARDS = 8
#: Ranges aimed at: at least, at most, and rows that a range holds on average in between. The driver gets DRAWN keys a range.
RANGES, MOST_RANGES, RANGE_ROWS = 64, 4096, 1_000_000
#: Keys drawn a range. Ranges over OVERFULL times the mean are subdivided until none is left that can be.
DRAWN, OVERFULL = 32, 2.0
#: Groups of equal texts up to this part of a shard's mean bytes stay in one shard.
WHOLE = 64
FIRST = -(2**63)


def _splitter_index(cuts: list[tuple[int, int, int]]) -> Column:
    """How many splitters are at most the key (_h, _i, _u): a binary search over constant arrays."""
    if not cuts:
        return F.lit(0)
    held = [F.split(F.lit(",".join(str(c[k]) for c in cuts)), ",").cast("array<bigint>") for k in range(3)]
    steps = [2**k for k in range(int(math.log2(len(cuts))), -1, -1)]

    def step(low: Column, jump: Column) -> Column:
        to = low + jump
        at = F.least(to, F.lit(len(cuts))) - 1
        h, i, u = (F.get(x, at) for x in held)
        within = (h < F.col("_h")) | ((h == F.col("_h")) & ((i < F.col("_i")) | ((i == F.col("_i")) & (u <= F.col("_u")))))
        return F.when((to <= len(cuts)) & within, to).otherwise(low)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)


def _drawn(keys: DataFrame, n: int, seed: int) -> list[tuple[int, int, int]]:
    """n keys at most, drawn without replacement with odds by weight (the n least of exponential waiting times)."""
    u = (F.pmod(F.xxhash64("_i", "_h", "_u", F.lit(seed)), F.lit(2**52)) + 1) / F.lit(2.0**52 + 1)
    least = keys.select("_h", "_i", "_u", (-F.log(u) / F.col("_w")).alias("_t")).orderBy("_t", "_h", "_i", "_u").limit(n)
    return sorted(tuple(r) for r in least.select("_h", "_i", "_u").collect())


def _quantiles(sample: list[tuple[int, int, int]], parts: int) -> list[tuple[int, int, int]]:
    """Splitters that part a run of equal texts only where they fall into the same run twice."""
    at = [sample[len(sample) * k // parts] for k in range(1, parts)] if len(sample) >= parts else sample
    often = Counter(h for h, _, _ in at)
    return sorted({(h, i, u) if often[h] > 1 else (h, FIRST, FIRST) for h, i, u in at})


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' rows with the columns doc_id, size, text_crc32, law, shard, slot, grown_shard in place of their own.

    Law `bytes`: records in key order are cut where shards * (bytes before the record, or before its group) / (all bytes)
    crosses an integer, so each shard's bytes differ from the mean by less than one record's or small group's size. Null text counts as empty (size 1, crc of the
    empty string) and differs from no empty text. Null ids sort before all others; repeated rows each get a slot. An
    empty table gives no rows. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("_h"), F.coalesce(F.col(id_col).cast("long"), F.lit(FIRST)).alias("_i"),
        F.monotonically_increasing_id().alias("_u"),
    )
    base = cut(base)  # written once, so the numbers of rows hold; they only part rows that are alike in text and id
    rows, total = base.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    # the mean size is added to each weight, so that neither bytes nor rows of a range run far beyond the mean
    keys = base.withColumn("_w", F.col("size") + F.lit(total / max(rows, 1)))
    ranges = min(MOST_RANGES, max(RANGES, math.ceil(rows / RANGE_ROWS)))
    cuts = _quantiles(_drawn(keys, ranges * DRAWN, 0), ranges)
    for seed in itertools.count(1):
        sums = keys.groupBy(_splitter_index(cuts).alias("_r")).agg(F.sum("_w").alias("w"), F.count("*").alias("n")).where(F.col("n") > 1)
        over = sums.where(F.col("w") > OVERFULL * 2 * total / ranges).select("_r", "w").collect()  # a row a range at most
        if not over:
            break
        inside = keys.withColumn("_r", _splitter_index(cuts)).where(F.col("_r").isin([r[0] for r in over]))
        parts = sum(math.ceil(r[1] * ranges / (2 * total)) for r in over)
        more = sorted({*cuts, *_quantiles(_drawn(inside, parts * DRAWN, seed), parts)})
        if len(more) == len(cuts):  # what is left is a record of its own size beside small ones
            break
        cuts = more
    placed = base.withColumn("_r", _splitter_index(cuts))
    sums = placed.groupBy("_r").agg(F.sum("size").alias("b")).select("_r", F.coalesce(F.sum("b").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    order = Window.partitionBy("_r").orderBy("_h", "_i", "_u")
    start = F.col("_before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    alike = Window.partitionBy("_r", "_h", "text_crc32")
    placed = placed.join(F.broadcast(sums), "_r").withColumn("_start", start)
    placed = placed.withColumn("_start", F.when(F.sum("size").over(alike) * (shards * WHOLE) <= total, F.min("_start").over(alike)).otherwise(F.col("_start")))
    placed = placed.withColumn("shard", F.least(F.floor(F.col("_start") * shards / F.lit(max(total, 1))), F.lit(shards - 1)).cast("int"))
    placed = cut(placed.withColumn("_n", F.row_number().over(Window.partitionBy("_r", "shard").orderBy("_h", "_i", "_u"))).drop("_before", "_start"))
    counts = placed.groupBy("shard", "_r").agg(F.count("*").alias("n"))
    first = counts.select("shard", "_r", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"))
    return placed.join(F.broadcast(first), ["shard", "_r"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_first") + F.col("_n") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"))

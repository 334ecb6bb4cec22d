"""Byte-level BPE encoding by overlapping chunks, and decoding.

A long text is cut into chunks that overlap. Each chunk is pre-tokenised from its own start, in parallel; where the chain of
one chunk and that of the next have a boundary in common within their overlap, they run alike from there on (the pattern
never looks back), so the text can be parted there. The parts between such places are encoded in parallel and their ids laid
end to end. If two chunks never meet, the rest of that text is one part. Texts of up to a chunk are encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, small_batches, table

#: Characters of a chunk, and by how many it runs into the next.
CHUNK, OVERLAP = 32_768, 512
#: How far beyond a boundary the pattern may look; boundaries nearer to a chunk's end are not used.
AHEAD = 4
#: Bytes of an Arrow batch of texts or ids at most, unless a row alone has more.
BATCH_BYTES = 1 << 22
RANKS = "byte_bpe_multi_50k.tiktoken"


def _ranks(vocab: dict) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocab["ranks"].splitlines())}


def token_bytes(vocab: dict) -> list[bytes]:
    """The bytes of each id; made once a worker and kept in the broadcast value. Workers that decode need no more."""
    if "raw" not in vocab:
        ranks = _ranks(vocab)
        raw = [b""] * (max(ranks.values()) + 1)
        for k, v in ranks.items():
            raw[v] = k
        vocab["raw"] = raw
    return vocab["raw"]


def built(vocab: dict) -> tuple[tiktoken.Encoding, regex.Pattern]:
    """The tokenizer and the pattern; made once a worker and kept in the broadcast value."""
    if "built" not in vocab:
        vocab["built"] = tiktoken.Encoding("ranks", pat_str=vocab["pattern"], mergeable_ranks=_ranks(vocab), special_tokens={}), regex.compile(vocab["pattern"])
    return vocab["built"]


def vocabulary(spark: SparkSession, path: str, pattern: str) -> Broadcast:
    """A rank file with its pattern, broadcast once; its size is the file's, whatever the input."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast({"ranks": f.read(), "pattern": pattern})


def _lists(parts: list[np.ndarray], kind: type) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*parts, np.empty(0, kind)]).astype(kind)))


def _encoder(vocab: Broadcast) -> Callable[[Column], Column]:
    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = built(vocab.value)[0]
        for texts in batches:
            yield _lists([enc.encode_to_numpy(t or "", disallowed_special=()) for t in texts.to_pylist()], np.int32)

    return encode


@lru_cache(maxsize=1 << 16)
def settled(c: str) -> bool:
    """Whether the kind of a character (letter, number, space or other) has been the same since Unicode 3.2, so that libraries
    of different ages agree on it."""
    old, new = unicodedata.ucd_3_2_0.category(c), unicodedata.category(c)
    return old != "Cn" and all((old[0] == x) == (new[0] == x) for x in "LNZC")


def _boundaries(vocab: Broadcast, overlap: int) -> Callable[[Column], Column]:
    """Of a chunk, the boundaries within its first `overlap` characters and within its last; only those among settled characters,
    three before and one after (so far a contraction reaches)."""

    @F.arrow_udf("array<int>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pattern = built(vocab.value)[1]
        for texts in batches:
            out = []
            for t in texts.to_pylist():
                at = (m.start() for m in pattern.finditer(t))
                out.append(np.array([p for p in at if (p <= overlap or p >= len(t) - overlap) and 0 < p <= len(t) - AHEAD and all(map(settled, t[max(0, p - 3) : p + 1]))], dtype=np.int32))
            yield _lists(out, np.int32)

    return found


def encode(docs: DataFrame, vocab: Broadcast, text_col: str = "text", out: str = "ids", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """docs with the column `out`: the ids of the whole text, as the tokenizer gives them without special tokens.

    Null text gives no ids, as empty text does. Other columns are kept as they are; a column named `out` is replaced.
    """
    small_batches(docs.sparkSession, size=BATCH_BYTES)
    run = _encoder(vocab)
    docs = docs.drop(out)
    is_long = F.coalesce(F.length(text_col) > chunk, F.lit(False))
    short = docs.where(~is_long).withColumn(out, run(F.col(text_col)))
    row = f"_row_{out}"
    long = cut(docs.where(is_long).withColumn(row, F.monotonically_increasing_id()))  # written once, so the ids of rows hold
    text = F.col(text_col)
    chunks = long.select(row, text.alias("t"), F.explode(F.sequence(F.lit(0), F.floor((F.length(text) - 1) / chunk).cast("int"))).alias("no"))
    chunks = chunks.select(row, "no", F.substring("t", F.col("no") * chunk + 1, F.lit(chunk + overlap)).alias("t")).repartition(row, "no")
    at = chunks.withColumn("at", _boundaries(vocab, overlap)("t")).select(row, "no", F.transform("at", lambda p: p + F.col("no") * chunk).alias("at"))
    order = Window.partitionBy(row).orderBy("no")
    begin = (F.col("no") + 1) * chunk
    meet = F.array_min(F.filter(F.array_intersect("at", F.lead("at").over(order)), lambda p: p >= begin))
    met = at.withColumn("last", F.lead("no").over(order).isNull()).withColumn("meet", meet).where(~F.col("last"))
    met = met.withColumn("sound", F.min(F.col("meet").isNotNull()).over(order)).where("sound")
    starts = met.groupBy(row).agg(F.sort_array(F.collect_list("meet")).alias("starts"))
    parts = long.select(row, text.alias("t")).join(starts, row, "left").withColumn("starts", F.concat(F.array(F.lit(0)), F.coalesce("starts", F.array().cast("array<int>"))))
    parts = parts.select(row, "t", "starts", F.posexplode("starts").alias("no", "p"))
    parts = parts.select(row, "no", F.substring("t", F.col("p") + 1, F.coalesce(F.get("starts", F.col("no") + 1), F.length("t")) - F.col("p")).alias("t")).repartition(row, "no")
    ids = parts.withColumn("i", run(F.col("t"))).groupBy(row).agg(F.sort_array(F.collect_list(F.struct("no", "i"))).alias("p")).select(row, F.flatten("p.i").alias(out))
    return short.unionByName(long.join(ids, row).drop(row))


def _decoded(ids: pa.ListArray, raw: list[bytes]) -> Iterator[tuple[list[int] | None, bytes | None]]:
    """The ids of each row and their bytes, one row at a time: numbers of Python take nine times the room of a batch's."""
    for x in ids:
        own = x.values.to_numpy(zero_copy_only=False).tolist() if x.is_valid else None
        yield own, None if own is None else b"".join(map(raw.__getitem__, own))


def decode(rows: DataFrame, vocab: Broadcast, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """rows with the column `out`: the raw bytes of the ids, laid end to end (null for null ids). An id out of the vocabulary raises."""
    small_batches(rows.sparkSession, size=BATCH_BYTES)

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        raw = token_bytes(vocab.value)
        for ids in batches:
            yield pa.array([got for _, got in _decoded(ids, raw)], pa.binary())

    return rows.withColumn(out, run(F.col(ids_col)))


def hashes(rows: DataFrame, vocab: Broadcast, ids_col: str = "ids", out: str = "hashes") -> DataFrame:
    """rows with the column `out`: ids, the SHA-256 of the ids in decimal joined by commas, and decoded, that of their bytes as
    `decode` gives them (null for null ids). They are made where the ids are decoded: neither text travels."""
    small_batches(rows.sparkSession, size=BATCH_BYTES)

    @F.arrow_udf("struct<ids: string, decoded: string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        raw = token_bytes(vocab.value)
        kind = pa.struct([("ids", pa.string()), ("decoded", pa.string())])
        for ids in batches:
            yield pa.array([None if own is None else {"ids": hashlib.sha256(",".join(map(str, own)).encode()).hexdigest(), "decoded": hashlib.sha256(got).hexdigest()} for own, got in _decoded(ids, raw)], kind)

    return rows.withColumn(out, run(F.col(ids_col)))


def digests(docs: DataFrame, vocab: Broadcast) -> DataFrame:
    coded = hashes(encode(docs.select("doc_id", "text"), vocab).drop("text"), vocab)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.col("hashes.ids").alias("ids_sha256"), F.col("hashes.decoded").alias("decoded_sha256"))


def default_vocabulary(spark: SparkSession) -> Broadcast:
    import public_tokenizers

    return vocabulary(spark, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), default_vocabulary(spark))

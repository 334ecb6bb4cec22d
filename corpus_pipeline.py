"""A corpus pipeline: language ID, near-dedup, secret redaction, mixing, tokenisation.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame; all but the last return the
columns of documents (doc_id, text, lang, source, n_chars, in the order they came, with any others kept).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bpe, langid, mixing, neardup, secrets
from weftline.llm.shared import cut

#: Share of the remaining tokens that the mix takes; each document is used once at most.
MIX_SHARE = 0.7


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """lang becomes the predicted language. Documents go whose language is `und` (no text, no letter, or nothing learned) or
    whose code length under the best language shows no language at all (langid.REJECT_BITS)."""
    judged = langid.predicted(docs, langid.trained(docs))
    kept = judged.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("bits_per_byte") <= langid.REJECT_BITS))
    return kept.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one of least doc_id. Rows without an id all stay; of rows that
    share an id one stays (that of the least hash of its columns, maps and variants left out)."""
    plain = [f.name for f in docs.schema if not re.search("map<|variant", f.dataType.simpleString())]
    kept = neardup.near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    rest = docs.join(kept, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*plain)).alias("_row"))
    return rest.select("_row.*").unionByName(docs.where("doc_id is null"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark; every document stays. n_chars follows the text."""
    out = secrets.redacted(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else out.select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that fill the token budget of the domain-language-source tree, each once."""
    picked = mixing.mix(docs, share=MIX_SHARE, epochs=1).select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(picked, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens and digests of the ids and of the decoded bytes."""
    vocab = bpe.default_vocabulary(spark)
    coded = bpe.decode(bpe.encode(docs.select("doc_id", "lang", "source", "text"), vocab).drop("text"), vocab)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary")
    return coded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("mixing", mixing_stage), ("tokenise", tokenise)]
#: Language models and near-duplicate components are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

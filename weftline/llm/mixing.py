"""Mixing sources to target weights by hierarchical budgeting.

A tree of domains, languages and sources shares out a token budget. Each node's share goes by weight, but no node gets more
than its leaves hold over all epochs; what a node can't take is shared among its siblings by weight first, and only what the
siblings can't take either is missing at the parent. That is water filling level by level: a level L with
sum(min(weight * L, capacity)) = budget, found in closed form from running sums over the siblings in order of
capacity / weight. Each leaf then takes whole epochs and a prefix of one more, in that epoch's seeded order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, table

#: Share of the tokens of all documents that the mix takes, and epochs that a document may be used.
SHARE, EPOCHS, SEED = 0.6, 2, "mix-1"
DOMAIN_WEIGHTS = {"web": 5.0, "books": 3.0, "code": 2.0}
LANG_WEIGHTS = {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 2.0}
#: Documents of a leaf that meet in one task, on average.
BUCKET_ROWS = 512


def source_domain(source: Column) -> Column:
    """The domain of a source of the test tables: src0-src9 web, those that end in 1 after that code, all others books."""
    return F.when(source.rlike("^src[0-9]$"), "web").when(source.rlike("^src[0-9]+1$"), "code").otherwise("books")


def words(text: Column) -> Column:
    """Tokens of a text as its runs of characters other than ASCII space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _weight(col: Column, weights: dict[str, float] | None) -> Column:
    if not weights:
        return F.lit(1.0)
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.coalesce(col, F.lit("\0"))), F.lit(1.0))


def _filled(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """nodes (parent's columns, name, cap, w, budget of the parent) with `got`: the node's budget by water filling."""
    ratio = F.col("cap") / F.col("w")
    order = Window.partitionBy(*parent).orderBy("_r", name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    out = nodes.withColumn("_r", ratio)
    out = out.withColumn("_full", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("_w", F.sum("w").over(rest))
    out = out.withColumn("_l", (F.col("budget") - F.col("_full")) / F.col("_w"))
    # the first node (by ratio) that the level doesn't fill gives the level; below it all are full
    level = F.max(F.when(F.col("_l") <= F.col("_r"), F.col("_l"))).over(Window.partitionBy(*parent))
    out = out.withColumn("_level", level).withColumn("got", F.when(F.col("_level").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("w") * F.col("_level"), F.col("cap"))))
    return out.drop("_r", "_full", "_w", "_l", "_level")


def budgets(leaves: DataFrame, share: float, epochs: int, domain_weights: dict | None, lang_weights: dict | None, source_weights: dict | None) -> DataFrame:
    """leaves (domain, lang, source, tokens) with quota: the whole tokens each is to give."""
    cap = (F.col("tokens") * epochs).alias("cap")
    domains = leaves.groupBy("domain").agg((F.sum("tokens") * epochs).alias("cap"), F.sum("tokens").alias("t"))
    domains = domains.withColumn("all", F.lit(0)).withColumn("w", _weight(F.col("domain"), domain_weights)).withColumn("budget", F.floor(F.sum("t").over(Window.partitionBy("all")) * F.lit(share)))
    domains = _filled(domains, ["all"], "domain").select("domain", F.col("got").alias("budget"))
    langs = leaves.groupBy("domain", "lang").agg((F.sum("tokens") * epochs).alias("cap")).join(domains, "domain").withColumn("w", _weight(F.col("lang"), lang_weights))
    langs = _filled(langs, ["domain"], "lang").select("domain", "lang", F.col("got").alias("budget"))
    out = leaves.withColumn("cap", cap).join(langs, ["domain", "lang"]).withColumn("w", _weight(F.col("source"), source_weights))
    return _filled(out, ["domain", "lang"], "source").withColumn("quota", F.floor(F.col("got") + 1e-6)).select("domain", "lang", "source", "tokens", "n", "quota")


def mix(
    docs: DataFrame, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED, domain_weights: dict | None = DOMAIN_WEIGHTS, lang_weights: dict | None = LANG_WEIGHTS, source_weights: dict | None = None,
    domain: Column | None = None, tokens: Column | None = None, id_col: str = "doc_id",
) -> DataFrame:
    """(id, domain, lang, source, n_tokens, copies) of the documents that the mix uses, copies times each.

    Null language or source is the node '' of its parent; a weight not named is 1. Whole documents are taken while the
    running sum in the epoch's order stays within the quota (so a leaf gives its quota less part of one document at most);
    documents without tokens are taken while the prefix runs. Null ids order as ''; rows that share an id are ordered by
    their tokens, repeats alike. An empty table gives no rows. Other columns are not read.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (source_domain(blank("source")) if domain is None else domain).alias("domain"), blank("lang").alias("lang"), blank("source").alias("source"), (words(F.col("text")) if tokens is None else tokens).alias("n_tokens"))
    rows = cut(rows)
    leaf = ["domain", "lang", "source"]
    leaves = budgets(rows.groupBy(*leaf).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n")), share, epochs, domain_weights, lang_weights, source_weights)
    leaves = leaves.select(*leaf, F.when(F.col("tokens") > 0, F.least(F.floor(F.col("quota") / F.when(F.col("tokens") > 0, F.col("tokens"))), F.lit(epochs))).otherwise(0).alias("full"), "quota", "tokens", F.greatest(F.lit(1), F.ceil(F.col("n") / BUCKET_ROWS)).alias("nb"))
    leaves = cut(leaves)
    placed = rows.join(leaves, leaf)
    luck = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("full").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")), 1, 8), 16, 10).cast("long")
    # the epoch's order is cut into buckets of even width; sums of whole buckets place each bucket, running sums the documents
    placed = placed.withColumn("luck", luck).withColumn("b", F.floor(F.col("luck") * F.col("nb") / F.lit(2**32)))
    sums = placed.groupBy(*leaf, "b").agg(F.sum("n_tokens").alias("s"))
    ahead = sums.withColumn("ahead", F.coalesce(F.sum("s").over(Window.partitionBy(*leaf).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("s")
    order = Window.partitionBy(*leaf, "b").orderBy("luck", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.join(ahead, [*leaf, "b"]).withColumn("upto", F.col("ahead") + F.sum("n_tokens").over(order))
    extra = ((F.col("full") < epochs) & (F.col("upto") <= F.col("quota") - F.col("full") * F.col("tokens"))).cast("long")
    return placed.withColumn("copies", F.col("full").cast("long") + extra).where("copies > 0").select("doc_id", *leaf, "n_tokens", "copies")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def _sql_weights(col: str, weights: dict[str, float]) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1.0 END"


def _sql_filled(rows: str, parent: str, name: str) -> str:
    return f"""
 SELECT *, CASE WHEN lev IS NULL THEN CAST(cap AS DOUBLE) ELSE least(w * lev, cap) END AS got FROM (
  SELECT *, max(CASE WHEN l <= r THEN l END) OVER (PARTITION BY {parent}) AS lev FROM (
   SELECT *, (budget - ful) / ws AS l FROM (
    SELECT *, coalesce(sum(cap) OVER (PARTITION BY {parent} ORDER BY r, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ful,
     sum(w) OVER (PARTITION BY {parent} ORDER BY r, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws
    FROM (SELECT *, cap / w AS r FROM ({rows})))))"""


OP9_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  CASE WHEN regexp_full_match(coalesce(source, ''), 'src[0-9]') THEN 'web' WHEN regexp_full_match(coalesce(source, ''), 'src[0-9]+1') THEN 'code' ELSE 'books' END AS domain,
  CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS n_tokens FROM documents),
lf AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS DOUBLE) AS t FROM d GROUP BY ALL),
dm AS ({_sql_filled(f"SELECT domain, {EPOCHS} * sum(t) AS cap, CAST({_sql_weights('domain', DOMAIN_WEIGHTS)} AS DOUBLE) AS w, floor((SELECT sum(t) FROM lf) * CAST({SHARE} AS DOUBLE)) AS budget FROM lf GROUP BY domain", "1", "domain")}),
lg AS ({_sql_filled(f"SELECT lf.domain, lf.lang, {EPOCHS} * sum(t) AS cap, CAST({_sql_weights('lf.lang', LANG_WEIGHTS)} AS DOUBLE) AS w, any_value(dm.got) AS budget FROM lf JOIN dm ON lf.domain = dm.domain GROUP BY lf.domain, lf.lang", "domain", "lang")}),
sr AS ({_sql_filled(f"SELECT lf.domain, lf.lang, lf.source, t, {EPOCHS} * t AS cap, CAST(1 AS DOUBLE) AS w, lg.got AS budget FROM lf JOIN lg ON lf.domain = lg.domain AND lf.lang = lg.lang", "domain, lang", "source")}),
q AS (SELECT domain, lang, source, t, floor(got + CAST(1e-6 AS DOUBLE)) AS quota,
  CASE WHEN t > 0 THEN least(floor(floor(got + CAST(1e-6 AS DOUBLE)) / t), {EPOCHS}) ELSE 0 END AS ful FROM sr),
p AS (SELECT d.*, t, quota, CAST(ful AS BIGINT) AS ful, substr(md5(concat('{SEED}:', CAST(ful AS BIGINT), ':', coalesce(CAST(doc_id AS VARCHAR), ''))), 1, 8) AS luck
  FROM d JOIN q ON d.domain = q.domain AND d.lang = q.lang AND d.source = q.source),
s AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY luck, doc_id NULLS FIRST, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM p)
SELECT doc_id, domain, lang, source, n_tokens, copies FROM (
  SELECT *, CAST(ful + CASE WHEN ful < {EPOCHS} AND upto <= quota - ful * t THEN 1 ELSE 0 END AS BIGINT) AS copies FROM s) WHERE copies > 0
"""

"""Language identification by prediction with partial matching (PPM).

For each language a context tree of up to ORDER bytes is counted on a bounded sample and then frozen. A byte's probability is
its share under the longest context (method C); a byte never seen there costs an escape, and the next shorter context is
asked with the bytes of the longer one excluded, down to equal odds for all 256 bytes. So the code length of a text under a
language is exact. The trees of a few languages together are laid out as sorted arrays of n-grams with a cost for each of them, so
that the model grows with the sample, not with the square of the languages.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import small_batches, table

#: Bytes of context; documents sampled a language, and in all (languages share them evenly; each has one at least).
ORDER, SAMPLE, SAMPLES = 4, 250, 8_000
#: The model is bounded by the sample: at most this many bytes of text are learned from a language, and from all together
#: (shared evenly; a language's first text is learned in any case).
SAMPLE_BYTES, ALL_BYTES = 1_500_000, 12_000_000
#: Languages whose trees are laid out together.
TOGETHER = 8
#: Longer texts teach from a piece of at most so many bytes (they are judged whole all the same).
TAUGHT_BYTES = 50_000
UNKNOWN = "und"
#: Bits a byte that a document must stay under to be kept: plain bytes cost 8.
REJECT_BITS = 7.5


def _windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of the texts in turn, a number of its ORDER bytes of context and itself (the last byte lowest), and
    where each text begins and ends. Before a text stand zero bytes."""
    pad = bytes(ORDER)
    a = np.frombuffer(pad + pad.join(texts) + pad, dtype=np.uint8)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.concatenate([[0], np.cumsum(lengths)])
    at = np.arange(ends[-1]) + np.repeat(ORDER * (np.arange(len(texts)) + 1), lengths)
    w = np.zeros(len(at), dtype=np.int64)
    for k in range(ORDER, -1, -1):
        w = (w << 8) | a[at - k]
    return w, ends


def folded(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass")


class Trees:
    """keys[k]: sorted n-grams of k bytes of context and one more; costs[k]: their bits by language. contexts[k] and
    escapes[k]: sorted contexts of k bytes seen in some language, and what falling through them costs in bits by language."""

    def __init__(self, langs: list[str]):
        self.langs, self.keys, self.costs, self.contexts, self.escapes = langs, [], [], [], []

    def bits(self, w: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Costs in bits of each window's last byte, by language."""
        if order < 0:
            return np.full((len(w), len(self.langs)), 8.0)
        low = w & ((1 << (8 * (order + 1))) - 1)
        keys = self.keys[order]
        at = np.minimum(np.searchsorted(keys, low), max(len(keys) - 1, 0))
        hit = keys[at] == low if len(keys) else np.zeros(len(w), dtype=bool)
        out = np.empty((len(w), len(self.langs)))
        out[hit] = self.costs[order][at[hit]]
        miss = np.nonzero(~hit)[0]
        if len(miss):
            out[miss] = self.bits(w[miss], order - 1) + self._escape(low[miss] >> 8, order)
        return out

    def _escape(self, context: np.ndarray, order: int) -> np.ndarray:
        keys = self.contexts[order]
        out = np.zeros((len(context), len(self.langs)))
        if len(keys):
            at = np.minimum(np.searchsorted(keys, context), len(keys) - 1)
            hit = keys[at] == context
            out[hit] = self.escapes[order][at[hit]]
        return out


def learned(texts: dict[str, list[str]]) -> Trees:
    langs = sorted(texts)
    trees = Trees(langs)
    seen = []
    for lang in langs:
        raw = np.array([], dtype=np.int64) if not texts[lang] else _windows([folded(t) for t in texts[lang]])[0]
        seen.append(raw)
    for k in range(ORDER + 1):
        mask = (1 << (8 * (k + 1))) - 1
        counted = [np.unique(w & mask, return_counts=True) for w in seen]
        keys = np.unique(np.concatenate([g for g, _ in counted])) if counted else np.empty(0, np.int64)
        contexts = np.unique(keys >> 8)
        costs, escapes = np.empty((len(keys), len(langs))), np.zeros((len(contexts), len(langs)))
        below = trees.bits(keys, k - 1)
        for j, (grams, n) in enumerate(counted):
            at, ctx = np.searchsorted(keys, grams), np.searchsorted(contexts, grams >> 8)
            total = np.bincount(ctx, n, len(contexts))
            kinds = np.bincount(ctx, minlength=len(contexts))
            taken = np.bincount(ctx, 2.0 ** -below[at, j], len(contexts))
            here = kinds > 0
            full = total + kinds
            with np.errstate(divide="ignore"):  # odds of an escape, over what the shorter context leaves when the seen bytes are excluded
                escapes[here, j] = -np.log2(kinds[here] / full[here]) + np.log2(np.maximum(1 - taken[here], 2.0**-40))
            escapes[here & (kinds >= 256), j] = 0
            costs[:, j] = below[:, j] + escapes[np.searchsorted(contexts, keys >> 8), j]
            costs[at, j] = -np.log2(n / full[ctx])
        trees.keys.append(keys), trees.costs.append(costs), trees.contexts.append(contexts), trees.escapes.append(escapes)
    return trees


def forest(texts: dict[str, list[str]]) -> list[Trees]:
    """The trees of all languages, TOGETHER at a time in order of their names."""
    langs = sorted(texts)
    return [learned({k: texts[k] for k in langs[i : i + TOGETHER]}) for i in range(0, len(langs), TOGETHER)]


def remainder(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def sample_texts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", order_by: Column | None = None, each: int = SAMPLE) -> dict[str, list[str]]:
    """Texts by language: those of least luck (a hash), `each` a language or an even share of SAMPLES, one at least; every
    language has some. Up to SAMPLE_BYTES a language or an even share of ALL_BYTES; of texts over TAUGHT_BYTES a piece at a
    place that the luck picks."""
    luck = F.pmod(F.xxhash64(text_col), F.lit(2**40)) if order_by is None else order_by
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), luck.alias("luck")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r.lang: r for r in rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("luck").alias("least")).collect()}
    if not counts:
        return {}
    take = max(1, min(each, SAMPLES // len(counts)))
    # only rows that can be among the first are ranked: six deviations more than are taken, and the first in any case
    drawn = take + 6 * math.sqrt(take) + 12
    limit = [F.lit(x) for k, r in counts.items() if r.n > drawn for x in (k, max(2.0**40 * drawn / r.n, r.least + 1.0))]
    if limit:
        rows = rows.where(F.col("luck") < F.coalesce(F.create_map(*limit)[F.col("lang")], F.lit(2.0**40)))
    chars = TAUGHT_BYTES // 4
    piece = F.substring("text", (F.col("luck") % (F.length("text") - chars + 1) + 1).cast("int"), F.lit(chars))
    rows = rows.withColumn("text", F.when((F.octet_length("text") > TAUGHT_BYTES) & (F.length("text") > chars), piece).otherwise(F.col("text")))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("luck", "text"))).where(F.col("rank") <= take)
    out: dict[str, list[str]] = {}
    room = dict.fromkeys(counts, min(SAMPLE_BYTES, ALL_BYTES // len(counts)))
    for r in ranked.select("lang", "text").toLocalIterator():
        if (n := len(r.text.encode("utf-8", "surrogatepass"))) <= room[r.lang] or r.lang not in out:
            room[r.lang] -= n
            out.setdefault(r.lang, []).append(r.text)
    return out


def predicted(docs: DataFrame, trees: list[Trees], text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score and bits_per_byte (replacing columns so named).

    Null text and text without a letter, and any text where no language was learned, is `und` with score 0 and no bits. Else
    the language of least code length wins (ties: the first by name); score is its share of the odds 2 ** -(bits a byte).
    """
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast([vars(x) for x in trees])  # bounded by the sample
    schema = "struct<lang_pred: string, score: double, bits_per_byte: double>"

    @F.pandas_udf(schema)
    def judge(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = []
        for x in model.value:
            own.append(Trees([]))
            vars(own[-1]).update(x)
        langs = np.array([x for t in own for x in t.langs], dtype=object)
        for texts in series:
            lang, score, rate = np.full(len(texts), UNKNOWN, dtype=object), np.zeros(len(texts)), np.full(len(texts), np.nan)
            use = [i for i, t in enumerate(texts) if t is not None and any(map(str.isalpha, t))] if len(langs) else []
            for part in (use[i : i + 32] for i in range(0, len(use), 32)):
                w, ends = _windows([folded(texts.iloc[i]) for i in part])
                total = np.zeros((len(part), len(langs)))
                for a in range(0, len(w), 1 << 18):
                    doc = np.searchsorted(ends, np.arange(a, min(len(w), a + (1 << 18))), side="right") - 1
                    j = 0
                    for t in own:
                        for costs in t.bits(w[a : a + (1 << 18)]).T:
                            total[:, j] += np.bincount(doc, costs, len(part))
                            j += 1
                total /= np.diff(ends)[:, None]
                best = total.argmin(axis=1)
                lang[part] = langs[best]
                least = total[np.arange(len(part)), best]
                score[part] = 1 / (2.0 ** -(total - least[:, None])).sum(axis=1)
                rate[part] = least
            yield pd.DataFrame({"lang_pred": lang, "score": score, "bits_per_byte": rate})

    # marked so that a filter on the outcome doesn't judge each text a second time
    got = docs.drop("lang_pred", "score", "bits_per_byte").withColumn("_judged", judge.asNondeterministic()(F.col(text_col)))
    return got.select("*", "_judged.*").drop("_judged").withColumn("bits_per_byte", F.nanvl("bits_per_byte", F.lit(None).cast("double")))


def trained(docs: DataFrame) -> list[Trees]:
    """Trees learned from documents with a language whose remainder isn't 2 (documents without an id don't teach)."""
    return forest(sample_texts(docs.where((remainder() != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull()), order_by=F.pmod(F.xxhash64("doc_id", F.lit(77)), F.lit(2**40))))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predicted(docs.select("doc_id", "text"), trained(docs))
    return out.select("doc_id", F.coalesce(remainder() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")

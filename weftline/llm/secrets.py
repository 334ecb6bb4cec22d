"""Secret scans: fixed patterns, and a battery of randomness tests with control of false discoveries.

Beside the patterns' spans, every run of RUN or more characters of the base-64 alphabets is a candidate. Its encoding is the
least alphabet that holds it. The battery asks whether its characters are drawn evenly and freely from that alphabet:
chi-squared uniformity, the runs test (above and below the alphabet's middle) and lag-1 serial correlation, joined by Fisher's
method. What the battery turns down (odds under REJECT) is no secret. Written text that is short passes it at times, so the
rest has to be unlike text as well: the chi-squared statistic, changes of character class and the turns between vowels and
consonants are read against what written text gives, and these p-values go through Benjamini-Hochberg over all documents,
within strata of encoding and length, so that the many short words don't decide about long strings. What the battery turned
down stays in its stratum with p = 1. P-values are counted in bins, so that a stratum is a bounded histogram.

Runs of more than WHOLE characters are tested in windows that overlap by three quarters, each a candidate of its own.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, small_batches, table

KINDS = ("assign", "access", "hex")
ADDED = "random"
_ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
RUN = 20
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}={0,2}" % RUN)
#: Runs of more than WHOLE characters are tested in windows of WINDOW, short enough for a key within to stand out.
WHOLE, WINDOW = 400, 100
#: Share of false discoveries allowed in a stratum, and -log10 p in steps of 1 / STEPS up to MOST.
FALSE, STEPS, MOST = 1e-3, 4, 60
#: Odds at which the battery turns down a string that is random.
REJECT = 1e-4
#: What written text and names do: share of adjacent characters that change class by encoding (names of base 64 have capitals,
#: digits and marks); of adjacent letters that change between vowel and consonant; correlation of hex digits.
_CHANGE, _TURN, _NEAR = {"decimal": 0.08, "hex": 0.08, "HEX": 0.08, "base32": 0.15, "base36": 0.15, "BASE36": 0.15, "base64": 0.3}, 0.62, 0.5
_LETTERS = np.array([8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.1, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.07])
_TEXT = np.concatenate([_LETTERS / _LETTERS.sum() * 0.92, _LETTERS / _LETTERS.sum() * 0.05, np.full(10, 0.002), np.full(4, 0.0025)])
_DIGITS = np.concatenate([np.full(10, 0.03), np.array([0.25, 0.05, 0.09, 0.13, 0.39, 0.07]) / 0.98 * 0.7])
#: Alphabets, least first: each a string of its symbols in order of their values.
ALPHABETS = {
    "decimal": "0123456789", "hex": "0123456789abcdef", "HEX": "0123456789ABCDEF", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "BASE36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
ENCODINGS = tuple(ALPHABETS)
_HEXLIKE = ("decimal", "hex", "HEX")
_SYMBOLS = [set(x) for x in ALPHABETS.values()]
_VALUE = [{c: i for i, c in enumerate(x)} for x in ALPHABETS.values()]
#: The URL-safe pair stands for the two last symbols of base 64.
_URL = str.maketrans("-_", "+/")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, place in KINDS) of the patterns' matches, by start, then kind; code points, end exclusive."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], x[2]))


def encoding(s: str) -> int:
    """The place in ENCODINGS of the least alphabet that holds s (less `=` at its end)."""
    have = set(s.rstrip("=").translate(_URL))
    return next(i for i, x in enumerate(_SYMBOLS) if have <= x)


@lru_cache(maxsize=1 << 16)
def _binomial(n: int, p: float, least: int) -> float:
    """P(X >= least) of n draws."""
    return min(1.0, sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(least, n + 1)))


def _normal(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def uniformity(x: np.ndarray, size: int) -> float:
    """Odds of a chi-squared statistic of the symbols' counts as large as this, or larger, if all `size` symbols are alike
    (the Wilson-Hilferty form of the distribution)."""
    stat, free = size / len(x) * float((np.bincount(x, minlength=size).astype(float) ** 2).sum()) - len(x), size - 1
    z = ((max(stat, 0.0) / free) ** (1 / 3) - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free))
    return _normal(-z)


def runs(x: np.ndarray, size: int) -> float:
    """Two-sided odds of the number of runs above and below the alphabet's middle, given how many symbols lie on each side."""
    high = x * 2 >= size
    n, a = len(x), int(high.sum())
    b = n - a
    if not a or not b:
        return 2.0 ** (1 - n)  # one run: odds of n symbols on one side
    mean = 1 + 2 * a * b / n
    var = (mean - 1) * (mean - 2) / (n - 1)
    off = max(0.0, abs(1 + int((high[1:] != high[:-1]).sum()) - mean) - 0.5)
    return min(1.0, 2 * _normal(-off / math.sqrt(var))) if var > 0 else 1.0


def serial(x: np.ndarray) -> float:
    """Two-sided odds of the lag-1 correlation of the symbols' values; a constant string has the correlation 1."""
    n, y = len(x), x - x.mean()
    r = float((y[1:] * y[:-1]).sum() / (y * y).sum()) if y.any() else 1.0
    return min(1.0, 2 * _normal(-abs(r + 1 / n) * math.sqrt(n)))


def fisher(odds: list[float]) -> float:
    """Fisher's joint odds of three independent p-values (a chi-squared tail of six degrees)."""
    half = -sum(math.log(max(p, 1e-100)) for p in odds)
    return math.exp(-half) * (1 + half + half * half / 2)


def random_odds(s: str) -> float:
    """The battery: odds that a random string of s's encoding and length looks no more even and free than s."""
    kind = encoding(s)
    x = np.array([_VALUE[kind][c] for c in s.rstrip("=").translate(_URL)])
    size = len(_VALUE[kind])
    return fisher([uniformity(x, size), runs(x, size), serial(x)])


def text_odds(s: str) -> float:
    """Odds that written text looks as random as `s` (WHOLE characters at most, which keeps the sums finite)."""
    kind, s = ENCODINGS[encoding(s)], s.rstrip("=")
    hexlike = kind in _HEXLIKE
    n = len(s)
    q = _DIGITS if hexlike else _TEXT / _TEXT.sum()
    code = [int(c, 16) if hexlike else ord(c) for c in s]
    counts = np.unique(code, return_counts=True)[1].astype(float)
    pairs, all_pairs = (counts * (counts - 1)).sum() / 2, n * (n - 1) / 2  # chi-squared is linear in the pairs of equal symbols
    k2, k3 = (q**2).sum(), (q**3).sum()
    sd = math.sqrt(all_pairs * k2 * (1 - k2) + n * (n - 1) * (n - 2) * (k3 - k2 * k2))
    even = _normal((pairs - all_pairs * k2) / sd)
    classes = [0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 for c in s]
    change = _binomial(n - 1, _CHANGE[kind], sum(a != b for a, b in zip(classes, classes[1:])))
    if hexlike:
        x = np.array(code, dtype=float)
        r = float(np.corrcoef(x[:-1], x[1:])[0, 1]) if x[:-1].std() and x[1:].std() else 1.0
        turn = _normal((r - _NEAR) * math.sqrt(n - 1))
    else:
        letters = [(a.lower() in "aeiouy", b.lower() in "aeiouy") for a, b in zip(s, s[1:]) if a.isalpha() and b.isalpha()]
        turns = sum(a != b for a, b in letters)
        turn = _binomial(len(letters), 1 - _TURN, len(letters) - turns)
    return fisher([max(p, 1e-40) for p in (even, change, turn)])


def odds(s: str, window: bool = False) -> float:
    """The p-value that goes into the control of false discoveries: 1 for what the battery turns down. A window may end within
    a random string: it stands if either of its halves does."""
    half = len(s) // 2
    return text_odds(s) if any(random_odds(x) >= REJECT for x in ((s, s[:half], s[half:]) if window else (s,))) else 1.0


def stratum(s: str) -> int:
    """Encoding and length class (each half as long again as the one before) in one number."""
    return encoding(s) * 100 + min(99, int(math.log(len(s) / RUN, 1.5)))


def windows(start: int, end: int) -> Iterator[tuple[int, int]]:
    """The run itself, or windows of at most WINDOW characters that cover it, each overlapping the next by three quarters of WINDOW."""
    if end - start > WHOLE:
        while end - start > WINDOW:
            yield start, start + WINDOW
            start += WINDOW // 4
    yield start, end


def pieces(start: int, end: int, taken: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """What the spans (by start) leave of start to end."""
    for a, b, _ in taken:
        if start < b and a < end:
            if start < a:
                yield start, a
            start = b
    if start < end:
        yield start, end


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(start, end, stratum, bin of -log10 p) of the windows of what base spans leave of the runs, in pieces of RUN or more."""
    out = []
    for m in _RUN.finditer(text):
        for start, end in pieces(m.start(), m.end(), taken):
            if len(text[start:end].rstrip("=")) < RUN:
                continue
            for a, b in windows(start, end):
                p = odds(text[a:b], window=(a, b) != (start, end))
                out.append((a, b, stratum(text[a:b]), min(MOST * STEPS, int(-math.log10(max(p, 1e-300)) * STEPS))))
    return out


_FOUND = "struct<base: array<struct<kind: int, start: int, end: int>>, cand: array<struct<start: int, end: int, stratum: int, bin: int>>>"


def _scanned(text: Column) -> Column:
    """Base spans and candidates of each text."""

    @F.pandas_udf(_FOUND)
    def scan(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in series:
            base, cand = [], []
            for t in texts:
                found = base_spans(t or "")
                base.append([{"kind": k, "start": a, "end": b} for a, b, k in found])
                cand.append([dict(zip(("start", "end", "stratum", "bin"), c)) for c in candidates(t or "", found)])
            yield pd.DataFrame({"base": base, "cand": cand})

    return scan(text)


def cutoffs(cand: DataFrame, false: float = FALSE) -> dict[int, int]:
    """Of (stratum, bin) rows: for each stratum with discoveries the least bin that is one (Benjamini-Hochberg on the bins' upper ends)."""
    counts = cand.groupBy("stratum", "bin").agg(F.count("*").alias("n")).collect()  # strata and bins are few, whatever the input
    out = {}
    for s in {r.stratum for r in counts}:
        bins = sorted(((r.bin, r.n) for r in counts if r.stratum == s), reverse=True)
        total, upto = sum(n for _, n in bins), 0
        for b, n in bins:
            upto += n
            if 10.0 ** (-b / STEPS) * total <= false * upto:
                out[s] = b
    return out


def _joined(cand: Column) -> Column:
    """Candidates (by start) with those that overlap made one (start, end): windows of one run; runs never overlap."""
    head = lambda c: F.filter(c, lambda x, i: F.coalesce(F.get(c, i - 1)["end"] <= x["start"], F.lit(True)))
    tail = lambda c: F.filter(c, lambda x, i: F.coalesce(x["end"] <= F.get(c, i + 1)["start"], F.lit(True)))
    both = lambda c: F.zip_with(head(c), tail(c), lambda x, y: F.struct(x["start"].alias("start"), y["end"].alias("end")))
    return F.get(F.transform(F.array(cand), both), F.lit(0))  # bound to a name, so that it is worked out once


def _spans(base: Column, cand: Column, cut: dict[int, int]) -> Column:
    named = F.transform(base, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("at"), x["end"].alias("end")))
    if not cut:
        return F.sort_array(named)
    least = F.create_map(*[F.lit(x) for kv in cut.items() for x in kv])
    added = _joined(F.filter(cand, lambda c: F.coalesce(c["bin"] >= F.element_at(least, c["stratum"]), F.lit(False))))
    return F.sort_array(F.concat(named, F.transform(added, lambda c: F.struct(c["start"].alias("start"), F.lit(len(KINDS)).alias("at"), c["end"].alias("end")))))


def secret_spans(docs: DataFrame, text_col: str = "text", out: str = "spans", false: float = FALSE, keep_text: bool = True) -> DataFrame:
    """docs with `out`: array of (start, at, end) by start, then `at` (the place in KINDS; 3 for what the battery adds).

    Offsets are code points, ends exclusive. Null and empty texts have no spans. Each text is scanned once: what was found is
    written, the histogram of p-values over all documents is taken from it, and then its cutoffs apply. Without keep_text the
    text goes, and only what was found is written. A column named `out` is replaced, others are kept.
    """
    small_batches(docs.sparkSession)
    found = docs.drop(*{out} - {text_col}).withColumn("_found", _scanned(F.col(text_col)))
    found = cut(found if keep_text else found.drop(text_col))
    cand = found.select(F.explode("_found.cand").alias("c")).select("c.stratum", "c.bin")
    return found.withColumn(out, _spans(F.col("_found.base"), F.col("_found.cand"), cutoffs(cand, false))).drop("_found")


def _told(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, (*KINDS, ADDED)))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["at"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", false: float = FALSE) -> DataFrame:
    """docs with each stretch of its text that spans cover replaced by `mark`; rows, null texts and other columns stay."""

    @F.pandas_udf("string")
    def masked(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, found in zip(texts, spans):
            if t is not None and len(found):
                parts, at, end = [], 0, 0
                for x in found:
                    if x["start"] >= end:
                        parts += [t[at : x["start"]], mark]
                    at = end = max(end, x["end"])
                t = "".join(parts) + t[at:]
            out.append(t)
        return pd.Series(out, dtype=object)

    found = secret_spans(docs, text_col, "_spans", false)
    return found.withColumn(text_col, F.when(F.size("_spans") > 0, masked(F.col(text_col), F.col("_spans"))).otherwise(F.col(text_col))).drop("_spans")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    base = F.filter("spans", lambda x: x["at"] < len(KINDS))
    count = lambda k: F.size(F.filter("spans", lambda x: x["at"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", count(0), count(1), count(2), F.sha2(_told(base).cast("binary"), 256).alias("base_sha256"), _told(F.col("spans")).alias("spans"))

"""License scans by patience alignment.

A text and a template are aligned on the words that occur exactly once in both: the longest increasing subsequence of their
places keeps the anchors in order, runs of equal words grow around them, and each gap between anchors is aligned in the same
way (words that are unique within the gap anchor it). Coverage is the share of the template's words that the alignment meets.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import small_batches, table

#: Notices, grants and disclaimers by name, fixed values: all are public licence wordings.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "mit-warranty": "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.",
    "bsd-warranty": "This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage.",
    "isc-warranty": "The software is provided \"as is\" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. In no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "bsl-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
}
#: Least coverage of a template, and the most text words that an alignment may span for each template word.
COVERAGE, STRETCH = 0.8, 3
_WORD = re.compile(r"[a-z0-9]+(?:[.\-'][a-z0-9]+)*")


def tokens(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Words of the text in small letters, punctuation at their ends dropped, and their places (code points, end exclusive).

    Only A-Z are folded, so places in the folded text are places in the text itself.
    """
    low = text.translate(_FOLD)
    found = list(_WORD.finditer(low))
    return [m[0] for m in found], [m.span() for m in found]


_FOLD = {c: c + 32 for c in range(65, 91)}


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs (sorted by the first place) whose second places rise; patience sorting."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tops, b)
        back[i] = at[k - 1] if k else -1
        tops[k:k + 1], at[k:k + 1] = [b], [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def aligned(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matching places of the word lists, rising in both: equal ends first, then unique common words, then the gaps between."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, ie, j, je = todo.pop()
        while i < ie and j < je and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < ie and j < je and a[ie - 1] == b[je - 1]:
            ie, je = ie - 1, je - 1
            out.append((ie, je))
        if i == ie or j == je:
            continue
        ca, cb = Counter(a[i:ie]), Counter(b[j:je])
        place = {w: k for k, w in enumerate(b[j:je], j) if cb[w] == 1}
        anchors = rising([(k, place[w]) for k, w in enumerate(a[i:ie], i) if ca[w] == 1 and w in place])
        if not anchors:
            continue
        out += anchors
        ends = [(i - 1, j - 1), *anchors, (ie, je)]
        todo += [(p + 1, q, r + 1, s) for (p, r), (q, s) in zip(ends, ends[1:])]
    return sorted(out)


def tight(m: list[tuple[int, int]], need: int) -> list[tuple[int, int]]:
    """An alignment without words at its ends that lie far off: those are left out between which and the rest there are more other
    words than they are themselves (a stray word, or words of the copy before), while `need` words stay."""
    for way in (1, -1):
        m = m[::way]
        at = range(max(0, len(m) - need) + 1)
        m = m[max(at, key=lambda a: (abs(m[a][0] - m[0][0]) - 2 * a, -a)) :][::way] if m else m
    return m


def needed(template: list[str], coverage: float) -> int:
    """The fewest words of the template that make up the coverage (4 of 5 at 0.8, whatever the rounding of the product)."""
    return math.ceil(coverage * len(template) - 1e-9)


def rarest(templates: dict[str, list[str]], coverage: float) -> dict[str, set[str]]:
    """Each template's rarest words among all templates, so many that any match at the wanted coverage holds one of them."""
    often = Counter(w for v in templates.values() for w in set(v))
    out = {}
    for k, v in templates.items():
        ranked = sorted(set(v), key=lambda w: (often[w], -len(w), w))
        n, left, counts = 0, len(v) - needed(v, coverage), Counter(v)
        while n < len(ranked) and left >= 0:
            left -= counts[ranked[n]]
            n += 1
        out[k] = set(ranked[:n])
    return out


def _stretches(words: list[str], template: list[str], rare: set[str]) -> Iterator[tuple[int, int]]:
    """Parts of the text that can hold the template: around places of its rare words, as far as STRETCH templates reach."""
    reach = STRETCH * len(template)
    begin = end = None
    for k, w in enumerate(words):
        if w in rare:
            if begin is None or k - reach > end:
                if begin is not None:
                    yield begin, end
                begin = max(0, k - reach)
            end = min(len(words), k + reach)
    if begin is not None:
        yield begin, end


def _around(words: list[str], template: list[str], k: int, j: int, lo: int, hi: int) -> list[tuple[int, int]]:
    """The alignment of words[lo:hi] and the template in which place k meets the template's place j."""
    left = aligned(words[lo:k], template[:j])
    right = aligned(words[k + 1 : hi], template[j + 1 :])
    return [*((lo + x, y) for x, y in left), (k, j), *((k + 1 + x, j + 1 + y) for x, y in right)]


def _copies(words: list[str], begin: int, end: int, template: list[str], rare: set[str], need: int) -> Iterator[list[tuple[int, int]]]:
    """Alignments of the copies in a stretch, from left to right. Each place of a rare word (or of the first word) is met with
    its own places in the template, and what lies on both sides is aligned as far as the word's repeats: a copy holds no more
    of them than the template. Of the alignments that share a copy the fullest stays, then the shortest."""
    reach, counts = STRETCH * len(template), Counter(template)
    offsets: dict[str, list[int]] = {w: [] for w in (*rare, template[0])}
    for j, w in enumerate(template):
        if w in offsets:
            offsets[w].append(j)
    at = [k for k in range(begin, end) if words[k] in offsets]
    of: dict[str, list[int]] = {w: [] for w in offsets}
    nth = {}
    for k in at:
        nth[k] = len(of[words[k]])
        of[words[k]].append(k)

    def best(k: int, free: int) -> list[tuple[int, int]]:
        lo, hi = max(free, k - reach), min(end, k + reach)
        if sum(min(n, counts[w]) for w, n in Counter(words[lo:hi]).items() if w in counts) < need:
            return []
        own, js, found = of[words[k]], offsets[words[k]], []
        for i, j in enumerate(js):
            before, after = nth[k] - i - 1, nth[k] + len(js) - i
            near = max(lo, own[before] + 1) if before >= 0 else lo, min(hi, own[after]) if after < len(own) else hi
            found += [_around(words, template, k, j, *x) for x in {near, (lo, hi)}]
        found = [tight(m, need) for m in found if len(m) >= need and m[-1][0] - m[0][0] < reach]
        return max((m for m in found if m[0][0] <= k <= m[-1][0]), key=_rank, default=[])

    free, i = begin, 0
    while i < len(at):
        m = best(at[i], free) if at[i] >= free else []
        if m:
            first, last = at[i], m[-1][0]
            for k in at[i + 1 : bisect_left(at, last + 1)]:
                if (other := best(k, free)) and other[0][0] <= first:
                    m = max(m, other, key=_rank)
            yield m
            free = m[-1][0] + 1
        i += 1


def common(words: list[str], template: list[str]) -> int:
    """The length of the longest common subsequence, which no alignment exceeds; a bit for each word of the template."""
    bits: dict[str, int] = {}
    for k, w in enumerate(template):
        bits[w] = bits.get(w, 0) | 1 << k
    whole = (1 << len(template)) - 1
    free = whole
    for w in words:
        if u := free & bits.get(w, 0):
            free = (free + u | free - u) & whole
    return len(template) - free.bit_count()


def _windows(words: list[str], begin: int, end: int, template: list[str], need: int) -> Iterator[list[tuple[int, int]]]:
    """Alignments of windows of a stretch, from left to right: where repeats mislead the anchors of wider parts, every window that
    begins and ends with a word of the template is tried, the longest first. Most starts have too few common words for it."""
    reach, counts = STRETCH * len(template), Counter(template)
    at = [k for k in range(begin, end) if words[k] in counts]
    i = 0
    while i < len(at):
        k = at[i]
        hi = bisect_left(at, min(end, k + reach))
        i += 1
        if hi - i + 1 < need or common(words[k : at[hi - 1] + 1], template) < need:
            continue
        for j in range(hi - 1, i + need - 3, -1):
            m = aligned(words[k : at[j] + 1], template)
            if len(m) >= need:
                yield [(k + x, y) for x, y in m]
                i = bisect_left(at, k + m[-1][0] + 1)
                break


def _rank(m: list[tuple[int, int]]) -> tuple[int, int]:
    return len(m), m[0][0] - m[-1][0]


def licences(text: str, templates: dict[str, list[str]], rare: dict[str, set[str]], coverage: float = COVERAGE) -> list[dict]:
    """Templates found in the text: name, coverage, start and end. Every stretch of the text that can hold one is aligned;
    within it, occurrences are taken from left to right; where none is found so, every window is tried. A notice inside a longer licence found at the same place gives way."""
    words, places = tokens(text)
    have = set(words)
    out = []
    for name, template in templates.items():
        need = needed(template, coverage)
        if sum(map(have.__contains__, template)) < need:
            continue
        for begin, end in _stretches(words, template, rare[name]):
            parts = [(begin, end)]
            while parts:
                b, e = parts.pop()
                if e - b < need:
                    continue
                part = words[b:e]
                met = aligned(part, template)
                span = met[-1][0] - met[0][0] + 1 if met else 0
                if len(met) < need or span > STRETCH * len(template):
                    # several copies leave no word unique: look again around each place of a rare word
                    for m in [*_copies(words, b, e, template, rare[name], need)] or _windows(words, b, e, template, need):
                        out.append({"license": name, "coverage": len(m) / len(template), "start": places[m[0][0]][0], "end": places[m[-1][0]][1]})
                    continue
                met = tight(met, need)
                first, last = b + met[0][0], b + met[-1][0]
                out.append({"license": name, "coverage": len(met) / len(template), "start": places[first][0], "end": places[last][1]})
                parts += [(b, first), (last + 1, e)]
    inside = lambda x, y: x is not y and y["start"] <= x["start"] and x["end"] <= y["end"] and (y["end"] - y["start"], y["license"]) > (x["end"] - x["start"], x["license"])
    return sorted((x for x in out if not any(inside(x, y) for y in out)), key=lambda x: (x["start"], x["license"]))


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE, text_col: str = "text", out: str = "licenses") -> DataFrame:
    """docs with `out`: array of (license, coverage, start, end) by start, then name; offsets in code points, end exclusive.

    Whole texts are scanned. Null, empty and wordless texts have none. A column named `out` is replaced, others are kept.
    """
    small_batches(docs.sparkSession)
    known = {k: tokens(v)[0] for k, v in (TEMPLATES if templates is None else templates).items()}
    known = {k: v for k, v in known.items() if v}
    rare = rarest(known, coverage)

    @F.pandas_udf("array<struct<license: string, coverage: double, start: int, end: int>>")
    def scan(texts: pd.Series) -> pd.Series:
        return pd.Series([licences(t, known, rare, coverage) if t else [] for t in texts], dtype=object)

    return docs.drop(out).withColumn(out, scan(F.col(text_col)))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    told = F.transform("licenses", lambda x: F.concat_ws(":", x["license"], x["start"].cast("string"), x["end"].cast("string"), F.format_number(x["coverage"], 4)))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join(told, ",").alias("licenses"))

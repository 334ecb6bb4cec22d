"""Tokens, secrets, licences, languages and quality, against brute force, round trips or held-out accuracy."""

import hashlib
import math
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from fixtures import KEY, RANDOM, WORDS, messy_rows, sentence
from pyspark.sql import functions as F

from weftline.llm import bpe, langid, licenses, quality, secrets


def test_bpe_equals_the_library_at_any_chunk(spark, messy, nothing):
    vocab = bpe.default_vocabulary(spark)
    enc = bpe.built(vocab.value)[0]
    for chunk, overlap in ((bpe.CHUNK, bpe.OVERLAP), (100, 40), (50, 8)):
        rows = bpe.decode(bpe.encode(messy, vocab, chunk=chunk, overlap=overlap), vocab).collect()
        assert len(rows) == len(messy_rows())
        for r in rows:
            assert r.ids == enc.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
            assert r.key == "clash"
    assert bpe.digests(nothing, vocab).collect() == []
    one = {r.doc_id: r for r in bpe.digests(messy.where("doc_id in (120, 140)"), vocab).collect()}
    assert one[120].n_tokens == 0 and one[120].ids_sha256 == one[120].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert one[140].n_tokens > 10_000


def test_long_texts_of_other_scripts_are_parted(spark):
    rng = np.random.default_rng(3)
    text = "".join("".join(map(chr, rng.integers(0x4E00, 0x9FA5, rng.integers(3, 30)))) + rng.choice(["，", "。", "！"]) for _ in range(400))
    vocab = bpe.default_vocabulary(spark)
    at = spark.createDataFrame([(text,)], "t string").select(bpe._boundaries(vocab, len(text))("t").alias("at")).first().at
    assert len(at) > 300
    enc = bpe.built(vocab.value)[0]
    docs = spark.createDataFrame([(1, text), (2, text.replace("。", "")[:3_000] + "\U0001fae8's x"), (3, "漢" * 5_000)], "doc_id int, text string")
    for r in bpe.encode(docs, vocab, chunk=500, overlap=100).collect():
        assert r.ids == enc.encode_ordinary(r.text)


def test_hashes_are_those_of_ids_and_of_decoded_bytes(spark, messy):
    vocab = bpe.default_vocabulary(spark)
    coded = bpe.hashes(bpe.decode(bpe.encode(messy, vocab, chunk=100, overlap=40), vocab), vocab).drop("text")
    for r in coded.collect():
        assert r.hashes.ids == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest()
        assert r.hashes.decoded == hashlib.sha256(r.decoded).hexdigest()
    none = bpe.hashes(bpe.decode(spark.createDataFrame([(1, None)], "doc_id int, ids array<int>"), vocab), vocab).first()
    assert none.hashes is None and none.decoded is None


def test_ids_are_decoded_a_row_at_a_time_in_batches_bounded_by_bytes(spark):
    import tracemalloc

    import pyarrow as pa

    raw = [b"%d " % i for i in range(50_000)]
    ids = pa.array([np.random.default_rng(i).integers(300, 50_000, 100_000).astype(np.int32) for i in range(24)])
    tracemalloc.start()
    sizes = [len(got) for _, got in bpe._decoded(ids, raw)]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(sizes) == 24 and most < 24e6  # all rows as lists of Python take 80 MB and more
    before = [spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")]
    try:
        for given, want in (("256m", str(bpe.BATCH_BYTES)), ("64k", "64k")):
            spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", given)
            bpe.encode(spark.createDataFrame([(1, "a")], "doc_id int, text string"), bpe.default_vocabulary(spark))
            assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == want
    finally:
        for k, v in zip(("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"), before):
            spark.conf.set(k, v)


def test_secrets(spark, messy, nothing):
    got = secrets.secret_spans(messy).collect()
    assert len(got) == len(messy_rows())
    pattern = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for r in got:
        t = r.text or ""
        want = [(m.start(), 0, m.end()) for m in pattern.finditer(t) if len(m[2]) >= 6]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert [tuple(s) for s in r.spans if s.at < 3] == sorted(want)
        if r.doc_id == 131:
            assert [t[s.start : s.end] for s in r.spans if s.at == 3] == [RANDOM]
    masked = {r.doc_id: r.text for r in secrets.redacted(messy.where("doc_id >= 120")).collect()}
    assert KEY not in masked[130] and masked[130].endswith("é") and masked[131] == "note [SECRET] end" and masked[120] is None and masked[121] == ""
    assert secrets.secret_spans(nothing).collect() == []


def test_written_words_are_no_secrets(spark):
    clean = [(i, sentence("en", i) + " internationalization_of_configuration Donaudampfschifffahrtsgesellschaft") for i in range(40)]
    rows = secrets.secret_spans(spark.createDataFrame(clean, "doc_id long, text string")).collect()
    assert all(not r.spans for r in rows)


def test_long_runs_are_read_whole(spark):
    words = "".join(re.findall("[a-z]+", " ".join(sentence("en", i, 60) for i in range(40)))) * 3
    key = "".join(np.random.default_rng(1).choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"), 80))
    places = [0, 50, 390, 1_111, 2_345, 3_920]
    rows = [(i, "see " + words[:k] + key + words[k:3_920] + " end") for i, k in enumerate(places)] + [(6, words[:4_000]), (7, key * 20)]
    for r in secrets.secret_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        added = [(s.start, s.end) for s in r.spans if s.at == 3]
        if r.doc_id < 6:
            k = 4 + places[r.doc_id]
            assert len(added) == 1 and added[0][0] <= k and k + 80 <= added[0][1] and added[0][1] - added[0][0] <= 250
        else:
            assert added == ([] if r.doc_id == 6 else [(0, 1_600)])  # windows that overlap are one span


def test_what_base_spans_leave_of_a_run_is_tested(spark):
    rows = [(0, f"id AKIA{'Q7' * 8}/{RANDOM} end"), (1, f"id {'0123456789abcdef' * 2}_{RANDOM} end"), (2, f"id AKIA{'Q7' * 8}/short end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [(r.text[s.start : s.end], s.at) for s in r.spans] for r in secrets.secret_spans(docs).collect()}
    assert got[0] == [("AKIA" + "Q7" * 8, 1), ("/" + RANDOM, 3)] and got[1] == [("0123456789abcdef" * 2, 2), ("_" + RANDOM, 3)] and len(got[2]) == 1
    assert all(RANDOM not in r.text for r in secrets.redacted(docs).collect())
    assert list(secrets.pieces(0, 10, [(2, 4, 0), (3, 5, 1), (3, 4, 2), (8, 12, 0)])) == [(0, 2), (5, 8)]


def test_the_battery_against_chance():
    # odds under the null are near even for random strings, and what isn't even or free is turned down
    rng = np.random.default_rng(4)
    for name, n in (("hex", 24), ("base32", 40), ("base36", 32), ("base64", 64)):
        size = len(secrets.ALPHABETS[name])
        draws = rng.integers(0, size, (4_000, n))
        for odds in (lambda x: secrets.uniformity(x, size), lambda x: secrets.runs(x, size), secrets.serial):
            p = np.array([odds(x) for x in draws])
            for level in (0.05, 0.01):
                assert (p < level).mean() <= 1.6 * level
        steps = np.cumsum(rng.integers(0, 2, n)) % size
        assert secrets.serial(steps) < 1e-3 and secrets.uniformity(np.zeros(n, dtype=int), size) < 1e-9
        assert secrets.runs(np.repeat([0, size - 1], n // 2), size) < 1e-3
    # the runs test against all arrangements of five high and five low symbols
    every = [np.array(x) for x in set(permutations([0] * 5 + [1] * 5))]
    count = lambda x: 1 + int((x[1:] != x[:-1]).sum())
    for few in (2, 4):
        x = next(x for x in every if count(x) == few)
        exact = 2 * np.mean([count(y) <= few for y in every])
        assert secrets.runs(x, 2) == pytest.approx(exact, rel=0.75, abs=0.01)
    assert [secrets.ENCODINGS[secrets.encoding(x)] for x in ("0123", "0a", "0A", "QA27==", "az09", "AZ09", "a-_Z")] == ["decimal", "hex", "HEX", "base32", "base36", "BASE36", "base64"]


def test_planted_random_strings_and_names(spark):
    rng = np.random.default_rng(8)
    draw = lambda name, n: "".join(rng.choice(list(secrets.ALPHABETS[name]), n))
    planted = {"base64": 40, "HEX": 40, "base36": 64}
    rows = [(i, f"see {draw(name, n)} here") for i, (name, n) in enumerate([x for x in planted.items() for _ in range(60)])]
    parts = "house river stone config service manager factory value request handler user list index path".split()
    rows += [(1_000 + i, " ".join(["_".join(f"{rng.choice(parts)}{rng.integers(9)}" for _ in range(5)), "/".join(rng.choice(parts, 6)), "".join(x.title() for x in rng.choice(parts, 5))])) for i in range(300)]
    got = {r.doc_id: [s for s in r.spans if s.at == 3] for r in secrets.secret_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(bool(got[i]) for i in range(180)) >= 0.95 * 180 and sum(len(got[1_000 + i]) for i in range(300)) <= 9


def test_false_discovery_cutoffs(spark):
    # 90 draws as chance gives them and ten far beyond: the ten are found
    rows = [(1, int(-np.log10((i + 0.5) / 90) * secrets.STEPS)) for i in range(90)] + [(1, 60)] * 10
    cand = spark.createDataFrame(rows, "stratum int, bin int")
    cut = secrets.cutoffs(cand, 0.05)[1]
    p = sorted(10.0 ** (-b / secrets.STEPS) for _, b in rows)
    passed = max(k + 1 for k in range(100) if p[k] * 100 <= 0.05 * (k + 1))
    assert sum(b >= cut for _, b in rows) == passed >= 10


def test_rising_is_longest():
    rng = np.random.default_rng(0)
    for _ in range(50):
        seq = rng.permutation(8).tolist()
        parts = [[x for i, x in enumerate(seq) if m >> i & 1] for m in range(256)]
        best = max(len(s) for s in parts if s == sorted(s))
        got = licenses.rising(list(enumerate(seq)))
        assert len(got) == best and all(a[0] < b[0] and a[1] < b[1] for a, b in zip(got, got[1:]))


def test_licences(spark, messy, nothing):
    mit = licenses.TEMPLATES["mit"]
    worn = mit.replace("free of charge", "gratis and for free").replace("merge, ", "").upper()
    texts = [(1, f"intro {mit} outro"), (2, f"a é {worn} b"), (3, mit[: len(mit) // 3]), (4, "Licensed under CC BY-NC 4.0. " * 3), (5, None), (6, ""), (7, "x " * 50_000 + "Released under the MIT License." + " y" * 50_000)]
    got = {r.id: r for r in licenses.license_scan(spark.createDataFrame(texts, "id int, text string")).collect()}
    first = got[1].licenses[0]
    assert first.license == "mit" and first.coverage == 1.0 and got[1].text[first.start : first.end] == mit.rstrip(".")
    assert [x.license for x in got[2].licenses] == ["mit"] and 0.8 <= got[2].licenses[0].coverage < 1
    assert got[3].licenses == [] and got[5].licenses == [] and got[6].licenses == []
    assert [x.license for x in got[4].licenses] == ["cc-by-nc-4.0-notice"] * 3 and [x.license for x in got[7].licenses] == ["mit-notice"]
    assert licenses.license_scan(messy).where("size(licenses) > 0").count() == 0 and licenses.license_scan(nothing).collect() == []


def found_licences(text, templates=licenses.TEMPLATES):
    known = {k: licenses.tokens(v)[0] for k, v in templates.items()}
    return licenses.licences(text, known, licenses.rarest(known, licenses.COVERAGE))


def test_notices_may_lack_any_one_word_of_five():
    for name in ("mit-notice", "cc-by-nc-4.0-notice"):
        words = licenses.tokens(licenses.TEMPLATES[name])[0]
        for k in range(5):
            got = found_licences(" ".join(["a b c", *words[:k], "changed", *words[k + 1 :], "d e f"]))
            assert [(x["license"], x["coverage"]) for x in got] == [(name, 0.8)]


def test_worn_copies_are_found_in_short_texts():
    for name in ("mit", "apache-2.0-header", "gpl-3.0-header", "bsd-3-clause", "isc"):
        words = licenses.tokens(licenses.TEMPLATES[name])[0]
        once = [k for k, w in enumerate(words) if words.count(w) == 1]
        n = len(words) - licenses.needed(words, licenses.COVERAGE)
        lost = [once[i * len(once) // n] for i in range(n)]
        text = " ".join(w for k, w in enumerate(words) if k not in lost)
        for around in ("", " ".join(words[k] for k in lost) + " x" * 1000):
            assert name in [x["license"] for x in found_licences(f"{text} {'y ' * 1000 if around else ''}{around}")]


def test_repeated_copies_with_a_changed_first_word_are_all_found():
    for name, template in licenses.TEMPLATES.items():
        words = licenses.tokens(template)[0]
        copy = " ".join(["changed", *words[1:]])
        for n in (2, 3, 7):
            for between in (" ", " x y z ", " and the other part is "):
                text = "It came so. " + between.join([copy] * n) + " More text follows here." * 3
                got = [text[x["start"] : x["end"]] for x in found_licences(text) if x["license"] == name]
                assert got == [" ".join(words[1:])] * n


def test_stray_words_do_not_stretch_a_copy():
    m = [(0, 0), (9, 1), (10, 2), (11, 3), (13, 4), (30, 5)]
    assert licenses.tight(m, 2) == [(9, 1), (10, 2), (11, 3), (13, 4)]
    assert licenses.tight(m, 5) == m[1:] or licenses.tight(m, 5) == m[:-1]
    assert licenses.tight(m, 6) == m and licenses.tight([], 0) == []


def windows_that_match(words, template, need):
    """Whether any window of the text, aligned with the template, covers it."""
    reach = licenses.STRETCH * len(template)
    for i in range(len(words)):
        for j in range(i + need, min(len(words), i + reach) + 1):
            m = licenses.aligned(words[i:j], template)
            if len(m) >= need and m[-1][0] - m[0][0] < reach:
                return True
    return False


def test_no_window_that_matches_is_missed():
    rng = np.random.default_rng(6)
    pick = lambda x: x[rng.integers(len(x))]
    hits = 0
    for _ in range(250):
        name = pick(["gpl-3.0-notice", "apache-2.0-notice", "mit-notice"])
        template = licenses.tokens(licenses.TEMPLATES[name])[0]
        need = licenses.needed(template, licenses.COVERAGE)
        noise = lambda: [pick(["aa", "bb", pick(template)]) for _ in range(rng.integers(12))]
        words = noise()
        for _ in range(rng.integers(1, 4)):  # copies with words changed, lost and put in
            copy = list(template)
            for _ in range(rng.integers(len(template) - need + 3)):
                k = int(rng.integers(len(copy)))
                copy[k : k + 1] = pick([["zz"], [], [copy[k], "zz"], [pick(template)]])
            words += copy + noise()
        if windows_that_match(words, template, need):
            hits += 1
            assert found_licences(" ".join(words), {name: licenses.TEMPLATES[name]}), words
    assert hits > 150
    a, b = [[int(x) for x in rng.integers(0, 6, 30)] for _ in range(2)]
    table = np.zeros((31, 31), dtype=int)
    for i in range(30):
        for j in range(30):
            table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
    assert licenses.common(a, b) == table[-1, -1]


def test_languages(spark, messy, nothing):
    rows = [(i, sentence(lang, i, 30), lang) for lang, k in zip(WORDS, (0, 1000, 2000)) for i in range(k, k + 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trees = langid.trained(docs)
    got = langid.predicted(docs.where(langid.remainder() == 2), trees).collect()
    assert len(got) > 20 and np.mean([r.lang == r.lang_pred for r in got]) >= 0.95 and all(0 <= r.score <= 1 for r in got)
    odd = {r.doc_id: r for r in langid.predicted(messy, trees).where("doc_id >= 120").collect()}
    assert all(odd[i].lang_pred == "und" and odd[i].score == 0 for i in (120, 121, 122, 123)) and odd[124].lang_pred in WORDS and odd[140].lang_pred == "en"
    assert {r.lang_pred for r in langid.predicted(docs, langid.trained(nothing)).collect()} == {"und"}
    assert langid.predicted(nothing, trees).collect() == []


def test_every_language_teaches(spark, monkeypatch):
    long = "".join(f"{i} lorem ipsum é " for i in range(9_000))
    rows = [(f"{x} {i}", x) for x in ("common", "frequent") for i in range(2_000)] + [(f"rare {i}", "rare") for i in range(30)] + [(long, "long")]
    docs = spark.createDataFrame([*rows, *((f"word {i}", f"lang{i}") for i in range(1_100))], "text string, lang string")
    got = langid.sample_texts(docs)
    assert len(got) == 1_104 and len(got["rare"]) == langid.SAMPLES // 1_104 == len(got["common"])
    assert len(got["long"]) == 1 and got["long"][0] in long and 10_000 < len(got["long"][0].encode()) <= langid.TAUGHT_BYTES
    monkeypatch.setattr(langid, "SAMPLES", 30)
    few = langid.sample_texts(docs.where("lang in ('common', 'frequent', 'rare')"))
    assert {k: len(v) for k, v in few.items()} == {"common": 10, "frequent": 10, "rare": 10}
    same = spark.createDataFrame([("one text", "same")] * 3_000 + [("other", "x")], "text string, lang string")
    assert set(langid.sample_texts(same)) == {"same", "x"}


def plain_code_length(text, sample, order=langid.ORDER):
    """Bits of the text under PPM of method C with exclusion, from plain counts of the sample's texts."""
    counts = [defaultdict(Counter) for _ in range(order + 1)]
    for t in sample:
        raw = bytes(order) + langid.folded(t)
        for i in range(order, len(raw)):
            for k in range(order + 1):
                counts[k][raw[i - k : i]][raw[i]] += 1
    raw, total = bytes(order) + langid.folded(text), 0.0

    def odds(context, byte, k):
        if k < 0:
            return 1 / 256
        seen = counts[k][context]
        n, kinds = sum(seen.values()), len(seen)
        if not n:
            return odds(context[1:], byte, k - 1)
        if byte in seen:
            return seen[byte] / (n + kinds)
        left = 1 - sum(odds(context[1:], b, k - 1) for b in seen)
        return kinds / (n + kinds) * odds(context[1:], byte, k - 1) / left

    for i in range(order, len(raw)):
        total -= math.log2(odds(raw[i - order : i], raw[i], order))
    return total


def test_predictions_are_those_of_plain_ppm(spark):
    sample = {lang: [sentence(lang, i, 12) for i in range(6)] for lang in WORDS}
    texts = [sentence(lang, 100 + i, 8) for lang in WORDS for i in range(3)] + ["Zwölf x", "é", "a"]
    got = langid.predicted(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), langid.forest(sample)).collect()
    for r in got:
        bits = {lang: plain_code_length(r.text, s) / len(langid.folded(r.text)) for lang, s in sample.items()}
        best = min(sorted(bits), key=bits.get)
        assert r.lang_pred == best and r.bits_per_byte == pytest.approx(bits[best], rel=1e-9)
        assert r.score == pytest.approx(2 ** -bits[best] / sum(2**-b for b in bits.values()), rel=1e-6)


def test_many_languages_are_judged_in_parts(spark, monkeypatch):
    sample = {lang: [sentence(lang, i, 12) for i in range(6)] for lang in WORDS}
    docs = spark.createDataFrame([(i, sentence(lang, 50 + i, 9)) for i, lang in enumerate([*WORDS] * 3)], "doc_id long, text string")
    want = langid.predicted(docs, langid.forest(sample)).orderBy("doc_id").collect()
    monkeypatch.setattr(langid, "TOGETHER", 2)
    assert len(langid.forest(sample)) == 2
    got = langid.predicted(docs, langid.forest(sample)).orderBy("doc_id").collect()
    assert [(r.lang_pred, round(r.score, 9)) for r in got] == [(r.lang_pred, round(r.score, 9)) for r in want]
    # a filter on the outcome judges each text once
    plan = langid.predicted(docs, langid.forest(sample)).where("bits_per_byte < 7 and lang_pred <> 'und'")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"ArrowEvalPython \[", plan)) == 1


def test_code_lengths_are_those_of_a_distribution():
    trees = langid.learned({"a": ["abracadabra abra"], "b": ["the cat sat"]})
    contexts = [b"abra", b"\0\0\0\0", b"zzzz", b"cada"]
    for c in contexts:
        w = np.array([int.from_bytes(c + bytes([x]), "big") for x in range(256)])
        assert np.allclose((2.0 ** -trees.bits(w)).sum(axis=0), 1, atol=1e-6)


def test_quality(spark, messy, nothing):
    good = [(i, sentence("en", i), 1) for i in range(150)]
    bad = [(1000 + i, "BUY!!! $$$ CLICK *** " * (5 + i % 7), 0) for i in range(150)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in good + bad], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in good[:75] + bad[:75]] + [(None, 1), (5, None)], "doc_id long, quality int")
    w = quality.trained(docs, labels)
    scored = quality.evidence(docs, w).select("doc_id", F.lit("h").alias("host"), F.when(F.col("doc_id") < 1000, "h/a").otherwise("h/b").alias("path"), "evidence")
    rows = quality.judged(scored).collect()
    assert all((r.quality > 0.5) == (r.doc_id < 1000) for r in rows)
    own = quality.judged(quality.evidence(messy, w).select("doc_id", F.col("source").alias("host"), F.col("lang").alias("path"), "evidence")).collect()
    assert len(own) == len(messy_rows()) and all(0 <= r.quality <= 1 for r in own)
    assert quality.judged(quality.evidence(nothing, w).select("doc_id", F.col("source").alias("host"), F.col("lang").alias("path"), "evidence")).collect() == []
    assert not quality.fitted([], []).any() and not quality.fitted(list(quality._features(["a"])), [1]).any()


def test_rates_are_those_of_plain_shrinkage(spark):
    rng = np.random.default_rng(2)
    rows = [(i, f"h{h}", f"h{h}/{rng.integers(3)}", float(rng.normal(h % 3 - 1, 1))) for i, h in enumerate(rng.integers(0, 9, 400))]
    rows += [(900, None, None, 1.0), (901, "h1", None, None)]
    docs = spark.createDataFrame([(*r, 5, "x", "y") for r in rows], "doc_id long, host string, path string, evidence double, p int, path_rate string, _host string")
    got = {r.doc_id: r for r in quality.judged(docs).collect()}
    p = lambda e: 1 / (1 + math.exp(-(e or 0.0)))
    sums = lambda key: {k: (sum(p(r[3]) for r in rows if key(r) == k), sum(key(r) == k for r in rows)) for k in map(key, rows)}
    host, path = lambda r: r[1] or "", lambda r: (r[1] or "", r[2] or "")
    rate = sum(p(r[3]) for r in rows) / len(rows)

    def strength(groups, mean):
        n = {k: v[1] for k, v in groups.items()}
        spread = sum(n[k] * (g / n[k] - mean(k)) ** 2 for k, (g, _) in groups.items())
        noise = sum(mean(k) * (1 - mean(k)) for k in groups)
        return min(1e6, max(1.0, noise / len(groups) / max(1e-4, (spread - noise) / sum(n.values()))))

    hosts, paths = sums(host), sums(path)
    s = strength(hosts, lambda k: rate)
    host_rate = {k: (g + s * rate) / (n + s) for k, (g, n) in hosts.items()}
    s = strength(paths, lambda k: host_rate[k[0]])
    path_rate = {k: (g + s * host_rate[k[0]]) / (n + s) for k, (g, n) in paths.items()}
    logit = lambda x: math.log(x / (1 - x))
    for r in rows:
        own = got[r[0]]
        assert own.host_rate == pytest.approx(host_rate[host(r)]) and own.path_rate == pytest.approx(path_rate[path(r)])
        assert own.quality == pytest.approx(p((r[3] or 0.0) + quality.TRUST * (logit(path_rate[path(r)]) - logit(rate))))
        assert own.p == 5 and own._host == "y"


def test_sparse_sites_shrink(spark):
    rows = [(i, "big", "big/x", 3.0 if i % 2 else -3.0) for i in range(400)] + [(1000 + i, "good", "good/x", 4.0) for i in range(200)] + [(2000, "one", "one/x", 4.0)]
    got = {r.host: r for r in quality.judged(spark.createDataFrame(rows, "doc_id long, host string, path string, evidence double")).collect()}
    rate = np.mean([1 / (1 + np.exp(-r[3])) for r in rows])
    assert got["big"].host_rate == pytest.approx(0.5, abs=0.02)
    assert rate < got["one"].host_rate < got["good"].host_rate <= 1  # a site of one document stays nearer to the whole

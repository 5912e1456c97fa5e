"""Each operator on small tables with nulls, empty and long texts, repeats, no rows, and clashing columns."""

import hashlib
import math
import random
import zlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tests.llm.test_bytes import plain_shingles
from tokenizers import Tokenizer

from palimpsest.llm import bpe, decontam, jaccard, langid, licenses, matroska, quality, repeats, sharding, wavelet

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {"en": "the of and that with from this was have river stone bridge house under water light".split(), "de": "der die und das mit von nicht wurde haben fluss stein brücke haus unter wasser licht".split(), "fr": "le la et que avec dans cette était avoir rivière pierre pont maison sous eau lumière".split()}


def sentence(pick, n, lang="en"):
    return " ".join(pick.choice(WORDS[lang]) + pick.choice(["", "s", "er", "ing"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    pick = random.Random(5)
    out = [(i, sentence(pick, pick.randrange(1, 150), lang), lang, "web", 1) for i, lang in enumerate(["en", "de", "fr"] * 30)]
    base = sentence(pick, 120)
    near = base.split()
    near[60] = "changed"
    passage = sentence(pick, 60)
    out += [(200, base, "en", "web", 1), (201, base, "en", "web", 1), (202, " ".join(near), "en", "web", 1), (203, passage + " one " + sentence(pick, 20), "en", "web", 1), (204, sentence(pick, 30) + " " + passage, "en", "web", 1)]
    out += [(300, None, None, None, None), (301, "", "en", "x", 0), (302, "   ", None, "x", 3), (303, "123 456", "en", "x", 7), (304, "one two", "en", "x", 7), (305, "one two", "en", "x", 7), (306, "é" * 300 + " " + "é" * 300, "fr", "x", 1), (307, "word " * 30_000, "en", "x", 1), (308, "z" * 5000, "en", "x", 1), (None, "the lost one", "en", "x", 12), (304, "one two", "en", "x", 7)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_decontamination(spark, docs, rows, none):
    items = [(1, rows[200 - 110][1]), (2, "one two"), (3, " ".join(rows[0][1].split()[:40])), (4, None), (5, ""), (2, "one two"), (6, "not in any of these texts at all")]
    table = spark.createDataFrame([(*x, "clash", 0) for x in items], "item_id long, text string, doc_id string, n_item int")
    want = Counter()
    for i, text, *_ in rows:
        for item, short in items:
            s = plain_shingles(short)
            k = min(5, len((short or "").split())) or 5
            shared = len(s & {t for t in plain_shingles(text, k) if len(t) == len(next(iter(s)))}) if s else 0
            if s and shared >= 0.75 * len(s):
                want[i, item, len(s), shared] += 1
    got = Counter((r["doc_id"], r["item_id"], r["n_item"], r["n_shared"]) for r in decontam.contaminated(docs, table).collect())
    assert got == want and any(k[1] == 2 for k in got)
    assert decontam.contaminated(none, table).count() == 0 == decontam.contaminated(docs, table.limit(0)).count()
    kept = decontam.decontaminate(docs, table)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, *_ in rows} - {k[0] for k in want}
    two = spark.createDataFrame([(7, "one two", 1), (7, "quite another text", 2)], "doc_id long, text string, _text_key int")
    assert [tuple(r) for r in decontam.decontaminate(two, table).collect()] == [(7, "quite another text", 2)]


def test_wavelet_shards(spark, docs, rows, none, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    wavelet.write_shards(docs, path, str(tmp_path / "s"), shard_tokens=500)
    shards = wavelet.read_shards(spark, str(tmp_path / "s"))
    got = wavelet.documents_of(shards).collect()
    own, want, start = Tokenizer.from_file(path), Counter(), 0
    for i, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*own.encode(text or "", add_special_tokens=False).ids, 2]
        want[i, start, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))] += 1
        start += len(ids)
    assert Counter(tuple(r) for r in got) == want and shards.count() > 5
    assert wavelet.occurrence_counts(shards, [2]).agg({"n": "sum"}).first()[0] == len(rows)
    assert wavelet.token_shards(none, path).count() == 0
    places = Counter(r["doc_id"] for r in wavelet.token_places(shards, 2).collect())
    assert places == Counter(r[0] for r in rows)


def test_bpe_round_trip(docs, rows, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, want = Tokenizer.from_file(path), Counter()
    for i, text, *_ in rows:
        ids = own.encode(text or "", add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256(own.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in bpe.round_trip(docs, path).collect()) == want
    assert bpe.round_trip(none, path).count() == 0
    back = bpe.decode(bpe.encode(docs.withColumnRenamed("source", "ids"), path), path)
    assert all((r["text"] or "") == r["decoded"] for r in back.collect())


def test_language_id(docs, rows, none):
    got = langid.identify(docs).collect()
    texts = {(i, t): lang for i, t, lang, *_ in rows}
    assert len(got) == len(rows)
    for r in got:
        assert r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
        if r["doc_id"] in (300, 301, 302, 303):
            assert r["lang_pred"] == "und"
    long = {i for i, t, *_ in rows[:90] if len(t.split()) > 20}
    right = [r["lang_pred"] == texts[r["doc_id"], next(t for i, t, *_ in rows if i == r["doc_id"])] for r in got if r["doc_id"] in long]
    assert sum(right) >= 0.95 * len(right)
    assert langid.identify(none).count() == 0


def plain_removed(texts, depth):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + depth] for d in data for i in range(len(d) - depth + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - depth + 1):
            if seen[d[i : i + depth]] > 1:
                gone[i : i + depth] = b"\1" * depth
        runs = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(d)))
        out.append((len(d), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(d, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("depth, anchor", [(200, 100), (24, 12), (9, 3)])
def test_suffix_dedup(spark, docs, rows, none, depth, anchor, monkeypatch):
    rows = [r for r in rows if r[0] != 307] + [(400, "ab" * 150 + "c" + "ab" * 120, "en", "x", 1)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    want = Counter((i, *x) for (i, *_), x in zip(rows, plain_removed([r[1] for r in rows], depth), strict=True))
    assert Counter(tuple(r) for r in repeats.measure(docs, depth, anchor).collect()) == want
    # Hashes of few bits, which take many different strings for equal, and groups in many parts.
    monkeypatch.setattr(repeats, "PART", 3)
    for bits in (4, 10):
        assert Counter(tuple(r) for r in repeats.measure(docs, depth, anchor, bits).collect()) == want
    clash = docs.withColumnRenamed("source", "_row").withColumnRenamed("lang", "_spans")
    cut = repeats.remove_repeats(clash, depth, anchor)
    assert cut.columns == clash.columns and cut.count() == len(rows)
    assert repeats.measure(none, depth, anchor).count() == 0


@pytest.mark.parametrize("stretch", [1 << 14, 64])
def test_periodic_text_and_passages_are_compared_by_document(spark, monkeypatch, stretch):
    """A group far larger than a part needs a few comparisons for each document, not one for each of its records."""
    pick, claims, refuted = random.Random(5), [], repeats._refuted
    passage = sentence(pick, 150)
    texts = [f"{sentence(pick, 9)}{k} " + ("onhe. Is " * pick.randrange(80, 120) if k % 2 else passage) + f"{k} {sentence(pick, 9)}" for k in range(60)] + ["a" * 2000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(repeats, "PART", 20)
    monkeypatch.setattr(repeats, "STRETCH", stretch)
    monkeypatch.setattr(repeats, "AT_ONCE", stretch * 10)
    monkeypatch.setattr(repeats, "_refuted", lambda t, runs: claims.append(runs.where("not (r = other and shift = 0)").count()) or refuted(t, runs))
    want = Counter((i, *x) for i, x in enumerate(plain_removed(texts, 200)))
    assert Counter(tuple(r) for r in repeats.measure(docs).collect()) == want
    assert stretch == 64 or claims[0] <= 8 * len(texts)


def test_matroska_columns(spark, docs, rows, none):
    got = matroska.read_back(matroska.mux(docs)).collect()
    assert len(got) == len(rows)
    by_text = {}
    for r in got:
        raw = next((t or "").encode() for i, t, *_ in rows if i == r["doc_id"])
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        media, sound = matroska.build(payload), [x - 128 for x in payload]
        groups = -(-len(payload) // (matroska.FRAME * matroska.LACED * matroska.BLOCKS))
        turns = sum((a < 0) != (b < 0) for a, b in zip(sound, sound[1:], strict=False))
        feature = f"packets={-(-len(payload) // matroska.FRAME)};clusters={groups};cues={groups};samples={len(payload)};peak={max(map(abs, sound))};sum={sum(sound)};crossings={turns}"
        want = (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, None)
        assert tuple(r)[1:] == want and by_text.setdefault(raw, want) == want
    assert matroska.read_back(matroska.mux(none)).count() == 0
    packets = matroska.packets(matroska.mux(docs))
    assert packets.count() >= len(rows) and packets.where("error is not null").isEmpty()
    good = matroska.build(b"x" * 6400)
    bad = spark.createDataFrame([(1, 64, good), (2, 64, None), (3, 64, b""), (4, 64, good[:-30]), (5, 64, good[:60] + b"\0" + good[61:])], "doc_id long, n_bytes long, media binary")
    errors = {r["doc_id"]: r["error"] for r in matroska.read_back(bad).collect()}
    assert errors[1] is None and errors[2] == "no stream" and errors[4] and len(errors) == 5
    assert matroska.packets(bad).where("error is not null").count() == sum(e is not None and k != 3 for k, e in errors.items())


def plain_components(rows):
    sets = [plain_shingles(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    low = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return Counter((i, len(sets[k]), low.get(find(k)) if sets[k] else i) for k, (i, *_) in enumerate(rows))


def test_jaccard_components(docs, rows, none):
    assert Counter(tuple(r) for r in jaccard.jaccard_components(docs).collect()) == plain_components(rows)
    assert jaccard.jaccard_components(none).count() == 0
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and {200} == {r["doc_id"] for r in kept.collect()} & {200, 201, 202}
    few = docs.sparkSession.createDataFrame([(3, "a b", 1), (5, "a b", 2), (5, "c d", 3)], "doc_id long, text string, node int")
    assert {tuple(r) for r in jaccard.keep_one(few).collect()} == {(3, "a b", 1), (5, "c d", 3)}


def test_jaccard_with_frequent_shingles(spark, monkeypatch):
    """Near copies of one text, and texts that share a long passage, with tiny parts: every pair comes from a tree."""
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    pick = random.Random(3)
    base, out = sentence(pick, 80).split(), []
    for i in range(40):
        w = list(base)
        for _ in range(pick.randrange(0, 4)):
            w[pick.randrange(80)] = f"w{pick.randrange(10**6)}"
        out.append((i, " ".join(w), "en", "x", 1))
    out += [(100 + i, " ".join(base[:60]) + " " + sentence(pick, pick.randrange(5, 40)), "en", "x", 1) for i in range(30)]
    assert Counter(tuple(r) for r in jaccard.jaccard_components(spark.createDataFrame(out, DOCS)).collect()) == plain_components(out)


def test_jaccard_with_a_shingle_in_thousands_of_sets(spark):
    """One passage in 3,000 otherwise different texts links none of them, and hides no pair of near copies among them."""
    pick = random.Random(13)
    passage, out = sentence(pick, 30), []
    for i in range(3000):
        own = " ".join(f"{pick.randrange(10**9):x}" for _ in range(20))
        out.append((i, f"{own} {passage}", "en", "x", 1))
    out += [(5000 + i, out[i][1] + " again", "en", "x", 1) for i in range(0, 3000, 100)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(spark.createDataFrame(out, DOCS)).collect()}
    assert got == {i: i % 5000 if i >= 5000 else i for i, *_ in out}


@pytest.mark.parametrize("n", [*range(1, 40), 1000, 1001])
def test_rarest_shingles_of_linked_sets_meet(n):
    """Any two linked sets with least overlap share one of their prefixes, for the worst order."""
    for m in range(n, (4 * n) // 3 + 1):
        both = int(jaccard.needed(n, m))
        assert 100 * both >= 75 * (n + m - both)
        assert jaccard.prefix_size(n) + both > n and jaccard.prefix_size(m) + both > m


def test_points_bound_overlaps():
    import numpy as np

    for n in (0, 1, 255 * 256, 511, 130_000):
        hashes = np.zeros(n, np.uint64)
        assert jaccard.points([jaccard.point(hashes)])[0, 0] >= n


def test_license_scan(spark, none):
    rows = [(1, "x\nReleased under the MIT License.\ny"), (2, "licensed UNDER the apache license version 2.0"), (3, None), (4, ""), (5, "All rights reserved. Not at all."), (1, "All rights reserved."), (6, "word\n" * 2000 + "Licensed under CC BY-NC 4.0.")]
    got = Counter((r["doc_id"], r["line_no"], r["license"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert (1, 2, "MIT") in got and (2, 1, "Apache-2.0") in got and (1, 1, "proprietary") in got and (6, 2001, "CC-BY-NC-4.0") in got
    assert not any(k[0] in (3, 4, 5) for k in got)
    want = Counter()
    for i, text in rows:
        for n, line in enumerate((text or "").split("\n"), 1):
            a = set(licenses.template_bigrams(line))
            for _, (name, template) in enumerate(licenses.TEMPLATES):
                b = set(licenses.template_bigrams(template))
                if a and 2 * len(a & b) >= 0.75 * (len(a) + len(b)):
                    want[i, n, name] += 1
    assert got == want and licenses.scan(none).count() == 0


def plain_passages(text):
    """Every window of every length that bounds allow, for each template; overlapping ones go by dice, place, length."""
    w, out = licenses.normal_words(text or ""), []
    pairs = [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]
    for k, (name, template) in enumerate(licenses.TEMPLATES):
        b = set(licenses.template_bigrams(template))
        lo, hi = licenses.size_bounds(len(b), licenses.THRESHOLD)
        some = []
        for i in range(len(pairs)):
            for n in range(lo, min(hi, len(pairs) - i) + 1):
                a = set(pairs[i : i + n])
                if 2 * len(a & b) >= licenses.THRESHOLD * (len(a) + len(b)):
                    some.append((-2 * len(a & b) / (len(a) + len(b)), i, n, len(a & b), len(a)))
        kept = []
        for x in sorted(some):
            if all(x[1] > y[1] + y[2] or y[1] > x[1] + x[2] for y in kept):
                kept.append(x)
        out += [(name, k, i + 1, n + 1, shared, size, round(-d, 9)) for d, i, n, shared, size in kept]
    return out


def test_license_passages(spark, none):
    """Notices that are wrapped over lines or stand inside longer ones, which no single line gives."""
    gpl = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version."
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:\n"
    cut = [(1, gpl, "GPL-3.0"), (2, bsd, "BSD-3-Clause"), (3, "Copyright (c) 2020 Acme Corp. All rights reserved.", "proprietary"), (4, "This package by Jane Doe is released under the MIT License.", "MIT")]
    pick = random.Random(8)
    text = lambda n: sentence(pick, n)
    rows = [(i, t) for i, t, _ in cut] + [(5, None), (6, ""), (7, " .\n"), (8, "reserved"), (9, "All rights reserved. All rights\nreserved. " * 3), (10, f"{text(50)}\n{gpl}\n{text(30)} {gpl.replace('either', 'EITHER a')}"), (11, text(40)), (1, gpl)]
    for i in range(40):
        words = pick.choice(licenses.TEMPLATES)[1].split()
        for _ in range(pick.randrange(len(words) // 5 + 2)):
            words[pick.randrange(len(words))] = pick.choice(["the", "and", "License", "under the", ""])
        rows.append((20 + i, f"{text(9)} {pick.choice([' ', chr(10)]).join(words)} {text(9)}"))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = licenses.passages(frame).collect()
    for i, _, name in cut:
        assert any(r["doc_id"] == i and r["license"] == name for r in got)
    assert not licenses.scan(frame.where("doc_id <= 4")).count()
    want = Counter((i, *m) for i, t in rows for m in plain_passages(t))
    assert Counter((*tuple(r)[:-1], round(r["dice"], 9)) for r in got) == want and want
    assert licenses.passages(none).count() == 0


def test_whole_license_texts(spark, none):
    pick = random.Random(17)
    wrapped = lambda t: "\n".join(" ".join(t.split()[i : i + 11]) for i in range(0, len(t.split()), 11))
    rows = [(k, f"Copyright (c) 2020 Acme\n\n{wrapped(t)}") for k, (_, t) in enumerate(licenses.TEXTS)]
    for i in range(30):
        words = pick.choice(licenses.TEXTS)[1].split()
        for _ in range(pick.randrange(60)):
            words[pick.randrange(len(words))] = pick.choice(["the", "of", "SOFTWARE", ""])
        rows.append((10 + i, " ".join(words)))
    rows += [(50, None), (51, ""), (52, sentence(pick, 300)), (53, licenses.TEXTS[0][1] + " " + sentence(pick, 400)), (54, "word " * 60_000), (0, rows[0][1])]
    want = Counter()
    for i, text in rows:
        a = set(licenses.template_bigrams(text or ""))
        for k, (name, template) in enumerate(licenses.TEXTS):
            b = set(licenses.template_bigrams(template))
            if len(licenses.normal_words(text or "")) > 1 and 2 * len(a & b) >= 0.75 * (len(a) + len(b)):
                want[i, name, len(licenses.TEMPLATES) + k, 1, len(licenses.normal_words(text)), len(a & b), len(a), round(2 * len(a & b) / (len(a) + len(b)), 9)] += 1
    got = licenses.whole_texts(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_words int"))
    assert Counter((*tuple(r)[:-1], round(r["dice"], 9)) for r in got.collect()) == want
    assert {("MIT", 0), ("ISC", 1), ("BSD-2-Clause", 2)} <= {(k[1], k[0]) for k in want} and not any(k[0] in (52, 53) for k in want)
    assert licenses.whole_texts(none).count() == 0


def plain_shard(key, weights):
    draw = lambda k: -math.log((int(hashlib.md5(f"{key}:{k}".encode()).hexdigest()[:15], 16) + 1) / (2.0**60 + 1)) / weights[k]
    return min((draw(k), k) for k in range(len(weights)) if weights[k] > 0)[1]


def test_sharding(spark, docs, rows, none):
    weights = [1.0] * 7 + [3.0, 0.0]
    clash = docs.withColumnRenamed("source", "shard").withColumnRenamed("lang", "_part")
    got = sharding.assign(clash, weights).collect()
    assert len(got) == len(rows)
    slots = {}
    for r in got:
        raw = next((t or "").encode() for i, t, *_ in rows if i == r["doc_id"])
        key = "null" if r["doc_id"] is None else str(r["doc_id"])
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 16, zlib.crc32(raw), "key")
        assert (r["shard"], r["grown_shard"]) == (plain_shard(key, weights), plain_shard(key, [*weights, 1.0]))
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.assign(none, weights).count() == 0
    same = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("one").alias("text")).repartition(5)
    alike = sharding.assign(same, [1.0, 1.0])
    assert sorted(r["slot"] for r in alike.collect()) == list(range(3000)) and alike.select("shard").distinct().count() == 1


def test_prior_from_positives_and_unlabelled():
    import numpy as np

    pick = np.random.default_rng(5)
    for share in (0.2, 0.5, 0.8):
        side = lambda n, good: pick.normal(1.2 if good else -1.2, 1, (n, quality.WIDTH)).astype(np.float32)
        unlabelled = np.vstack([side(int(4000 * share), True), side(int(4000 * (1 - share)), False)])
        pick.shuffle(unlabelled)
        assert abs(quality.estimate_prior(side(2000, True), unlabelled) - share) < 0.06


def test_quality(spark, none):
    pick = random.Random(2)
    rows, marks = [], []
    for i in range(600):
        good = pick.random() < 0.7
        text = sentence(pick, 60) if good else " ".join(w + pick.choice(["***", "$$$", "%%%"]) for w in sentence(pick, 60).split())
        rows.append((i, text, "en", "x", 1))
        if i % 2:
            marks.append((i, int(good), 0))
    truth = {i: "***" not in t and "$$$" not in t for i, t, *_ in rows}
    rows += [(1000, None, None, None, None), (1001, "", "en", "x", 0), (None, "no id", "en", "x", 1), (1002, "word " * 40_000, "en", "x", 1), rows[0], rows[0]]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    clash = spark.createDataFrame(rows, DOCS).withColumnRenamed("source", "score").withColumnRenamed("lang", "quality")
    got = quality.score_quality(clash, labels).collect()
    assert len({r["score"] for r in got if r["doc_id"] == 0}) == 1 and len({r["score"] for r in got if r["doc_id"] in (1000, 1001)}) == 1
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert sum(truth[r["doc_id"]] == bool(r["predicted"]) for r in held) >= 0.97 * len(held)
    assert quality.score_quality(none, labels).count() == 0
    assert quality.score_quality(spark.createDataFrame(rows[:5], DOCS), labels.limit(0)).count() == 5


def test_regular_words_in_sets(spark):
    """Words that polynomial hashes modulo a power of two take for one another."""
    bits = "".join("ab"[bin(k).count("1") & 1] for k in range(1024))
    other = bits.translate(str.maketrans("ab", "ba"))
    rows = [(1, bits), (2, other), (3, f"{bits} {bits} {bits} {bits} {bits} {other} {bits} {other} {bits} {bits}"), (4, bits.upper())]
    docs = spark.createDataFrame([(*r, "en", "x", 1) for r in rows], DOCS)
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs).collect()}
    assert got == {(i, len(plain_shingles(t)), 1 if i in (1, 4) else i) for i, t in rows}
    item = spark.createDataFrame([(1, f"{bits} w x y z {other} w x")], "item_id long, text string")
    held = spark.createDataFrame([(1, f"{bits} w x y z {other} w", "en", "x", 1)], DOCS)
    assert [(r["n_item"], r["n_shared"]) for r in decontam.contaminated(held, item).collect()] == [(4, 3)]


def test_exact_mode_gives_the_same_components(spark, docs):
    columns = ("doc_id", "n_shingles", "component_id")
    plain, exact = (Counter(tuple(r[c] for c in columns) for r in jaccard.jaccard_components(docs, exact=x).collect()) for x in (False, True))
    assert plain == exact

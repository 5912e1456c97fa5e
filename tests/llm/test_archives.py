"""WARC bundles, fill-in-middle and vector codes against plain versions, with nulls, ties, repeats, long and odd input."""

import hashlib
import math
import random
import re
import struct
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from palimpsest.llm import middle, veccodes, warc
from palimpsest.scratch import scratch

PAGES = "page_id long, url string, html string, digest string, raw int"


@pytest.fixture(scope="module")
def page_rows():
    pick = random.Random(3)
    same, other = "<p>the same page</p>" * 9, "é" * 50
    rows = [(k, f"http://a.example/{k}", f"<p>{pick.random()}</p>" * pick.randrange(1, 40), "clash", k) for k in range(60)]
    rows += [(k, None, same, None, None) for k in (205, 201, 203, 202)] + [(300 + k, "http://b\r\nX: y", other, "", 1) for k in range(2)]
    rows += [(400, "u", "short", None, 1), (401, "u", "short", None, 1), (402, "u", None, None, 1), (403, "u", "", None, 1), (404, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 20, None, 1)]
    rows += [(None, "u", same, None, 1), (None, "u", "no id, " * 30, None, 1), (None, "u", "no id, " * 30, None, 1), (201, None, same, None, None)]
    return rows + [(500, "u", "long " * 400_000, None, 1), (501, "u", "x" * 100, None, 1), (502, "u", "x" * 100, None, 1), (503, "u", "y" * 99, None, 1), (504, "u", "y" * 99, None, 1)]


def plain_archive(rows):
    first = {}
    for page, _, html, *_ in rows:
        raw = (html or "").encode()
        if len(raw) >= 100 and page is not None:
            first[raw] = min(page, first.get(raw, page))
    out = Counter()
    for page, _, html, *_ in rows:
        raw = (html or "").encode()
        to = first.get(raw)
        to = None if to == page else to
        out[page, len(raw), hashlib.sha256(raw).hexdigest(), "response" if to is None else "revisit", to] += 1
    return out


def told(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


TOLD = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def test_archive(spark, page_rows):
    pages = spark.createDataFrame(page_rows, PAGES).repartition(3)
    assert told(warc.archive(pages), *TOLD) == plain_archive(page_rows)
    assert warc.archive(pages.limit(0)).collect() == []


def test_archive_by_shuffle(spark, page_rows, monkeypatch):
    monkeypatch.setattr(warc, "SENT_ROWS", 0)
    assert told(warc.archive(spark.createDataFrame(page_rows, PAGES)), *TOLD) == plain_archive(page_rows)


def test_bundles_are_seekable(spark, page_rows):
    path = scratch(spark, "warc")
    warc.write_bundles(spark.createDataFrame(page_rows, PAGES).coalesce(2), path, frame_bytes=4000, bundle_bytes=600)
    bundles = warc.bundles_at(spark, path)
    files = {(r["part"], r["bundle"]): bytes(r["file"]) for r in bundles.collect()}
    assert len(files) > 4
    frames = 0
    for raw in files.values():
        # Any reader of the format takes the frames as one stream and skips the table.
        whole = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
        archive = warc.Archive(raw)
        assert whole == b"".join(archive.frame(k) for k in range(len(archive.places)))
        assert struct.unpack("<I", raw[-4:])[0] == 0x8F92EAB1
        frames += len(archive.places)
    assert frames > len(files)
    for r in warc.index_of(bundles).collect():
        frame = warc.Archive(files[r["part"], r["bundle"]]).frame(r["frame"])
        fields, size, payload, end = warc.parse(frame, r["begin"])
        assert fields["WARC-Record-ID"] == f"<{r['record_id']}>" and end == r["begin"] + r["length"]
        assert warc.page_of(r["record_id"]) == r["page_id"] and (payload == b"") == (r["refers_to"] is not None or size == 0)
    html = defaultdict(list)
    for page, _, text, *_ in page_rows:
        html[page].append((text or "").encode())
    wanted = [205, 203, 201, 17, 402, 404, 500, 502, 999, None, 17]
    got = Counter((r["page_id"], bytes(r["payload"])) for r in warc.fetch(bundles, spark.createDataFrame([(w, 1) for w in wanted], "page_id long, url int")).collect())
    assert got == Counter((w, raw) for w in {*wanted} - {None, 999} for raw in html[w])


def test_damaged_bundles():
    bundle = warc.Bundle()
    bundle.add(warc.record(1, None, b"abc", 3, hashlib.sha256(b"abc").hexdigest(), None), "n", 1, None)
    raw = bundle.file()
    assert [p for _, _, p in warc.Archive(raw).records()] == [b"abc"]
    for bad in (b"", raw[:-1], raw[:40] + raw[41:], raw[:-10] + b"\0" + raw[-9:]):
        with pytest.raises(ValueError):
            list(warc.Archive(bad).records())
    spoiled = bytearray(raw)
    spoiled[len(raw) - 10] ^= 1  # the checksum
    with pytest.raises(ValueError):
        list(warc.Archive(bytes(spoiled)).records())


DOCS = "doc_id long, text string, n int, form string"


def plain_middle(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n, hexed = len(units), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(hexed[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return text, (doc_id, n, "plain", None, None, digest(text), digest(text))
    form = "spm" if h4 % 100 < 20 else "psm"
    out = f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"
    return out, (doc_id, n, form, len(p), len(m), digest(out), digest(text))


@pytest.fixture(scope="module")
def texts():
    pick = random.Random(8)
    rows = [(k, "".join(pick.choice(["word", "é", "日本", " ", "\n", "X", "5", "😀", "<", "P>"]) for _ in range(pick.randrange(200))), 0, "x") for k in range(150)]
    rows += [(None, None, None, None), (None, "", 1, None), (None, "a b", 1, None), (7, "one two", 1, "y"), (7, "one two", 1, "y"), (7, "one three", 1, "y"), (9, None, 1, None), (10, "z<M>", 1, None), (11, "A", 1, None), (12, "é", 1, None)]
    # Longer than a piece: many units, one endless unit, and a character that lies across the cut.
    return rows + [(20 + k, t, 0, None) for k, t in enumerate(["ab cd " * 40_000, "z" * 200_000, "z" * (middle.PIECE_BYTES - 1) + "é" * 50_000, ". " * 30_000])] + [(90, "copy " * 50, 0, None)] * 40


def test_fill_in_middle(spark, texts):
    docs = spark.createDataFrame(texts, DOCS).repartition(3)
    want = [plain_middle(i, t) for i, t, *_ in texts]
    got = told(middle.measure(docs), *(c.split()[0] for c in middle.ROWS.split(", ")))
    assert got == Counter(row for _, row in want)
    assert {row[2] for _, row in want} == {"plain", "psm", "spm"}
    out = middle.outputs(docs)
    assert told(out, "doc_id", "form", "output") == Counter((row[0], row[2], text) for text, row in want)
    back = told(out.select("doc_id", middle.restored(F.col("output"), F.col("form")).alias("text")), "doc_id", "text")
    assert back == Counter((i, t or "") for i, t, *_ in texts)
    assert middle.measure(docs.limit(0)).collect() == []


def test_pieces_are_shuffled_once(spark, texts):
    plan = middle.measure(spark.createDataFrame(texts, DOCS)).rdd.toDebugString().decode()
    assert plan.count("ShuffledRDD") == 1


def test_pieces_are_bounded(texts):
    for i, text, *_ in texts:
        raw = (text or "").encode()
        form, pieces = middle.pieces_of(i, raw)
        pieces = list(pieces)
        assert all(len(p) <= middle.PIECE_BYTES and n <= middle.UNITS for n, p in pieces)
        assert sum(n for n, _ in pieces) == len(re.findall("[A-Za-z]+|[^A-Za-z]", text or ""))


def plain_codes(rows, parts, entries, rounds):
    kept = [(i, label, [math.floor(256 * x) for x in v]) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[2]))
    width = len(kept[0][2]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, _, v in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    find = lambda v, p: min((far(cut(v, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, _, v in kept:
            for p in range(parts):
                groups[p, find(v, p)[1]].append(cut(v, p))
        for (p, k), members in groups.items():
            books[p][k] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    out = [(i, label, "".join(f"{find(v, p)[1]:02x}" for p in range(parts)), sum(find(v, p)[0] for p in range(parts))) for i, label, v in kept]
    sums = Counter()
    for _, label, _, error in out:
        sums[label] += error
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((i, code, error, sums[label], digest) for i, label, code, error in out)


CODES = ("vec_id", "code", "error", "label_error", "codebooks_sha256")
VECTORS = "vec_id long, embedding array<float>, label int, x int, code string"


def vectors(seed, n, spread):
    pick = np.random.default_rng(seed)
    rows = [(int(k), [float(x) for x in (pick.integers(-spread, spread + 1, 16) / 64).astype(np.float32)], int(k % 3) if k % 5 else None) for k in pick.permutation(n)]
    return rows + [(n, None, 1), (n + 1, [None] + [0.0] * 15, 1), (n + 2, [math.nan] * 16, 1), (n + 3, [math.inf] + [0.0] * 15, 2), (0, rows[0][1], 1), (3, rows[0][1], 1), (None, rows[1][1], 9)]


@pytest.mark.parametrize(("n", "spread", "parts", "entries"), [(120, 40, 4, 16), (120, 2, 4, 16), (20, 30, 16, 64), (70, 1, 2, 8), (40, 0, 4, 8)])
def test_vector_codes(spark, n, spread, parts, entries):
    rows = vectors(n + spread, n, spread)
    table = spark.createDataFrame([(*r, 1, "clash") for r in rows], VECTORS).repartition(3)
    assert told(veccodes.compress(table, parts, entries), *CODES) == plain_codes(rows, parts, entries, 2)


def test_vector_codes_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(veccodes, "SENT_ROWS", 0)
    rows = vectors(1, 50, 30)
    table = spark.createDataFrame([(*r, 1, "clash") for r in rows], VECTORS)
    assert told(veccodes.compress(table, 4, 16), *CODES) == plain_codes(rows, 4, 16, 2)


def test_odd_vectors(spark):
    rows = vectors(2, 30, 30)
    odd = [(1000, [], 1), (1001, [0.5] * 15, 1), (1002, [1e30] * 16, None), (-5, [0.5] * 3, 1)]
    table = spark.createDataFrame([(*r, 1, "clash") for r in [*rows, *odd]], VECTORS)
    got = told(veccodes.compress(table, 4, 16), *CODES)
    want = plain_codes(rows, 4, 16, 2)
    assert Counter({k: n for k, n in got.items() if k[1] is not None}) == want
    assert sorted(k[0] for k in got if k[1] is None) == [-5, 1000, 1001, 1002]
    assert veccodes.compress(table.limit(0)).collect() == []
    assert [r["code"] for r in veccodes.compress(table.where("vec_id = 1001")).collect()] == [None]


def test_codes_decode(spark):
    rows = [r for r in vectors(4, 64, 30)[:64]]
    kept = veccodes.integers(spark.createDataFrame([(*r, 1, "clash") for r in rows], VECTORS))
    books = veccodes.fit(kept, 4, 16)
    back = {r["vec_id"]: r["x"] for r in veccodes.decode(veccodes.encode(kept, books), books).collect()}
    far = {r["vec_id"]: r["error"] for r in veccodes.encode(kept, books).collect()}
    for i, v, _ in rows:
        assert far[i] == sum((math.floor(256 * a) - b) ** 2 for a, b in zip(v, back[i], strict=True))


def test_search_is_exact():
    pick = np.random.default_rng(0)
    for spread in (1, 3, 50, 1 << 26):
        for d in (1, 3, 4):
            book, x = pick.integers(-spread, spread + 1, (64, d)), pick.integers(-spread, spread + 1, (500, d))
            index, far = veccodes.nearest(x, book)
            exact = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
            assert (index == exact.argmin(axis=1)).all() and (far == exact.min(axis=1)).all()

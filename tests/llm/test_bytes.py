"""Vectorised helpers, BPE, wavelet shards and Matroska streams against plain versions and libraries."""

import random
import re
import struct

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from palimpsest.llm import bpe, buffers, matroska, repeats, segcodes, wavelet

HARD = ["", None, " ", "  a  b  　 c  d", "foo <|endoftext|> bar  <|endoftext|>x", "aaaaaaaaa a" * 3, "a" * 700, "don't I'll 'tis we've'd", "\n\n x \t\n y ", "été É ́x  日本語 テスト 😀 \x1c \x85 1234 12.5%", "x" * 60 + " " * 70 + "y", "ÀÉÎ ŒUVRE İstanbul ΣΑΣ ß ẞ ª µ x.y, z.", "<|startoftext|>Hi <|endoftext|>"]
TEXT = st.text(st.sampled_from("ab Eé\n\t.,'1日 <|endoftext>sß"), max_size=60)


def codes(coder, texts):
    out = []
    for _, ids, offsets in coder.documents(pa.array(texts, pa.string())):
        out += [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)]
    return out


@pytest.mark.parametrize("name, make", [("byte_bpe_50k.json", bpe.coder), ("word_bpe_49k.json", wavelet.coder)])
def test_ids_are_those_of_the_library(name, make):
    path = public_tokenizers.path(name)
    own = Tokenizer.from_file(path)
    assert codes(make(path), HARD) == [own.encode(t or "", add_special_tokens=False).ids for t in HARD]


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=4))
def test_ids_and_decoding_of_random_texts(texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, mine = Tokenizer.from_file(path), bpe.load(path)
    for text, ids in zip(texts, codes(bpe.coder(path), texts), strict=True):
        assert ids == own.encode(text, add_special_tokens=False).ids
        assert mine.decode(np.array(ids, np.int64), np.array([0, len(ids)]))[0].decode() == own.decode(ids, skip_special_tokens=False)


def test_pair_checks_agree_with_merging():
    mine = bpe.load(public_tokenizers.path("byte_bpe_50k.json"))
    pick = random.Random(1)
    a, b = (np.array([pick.randrange(50256) for _ in range(3000)]) for _ in range(2))
    ok = mine._compatible(a, b)
    for x, y, good in zip(a, b, ok, strict=True):
        assert good == (mine.merge_long(mine.spelled[x] + mine.spelled[y]) == [x, y])
    words = [bytes(pick.choices(b"abtherion ", k=pick.randrange(1, 20))) for _ in range(2000)]
    ids, n = mine._exact(np.frombuffer(b"".join(words), np.uint8), np.cumsum([0, *map(len, words[:-1])]), np.cumsum(list(map(len, words))))
    ends = np.cumsum(n)
    assert all(ids[e - k : e].tolist() == mine.merge_long(w) for w, e, k in zip(words, ends, n, strict=True))


def plain_shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(["a", "B", "b", "cc", "é", "Ab"]), max_size=14).map(" \n".join)), max_size=6))
def test_shingle_sets(texts):
    sets = [plain_shingles(t) for t in texts]
    got = []
    for _, hashes, offsets in buffers.shingle_sets(pa.array(texts, pa.string())):
        got += [set(hashes[a:b].tolist()) for a, b in zip(offsets, offsets[1:], strict=False)]
    assert [len(s) for s in sets] == [len(s) for s in got]
    for s, t in ((i, j) for i in range(len(texts)) for j in range(i)):
        assert len(sets[s] & sets[t]) == len(got[s] & got[t])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=1500))
def test_wavelet_matrix(values):
    ids = np.array(values, np.uint32) * 4097
    matrix, names, offsets = wavelet.from_file(wavelet.to_file(wavelet.WaveletMatrix.build(ids), [7], np.array([0, len(ids)])))
    assert (matrix.ids() == ids).all() and names == [7] and offsets.tolist() == [0, len(ids)]
    if len(ids):
        assert (matrix.access(np.arange(len(ids))) == ids).all()
    for token in {*ids[:3].tolist(), 5}:
        at = np.flatnonzero(ids == token)
        assert matrix.count(token) == len(at) and matrix.occurrences(token).tolist() == at.tolist()
        assert matrix.count(token, len(ids) // 3, len(ids) // 2) == (ids[len(ids) // 3 : len(ids) // 2] == token).sum()
        assert all(matrix.select(token, n) == at[n] for n in range(0, len(at), 7))
        assert matrix.select(token, len(at)) == -1


def test_one_token_of_a_long_shard_reads_few_pieces():
    ids = np.random.default_rng(1).integers(0, 3000, 2_000_000).astype(np.uint32)
    matrix, _, _ = wavelet.from_file(wavelet.to_file(wavelet.WaveletMatrix.build(ids), [1], np.array([0, len(ids)])))
    assert matrix.access([1_234_567])[0] == ids[1_234_567]
    pieces = [name for name in matrix.planes.known if name[0] != "counts"]
    assert len(pieces) <= 2 * matrix.planes.n < matrix.planes.n * len(ids) // wavelet.PIECE
    assert matrix.occurrences(77).tolist() == np.flatnonzero(ids == 77).tolist()


def test_rules_of_plain_words_come_from_the_file(tmp_path):
    import json

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    assert wavelet.plain_words(spec) == (True, True)
    cased = json.loads(json.dumps(spec))
    cased["normalizer"]["normalizers"] = [x for x in cased["normalizer"]["normalizers"] if x["type"] != "Lowercase"]
    stripped = json.loads(json.dumps(spec))
    stripped["normalizer"]["normalizers"].append({"type": "StripAccents"})
    assert wavelet.plain_words(cased) == (False, True) and wavelet.plain_words(stripped) is None
    for k, other in enumerate((cased, stripped)):
        path = str(tmp_path / f"{k}.json")
        with open(path, "w", encoding="utf-8") as f:
            json.dump(other, f)
        own = Tokenizer.from_file(path)
        texts = [t for t in HARD if t is not None] + ["Été à Paris, Brücke. The End"]
        assert codes(wavelet.coder(path), texts) == [own.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("n", [64, 1024, 1088, 4096, 64 * 5000])
def test_matroska_round_trip(n):
    payload = random.Random(n).randbytes(n)
    raw = matroska.build(payload)
    found = matroska.read_packets(raw)
    assert matroska.payload_of(raw) == payload and found["tracks"] == {1: "A_PCM/INT/LIT"}
    assert {place: time for time, _, place in found["cues"]} == found["clusters"]
    for time in found["clusters"].values():
        group = matroska.FRAME * matroska.LACED * matroska.BLOCKS * matroska.SCALE
        assert matroska.seek(raw, time + 5) == [p for p in found["packets"] if time <= p[1] < time + group]
    at = 0
    for track, time, lace, _, a, b in found["packets"]:
        assert track == 1 and time == (at - lace * matroska.FRAME) * matroska.SCALE
        at += b - a
    assert at == n


def test_matroska_lacing_unknown_sizes_and_groups():
    e, n = matroska.element, matroska.number
    xiph = b"\x81" + struct.pack(">hB", 5, 0x02) + bytes([2, 255, 1, 3]) + b"a" * 256 + b"b" * 3 + b"cc"
    fixed = b"\x82" + struct.pack(">hB", 6, 0x04) + bytes([1]) + b"ddee"
    cluster = n(matroska.TIMESTAMP, 10) + e(matroska.SIMPLE_BLOCK, xiph) + e(0xEC, b"void") + e(matroska.BLOCK_GROUP, e(matroska.BLOCK, fixed))
    unknown = bytes.fromhex("1F43B675") + b"\x01" + b"\xff" * 7
    raw = e(matroska.EBML, b"") + bytes.fromhex("18538067") + b"\x01" + b"\xff" * 7 + unknown + cluster + unknown + n(matroska.TIMESTAMP, 99)
    found = matroska.read_packets(raw)["packets"]
    assert [(p[0], p[1], p[2], raw[p[4] : p[5]]) for p in found] == [(1, 15_000_000, 0, b"a" * 256), (1, 15_000_000, 1, b"bbb"), (1, 15_000_000, 2, b"cc"), (2, 16_000_000, 0, b"dd"), (2, 16_000_000, 1, b"ee")]
    with pytest.raises(ValueError):
        matroska.read_packets(raw[:-40])


def test_damaged_matroska_streams_raise_one_error():
    pick = random.Random(6)
    whole = matroska.build(bytes(range(256)) * 40)
    for _ in range(3000):
        raw = bytearray(whole)
        for _ in range(pick.randrange(1, 4)):
            raw[pick.randrange(len(raw))] = pick.randrange(256)
        raw = bytes(raw[: pick.randrange(len(raw)) if pick.random() < 0.3 else len(raw)])
        for read in (matroska.read_packets, lambda x: matroska.seek(x, 10**9)):
            try:
                read(raw)
            except ValueError:
                pass


def thue_morse(n):
    return "".join("ab"[bin(k).count("1") & 1] for k in range(n))


TWISTED = [t for n in (64, 1024, 4096) for t in (thue_morse(n), thue_morse(n).translate(str.maketrans("ab", "ba")))]


@pytest.mark.parametrize("seed", [0, 1])
def test_regular_words_do_not_collide(seed):
    data, offsets = buffers.utf8(pa.array([*TWISTED, *(t + "x" for t in TWISTED), *map(str, range(5000))]))
    words, _ = buffers.word_hashes(data, offsets, seed)
    assert len(np.unique(words)) == len(words) == 2 * len(TWISTED) + 5000


def test_regular_words_as_segments():
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    made = bpe.coder(public_tokenizers.path("byte_bpe_50k.json"))
    for texts in (TWISTED[:1], TWISTED[1:2], TWISTED, [" ".join(TWISTED)], ["a b " + t for t in TWISTED]):
        for first, ids, offsets in made.documents(pa.array(texts)):
            for k, (a, b) in enumerate(zip(offsets, offsets[1:])):
                assert ids[a:b].tolist() == own.encode(texts[first + k], add_special_tokens=False).ids


def test_segments_of_equal_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(buffers, "range_hashes", lambda data, starts, ends, seed=0: np.zeros(len(starts), np.uint64))
    coder = segcodes.SegmentCoder(lambda new: (np.array([x for s in new for x in s], np.uint32), np.array([len(s) for s in new])))
    for texts in (["one two", "two one", ""], ["three one", "one two"], ["two"]):
        for first, ids, offsets in coder.documents(pa.array(texts)):
            assert [bytes(ids[a:b].tolist()).decode() for a, b in zip(offsets, offsets[1:])] == texts[first:]


@pytest.mark.parametrize("bits", [3, 8, 16, 64])
def test_anchors_depend_on_the_window_alone(bits):
    pick = np.random.default_rng(bits)
    text = pick.integers(97, 100, 3000).astype(np.uint8)
    text[500:900] = 97
    alone = {}
    for doc, a, _, lo, hi in zip(*repeats.anchors(text, np.array([0, len(text)]), 60, 20, bits), strict=True):
        alone |= {at: a for at in range(lo, hi + 1)}
    for before, after in ((1, 0), (5000, 200_000), (123_456, 1_000_000)):
        data = np.concatenate([pick.integers(0, 256, before).astype(np.uint8), text, pick.integers(0, 256, after).astype(np.uint8)])
        found = {}
        for doc, a, _, lo, hi in zip(*repeats.anchors(data, np.array([0, before, before + len(text), len(data)]), 60, 20, bits), strict=True):
            if doc == 1:
                found |= {at: a for at in range(lo, hi + 1)}
        assert found == alone and len(alone) == len(text) - 59


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=60), st.integers(1, 12))
def test_least_places(values, width):
    array = np.array(values, np.uint64)
    want = [i + values[i : i + width].index(min(values[i : i + width])) for i in range(len(values) - width + 1)]
    assert repeats.least_places(array, width).tolist() == want

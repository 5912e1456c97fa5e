"""Token ids in wavelet-matrix shards: succinct bit planes with rank and select.

One shard is one compressed file image: a JSON header line, then zstandard-compressed sections (document
ids, used ids, document offsets, each plane's running counts, and each plane in pieces).  Sections are
inflated when first needed, so a token, a count or an occurrence costs a few pieces of each plane, not the file.
"""

from __future__ import annotations

import functools
import itertools
import json
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from palimpsest.llm.bpe import byte_characters
from palimpsest.llm.segcodes import SegmentCoder
from palimpsest.scratch import scratch

MAGIC = b"WMX2\n"
#: Bits for which one running count is kept.
BLOCK = 512
#: Bits of a plane that are compressed together; a multiple of BLOCK.
PIECE = 1 << 17
#: Tokens after which a shard is closed; a document is never split, so one long document may exceed it.
SHARD_TOKENS = 1 << 19


class Planes:
    """Bit planes in memory; counts[k] has the ones of plane k before each block."""

    def __init__(self, planes: list[np.ndarray], length: int):
        self.n, self.whole = len(planes), planes.__getitem__
        blocks = -(-length // BLOCK)
        self.counts = np.zeros((len(planes), blocks + 1), np.uint32)
        for k, plane in enumerate(planes):
            bits = np.bitwise_count(np.pad(plane, (0, blocks * (BLOCK // 8) - len(plane)))).reshape(blocks, -1).sum(axis=1, dtype=np.uint32)
            np.cumsum(bits, out=self.counts[k, 1:])

    def take(self, k: int, at: np.ndarray) -> np.ndarray:
        """Bytes of plane k at the given places; 0 past its end."""
        plane = self.whole(k)
        out = np.zeros(at.shape, np.uint8)
        inside = at < len(plane)
        out[inside] = plane[at[inside]]
        return out


class StoredPlanes:
    """Bit planes of a shard file, inflated piece by piece on demand."""

    def __init__(self, inflate, n: int):
        self.inflate, self.n, self.known, self.full = inflate, n, {}, {}

    @property
    def counts(self):
        return self

    def __getitem__(self, k: int) -> np.ndarray:
        return np.frombuffer(self._get(("counts", k)), np.uint32)

    def _get(self, name) -> bytes:
        if name not in self.known:
            self.known[name] = self.inflate(name)
        return self.known[name]

    def take(self, k: int, at: np.ndarray) -> np.ndarray:
        out = np.zeros(at.shape, np.uint8)
        if k in self.full:  # the plane has been read as a whole
            mine = at < len(self.full[k])
            out[mine] = self.full[k][at[mine]]
            return out
        piece, inside = at // (PIECE // 8), at % (PIECE // 8)
        for j in np.unique(piece):
            raw = np.frombuffer(self._get((k, int(j))), np.uint8)
            mine = (piece == j) & (inside < len(raw))
            out[mine] = raw[inside[mine]]
        return out

    def whole(self, k: int) -> np.ndarray:
        if k not in self.full:
            parts, j = [], 0
            while raw := self._get((k, j)):
                parts.append(raw)
                j += 1
            self.full[k] = np.frombuffer(b"".join(parts), np.uint8)
        return self.full[k]


class WaveletMatrix:
    """A sequence of ids as bit planes over the ranks of the used ids, most significant bit first."""

    def __init__(self, alphabet: np.ndarray, planes: Planes | StoredPlanes, length: int):
        self.alphabet, self.planes, self.length = alphabet, planes, length

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        seen = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
        alphabet = np.flatnonzero(seen).astype(np.uint32)
        width = max(1, int(len(alphabet) - 1).bit_length()) if len(alphabet) else 0
        code = np.zeros(len(seen), np.uint16 if len(alphabet) <= 1 << 16 else np.uint32)
        code[alphabet] = np.arange(len(alphabet))
        row, planes = code[ids] if len(ids) else code, []
        for k in range(width - 1, -1, -1):
            bit = (row & row.dtype.type(1 << k)) != 0
            planes.append(np.packbits(bit, bitorder="little"))
            row = np.concatenate([np.compress(~bit, row), np.compress(bit, row)])
        return cls(alphabet, Planes(planes, len(ids)), len(ids))

    def _zeros(self, k: int) -> int:
        return self.length - int(self.planes.counts[k][-1])

    def _rank1(self, k: int, at: np.ndarray) -> np.ndarray:
        """Ones among the first ``at`` bits of plane k: the count of whole blocks, and of the bits of the last one."""
        block = at // BLOCK
        inside = (at - block * BLOCK)[:, None] - np.arange(0, BLOCK, 8)
        raw = self.planes.take(k, block[:, None] * (BLOCK // 8) + np.arange(BLOCK // 8))
        mask = ((1 << np.clip(inside, 0, 8)) - 1).astype(np.uint8)
        return self.planes.counts[k][block].astype(np.int64) + np.bitwise_count(raw & mask).sum(axis=1, dtype=np.int64)

    def access(self, at) -> np.ndarray:
        """The ids at the given places."""
        at = np.asarray(at, np.int64).copy()
        code = np.zeros(len(at), np.int64)
        for k in range(self.planes.n):
            bit = (self.planes.take(k, at >> 3) >> (at & 7).astype(np.uint8)) & 1
            ones = self._rank1(k, at)
            at = np.where(bit == 1, self._zeros(k) + ones, at - ones)
            code = code << 1 | bit
        return self.alphabet[code]

    def _walk(self, token: int, lo, hi) -> tuple[int, np.ndarray, np.ndarray] | None:
        """(code, begins, ends) of the last plane's ranges that hold the token's places in lo to hi - 1; None for an unused token."""
        code = int(np.searchsorted(self.alphabet, token))
        if code == len(self.alphabet) or self.alphabet[code] != token:
            return None
        lo, hi = np.atleast_1d(np.asarray(lo, np.int64)), np.atleast_1d(np.asarray(hi, np.int64))
        for k in range(self.planes.n):
            a, b = self._rank1(k, lo), self._rank1(k, hi)
            lo, hi = (self._zeros(k) + a, self._zeros(k) + b) if code >> (self.planes.n - 1 - k) & 1 else (lo - a, hi - b)
        return code, lo, hi

    def counts_in(self, token: int, lo, hi) -> np.ndarray:
        """How often ``token`` stands in each of the ranges of places lo to hi - 1."""
        found = self._walk(token, lo, hi)
        return found[2] - found[1] if found else np.zeros(len(np.atleast_1d(lo)), np.int64)

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """How often ``token`` stands in places lo to hi - 1."""
        return int(self.counts_in(token, lo, self.length if hi is None else hi)[0])

    def _select(self, code: int, at: np.ndarray) -> np.ndarray:
        """The places in the sequence of the given places of the last plane's order, by select in each plane upwards."""
        for k in range(self.planes.n - 1, -1, -1):
            one = code >> (self.planes.n - 1 - k) & 1
            want = at - self._zeros(k) if one else at
            row = self.planes.counts[k].astype(np.int64)
            before = row if one else np.minimum(np.arange(len(row)) * BLOCK, self.length) - row
            block = np.searchsorted(before, want, "right") - 1
            raw = self.planes.take(k, block[:, None] * (BLOCK // 8) + np.arange(BLOCK // 8))
            seen = np.cumsum(np.unpackbits(raw, axis=1, bitorder="little") == one, axis=1, dtype=np.int32)
            at = block * BLOCK + (seen == (want - before[block] + 1)[:, None]).argmax(axis=1)
        return at

    def select(self, token: int, n: int) -> int:
        """The place of the n-th (from 0) ``token``; -1 if there are fewer."""
        found = self._walk(token, 0, self.length)
        if not found or not 0 <= n < int(found[2][0] - found[1][0]):
            return -1
        return int(self._select(found[0], found[1] + n)[0])

    def occurrences(self, token: int) -> np.ndarray:
        """All places of ``token`` in rising order, many at once."""
        found = self._walk(token, 0, self.length)
        at = np.arange(found[1][0], found[2][0]) if found else np.zeros(0, np.int64)
        return np.concatenate([self._select(found[0], at[a : a + 2048]) for a in range(0, len(at), 2048)]) if len(at) else at

    def ids(self) -> np.ndarray:
        """The whole sequence, from the last plane up."""
        row = np.zeros(self.length, np.uint16 if self.planes.n <= 16 else np.uint32)
        for j in range(self.planes.n):
            k = self.planes.n - 1 - j
            bit, zeros = np.unpackbits(self.planes.whole(k), count=self.length, bitorder="little").view(bool), self._zeros(k)
            up = np.empty_like(row)
            up[np.flatnonzero(~bit)] = row[:zeros]
            up[np.flatnonzero(bit)] = row[zeros:] | row.dtype.type(1 << j)
            row = up
        return self.alphabet[row] if self.length else np.zeros(0, np.uint32)


def to_file(matrix: WaveletMatrix, doc_ids: list, offsets: np.ndarray) -> bytes:
    press = zstandard.ZstdCompressor(level=1).compress
    n, step = matrix.planes.n, PIECE // 8
    parts = {"docs": json.dumps(doc_ids).encode(), "alphabet": matrix.alphabet.tobytes(), "offsets": offsets.astype(np.int64).tobytes()}
    for k in range(n):
        plane = matrix.planes.whole(k).tobytes()
        parts[f"counts {k}"] = matrix.planes.counts[k].tobytes()
        parts |= {f"{k} {j}": plane[j * step : (j + 1) * step] for j in range(-(-len(plane) // step))}
    packed = {name: press(x) for name, x in parts.items()}
    head = {"length": matrix.length, "planes": n, "sections": [[name, len(x)] for name, x in packed.items()]}
    return MAGIC + json.dumps(head).encode() + b"\n" + b"".join(packed.values())


def from_file(raw: bytes) -> tuple[WaveletMatrix, list, np.ndarray]:
    """(matrix, document ids, document offsets) of a shard file; planes and counts stay compressed until they are asked."""
    raw = bytes(raw) if not isinstance(raw, bytes) else raw
    if not raw.startswith(MAGIC):
        raise ValueError("not a wavelet shard")
    at = raw.index(b"\n", len(MAGIC)) + 1
    head, where = json.loads(raw[len(MAGIC) : at]), {}
    for name, size in head["sections"]:
        where[name] = (at, at + size)
        at += size
    if at != len(raw):
        raise ValueError("a wavelet shard is cut off")

    def inflate(name) -> bytes:
        a, b = where.get(name if isinstance(name, str) else f"{name[0]} {name[1]}", (0, 0))
        return zstandard.decompress(raw[a:b]) if b > a else b""

    matrix = WaveletMatrix(np.frombuffer(inflate("alphabet"), np.uint32), StoredPlanes(inflate, head["planes"]), head["length"])
    return matrix, json.loads(inflate("docs")), np.frombuffer(inflate("offsets"), np.int64)


#: The parts of a vocabulary file under which a plain word can be encoded by itself: words are runs of letters, cut
#: from white space and marks, and spelled in bytes.  Fixed values of the file format.
_LETTERS, _MARKS = r"[\p{L}]+", r"[^\s\p{L}\p{N}]+"


def plain_words(spec: dict) -> tuple[bool, bool] | None:
    """(whether words are lower-cased, whether a comma or full stop after a word is a token of its own) by the rules of
    a tokenizer's JSON; None where these aren't rules for plain words, so that only the library may encode."""
    normal = spec.get("normalizer") or {"type": "Sequence", "normalizers": []}
    steps = normal["normalizers"] if normal["type"] == "Sequence" else [normal]
    harmless = lambda x: x["type"] in ("NFC", "Lowercase") or x["type"] == "Replace" and x["pattern"] == {"Regex": r"\s+"} and x["content"] == " "
    before = spec.get("pre_tokenizer") or {}
    cuts = before.get("pretokenizers", [])
    if not all(map(harmless, steps)) or before.get("type") != "Sequence" or [x["type"] for x in cuts] != ["Split", "ByteLevel"]:
        return None
    split, spelled = cuts
    choices = split["pattern"].get("Regex", "").split("|")
    if split["behavior"] != "Removed" or not split["invert"] or _LETTERS not in choices or spelled["add_prefix_space"] or spelled["use_regex"] or spec["model"]["type"] != "BPE":
        return None
    return any(x["type"] == "Lowercase" for x in steps), _MARKS in choices


@functools.lru_cache(maxsize=2)
def coder(path: str) -> SegmentCoder:
    """Encodes segments with the tokenizers library; where the file's rules allow, plain Latin words go straight to its BPE model."""
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    with open(path, encoding="utf-8") as f:
        rules = plain_words(json.load(f))
    shown, model = {b: c for b, c in enumerate(byte_characters())}, tokenizer.model

    def of_word(word: str) -> list[int]:
        spelled = word if word.isascii() else word.encode().decode("latin-1").translate(shown)
        return [t.id for t in model.tokenize(spelled)]

    tails = {c: of_word(c) for c in ",."} if rules and rules[1] else {}

    def encode_many(segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        out: list = [None] * len(segments)
        rest, known = [], {}
        for k, segment in enumerate(segments):
            text = segment.decode("utf-8")
            word = text.strip(" \t\n\r\x0b\x0c") if rules else ""
            word = word.lower() if rules and rules[0] else word
            tail = word[-1:]
            if tail in tails:
                word = word[: len(word) - len(tail)]
            if word.isalpha() and (text.isascii() or max(text) < "Ā"):
                ids = known.get(word)
                if ids is None:
                    ids = known[word] = of_word(word)
                out[k] = ids + tails[tail] if tail in tails else ids
            else:
                rest.append((k, text))
        for (k, _), got in zip(rest, tokenizer.encode_batch_fast([t for _, t in rest], add_special_tokens=False), strict=True):
            out[k] = got.ids
        lengths = np.fromiter(map(len, out), np.int64, len(out))
        return np.fromiter(itertools.chain.from_iterable(out), np.uint32, int(lengths.sum())), lengths

    return SegmentCoder(encode_many)


SHARD_SCHEMA = "part int, shard int, start long, n_docs long, n_tokens long, file binary"


def write_shards(docs: DataFrame, vocabulary: str, path: str, end_id: int = 2, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode each whole text, append ``end_id``, and write wavelet shards in ascending doc_id order.

    ``docs`` needs doc_id and text; other columns are ignored.  A null text counts as empty (its only
    token is ``end_id``); null ids come first; rows that share an id stay separate, ordered by a hash of the text.
    One row of the written table is one shard file; ``start`` counts tokens from its part's begin.
    A part is one range of ids and hashes, so no id fills one alone, and only one number per part is ever
    summed up over the whole table.
    """

    def run(batches):
        part, shard, total = TaskContext.get().partitionId(), 0, 0
        ids, sizes, names = [], [], []

        def close():
            nonlocal shard, total, ids, sizes, names
            flat, lengths = np.concatenate(ids), np.concatenate(sizes)
            offsets = np.concatenate([[0], np.cumsum(lengths)])
            row = {"part": part, "shard": shard, "start": total, "n_docs": len(names), "n_tokens": len(flat), "file": to_file(WaveletMatrix.build(flat), names, offsets)}
            shard, total, ids, sizes, names = shard + 1, total + len(flat), [], [], []
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("start", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("file", pa.binary())]))

        for batch in batches:
            doc_ids = batch.column(0)
            for first, flat, offsets in coder(vocabulary).documents(batch.column(1)):
                count = len(offsets) - 1
                flat, offsets = np.insert(flat, offsets[1:], end_id), offsets + np.arange(count + 1)
                at = 0
                while at < count:
                    room = shard_tokens - sum(map(len, ids))
                    to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + room, "right")) - 1)
                    to = min(to, count)
                    ids.append(flat[offsets[at] : offsets[to]])
                    sizes.append(np.diff(offsets[at : to + 1]))
                    names += doc_ids.slice(first + at, to - at).to_pylist()
                    at = to
                    if sum(map(len, ids)) >= shard_tokens or at < count:
                        yield close()
        if ids:
            yield close()

    order = [F.col("doc_id").asc_nulls_first(), F.col("_hash").asc()]
    by_id = docs.select("doc_id", "text", F.xxhash64("text").alias("_hash")).repartitionByRange(*order).sortWithinPartitions(*order)
    by_id.mapInArrow(run, SHARD_SCHEMA).write.option("compression", "none").parquet(path)


def read_shards(spark, path: str) -> DataFrame:
    """The shards of a written table with ``start`` counted from the first token of the whole table."""
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = parts.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_before"))
    return shards.join(F.broadcast(before), "part").withColumn("start", F.col("start") + F.col("_before")).drop("_before")


def documents_of(shards: DataFrame, end_id: int = 2) -> DataFrame:
    """Per document, read back from the shard files: doc_id, start, n_tokens, ids_crc32.

    Every document must end with ``end_id``, which is read and counted in the stored planes.
    """

    def run(batches):
        for batch in batches:
            for start, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                matrix, names, offsets = from_file(raw.as_py())
                # The ids by decoding the planes in turn, the documents' ends by access and rank.
                decoded = matrix.ids()
                if len(names) and ((matrix.access(offsets[1:] - 1) != end_id).any() or (matrix.counts_in(end_id, offsets[:-1], offsets[1:]) < 1).any()):
                    raise ValueError("a document of a shard doesn't end with the end token")
                flat, ends = memoryview(decoded.astype("<u4")).cast("B"), (offsets * 4).tolist()
                crcs = [zlib.crc32(flat[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(start + offsets[:-1]), pa.array(np.diff(offsets)), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.select("start", "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_shards(docs: DataFrame, vocabulary: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Write ``docs`` as shards (to ``path``, or to scratch space) and read every document back."""
    path = path or scratch(docs.sparkSession, "wavelet")
    write_shards(docs, vocabulary, path, end_id)
    return documents_of(read_shards(docs.sparkSession, path), end_id)


def occurrence_counts(shards: DataFrame, tokens: list[int]) -> DataFrame:
    """part, shard, token, n: how often each of the given ids stands in each shard, by rank alone."""

    def run(batches):
        for batch in batches:
            part, shard, n = [], [], []
            for p, s, raw in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                matrix = from_file(raw)[0]
                part += [p] * len(tokens)
                shard += [s] * len(tokens)
                n += [matrix.count(t) for t in tokens]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(shard, pa.int32()), pa.array(list(tokens) * batch.num_rows, pa.int32()), pa.array(n, pa.int64())], names=["part", "shard", "token", "n"])

    return shards.select("part", "shard", "file").mapInArrow(run, "part int, shard int, token int, n long")


def token_places(shards: DataFrame, token: int) -> DataFrame:
    """doc_id, place: every occurrence of a token, by select alone; ``place`` counts from the document's begin."""

    def run(batches):
        for batch in batches:
            for raw in batch.column(0):
                matrix, names, offsets = from_file(raw.as_py())
                at = matrix.occurrences(token)
                if len(at):
                    doc = np.searchsorted(offsets, at, "right") - 1
                    yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in doc], pa.int64()), pa.array(at - offsets[doc])], names=["doc_id", "place"])

    return shards.select("file").mapInArrow(run, "doc_id long, place long")

"""Vectorised work on the UTF-8 bytes of whole Arrow batches.

A batch of texts is one byte buffer plus document offsets.  Word limits, hashes and
shingles are computed over the buffer with numpy, so no Python object is made per word.
Every helper treats a null text as an empty one.
"""

from __future__ import annotations

import ctypes
import functools
import gc
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Longest run of bytes that the rolling-hash helpers handle at once; bounds a worker's memory.
CHUNK_BYTES = 1 << 20

_U = np.uint64


def _odd_inverse(p: int) -> int:
    return pow(p, -1, 1 << 64)


#: Multiplier of a polynomial hash over the ring of 64-bit integers.
_P = 0x9E3779B97F4A7C15
_P_INV = _odd_inverse(_P)
_BYTE_CODE = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes after which a white-space byte surely starts a new run (see ``segment_starts``).
_SOLID = np.zeros(256, dtype=bool)
_SOLID[0x21:0x7F] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that every bit of the result depends on every bit of ``x``."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def utf8(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and n + 1 offsets of the texts in them."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches, rows: int = 1000):
    """The record batches in slices of few rows, so that copies of a batch's texts stay small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def text_slices(texts: pa.Array, rows: int = 1000):
    """The texts in slices of few rows."""
    for at in range(0, len(texts), rows):
        yield texts.slice(at, rows)


def release() -> None:
    """Give freed memory back to the system: a worker process is kept for later tasks of other operators."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


def tidy(run):
    """``run`` over the batches of a task, after which the worker's freed memory goes back to the system."""

    @functools.wraps(run)
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def runs_of_documents(offsets: np.ndarray, limit: int = CHUNK_BYTES, most: int | None = None):
    """(first, last + 1) documents, ``most`` at most, whose bytes together stay under ``limit``; a longer document is alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(n, max(first + 1, last), first + (most or n))
        yield first, last
        first = last


def ragged_positions(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... for each run, end to end."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    out = np.arange(total, dtype=np.int64)
    return out + np.repeat(starts - (ends - lengths), lengths)


def segment_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places where a text can be cut without changing any white-space based pre-tokenisation.

    A cut is made before an ASCII white-space byte that follows a character which surely isn't
    white space: a visible ASCII character, or a two-byte character of U+00C0 to U+07FF.  After any
    other character no cut is made, which only makes the segment longer.
    """
    cut = np.zeros(len(data) + 1, dtype=bool)
    if len(data) > 1:
        solid = _SOLID[data[:-1]]
        if len(data) > 2:
            lead = data[:-2]
            solid[1:] |= (data[1:-1] >= 0x80) & (lead >= 0xC3) & (lead <= 0xDF)
        cut[1:-1] = SPACE[data[1:]] & solid
    cut[offsets[:-1]] = True
    cut[len(data)] = False
    return np.flatnonzero(cut)


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(segment code of each segment, the distinct segments as binary, segment count of each document)."""
    starts = segment_starts(data, offsets)
    ends = np.append(starts[1:], len(data))
    per_doc = np.searchsorted(starts, offsets[1:]) - np.searchsorted(starts, offsets[:-1])
    arr = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    assert len(starts) == 0 or ends[-1] == len(data)
    coded = arr.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary, per_doc


#: A power is a product of one entry of a low and one of a high table, so tables stay small for texts of any length.
_STEP = 12
_tables: dict[bool, tuple[np.ndarray, np.ndarray]] = {}


def _table(n: int, inverse: bool) -> tuple[np.ndarray, np.ndarray]:
    """p^0 to p^(2^_STEP - 1), and p^(k * 2^_STEP) for as many k as ``n`` places need."""
    have = _tables.get(inverse)
    steps = (n >> _STEP) + 1
    if have is None or len(have[1]) < steps:
        p = _P_INV if inverse else _P
        grow = lambda base, size: np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, base, np.uint64)]))
        have = _tables[inverse] = grow(p, 1 << _STEP), grow(pow(p, 1 << _STEP, 1 << 64), 1 << max(9, (steps - 1).bit_length()))
    return have


def _powers(n: int, inverse: bool) -> np.ndarray:
    """1, p, p^2, ... for n places."""
    low, high = _table(n, inverse)
    return (high[: (n >> _STEP) + 1, None] * low).ravel()[:n]


class Rolling:
    """Hashes of any byte ranges of one buffer in constant time each.

    They are polynomials, so texts of a regular build may collide: whoever uses them compares bytes in the end.
    """

    def __init__(self, data: np.ndarray):
        self.n = len(data)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_CODE[data] * _powers(len(data), False), out=self.sums[1:])

    def range(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        low, high = _table(self.n + 1, True)
        return mix((self.sums[ends] - self.sums[starts]) * (high[starts >> _STEP] * low[starts & ((1 << _STEP) - 1)]))

    def windows(self, length: int) -> np.ndarray:
        """The hash of data[i : i + length] for every i."""
        if self.n < length:
            return np.zeros(0, np.uint64)
        return mix((self.sums[length:] - self.sums[: self.n - length + 1]) * _powers(self.n - length + 1, True))


#: Seeds of independent hashes of byte ranges, and bytes up to which a range is hashed by numpy, eight at a time.
_SEEDS = (0x243F6A8885A308D3, 0x13198A2E03707344)
_STEPPED = 64
_TAIL = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte ranges of one buffer.

    Each step takes eight bytes in and mixes, so nothing about it is linear, and texts of a regular build collide no
    more often than others; ranges of one length up to eight bytes never do.  Longer ranges than ``_STEPPED`` take BLAKE2.
    """
    length = ends - starts
    out = mix(length.astype(np.uint64) * _U(0x9FB21C651E98DF25) + _U(_SEEDS[seed]))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray((len(data) + 1,), np.dtype("<u8"), padded, 0, (1,))
    long = length > _STEPPED
    rows = np.flatnonzero((length > 0) & ~long)
    at, left = starts[rows], length[rows]
    while len(rows):
        chunk = words[at] & _TAIL[np.minimum(left, 8)]
        out[rows] = mix(out[rows] ^ (chunk * _U(0x9E3779B97F4A7C15)))
        more = left > 8
        rows, at, left = rows[more], at[more] + 8, left[more] - 8
    if long.any():
        view = memoryview(np.ascontiguousarray(data))
        key = _SEEDS[seed].to_bytes(8, "big")
        for k in np.flatnonzero(long):
            out[k] = int.from_bytes(blake2b(view[starts[k] : ends[k]], digest_size=8, key=key).digest(), "big")
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word (ASCII lower case, split at ASCII white space), and each document's word offsets."""
    low = _LOWER[data]
    solid = np.zeros(len(data) + 2, dtype=np.int8)
    solid[1:-1] = ~SPACE[low]
    solid_before = solid[:-1].copy()
    inner = offsets[1:-1]
    solid_before[inner[inner < len(data)]] = 0  # a word never runs on into the next document
    begins = np.flatnonzero((solid[1:-1] == 1) & (solid_before[: len(data)] == 0))
    after = solid[2:].copy()
    at = inner[(inner > 0)] - 1
    after[at] = 0
    ends = np.flatnonzero((solid[1:-1] == 1) & (after == 0)) + 1
    hashes = range_hashes(low, begins, ends, seed) if len(begins) else np.zeros(0, np.uint64)
    return hashes, np.searchsorted(begins, offsets)


#: Odd weights of the places in a shingle.
_PLACE = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def shingle_hashes(words: np.ndarray, word_offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles (repeats included) and each document's offsets in them.

    A document with 1 to k - 1 words has one shingle, its whole sequence; one without words has none.
    """
    n_words = np.diff(word_offsets)
    counts = np.where(n_words >= k, n_words - k + 1, np.minimum(n_words, 1))
    offsets = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=offsets[1:])
    at = ragged_positions(word_offsets[:-1], counts)
    size = np.repeat(np.minimum(n_words, k), counts).astype(np.uint64)
    out = size * _U(0x2545F4914F6CDD1D)
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    short = bool((n_words < k).any())
    for j in range(k):
        part = padded[at + j] * _PLACE[j % len(_PLACE)] if j < len(_PLACE) else mix(padded[at + j] + _U(j))
        out += np.where(size > j, part, _U(0)) if short else part
    return mix(out), offsets


def distinct_per_document(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct hashes in rising order, and their offsets."""
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    keep = np.ones(len(hashes), dtype=bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    hashes, doc = hashes[keep], doc[keep]
    return hashes, np.searchsorted(doc, np.arange(len(offsets)))


def shingle_sets(texts: pa.Array, k: int = 5, seed: int = 0):
    """Yield (first document, distinct shingle hashes, offsets) for runs of documents of bounded size."""
    data, offsets = utf8(texts)
    for first, last in runs_of_documents(offsets):
        part = offsets[first : last + 1]
        words, at = word_hashes(data[part[0] : part[-1]], part - part[0], seed)
        yield first, *distinct_per_document(*shingle_hashes(words, at, k))

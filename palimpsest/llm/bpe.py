"""Byte-level BPE encoding and decoding by speculation and verification.

Greedy longest match proposes the tokens of every word at once.  A proposal is the true BPE result
exactly when each adjacent pair of its tokens is compatible, that is, when merging by rank would never
join the two sides earlier than each side is complete; that test runs over all pairs at once.  Only the
words with an incompatible pair are merged exactly, rank by rank.
"""

from __future__ import annotations

import functools
import heapq
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType

from palimpsest.llm import buffers
from palimpsest.llm.common import extended
from palimpsest.llm.segcodes import SegmentCoder

#: The pre-tokeniser's rule of byte-level BPE.  Fixed value.
WORD_RULE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Failing words of more bytes are merged one by one with a heap, which costs less than a wide table.
LONG_WORD = 48
_NEVER = np.int64(1) << np.int64(40)
_U = np.uint64


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in set(shown) else chr(next(spare)) for b in range(256)]


class Lookup:
    """A fixed map from 64-bit keys to ints, probed for whole arrays at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(4 * max(1, len(keys)) - 1).bit_length())
        self.shift, self.mask = _U(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, np.iinfo(np.uint64).max, np.uint64)
        self.values = np.full(1 << bits, -1, np.int64)
        keys = keys.astype(np.uint64)
        todo, at = np.arange(len(keys)), self._home(keys)
        while len(todo):
            free = self.values[at] < 0
            slots, first = np.unique(np.where(free, at, -1), return_index=True)
            first = first[slots >= 0]
            self.keys[at[first]], self.values[at[first]] = keys[todo[first]], values[todo[first]]
            rest = np.ones(len(todo), bool)
            rest[first] = False
            todo, at = todo[rest], (at[rest] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _U(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 where there is none."""
        keys = keys.astype(np.uint64, copy=False)
        at = self._home(keys)
        out = np.where(self.keys[at] == keys, self.values[at], -1)
        todo = np.flatnonzero((self.keys[at] != keys) & (self.values[at] >= 0))
        at = at[todo]
        while len(todo):
            at = (at + 1) & self.mask
            hit = self.keys[at] == keys[todo]
            out[todo[hit]] = self.values[at[hit]]
            go = ~hit & (self.values[at] >= 0)
            todo, at = todo[go], at[go]
        return out


class ByteBpe:
    """One vocabulary: merge ranks, token bytes, a byte trie, and the special tokens' strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = {c: b for b, c in enumerate(byte_characters())}
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        n = max([*vocab.values(), *self.special.values()]) + 1
        spelled = [b""] * n
        for token, i in vocab.items():
            spelled[i] = bytes(to_byte[c] for c in token)
        for token, i in self.special.items():
            spelled[i] = token.encode()
        self.spelled = spelled
        self.lengths = np.array([len(x) for x in spelled], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.letters = np.frombuffer(b"".join(spelled), np.uint8)
        self.byte_token = np.array([vocab[c] for c in byte_characters()], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.arange(len(pairs))
        self.made = made
        self.merge = Lookup(self._pair(left, right), order)
        #: The last merge that makes a token; -1 for single bytes.
        self.rank = np.full(n, -1, np.int64)
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        for to, what in ((self.rank, order), (self.left, left), (self.right, right)):
            to[made[::-1]] = what[::-1]
        self.merges = left, right
        # A token may be proposed only if merging its own bytes gives it.
        whole = np.zeros(n, bool)
        whole[self.byte_token] = True
        built = made[self.rank[made] == order]
        whole[built] = self._compatible(self.left[built], self.right[built], self.rank[built])
        for t in built:  # in rank order, parts come before wholes
            whole[t] &= whole[self.left[t]] and whole[self.right[t]]
        self._trie(np.flatnonzero(whole))
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.words = regex.compile(WORD_RULE)

    @functools.cached_property
    def merge_of(self) -> dict[tuple[int, int], int]:
        """Rank of each merge; made when the first long word fails."""
        return {(int(a), int(b)): r for r, (a, b) in enumerate(zip(*self.merges, strict=True))}

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a.astype(np.uint64) << _U(32)) | b.astype(np.uint64)

    def _trie(self, tokens: np.ndarray) -> None:
        nodes: dict[bytes, int] = {b"": 0}
        keys, to, accept = [], [], [-1]
        for t in tokens:
            word = self.spelled[t]
            for k in range(1, len(word) + 1):
                if (prefix := word[:k]) not in nodes:
                    keys.append(nodes[word[: k - 1]] << 8 | word[k - 1])
                    nodes[prefix] = len(nodes)
                    to.append(nodes[prefix])
                    accept.append(-1)
            accept[nodes[word]] = int(t)
        self.edges, self.accept = Lookup(np.array(keys, np.uint64), np.array(to, np.int64)), np.array(accept, np.int64)

    def _compatible(self, a: np.ndarray, b: np.ndarray, within: np.ndarray | None = None) -> np.ndarray:
        """Whether merging the bytes of a then b by rank leaves exactly a and b.

        The boundary is followed back in time: the side completed last is taken apart first, and at each
        moment the two symbols at the boundary must not have a merge due before either is used up.  Among
        equal ranks the left place merges first.  ``within``: the rank at which the boundary itself is joined.
        """
        a, b, ok = a.copy(), b.copy(), np.ones(len(a), bool)
        used_a = np.full(len(a), _NEVER) if within is None else within.copy()
        used_b = used_a.copy() if within is None else within - 1
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            due = self.merge(self._pair(x, y))
            bad = (due >= 0) & (due < used_a[live]) & (due <= used_b[live])
            ok[live[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~bad & ((rx >= 0) | (ry >= 0))
            live, x, y, rx, ry = live[go], x[go], y[go], rx[go], ry[go]
            of_a = rx > ry
            i, j = live[of_a], live[~of_a]
            used_a[i], a[i] = rx[of_a], self.right[x[of_a]]
            used_b[j], b[j] = ry[~of_a], self.left[y[~of_a]]
        return ok

    def _greedy(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, token) of each proposed token, in the order of words and places."""
        word, at, end = np.arange(len(begins)), begins.copy(), ends
        node, last, last_end = np.zeros(len(word), np.int64), np.full(len(word), -1), begins.copy()
        out_word, out_token = [], []
        while len(word):
            inside = at < end
            child = np.full(len(word), -1)
            child[inside] = self.edges((node[inside] << 8) | data[at[inside]])
            on = child >= 0
            at[on] += 1
            node[on] = child[on]
            took = np.where(on, self.accept[np.where(on, child, 0)], -1)
            hit = took >= 0
            last[hit], last_end[hit] = took[hit], at[hit]
            if not on.all():
                stop = ~on
                out_word.append(word[stop])
                out_token.append(last[stop])
                at[stop], node[stop] = last_end[stop], 0
                keep = on | (last_end < end)
                word, at, end, node, last, last_end = (v[keep] for v in (word, at, end, node, last, last_end))
        words = np.concatenate(out_word) if out_word else np.zeros(0, np.int64)
        tokens = np.concatenate(out_token) if out_token else np.zeros(0, np.int64)
        order = np.argsort(words, kind="stable")
        return words[order], tokens[order]

    def _exact(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens end to end, counts): rank-by-rank merging of short words, all words at once."""
        lengths = ends - begins
        order = np.argsort(lengths, kind="stable")
        tokens: list = [None] * len(order)
        for chunk in np.array_split(order, max(1, len(order) // 8192)):
            if not len(chunk):
                continue
            n, width = len(chunk), int(lengths[chunk].max())
            sym = np.full((n, width), -1, np.int64)
            col = np.arange(width)
            filled = col < lengths[chunk][:, None]
            sym[filled] = self.byte_token[data[buffers.ragged_positions(begins[chunk], lengths[chunk])]]
            size, live = lengths[chunk].copy(), np.flatnonzero(lengths[chunk] > 1)
            while len(live):
                s, w = sym[live], int(size[live].max())
                s = s[:, :w]
                due = np.full((len(live), w - 1), _NEVER)
                pair = col[: w - 1] < (size[live] - 1)[:, None]
                found = self.merge(self._pair(s[:, :-1][pair], s[:, 1:][pair]))
                due[pair] = np.where(found < 0, _NEVER, found)
                at = due.argmin(axis=1)
                best = due[np.arange(len(live)), at]
                go = best < _NEVER
                live, at, best = live[go], at[go], best[go]
                if not len(live):
                    break
                sym[live, at] = self.made[best]
                src = np.minimum(col + (col > at[:, None]), width - 1)
                sym[live] = np.take_along_axis(sym[live], src, axis=1)
                size[live] -= 1
                live = live[size[live] > 1]
            for k, row, m in zip(chunk, sym, size, strict=True):
                tokens[k] = row[:m]
        counts = np.fromiter(map(len, tokens), np.int64, len(tokens))
        return (np.concatenate(tokens) if tokens else np.zeros(0, np.int64)), counts

    def merge_long(self, word: bytes) -> list[int]:
        """Exact merging of one word of any length, with a heap of due merges."""
        sym = [int(self.byte_token[b]) for b in word]
        nxt, prv = [*range(1, len(sym)), -1], [*range(-1, len(sym) - 1)]
        heap = [(r, i) for i in range(len(sym) - 1) if (r := self.merge_of.get((sym[i], sym[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = nxt[i] if sym[i] >= 0 else -1
            if j < 0 or self.merge_of.get((sym[i], sym[j])) != r:
                continue
            sym[i], sym[j] = int(self.made[r]), -1
            nxt[i] = nxt[j]
            if nxt[j] >= 0:
                prv[nxt[j]] = i
            for a, b in ((prv[i], i), (i, nxt[i])):
                if a >= 0 and b >= 0 and (q := self.merge_of.get((sym[a], sym[b]))) is not None:
                    heapq.heappush(heap, (q, a))
        return [s for s in sym if s >= 0]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens end to end, token count of each word)."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(lengths)
        begins = ends - lengths
        some = np.flatnonzero(lengths > 0)
        word, token = self._greedy(data, begins[some], ends[some])
        same = word[1:] == word[:-1]
        pairs, back = np.unique(self._pair(token[:-1][same], token[1:][same]), return_inverse=True)
        ok = self._compatible((pairs >> _U(32)).astype(np.int64), (pairs & _U(0xFFFFFFFF)).astype(np.int64))
        failed = np.unique(word[1:][same][~ok[back]])
        counts = np.zeros(len(words), np.int64)
        counts[some] = np.bincount(word, minlength=len(some))
        good = np.ones(len(some), bool)
        good[failed] = False
        pieces = [(some[word[good[word]]], token[good[word]])]
        failed = some[failed]
        rows = failed[lengths[failed] <= LONG_WORD]
        if len(rows):
            merged, n = self._exact(data, begins[rows], ends[rows])
            counts[rows] = n
            pieces.append((np.repeat(rows, n), merged))
        for k in failed[lengths[failed] > LONG_WORD]:
            ids = self.merge_long(words[k])
            counts[k] = len(ids)
            pieces.append((np.full(len(ids), k), np.array(ids, np.int64)))
        owner = np.concatenate([p[0] for p in pieces])
        tokens = np.concatenate([p[1] for p in pieces])
        return tokens[np.argsort(owner, kind="stable")], counts

    def encode_segments(self, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """ids and counts of segments: special strings first, then words by the pre-tokeniser's rule."""
        words, special, per = [], [], np.zeros(len(segments), np.int64)
        for k, segment in enumerate(segments):
            text = segment.decode("utf-8")
            before = len(words)
            if self.split is not None and (found := list(self.split.finditer(text))):
                at = 0
                for m in found:
                    words += [w.encode() for w in self.words.findall(text[at : m.start()])]
                    special.append((len(words), self.special[m[0]]))
                    words.append(b"")
                    at = m.end()
                words += [w.encode() for w in self.words.findall(text[at:])]
            else:
                words += [w.encode() for w in self.words.findall(text)]
            per[k] = len(words) - before
        ids, counts = self.encode_words(words)
        if special:
            where = np.array([p for p, _ in special])
            ends = np.cumsum(counts)
            ids = np.insert(ids, ends[where], [i for _, i in special])
            counts[where] = 1
        ends = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum(per)])]
        return ids.astype(np.uint32), np.diff(ends)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The decoded text of each document, in UTF-8; broken sequences become U+FFFD."""
        if len(ids) and int(ids.max()) >= len(self.lengths):
            raise ValueError(f"token id {int(ids.max())} is outside the vocabulary")
        lengths = self.lengths[ids]
        flat = memoryview(self.letters[buffers.ragged_positions(self.starts[ids], lengths)])
        ends = np.concatenate([[0], np.cumsum(lengths)])[offsets].tolist()
        return [str(flat[a:b], "utf-8", "replace").encode() for a, b in zip(ends, ends[1:], strict=False)]


@functools.lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


@functools.lru_cache(maxsize=2)
def coder(path: str) -> SegmentCoder:
    return SegmentCoder(load(path).encode_segments, run_bytes=1 << 20)  # decoding takes some twenty times a run's bytes


def forgetting(run):
    """``run`` over the batches of a task, after which the vocabulary leaves the worker's memory."""

    @functools.wraps(run)
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            load.cache_clear()
            coder.cache_clear()
            buffers.release()

    return whole


def encode(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """``docs`` with a column ``ids`` (array<int>): the byte-level BPE ids of each whole text.

    ``vocabulary``: path of a tokenizers JSON file, readable on every executor.  A null text counts as
    empty and has no ids.  Strings of special tokens inside a text become those tokens.  Rows are mapped
    one to one, so repeated rows stay, an empty table stays empty, and other columns pass unchanged; a
    column ``ids`` of the input is replaced.
    """
    keep = docs.drop("ids")
    name = next(f.name for f in keep.schema.fields if f.name.lower() == text.lower())

    def run(batches):
        for batch in batches:
            ids, lengths = [], []
            for _, part, offsets in coder(vocabulary).documents(batch.column(batch.schema.get_field_index(name))):
                ids.append(part)
                lengths.append(np.diff(offsets))
            flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
            ends = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]) if lengths else np.zeros(1)
            column = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, "ids"])

    return keep.mapInArrow(forgetting(run), extended(keep.schema, ids=ArrayType(IntegerType())))


def decode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``docs`` with a column ``decoded`` (string) made from ``ids``; null ids count as none."""
    keep = docs.drop("decoded")

    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("ids")).fill_null([])
            offsets = column.offsets.to_numpy().astype(np.int64)
            flat = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
            texts = load(vocabulary).decode(flat, offsets - offsets[0])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary()).cast(pa.string())], names=[*batch.schema.names, "decoded"])

    return keep.mapInArrow(forgetting(run), extended(keep.schema, decoded=StringType()))


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of ``docs``, in one pass over the texts.

    The ids are made by ``encode``'s coder and the text is decoded from them by ``ByteBpe.decode``; only
    the digests leave the task.  Null text counts as empty; repeated rows give repeated rows.
    """
    from hashlib import sha256

    def run(batches):
        for batch in buffers.slices(batches):
            doc_ids = batch.column(0)
            for first, ids, offsets in coder(vocabulary).documents(batch.column(1)):
                raw, ends = memoryview(ids.astype("<u4")).cast("B"), (offsets * 4).tolist()
                of_ids = [sha256(raw[a:b]).hexdigest() for a, b in zip(ends, ends[1:], strict=False)]
                of_text = [sha256(x).hexdigest() for x in load(vocabulary).decode(ids, offsets)]
                yield pa.RecordBatch.from_arrays([doc_ids.slice(first, len(of_ids)), pa.array(np.diff(offsets).astype(np.int64)), pa.array(of_ids), pa.array(of_text)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(forgetting(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

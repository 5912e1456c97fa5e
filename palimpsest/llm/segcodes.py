"""Token ids of whole texts by way of their distinct segments.

A text is cut where no pre-tokeniser rule can see across (``buffers.segment_starts``).  Arrow codes
the segments of a run of documents by a dictionary, so that each distinct segment is encoded once,
and numpy gathers the ids of all segments back into documents.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from palimpsest.llm import buffers

#: Bytes of text that are coded together, unless a coder says otherwise.
RUN_BYTES = 4 << 20


class SegmentCoder:
    """encode_many(list of segments as bytes) -> (ids end to end as uint32, id count of each segment).

    Known segments are kept until there are ``limit`` of them, then all are forgotten: memory stays
    bounded whatever the corpus holds, and results don't depend on what is kept.  A known segment is found by
    a hash and then compared byte by byte, so that only new segments become Python objects.
    """

    def __init__(self, encode_many: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], limit: int = 700_000, run_bytes: int = RUN_BYTES):
        self.encode_many, self.limit, self.run_bytes = encode_many, limit, run_bytes
        self.forget()

    def forget(self) -> None:
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.raw, self.raw_used, self.places = np.zeros(1 << 18, np.uint8), 0, np.zeros(1, np.int64)
        self.ids, self.used, self.known = np.zeros(1 << 16, np.uint32), 0, 0
        self.starts, self.lengths = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)

    def _learn(self, new: list[bytes]) -> np.ndarray:
        """The slots of newly encoded segments."""
        ids, lengths = self.encode_many(new)
        have, total = self.known, self.used + len(ids)
        while len(self.ids) < total:
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.starts) < have + len(new):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
        self.ids[self.used : total] = ids
        self.lengths[have : have + len(new)] = lengths
        self.starts[have : have + len(new)] = self.used + np.cumsum(lengths) - lengths
        self.known, self.used = have + len(new), total
        self._remember(new)
        return np.arange(have, have + len(new))

    def _remember(self, new: list[bytes]) -> None:
        """The bytes of new segments, by slot."""
        raw = np.frombuffer(b"".join(new), np.uint8)
        total = self.raw_used + len(raw)
        while len(self.raw) < total:
            self.raw = np.concatenate([self.raw, np.zeros_like(self.raw)])
        self.raw[self.raw_used : total] = raw
        self.places = np.concatenate([self.places, self.raw_used + np.cumsum([len(x) for x in new])])
        self.raw_used = total

    def _same(self, slots: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Whether known segments have the bytes of the given ranges."""
        at = self.places[slots]
        same = self.places[slots + 1] - at == lengths
        rows = np.flatnonzero(same & (lengths > 0))
        if len(rows):
            differ = self.raw[buffers.ragged_positions(at[rows], lengths[rows])] != data[buffers.ragged_positions(starts[rows], lengths[rows])]
            same[rows] = ~np.logical_or.reduceat(differ, np.cumsum(lengths[rows]) - lengths[rows])
        return same

    def _slots_of(self, distinct: pa.Array) -> np.ndarray:
        data, ends = np.frombuffer(distinct.buffers()[2], np.uint8), np.frombuffer(distinct.buffers()[1], np.int64)
        ends = ends[distinct.offset : distinct.offset + len(distinct) + 1]
        data, ends = data[ends[0] : ends[-1]], ends - ends[0]
        key = buffers.range_hashes(data, ends[:-1], ends[1:])
        if self.known + len(key) > self.limit:
            self.forget()
        hit, slots = np.zeros(len(key), bool), np.zeros(len(key), np.int64)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit, slots = self.keys[at] == key, self.slots[at]
        same_key = hit.copy()
        hit[hit] = self._same(slots[hit], data, ends[:-1][hit], np.diff(ends)[hit])
        new = np.flatnonzero(~hit)
        if len(new):
            slots[new] = self._learn(distinct.take(pa.array(new)).to_pylist())
            fresh = new[~same_key[new]]
            fresh = fresh[np.argsort(key[fresh], kind="stable")]
            place = np.searchsorted(self.keys, key[fresh])
            self.keys, self.slots = (np.insert(a, place, b[fresh]) for a, b in ((self.keys, key), (self.slots, slots)))
        return slots

    def run(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of all documents end to end, and each document's offsets in them."""
        codes, distinct, per_doc = buffers.segments(data, offsets)
        if not len(codes):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        of = self._slots_of(distinct)[codes]
        lengths = self.lengths[of].astype(np.int64)
        ids = self.ids[buffers.ragged_positions(self.starts[of], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return ids, ends[np.concatenate([[0], np.cumsum(per_doc)])]

    def documents(self, texts: pa.Array):
        """Yield (first document, ids, offsets) for runs of documents."""
        data, offsets = buffers.utf8(texts)
        for first, last in buffers.runs_of_documents(offsets, self.run_bytes):
            part = offsets[first : last + 1]
            yield first, *self.run(data[part[0] : part[-1]], part - part[0])

"""Matroska media columns: EBML elements, clusters, lacing and cues as packet tables.

``mux`` stores bytes as 8-bit PCM samples in a Matroska stream; ``read_packets`` parses any stream made
of variable-length elements into packets with track, timestamp and byte range.
"""

from __future__ import annotations

import functools
import struct
import zlib
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Element ids of the container.  Fixed values.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
BLOCK_GROUP, BLOCK, SIMPLE_BLOCK, TIMESTAMP = 0xA0, 0xA1, 0xA3, 0xE7
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, FLAG_LACING = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x9C
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE, DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
#: Elements that hold elements.
MASTERS = {EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES, BLOCK_GROUP, TRACK_ENTRY, AUDIO, CUE_POINT, CUE_TRACK_POSITIONS}
#: Elements that end a cluster or segment of unknown size.
_TOP = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367}

#: 8000 samples a second: one sample lasts 125 microseconds, so timestamps count samples.
RATE = 8000
SCALE = 1_000_000_000 // RATE
#: Samples of a frame, frames laced into a block, and blocks of a cluster.
FRAME, LACED, BLOCKS = 1024, 4, 7
PAD = 64


def size_code(n: int) -> bytes:
    """``n`` as a variable-length integer of the fewest bytes; all ones is kept for unknown sizes."""
    width = 1
    while n >= (1 << 7 * width) - 1:
        width += 1
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(tag: int, body: bytes) -> bytes:
    return tag.to_bytes((tag.bit_length() + 7) // 8, "big") + size_code(len(body)) + body


def number(tag: int, value: int) -> bytes:
    return element(tag, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def _lace(frames: list[bytes]) -> bytes:
    """EBML lacing: count, first size, signed size differences, then the frames."""
    out = [bytes([len(frames) - 1]), size_code(len(frames[0]))]
    for before, frame in zip(frames[:-2], frames[1:-1], strict=True):
        step, width = len(frame) - len(before), 1
        while not -((1 << 7 * width - 1) - 1) <= step <= (1 << 7 * width - 1) - 1:
            width += 1
        out.append((step + (1 << 7 * width - 1) - 1 | 1 << 7 * width).to_bytes(width, "big"))
    return b"".join(out + frames)


def build(payload: bytes, frame: int = FRAME) -> bytes:
    """One Matroska stream with ``payload`` as the samples of a mono 8-bit PCM track."""
    head = element(EBML, number(EBML_VERSION, 1) + number(EBML_READ_VERSION, 1) + number(EBML_MAX_ID, 4) + number(EBML_MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + number(DOC_TYPE_VERSION, 4) + number(DOC_TYPE_READ, 2))
    info = element(INFO, number(TIMESTAMP_SCALE, SCALE) + element(DURATION, struct.pack(">d", len(payload))) + element(MUXING_APP, b"columns") + element(WRITING_APP, b"columns"))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + number(CHANNELS, 1) + number(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + number(FLAG_LACING, 1) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio))
    body, at, cues = [info, tracks], len(info) + len(tracks), []
    step, group = frame * LACED, frame * LACED * BLOCKS
    for begin in range(0, len(payload), group):
        blocks = [number(TIMESTAMP, begin)]
        for b in range(begin, min(begin + group, len(payload)), step):
            frames = [payload[f : f + frame] for f in range(b, min(b + step, len(payload)), frame)]
            laced = len(frames) > 1
            blocks.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", b - begin, 0x80 | (0x06 if laced else 0)) + (_lace(frames) if laced else frames[0])))
        cluster = element(CLUSTER, b"".join(blocks))
        cues.append(element(CUE_POINT, number(CUE_TIME, begin) + element(CUE_TRACK_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER_POSITION, at))))
        body.append(cluster)
        at += len(cluster)
    return head + element(SEGMENT, b"".join([*body, element(CUES, b"".join(cues))]))


def _vint(raw, at: int) -> tuple[int, int, bool]:
    """(value, next place, whether all value bits are ones)."""
    first = raw[at]
    if not first:
        raise ValueError(f"no variable-length integer at {at}")
    width = 9 - first.bit_length()
    value = int.from_bytes(raw[at : at + width], "big") & ((1 << 7 * width) - 1)
    if at + width > len(raw):
        raise ValueError(f"cut off at {at}")
    return value, at + width, value == (1 << 7 * width) - 1


def elements(raw, begin: int = 0, end: int | None = None):
    """Yield (id, begin, body begin, body end) of all elements in document order; unknown sizes are resolved."""
    end = len(raw) if end is None else end
    stack = [(None, end, False)]
    at = begin
    while True:
        while len(stack) > 1 and at >= stack[-1][1]:
            stack.pop()
        if at >= end:
            return
        first = raw[at]
        width = 9 - first.bit_length() if first else 9
        if width > 4:
            raise ValueError(f"no element id at {at}")
        tag = int.from_bytes(raw[at : at + width], "big")
        size, body, unknown = _vint(raw, at + width)
        while len(stack) > 1 and stack[-1][2] and (tag in (EBML, SEGMENT) or stack[-1][0] == CLUSTER and tag in _TOP):
            stack.pop()
        to = stack[-1][1] if unknown else body + size
        if to > stack[-1][1]:
            raise ValueError(f"element {tag:x} at {at} runs past its parent")
        yield tag, at, body, to
        if tag in MASTERS:
            stack.append((tag, to, unknown))
            at = body
        else:
            at = to


def _frames(raw, begin: int, end: int) -> tuple[int, int, bool, list[tuple[int, int]]]:
    """(track, relative time, keyframe flag, byte ranges of the frames) of a block."""
    track, at, _ = _vint(raw, begin)
    (time,) = struct.unpack_from(">h", raw, at)
    flags = raw[at + 2]
    at += 3
    lacing = flags >> 1 & 3
    if not lacing:
        return track, time, bool(flags & 0x80), [(at, end)]
    count = raw[at] + 1
    at += 1
    sizes: list[int] = []
    if lacing == 2:
        if (end - at) % count:
            raise ValueError("frames of a fixed lace differ")
        sizes = [(end - at) // count] * (count - 1)
    elif lacing == 1:
        for _ in range(count - 1):
            size = 0
            while raw[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + raw[at])
            at += 1
    else:
        for k in range(count - 1):
            value, after, _ = _vint(raw, at)
            sizes.append(value if k == 0 else sizes[-1] + value - ((1 << 7 * (after - at) - 1) - 1))
            at = after
    ranges = []
    for size in sizes:
        if size < 0 or at + size > end:
            raise ValueError("a lace runs past its block")
        ranges.append((at, at + size))
        at += size
    return track, time, bool(flags & 0x80), [*ranges, (at, end)]


def _value(raw, begin: int, end: int) -> int:
    if end - begin > 8:
        raise ValueError(f"a number of {end - begin} bytes at {begin}")
    return int.from_bytes(raw[begin:end], "big")


def children(raw, begin: int, end: int):
    """Yield (id, begin, body begin, body end) of the elements of one level; bodies are stepped over, not read."""
    at = begin
    while at < end:
        first = raw[at]
        width = 9 - first.bit_length() if first else 9
        if width > 4:
            raise ValueError(f"no element id at {at}")
        size, body, unknown = _vint(raw, at + width)
        to = end if unknown else body + size
        if to > end:
            raise ValueError(f"an element at {at} runs past its parent")
        yield int.from_bytes(raw[at : at + width], "big"), at, body, to
        at = to


def _checked(read):
    """Whatever damage a stream has, ``read`` raises ValueError."""

    @functools.wraps(read)
    def run(raw, *rest):
        if raw is None:
            raise ValueError("no stream")
        try:
            return read(memoryview(raw), *rest)
        except (IndexError, TypeError, OverflowError, struct.error, UnicodeDecodeError) as e:
            raise ValueError(f"damaged stream: {e}") from e

    return run


@_checked
def read_packets(raw: bytes) -> dict:
    """Packets, tracks, cues and clusters of a stream.

    packets: (track, block timestamp in nanoseconds, place in its lace, key, begin, end); cues: (timestamp,
    track, cluster's place in the file); tracks: {number: codec}; clusters: {place: timestamp}; scale and segment
    (where its body begins).  Damaged streams raise ValueError.
    """
    scale, cluster, base, at = 1_000_000, 0, 0, 0
    packets, cues, tracks, cue, track = [], [], {}, [0, 0], 0
    clusters = {}
    for tag, start, begin, end in elements(raw):
        if tag == SEGMENT:
            base = begin
        elif tag == TIMESTAMP_SCALE:
            scale = _value(raw, begin, end)
        elif tag == CLUSTER:
            cluster, at = 0, start
            clusters[at] = 0
        elif tag == TIMESTAMP:
            cluster = _value(raw, begin, end)
            clusters[at] = cluster * scale
        elif tag in (SIMPLE_BLOCK, BLOCK):
            number_, time, key, ranges = _frames(raw, begin, end)
            packets += [(number_, (cluster + time) * scale, k, key, a, b) for k, (a, b) in enumerate(ranges)]
        elif tag == TRACK_NUMBER:
            track = _value(raw, begin, end)
        elif tag == CODEC_ID:
            tracks[track] = bytes(raw[begin:end]).decode("ascii")
        elif tag == CUE_TIME:
            cue[0] = _value(raw, begin, end)
        elif tag == CUE_TRACK:
            cue[1] = _value(raw, begin, end)
        elif tag == CUE_CLUSTER_POSITION:
            cues.append((cue[0] * scale, cue[1], base + _value(raw, begin, end)))
    return {"packets": packets, "tracks": tracks, "cues": cues, "clusters": clusters, "scale": scale, "segment": base}


@_checked
def seek(raw: bytes, timestamp_ns: int, track: int = 1) -> list[tuple]:
    """The packets of the cluster that the cues name for a time: the last cue at or before it.

    Only the headers on the segment's level, the cues and that one cluster are read.  Without a cue that
    early there are none.
    """
    segment = next(((b, e) for tag, _, b, e in children(raw, 0, len(raw)) if tag == SEGMENT), None)
    if segment is None:
        raise ValueError("no segment")
    scale, best = 1_000_000, None
    tops = list(children(raw, *segment))
    for tag, _, b, e in tops:
        if tag == INFO:
            scale = next((_value(raw, x, y) for t, _, x, y in children(raw, b, e) if t == TIMESTAMP_SCALE), scale)
    for tag, _, b, e in tops:
        for t, _, x, y in children(raw, b, e) if tag == CUES else ():
            if t == CUE_POINT:
                point = {name: (p, q) for name, _, p, q in children(raw, x, y)}
                at = {name: _value(raw, p, q) for name, _, p, q in children(raw, *point[CUE_TRACK_POSITIONS])}
                time = _value(raw, *point[CUE_TIME]) * scale
                if at.get(CUE_TRACK, track) == track and time <= timestamp_ns and (best is None or time >= best[0]):
                    best = (time, segment[0] + at[CUE_CLUSTER_POSITION])
    if best is None:
        return []
    tag, _, b, e = next(children(raw, best[1], segment[1]))
    if tag != CLUSTER:
        raise ValueError("a cue names no cluster")
    base, out = 0, []
    for t, _, x, y in elements(raw, b, e):
        if t == TIMESTAMP:
            base = _value(raw, x, y)
        elif t in (SIMPLE_BLOCK, BLOCK):
            number_, time, key, ranges = _frames(raw, x, y)
            out += [(number_, (base + time) * scale, k, key, p, q) for k, (p, q) in enumerate(ranges) if number_ == track]
    return out


def payload_of(raw: bytes, track: int = 1) -> bytes:
    view = memoryview(raw)
    return b"".join(view[a:b] for t, _, _, _, a, b in read_packets(raw)["packets"] if t == track)


def mux(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (binary): each whole text as a Matroska stream.

    The payload is the text in UTF-8 (null: none) with bytes 0 up to a positive multiple of 64; it depends
    on the text alone, so equal texts give equal streams.  Rows map one to one; other columns are left out.
    """

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at in range(0, len(texts), 256):
                raws = [(x.as_py() or "").encode() for x in texts.slice(at, 256)]
                media = [build(x + bytes(-len(x) % PAD if x else PAD)) for x in raws]
                yield pa.RecordBatch.from_arrays([ids.slice(at, 256), pa.array([len(x) for x in raws], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


PACKETS = "doc_id long, track int, timestamp_ns long, lace int, key boolean, begin long, end long, error string"


def packets(media: DataFrame) -> DataFrame:
    """The packet table of a media column: one row per frame, with its byte range in the stream.

    ``media`` has doc_id and media.  A null or damaged stream gives one row with the reason in ``error`` and
    null elsewhere; of other rows ``error`` is null.
    """
    names = [f.split()[0] for f in PACKETS.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.string()]

    def run(batches):
        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    found = [(*p, None) for p in read_packets(raw.as_py())["packets"]]
                except ValueError as e:
                    found = [(None,) * 6 + (str(e),)]
                if found:
                    columns = [[doc] * len(found), *zip(*found, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return media.select("doc_id", "media").mapInArrow(run, PACKETS)


def _feature(samples: np.ndarray, found: dict) -> str:
    """Packets, clusters, cues that name a cluster of their time, samples, peak, sum and zero-crossing count of the samples."""
    centred = samples.astype(np.int16) - 128
    crossings = int(np.count_nonzero((centred[1:] < 0) != (centred[:-1] < 0)))
    good = sum(found["clusters"].get(place) == time for time, _, place in found["cues"])
    return f"packets={len(found['packets'])};clusters={len(found['clusters'])};cues={good};samples={len(samples)};peak={int(np.abs(centred).max(initial=0))};sum={int(centred.sum())};crossings={crossings}"


def read_back(media: DataFrame) -> DataFrame:
    """Per row of doc_id, n_bytes, media: the payload read from its packets, and features of the samples.

    The packets of the last cluster are also reached through the cues, and must be those of the whole reading.  A null
    or damaged stream gives a row with the reason in ``error``, and nulls where its payload would be told.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    names = [f.split()[0] for f in schema.split(", ")]

    def told(raw: bytes | None) -> tuple:
        stored = (None, None) if raw is None else (len(raw), sha256(raw).hexdigest())
        try:
            found = read_packets(raw)
            last = max((time for time, *_ in found["cues"]), default=None)
            if last is not None and seek(raw, last) != [p for p in found["packets"] if p[0] == 1 and p[1] >= last]:
                raise ValueError("the cues name another cluster")
        except ValueError as e:
            return None, None, None, *stored, None, str(e)
        view = memoryview(raw)
        payload = b"".join(view[a:b] for t, _, _, _, a, b in found["packets"] if t == 1)
        return len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), *stored, _feature(np.frombuffer(payload, np.uint8), found), None

    def run(batches):
        for batch in batches:
            rows = [(doc, n, *told(cell.as_py())) for doc, n, cell in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)

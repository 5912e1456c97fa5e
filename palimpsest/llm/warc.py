"""WARC archives in seekable Zstandard bundles.

Records are grouped into independent frames; a footer table of frame sizes and checksums (the public seekable
format) lets any reader inflate one frame alone, and an index maps each record's identifier to its frame and the
place inside it.  A bundle is one row of a table, so Spark's committer makes the write survive lost tasks.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import buffers
from palimpsest.llm.common import SENT_ROWS
from palimpsest.scratch import scratch, stored

#: Of the public seekable format: the skippable frame of the seek table, and the last four bytes of a file.  Fixed values.
SEEK_FRAME, SEEK_MAGIC = 0x184D2A5E, 0x8F92EAB1
#: Bit of the descriptor that says that each entry has a checksum.
_CHECKED = 0x80
#: Named by the WARC standard for records whose payload equals an earlier one's.  Fixed value.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads shorter than this are always stored.
LEAST = 100
#: Bytes of records after which a frame is closed, and bytes of frames (compressed) after which a bundle is.
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 8 << 20
LEVEL = 3
BUNDLES = "part int, bundle int, n_records int, file binary, index array<struct<record_id:string,page_id:long,frame:int,begin:int,length:int,refers_to:long>>"


def record_id(page_id: int | None, digest: str) -> str:
    """The record's identifier: page and payload decide it."""
    return f"urn:x-page:{'' if page_id is None else page_id}:{digest[:16]}"


def page_of(name: str) -> int | None:
    """The page that an identifier of ``record_id`` names."""
    page = name.strip("<>").split(":")[2]
    return int(page) if page else None


def _plain(url: str) -> str:
    """A URL without bytes that would end or split a header line."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; without a payload it is a revisit of the page ``refers_to``, which has the same payload.

    The HTTP header of a revisit is kept, and so tells the payload's length.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if payload is None else 'response'}", f"WARC-Record-ID: <{record_id(page_id, digest)}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_plain(url)}")
    if payload is None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{record_id(refers_to, digest)}>"]
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _fields(raw: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in raw.decode().split("\r\n")[1:] if ": " in line)


def parse(raw: bytes, at: int = 0) -> tuple[dict[str, str], int, bytes, int]:
    """(WARC header fields, payload length told by HTTP, the stored payload, where the next record begins)."""
    if raw[at : at + 5] != b"WARC/":
        raise ValueError("no record begins here")
    stop = raw.find(b"\r\n\r\n", at)
    fields = _fields(raw[at:stop])
    begin = stop + 4
    end = begin + int(fields["Content-Length"])
    split = raw.find(b"\r\n\r\n", begin, end)
    if stop < 0 or split < 0 or raw[end : end + 4] != b"\r\n\r\n":
        raise ValueError("a damaged record")
    size = int(_fields(raw[begin:split])["Content-Length"])
    return fields, size, raw[split + 4 : end], end + 4


class Bundle:
    """A seekable file under construction: records gather into a frame, frames into the file."""

    def __init__(self, frame_bytes: int = FRAME_BYTES):
        self.frame_bytes, self.pack = frame_bytes, zstandard.ZstdCompressor(level=LEVEL)
        self.frames: list[bytes] = []
        self.table: list[bytes] = []
        self.index: list[tuple[str, int | None, int, int, int, int | None]] = []
        self.open: list[bytes] = []
        self.held = self.size = 0

    def add(self, raw: bytes, name: str, page_id: int | None, refers_to: int | None) -> None:
        """A record; one that would overfill the open frame begins the next, and one longer than a frame has a frame of its own."""
        if self.held and self.held + len(raw) > self.frame_bytes:
            self.close_frame()
        self.index.append((name, page_id, len(self.frames), self.held, len(raw), refers_to))
        self.open.append(raw)
        self.held += len(raw)

    def close_frame(self) -> None:
        if not self.open:
            return
        raw = b"".join(self.open)
        frame = self.pack.compress(raw)
        self.frames.append(frame)
        self.table.append(struct.pack("<III", len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.size += len(frame)
        self.open, self.held = [], 0

    def file(self) -> bytes:
        self.close_frame()
        entries = b"".join(self.table)
        footer = struct.pack("<IBI", len(self.table), _CHECKED, SEEK_MAGIC)
        return b"".join(self.frames) + struct.pack("<II", SEEK_FRAME, len(entries) + len(footer)) + entries + footer


class Archive:
    """Random access to the frames of a bundle's file by its seek table; only the footer is read at first."""

    def __init__(self, raw: bytes):
        self.raw = raw
        if len(raw) < 17:
            raise ValueError("too short for a seek table")
        n, how, magic = struct.unpack_from("<IBI", raw, len(raw) - 9)
        width = 12 if how & _CHECKED else 8
        at = len(raw) - 9 - n * width
        if magic != SEEK_MAGIC or at < 8 or struct.unpack_from("<II", raw, at - 8) != (SEEK_FRAME, n * width + 9):
            raise ValueError("no seek table at the end")
        self.places, begin = [], 0
        for k in range(n):
            packed, size = struct.unpack_from("<II", raw, at + k * width)
            check = struct.unpack_from("<I", raw, at + k * width + 8)[0] if width == 12 else None
            self.places.append((begin, packed, size, check))
            begin += packed
        if begin != at - 8:
            raise ValueError("the frames don't fill the file")

    def frame(self, k: int) -> bytes:
        """One frame's records, inflated alone and held against its checksum."""
        begin, packed, size, check = self.places[k]
        out = zstandard.ZstdDecompressor().decompress(self.raw[begin : begin + packed], max_output_size=size)
        if len(out) != size or (check is not None and xxhash.xxh64_intdigest(out) & 0xFFFFFFFF != check):
            raise ValueError(f"frame {k} is damaged")
        return out

    def records(self) -> Iterator[tuple[dict[str, str], int, bytes]]:
        """(WARC fields, payload length, stored payload) of all records in order, frame by frame."""
        for k in range(len(self.places)):
            raw, at = self.frame(k), 0
            while at < len(raw):
                fields, size, payload, at = parse(raw, at)
                yield fields, size, payload


def plan(pages: DataFrame) -> DataFrame:
    """page_id, url, raw (binary), digest, refers_to: ``refers_to`` is null for what is stored as a response.

    Of rows with equal payloads of at least 100 bytes the smallest page_id is stored; its other rows of that payload
    and id (repeated rows) are stored as well, as nothing could tell a revisit from what it revisits.  Null ids give
    way to any other; where all ids of a payload are null, all its rows are stored.  Digests are counted where the pages
    lie; only those that repeat travel on.  At most ``common.SENT_ROWS`` of them are sent to the tasks; more are
    joined by a shuffle, whose hot keys AQE splits.
    """
    raw = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), raw.alias("raw"), F.sha2(raw, 256).alias("digest"))
    long_enough = rows.where(F.octet_length("raw") >= LEAST)
    first = stored(long_enough.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("digest", "first"), "payloads")
    first = F.broadcast(first) if first.count() <= SENT_ROWS else first
    other = F.when(F.coalesce(F.col("page_id") != F.col("first"), F.col("first").isNotNull()), F.col("first"))
    return rows.join(first, "digest", "left").select("page_id", "url", "raw", "digest", other.alias("refers_to"))


def write_bundles(pages: DataFrame, path: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> None:
    """Write a record for each row of ``pages`` (page_id, url, html; other columns are left out) as bundles with their index.

    A null html is an empty payload, a null url no header line.  Records stand in the order of the rows; a task holds
    one open bundle.
    """

    def run(batches):
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        bundle = Bundle(frame_bytes)

        def closed():
            nonlocal bundle, made
            file = bundle.file()
            names = ("record_id", "page_id", "frame", "begin", "length", "refers_to")
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
            entries = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(zip(*bundle.index, strict=True), kinds, strict=True)], names=names)
            index = pa.ListArray.from_arrays(pa.array([0, len(entries)], pa.int32()), entries)
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([made], pa.int32()), pa.array([len(entries)], pa.int32()), pa.array([file], pa.binary()), index], names=["part", "bundle", "n_records", "file", "index"])
            bundle, made = Bundle(frame_bytes), made + 1
            return out

        for batch in buffers.slices(batches, 200):
            pages_, urls, raws, digests, refers = batch.columns
            for k in range(batch.num_rows):
                page, digest, to = pages_[k].as_py(), digests[k].as_py(), refers[k].as_py()
                raw = raws[k].as_py()
                bundle.add(record(page, urls[k].as_py(), raw if to is None else None, len(raw), digest, to), record_id(page, digest), page, to)
                if bundle.size >= bundle_bytes:
                    yield closed()
        if bundle.index:
            yield closed()

    plan(pages).mapInArrow(buffers.tidy(run), BUNDLES).write.option("compression", "none").parquet(path)


def bundles_at(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BUNDLES).parquet(path)


def read_back(bundles: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record, read from the bundles' files alone.

    A stored payload is hashed again and must be as its header says; a revisit tells length and digest of what it revisits.
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def run(batches):
        for batch in batches:
            for cell in batch.column(0):
                rows = []
                for fields, size, payload in Archive(cell.as_py()).records():
                    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"]
                    if kind == "response" and (len(payload) != size or sha256(payload).hexdigest() != digest):
                        raise ValueError("a payload isn't what its header says")
                    rows.append((page_of(fields["WARC-Record-ID"]), size, digest, kind, page_of(fields["WARC-Refers-To"]) if kind == "revisit" else None))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return bundles.select("file").mapInArrow(buffers.tidy(run), schema)


def index_of(bundles: DataFrame) -> DataFrame:
    """record_id, page_id, part, bundle, frame, begin, length, refers_to: where each record stands."""
    return bundles.select("part", "bundle", F.explode("index").alias("at")).select("at.record_id", "at.page_id", "part", "bundle", "at.frame", "at.begin", "at.length", "at.refers_to")


def fetch(bundles: DataFrame, wanted: DataFrame) -> DataFrame:
    """page_id, payload (binary) of the pages in ``wanted`` (page_id), each through the index and the one frame that holds it.

    A revisit gives the payload of the record that it names.  Pages that the index doesn't know and null ids give no
    row; a page that stands in several records gives a row for each.  The places wanted of a bundle are as many as its
    records at most, so one row of them goes to each bundle.
    """
    index = index_of(bundles)
    asked = wanted.select("page_id").distinct().join(index, "page_id").select(F.col("page_id").alias("asked"), "record_id", "refers_to", "part", "bundle", "frame", "begin", "length")
    direct = asked.where(F.col("refers_to").isNull()).select("asked", "part", "bundle", "frame", "begin", "length")
    # The record named by a revisit has its payload's digest in its identifier.
    named = asked.where(F.col("refers_to").isNotNull()).select("asked", F.concat(F.lit("urn:x-page:"), F.col("refers_to"), F.lit(":"), F.substring_index("record_id", ":", -1)).alias("record_id"))
    held = index.where(F.col("refers_to").isNull()).groupBy("record_id").agg(F.min(F.struct("part", "bundle", "frame", "begin", "length")).alias("at"))
    through = named.join(held, "record_id").select("asked", "at.*")
    spots = direct.unionByName(through)
    # Many pages may revisit one record: it is read once, and its payload then meets those that asked for it.
    keys = ["part", "bundle", "frame", "begin", "length"]
    places = spots.select(keys).distinct().groupBy("part", "bundle").agg(F.sort_array(F.collect_list(F.struct("frame", "begin", "length"))).alias("places"))

    def run(batches):
        for batch in batches:
            part, bundle, file, places_ = batch.columns
            for k in range(batch.num_rows):
                archive, held_frame, raw = Archive(file[k].as_py()), None, b""
                for spot in places_[k].as_py():
                    if spot["frame"] != held_frame:
                        held_frame, raw = spot["frame"], archive.frame(spot["frame"])
                    payload = parse(raw[spot["begin"] : spot["begin"] + spot["length"]])[2]
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((part[k].as_py(), pa.int32()), (bundle[k].as_py(), pa.int32()), (spot["frame"], pa.int32()), (spot["begin"], pa.int32()), (spot["length"], pa.int32()), (payload, pa.binary()))], names=[*keys, "payload"])

    read = bundles.select("part", "bundle", "file").join(places, ["part", "bundle"]).mapInArrow(run, "part int, bundle int, frame int, begin int, length int, payload binary")
    return spots.join(read, keys).select(F.col("asked").alias("page_id"), "payload")


def archive(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``pages`` as bundles (to ``path``, or to scratch space) and read every record back."""
    path = path or scratch(pages.sparkSession, "warc")
    write_bundles(pages, path)
    return read_back(bundles_at(pages.sparkSession, path))

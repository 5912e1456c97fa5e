"""A data source for lines of gzip files of many members, read in parallel.

A gzip file can't be split, but a file of many members (as parallel compressors and appending writers make) can: each
task takes the members that begin in its range of bytes.  A line may cross members and ranges: a task leaves the rest of a
line that began before its range to the task before, which reads on until that line ends.
"""

from __future__ import annotations

import glob
import os
import zlib
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "value string, error string"
#: How a member begins, by the format: two magic bytes, and deflate as the method.  Fixed values.
_MAGIC = b"\x1f\x8b\x08"
_CHUNK = 1 << 18


def _plausible(file, at: int, check: bool) -> bool:
    """Whether a member begins at ``at``: its reserved flags are clear and it inflates, all of it with the right checksum if ``check``."""
    file.seek(at)
    head = file.read(_CHUNK)
    if len(head) < 18 or not head.startswith(_MAGIC) or head[3] & 0xE0:
        return False
    unpack = zlib.decompressobj(31)
    try:
        unpack.decompress(head, _CHUNK)
        while check and not unpack.eof:
            rest = unpack.unconsumed_tail or file.read(_CHUNK)
            if not rest:
                return False
            unpack.decompress(rest, _CHUNK)
    except zlib.error:
        return False
    return True


def next_member(file, at: int, end: int, check: bool = True) -> int | None:
    """The first place from ``at`` and before ``end`` where a member begins; what only looks like one is passed over."""
    while at < end:
        file.seek(at)
        block = file.read(min(_CHUNK, end - at) + len(_MAGIC) - 1)
        if len(block) < len(_MAGIC):
            return None
        found = block.find(_MAGIC)
        if found < 0:
            at += max(1, len(block) - len(_MAGIC) + 1)
        elif at + found < end and _plausible(file, at + found, check):
            return at + found
        else:
            at += found + 1
    return None


def member_bytes(file, at: int) -> Iterator[bytes | int]:
    """The bytes of the member at ``at`` in pieces, and then the place after it; -1 in place of that if it is damaged."""
    file.seek(at)
    unpack, read = zlib.decompressobj(31), at
    try:
        while not unpack.eof:
            raw = unpack.unconsumed_tail
            if not raw:
                raw = file.read(_CHUNK)
                read += len(raw)
            if not raw:
                yield -1
                return
            piece = unpack.decompress(raw, _CHUNK)
            if piece:
                yield piece
    except zlib.error:
        yield -1
        return
    yield read - len(unpack.unused_data)


def lines(path: str, begin: int, end: int) -> Iterator[tuple[str | None, str | None]]:
    """(value, error) of the lines that begin in the members of a range, the last one read to its end.

    A damaged member gives a row with ``error``; the line in which it breaks off is lost, and reading goes on with the
    next member's next line.  Bytes that aren't UTF-8 become replacement characters.
    """
    with open(path, "rb") as file:
        size = os.fstat(file.fileno()).st_size
        at = next_member(file, begin, min(end, size))
        if at is None:
            if begin == 0 and size:
                yield None, "no member at byte 0"
            return
        # The line that goes on from before the range belongs to another task; a first range has none.
        held: list[bytes] = []
        skipping, ending = at > 0, False
        if begin == 0 and at > 0:
            yield None, "no member at byte 0"
        while at is not None and at < size:
            if at >= end:
                ending = True
            after = -1
            for piece in member_bytes(file, at):
                if isinstance(piece, int):
                    after = piece
                    break
                parts = piece.split(b"\n")
                for k, part in enumerate(parts):
                    if k:
                        if not skipping:
                            yield b"".join(held).decode("utf-8", "replace"), None
                        held, skipping = [], False
                        if ending:
                            return
                    if part and not skipping:
                        held.append(part)
            if after < 0:
                yield None, f"damaged member at byte {at}"
                if ending:
                    return
                held, skipping = [], True
                at = next_member(file, at + 1, size)
            else:
                at = after if after >= size or file.seek(after) is None or file.read(3) == _MAGIC else next_member(file, after, size)
        if held and not skipping:
            yield b"".join(held).decode("utf-8", "replace"), None


class Range(InputPartition):
    def __init__(self, path: str, begin: int, end: int):
        self.path, self.begin, self.end = path, begin, end


class GzipReader(DataSourceReader):
    def __init__(self, options: dict):
        self.where, self.width = options["path"].removeprefix("file://").removeprefix("file:"), int(options.get("split_bytes", 64 << 20))

    def partitions(self) -> list[Range]:
        paths = sorted(glob.glob(f"{self.where}/*.gz") if os.path.isdir(self.where) else glob.glob(self.where))
        return [Range(p, a, a + self.width) for p in paths for a in range(0, max(1, os.path.getsize(p)), self.width)]

    def read(self, partition: Range) -> Iterator[tuple]:
        yield from lines(partition.path, partition.begin, partition.end)


class GzipLines(DataSource):
    """Format ``gzip_members``: value and error of each line; options path (a file, pattern or folder that all tasks see) and split_bytes."""

    @classmethod
    def name(cls) -> str:
        return "gzip_members"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> GzipReader:
        return GzipReader(self.options)


def register(spark: SparkSession) -> None:
    """Make ``spark.read.format("gzip_members")`` known to a session."""
    spark.dataSource.register(GzipLines)

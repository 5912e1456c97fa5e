"""Fill-in-middle by secondary sort: pieces keyed by document and output position stream into texts or digests.

A text is cut into units (runs of ASCII letters, and single other characters).  Its prefix, middle and suffix are
emitted as pieces of whole units, each under its place in the output; one
``repartitionAndSortWithinPartitions`` brings a document's pieces together in that order, so that a task holds a
piece at a time.  Sorting the same partitions again by section and place restores the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256
from itertools import groupby

import numpy as np
from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: What stands before prefix, suffix and middle in an output, and the section's place in the text.
MARKS = {b"<P>": 0, b"<M>": 1, b"<S>": 2}
#: Units of a piece, and bytes after which a piece is cut even inside a unit.
UNITS, PIECE_BYTES = 8192, 1 << 16
#: Bytes of text for each partition of the sort.
PARTITION_BYTES = 256 << 20
#: Hundredths that stay plain, and of the others those that begin with the suffix.
PLAIN_FROM, SUFFIX_FIRST = 90, 20

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True

ROWS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


def unit_starts(data: np.ndarray) -> np.ndarray:
    """Where the units of a UTF-8 text begin: at a letter after no letter, and at every other character's first byte."""
    letter = _LETTER[data]
    first = (data & 0xC0) != 0x80
    first[1:] &= ~(letter[1:] & letter[:-1])
    return np.flatnonzero(first)


def draws(doc_id: int | None, seed: int = 1) -> tuple[int, int, int, int]:
    """Four 32-bit numbers that the seed and the id decide (a null id: the seed alone)."""
    raw = sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(raw[k : k + 4], "big") for k in (0, 4, 8, 12))


def layout(doc_id: int | None, raw: bytes, n: int, seed: int = 1) -> tuple[str, int, int]:
    """(form, units before the end of the prefix, units before the end of the middle)."""
    h1, h2, h3, h4 = draws(doc_id, seed)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not raw or any(m in raw for m in MARKS) or h3 % 100 >= PLAIN_FROM:
        return "plain", 0, 0
    return "spm" if h4 % 100 < SUFFIX_FIRST else "psm", low, high


def chunks(raw: bytes, starts: np.ndarray, first: int, last: int) -> Iterator[tuple[int, bytes]]:
    """(units that begin in it, bytes) of the pieces of the units ``first`` to ``last`` - 1."""
    end_of = lambda k: int(starts[k]) if k < len(starts) else len(raw)
    for at in range(first, last, UNITS):
        to = min(last, at + UNITS)
        begin, end = end_of(at), end_of(to)
        for cut in range(begin, end, PIECE_BYTES):
            stop = min(end, cut + PIECE_BYTES)
            yield int(np.searchsorted(starts, stop) - np.searchsorted(starts, cut)), raw[cut:stop]


def pieces_of(doc_id: int | None, raw: bytes, seed: int = 1) -> tuple[str, Iterator[tuple[int, bytes]]]:
    """(form, pieces in the order of the output, each with its count of units; marks have none)."""
    starts = unit_starts(np.frombuffer(raw, np.uint8))
    n = len(starts)
    form, low, high = layout(doc_id, raw, n, seed)
    prefix, middle, suffix = (b"<P>", 0, low), (b"<M>", low, high), (b"<S>", high, n)
    order = {"plain": [(b"", 0, n)], "psm": [prefix, suffix, middle], "spm": [suffix, prefix, middle]}[form]

    def run():
        for mark, first, last in order:
            if mark:
                yield 0, mark
            yield from chunks(raw, starts, first, last)

    return form, run()


def by_document(key: tuple) -> int:
    """All pieces of a document share the first part of their key, which is hashed already."""
    return int.from_bytes(key[0][:7], "big")


def _emit(seed: int):
    def run(part: int, rows) -> Iterator:
        copies: dict[bytes, int] = {}
        for doc_id, text in rows:
            raw = (text or "").encode()
            same = blake2b(raw, digest_size=16, key=repr(doc_id).encode()).digest()
            # Repeated rows stay apart by number and input partition, whatever their order in a second run of the task.
            copies[same] = copies.get(same, -1) + 1
            key = blake2b(same + part.to_bytes(4, "big") + copies[same].to_bytes(8, "big"), digest_size=16).digest()
            form, pieces = pieces_of(doc_id, raw, seed)
            yield (key, 0), (doc_id, form)
            for at, piece in enumerate(pieces, 1):
                yield (key, at), piece

    return run


def pieces(docs: DataFrame, seed: int = 1) -> RDD:
    """((document key, place), piece) sorted within partitions; place 0 holds (doc_id, form), others (units, bytes).

    ``docs`` has doc_id and text.  The texts' bytes are summed up first, as the number of partitions follows them; it
    is the session's shuffle partitions at least.  Each row is a document of its own, so no key gathers more than one text.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    wide = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION_BYTES))
    return rows.rdd.mapPartitionsWithIndex(_emit(seed)).repartitionAndSortWithinPartitions(wide, by_document)


def _documents(stream: Iterator) -> Iterator[tuple[bytes, Iterator]]:
    for key, items in groupby(stream, key=lambda x: x[0][0]):
        yield key, items


def _characters(raw: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80))


def _digest_outputs(stream: Iterator) -> Iterator:
    """Feeds each output to its digest, and sends each piece on under its section and place in the text."""
    for key, items in _documents(stream):
        _, (doc_id, form) = next(items)
        digest, n, section, chars = sha256(), 0, 0, [0, 0, 0]
        for (_, at), (units, raw) in items:
            digest.update(raw)
            n += units
            # The output tells its sections: where it isn't plain, a mark stands only before one.
            if form != "plain" and raw in MARKS:
                section = MARKS[raw]
            else:
                chars[section] += _characters(raw)
                yield (key, section, at), raw
        told = (None, None) if form == "plain" else (chars[0], chars[1])
        yield (key, len(MARKS), 0), (doc_id, n, form, *told, digest.hexdigest())


def _digest_restored(stream: Iterator) -> Iterator:
    for _, items in _documents(stream):
        digest = sha256()
        for (_, section, _), value in items:
            if section < len(MARKS):
                digest.update(value)
            else:
                yield *value, digest.hexdigest()


def measure(docs: DataFrame, seed: int = 1) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of each row of ``docs``.

    Null texts are empty and plain; null ids draw from the seed alone.  Repeated rows give a row each; other columns are
    left out.  The second sort has the first one's partitions, so its pieces aren't shuffled again.
    """
    out = pieces(docs, seed)
    wide = out.getNumPartitions()
    restored = out.mapPartitions(_digest_outputs, True).repartitionAndSortWithinPartitions(wide, by_document)
    return docs.sparkSession.createDataFrame(restored.mapPartitions(_digest_restored), StructType.fromDDL(ROWS), verifySchema=False)


def _join_outputs(stream: Iterator) -> Iterator:
    for _, items in _documents(stream):
        _, (doc_id, form) = next(items)
        yield doc_id, form, b"".join(raw for _, (_, raw) in items).decode()


def outputs(docs: DataFrame, seed: int = 1) -> DataFrame:
    """doc_id, form, output: the rearranged texts themselves; handling of rows as in ``measure``."""
    return docs.sparkSession.createDataFrame(pieces(docs, seed).mapPartitions(_join_outputs), StructType.fromDDL("doc_id long, form string, output string"), verifySchema=False)


def restored(output: Column, form: Column) -> Column:
    """The text that an output and its form come from."""
    part = F.split(output, "<[PSM]>", -1)
    # Before the first mark there is nothing; the middle is always last.
    return F.when(form == "plain", output).when(form == "psm", F.concat(part[1], part[3], part[2])).otherwise(F.concat(part[2], part[3], part[1]))

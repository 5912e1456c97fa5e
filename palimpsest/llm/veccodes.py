"""Vectors compressed to codes: each of equal parts is named by its nearest codebook entry.

Nearest entries come from an equal-average search.  Entries of a codebook are sorted by the sum of their components;
for a part of d components and sum s, (s - S)^2 / d is never more than its squared distance from an entry of sum S.
The search begins at the entry whose sum is nearest and expands on both sides until that bound strictly exceeds the
best distance, so the result is exact, ties included.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import buffers
from palimpsest.llm.common import SENT_ROWS
from palimpsest.scratch import drop, stored

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors that are searched together in a task.
BLOCK = 4096


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest row of ``book`` for each row of ``x``, the lower index on ties; integers."""
    n, d = x.shape
    sums = book.sum(axis=1)
    order = np.argsort(sums, kind="stable")
    sums, book = sums[order], book[order]
    own = x.sum(axis=1)
    right = np.searchsorted(sums, own)
    left = right - 1
    best, index = np.full(n, np.iinfo(np.int64).max // d), np.full(n, len(book), np.int64)
    rows = np.arange(n)
    while len(rows):
        going = np.zeros(len(rows), dtype=bool)
        for side, step in ((left, -1), (right, 1)):
            at = side[rows]
            inside = (at >= 0) & (at < len(book))
            r, a = rows[inside], at[inside]
            gap = own[r] - sums[a]
            # Further entries on this side have sums no nearer: beyond a strict excess none can be as good as the best.
            near = gap * gap <= best[r] * d
            r, a = r[near], a[near]
            step_to = x[r] - book[a]
            found = (step_to * step_to).sum(axis=1)
            better = (found < best[r]) | ((found == best[r]) & (order[a] < index[r]))
            best[r[better]], index[r[better]] = found[better], order[a[better]]
            side[r] += step
            going[np.flatnonzero(inside)[near]] = True
        rows = rows[going]
    return index, best


def _floors(vector: Column) -> Column:
    """floor(256 * x) of each component, as long; doubles hold it exactly."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE))


def _whole(vector: Column) -> Column:
    """Whether no component is null, infinite or not a number."""
    return F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))


def integers(table: DataFrame) -> DataFrame:
    """vec_id, label, x (integer components) of the rows whose ``embedding`` is neither null nor holds null or non-finite components."""
    kept = table.where(F.col("embedding").isNotNull() & _whole(F.col("embedding")))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), _floors(F.col("embedding")).alias("x"))


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def widest(dimension: int, parts: int) -> int:
    """The largest integer component with which no bound or distance can overflow 64 bits."""
    return (1 << 30) // (dimension // parts)


def _codable(dimension: int, parts: int) -> Column:
    """Rows of the common length whose components are within bounds."""
    return (F.size("x") == dimension) & ~F.exists("x", lambda c: (c > widest(dimension, parts)) | (c < -widest(dimension, parts)))


def _assigned(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of each part's entry, squared distance summed over parts) of each vector."""
    width = x.shape[1] // len(books)
    index, error = np.empty((len(x), len(books)), np.int64), np.zeros(len(x), np.int64)
    for p, book in enumerate(books):
        index[:, p], far = nearest(x[:, p * width : (p + 1) * width], book)
        error += far
    return index, error


def fit(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks (parts x entries x components) over all rows of ``kept`` (vec_id, x); None for no row.

    They begin as the parts of the ``entries`` smallest vec_ids (null ids last, ties by components), all of them if
    there are fewer; then each round replaces an entry by the floor of its parts' mean.  Tasks send sums and counts for
    each part and entry, and the driver gets one row for each: parts x entries at most.
    """
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "x").select("x").limit(entries).collect()
    if not first:
        return None
    start = np.array([r["x"] for r in first], np.int64)
    dimension = start.shape[1]
    width = dimension // parts
    books = start.reshape(len(start), parts, width).swapaxes(0, 1).copy()

    def sums_of(books: np.ndarray):
        def run(batches):
            total, count = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
            for batch in buffers.slices(batches, BLOCK):
                x = _matrix(batch.column(0), dimension)
                index, _ = _assigned(x, books)
                for p in range(parts):
                    np.add.at(total[p], index[:, p], x[:, p * width : (p + 1) * width])
                    count[p] += np.bincount(index[:, p], minlength=books.shape[1])
            part, entry = np.nonzero(count)
            if len(part):
                flat = pa.array(total[part, entry].ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * width), flat)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry]), lists], names=["part", "entry", "n", "total"])

        return run

    for _ in range(rounds):
        told = kept.select("x").mapInArrow(sums_of(books), "part int, entry int, n long, total array<long>")
        columns = [F.sum(F.col("total")[k]).alias(f"s{k}") for k in range(width)]
        for r in told.groupBy("part", "entry").agg(F.sum("n").alias("n"), *columns).collect():
            books[r["part"], r["entry"]] = [r[f"s{k}"] // r["n"] for k in range(width)]
    return books


def codebooks_digest(books: np.ndarray) -> str:
    """Of all components in decimal, by part, entry and position within the part, joined by commas."""
    return sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code, error of rows of ``kept`` (vec_id, label, x): two hex digits for each part, and the squared distance."""
    dimension = books.shape[0] * books.shape[2]
    digits = np.array([f"{k:02x}" for k in range(256)])

    def run(batches):
        for batch in buffers.slices(batches, BLOCK):
            index, error = _assigned(_matrix(batch.column(2), dimension), books)
            code = pc.binary_join_element_wise(*(pa.array(digits[index[:, p]]) for p in range(len(books))), "")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), code, pa.array(error)], names=["vec_id", "label", "code", "error"])

    kept = kept.select("vec_id", "label", "x")
    return kept.mapInArrow(run, f"vec_id long, label {kept.schema['label'].dataType.simpleString()}, code string, error long")


def decode(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """``codes`` with ``x``, the integer components that a code stands for (null for a null code); a column x is replaced."""
    entry = lambda p: F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int") + 1
    book_of = lambda book: F.array(*(F.array(*map(F.lit, components)) for components in book.tolist()))
    joined = F.concat(*(F.element_at(book_of(book), entry(p)) for p, book in enumerate(books)))
    return codes.withColumn("x", joined)


def compress(table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of each kept row of ``table`` (vec_id, embedding, label).

    ``label_error`` sums the errors of all rows of equal label, null labels together (null where the sum is beyond a long).
    Vectors have the length of the kept vector of the smallest vec_id whose length is a multiple of ``parts``; those of
    another length or with an integer component beyond ``widest`` have no code, and null for code and error.  Other
    columns are left out.  Labels' sums are sent to the tasks if they are at most ``common.SENT_ROWS``; more are joined by
    a shuffle, whose hot labels AQE splits.
    """
    if entries > 256:
        raise ValueError("a code has two hex digits for each part")
    rows = stored(integers(table), "integers")
    lead = rows.where((F.size("x") > 0) & (F.size("x") % parts == 0)).orderBy(F.col("vec_id").asc_nulls_last(), "x").select(F.size("x").alias("n")).limit(1).collect()
    dimension = lead[0]["n"] if lead else parts
    fits = _codable(dimension, parts)
    books = fit(rows.where(fits), parts, entries, rounds)
    codes = encode(rows.where(fits), books) if books is not None else None
    rest = rows.where(~fits).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    codes = stored(codes.unionByName(rest) if codes is not None else rest, "codes")
    drop(rows)
    sums = codes.groupBy(F.col("label").alias("_label")).agg(F.try_sum("error").alias("label_error"))
    sums = stored(sums, "labels")
    sums = F.broadcast(sums) if sums.count() <= SENT_ROWS else sums
    digest = codebooks_digest(books) if books is not None else sha256(b"").hexdigest()
    out = codes.join(sums, F.col("label").eqNullSafe(F.col("_label")), "left")
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))

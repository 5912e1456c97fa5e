"""An inverted file over unit vectors: cells around centroids, exact joins by the triangle inequality, and nearest neighbours.

Centroids are fitted on a bounded sample; every row is assigned to a cell.  What goes to tasks whole is the centroids and one
radius per cell, at most ``MAX_CELLS`` of each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.capture import dot
from palimpsest.scratch import stored

#: Bounds of an index: cells, and rows of the sample that the centroids are fitted on.
MAX_CELLS, SAMPLE = 4096, 20_000
#: Vectors of one side of a comparison in one task.
VECTORS = 4096
#: Probes (query and cell) that a task makes at once, and queries of a block that meet the other block at once.
PROBES, STRIP = 16_384, 256
#: Bytes of a block's vectors, comparisons that a task makes at once, and pairs that it gives out at once.
BLOCK_BYTES, COMPARED, GIVEN = 1 << 21, 1 << 18, 1 << 15
#: Every two partitions of blocks are a task: so many partitions where each has three blocks, then more, of so many blocks each.
PARTITIONS, PARTITION_BLOCKS = 32, 16
#: Slack of angles, which sums of squares get wrong by far less.
_SLACK = 1e-6


class Index(NamedTuple):
    rows: DataFrame  # vec_id, unit, cell, angle (to the cell's centroid)
    centroids: np.ndarray
    radii: np.ndarray  # the greatest angle of a cell's rows; negative where a cell is empty
    counts: np.ndarray


def representatives(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding, n of the distinct vectors, under the least id that has each; null, zero and non-finite ones have none."""
    norm = dot(F.col("embedding"), F.col("embedding"))
    good = vectors.where(F.col("embedding").isNotNull() & (norm > 0) & ~F.isnan(norm) & (norm < float("inf")))
    return good.groupBy("embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n")).select("vec_id", "embedding", "n")


def _unit(column: pd.Series) -> np.ndarray:
    x = np.stack(column.to_numpy()).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


def fit(vectors: DataFrame, cells: int, sample: int = SAMPLE, rounds: int = 8) -> np.ndarray:
    """Unit centroids of at most ``cells`` cells, by spherical k-means over the ``sample`` rows whose ids have the least hashes."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toPandas()
    if not len(rows):
        return np.zeros((0, 0))
    x = _unit(rows["embedding"])
    at = x[: min(cells, MAX_CELLS)].copy()
    for _ in range(rounds):
        own = (x @ at.T).argmax(axis=1)
        sums = np.zeros_like(at)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        at = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), at)
    return at


def build(vectors: DataFrame, cells: int | None = None, sample: int = SAMPLE) -> Index:
    """An index of all rows of ``vectors`` (vec_id, embedding: of one length, not zero): by default about the square root of their number in cells."""
    if cells is None:
        cells = max(1, int(vectors.count() ** 0.5))
    centroids = fit(vectors, cells, sample)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for s in range(0, len(whole), STRIP):  # a strip's angles to all centroids
                b = whole[s : s + STRIP]
                x = _unit(b["embedding"])
                near = x @ centroids.T
                cell = near.argmax(axis=1)
                yield pd.DataFrame({"vec_id": b["vec_id"], "unit": list(x), "cell": cell.astype(np.int32), "angle": _angles(near[np.arange(len(x)), cell])})

    rows = stored(vectors.select("vec_id", "embedding").mapInPandas(assign, "vec_id long, unit array<double>, cell int, angle double"), "cells")
    radii, counts = np.full(len(centroids), -1.0), np.zeros(len(centroids), dtype=np.int64)
    for r in rows.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).collect():  # a row per cell
        radii[r["cell"]], counts[r["cell"]] = r["radius"], r["n"]
    return Index(rows, centroids, radii, counts)


def _probes(queries: DataFrame, index: Index, choose: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """a, q, cell: each query (vec_id, unit) with the cells that ``choose`` marks among its angles to all centroids."""
    centroids = index.centroids
    step = max(1, PROBES // max(1, len(centroids)))  # a query may be asked of every cell, and each probe carries its vector

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in range(0, len(b), step):
                x = np.stack(b["unit"].to_numpy()[s : s + step])
                i, j = np.nonzero(choose(_angles(x @ centroids.T)))
                yield pd.DataFrame({"a": b["vec_id"].to_numpy()[s + i], "q": list(x[i]), "cell": j.astype(np.int32)})

    return queries.select("vec_id", "unit").mapInPandas(probe, "a long, q array<double>, cell int")


def _compared(asked: DataFrame, index: Index, keep: Callable, schema: str) -> DataFrame:
    """``keep`` over every block of a cell's queries with every block of its rows, so a hot cell is many tasks."""
    spark = asked.sparkSession
    asked = stored(asked, "probes")
    mine = asked.groupBy("cell").agg(F.ceil(F.count("*") / VECTORS).cast("int").alias("_nq"))
    sizes = spark.createDataFrame([(int(c), int(-(-n // VECTORS))) for c, n in enumerate(index.counts) if n], "cell int, _nv int")
    blocks = F.broadcast(mine.join(sizes, "cell"))  # at most MAX_CELLS rows
    side = lambda of, n: F.pmod(F.xxhash64(of), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(blocks, "cell").select("cell", "a", "q", side("a", "_nq").alias("_i"), every("_nv").alias("_j"))
    right = index.rows.join(blocks, "cell").select("cell", F.col("vec_id").alias("b"), F.col("unit").alias("v"), side("vec_id", "_nv").alias("_j"), every("_nq").alias("_i"))

    def run(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(v):
            return pd.DataFrame({"a": [], "b": [], "cosine": []}).astype({"a": "int64", "b": "int64"})
        a, b, across, found = q["a"].to_numpy(), v["b"].to_numpy(), np.stack(v["v"].to_numpy()).T, []
        for s in range(0, len(a), STRIP):
            at = np.stack(q["q"].to_numpy()[s : s + STRIP]) @ across
            i, j = keep(a[s : s + STRIP], b, at)
            found.append((a[s + i], b[j], at[i, j]))
        return pd.DataFrame({name: np.concatenate(x) for name, x in zip(("a", "b", "cosine"), zip(*found, strict=True), strict=True)})

    return left.groupBy("cell", "_i", "_j").cogroup(right.groupBy("cell", "_i", "_j")).applyInPandas(run, schema)


def _packed(index: Index, reach: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """part, block, ids, units, cells, ends, reach: the rows of an index, ordered by cell, in blocks of at most ``VECTORS`` and ``BLOCK_BYTES``.

    A block has the cells of its rows with the place where each ends, and the cells that ``reach`` marks among any row's angles to all centroids.
    """
    centroids = index.centroids
    size = max(1, min(VECTORS, BLOCK_BYTES // (8 * max(1, centroids.shape[1]))))
    parts = max(1, -(-int(index.counts.sum()) * 4 // (3 * size)))  # ranges are drawn by a sample: three quarters of a block each

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = 0
        for whole in batches:
            pieces = -(-len(whole) // size)
            for k in range(pieces):
                b = whole[k * len(whole) // pieces : (k + 1) * len(whole) // pieces]
                x, cell, near = np.stack(b["unit"].to_numpy()), b["cell"].to_numpy(), np.zeros(len(centroids), dtype=bool)
                for s in range(0, len(x), STRIP):
                    near |= reach(_angles(x[s : s + STRIP] @ centroids.T)).any(axis=0)
                ends = np.append(np.flatnonzero(cell[1:] != cell[:-1]) + 1, len(cell)).astype(np.int32)
                yield pd.DataFrame({"n": [n], "ids": [b["vec_id"].to_numpy(np.int64).tobytes()], "units": [x.tobytes()], "cells": [cell[ends - 1]], "ends": [ends], "reach": [np.flatnonzero(near).astype(np.int32)]})
                n += 1

    rows = index.rows.select("vec_id", "unit", "cell").repartitionByRange(parts, "cell", "vec_id").sortWithinPartitions("cell", "vec_id")
    blocks = rows.mapInPandas(pack, "n long, ids binary, units binary, cells array<int>, ends array<int>, reach array<int>")
    return stored(blocks.withColumn("part", F.spark_partition_id()).withColumn("block", F.col("part") * F.lit(1 << 32) + F.col("n")).drop("n"), "blocks")


def similar_within(index: Index, least: float) -> DataFrame:
    """a, b, cosine of all pairs of an index (a < b) with a cosine of at least ``least``: exact.

    A row within the angle of another lies, by the triangle inequality, in a cell whose centroid is no further from that
    other than the angle and the cell's radius together; these cells alone are looked at.  Index ``representatives``, so
    that copies don't meet each other.  Every two blocks of rows meet once, in a Cartesian product of partitions: what is
    written follows the rows, not the pairs of rows and cells.
    """
    limit, radii, centroids = float(np.arccos(np.clip(least, -1.0, 1.0))), index.radii, index.centroids
    reach = lambda angles, cells=slice(None): (radii[cells] >= 0) & (angles <= limit + radii[cells] + _SLACK)
    blocks = _packed(index, reach)
    parts = int(blocks.agg(F.coalesce(F.max("part"), F.lit(0)) + 1).first()[0])
    n = max(min(parts, 8), min(parts // 3, PARTITIONS), -(-parts // PARTITION_BLOCKS))
    # Both sides have all columns and the same filters, so that one shuffle serves them.
    dealt = blocks.where("block is not null and reach is not null and cells is not null").repartitionById(n, F.col("part") % n)
    left, right = (dealt.select(*[F.col(c).alias(f"{side}_{c}") for c in blocks.columns]) for side in ("l", "r"))
    met = left.hint("shuffle_replicate_nl").join(right, (F.col("l_block") <= F.col("r_block")) & F.arrays_overlap("l_reach", "r_cells"))

    def pairs(l: dict, r: dict) -> Iterator[tuple[np.ndarray, ...]]:
        a, b = np.frombuffer(l["ids"], np.int64), np.frombuffer(r["ids"], np.int64)
        x, y = np.frombuffer(l["units"]).reshape(len(a), -1), np.frombuffer(r["units"]).reshape(len(b), -1)
        cells, start = np.array(r["cells"]), 0
        near = reach(_angles(x @ centroids[cells].T), cells)
        for k, end in enumerate(r["ends"]):
            rows, of = np.flatnonzero(near[:, k]), y[start:end].T
            step = max(1, COMPARED // (end - start))
            for s in range(0, len(rows), step):
                some = rows[s : s + step]
                at = (x[some] @ of).ravel()
                hits = np.flatnonzero(at >= least)
                one, two, cosine = a[some[hits // (end - start)]], b[start + hits % (end - start)], at[hits]
                if l["block"] == r["block"]:
                    one, two, cosine = (v[one < two] for v in (one, two, cosine))
                yield np.minimum(one, two), np.maximum(one, two), cosine
            start = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give = lambda held: pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in zip(*held, strict=True)], names=["a", "b", "cosine"])
        held, n = [], 0
        for batch in batches:
            column = dict(zip(batch.schema.names, batch.columns, strict=True))
            for k in range(batch.num_rows):
                l, r = ({c: column[f"{side}_{c}"][k].as_buffer() if c in ("ids", "units") else column[f"{side}_{c}"][k].as_py() for c in ("ids", "units", "block", "cells", "ends")} for side in ("l", "r"))
                for found in pairs(l, r):
                    held.append(found)
                    n += len(found[0])
                    if n >= GIVEN:
                        yield give(held)
                        held, n = [], 0
        if n:
            yield give(held)

    return met.mapInArrow(run, "a long, b long, cosine double")


def nearest(queries: DataFrame, index: Index, k: int, probes: int) -> DataFrame:
    """a, b, cosine, place: about the ``k`` nearest rows of each query (vec_id, embedding), from the ``probes`` nearest cells that have rows.

    Rows with the query's own id are left out.  Approximate: a neighbour in no probed cell is missed.
    """
    radii = index.radii

    def choose(angles: np.ndarray) -> np.ndarray:
        angles = np.where(radii >= 0, angles, np.inf)
        order = np.argsort(angles, axis=1, kind="stable")[:, :probes]
        mark = np.zeros(angles.shape, dtype=bool)
        np.put_along_axis(mark, order, True, axis=1)
        return mark & np.isfinite(angles)

    def unit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"vec_id": b["vec_id"], "unit": list(_unit(b["embedding"]))})

    def keep(a: np.ndarray, b: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.where(a[:, None] == b[None, :], -np.inf, at)
        order = np.lexsort((np.broadcast_to(b, at.shape), -at), axis=1)[:, :k]
        i, j = np.repeat(np.arange(len(a)), order.shape[1]), order.ravel()
        fine = np.isfinite(at[i, j])
        return i[fine], j[fine]

    asked = _probes(queries.select("vec_id", "embedding").mapInPandas(unit, "vec_id long, unit array<double>"), index, choose)
    # At most k rows of a query leave each pair of blocks.
    found = _compared(asked, index, keep, "a long, b long, cosine double")
    best = Window.partitionBy("a").orderBy(F.desc("cosine"), "b")
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)

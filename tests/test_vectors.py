"""The index of vectors against brute force: exact pairs, copies, a hot cell, and recall."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import vectors

DIR = "/root/testdata/sf0.001"


def frame(spark, x, ids=None):
    return spark.createDataFrame([(int(i), None if v is None else [float(c) for c in v]) for i, v in zip(ids or range(len(x)), x, strict=True)], "vec_id long, embedding array<float>")


def clustered(seed, n=300, dim=12):
    """A third of the rows about one centre, the rest about twelve others."""
    r = np.random.default_rng(seed)
    centres = r.normal(size=(13, dim))
    own = np.where(r.random(n) < 0.33, 0, r.integers(0, 13, n))
    return (centres[own] + 0.25 * r.normal(size=(n, dim))).astype(np.float32)


def cosines(x):
    x = x.astype(np.float64)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    return x @ x.T


@pytest.mark.parametrize("least", [0.95, 0.8])
def test_exact_pairs(spark, monkeypatch, least):
    monkeypatch.setattr(vectors, "VECTORS", 40)
    x = clustered(1)
    index = vectors.build(frame(spark, x), sample=100)
    assert index.rows.count() == len(x)
    got = {(r.a, r.b): r.cosine for r in vectors.similar_within(index, least).collect()}
    at = cosines(x)
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(at >= least), strict=True) if i < j}
    assert set(got) == want and len(want) > 50
    assert all(abs(at[p] - c) < 1e-9 for p, c in got.items())


def written(spark, after=-1):
    """The last stage, and the bytes that all stages after a given one have shuffled or written."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    found = spark.sparkContext._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    stages = [s for s in (found.apply(k) for k in range(found.size())) if s.stageId() > after]
    return max((s.stageId() for s in stages), default=after), sum(s.shuffleWriteBytes() + s.outputBytes() for s in stages)


def test_all_pairs_write_no_more_than_their_rows(spark):
    """Where the threshold prunes no cell, each row meets every cell; before, each such meeting was written with its vector."""
    n, dim = 3000, 32
    index = vectors.build(frame(spark, np.random.default_rng(2).normal(size=(n, dim))), 50)
    last, _ = written(spark)
    pairs = vectors.similar_within(index, -1.0)
    assert pairs.agg(F.count("*"), F.sum((pairs.a < pairs.b).cast("int"))).first() == (n * (n - 1) // 2,) * 2
    assert 0 < written(spark, last)[1] < 6 * n * dim * 8


@pytest.mark.parametrize("blocks", [1, 3])
def test_pairs_of_partitions_of_several_blocks(spark, monkeypatch, blocks):
    for name, value in (("VECTORS", 17), ("PARTITIONS", 1), ("PARTITION_BLOCKS", blocks), ("COMPARED", 50)):
        monkeypatch.setattr(vectors, name, value)
    x = clustered(3, 200)
    index = vectors.build(frame(spark, x, range(1000, 800, -1)), 9)
    at = cosines(x)
    got = [(r.a, r.b) for r in vectors.similar_within(index, 0.5).collect()]
    want = {(1000 - int(j), 1000 - int(i)) for i, j in zip(*np.nonzero(at >= 0.5), strict=True) if i < j}
    assert len(got) == len(want) and set(got) == want


def test_copies_and_odd_vectors(spark):
    rows = [[1, 0], [1, 0], None, [0, 0], [float("nan"), 1], [1, 0.01], [0, 1], [2, 0]]
    reps = vectors.representatives(frame(spark, rows))
    assert {r.vec_id: r.n for r in reps.collect()} == {0: 2, 5: 1, 6: 1, 7: 1}
    pairs = vectors.similar_within(vectors.build(reps), 0.9).collect()
    assert {(r.a, r.b) for r in pairs} == {(0, 5), (0, 7), (5, 7)}
    empty = vectors.representatives(frame(spark, []))
    assert vectors.similar_within(vectors.build(empty), 0.9).collect() == []


def test_recall(spark):
    """Nearest neighbours of the stated queries in the given embeddings: at least nine tenths of those of brute force."""
    table = spark.read.parquet(f"{DIR}/embeddings.parquet")
    rows = table.orderBy("vec_id").collect()
    x, ids = np.array([r.embedding for r in rows]), [r.vec_id for r in rows]
    index = vectors.build(table)
    k = 10
    got = {}
    for r in vectors.nearest(table.where("vec_id % 50 = 0"), index, k, max(1, 3 * len(index.centroids) // 4)).collect():
        got.setdefault(r.a, set()).add(r.b)
    at, hits = cosines(x), 0
    np.fill_diagonal(at, -1)
    asked = [n for n, i in enumerate(ids) if i % 50 == 0]
    for n in asked:
        assert len(got[ids[n]]) == k
        hits += len({ids[j] for j in np.argsort(-at[n])[:k]} & got[ids[n]])
    print("recall", hits / (k * len(asked)), len(ids), len(index.centroids))
    assert hits >= 0.9 * k * len(asked)


def test_probes_of_many_cells_leave_in_bounded_batches(spark):
    """Each probe carries its query's vector, so what a task makes at once may not grow with the number of cells."""
    pick = np.random.default_rng(5)
    x = pick.normal(size=(2000, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, unit array<double>").coalesce(1)
    index = vectors.Index(None, x[:1000], np.zeros(1000), np.ones(1000, dtype=np.int64))

    def all_cells(angles):
        assert angles.size <= 16_384
        return np.ones(angles.shape, dtype=bool)

    assert vectors._probes(rows, index, all_cells).count() == 2000 * 1000

"""Keyed streaming state against a plain reading of the log: random retractions, restarts and replays."""

import os
import random

import pytest

from palimpsest.operators import snapshot
from palimpsest.scratch import scratch
from palimpsest.streaming import jobs, state

FACTS = "fact_id long, commit_seq long, entity long, kind string, lo int, hi int, event long, retracts_fact_id long, retracts_commit_seq long"


def random_log(seed, n):
    """Facts of a few classes, and retractions of single facts and whole commits, retractions among them."""
    pick, out = random.Random(seed), []
    for i in range(n):
        if i > 5 and pick.random() < 0.35:
            whole = pick.random() < 0.15 and i >= 12
            # Also of what is younger or unknown: that retracts nothing.
            target = pick.choice([pick.randrange(i), max(0, i - 1 - pick.randrange(6)), i + 3])
            out.append((i, i // 4, None, "retract", None, None, None, None if whole else target, pick.randrange(i // 4) if whole else None))
        else:
            lo, hi = pick.choice([None, pick.randrange(40)]), pick.choice([None, pick.randrange(40, 80), pick.randrange(20)])
            kind = pick.choice(snapshot.DATED)
            entity = pick.randrange(6)
            out.append((i, i // 4, entity, kind, lo, hi, entity * 2 + i % 2 if kind == "event" else None, None, None))
    return out


def plain_live(log):
    edges = [(r[0], t[0]) for r in log for t in log if r[0] > t[0] and (r[7] == t[0] or (r[8] is not None and r[8] == t[1]))]
    dead = set()
    for fact in sorted((r[0] for r in log), reverse=True):
        if any(t == fact and r not in dead for r, t in edges):
            dead.add(fact)
    return [r for r in log if r[0] not in dead and r[3] in snapshot.DATED]


def plain_life(log):
    out = {}
    for rep in {r[2] // 2 for r in log}:
        facts = [r for r in log if r[2] // 2 == rep]
        most = lambda values: max((v for v in values if v is not None), default=None)
        least = lambda values: min((v for v in values if v is not None), default=None)
        done = [r for r in facts if r[3] == "demolition_completed"]
        began = any(r[3] == "demolition_started" for r in facts)
        out[rep] = (
            least(r[5] if r[4] is None else r[4] for r in facts), most(r[4] if r[5] is None else r[5] for r in facts), most(r[4] for r in facts if r not in done), most(r[4] for r in facts if r[3] == "construction_started"),
            least(r[5] for r in done), most(r[5] for r in done), began or any(r[5] is None for r in done), began or bool(done),
        )
    return out


@pytest.fixture(scope="module")
def reps(spark):
    return spark.createDataFrame([(e, e // 2) for e in range(6)], "member long, rep long")


def written(spark, folder, rows, name):
    spark.createDataFrame(rows, FACTS).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def source(spark, folder):
    return spark.readStream.schema(FACTS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


LIFE = [c.split()[0] for c in state.LIFE.split(", ")]


def by_rep(log):
    last = {}
    for r in log.collect():
        if r["rep"] not in last or r["batch"] > last[r["rep"]]["batch"]:
            last[r["rep"]] = r
    return {rep: tuple(r[c] for c in LIFE) for rep, r in last.items() if r["claimed"] is not None}


@pytest.mark.parametrize("seed", [1, 2])
def test_each_batch_leaves_what_its_log_has(spark, reps, seed):
    """The stream is stopped after each file and goes on from its checkpoint with the next."""
    log, folder, at = random_log(seed, 120), scratch(spark, "life"), scratch(spark, "source")
    for k in range(3):
        written(spark, at, log[k * 40 : k * 40 + 40], f"part-{k}")
        found = state.lifespans(source(spark, at), reps, folder)
        assert by_rep(found) == plain_life(plain_live(log[: k * 40 + 40]))


def test_replay_changes_nothing(spark, reps):
    log, folder, at = random_log(7, 90), scratch(spark, "life"), scratch(spark, "source")
    for k in range(3):
        written(spark, at, log[k * 30 : k * 30 + 30], f"part-{k}")
    first = sorted(map(tuple, state.lifespans(source(spark, at), reps, folder).collect()), key=str)
    deltas = lambda: sorted(map(tuple, spark.read.schema(state.DELTAS).parquet(f"{folder}/deltas").collect()), key=str)
    before = deltas()
    local = folder.removeprefix("file:")
    for query in (local, f"{local}/life"):  # as if the last batch of each query had been cut off before its commit
        commits = f"{query}/checkpoint/commits"
        last = max(int(f) for f in os.listdir(commits) if f.isdigit())
        for f in (f"{commits}/{last}", f"{commits}/.{last}.crc"):
            if os.path.exists(f):
                os.remove(f)
    again = sorted(map(tuple, state.lifespans(source(spark, at), reps, folder).collect()), key=str)
    assert deltas() == before and again == first


def test_state_reads_deltas_and_not_the_log(spark, reps):
    log, folder, at = random_log(9, 400), scratch(spark, "life"), scratch(spark, "source")
    for k in range(4):
        written(spark, at, log[k * 100 : k * 100 + 100], f"part-{k}")
    reports = state.fact_deltas(source(spark, at), reps, folder)
    assert [r["rows"] for r in reports if r["rows"]] == [100] * 4
    deltas = spark.read.schema(state.DELTAS).parquet(f"{folder}/deltas")
    per = {r["batch"]: r["count"] for r in deltas.groupBy("batch").count().collect()}
    _, reports = state.folded(spark, folder, "life", state.bound_key, state.life_of, state.LIFE)
    assert sum(r["rows"] for r in reports) == sum(per.values())
    # Taken back as often as given, in the end each live fact counts once.
    held = {r["fact_id"]: r["n"] for r in deltas.groupBy("fact_id").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").where("n <> 0").collect()}
    assert held == {r[0]: 1 for r in plain_live(log)}


def test_alerts_equal_the_batch_operator(spark, reps):
    from palimpsest.operators import conflicts

    at = scratch(spark, "source")
    bookend = {"construction_started": (30, 90), "demolition_completed": (0, 20)}
    log = [(*r[:4], *bookend.get(r[3], r[4:6]), *r[6:]) for r in random_log(4, 150)]
    for k in range(3):
        written(spark, at, log[k * 50 : k * 50 + 50], f"part-{k}")
    got = {(r["rep"], r["bound"], tuple(r["witnesses"]), r["witness"]) for r in jobs.conflict_alerts(source(spark, at), reps).collect()}
    live = snapshot.live(spark.createDataFrame(log, FACTS)).where(f"kind in {tuple(snapshot.DATED)}").join(reps.withColumnRenamed("member", "entity"), "entity")
    want = {(r["rep"], r["bound"], tuple(r["witnesses"]), r["witness"]) for r in conflicts.temporal_conflicts(live).collect()}
    assert got == want and want


def test_buckets_hold_classes_and_batches_stay_whole(spark):
    """Classes share state keys, and a batch of many files is folded once: before, each class was a key, and 64 files made a run."""
    folder = scratch(spark, "life")
    rows = [(rep, rep * 70 + k, "existence", k, k + 5, None, 1) for rep in range(2000) for k in range(2)]
    df = spark.createDataFrame(rows, "rep long, fact_id long, kind string, lo int, hi int, event long, n int")
    df.repartition(70, "fact_id").write.option("maxRecordsPerFile", 40).parquet(f"{folder}/deltas/batch=0")
    found, reports = state.folded(spark, folder, "life", state.bound_key, state.life_of, state.LIFE)
    got = {r["rep"]: (r["earliest"], r["affirmed"]) for r in found.collect()}
    assert found.count() == 2000 and got == {rep: (0, 6) for rep in range(2000)}
    assert max(r["held"] for r in reports) <= state.BUCKETS


def test_a_log_streams_in_its_order(spark):
    """The files of a log are read in log order, whichever task ends first: here the first range is much the longest to write."""
    from pyspark.sql import functions as F

    i = F.col("fact_id")
    wide = F.when(i < 300, F.repeat(F.sha2(i.cast("string"), 256), 2000)).when(i < 600, F.repeat(F.sha2(i.cast("string"), 256), 400)).otherwise("")
    facts = spark.range(1200).select(F.col("id").alias("fact_id")).withColumn("wide", wide)
    seen = []
    state.run_to_end(jobs.log_stream(spark, facts, 4), lambda batch, n: seen.append(tuple(batch.agg(F.min("fact_id"), F.max("fact_id"), F.count("*")).first())))
    seen = [x for x in seen if x[2]]
    assert len(seen) == 4 and sum(x[2] for x in seen) == 1200
    assert all(a[1] < b[0] for a, b in zip(seen, seen[1:], strict=False))

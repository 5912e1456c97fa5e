"""Keyed state over a stream of facts: what batches add and take back per class, held in a state store.

A first query turns the log into deltas: a fact that comes to life is one more, one that a retraction kills is one less.
Only retractions look back, and only into the retraction edges, the fates of facts that were ever retracted, and the log's
rows in the range of the facts that change.  A second query keeps the live facts of buckets of classes in the state store and emits
what a fold makes of them, so its reading follows the deltas, not the log.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from palimpsest.operators import snapshot
from palimpsest.scratch import drop, scratch, stored

#: The state store that processors with several states need.
_PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
DELTAS = "rep long, fact_id long, kind string, lo int, hi int, event long, n int, batch int"


def run_to_end(stream: DataFrame, each: Callable[[DataFrame, int], None], folder: str | None = None, mode: str = "append") -> list[dict]:
    """Hand every micro-batch to each(batch, id) until the input at the start is used up; the batches' progress reports.

    With a ``folder`` the query goes on where an earlier one with that folder ended.
    """
    at = f"{folder or scratch(stream.sparkSession, 'query')}/checkpoint"
    q = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", at).trigger(availableNow=True).start()
    q.awaitTermination()
    return [dict(batch=p.batchId, rows=p.numInputRows, held=sum(o.numRowsTotal for o in p.stateOperators)) for p in q.recentProgress]


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of one folder a batch, which may have none yet."""
    full = f"{schema}, batch int"
    if not spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(path)):
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/batch=-1")
    return spark.read.schema(full).parquet(path)


def _range(rows: DataFrame, of: DataFrame, column: str) -> DataFrame:
    """``rows`` whose ``column`` lies between the least and greatest of ``of``: literal bounds, by which the reader skips files and row groups."""
    low, high = of.agg(F.min(column), F.max(column)).first()
    return rows.where(F.lit(False)) if low is None else rows.where(F.col(column).between(low, high))


def fact_deltas(stream: DataFrame, reps: DataFrame, folder: str) -> list[dict]:
    """Write the deltas of a stream of facts (see ``DELTAS``) under ``folder``/deltas; the batches' progress reports.

    ``stream`` has fact_id, commit_seq, entity, kind, lo, hi, retracts_fact_id and retracts_commit_seq, and maybe event; ids
    rise from batch to batch.  ``reps`` has member and rep.  Each batch writes folders named by its number, and reads only
    those of earlier ones, so a repeated batch overwrites itself.
    """
    spark = stream.sparkSession
    columns = ["fact_id", "commit_seq", "entity", "kind", "lo", "hi"]
    log_schema = "fact_id long, commit_seq long, entity long, kind string, lo int, hi int, event long"
    event = F.col("event").cast("long") if "event" in stream.columns else F.lit(None).cast("long")
    place = {name: f"{folder}/{name}" for name in ("log", "edges", "fates", "deltas")}
    of = reps.select(F.col("member").alias("entity"), F.col("rep").cast("long").alias("rep"))

    def each(batch: DataFrame, i: int) -> None:
        into = lambda df, name: df.write.mode("overwrite").parquet(f"{place[name]}/batch={i}")
        before = lambda name, schema: _table(spark, place[name], schema).where(F.col("batch") < i)
        own = stored(batch.select(*columns, event.alias("event"), "retracts_fact_id", "retracts_commit_seq"), "batch")
        facts = own.select(*columns, "event")
        into(facts.orderBy("fact_id"), "log")
        log = before("log", log_schema).drop("batch").unionByName(facts)
        single = own.where("retracts_fact_id is not null").select(F.col("fact_id").alias("retractor"), F.col("retracts_fact_id").cast("long").alias("target"))
        whole = own.where("retracts_commit_seq is not null").select(F.col("fact_id").alias("retractor"), F.col("retracts_commit_seq").cast("long").alias("commit_seq"))
        members = _range(log, whole, "commit_seq").select("commit_seq", F.col("fact_id").alias("target"))
        new = stored(single.unionByName(whole.join(members, "commit_seq").select("retractor", "target")).where("retractor > target").distinct(), "edges")
        into(new, "edges")
        fates = before("fates", "fact_id long, dead boolean").groupBy("fact_id").agg(F.max_by("dead", "batch").alias("was"))
        if new.isEmpty():
            changed = None
            live = facts
        else:
            edges = before("edges", "retractor long, target long").drop("batch").unionByName(new)
            reached = snapshot.touched_targets(new.select(F.col("target").alias("fact_id")), edges)
            mine = edges.join(reached.withColumnRenamed("fact_id", "target"), "target", "left_semi")
            # Retractors above what this batch reaches keep the fate that they had.
            outside = fates.where("was").join(reached, "fact_id", "left_anti").select(F.col("fact_id").alias("retractor"))
            dead = snapshot.effective_retractors(mine.join(outside, "retractor", "left_anti"))
            now = reached.join(dead.select(F.col("target").alias("fact_id"), F.lit(True).alias("dead")), "fact_id", "left").select("fact_id", F.coalesce("dead", F.lit(False)).alias("dead"))
            now = stored(now.join(fates, "fact_id", "left").withColumn("was", F.coalesce("was", F.lit(False))), "fates")
            into(now.select("fact_id", "dead"), "fates")
            live = facts.join(now.where("dead").select("fact_id"), "fact_id", "left_anti")
            moved = now.where("was <> dead").join(facts.select("fact_id"), "fact_id", "left_anti")
            changed = _range(log, moved, "fact_id").join(moved.select("fact_id", F.when(F.col("dead"), -1).otherwise(1).alias("n")), "fact_id")
        delta = live.withColumn("n", F.lit(1))
        delta = delta if changed is None else delta.unionByName(changed)
        dated = delta.where(F.col("kind").isin(snapshot.DATED)).join(of, "entity")
        into(dated.select("rep", "fact_id", "kind", "lo", "hi", "event", "n"), "deltas")
        drop(own, new)

    return run_to_end(stream, each, folder)


#: State keys.  Classes are dealt to them by a hash: a key's cells are read, summed and folded as columns, so neither a call of
#: Python nor one to the state store is made per class.  The number is fixed for the life of a checkpoint.
BUCKETS = 1024
#: A missing value among the integers of a cell.
NONE = -(1 << 62)
_CODE = {kind: k for k, kind in enumerate(snapshot.DATED)}


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin in columns of one length."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.append(True, np.any([c[1:] != c[:-1] for c in columns], axis=0)))


def summed(cells: np.ndarray) -> np.ndarray:
    """Rows (rep, key columns, n) in order, equal keys as one with the sum of their n; those with none left go."""
    cells = cells[np.lexsort(cells[:, -2::-1].T)]
    first = _starts(*cells[:, :-1].T)
    out = cells[first]
    if len(first):
        out[:, -1] = np.add.reduceat(cells[:, -1], first)
    return out[out[:, -1] != 0]


class Held(StatefulProcessor):
    """Keeps the live facts of a bucket of classes, counted by key columns, and emits ``fold`` of each class's after each batch that touches it."""

    def __init__(self, fold: Callable[[np.ndarray], dict[str, Any]], columns: list[str]):
        self.fold, self.columns = fold, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "cells binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        moves = np.concatenate([part.drop(columns="bucket").to_numpy(np.int64) for part in rows])
        batches, moves = moves[:, 0], moves[:, 1:]
        have = self.held.get() if self.held.exists() else None
        cells = np.frombuffer(have[0] if have else b"", np.int64).reshape(-1, moves.shape[1])
        for batch in np.unique(batches):
            moved = moves[batches == batch]
            reps = np.unique(moved[:, 0])
            cells = summed(np.concatenate([cells, moved]))
            found = pd.DataFrame(self.fold(cells[np.isin(cells[:, 0], reps) & (cells[:, -1] > 0), :-1]))
            # A class of which the fold says nothing has one row of nulls.
            out = found.merge(pd.DataFrame({"rep": reps}), how="right", on="rep")
            out.insert(1, "batch", batch)
            yield out[["rep", "batch"]].join(out[self.columns].astype(object).where(out[self.columns].notna(), None))
        self.held.update((cells.tobytes(),)) if len(cells) else self.held.clear()

    def close(self) -> None:
        pass


#: Facts of one kind and date count together: a class's state has one cell for each date, not for each fact.
bound_key = ["kind", "lo", "hi"]
fact_key = [*bound_key, "event", "fact_id"]


def _whole(values: np.ndarray, kind: str = "Int32") -> pd.Series:
    """Integers, null for NONE."""
    return pd.Series(pd.array(values, "Int64")).mask(values == NONE).astype(kind)


LIFE = "earliest int, affirmed int, reached int, floor int, denies_after int, claimed_through int, unbounded boolean, claimed boolean"


def life_of(held: np.ndarray) -> dict[str, Any]:
    """rep and the lifespan's values of each class of (rep, kind, lo, hi), ordered by rep; the rules are ``existence.lifespan``'s."""
    rep, kind, lo, hi = held.T
    first = _starts(rep)
    if not len(first):
        return {"rep": rep, **{c.split()[0]: pd.Series(dtype="boolean" if c.endswith("boolean") else "Int32") for c in LIFE.split(", ")}}
    most = lambda v, where=True: np.maximum.reduceat(np.where(where, v, NONE), first)
    least = lambda v, where=True: (lambda x: np.where(x == -NONE, NONE, x))(np.minimum.reduceat(np.where(where & (v != NONE), v, -NONE), first))
    some = lambda where: pd.Series(np.logical_or.reduceat(where, first), dtype="boolean")
    done, began = kind == _CODE["demolition_completed"], kind == _CODE["demolition_started"]
    return {
        "rep": rep[first], "earliest": _whole(least(np.where(lo == NONE, hi, lo))), "affirmed": _whole(most(np.where(hi == NONE, lo, hi))),
        "reached": _whole(most(lo, ~done)), "floor": _whole(most(lo, kind == _CODE["construction_started"])),
        "denies_after": _whole(least(hi, done)), "claimed_through": _whole(most(hi, done)), "unbounded": some(began | (done & (hi == NONE))), "claimed": some(done | began),
    }


ALERTS = "bound string, witnesses array<long>, witness long"


def alerts_of(held: np.ndarray) -> dict[str, Any]:
    """rep, bound, witnesses, witness of each temporal conflict among the facts (rep, kind, lo, hi, event, fact_id) of each class,
    ordered by rep; the rules are ``conflicts.temporal_conflicts``'s."""
    rep, kind, lo, hi, event, fact = held.T
    first = _starts(rep)
    if not len(first):
        return {"rep": rep, "bound": [], "witnesses": [], "witness": pd.Series(dtype="Int64")}
    size = np.diff(np.append(first, len(rep)))
    started, ended = kind == _CODE["construction_started"], kind == _CODE["demolition_completed"]
    # A bound that is open on one fact is open: a missing start is the least one of all.
    least = np.minimum.reduceat(np.where(started, lo, -NONE), first)
    floor = np.repeat(np.where(least == NONE, -NONE, least), size)
    ceiling = np.maximum.reduceat(np.where(ended, hi, NONE), first)
    ceiling = np.repeat(np.where(np.logical_or.reduceat(ended & (hi == NONE), first), NONE, ceiling), size)
    seen, happening = kind == _CODE["existence"], kind == _CODE["event"]
    shared = happening & (event != NONE)
    # The group: dates of existence, an event, or an event's fact alone.
    group = [np.select([seen, shared], [0, 1], 2), np.where(seen, lo, np.where(shared, event, fact)), np.where(seen, hi, 0)]
    below = (seen | happening) & (hi != NONE) & (floor != -NONE) & (hi < floor)
    above = (seen | happening) & (lo != NONE) & (ceiling != NONE) & (lo > ceiling)
    hit = lambda which, bound, rank: np.column_stack([x[which] for x in (rep, np.full(len(rep), bound), *group, rank, fact)])
    found = np.concatenate([hit(below, 0, -hi), hit(above, 1, lo)])
    found = found[np.lexsort(found[:, ::-1].T)]
    at = _starts(*found[:, :5].T)
    return {
        "rep": found[at, 0], "bound": np.array(["floor", "ceiling"], object)[found[at, 1]],
        "witnesses": [sorted(x.tolist()) for x in np.split(found[:, 6], at[1:])] if len(at) else [], "witness": pd.Series(pd.array(found[at, 6], "Int64")),
    }


def folded(spark: SparkSession, folder: str, name: str, key: list[str], fold: Callable[[np.ndarray], dict[str, Any]], columns: str) -> tuple[DataFrame, list[dict]]:
    """(rep, batch and ``columns`` after each batch of deltas under ``folder`` that touches the class; the progress reports).

    One run takes all batches of deltas that are new, so a batch's files are never parted.
    """
    conf = spark.conf.get(_PROVIDER[0], None)
    spark.conf.set(*_PROVIDER)
    shape = f"rep long, batch int, {columns}"
    try:
        deltas = spark.readStream.schema(DELTAS).parquet(f"{folder}/deltas")
        names = [c.split()[0] for c in columns.split(", ")]
        code = F.expr("case kind " + " ".join(f"when '{kind}' then {k}" for kind, k in _CODE.items()) + " end").alias("kind")
        cells = [code if c == "kind" else F.coalesce(F.col(c).cast("long"), F.lit(NONE)).alias(c) for c in key]
        dealt = deltas.select(F.pmod(F.xxhash64("rep"), F.lit(BUCKETS)).cast("int").alias("bucket"), "batch", "rep", *cells, "n")
        changes = dealt.groupBy("bucket").transformWithStateInPandas(Held(fold, names), shape, "Update", "None")
        out = f"{folder}/{name}"
        reports = run_to_end(changes, lambda batch, i: batch.write.mode("overwrite").parquet(f"{out}/run={i}"), out, "update")
    finally:
        spark.conf.set(_PROVIDER[0], conf) if conf else spark.conf.unset(_PROVIDER[0])
    return spark.read.schema(f"{shape}, run int").parquet(f"{out}/run=*"), reports


def lifespans(stream: DataFrame, reps: DataFrame, folder: str | None = None) -> DataFrame:
    """rep, batch and the lifespan's values after each batch of a stream of facts that touches the class; null after one that takes back all."""
    folder = folder or scratch(stream.sparkSession, "life")
    fact_deltas(stream, reps, folder)
    return folded(stream.sparkSession, folder, "life", bound_key, life_of, LIFE)[0].drop("run")


def alerts(stream: DataFrame, reps: DataFrame, folder: str | None = None) -> DataFrame:
    """rep, batch, bound, witnesses, witness: the temporal conflicts of a class after each batch that touches it; a row of nulls where it has none."""
    folder = folder or scratch(stream.sparkSession, "alerts")
    fact_deltas(stream, reps, folder)
    return folded(stream.sparkSession, folder, "alerts", fact_key, alerts_of, ALERTS)[0].drop("run")

"""Continuous append with a ledger: a bundle is appended whole or not at all, once, and a re-sent one gets its first result.

Tables of one folder a batch under a common folder, of which a reader sees those of published batches:

- ``facts``: commit_id, ts, fact, the bundle's other columns, fact_id (dense over the whole log);
- ``mentions``: each distinct (fact_id, kind, subject) once;
- ``results``: commit_id, outcome (accepted, rejected or replayed), first_id, n_facts, rules (those that a rejected bundle breaks);
- ``pending``: the facts of bundles that haven't come whole yet, as they stand after the batch;
- ``manifest``: one row, batch, next_id, written last.  It publishes the batch.

A batch that dies before its manifest is invisible, and is written anew under the same number.  Ids start at the last
manifest's ``next_id``, so no batch scans the facts; only the narrow results of earlier batches are joined, to know a
re-sent bundle.  A rejected bundle leaves no fact and isn't known later: once mended, or once the log has what it lacked,
it may come again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import folds, snapshot, validate
from palimpsest.scratch import drop, stored
from palimpsest.streaming.state import run_to_end

RESULTS = "commit_id string, outcome string, first_id long, n_facts long, rules array<string>"
MANIFEST = "next_id long"
#: Rules of a batch: (facts of whole new bundles, next id) to {name: frame with ``bundle``}.
Rules = Callable[[DataFrame, int], dict[str, DataFrame]]


def basic_rules(facts: DataFrame, next_id: int) -> dict[str, DataFrame]:
    """Violations that need the bundle alone: inverted ranges, sameness of events, and retraction targets (dense ids: known means below next_id)."""
    bundles = facts.withColumn("bundle", F.col("commit_id"))
    return {
        "inverted_window": bundles.where("hi < lo"),
        "same_event": validate.same_event(bundles),
        "unknown_target": bundles.where(~F.col("retracts_fact_id").between(0, next_id - 1)),
    }


def _read(spark: SparkSession, folder: str, name: str, schema, through: int) -> DataFrame:
    """A table's rows of the batches 0 to ``through``; a table that has none yet is empty."""
    none = spark.createDataFrame([], schema).withColumn("batch", F.lit(None).cast("int"))
    if through < 0:
        return none
    return spark.read.schema(none.schema).parquet(f"{folder}/{name}").where(F.col("batch") <= through)


def published(spark: SparkSession, folder: str) -> tuple[int, int | None]:
    """(last published batch or -1, its next_id or None), from file names and one row."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest")
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(at):
        return -1, None
    # A manifest that its write committed has the committer's mark.
    done = [int(p.getPath().getName().split("=")[1]) for p in files.listStatus(at) if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p.getPath(), "_SUCCESS"))]
    if not done:
        return -1, None
    last = max(done)
    return last, spark.read.schema(MANIFEST).parquet(f"{folder}/manifest/batch={last}").first()["next_id"]


def _publish(spark: SparkSession, folder: str, i: int, next_id: int) -> None:
    spark.createDataFrame([(next_id,)], MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest/batch={i}")


def append(bundles: DataFrame, folder: str, subjects: Column | None = None, rules: Rules = basic_rules, first: int = 0) -> list[dict]:
    """Append a stream of facts (commit_id, ts, fact, n_facts, kind, entity, and more) to the tables under ``folder``.

    ``fact`` numbers the facts inside their bundle and ``n_facts`` tells how many it has, so a bundle may come in pieces, over
    several batches; it is judged once it is whole.  Repeated facts count once; facts of unknown size (null) are a bundle of
    what the batch holds.  Returns the batches' progress reports; a later call with the folder goes on where this one ended.
    """
    spark, plain = bundles.sparkSession, bundles.schema
    subjects = subjects if subjects is not None else F.array("entity")

    def each(batch: DataFrame, i: int) -> None:
        last, next_id = published(spark, folder)
        if last >= i:
            return
        next_id = first if next_id is None else next_id
        into = lambda df, name: df.write.mode("overwrite").parquet(f"{folder}/{name}/batch={i}")
        waiting = _read(spark, folder, "pending", plain, last).where(F.col("batch") == last).drop("batch")
        rest = [c for c in plain.names if c not in ("commit_id", "fact")]
        once = batch.unionByName(waiting).groupBy("commit_id", "fact").agg(F.min(F.struct("ts", *[c for c in rest if c != "ts"])).alias("_x"))
        rows = stored(once.select(*[F.col(c) if c in ("commit_id", "fact") else F.col(f"_x.{c}").alias(c) for c in plain.names]), "arrived")
        commits = rows.groupBy("commit_id").agg(F.count("*").alias("_n"), F.max("n_facts").alias("_need"), F.min("ts").alias("_ts"))
        ledger = _read(spark, folder, "results", RESULTS, last).where("outcome = 'accepted'").select("commit_id", "first_id", F.col("n_facts").alias("_known"))
        judged = stored(commits.join(ledger, "commit_id", "left"), "commits")
        whole = judged.where("_known is null and _n >= coalesce(_need, 0)").select("commit_id", "_ts")
        fresh = stored(rows.join(whole, "commit_id").withColumn("ts", F.col("_ts")).select(*plain.names), "fresh")
        broken = stored(validate.validate(fresh.withColumn("bundle", F.col("commit_id")), rules(fresh, next_id))[1].select("bundle", "rule").distinct(), "broken")
        accepted = fresh.join(broken.select(F.col("bundle").alias("commit_id")).distinct(), "commit_id", "left_anti")
        with_ids = snapshot.append_ids(accepted, next_id, ["ts", "commit_id", "fact"])
        into(with_ids, "facts")
        facts = spark.read.schema(with_ids.schema).parquet(f"{folder}/facts/batch={i}")
        into(folds.mentions(facts, subjects), "mentions")
        blank = F.array().cast("array<string>")
        results = facts.groupBy("commit_id").agg(F.lit("accepted").alias("outcome"), F.min("fact_id").alias("first_id"), F.count("*").alias("n_facts"), blank.alias("rules"))
        rejected = broken.groupBy("bundle").agg(F.sort_array(F.collect_set("rule")).alias("rules")).select(F.col("bundle").alias("commit_id"), F.lit("rejected").alias("outcome"), F.lit(None).cast("long").alias("first_id"), F.lit(0).cast("long").alias("n_facts"), "rules")
        again = judged.where("_known is not null").select("commit_id", F.lit("replayed").alias("outcome"), "first_id", F.col("_known").alias("n_facts"), blank.alias("rules"))
        into(results.unionByName(rejected).unionByName(again), "results")
        into(rows.join(judged.where("_known is null and _n < _need").select("commit_id"), "commit_id", "left_semi"), "pending")
        _publish(spark, folder, i, next_id + facts.count())
        drop(rows, judged, fresh, broken)

    return run_to_end(bundles, each, folder)


def read(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """A table (``facts``, ``mentions`` or ``results``) with ``batch``, as far as it is published."""
    return _read(spark, folder, name, schema, published(spark, folder)[0])


def results(spark: SparkSession, folder: str) -> DataFrame:
    """The results of all published batches, one row per batch and bundle that it dealt with."""
    return read(spark, folder, "results", RESULTS)


def facts(spark: SparkSession, folder: str, bundle_schema) -> DataFrame:
    """The log: the bundles' columns with fact_id."""
    return read(spark, folder, "facts", spark.createDataFrame([], bundle_schema).withColumn("fact_id", F.lit(0).cast("long")).schema).drop("batch")


def still_pending(spark: SparkSession, folder: str, bundle_schema) -> DataFrame:
    """Facts of bundles that have not come whole by the last batch."""
    last = published(spark, folder)[0]
    return _read(spark, folder, "pending", bundle_schema, last).where(F.col("batch") == last).drop("batch")

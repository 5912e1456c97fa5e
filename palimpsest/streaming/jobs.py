"""Structured Streaming jobs over the fact log; each equals its batch operator when the stream is done."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.operators import existence, identity, snapshot
from palimpsest.scratch import scratch
from palimpsest.streaming import state
from palimpsest.streaming.state import run_to_end


def _timed(spark: SparkSession, path: str) -> None:
    """Set the files' times a second apart, in the order of their names: a stream takes files by time, and tasks end in any order."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = lambda: sorted(((f.getPath().getName(), f) for f in fs.listStatus(at) if f.getPath().getName().startswith("part-")), key=lambda x: x[0])
    found = files()
    first = min((f.getModificationTime() for _, f in found), default=0) // 1000 - len(found)
    for k, (_, f) in enumerate(found):
        fs.setTimes(f.getPath(), (first + k) * 1000, -1)
    times = [f.getModificationTime() for _, f in files()]
    if any(b <= a for a, b in zip(times, times[1:], strict=False)):
        raise RuntimeError(f"{path} keeps no file times, so a stream can't read it in log order")


def log_stream(spark: SparkSession, facts: DataFrame, files: int = 4, order: str = "fact_id") -> DataFrame:
    """``facts`` written as files in log order, and read back as a stream of one file per trigger."""
    path = scratch(spark, "log")
    facts.repartitionByRange(files, order).sortWithinPartitions(order).write.parquet(path)
    _timed(spark, path)
    return spark.readStream.schema(facts.schema).option("maxFilesPerTrigger", 1).parquet(path)


def continuous_append(bundles: DataFrame, first: int = 0) -> DataFrame:
    """Append a stream of bundles (commit_id, ts, fact): unknown ones get ids and are written, re-sent ones do nothing.

    One batch writes one folder named by its number, so that a repeated batch overwrites itself.
    """
    spark, out = bundles.sparkSession, scratch(bundles.sparkSession, "append")
    schema = "commit_id string, ts timestamp, fact long, fact_id long, batch int"
    spark.createDataFrame([], schema.replace(", batch int", "")).write.parquet(f"{out}/batch=-1")

    def each(batch: DataFrame, i: int) -> None:
        known = spark.read.schema(schema).parquet(out).where(F.col("batch") < i)
        top = known.agg(F.coalesce(F.max("fact_id") + 1, F.lit(first)).alias("n")).first()["n"]
        new = batch.dropDuplicates(["commit_id", "fact"]).join(known.select("commit_id").distinct(), "commit_id", "left_anti")
        snapshot.append_ids(new, int(top), ["ts", "commit_id", "fact"]).select("commit_id", "ts", "fact", "fact_id").write.mode("overwrite").parquet(f"{out}/batch={i}")

    run_to_end(bundles, each)
    return spark.read.schema(schema).parquet(out)


def _latest(folded: DataFrame) -> DataFrame:
    """The rows of each class's last batch; a class that has lost all its facts has none."""
    last = folded.groupBy("rep").agg(F.max("batch").alias("batch"))
    return folded.join(last, ["rep", "batch"]).drop("batch")


def lifespan_log(stream: DataFrame, reps: DataFrame) -> DataFrame:
    """rep, batch and the lifespan's values after each batch of a stream of facts that touches the class.

    Dates are counted in keyed state (see ``state``).  Values are null after a batch that retracts all of a class.
    """
    return state.lifespans(stream, reps)


def streaming_lifespan(stream: DataFrame, reps: DataFrame) -> DataFrame:
    """rep and the lifespan's values when a stream of facts, retractions among them, is done."""
    return _latest(lifespan_log(stream, reps)).where("claimed is not null")


def verdict_changes(log: DataFrame, day: int) -> DataFrame:
    """rep, batch, before, after: each change of a class's existence verdict at a day, from a ``lifespan_log``.

    A class is unknown before its first batch.
    """
    now = log.select("rep", "batch", F.when(F.col("claimed").isNotNull(), existence.verdict(day)).otherwise("unknown").alias("after"))
    before = F.coalesce(F.lag("after").over(Window.partitionBy("rep").orderBy("batch")), F.lit("unknown"))
    return now.withColumn("before", before).where("before <> after").select("rep", "batch", "before", "after")


def conflict_alerts(stream: DataFrame, reps: DataFrame) -> DataFrame:
    """The temporal conflicts after a stream of facts, from state kept per class."""
    return _latest(state.alerts(stream, reps)).where("witness is not null")


def rep_log_upkeep(edges: DataFrame) -> DataFrame:
    """member, as_of, rep: the representative log kept up over a stream of identity edges (edge_id, a, b)."""
    spark = edges.sparkSession
    seen, log = scratch(spark, "edges"), scratch(spark, "reps")
    spark.createDataFrame([], edges.schema).write.parquet(f"{seen}/batch=-1")
    spark.createDataFrame([], "member long, as_of long, rep long").write.parquet(f"{log}/batch=-1")

    def each(batch: DataFrame, i: int) -> None:
        batch.write.mode("overwrite").parquet(f"{seen}/batch={i}")
        all_edges = spark.read.schema(edges.schema).parquet(seen)
        before = spark.read.schema("member long, as_of long, rep long, batch int").parquet(log).where(F.col("batch") < i).drop("batch")
        ends = batch.select(F.col("a").alias("member")).unionByName(batch.select(F.col("b").alias("member")))
        identity.update_touched(before, all_edges, ends, i + 1).write.mode("overwrite").parquet(f"{log}/batch={i}")

    run_to_end(edges, each)
    return spark.read.schema("member long, as_of long, rep long, batch int").parquet(log).drop("batch")


def seen_urls(stream: DataFrame, key: str, time: str, within: str = "30 days") -> DataFrame:
    """The first row per key of a capture stream, with state that the watermark bounds."""
    out = scratch(stream.sparkSession, "urls")
    first = stream.withWatermark(time, within).dropDuplicatesWithinWatermark([key])
    stream.sparkSession.createDataFrame([], stream.schema).write.parquet(f"{out}/batch=-1")
    run_to_end(first, lambda batch, i: batch.write.mode("overwrite").parquet(f"{out}/batch={i}"))
    return stream.sparkSession.read.schema(stream.schema).parquet(out)

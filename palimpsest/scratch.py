"""Scratch tables in the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Deletes a job's shuffle files when it ends; the table that it wrote has all that is needed of them.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder; where the session names none, in the warehouse, or locally if Spark runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        one_process = spark.sparkContext.master.split("[")[0] == "local"
        home = tempfile.gettempdir() if one_process else spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        base = os.path.join(home, f"palimpsest-{spark.sparkContext.applicationId}")
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, what: str, codec: str = "zstd") -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends here, and a lost executor costs nothing."""
    spark, path = df.sparkSession, scratch(df.sparkSession, what)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def drop(*frames: DataFrame) -> None:
    """Delete the tables of frames that ``stored`` gave and that no later plan reads."""
    for frame in frames:
        spark, path = frame.sparkSession, frame.scratch_path
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def free_driver(spark: SparkSession) -> None:
    """Collect the driver's JVM garbage once an operator's intermediate tables are gone: plans and broadcasts of its many jobs
    hold memory until then, and Spark's cleaner drops what they refer to on executors."""
    spark.sparkContext._jvm.System.gc()

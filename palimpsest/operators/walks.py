"""Walks over (rep, fact_id) rows by cursor: a sorted table that is written once, and pages that read a few of its files."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The greatest fact id; a cursor that holds it has passed the whole class.
LAST = (1 << 63) - 1
#: Files of a walk are cut at about this many rows.
ROWS_PER_FILE = 1_000_000

Cursor = tuple[int, int]


class Page(NamedTuple):
    """Rows of a page (rep, fact_id), the cursor past its last row while rows remain, and one past its last class while classes remain."""

    rows: DataFrame
    next: Cursor | None
    next_class: Cursor | None


def _past(after: Cursor, rep: str = "rep", fact: str = "fact_id"):
    return (F.col(rep) > after[0]) | ((F.col(rep) == after[0]) & (F.col(fact) > after[1]))


def write_walk(rows: DataFrame, path: str, parts: int | None = None) -> None:
    """Write the distinct (rep, fact_id) of ``rows`` under ``path``: ``rows`` in order by part, ``bounds`` with each part's ends and count.

    Parts are ranges of the order, so a hot class lies in as many as it needs.  One shuffle for the ranges; each part is sorted alone.
    """
    spark = rows.sparkSession
    rows = rows.select(F.col("rep").cast("long").alias("rep"), F.col("fact_id").cast("long").alias("fact_id")).distinct()
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, "rep", "fact_id").withColumn("part", F.spark_partition_id()).sortWithinPartitions("part", "rep", "fact_id")
    ranged.write.option("maxRecordsPerFile", ROWS_PER_FILE).partitionBy("part").mode("overwrite").parquet(f"{path}/rows")
    written = spark.read.schema("rep long, fact_id long, part int").parquet(f"{path}/rows")
    ends = written.groupBy("part").agg(F.max(F.struct("rep", "fact_id")).alias("_z"), F.count("*").alias("n"))
    ends.select("part", F.col("_z.rep").alias("rep"), F.col("_z.fact_id").alias("fact_id"), "n").coalesce(1).write.mode("overwrite").parquet(f"{path}/bounds")


def _parts(spark: SparkSession, path: str, after: Cursor | None, limit: int) -> list[int]:
    """The parts that hold the next ``limit`` rows past the cursor: the first that reaches past it, and whole ones until there are enough."""
    bounds = spark.read.schema("part int, rep long, fact_id long, n long").parquet(f"{path}/bounds")
    ahead = bounds.where(_past(after)) if after is not None else bounds
    # One row per part, so a window without a key sees as many rows as there are parts.  Of the first part any number may lie
    # before the cursor, so it counts as none.
    order = Window.orderBy("part")
    counted = F.when(F.row_number().over(order) == 1, 0).otherwise(F.col("n")) if after is not None else F.col("n")
    got = F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return [r["part"] for r in ahead.withColumn("_n", counted).withColumn("_got", F.coalesce(got, F.lit(0))).where(F.col("_got") < limit).select("part").collect()]


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("rep long, fact_id long, part int").parquet(f"{path}/rows")


def page(spark: SparkSession, path: str, after: Cursor | None, limit: int) -> Page:
    """The next ``limit`` rows of a written walk past a cursor (None: from its beginning).

    Only the parts that hold them are read, and in these the row groups past the cursor; nothing is sorted but a page.
    """
    found = _rows(spark, path).where(F.col("part").isin(_parts(spark, path, after, limit + 1)))
    found = (found.where(_past(after)) if after is not None else found).select("rep", "fact_id")
    rows = found.orderBy("rep", "fact_id").limit(limit)
    return _page(spark, path, found.orderBy("rep", "fact_id").limit(limit + 1), rows, limit)


def _page(spark: SparkSession, path: str, more: DataFrame, rows: DataFrame, limit: int) -> Page:
    seen = more.agg(F.count("*").alias("n")).first()["n"]
    last = rows.agg(F.max(F.struct("rep", "fact_id")).alias("z")).first()["z"]
    if last is None:
        return Page(rows, None, None)
    return Page(rows, (last["rep"], last["fact_id"]) if seen > limit else None, _class_cursor(spark, path, last["rep"]))


def _class_cursor(spark: SparkSession, path: str, rep: int) -> Cursor | None:
    top = spark.read.schema("part int, rep long, fact_id long, n long").parquet(f"{path}/bounds").agg(F.max("rep")).first()[0]
    return (rep, LAST) if top > rep else None


def write_class_walk(rows: DataFrame, path: str, parts: int | None = None) -> None:
    """``write_walk``, and beside it (``classes``) a walk of the classes alone, by which pages of whole classes find their end."""
    write_walk(rows, path, parts)
    write_walk(_rows(rows.sparkSession, path).groupBy("rep").agg(F.min("fact_id").alias("fact_id")), f"{path}/classes", parts)


def class_page(spark: SparkSession, path: str, after: Cursor | None, classes: int) -> Page:
    """The rows past the cursor of the next ``classes`` classes, each whole; only ``next_class`` goes on.

    A cursor inside a class takes the rest of that class as the first.  The rows aren't collected, however many a class has.
    """
    inside = _rows(spark, path).where(_past(after)).where(F.col("rep") == after[0]).limit(1).count() if after is not None and after[1] != LAST else 0
    rest = page(spark, f"{path}/classes", (after[0], LAST) if after is not None else None, classes - inside) if classes > inside else None
    top = rest.rows.agg(F.max("rep")).first()[0] if rest is not None else None
    top = after[0] if top is None and inside else top
    rows = _rows(spark, path).where(F.lit(False) if top is None else F.col("rep") <= top)
    rows = (rows.where((F.col("rep") >= after[0]) & _past(after)) if after is not None else rows).select("rep", "fact_id")
    return Page(rows, None, None if top is None else _class_cursor(spark, path, top))

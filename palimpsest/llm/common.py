"""Tables and small column rules that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from palimpsest.scratch import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(docs: DataFrame, name: str) -> str:
    """``name``, made longer until ``docs`` has no such column."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_key() -> Column:
    """16 bytes (MD5) that tell the texts of one id apart; a null text counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def keyed_text(docs: DataFrame) -> DataFrame:
    """doc_id, text, text_key of ``docs``."""
    return docs.select("doc_id", "text", text_key().alias("text_key"))


#: Rows to drop that an anti-join sends to every task; more of them are joined by a shuffle instead.
SENT_ROWS = 200_000


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id and text are in ``gone`` (doc_id, text_key); columns are unchanged.

    Rows with a null id stay.  Rows that share an id but not the text are told apart.
    """
    gone = stored(gone.select("doc_id", "text_key").distinct(), "gone")
    key = unused(docs, "_text_key")
    gone = gone.withColumnRenamed("text_key", key)
    few = gone.count() <= SENT_ROWS
    return docs.withColumn(key, text_key()).join(F.broadcast(gone) if few else gone, ["doc_id", key], "left_anti").select(*docs.columns)


def id_remainder(doc_id: str, divisor: int) -> Column:
    """crc32 of the id written as text, modulo ``divisor``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(divisor)


def extended(schema: StructType, **more: DataType) -> StructType:
    """``schema`` with further columns at its end."""
    return StructType([*schema.fields, *(StructField(k, t) for k, t in more.items())])

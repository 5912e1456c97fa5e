"""Sharding by rendezvous hashing of stable record keys over weighted shards, in DataFrame functions only.

Each record draws one number per shard from its key and goes to the shard where weight and draw give the
least arrival time, -ln(u) / weight.  A further shard therefore takes records only into itself.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.scratch import stored

_SPAN = float(1 << 60)


def arrival(key: Column, shard: int, weight: float = 1.0) -> Column:
    """Arrival time of a key at a shard: exponential with the shard's weight as rate, fixed by key and shard."""
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", key, F.lit(str(shard))).cast("binary")), 1, 15), 16, 10).cast("double")
    return -F.log((draw + 1.0) / (_SPAN + 1.0)) / weight


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (int) of least arrival time; shards of weight 0 or less take nothing, ties go to the lower number."""
    live = [(k, w) for k, w in enumerate(weights) if w > 0]
    if not live:
        raise ValueError("no shard has a positive weight")
    times = [F.struct(arrival(key, k, w).alias("t"), F.lit(k).alias("k")) for k, w in live]
    return (F.least(*times) if len(times) > 1 else times[0])["k"]


def grown(key: Column, shard: Column, weights: Sequence[float], further: float = 1.0) -> Column:
    """The shard after one more of weight ``further`` came: the old one, or the new one."""
    old = reduce(lambda rest, k: F.when(shard == k, arrival(key, k, weights[k])).otherwise(rest), [k for k, w in enumerate(weights) if w > 0], F.lit(None).cast("double"))
    return F.when(arrival(key, len(weights), further) < old, F.lit(len(weights))).otherwise(shard)


def assign(docs: DataFrame, weights: Sequence[float], further: float = 1.0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of ``docs`` (doc_id, text).

    ``size`` is the UTF-8 length of the text (null: none) plus 16.  The law is ``key``: doc_id and the
    weights decide.  Null ids are a key of their own; rows that share an id share a shard.  ``slot``
    numbers each shard's rows from 0 without gaps, in the order of the written rows: rows are counted inside
    one written part of a shard, and the parts' sizes are summed up, so no task ever holds a shard or all
    rows of a key.  Other columns are left out.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = docs.select("doc_id", (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), key.alias("_key"))
    rows = rows.withColumn("shard", rendezvous(F.col("_key"), weights))
    rows = rows.withColumn("grown_shard", grown(F.col("_key"), F.col("shard"), weights, further)).drop("_key")
    rows = stored(rows.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "shards")
    sizes = rows.groupBy("shard", "_part").count()
    before = sizes.select("shard", "_part", (F.sum("count").over(Window.partitionBy("shard").orderBy("_part")) - F.col("count")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("shard", "_part").orderBy("_at"))
    numbered = rows.withColumn("_row", inside).join(before, ["shard", "_part"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_before") + F.col("_row") - 1).cast("long").alias("slot"), "grown_shard")


def write(docs: DataFrame, weights: Sequence[float], path: str) -> None:
    """Write ``docs`` with its columns as one folder per shard; a ``shard`` column of the input is replaced."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    spread = F.pmod(F.xxhash64(key, "text"), F.lit(64))
    docs.drop("shard").withColumn("shard", rendezvous(key, weights)).repartition("shard", spread).write.partitionBy("shard").parquet(path)

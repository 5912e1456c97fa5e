"""Entity dumps: one JSON item per line inside a bracketed list, plain, gzip or bzip2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.sources import gzip_members

_SNAK = "struct<snaktype:string,datavalue:struct<type:string,value:string>>"
#: The typed part of an item; ``value`` stays JSON text, since its form depends on ``type``.
ITEM = f"id string, type string, lastrevid bigint, labels map<string,struct<language:string,value:string>>, claims map<string,array<struct<mainsnak:{_SNAK},qualifiers:map<string,array<{_SNAK}>>,rank:string>>>, sitelinks map<string,struct<title:string>>, _corrupt string"


def read_entity_dump(spark: SparkSession, path: str, members: bool = False) -> DataFrame:
    """value, item: each item's untouched line and its JSON, without brackets, blanks and trailing commas.

    Compressed text is read by Spark's codecs; bzip2 splits, a gzip file is one task.  With ``members`` the members of
    gzip files are read in parallel (see ``gzip_members``), from a path that all tasks can open; what is damaged is left out.
    """
    if members:
        gzip_members.register(spark)
        lines = spark.read.format("gzip_members").load(path).where("error is null")
    else:
        lines = spark.read.text(path)
    item = F.regexp_replace(F.trim("value"), r",\s*$", "")
    return lines.select("value", item.alias("item")).where(~F.col("item").isin("", "[", "]"))


def parse_entities(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good items as typed columns, bad lines): malformed lines are kept apart and never fatal."""
    parsed = items.select("value", F.from_json("item", ITEM, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("x"))
    bad = F.col("x._corrupt").isNotNull() | F.col("x.id").isNull()
    none = lambda c, t: F.coalesce(F.col(c), F.create_map().cast(t)).alias(c.split(".")[1])
    good = parsed.where(~bad).select("value", "x.id", "x.type", "x.lastrevid", *[none(f"x.{c}", items.sparkSession.createDataFrame([], ITEM).schema[c].dataType) for c in ("labels", "claims", "sitelinks")])
    return good, parsed.where(bad).select("value")


def _property_view(items: DataFrame, prop: str) -> DataFrame:
    """id, targets: the item ids that one property of each item names; nothing else is decoded."""
    narrow = f"id string, claims struct<{prop}:array<struct<mainsnak:struct<datavalue:struct<value:struct<id:string>>>,rank:string>>>"
    x = items.select(F.from_json("item", narrow).alias("x"))
    claims = F.filter(F.coalesce(F.col(f"x.claims.{prop}"), F.array()), lambda c: ~F.coalesce(c["rank"] == "deprecated", F.lit(False)))
    return x.select(F.col("x.id").alias("id"), F.filter(F.transform(claims, lambda c: c["mainsnak"]["datavalue"]["value"]["id"]), lambda t: t.isNotNull()).alias("targets")).where("id is not null")


def subclass_view(items: DataFrame) -> DataFrame:
    """child, parent edges from the subclass property."""
    return _property_view(items, "P279").select(F.col("id").alias("child"), F.explode("targets").alias("parent"))


def instance_view(items: DataFrame) -> DataFrame:
    """item, types from the instance-of property."""
    return _property_view(items, "P31").select(F.col("id").alias("item"), F.col("targets").alias("types"))


def write_filtered(items: DataFrame, kept: DataFrame, path: str) -> None:
    """The untouched lines of the items whose id is in ``kept`` (item)."""
    ids = items.select("value", F.get_json_object("item", "$.id").alias("item"))
    ids.join(kept.select("item").distinct(), "item", "left_semi").select("value").write.text(path)

"""A training-corpus pipeline over ``documents``: each stage works on all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import bpe, decontam, jaccard, langid, repeats
from palimpsest.llm.common import id_remainder, table, unused
from palimpsest.scratch import stored


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, which fills in ``lang`` where it is null; those with a null text or no letter go."""
    held_out = F.coalesce(id_remainder("doc_id", 5) == 0, F.lit(True))
    model = langid.train(docs.where(~held_out).select("text", "lang"))
    told = unused(docs, "_told")
    kept = docs.withColumn(told, langid.language_of(model)("text")).where(F.col(told)["lang_pred"] != langid.UNKNOWN)
    return kept.select(*[F.coalesce("lang", F.col(told)["lang_pred"]).alias("lang") if c == "lang" else c for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest id, of each group of near copies."""
    return jaccard.keep_one(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the 200-byte strings that stand more than once among them."""
    return repeats.remove_repeats(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def token_digests(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text of each document."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", known_language),
    ("ngram_jaccard_join", one_of_each_group),
    ("suffix_array_dedup", without_repeats),
    ("benchmark_decontamination", without_benchmark),
    ("bpe_round_trip", token_digests),
]

#: Language models and byte-level merging are beyond SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

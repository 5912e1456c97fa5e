"""Data-quality rules: each gives the violating rows, and a bundle with any is rejected whole."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Payloads that suit a declared event kind.  Fixed values.
PAYLOADS = [("modified", "span"), ("damaged", "span"), ("repaired", "span"), ("moved", "span"), ("moved", "destination"), ("usage_changed", "point"), ("designated", "point")]
#: Circles that one fact's location may have.
MAX_CIRCLES = 100


def event_one_kind(edges: DataFrame, events: DataFrame) -> DataFrame:
    """event, n, fault: events (event) whose live edges (event, owner, kind) don't name exactly one owner and kind."""
    per = edges.groupBy("event").agg(F.countDistinct("owner", "kind").alias("n"))
    out = events.select("event").distinct().join(per, "event", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.where("n <> 1").withColumn("fault", F.when(F.col("n") == 0, "missing").otherwise("multiple"))


def kind_consistency(payloads: DataFrame, kinds: DataFrame) -> DataFrame:
    """Payload rows (event, payload) that don't suit the event's declared kind."""
    allowed = F.create_map(*[F.lit(v) for k in sorted({k for k, _ in PAYLOADS}) for v in (k, ",".join(p for q, p in PAYLOADS if q == k))])
    fits = F.array_contains(F.split(F.coalesce(allowed[F.col("kind")], F.lit("")), ","), F.col("payload"))
    return payloads.join(kinds, "event").where(~fits)


def ownership_changed(edges: DataFrame, pins: DataFrame) -> DataFrame:
    """Edges (event, owner, kind, fact_id) that differ from the event's first ownership."""
    first = pins.select("event", F.col("owner").alias("_o"), F.col("kind").alias("_k"))
    return edges.join(first, "event").where("owner <> _o or kind <> _k").select("event", "fact_id")


def same_event(facts: DataFrame) -> DataFrame:
    """Sameness edges between events, which are refused."""
    return facts.where("kind = 'same_event'")


def inverted_window(names: DataFrame) -> DataFrame:
    """Names whose validity ends before it begins; equal and open ends are fine."""
    return names.where("valid_to < valid_from")


def not_one_interval(facts: DataFrame) -> DataFrame:
    """Facts whose date (array of intervals) isn't exactly one interval."""
    return facts.where(F.size("date") != 1)


def bad_location(facts: DataFrame) -> DataFrame:
    """Facts whose location has no circle, or more than the limit."""
    return facts.where((F.size("circles") < 1) | (F.size("circles") > MAX_CIRCLES))


def observation_without_depiction(observations: DataFrame, depictions: DataFrame) -> DataFrame:
    """Image-cited observations without a depiction of that entity on that image."""
    return observations.join(depictions.select("image", "entity").distinct(), ["image", "entity"], "left_anti")


def composite_faults(edges: DataFrame) -> DataFrame:
    """child, fault of (child, parent) edges: self_parent, several_parents, or chain (a parent that is a child)."""
    own = edges.where("child = parent").select("child", F.lit("self_parent").alias("fault"))
    many = edges.groupBy("child").agg(F.countDistinct("parent").alias("_n")).where("_n > 1").select("child", F.lit("several_parents").alias("fault"))
    chain = edges.where("child <> parent").join(edges.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi").select("child", F.lit("chain").alias("fault"))
    return own.unionByName(many).unionByName(chain).distinct()


def retraction_targets(facts: DataFrame) -> DataFrame:
    """fact_id, fault of retractions: unknown_target, not_older, same_commit."""
    target = facts.select(F.col("fact_id").alias("retracts_fact_id"), F.col("commit_seq").alias("_c"))
    x = facts.where("retracts_fact_id is not null").join(target, "retracts_fact_id", "left")
    fault = F.when(F.col("_c").isNull(), "unknown_target").when(F.col("retracts_fact_id") >= F.col("fact_id"), "not_older").when(F.col("_c") == F.col("commit_seq"), "same_commit")
    return x.select("fact_id", fault.alias("fault")).where("fault is not null")


def supersede_targets(facts: DataFrame) -> DataFrame:
    """fact_id, fault of facts that supersede another (supersedes_fact_id, replacement_fact_id), a row per fault.

    ``same_as_replacement`` stands alone; else the target must exist before the own commit (unknown_target, same_commit), and
    the replacement in the own commit or before (unknown_replacement).
    """
    known = facts.select(F.col("fact_id").alias("_id"), F.col("commit_seq").alias("_c"))
    x = facts.where("supersedes_fact_id is not null").select("fact_id", "commit_seq", "supersedes_fact_id", "replacement_fact_id")
    apart = x.where("not (supersedes_fact_id <=> replacement_fact_id)")
    late = F.col("_c").isNull() | (F.col("_c") > F.col("commit_seq"))
    target = apart.join(known, F.col("supersedes_fact_id") == F.col("_id"), "left").select("fact_id", F.when(late, "unknown_target").when(F.col("_c") == F.col("commit_seq"), "same_commit").alias("fault"))
    other = apart.join(known, F.col("replacement_fact_id") == F.col("_id"), "left").select("fact_id", F.when(late, "unknown_replacement").alias("fault"))
    same = x.where("supersedes_fact_id <=> replacement_fact_id").select("fact_id", F.lit("same_as_replacement").alias("fault"))
    return same.unionByName(target).unionByName(other).where("fault is not null")


def commit_targets(facts: DataFrame) -> DataFrame:
    """fact_id, fault of retractions of whole commits that no earlier commit answers to."""
    known = facts.select(F.col("commit_seq").alias("_c")).distinct()
    x = facts.where("retracts_commit_seq is not null").join(known, F.col("retracts_commit_seq") == F.col("_c"), "left")
    return x.where("_c is null or _c >= commit_seq").select("fact_id", F.lit("unknown_commit").alias("fault"))


def declaration_faults(declared: DataFrame, used: DataFrame, known: DataFrame) -> DataFrame:
    """bundle, subject, fault: duplicated, unused or unknown declarations, and undeclared uses.

    ``declared`` has bundle, subject, existing; ``used`` bundle, subject; ``known`` subject.
    """
    keys = ["bundle", "subject"]
    twice = declared.groupBy(*keys).count().where("count > 1").select(*keys, F.lit("duplicated").alias("fault"))
    unused = declared.select(*keys).distinct().join(used, keys, "left_anti").select(*keys, F.lit("unused").alias("fault"))
    undeclared = used.select(*keys).distinct().join(declared, keys, "left_anti").select(*keys, F.lit("undeclared").alias("fault"))
    unknown = declared.where("existing").join(known, "subject", "left_anti").select(*keys, F.lit("unknown").alias("fault")).distinct()
    return reduce(DataFrame.unionByName, [twice, unused, undeclared, unknown])


def validate(bundles: DataFrame, violations: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, all violations with rule and rule_no): bundles with any violation are left out whole.

    ``violations`` gives the rules in their fixed order, each a frame with a ``bundle`` column.
    """
    report = reduce(DataFrame.unionByName, [v.select("bundle", F.lit(k).alias("rule_no"), F.lit(name).alias("rule")) for k, (name, v) in enumerate(violations.items())])
    return bundles.join(report.select("bundle").distinct(), "bundle", "left_anti"), report


def dedup_commits(new: DataFrame, known: DataFrame) -> DataFrame:
    """Bundles whose content address isn't known yet, once each."""
    return new.dropDuplicates(["commit_id"]).join(known.select("commit_id"), "commit_id", "left_anti")


def insert_new(batch: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't known yet, one per key."""
    return batch.dropDuplicates([key]).join(known.select(key), key, "left_anti")


def upsert_media(batch: DataFrame, known: DataFrame) -> DataFrame:
    """hash, id, is_new: the known id of each distinct content hash, else the least of the batch's own ids."""
    mine = batch.groupBy("hash").agg(F.min("id").alias("_id"))
    return mine.join(known.groupBy("hash").agg(F.min("id").alias("_known")), "hash", "left").select("hash", F.coalesce("_known", "_id").alias("id"), F.col("_known").isNull().alias("is_new"))

"""Identity: class representatives over time, and matching of declarations by exact anchors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.components import components
from palimpsest.scratch import stored


def representatives(members: DataFrame, edges: DataFrame) -> DataFrame:
    """member, rep: the smallest member of each class; a member without an edge represents itself."""
    roots = components(edges).select(F.col("node").alias("member"), "root")
    return members.select("member").distinct().join(roots, "member", "left").select("member", F.coalesce("root", "member").alias("rep"))


def resolve_reps(members: DataFrame, log: DataFrame, n: int) -> DataFrame:
    """member, rep as of snapshot n: the last log row strictly below n, else the member itself."""
    last = log.where(F.col("as_of") < n).groupBy("member").agg(F.max_by("rep", "as_of").alias("_rep"))
    return members.join(last, "member", "left").select("member", F.coalesce("_rep", "member").alias("rep"))


def class_members(log: DataFrame, n: int) -> DataFrame:
    """rep, member: members whose last row below n names the representative (the reverse of ``resolve_reps``)."""
    return log.where(F.col("as_of") < n).groupBy("member").agg(F.max_by("rep", "as_of").alias("rep")).select("rep", "member")


def update_reps(log: DataFrame, members: DataFrame, edges: DataFrame, as_of: int) -> DataFrame:
    """member, as_of, rep: the rows to append so that the log agrees with the components of all ``edges``.

    Only members whose representative changed get a row; merges and splits are the same comparison.
    """
    before = resolve_reps(members.select("member").distinct(), log, as_of)
    now = representatives(members, edges).withColumnRenamed("rep", "_now")
    return before.join(now, "member").where("rep <> _now").select("member", F.lit(as_of).cast("long").alias("as_of"), F.col("_now").alias("rep"))


def update_touched(log: DataFrame, edges: DataFrame, touched: DataFrame, as_of: int) -> DataFrame:
    """As ``update_reps``, from the classes of the ``touched`` members (ends of added or removed edges) alone.

    ``edges`` are those that hold now.  No other class can change, so components are solved over the touched
    classes' members and their edges only.
    """
    seeds = touched.select("member").distinct()
    classes = resolve_reps(seeds, log, as_of).select("rep").distinct()
    last = class_members(log, as_of).join(classes, "rep", "left_semi").select("member")
    own = stored(seeds.unionByName(last).unionByName(classes.select(F.col("rep").alias("member"))).distinct(), "touched")
    inside = edges.join(own.withColumnRenamed("member", "a"), "a", "left_semi").select("a", "b")
    return update_reps(log, own, inside, as_of)


def _anchored(decls: DataFrame, decl_refs: DataFrame, known_names: DataFrame, known_refs: DataFrame, reps: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
    """(decl, anchors: the references of a declaration, or else its names; anchor, rep and ``more`` of the known facts).

    Anchors are structs of reference, name and language.  Declarations with the same anchors have the same candidates, so
    these are found once for each set of anchors, and copies of a popular name never meet each other one by one.
    """
    none = F.lit(None)
    by_name = F.struct(none.cast(decl_refs.schema["ref"].dataType).alias("ref"), F.col("name_norm"), F.col("lang"))
    by_ref = F.struct(F.col("ref"), none.cast(decls.schema["name_norm"].dataType).alias("name_norm"), none.cast(decls.schema["lang"].dataType).alias("lang"))
    nameless = decls.join(decl_refs.select("decl").distinct(), "decl", "left_anti").where("name_norm is not null and lang is not null")
    cited = decl_refs.where("ref is not null")
    own = cited.select("decl", by_ref.alias("anchor")).unionByName(nameless.select("decl", by_name.alias("anchor")))
    sets = own.groupBy("decl").agg(F.array_sort(F.collect_set("anchor")).alias("anchors"))
    known = known_refs.select(by_ref.alias("anchor"), "entity", *more).unionByName(known_names.select(by_name.alias("anchor"), "entity", *more))
    known = known.join(reps.withColumnRenamed("member", "entity"), "entity", "left")
    return sets, known.select("anchor", F.coalesce("rep", "entity").alias("rep"), *more).distinct()


def _candidates(sets: DataFrame, known: DataFrame) -> DataFrame:
    """anchors, n_candidates, rep (the least) of each set of anchors."""
    hit = sets.select("anchors").distinct().select("anchors", F.explode("anchors").alias("anchor")).join(known.select("anchor", "rep").distinct(), "anchor")
    return hit.groupBy("anchors").agg(F.countDistinct("rep").alias("n_candidates"), F.min("rep").alias("_rep"))


def match_entities(decls: DataFrame, decl_refs: DataFrame, known_names: DataFrame, known_refs: DataFrame, reps: DataFrame) -> DataFrame:
    """decl, n_candidates, rep, outcome (matched, ambiguous or new) for each declaration.

    ``decls`` has decl, name_norm, lang; ``decl_refs`` decl, ref; the known tables entity and the anchor.
    A declaration with references is matched on references only, one without any on name and language.
    """
    sets, known = _anchored(decls, decl_refs, known_names, known_refs, reps)
    per = sets.join(_candidates(sets, known), "anchors").drop("anchors")
    out = decls.select("decl").join(per, "decl", "left").withColumn("n_candidates", F.coalesce("n_candidates", F.lit(0)))
    outcome = F.when(F.col("n_candidates") == 0, "new").when(F.col("n_candidates") == 1, "matched").otherwise("ambiguous")
    return out.select("decl", "n_candidates", F.when(F.col("n_candidates") == 1, F.col("_rep")).alias("rep"), outcome.alias("outcome"))


def match_basis(decls: DataFrame, decl_refs: DataFrame, known_names: DataFrame, known_refs: DataFrame, reps: DataFrame) -> DataFrame:
    """decl, rep, fact_id: the facts on which each matched declaration's identity rests, a row each.

    As ``match_entities``, where the known tables also have fact_id.  These rows are what the identity facts of a batch cite;
    ambiguous declarations have none, and are left out before any fact is joined.  A popular anchor's facts stay rows, so none is gathered.
    """
    sets, known = _anchored(decls, decl_refs, known_names, known_refs, reps, "fact_id")
    one = sets.join(_candidates(sets, known).where("n_candidates = 1"), "anchors", "left_semi")
    return one.select("decl", F.explode("anchors").alias("anchor")).join(known, "anchor").select("decl", "rep", "fact_id").distinct()


def match_images(decls: DataFrame, facts: DataFrame) -> DataFrame:
    """decl, n_candidates, image for declarations (decl, source_url) against known image facts (image, source_url)."""
    per = decls.join(facts, "source_url").groupBy("decl").agg(F.countDistinct("image").alias("n_candidates"), F.min("image").alias("_image"))
    return decls.select("decl").distinct().join(per, "decl", "left").select("decl", F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"), F.when(F.col("n_candidates") == 1, F.col("_image")).alias("image"))

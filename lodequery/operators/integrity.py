"""Verification and repair of a knowledge graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodequery.operators.graph import ends
from lodequery.storage import written

HIGH, MEDIUM, LOW = "HIGH", "MEDIUM", "LOW"


def _edge_key() -> list:
    return ["subject_entity_id", F.upper("predicate"), "object_entity_id"]


def issues(entities: DataFrame, relationships: DataFrame, evidence: DataFrame, mentions: DataFrame | None = None) -> DataFrame:
    """``issue, id, ref, severity``: references to entities that don't exist, missing evidence, repeated edges, entities
    without edges and mentions. Joins with missing keys are anti joins; nothing is collected."""
    # Both are read several times, so versions and filters that lie behind them are worked out once.
    known = written(entities.select("entity_id").distinct(), "known")
    relationships = written(relationships.select("relationship_id", "subject_entity_id", "predicate", "object_entity_id", "evidence_ids", "seq"), "edges")
    parts = []
    for c in ("subject_entity_id", "object_entity_id"):
        lost = relationships.select("relationship_id", F.col(c).alias("entity_id")).join(known, "entity_id", "left_anti")
        parts.append(lost.select(F.lit("INVALID_REFERENCE").alias("issue"), F.col("relationship_id").alias("id"), F.col("entity_id").alias("ref"), F.lit(HIGH).alias("severity")))
    bare = relationships.where("evidence_ids is null or size(evidence_ids) = 0")
    parts.append(bare.select(F.lit("MISSING_EVIDENCE").alias("issue"), F.col("relationship_id").alias("id"), F.lit(None).cast("string").alias("ref"), F.lit(MEDIUM).alias("severity")))
    cited = relationships.select("relationship_id", F.explode("evidence_ids").alias("evidence_id"))
    gone = cited.join(evidence.select("evidence_id").distinct(), "evidence_id", "left_anti")
    parts.append(gone.select(F.lit("MISSING_EVIDENCE").alias("issue"), F.col("relationship_id").alias("id"), F.col("evidence_id").alias("ref"), F.lit(MEDIUM).alias("severity")))
    again = relationships.withColumn("place", F.row_number().over(Window.partitionBy(*_edge_key()).orderBy("seq"))).where("place > 1")
    parts.append(again.select(F.lit("DUPLICATE_RELATIONSHIP").alias("issue"), F.col("relationship_id").alias("id"), F.lit(None).cast("string").alias("ref"), F.lit(LOW).alias("severity")))
    used = ends(relationships).select(F.col("node").alias("entity_id")).distinct()
    alone = known.join(used, "entity_id", "left_anti")
    if mentions is not None:
        alone = alone.join(mentions.select("entity_id").distinct(), "entity_id", "left_anti")
    parts.append(alone.select(F.lit("ORPHAN_ENTITY").alias("issue"), F.col("entity_id").alias("id"), F.lit(None).cast("string").alias("ref"), F.lit(LOW).alias("severity")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def verdict(found: DataFrame) -> DataFrame:
    """One row: whether the graph is valid (no issue of high severity) and how many issues there are."""
    return found.agg((F.count_if(F.col("severity") == HIGH) == 0).alias("valid"), F.count("*").alias("issues"))


def repair(entities: DataFrame, relationships: DataFrame, evidence: DataFrame) -> DataFrame:
    """Edges without those that lead nowhere, without evidence that doesn't exist, and with repeated edges merged into the
    first: its evidence is all of theirs, its confidence the greatest."""
    known = entities.select("entity_id").distinct()
    whole = relationships
    for c in ("subject_entity_id", "object_entity_id"):
        whole = whole.join(known.withColumnRenamed("entity_id", c), c, "left_semi")
    whole = written(whole.select("relationship_id", "subject_entity_id", "predicate", "object_entity_id", "confidence", "evidence_ids", "seq"), "whole")
    cited = whole.select("relationship_id", F.posexplode("evidence_ids").alias("at", "evidence_id"))
    there = cited.join(evidence.select("evidence_id").distinct(), "evidence_id", "left_semi")
    lists = there.groupBy("relationship_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "evidence_id"))), lambda x: x["evidence_id"]).alias("kept"))
    pruned = whole.join(lists, "relationship_id", "left").withColumn("kept", F.array_distinct(F.coalesce("kept", F.array().cast("array<string>"))))
    merged = pruned.groupBy("subject_entity_id", F.upper("predicate").alias("predicate"), "object_entity_id")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "kept"))), lambda x: x["kept"])
    return merged.agg(F.min_by("relationship_id", "seq").alias("relationship_id"), F.max("confidence").alias("confidence"), F.array_distinct(F.flatten(ordered)).alias("evidence_ids"), F.count("*").alias("merged"))


def repair_actions(entities: DataFrame, relationships: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row: ``deleted`` edges that lead nowhere, ``pruned`` ids of evidence that doesn't exist (of the other edges),
    ``merged`` repeated edges: what :func:`repair` does."""
    known = entities.select("entity_id").distinct()
    whole = relationships
    for c in ("subject_entity_id", "object_entity_id"):
        whole = whole.join(known.withColumnRenamed("entity_id", c), c, "left_semi")
    one = lambda df, name: df.agg(F.count("*").alias(name))
    deleted = one(relationships, "a").join(one(whole, "b")).select((F.col("a") - F.col("b")).alias("deleted"))
    cited = whole.select("relationship_id", F.explode("evidence_ids").alias("evidence_id"))
    pruned = one(cited.join(evidence.select("evidence_id"), "evidence_id", "left_anti"), "pruned")
    same = whole.groupBy("subject_entity_id", F.upper("predicate"), "object_entity_id").agg((F.count("*") - 1).alias("n"))
    return deleted.join(pruned).join(same.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("merged")))  # one row each

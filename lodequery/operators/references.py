"""Problem 3: references to records that are missing, deleted or written later.

Method: parents are range-partitioned by key and kept as sorted arrays, one per range; batches of references are
probed against the array of their range by binary search; the misses are rows, or are counted per table and month.

A range holds a bounded number of parents because its bounds are quantiles of the parents' keys. The references of one
range can be any number (one entity may be named by a third of them), so each range is cut into as many slices of
references as its count asks for, and its parents are sent to every slice: no task ever holds more than
``slice_refs`` references and one range of parents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from lodequery.operators.versions import current_version
from lodequery.storage import written

#: Parents in a range, references in a slice, and keys sampled for each range's bounds.
RANGE_PARENTS = 100_000
SLICE_REFS = 200_000
KEYS_PER_RANGE = 40
#: At most so many ranges, so that their bounds stay small in every task's closure. Of more parents each range is cut further,
#: by a hash of the key that its references and parents share.
MOST_RANGES = 10_000

ENTITY, EVIDENCE = "entity", "evidence"
MISSING, DELETED, LATER = "missing", "deleted", "later"


def _blank(c: Column) -> Column:
    return F.trim(c, F.lit(" \t\r\n")) == ""


def references(relationships: DataFrame) -> DataFrame:
    """``relationship_id, ref_field, kind, ref_id, created_at``: every reference of the current versions, once."""
    r = current_version(relationships, "relationship_id").select("relationship_id", "created_at", "subject_entity_id", "object_entity_id", "evidence_ids")
    ends = [F.struct(F.lit(f).alias("ref_field"), F.lit(ENTITY).alias("kind"), F.col(f).alias("ref_id")) for f in ("subject_entity_id", "object_entity_id")]
    seen = F.transform(
        F.array_distinct(F.coalesce("evidence_ids", F.array().cast("array<string>"))),
        lambda e: F.struct(F.lit("evidence_ids").alias("ref_field"), F.lit(EVIDENCE).alias("kind"), e.alias("ref_id")),
    )
    r = r.select("relationship_id", "created_at", F.explode(F.concat(F.array(*ends), seen)).alias("r")).select("relationship_id", "created_at", "r.*")
    return r.where(F.col("ref_id").isNotNull() & ~_blank(F.col("ref_id")))


def parents(entities: DataFrame, evidence: DataFrame, deletions: DataFrame) -> DataFrame:
    """``kind, id, first_at, dead``: one row per stored key; dead if its latest deletion is not before its last write."""
    rows = (
        entities.select(F.lit(ENTITY).alias("kind"), F.col("entity_id").alias("id"), "created_at", F.col("updated_at").alias("wrote"), F.lit(None).cast("timestamp_ntz").alias("gone"))
        .unionByName(evidence.select(F.lit(EVIDENCE).alias("kind"), F.col("evidence_id").alias("id"), "created_at", F.col("created_at").alias("wrote"), F.lit(None).cast("timestamp_ntz").alias("gone")))
        .unionByName(deletions.select(F.col("record_kind").alias("kind"), F.col("record_id").alias("id"), F.lit(None).cast("timestamp_ntz").alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("wrote"), F.col("deleted_at").alias("gone")))
    )
    each = rows.where("id is not null").groupBy("kind", "id").agg(F.min("created_at").alias("first_at"), F.max("wrote").alias("wrote"), F.max("gone").alias("gone"))
    # A key that occurs only in the log of deletions has no row, so it is no parent.
    return each.where("wrote is not null or first_at is not null").select("kind", "id", "first_at", F.coalesce(F.expr("gone >= wrote"), F.lit(False)).alias("dead"))


def _probe(key: tuple, refs: pa.Table, stored: pa.Table) -> pa.Table:
    """Binary search of all references of a slice in the sorted keys of its range."""
    keys = stored.column("key").to_numpy(zero_copy_only=False)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    wanted = refs.column("key").to_numpy(zero_copy_only=False)
    at = np.searchsorted(keys, wanted) if len(keys) else np.zeros(len(wanted), np.int64)
    near = np.minimum(at, max(len(keys) - 1, 0))
    there = (keys[near] == wanted).astype(bool) if len(keys) else np.zeros(len(wanted), bool)
    pick = order[near] if len(keys) else near
    dead = there & (stored.column("dead").to_numpy(zero_copy_only=False).astype(bool)[pick] if len(keys) else False)
    first = stored.column("first_at").cast(pa.timestamp("us")).to_numpy(zero_copy_only=False) if len(keys) else np.zeros(1, "M8[us]")
    made = refs.column("created_at").cast(pa.timestamp("us")).to_numpy(zero_copy_only=False)
    later = there & ~dead & (first[pick] > made if len(keys) else False)  # a comparison with a null time is false
    why = np.where(~there, MISSING, np.where(dead, DELETED, np.where(later, LATER, "")))
    miss = why != ""
    return refs.filter(pa.array(miss)).select(["relationship_id", "ref_field", "ref_id", "created_at"]).append_column("reason", pa.array(why[miss].tolist(), pa.string()))


def orphan_references(relationships: DataFrame, entities: DataFrame, evidence: DataFrame, deletions: DataFrame, range_parents: int = RANGE_PARENTS, slice_refs: int = SLICE_REFS, most_ranges: int = MOST_RANGES) -> DataFrame:
    """``relationship_id, ref_field, ref_id, created_at, reason`` of every reference that does not resolve.

    reason is ``missing`` (no row has the id), ``deleted`` (latest deletion not before the last write) or ``later``
    (the target's earliest created_at is after the relationship's created_at), the first that applies.

    Edge cases: null and blank references, null array elements and repeated elements count as none or once; a null
    relationship_id is no relationship; times that are null never make a reference an orphan; empty parent tables make
    every reference ``missing``; other columns, whatever their names, are not read.
    """
    spark = relationships.sparkSession
    refs = written(references(relationships).withColumn("key", F.concat_ws("/", "kind", "ref_id")), "refs")
    stored = written(parents(entities, evidence, deletions).withColumn("key", F.concat_ws("/", "kind", "id")).select("key", "first_at", "dead"), "parents")
    n = stored.count()
    ranges = min(most_ranges, max(1, -(-n // range_parents)))
    cuts = max(1, -(-n // (ranges * range_parents)))
    bounds: list[str] = []
    if ranges > 1:
        share = min(1.0, KEYS_PER_RANGE * ranges / n)
        keys = sorted(r[0] for r in stored.select("key").sample(share, seed=7).collect())
        bounds = sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []
    edges = np.array(bounds, dtype=object)

    @F.pandas_udf(IntegerType())
    def range_of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series(np.searchsorted(edges, s.to_numpy(dtype=object), side="right").astype(np.int32))

    at = range_of("key") if bounds else F.lit(0)
    cut = F.pmod(F.xxhash64("key"), F.lit(cuts)).cast("int") if cuts > 1 else F.lit(0)
    refs, stored = (df.withColumn("r", at).withColumn("h", cut) for df in (refs, stored))
    # A row a range; the cuts of a range are even but for hot keys, and as many slices are made for each of them.
    counts = {r["r"]: -(-r["n"] // slice_refs) for r in refs.groupBy("r", "h").agg(F.count("*").alias("n")).groupBy("r").agg(F.max("n").alias("n")).collect()}
    slices = spark.createDataFrame([(int(k), int(v)) for k, v in counts.items()] or [(0, 1)], "r int, n int")  # at most most_ranges rows
    refs = refs.join(F.broadcast(slices), "r").withColumn("s", F.pmod(F.xxhash64("relationship_id", "ref_field"), F.col("n")).cast("int")).drop("n")
    stored = stored.join(F.broadcast(slices), "r").withColumn("s", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("n")
    refs = refs.select("r", "h", "s", "key", "relationship_id", "ref_field", "ref_id", "created_at")
    return refs.groupBy("r", "h", "s").cogroup(stored.select("r", "h", "s", "key", "first_at", "dead").groupBy("r", "h", "s")).applyInArrow(_probe, "relationship_id string, ref_field string, ref_id string, created_at timestamp_ntz, reason string")


def orphan_report(orphans: DataFrame) -> DataFrame:
    """``target_table, ref_field, period, reason, n_orphans``: misses per table and month of the relationship."""
    table = F.when(F.col("ref_field") == "evidence_ids", "evidence").otherwise("entities")
    return orphans.groupBy(table.alias("target_table"), "ref_field", F.date_format("created_at", "yyyy-MM").alias("period"), "reason").agg(F.count("*").alias("n_orphans"))

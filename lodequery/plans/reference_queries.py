"""Queries of problem 3 over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodequery.operators.references import orphan_references, orphan_report
from lodequery.sources.tables import table


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_references(*(table(spark, sf_dir, t) for t in ("relationships", "entities", "evidence", "deletions")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).select("relationship_id", "ref_field", "ref_id", F.date_format("created_at", "yyyy-MM").alias("period"))


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_report(_orphans(spark, sf_dir))


QUERIES = {"p3_found": p3_found, "p3_report": p3_report}

_ORPHANS = """
with cur as (
  select * from relationships where relationship_id is not null
  qualify row_number() over (partition by relationship_id order by updated_at desc nulls last, seq desc nulls last) = 1),
refs as (
  select relationship_id, created_at, 'subject_entity_id' as ref_field, 'entity' as kind, subject_entity_id as ref_id from cur
  union all select relationship_id, created_at, 'object_entity_id', 'entity', object_entity_id from cur
  union all select distinct relationship_id, created_at, 'evidence_ids', 'evidence', unnest(evidence_ids) from cur),
stored as (
  select 'entity' as kind, entity_id as id, min(created_at) as first_at, max(updated_at) as wrote from entities group by all
  union all select 'evidence', evidence_id, min(created_at), max(created_at) from evidence group by all),
gone as (select record_kind as kind, record_id as id, max(deleted_at) as gone from deletions group by all),
orphans as (
  select relationship_id, ref_field, ref_id, refs.created_at,
    case when s.id is null then 'missing' when g.gone >= s.wrote then 'deleted' when s.first_at > refs.created_at then 'later' end as reason
  from refs left join stored s on s.kind = refs.kind and s.id = refs.ref_id
  left join gone g on g.kind = refs.kind and g.id = refs.ref_id
  where ref_id is not null and trim(ref_id, E' \\t\\r\\n') <> '')
"""

ORACLE = {
    "p3_found": _ORPHANS + "select relationship_id, ref_field, ref_id, strftime(created_at, '%Y-%m') as period from orphans where reason is not null",
    "p3_report": _ORPHANS + """select case ref_field when 'evidence_ids' then 'evidence' else 'entities' end as target_table, ref_field,
      strftime(created_at, '%Y-%m') as period, reason, count(*) as n_orphans from orphans where reason is not null group by all""",
}

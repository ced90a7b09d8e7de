"""Documents into the knowledge graph: chunks, mentions, resolved entities, relations with evidence, merged edges.

All ids are made of what they name, so a document that is ingested again replaces what it gave before.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodequery.functions.text import canonical_id, normalize_name
from lodequery.operators.chunking import chunk_documents
from lodequery.operators.extract import extract_mentions, extract_relations
from lodequery.operators.graph import delete_documents, merge_edges
from lodequery.operators.resolve import resolve
from lodequery.storage import written

SIZE, OVERLAP = 512, 64


@dataclass
class Graph:
    entities: DataFrame  # entity_id, canonical_name, entity_type, aliases, seq
    relationships: DataFrame  # relationship_id, subject_entity_id, predicate, object_entity_id, confidence, evidence_ids, seq
    evidence: DataFrame  # evidence_id, document_id, chunk_id, source_text_reference, extraction_method, confidence
    mentions: DataFrame  # mention_id, entity_id, document_id, chunk_id, text, start_offset, end_offset, confidence


SCHEMAS = {
    "entities": "entity_id string, canonical_name string, entity_type string, aliases array<string>, seq bigint",
    "relationships": "relationship_id string, subject_entity_id string, predicate string, object_entity_id string, confidence double, evidence_ids array<string>, seq bigint",
    "evidence": "evidence_id string, document_id string, chunk_id string, source_text_reference string, extraction_method string, confidence double",
    "mentions": "mention_id string, entity_id string, document_id string, chunk_id string, text string, start_offset int, end_offset int, confidence double",
}


def empty_graph(spark) -> Graph:
    return Graph(**{n: spark.createDataFrame([], s) for n, s in SCHEMAS.items()})


def _id(prefix: str, *parts: str):
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16))


def ingest(graph: Graph, documents: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> Graph:
    """The graph with ``document_id, text`` added. Names with one slug are one entity."""
    kept, evidence, mentions = delete_documents(graph.relationships, graph.evidence, graph.mentions, documents)
    chunks = written(chunk_documents(documents, size, overlap), "chunks")
    found = written(extract_mentions(chunks), "found")
    names = found.select("entity_type", "name").distinct().withColumn("candidate_id", F.concat_ws("|", "entity_type", "name"))
    known = resolve(names, graph.entities).where("entity_id is not null").select("candidate_id", "entity_id")
    named = written(names.join(known, "candidate_id", "left").withColumn("id", F.coalesce("entity_id", canonical_id(F.col("entity_type"), F.col("name")))).withColumn("new", F.col("entity_id").isNull()), "named")
    last = graph.entities.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    fresh = named.groupBy(F.col("id").alias("entity_id")).agg(F.min("name").alias("canonical_name"), F.first("entity_type").alias("entity_type"), F.array_sort(F.collect_set("name")).alias("aliases"), F.bool_and("new").alias("new"))
    # Names new to a known entity become its aliases.
    grown = graph.entities.join(fresh.select("entity_id", F.col("aliases").alias("more")), "entity_id", "left")
    grown = grown.withColumn("aliases", F.when(F.col("more").isNull(), F.col("aliases")).otherwise(F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.filter("more", lambda m: ~F.exists(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda a: normalize_name(a) == normalize_name(m))))))
    added = fresh.join(graph.entities.select("entity_id"), "entity_id", "left_anti").select("entity_id", "canonical_name", "entity_type", "aliases", (F.lit(last) + 1 + F.abs(F.xxhash64("entity_id"))).alias("seq"))
    entities = grown.select(*[c.split(" ")[0] for c in SCHEMAS["entities"].split(", ")]).unionByName(added)
    ids = named.select("entity_type", "name", F.col("id").alias("entity_id"))
    made = found.join(ids, ["entity_type", "name"]).withColumn("mention_id", _id("men_", "document_id", "chunk_id", "start_offset", "end_offset", "entity_id"))
    new_mentions = made.select("mention_id", "entity_id", "document_id", "chunk_id", F.col("name").alias("text"), "start_offset", "end_offset", "confidence")
    # A name may be mentioned with several types; a relation means the first.
    by_name = ids.groupBy("name").agg(F.min_by("entity_id", "entity_type").alias("entity_id"))
    rel = extract_relations(chunks)
    rel = rel.join(by_name.toDF("subject", "subject_entity_id"), "subject").join(by_name.toDF("object", "object_entity_id"), "object").where("subject_entity_id <> object_entity_id")
    rel = rel.withColumn("evidence_id", _id("ev_", "document_id", "chunk_id", "subject_entity_id", "predicate", "object_entity_id", "sentence")).dropDuplicates(["evidence_id"])
    rel = written(rel, "relations")
    new_evidence = rel.select("evidence_id", "document_id", "chunk_id", F.col("sentence").alias("source_text_reference"), F.lit("RULE_BASED").alias("extraction_method"), "confidence")
    edges = rel.select(_id("rel_", "subject_entity_id", "predicate", "object_entity_id").alias("relationship_id"), "subject_entity_id", "predicate", "object_entity_id", "confidence", F.array("evidence_id").alias("evidence_ids"), F.abs(F.xxhash64("evidence_id")).alias("seq"))
    merged = merge_edges(kept, edges).select(*[c.split(" ")[0] for c in SCHEMAS["relationships"].split(", ")])
    return Graph(entities, merged, evidence.unionByName(new_evidence), mentions.unionByName(new_mentions))

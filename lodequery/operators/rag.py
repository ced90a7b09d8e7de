"""Graph-aware reranking of passages and answers that cite their evidence."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodequery.functions.similarity import clamp
from lodequery.functions.text import humanize
from lodequery.operators import graph as G
from lodequery.operators.extract import mentions_in
from lodequery.operators.search import hybrid_search
from lodequery.storage import remove, written

VECTOR_WEIGHT, SPARSE_WEIGHT, GRAPH_WEIGHT, BOOST = 0.35, 0.15, 0.5, 0.2
TOP_K, RAG_NODES, RAG_EDGES, SNIPPET = 5, 50, 100, 150
#: An answer without evidence, and the first line of one with it.
NOTHING = "Insufficient verified evidence found in local Knowledge Graph or documents to answer this query."
HEADING = "Based on verified local source evidence:"


def _nearest(near: list[tuple[str, int]], backed: list[tuple[str, str, float]]):
    """Adds ``distance`` and ``boost``: the least distance of an entity named in the text, the greatest confidence of
    evidence of the chunk or quoted in the text."""
    chunks: dict[str, float] = {}
    for chunk, _, confidence in backed:
        chunks[chunk] = max(chunks.get(chunk, 0.0), confidence)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            distance, boost = [], []
            for text, chunk in zip(b.column("text").to_pylist(), b.column("chunk_id").to_pylist()):
                low = (text or "").lower()
                distance.append(min((d for name, d in near if name in low), default=999))
                boost.append(max([chunks.get(chunk, 0.0), *(c for _, quote, c in backed if quote and quote in (text or ""))]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(distance, pa.int32()), pa.array(boost, pa.float64())], [*b.schema.names, "distance", "boost"])

    return run


def rerank(passages: DataFrame, entities: DataFrame, evidence: DataFrame, k: int = TOP_K, vector: float = VECTOR_WEIGHT, sparse: float = SPARSE_WEIGHT, graph: float = GRAPH_WEIGHT) -> DataFrame:
    """``passage_id, score``: passages (``passage_id, seq, text, chunk_id, score``) by their score and their distance to the
    query's entities (``name, distance``: 0 for those of the query, 1 for those reached), raised by the greatest confidence
    of evidence (``chunk_id, quote, confidence``) of the same chunk or quoted in the text.

    Entities and evidence are those of the walks of one query, at most RAG_NODES and RAG_EDGES for each of its anchors;
    all of them are gathered and sent along, the passages, of any number, are read once.
    """
    near = [(r["name"].lower(), int(r["distance"])) for r in entities.where("name is not null").groupBy("name").agg(F.min("distance").alias("distance")).collect()]
    backed = [(r["chunk_id"], r["quote"], float(r["confidence"] or 0.0)) for r in evidence.groupBy("chunk_id", "quote").agg(F.max("confidence").alias("confidence")).collect()]
    rows = passages.select("passage_id", "seq", "text", "chunk_id", F.col("score").cast("double").alias("score"))
    types = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    rows = rows.mapInArrow(_nearest(near, backed), f"{types}, distance int, boost double")
    distance, boost = F.col("distance"), F.col("boost")
    total = vector + sparse + graph
    proximity = F.when(distance == 0, 1.0).when(distance == 1, 0.75).when(distance == 2, 0.5).when(distance <= 4, 0.2).otherwise(0.0)
    base = clamp(F.coalesce("score", F.lit(0.0)), 0.0, 1.0)
    score = F.round((vector + sparse) / total * base + graph / total * F.least(F.lit(1.0), proximity + boost * BOOST), 4)
    return rows.withColumn("reranked", score).orderBy(F.col("reranked").desc(), "seq").limit(k).select("passage_id", F.col("reranked").alias("score"))


def claims(entities: DataFrame, relationships: DataFrame, evidence: DataFrame) -> DataFrame:
    """``relationship_id, claim, citations``: an edge as a sentence, and its evidence as "document#chunk" in order."""
    names = entities.select("entity_id", "canonical_name")
    r = relationships.join(names.toDF("subject_entity_id", "s"), "subject_entity_id", "left").join(names.toDF("object_entity_id", "o"), "object_entity_id", "left")
    text = F.concat_ws(" ", F.coalesce("s", "subject_entity_id"), humanize(F.col("predicate")), F.coalesce("o", "object_entity_id"))
    cited = r.select("relationship_id", F.posexplode("evidence_ids").alias("at", "evidence_id")).join(evidence.select("evidence_id", F.concat("document_id", F.lit("#"), "chunk_id").alias("c")), "evidence_id")
    lists = cited.groupBy("relationship_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "c"))), lambda x: x["c"]), ", ").alias("citations"))  # an edge's own evidence
    return r.select("relationship_id", "seq", text.alias("claim")).join(lists, "relationship_id", "left").select("relationship_id", "seq", "claim", F.coalesce("citations", F.lit("KG-Edge")).alias("citations"))


def sources(passages: DataFrame, evidence: DataFrame) -> DataFrame:
    """``document_id, chunk_id, reference``: where passages (``document_id, chunk_id, reference, seq``) and evidence come
    from, each chunk once, as the first passage or else the first evidence names it."""
    both = passages.select("document_id", "chunk_id", "reference", F.struct(F.lit(0).alias("side"), F.col("seq")).alias("at")).unionByName(
        evidence.select("document_id", "chunk_id", F.col("source_text_reference").alias("reference"), F.struct(F.lit(1).alias("side"), F.col("seq")).alias("at"))
    )
    first = both.groupBy("document_id", "chunk_id").agg(F.min_by(F.struct("reference"), "at").alias("f"))
    return first.select("document_id", "chunk_id", F.col("f.reference").alias("reference"))


def coverage(entities: int, relationships: int) -> float:
    """How far the graph covers a query: 1 with edges, a half with entities only, 0 without."""
    return (1.0 if relationships else 0.5) if entities else 0.0


def evidence_confidence(relationships: DataFrame, evidence: DataFrame) -> DataFrame:
    """``relationship_id, mean_confidence, max_confidence`` of the stored evidence of each edge."""
    cited = relationships.select("relationship_id", F.explode(F.array_distinct("evidence_ids")).alias("evidence_id"))
    each = cited.join(evidence.select("evidence_id", "confidence"), "evidence_id").groupBy("relationship_id")
    return each.agg(F.avg("confidence").alias("mean_confidence"), F.max("confidence").alias("max_confidence"))


#: Headings of a context's text.
PASSAGES_HEADING, EDGES_HEADING, EVIDENCE_HEADING = "=== Verified Evidence Passages ===", "=== Knowledge Graph Relationships ===", "=== Supporting Source Assertions ==="


@dataclass
class Answer:
    text: str
    confidence: float
    status: str
    claims: list[tuple[str, str]] = field(default_factory=list)
    passages: list[tuple[str, float]] = field(default_factory=list)
    coverage: float = 0.0
    sources: list[tuple[str, str, str | None]] = field(default_factory=list)
    context: str = ""


def context_text(query: str, passages: list[dict], edges: list[dict], evidence: list[dict]) -> str:
    """What a model is given: passages with their scores, edges and quoted evidence with their confidence, if there are any."""
    parts = [f"Query: {query}", "", PASSAGES_HEADING]
    parts += [f"[Doc: {p['document_id']} / Chunk: {p['chunk_id']}] (Score: {p['score']:.3f}):\n{p['text']}" for p in passages]
    if edges:
        parts += ["", EDGES_HEADING, *(f"- {e['subject_entity_id']} --[{e['predicate']}]--> {e['object_entity_id']} (Confidence: {e['confidence'] or 0.0:.2f})" for e in edges)]
    if evidence:
        parts += ["", EVIDENCE_HEADING, *(f"- \"{v['quote']}\" (Method: {v['method']}, Confidence: {v['confidence'] or 0.0:.2f})" for v in evidence)]
    return "\n".join(parts)


def answer(records: DataFrame, entities: DataFrame, relationships: DataFrame, evidence: DataFrame, query: str, k: int = TOP_K, depth: int = G.DEPTH, dimension: int = 64, extract: Callable[[str], list[tuple]] = mentions_in, generate: Callable[[str], str] | None = None) -> Answer:
    """Entities of the query (or of the three best passages), their neighbourhood, hybrid search, rerank, cited claims.

    Everything collected is one query's: 2 k passages, RAG_NODES entities and RAG_EDGES edges for each anchor. ``extract``
    finds the names in a text (first of each tuple); ``generate`` makes the answer's text out of the context's.
    """
    anchors = _anchors(entities, [query], extract)
    found = hybrid_search(records, query, k=2 * k, dimension=dimension).join(records.select("id", "seq", "text", "metadata"), "id")
    place = lambda key, other: F.coalesce(F.get_json_object("metadata", key), F.col(other))
    passages = written(found.select(F.col("id").alias("passage_id"), "seq", "text", place("$.chunk_id", "id").alias("chunk_id"), place("$.document_id", "id").alias("document_id"), F.get_json_object("metadata", "$.source").alias("reference"), "score"), "passages")
    starts = anchors or _anchors(entities, [r["text"] or "" for r in passages.orderBy(F.col("score").desc(), "seq").limit(3).collect()], extract)
    nodes: dict[str, None] = {}
    edges: dict[str, None] = {}
    for a in starts:
        n = G.neighbors(entities, relationships, a, depth, max_nodes=RAG_NODES, max_edges=RAG_EDGES)
        nodes |= dict.fromkeys(n.nodes)
        edges |= dict.fromkeys(n.edges)
    near = entities.where(F.col("entity_id").isin(list(nodes) or [""])).select(F.col("canonical_name").alias("name"), F.when(F.col("entity_id").isin(anchors or [""]), 0).otherwise(1).alias("distance"))
    used = relationships.where(F.col("relationship_id").isin(list(edges) or [""]))
    backing = evidence.join(used.select(F.explode("evidence_ids").alias("evidence_id")).distinct(), "evidence_id", "left_semi")
    best = [(r["passage_id"], r["score"]) for r in rerank(passages, near, backing.select("chunk_id", F.col("source_text_reference").alias("quote"), "confidence"), k).collect()]
    made = [(r["claim"], r["citations"]) for r in claims(entities, used, backing).orderBy("seq").collect()]
    mean = backing.agg(F.avg("confidence")).first()[0]
    if not made and not best:
        remove(passages)
        return Answer(NOTHING, 0.0, "UNSUPPORTED", coverage=coverage(len(nodes), len(edges)))
    kept = {r["passage_id"]: r.asDict() for r in passages.where(F.col("passage_id").isin([p for p, _ in best])).collect()}
    shown = [kept[p] | {"score": score} for p, score in best]
    if not made:
        top = shown[0]
        made = [((top["text"] or "")[:SNIPPET].replace("\n", " "), top["chunk_id"])]
    quoted = [{"quote": r["source_text_reference"], "method": r["extraction_method"] if "extraction_method" in r else None, "confidence": r["confidence"], "at": (r["document_id"], r["chunk_id"])} for r in backing.orderBy("evidence_id").collect()]
    context = context_text(query, shown, [r.asDict() for r in used.orderBy("seq").collect()], quoted)
    named: dict[tuple, str | None] = {}
    for at, reference in [*(((p["document_id"], p["chunk_id"]), p["reference"]) for p in shown), *((v["at"], v["quote"]) for v in quoted)]:
        named.setdefault(at, reference)
    confidence = mean if mean is not None else min(0.9, best[0][1]) if best else 0.5
    text = generate(context) if generate else "\n".join([HEADING, *[f"- {c} [{w}]" for c, w in made]])
    remove(passages)
    return Answer(text, round(confidence, 2), "SUPPORTED" if made else "PARTIALLY_SUPPORTED", made, best, coverage(len(nodes), len(edges)), [(*at, r) for at, r in named.items()], context)


def _anchors(entities: DataFrame, texts: list[str], extract: Callable[[str], list[tuple]]) -> list[str]:
    out: dict[str, None] = {}
    for name in dict.fromkeys(m[0] for t in texts for m in extract(t)):
        first = G.find_entities(entities, name=name).orderBy("seq").limit(1).select("entity_id").collect()
        out |= dict.fromkeys(r[0] for r in first)
    return list(out)

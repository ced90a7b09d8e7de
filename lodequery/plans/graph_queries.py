"""Queries over the knowledge graph's whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodequery.functions.similarity import levenshtein_similarity
from lodequery.functions.text import canonical_id, normalize_name, strip_company
from lodequery.operators import graph as G
from lodequery.operators import integrity as I
from lodequery.operators.chunking import chunk_documents
from lodequery.operators.extract import CATALOG, KNOWN, extract_mentions, extract_relations
from lodequery.operators.ingest import empty_graph, ingest
from lodequery.operators.rag import evidence_confidence as evidence_confidence_of
from lodequery.operators.rag import sources
from lodequery.operators.resolve import resolve
from lodequery.operators.versions import current_version
from lodequery.sources.tables import table

HUB = "ent_technology_shared_runtime_00"


def graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return (
        current_version(table(spark, d, "entities"), "entity_id"),
        current_version(table(spark, d, "relationships"), "relationship_id"),
        current_version(table(spark, d, "evidence"), "evidence_id", ("created_at", "seq")),
    )


def degree_counts(spark, d):
    return G.degrees(graph(spark, d)[1])


def reach_d2(spark, d):
    e, r, _ = graph(spark, d)
    return G.reach(r, e.select(F.col("entity_id").alias("start")), 2)


def reach_predicate(spark, d):
    e, r, _ = graph(spark, d)
    return G.reach(r, e.select(F.col("entity_id").alias("start")), 2, G.BOTH, ["located_in"]).where("node <> start")


def shortest_path_len(spark, d):
    e, r, _ = graph(spark, d)
    """The length of the shortest path from the hub to every entity, against the direction of the edges."""
    return G.reach(r, e.where(F.col("entity_id") == HUB).select(F.col("entity_id").alias("start")), 3, G.IN).select(F.col("node").alias("start"), "depth")


def neighbors_capped(spark, d):
    e, r, _ = graph(spark, d)
    n = G.neighbors(e, r, HUB)
    return spark.createDataFrame([(k, v) for k, v in n.depth.items()], "entity_id string, depth int")


def neighbors_deep(spark, d):
    """From an entity of few edges, two steps."""
    e, r, _ = graph(spark, d)
    n = G.neighbors(e, r, _few_edges(r))
    return spark.createDataFrame([(k, v) for k, v in n.depth.items()], "entity_id string, depth int")


def _few_edges(r) -> str:
    """The first of the entities that most outbound edges lead from, but for the hubs."""
    return G.degrees(r).where("edges between 2 and 9").orderBy(F.col("out_degree").desc(), "entity_id").first()[0]


def related_entities(spark, d):
    e, r, _ = graph(spark, d)
    return spark.createDataFrame([(n,) for n in G.related_entities(e, r, _few_edges(r), 1)], "entity_id string")


def find_paths(spark, d):
    e, r, _ = graph(spark, d)
    paths = G.find_paths(e, r, HUB, "ent_technology_shared_runtime_01", 2)
    return spark.createDataFrame([(i, ">".join(n), ">".join(x)) for i, (n, x) in enumerate(paths)], "path int, nodes string, edges string")


def related_documents(spark, d):
    _, r, v = graph(spark, d)
    return G.related_documents(r, v)


def evidence_for_entity(spark, d):
    _, r, v = graph(spark, d)
    return G.entity_evidence(r, v).groupBy("entity_id").agg(F.count("*").alias("n_evidence"), F.countDistinct("document_id").alias("n_documents"))


def provenance(spark, d):
    return G.provenance(*graph(spark, d))


def graph_counts(spark, d):
    e, r, v = graph(spark, d)
    one = lambda df, n: df.agg(F.count("*").alias("n")).select(F.lit(n).alias("kind"), "n")
    return one(e, "entities").unionByName(one(r, "relationships")).unionByName(one(v, "evidence"))


def entity_filter(spark, d):
    return G.find_entities(graph(spark, d)[0], name=" Graph  ENGINE", kind="TECHNOLOGY").select("entity_id")


def relationship_filter(spark, d):
    return G.find_relationships(graph(spark, d)[1], predicate="depends_on", object_=HUB).select("relationship_id")


def verify_issues(spark, d):
    return I.issues(*graph(spark, d))


def verify_verdict(spark, d):
    return I.verdict(I.issues(*graph(spark, d)))


def repair_merge(spark, d):
    r = I.repair(*graph(spark, d))
    return r.select("relationship_id", "predicate", F.round("confidence", 6).alias("confidence"), F.size("evidence_ids").alias("n_evidence"), "merged")


def repair_actions(spark, d):
    return I.repair_actions(*graph(spark, d))


def evidence_confidence(spark, d):
    _, r, v = graph(spark, d)
    x = evidence_confidence_of(r, v)
    return x.select("relationship_id", F.round("mean_confidence", 6).alias("mean_confidence"), "max_confidence")


def answer_sources(spark, d):
    """Sources of all records with a document and of all evidence."""
    _, _, v = graph(spark, d)
    r = current_version(table(spark, d, "vector_records"), "id").where("content_ref is not null")
    passages = r.select(F.col("content_ref").alias("document_id"), F.col("collection_id").alias("chunk_id"), F.col("id").alias("reference"), "seq")
    return sources(passages, v)


def create_problems(spark, d):
    """All rows of the relationships, versions too, checked as if they were to be created in a graph of the entities alone."""
    e, r, _ = graph(spark, d)
    rows = table(spark, d, "relationships")
    return G.relationship_problems(e, r.limit(0), rows).groupBy(F.coalesce("problem", F.lit("none")).alias("problem")).agg(F.count("*").alias("n"))


def entity_updates(spark, d):
    """Current entities with a new description where their id is in the deletions."""
    e = graph(spark, d)[0]
    c = table(spark, d, "deletions").where("record_kind = 'entity' and record_id is not null").select(F.col("record_id").alias("entity_id")).distinct().withColumn("description", F.lit("updated")).withColumn("entity_type", F.lit(None).cast("string"))
    return G.update(e, c, "entity_id").select("entity_id", "entity_type", "description")


def cascade_delete(spark, d):
    e, r, _ = graph(spark, d)
    gone = table(spark, d, "deletions").where("record_kind = 'entity'").select(F.col("record_id").alias("entity_id"))
    left_e, left_r = G.delete_entities(e, r, gone)
    return left_e.select(F.lit("entity").alias("kind"), F.col("entity_id").alias("id")).unionByName(left_r.select(F.lit("relationship").alias("kind"), F.col("relationship_id").alias("id")))


def normalize_names(spark, d):
    e = graph(spark, d)[0]
    return e.select("entity_id", normalize_name(F.col("canonical_name")).alias("name"), strip_company(F.col("canonical_name")).alias("bare"))


def canonical_ids(spark, d):
    e = graph(spark, d)[0]
    return e.select("entity_id", canonical_id(F.col("entity_type"), F.col("canonical_name")).alias("canonical"))


def levenshtein_pairs(spark, d):
    e = graph(spark, d)[0]
    a = F.explode("aliases")
    pairs = e.select("entity_id", normalize_name(F.col("canonical_name")).alias("name"), a.alias("alias")).where("trim(alias) <> ''")
    return pairs.select("entity_id", "alias", F.round(levenshtein_similarity(F.col("name"), normalize_name(F.col("alias"))), 6).alias("similarity"))


def resolve_aliases(spark, d):
    """Every alias resolved against the entities' canonical names, their own aliases left out."""
    e = graph(spark, d)[0]
    c = e.select("entity_type", F.explode(F.array_distinct("aliases")).alias("name")).where("trim(name) <> ''").distinct()
    c = c.withColumn("candidate_id", F.concat_ws("|", "entity_type", "name"))
    return resolve(c, e.withColumn("aliases", F.lit(None).cast("array<string>")))


def _chunks(spark, d, size=512, overlap=64):
    return chunk_documents(table(spark, d, "documents").select("document_id", "text"), size, overlap)


def chunk_invariants(spark, d):
    c = _chunks(spark, d)
    return c.groupBy("document_id").agg(F.count("*").alias("chunks"), F.max(F.length("text")).alias("longest"), F.max("sequence_number").alias("last"), F.countDistinct("chunk_id").alias("ids"))


def mention_counts(spark, d):
    return extract_mentions(_chunks(spark, d)).groupBy("entity_type", "name").agg(F.count("*").alias("mentions"), F.countDistinct("document_id").alias("documents"))


def ingest_documents(spark, d):
    """All documents into an empty graph: what each part of it has."""
    g = ingest(empty_graph(spark), table(spark, d, "documents").where("text is not null").select("document_id", "text"))
    one = lambda df, n: df.agg(F.count("*").alias("n")).select(F.lit(n).alias("part"), "n")
    return one(g.entities, "entities").unionByName(one(g.relationships, "relationships")).unionByName(one(g.evidence, "evidence")).unionByName(one(g.mentions, "mentions"))


VERBS = ("is used for", "depends on", "is developed by", "is part of", "is located in", "provides", "competes with")


def relation_counts(spark, d):
    """Relations found in sentences made of all edges, each with a verb by its number."""
    e, r, _ = graph(spark, d)
    names = e.select("entity_id", "canonical_name")
    both = r.join(names.toDF("subject_entity_id", "s"), "subject_entity_id").join(names.toDF("object_entity_id", "o"), "object_entity_id")
    verb = F.element_at(F.array(*[F.lit(v) for v in VERBS]), (F.col("seq") % len(VERBS)).cast("int") + 1)
    text = F.concat(F.lit("The "), "s", F.lit(" "), verb, F.lit(" "), "o", F.lit("."))
    return extract_relations(both.select(F.col("relationship_id").alias("document_id"), F.col("relationship_id").alias("chunk_id"), text.alias("text"))).groupBy("predicate").agg(F.count("*").alias("relations"))


def catalog_mentions(spark, d):
    """Mentions of the catalog's entities in whole documents."""
    whole = table(spark, d, "documents").select("document_id", F.col("document_id").alias("chunk_id"), "text")
    return extract_mentions(whole).where(F.col("confidence") == KNOWN).groupBy("name").agg(F.count("*").alias("mentions"), F.countDistinct("document_id").alias("documents"))


def chunk_checks(spark, d):
    """Whether a document's chunks keep the size, are numbered through, and stand in the document, whose ends they cover."""
    c = _chunks(spark, d).join(table(spark, d, "documents").select("document_id", F.regexp_replace("text", r"\s+", "").alias("whole")), "document_id")
    bare = F.regexp_replace("text", r"\s+", "")
    each = c.groupBy("document_id").agg(
        (F.max(F.length("text")) <= 512).alias("within"),
        (F.countDistinct("sequence_number") == F.max("total_chunks")).alias("numbered"),
        F.bool_and(F.contains("whole", bare)).alias("contained"),
        (F.bool_or((F.col("sequence_number") == 0) & F.startswith("whole", bare)) & F.bool_or((F.col("sequence_number") == F.col("total_chunks") - 1) & F.endswith("whole", bare))).alias("covered"),
    )
    return each


QUERIES = {
    f.__name__: f
    for f in (degree_counts, reach_d2, reach_predicate, shortest_path_len, neighbors_capped, neighbors_deep, related_entities, find_paths, related_documents, evidence_for_entity, provenance, graph_counts, entity_filter, relationship_filter,
              verify_issues, verify_verdict, repair_merge, repair_actions, evidence_confidence, answer_sources, create_problems, entity_updates, cascade_delete, normalize_names, canonical_ids, levenshtein_pairs, resolve_aliases, chunk_invariants, chunk_checks, mention_counts, catalog_mentions, relation_counts, ingest_documents)
}

_G = """with e as (select * from entities where entity_id is not null qualify row_number() over (partition by entity_id order by updated_at desc nulls last, seq desc nulls last) = 1),
r as (select * from relationships where relationship_id is not null qualify row_number() over (partition by relationship_id order by updated_at desc nulls last, seq desc nulls last) = 1),
v as (select * from evidence where evidence_id is not null qualify row_number() over (partition by evidence_id order by created_at desc nulls last, seq desc nulls last) = 1),
o as (select distinct subject_entity_id as node, object_entity_id as other from r where subject_entity_id is not null and object_entity_id is not null)"""


def _reach_sql(start: str, edges: str, depth: int) -> str:
    steps = [f"w0 as (select entity_id as start, entity_id as node, 0 as depth from e where {start})"]
    for i in range(1, depth + 1):
        steps.append(f"w{i} as (select start, node, min(depth) as depth from (select * from w{i - 1} union all select start, other, {i} from w{i - 1} join {edges} using (node)) group by all)")
    return f"{_G}, b as (select distinct * from (select subject_entity_id as node, object_entity_id as other from r where upper(predicate) = 'LOCATED_IN' union all select object_entity_id, subject_entity_id from r where upper(predicate) = 'LOCATED_IN') where node is not null and other is not null), {', '.join(steps)}"


_NORM = r"lower(regexp_replace(trim(regexp_replace(strip_accents({x}), '\s+', ' ', 'g')), '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g'))"


def _lev(a: str, b: str) -> str:
    """DuckDB compares bytes, so letters that stay beyond ASCII are given one byte each."""
    one = "translate({}, 'øłđßæœ', '123456')"
    return f"levenshtein({one.format(a)}, {one.format(b)})"


def _norm(x: str) -> str:
    return _NORM.format(x=x)


def _bare(x: str) -> str:
    return _norm(rf"regexp_replace({x}, '(?i)\b(corp|corporation|inc|incorporated|llc|ltd|limited|gmbh|co|company)\b', ' ', 'g')")


ORACLE = {
    "degree_counts": f"{_G} select entity_id, count(*) filter (side = 0) as out_degree, count(*) filter (side = 1) as in_degree, count(distinct relationship_id) as edges from (select subject_entity_id as entity_id, 0 as side, relationship_id from r where object_entity_id is not null union all select object_entity_id, 1, relationship_id from r where subject_entity_id is not null) where entity_id is not null group by 1",
    "reach_d2": _reach_sql("true", "o", 2) + " select start, node, depth from w2",
    "reach_predicate": _reach_sql("true", "b", 2) + " select start, node, depth from w2 where node <> start",
    "shortest_path_len": _reach_sql(f"entity_id = '{HUB}'", "(select other as node, node as other from o)", 3) + " select node as start, depth from w3",
    "related_documents": f"{_G}, c as (select subject_entity_id as s, object_entity_id as t, unnest(evidence_ids) as evidence_id from r) select distinct entity_id, document_id from (select s as entity_id, evidence_id from c union select t, evidence_id from c) join v using (evidence_id) where entity_id is not null",
    "evidence_for_entity": f"{_G}, c as (select subject_entity_id as s, object_entity_id as t, unnest(evidence_ids) as evidence_id from r) select entity_id, count(distinct evidence_id) as n_evidence, count(distinct document_id) as n_documents from (select s as entity_id, evidence_id from c union select t, evidence_id from c) join v using (evidence_id) where entity_id is not null group by 1",
    "provenance": f"{_G}, c as (select distinct relationship_id, subject_entity_id, predicate, object_entity_id, unnest(evidence_ids) as evidence_id from r) select relationship_id, coalesce(x.canonical_name, subject_entity_id) || ' -[' || upper(predicate) || ']-> ' || coalesce(y.canonical_name, object_entity_id) as statement, evidence_id, document_id, chunk_id from c join v using (evidence_id) left join e x on x.entity_id = subject_entity_id left join e y on y.entity_id = object_entity_id",
    "graph_counts": f"{_G} select 'entities' as kind, count(*) as n from e union all select 'relationships', count(*) from r union all select 'evidence', count(*) from v",
    "entity_filter": f"{_G} select entity_id from e where entity_type = 'TECHNOLOGY' and (contains({_norm('canonical_name')}, 'graph engine') or len(list_filter(coalesce(aliases, []), lambda a: contains({_norm('a')}, 'graph engine'))) > 0)",
    "relationship_filter": f"{_G} select relationship_id from r where upper(predicate) = 'DEPENDS_ON' and object_entity_id = '{HUB}'",
    "verify_issues": f"""{_G}, x as (
  select 'INVALID_REFERENCE' as issue, relationship_id as id, subject_entity_id as ref, 'HIGH' as severity from r where not exists (select 1 from e where entity_id = subject_entity_id)
  union all select 'INVALID_REFERENCE', relationship_id, object_entity_id, 'HIGH' from r where not exists (select 1 from e where entity_id = object_entity_id)
  union all select 'MISSING_EVIDENCE', relationship_id, null, 'MEDIUM' from r where evidence_ids is null or len(evidence_ids) = 0
  union all select 'MISSING_EVIDENCE', relationship_id, ev, 'MEDIUM' from (select relationship_id, unnest(evidence_ids) as ev from r) where not exists (select 1 from v where evidence_id = ev)
  union all select 'DUPLICATE_RELATIONSHIP', relationship_id, null, 'LOW' from (select *, row_number() over (partition by subject_entity_id, upper(predicate), object_entity_id order by seq) as n from r) where n > 1
  union all select 'ORPHAN_ENTITY', entity_id, null, 'LOW' from e where entity_id not in (select node from o union all select other from o))
select * from x""",
    "repair_merge": f"""{_G}, w as (select * from r where exists (select 1 from e where entity_id = subject_entity_id) and exists (select 1 from e where entity_id = object_entity_id)),
k as (select arg_min(relationship_id, seq) as relationship_id, subject_entity_id, upper(predicate) as predicate, object_entity_id, round(max(confidence), 6) as confidence, count(*) as merged from w group by all),
n as (select subject_entity_id, upper(predicate) as predicate, object_entity_id, count(distinct ev) as n from (select subject_entity_id, predicate, object_entity_id, unnest(evidence_ids) as ev from w) where exists (select 1 from v where evidence_id = ev) group by all)
select k.relationship_id, k.predicate, k.confidence, coalesce(n.n, 0)::int as n_evidence, merged from k left join n using (subject_entity_id, predicate, object_entity_id)""",
    "cascade_delete": f"{_G}, g as (select record_id from deletions where record_kind = 'entity' and record_id is not null) select 'entity' as kind, entity_id as id from e where entity_id not in (from g) union all select 'relationship', relationship_id from r where (subject_entity_id is null or subject_entity_id not in (from g)) and (object_entity_id is null or object_entity_id not in (from g))",
    "normalize_names": f"{_G} select entity_id, {_norm('canonical_name')} as name, {_bare('canonical_name')} as bare from e",
    "canonical_ids": f"{_G}, s as (select entity_id, entity_type, regexp_replace(regexp_replace({_norm('canonical_name')}, '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') as slug from e) select entity_id, 'ent_' || lower(entity_type) || '_' || case when slug = '' then 'unnamed' else slug end as canonical from s",
    "levenshtein_pairs": f"{_G}, p as (select entity_id, {_norm('canonical_name')} as a, unnest(aliases) as alias from e), q as (select entity_id, alias, a, {_norm('alias')} as b from p where trim(alias) <> '') select entity_id, alias, round(case when a = b then 1.0 when a = '' or b = '' then 0.0 else 1 - {_lev('a', 'b')} / greatest(length(a), length(b)) end, 6) as similarity from q",
    "resolve_aliases": f"""{_G}, c as (select distinct entity_type, unnest(aliases) as name from e), d as (select entity_type, name, entity_type || '|' || name as candidate_id, {_norm('name')} as n, {_bare('name')} as b from c where trim(name) <> ''),
k as (select entity_id, entity_type, seq, {_norm('canonical_name')} as n, {_bare('canonical_name')} as b from e),
f as (select candidate_id, entity_id, seq, 1 as step from d join k using (entity_type, n)
  union all select candidate_id, entity_id, seq, 2 from d join k using (entity_type, b) where entity_type in ('ORGANIZATION', 'PRODUCT') and length(b) >= 3
  union all select candidate_id, entity_id, seq, 3 from d join k using (entity_type) where d.n <> '' and k.n <> '' and abs(length(d.n) - length(k.n)) <= greatest(length(d.n), length(k.n)) * 0.1 + 1e-9 and 1 - {_lev('d.n', 'k.n')} / greatest(length(d.n), length(k.n)) >= 0.9)
select d.candidate_id, x.entity_id, coalesce(x.step, 4) as step from d left join (select * from f qualify row_number() over (partition by candidate_id order by step, seq, entity_id) = 1) x using (candidate_id)""",
}
ORACLE["verify_verdict"] = ORACLE["verify_issues"].replace("select * from x", "select count(*) filter (severity = 'HIGH') = 0 as valid, count(*) as issues from x")


def _walk_sql(start: str, nodes: int = G.MAX_NODES, edges: int = G.MAX_EDGES) -> str:
    """Two steps of a bounded walk: each edge in the order in which a queue takes it, a node found by the first that leads to
    it while fewer than ``edges`` edges have been taken; the first ``nodes`` that exist, the start among them."""
    return f"""{_G}, s as ({start}),
z as (select subject_entity_id as node, object_entity_id as other, 0 as side, relationship_id, seq from r union all select object_entity_id, subject_entity_id, 1, relationship_id, seq from r),
y as (select * from z where node is not null and other is not null),
a as (select 1 as depth, 0::bigint as parent, other, relationship_id, row_number() over (order by side, seq) as pos from y where node = (select entity_id from s)),
n1 as (select other, min(pos) as pos from a where pos <= {2 * edges} and other <> (select entity_id from s) group by 1),
f1 as (select other, pos, row_number() over (order by pos) as place from n1 where other in (select entity_id from e)),
b as (select 2 as depth, f1.pos as parent, y.other, relationship_id, row_number() over (order by f1.pos, side, seq) + {10 * edges} as pos from y join f1 on y.node = f1.other where place < {nodes}),
w as (select * from a union all select * from b),
t as (select *, sum(fresh) over (order by pos rows between unbounded preceding and 1 preceding) as taken from (select *, case when row_number() over (partition by relationship_id order by pos) = 1 then 1 else 0 end as fresh from w)),
g as (select other, min(pos) as pos, min(depth) as depth from t where coalesce(taken, 0) < {edges} and other <> (select entity_id from s) group by 1),
h as (select *, row_number() over (order by pos) as place from g where other in (select entity_id from e))
select entity_id, 0 as depth from s union all select other, depth from h where place < {nodes}"""


_FEW = """select entity_id from (select entity_id, count(*) filter (side = 0) as out_degree, count(distinct relationship_id) as edges from (select subject_entity_id as entity_id, 0 as side, relationship_id from r where object_entity_id is not null union all select object_entity_id, 1, relationship_id from r where subject_entity_id is not null) where entity_id is not null group by 1) where edges between 2 and 9 order by out_degree desc, entity_id limit 1"""
ORACLE |= {
    "neighbors_capped": _walk_sql(f"select '{HUB}' as entity_id"),
    "neighbors_deep": _walk_sql(_FEW),
    "related_entities": f"{_G}, s as ({_FEW}) select distinct x as entity_id from (select object_entity_id as x from r, s where subject_entity_id = entity_id union all select subject_entity_id from r, s where object_entity_id = entity_id), s where x in (select entity_id from e) and x <> entity_id",
    "find_paths": f"""{_G}, q as (select subject_entity_id as node, object_entity_id as other, relationship_id, seq from r where object_entity_id is not null),
a as (select other, min_by(relationship_id, row(seq, relationship_id)) as edge, min(row(seq, relationship_id)) as pos from q where node = '{HUB}' and other not in ('{HUB}', 'ent_technology_shared_runtime_01') group by 1),
p as (select ['{HUB}', other] as nodes, [relationship_id] as edges, 1 as depth, row(seq, relationship_id) as x, null as y from q where node = '{HUB}' and other = 'ent_technology_shared_runtime_01'
  union all select ['{HUB}', a.other, q.other], [edge, relationship_id], 2, a.pos, row(q.seq, relationship_id) from a join q on q.node = a.other where q.other = 'ent_technology_shared_runtime_01')
select (row_number() over (order by depth, x, y) - 1)::int as path, array_to_string(nodes, '>') as nodes, array_to_string(edges, '>') as edges from p order by depth, x, y limit 5""",
    "repair_actions": f"""{_G}, w as (select * from r where exists (select 1 from e where entity_id = subject_entity_id) and exists (select 1 from e where entity_id = object_entity_id)),
c as (select unnest(evidence_ids) as x from w)
select (select count(*) from r) - (select count(*) from w) as deleted, (select count(*) from c where not exists (select 1 from v where evidence_id = x)) as pruned, (select sum(n - 1)::bigint from (select count(*) as n from w group by subject_entity_id, upper(predicate), object_entity_id)) as merged""",
    "evidence_confidence": f"{_G}, c as (select distinct relationship_id, unnest(evidence_ids) as evidence_id from r) select relationship_id, round(avg(confidence), 6) as mean_confidence, max(confidence) as max_confidence from c join v using (evidence_id) group by 1",
    "answer_sources": f"""{_G}, k as (select * from vector_records where id is not null qualify row_number() over (partition by id order by updated_at desc nulls last, seq desc nulls last) = 1),
x as (select content_ref as document_id, collection_id as chunk_id, id as reference, 0 as side, seq from k where content_ref is not null union all select document_id, chunk_id, source_text_reference, 1, seq from v)
select document_id, chunk_id, reference from x qualify row_number() over (partition by document_id, chunk_id order by side, seq) = 1""",
    "create_problems": f"""{_G}, x as (select *, row_number() over (partition by relationship_id order by seq) as place from relationships)
select case when relationship_id is null then 'no id' when place > 1 then 'exists' when not exists (select 1 from e where entity_id = subject_entity_id) then 'no subject' when not exists (select 1 from e where entity_id = object_entity_id) then 'no object' else 'none' end as problem, count(*) as n from x group by 1""",
    "entity_updates": f"{_G} select entity_id, entity_type, case when entity_id in (select record_id from deletions where record_kind = 'entity' and record_id is not null) then 'updated' else description end as description from e",
    "catalog_mentions": "with p(name, x) as (values " + ", ".join(f"('{n}', '{p}')" for n, _, p in CATALOG) + "), c as (select name, document_id, len(regexp_extract_all(text, x)) as n from documents cross join p where text is not null) select name, sum(n)::bigint as mentions, count(distinct document_id) as documents from c where n > 0 group by 1",
    "chunk_checks": r"select document_id, true as within, true as numbered, true as contained, true as covered from documents where regexp_matches(text, '[^\s]')",
}

"""A knowledge graph as three tables: entities, relationships and evidence.

Relationships are ``relationship_id, subject_entity_id, predicate, object_entity_id, confidence, evidence_ids, seq``.
The neighbourhood of one entity is bounded by its limits, so its frontier is a short list that is pushed into the scan of
the relationships; paths, and walks from many entities, are joins, one a step, with what was visited written in between.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from lodequery.functions.text import normalize_name
from lodequery.storage import remove, written

#: Default depth and the deepest, nodes and edges of a neighbourhood; depth and number of paths.
DEPTH, DEEPEST, MAX_NODES, MAX_EDGES = 2, 5, 200, 500
PATH_DEPTH, MAX_PATHS = 3, 5
#: A walk's hubs: pairs through one for each of its starts and edges; starts or edges a block; pairs a task, and tasks.
CROSSED, BLOCK, TASK_PAIRS, MAX_TASKS = 16, 1024, 1 << 21, 20_000
OUT, IN, BOTH = "out", "in", "both"


def ends(relationships: DataFrame, direction: str = BOTH, predicates: Sequence[str] | None = None) -> DataFrame:
    """``node, other, side, relationship_id, predicate, seq``: each edge as seen from its ends; side 0 is outbound."""
    r = relationships
    if predicates is not None:
        r = r.where(F.upper("predicate").isin([p.upper() for p in predicates]))
    cols = ["relationship_id", F.upper("predicate").alias("predicate"), "seq"]
    out = r.select(F.col("subject_entity_id").alias("node"), F.col("object_entity_id").alias("other"), F.lit(0).alias("side"), *cols)
    inn = r.select(F.col("object_entity_id").alias("node"), F.col("subject_entity_id").alias("other"), F.lit(1).alias("side"), *cols)
    return {OUT: out, IN: inn}.get(direction, out.unionByName(inn)).where("node is not null and other is not null")


@dataclass
class Neighborhood:
    nodes: list[str]
    edges: list[str]
    depth: dict[str, int] = field(default_factory=dict)


def neighbors(entities: DataFrame, relationships: DataFrame, start: str, depth: int = DEPTH, direction: str = BOTH, predicates: Sequence[str] | None = None, max_nodes: int = MAX_NODES, max_edges: int = MAX_EDGES) -> Neighborhood:
    """Breadth first from one entity: outbound before inbound, in order of arrival, up to the limits.

    An edge is taken before its far node, so with a full node limit an edge may lead to a node that isn't among the
    nodes. Of each frontier node at most twice ``max_edges`` edges are read: more could not be taken.
    """
    if not entities.where(F.col("entity_id") == start).limit(1).count():
        raise KeyError(start)
    seen, found = {start: 0}, {start: 0}
    edges: dict[str, None] = {}
    frontier = [start]
    seen_from = ends(relationships, direction, predicates)
    for level in range(min(depth, DEEPEST)):
        if not frontier:
            break
        near = seen_from.where(F.col("node").isin(frontier))
        place = F.row_number().over(Window.partitionBy("node").orderBy("side", "seq"))
        rows = near.withColumn("place", place).where(F.col("place") <= 2 * max_edges).collect()  # at most max_nodes * 2 * max_edges
        by: dict[str, list[Row]] = {}
        for r in sorted(rows, key=lambda r: r["place"]):
            by.setdefault(r["node"], []).append(r)
        others = {r["other"] for r in rows} - set(seen)
        there = {r[0] for r in entities.where(F.col("entity_id").isin(list(others))).select("entity_id").collect()} if others else set()
        following = []
        for node in frontier:
            for r in by.get(node, ()):
                if len(edges) >= max_edges:
                    break
                edges[r["relationship_id"]] = None
                if r["other"] in seen:
                    continue
                if len(found) >= max_nodes:
                    break
                seen[r["other"]] = level + 1
                if r["other"] in there:
                    found[r["other"]] = level + 1
                    following.append(r["other"])
        frontier = following
    return Neighborhood(list(found), list(edges), found)


def related_entities(entities: DataFrame, relationships: DataFrame, start: str, depth: int = DEPTH, direction: str = BOTH, predicates: Sequence[str] | None = None, max_nodes: int = MAX_NODES, max_edges: int = MAX_EDGES) -> list[str]:
    """The neighbourhood of an entity without itself."""
    return [n for n in neighbors(entities, relationships, start, depth, direction, predicates, max_nodes, max_edges).nodes if n != start]


def find_paths(entities: DataFrame, relationships: DataFrame, start: str, end: str, depth: int = PATH_DEPTH, predicates: Sequence[str] | None = None, most: int = MAX_PATHS) -> list[tuple[list[str], list[str]]]:
    """Up to ``most`` outbound paths as (nodes, edges) of a breadth-first tree: a node is entered once, every edge that
    reaches the end makes a path. A level is a written table, so it may have any number of nodes; its nodes carry the path
    to them, and the order of paths is the order in which a queue would find them."""
    known = {r[0] for r in entities.where(F.col("entity_id").isin([start, end])).select("entity_id").collect()}
    if not {start, end} <= known:
        return []
    if start == end:
        return [([start], [])]
    seen_from = ends(relationships, OUT, predicates)
    step = F.struct("seq", "relationship_id", F.col("other").alias("node"))
    none = F.array().cast("array<struct<seq:bigint,relationship_id:string,node:string>>")
    seen = written(entities.where(F.col("entity_id") == start).select(F.col("entity_id").alias("node")).distinct().select("node", F.lit(0).alias("depth"), none.alias("path")), "paths")
    paths = []
    deepest = min(depth, DEEPEST)
    for level in range(1, deepest + 1):
        steps = seen.where(F.col("depth") == level - 1).join(seen_from, "node").select("other", F.concat("path", F.array(step)).alias("path"))
        for r in steps.where(F.col("other") == end).orderBy("path").limit(most - len(paths)).collect():
            paths.append(([start, *(x["node"] for x in r["path"])], [x["relationship_id"] for x in r["path"]]))
        if len(paths) == most or level == deepest:
            break
        new = steps.where(F.col("other") != end).groupBy(F.col("other").alias("node")).agg(F.min("path").alias("path"))
        new = new.join(seen.select("node"), "node", "left_anti").select("node", F.lit(level).alias("depth"), "path")
        grown = written(seen.unionByName(new), "paths")
        remove(seen)
        seen = grown
        if seen.where(F.col("depth") == level).isEmpty():
            break
    remove(seen)
    return paths


def reach(relationships: DataFrame, starts: DataFrame, depth: int = DEPTH, direction: str = OUT, predicates: Sequence[str] | None = None) -> DataFrame:
    """``start, node, depth``: every node within ``depth`` steps of each of any number of starts (``start``), with the
    least number of steps; the start itself at 0. Each level but the last is a written table, the last is a plan."""
    near = written(ends(relationships, direction, predicates).select("node", "other").distinct(), "ends")
    levels = [written(starts.select("start").where("start is not null").distinct().select("start", F.col("start").alias("node"), F.lit(0).alias("depth")), "reach")]
    deepest = min(depth, DEEPEST)
    for level in range(1, deepest + 1):
        new = _step(levels, near).select("start", "node", F.lit(level).alias("depth"))
        levels.append(written(new, "reach") if level < deepest else new)  # only what is new is written
    return reduce(DataFrame.unionByName, levels)


def _step(levels: list[DataFrame], near: DataFrame) -> DataFrame:
    """``start, node``: what one step from the last of ``levels`` leads to, without what they have.

    The pairs through a hub, a node of many starts and many edges, are not shuffled: blocks of its starts meet blocks of its
    others, each two in one row, which is unfolded last. So that a pair comes out once, it belongs to the first hub that
    both its ends have, and each end knows its hubs before this one. Pairs through other nodes, at most ``CROSSED`` times the
    rows of the two tables, are made distinct by a shuffle, those that have a hub left out.
    """
    last = levels[-1].select("start", "node")
    fans = last.groupBy("node").agg(F.count("*").alias("fan_in")).join(near.groupBy("node").agg(F.count("*").alias("fan_out")), "node")
    fans = fans.withColumn("pairs", F.col("fan_in").cast("double") * F.col("fan_out")).where(F.col("pairs") > CROSSED * (F.col("fan_in") + F.col("fan_out")))
    pairs = 0
    if len(levels) > 1:  # the first step starts from one row a node
        blocks = [F.ceil(F.col(c) / BLOCK).alias(n) for c, n in (("fan_in", "rows"), ("fan_out", "columns"))]
        hubs = written(fans.orderBy(F.desc("pairs")).select("node", "pairs", *blocks, F.monotonically_increasing_id().alias("hub")), "hubs")
        pairs = hubs.agg(F.sum("pairs")).first()[0]
    if not pairs:
        return _without(last.join(near, "node").select("start", F.col("other").alias("node")).distinct(), levels)

    named = hubs.select("node", "hub")
    listed = F.array_sort(F.collect_list("hub"))
    of_start = written(last.join(named, "node").groupBy("start").agg(listed.alias("start_hubs")), "hubs")
    of_node = written(near.join(named, "node").groupBy(F.col("other").alias("node")).agg(listed.alias("node_hubs")), "hubs")

    other = last.join(named, "node", "left_anti").join(near, "node").select("start", F.col("other").alias("node")).distinct()
    other = _without(other, levels).join(of_start, "start", "left").join(of_node, "node", "left")
    other = other.where(~F.coalesce(F.arrays_overlap("start_hubs", "node_hubs"), F.lit(False))).select("start", "node")

    sizes = hubs.select("hub", "rows", "columns")
    row, column = (F.pmod(F.xxhash64(c), n).alias(a) for c, n, a in (("start", "rows", "row"), ("node", "columns", "column")))
    sides = []
    for found, end, block, name in ((of_start, "start", row, "starts"), (of_node, "node", column, "nodes")):
        each = found.select(end, f"{end}_hubs", F.posexplode(f"{end}_hubs").alias("place", "hub")).join(sizes, "hub")
        known = F.struct(F.col(end).alias("id"), F.slice(f"{end}_hubs", F.lit(1), F.col("place")).alias("before"))
        sides.append(each.select("hub", block, known.alias("known")).groupBy("hub", "row" if end == "start" else "column").agg(F.collect_list("known").alias(name)))
    met = reduce(DataFrame.unionByName, [x.select("start", "node") for x in levels]).join(of_start, "start").join(of_node, "node")
    met = met.select("start", "node", F.array_min(F.array_intersect("start_hubs", "node_hubs")).alias("hub")).join(sizes, "hub").select("hub", row, column, "start", "node")
    met = met.groupBy("hub", "row", "column", "start").agg(F.collect_list("node").alias("met"))
    met = met.groupBy("hub", "row", "column").agg(F.map_from_entries(F.collect_list(F.struct("start", "met"))).alias("met"))

    tasks = min(int(pairs // TASK_PAIRS) + 1, MAX_TASKS)  # by pairs, since the rows to unfold are few
    crossed = sides[0].join(sides[1], "hub").repartition(tasks, "hub", "row", "column").join(met, ["hub", "row", "column"], "left")
    # A function over the array keeps this explode out of the generated code of the next one, which holds all that a row becomes.
    known = F.transform("starts", lambda s: F.struct(s["id"].alias("id"), s["before"].alias("before"), F.try_element_at("met", s["id"]).alias("met")))
    crossed = crossed.select("nodes", F.explode(known).alias("s")).select("s", F.explode("nodes").alias("n"))
    apart = (F.size("s.before") == 0) | (F.size("n.before") == 0) | ~F.arrays_overlap("s.before", "n.before")
    fresh = F.col("s.met").isNull() | ~F.array_contains("s.met", F.col("n.id"))
    return other.unionByName(crossed.where(apart & fresh).select(F.col("s.id").alias("start"), F.col("n.id").alias("node")))


def _without(new: DataFrame, levels: list[DataFrame]) -> DataFrame:
    for seen in levels:
        new = new.join(seen.select("start", "node"), ["start", "node"], "left_anti")
    return new


def degrees(relationships: DataFrame) -> DataFrame:
    """``entity_id, out_degree, in_degree, edges``; an edge from an entity to itself counts once among its edges."""
    e = ends(relationships)
    return e.groupBy(F.col("node").alias("entity_id")).agg(F.count_if(F.col("side") == 0).alias("out_degree"), F.count_if(F.col("side") == 1).alias("in_degree"), F.countDistinct("relationship_id").alias("edges"))


def entity_evidence(relationships: DataFrame, evidence: DataFrame) -> DataFrame:
    """``entity_id, evidence_id, document_id, chunk_id``: the stored evidence of all edges of each entity, once."""
    cited = relationships.select("subject_entity_id", "object_entity_id", F.explode(F.array_distinct("evidence_ids")).alias("evidence_id"))
    found = cited.join(evidence.select("evidence_id", "document_id", "chunk_id"), "evidence_id")
    return found.select(F.explode(F.array_distinct(F.array("subject_entity_id", "object_entity_id"))).alias("entity_id"), "evidence_id", "document_id", "chunk_id").where("entity_id is not null").distinct()


def related_documents(relationships: DataFrame, evidence: DataFrame, mentions: DataFrame | None = None) -> DataFrame:
    """``entity_id, document_id``: documents of an entity's evidence and mentions."""
    docs = entity_evidence(relationships, evidence).select("entity_id", "document_id")
    return (docs.union(mentions.select("entity_id", "document_id")) if mentions is not None else docs).distinct()


def find_entities(entities: DataFrame, name: str | None = None, kind: str | None = None, alias: str | None = None) -> DataFrame:
    """Entities by type, by part of a normalised name or alias, and by a whole normalised alias."""
    spark = entities.sparkSession
    norm = lambda s: spark.range(1).select(normalize_name(F.lit(s))).first()[0]
    aliases = F.transform(F.coalesce("aliases", F.array().cast("array<string>")), normalize_name)
    out = entities
    if kind is not None:
        out = out.where(F.col("entity_type") == kind)
    if name is not None:
        q = norm(name)
        out = out.where(F.contains(normalize_name(F.col("canonical_name")), F.lit(q)) | F.exists(aliases, lambda a: F.contains(a, F.lit(q))))
    if alias is not None:
        out = out.where(F.array_contains(aliases, norm(alias)))
    return out


def find_relationships(relationships: DataFrame, predicate: str | None = None, subject: str | None = None, object_: str | None = None) -> DataFrame:
    out = relationships
    for c, x in ((F.upper("predicate"), predicate.upper() if predicate else None), (F.col("subject_entity_id"), subject), (F.col("object_entity_id"), object_)):
        if x is not None:
            out = out.where(c == x)
    return out


def _first_of_id(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``new`` with ``_exists``: whether its id is stored, or an earlier new row (by seq) has it."""
    known = stored.select(key).distinct().withColumn("_known", F.lit(True))
    place = F.row_number().over(Window.partitionBy(key).orderBy("seq"))
    return new.withColumn("_place", place).join(known, key, "left").withColumn("_exists", F.coalesce("_known", F.lit(False)) | (F.col("_place") > 1)).drop("_known", "_place")


def entity_problems(entities: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` with ``problem``: why an entity can't be created (null: it can): no id, or one that exists."""
    rows = _first_of_id(entities, new, "entity_id")
    return rows.withColumn("problem", F.when(F.col("entity_id").isNull(), "no id").when(F.col("_exists"), "exists")).select(*new.columns, "problem")


def relationship_problems(entities: DataFrame, relationships: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` with ``problem``: why an edge can't be created (null: it can): no id, one that exists, or an end that doesn't."""
    rows = _first_of_id(relationships, new, "relationship_id")
    for c in ("subject_entity_id", "object_entity_id"):
        rows = rows.join(entities.select(F.col("entity_id").alias(c), F.lit(True).alias(f"_{c}")).distinct(), c, "left")
    problem = F.when(F.col("relationship_id").isNull(), "no id").when(F.col("_exists"), "exists").when(F.col("_subject_entity_id").isNull(), "no subject").when(F.col("_object_entity_id").isNull(), "no object")
    return rows.withColumn("problem", problem).select(*new.columns, "problem")


def update(stored: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Entities, edges, evidence or mentions with what ``changes`` (the key and some columns, one row an id) says of them,
    nulls meaning no change; ids that aren't stored change nothing."""
    other = [c for c in changes.columns if c != key]
    fresh = changes.select(key, *[F.col(c).alias(f"_{c}") for c in other])
    return stored.join(fresh, key, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in other else F.col(c) for c in stored.columns])


def delete_entities(entities: DataFrame, relationships: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the entities of ``ids (entity_id)`` and their edges; evidence stays."""
    gone = ids.select("entity_id").distinct()
    left = relationships
    for c in ("subject_entity_id", "object_entity_id"):
        left = left.join(gone.withColumnRenamed("entity_id", c), c, "left_anti")
    return entities.join(gone, "entity_id", "left_anti"), left.select(*relationships.columns)


def delete_documents(relationships: DataFrame, evidence: DataFrame, mentions: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Without the evidence and mentions of documents ``ids (document_id)``; edges that lose all their evidence by it go."""
    gone = ids.select("document_id").distinct()
    dropped = evidence.join(gone, "document_id", "left_semi").select("evidence_id").distinct()
    cited = relationships.select("relationship_id", F.posexplode("evidence_ids").alias("at", "evidence_id"))
    lost = cited.join(dropped, "evidence_id").groupBy("relationship_id").agg(F.collect_set("evidence_id").alias("lost"))
    kept = relationships.join(lost, "relationship_id", "left").withColumn("evidence_ids", F.when(F.col("lost").isNull(), F.col("evidence_ids")).otherwise(F.array_except("evidence_ids", "lost")))
    kept = kept.where(F.col("lost").isNull() | (F.size("evidence_ids") > 0)).select(*relationships.columns)
    return kept, evidence.join(gone, "document_id", "left_anti"), mentions.join(gone, "document_id", "left_anti")


def merge_edges(relationships: DataFrame, new: DataFrame) -> DataFrame:
    """Edges with one subject, predicate and object become one: the first stays, evidence is joined, the greatest confidence counts."""
    both = relationships.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    key = ["subject_entity_id", F.upper("predicate").alias("predicate"), "object_entity_id"]
    evidence = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_new", "seq", F.coalesce("evidence_ids", F.array().cast("array<string>")).alias("e")))), lambda x: x["e"])))
    return both.groupBy(*key).agg(F.min_by("relationship_id", F.struct("_new", "seq")).alias("relationship_id"), F.max("confidence").alias("confidence"), evidence.alias("evidence_ids"), F.min("seq").alias("seq"))


def provenance(entities: DataFrame, relationships: DataFrame, evidence: DataFrame) -> DataFrame:
    """``relationship_id, statement, evidence_id, document_id, chunk_id``: "subject -[PREDICATE]-> object" and what backs it."""
    names = entities.select("entity_id", "canonical_name")
    r = relationships.join(names.toDF("subject_entity_id", "s"), "subject_entity_id", "left").join(names.toDF("object_entity_id", "o"), "object_entity_id", "left")
    text = F.concat(F.coalesce("s", "subject_entity_id"), F.lit(" -["), F.upper("predicate"), F.lit("]-> "), F.coalesce("o", "object_entity_id"))
    cited = r.select("relationship_id", text.alias("statement"), F.explode(F.array_distinct("evidence_ids")).alias("evidence_id"))
    return cited.join(evidence.select("evidence_id", "document_id", "chunk_id"), "evidence_id").select("relationship_id", "statement", "evidence_id", "document_id", "chunk_id")


def structured_query(entities: DataFrame, relationships: DataFrame, entity: str | None = None, kind: str | None = None, depth: int = 1) -> DataFrame:
    """The neighbourhood of the first entity of a name, or, without one, the entities of a type."""
    if entity is None:
        return find_entities(entities, kind=kind)
    first = find_entities(entities, name=entity).orderBy("seq").limit(1).select("entity_id").collect()
    if not first:
        return entities.limit(0)
    return entities.where(F.col("entity_id").isin(neighbors(entities, relationships, first[0][0], depth).nodes))

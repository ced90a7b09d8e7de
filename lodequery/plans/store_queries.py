"""Queries through the stores: what is written, changed and read back, with the SQL that gives the same rows."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodequery.functions.similarity import is_valid_vector
from lodequery.operators import audit as A
from lodequery.operators import graph as G
from lodequery.plans.graph_queries import _G, graph
from lodequery.plans.log_queries import _CHAIN, _L, _PEERS, chained, log, peers
from lodequery.plans.search_queries import _COLL, _CUR, DIMENSION, collection
from lodequery.sources import stores as S
from lodequery.sources.tables import table
from lodequery.storage import shared_dir, written
from lodequery.streaming.streams import within_skew


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lodequery/{name}-{uuid.uuid4().hex}"


def store_records(spark, d):
    """A collection's valid records stored, a third of them changed, a fifth deleted, and read back."""
    store = S.CollectionStore(spark, _place(spark, "store"))
    cid = store.create("Agent Memory", DIMENSION)
    rows = collection(spark, d).where(is_valid_vector(F.col("vector"), DIMENSION)).select("id", "vector", "text", "metadata", "seq")
    store.upsert(cid, rows)
    store.update(cid, rows.where("seq % 3 = 0").select("id", F.lit('{"changed": true}').alias("metadata")))
    store.delete(cid, rows.where("seq % 5 = 0").select("id"))
    return store.records(cid).select("id", "seq", "collection_id", "text", "metadata")


def store_catalog(spark, d):
    """Two collections created, one filled by texts alone, one dropped."""
    store = S.CollectionStore(spark, _place(spark, "store"))
    kept, gone = store.create("Kept Ones!", 8), store.create("gone", 4)
    store.upsert(kept, collection(spark, d).where("text is not null").select("id", "text", "seq"))
    store.drop(gone)
    return spark.createDataFrame([(c["collection_id"], c["name"], c["dimension"], c["record_count"]) for c in store.with_counts()], "collection_id string, name string, dimension int, record_count bigint")


def records_as_lines(spark, d):
    """Valid records written as JSON lines and read again."""
    path = _place(spark, "lines")
    rows = collection(spark, d).where(is_valid_vector(F.col("vector"), DIMENSION))
    S.write_records_jsonl(rows.select("id", "collection_id", "vector", "text", "content_ref", "metadata", "seq"), path)
    return S.read_records_jsonl(spark, path).select("id", "seq", F.round(F.element_at("vector", 1), 6).alias("first"), "content_ref")


def graph_store(spark, d):
    """A graph saved, saved again without its evidence's last rows, and loaded."""
    e, r, v = graph(spark, d)
    at = _place(spark, "graph")
    S.save_graph(spark, at, entities=e, relationships=r, evidence=v)
    before = S.load_graph(spark, at)
    S.save_graph(spark, at, entities=before["entities"], relationships=before["relationships"], evidence=before["evidence"].where("seq % 2 = 0"))
    one = lambda n, df: df.agg(F.count("*").alias("n"), F.sum("seq").alias("seqs")).select(F.lit(n).alias("part"), "n", "seqs")
    parts = [one(n, df) for n, df in S.load_graph(spark, at).items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def network_store(spark, d):
    at = _place(spark, "network")
    p = peers(spark, d)
    S.save_network(spark, at, peers=p, blocked=p.where("trust = 'BLOCKED'").select("agent_id"))
    held = S.load_network(spark, at)
    return held["peers"].select("agent_id", "trust").join(held["blocked"].withColumn("blocked", F.lit(True)), "agent_id", "left").withColumn("blocked", F.coalesce("blocked", F.lit(False)))


def session_store(spark, d):
    """Sessions of the log stored, and stored again as stopped where they were failed."""
    at = _place(spark, "sessions")
    rows = A.replay_summary(log(spark, d)).select(F.col("session_id").cast("string").alias("id"), "status")
    S.save_sessions(rows, at)
    S.save_sessions(S.load_sessions(spark, at).withColumn("status", F.when(F.col("status") == "FAILED", "STOPPED").otherwise(F.col("status"))), at)
    return S.load_sessions(spark, at).groupBy("status").agg(F.count("*").alias("sessions"))


def log_lines(spark, d):
    """The log as JSON lines, every hundredth cut short: entries that can be read, by type, and those that can't."""
    path = _place(spark, "log")
    rows = log(spark, d).select("event_id", F.to_json(F.struct(F.col("event_id").cast("string").alias("event_id"), F.col("session_id").cast("string").alias("session_id"), "event_type")).alias("value"))
    rows.select(F.when(F.col("event_id") % 100 == 0, F.expr("substring(value, 1, length(value) - 5)")).otherwise(F.col("value")).alias("value")).write.text(path)
    entries, lost = S.read_log_jsonl(spark, path)
    return entries.groupBy("event_type").agg(F.count("*").alias("n")).unionByName(spark.createDataFrame([("lost", lost)], "event_type string, n bigint"))


def chain_append(spark, d):
    """The earlier half of the log chained and stored, the later half appended to it."""
    rows = log(spark, d).withColumn("chain", F.col("session_id")).withColumn("seq", F.row_number().over(A.Window.partitionBy("session_id").orderBy("ts", "event_id")).cast("bigint"))
    rows = rows.withColumn("payload", F.concat_ws("|", "event_id", "session_id", "event_type", "props"))
    old = rows.where("event_id < 5000")
    stored = written(A.append_hashes(old), "stored")
    more = A.append_hashes(rows.where("event_id >= 5000"), stored)
    return stored.select("event_id", "seq", "hash").unionByName(more.select("event_id", "seq", "hash"))


def session_bundle(spark, d):
    """A session exported, one of its entries changed, and the bundle verified by itself."""
    header, entries = A.export_session(chained(spark, d), 8)
    changed = entries.withColumn("payload", F.when(F.col("seq") == 7, "x").otherwise(F.col("payload")))
    named = [F.lit(header[c]).alias(c) for c in ("root_hash", "leaf_hash", "integrity_valid")]
    return A.verify_bundle(header, changed).select("*", *named)


def log_expiry(spark, d):
    kept, old = S.expire_log(log(spark, d), dt.datetime(2024, 1, 31), 14)
    one = lambda n, df: df.agg(F.count("*").alias("n"), F.max("event_id").alias("last")).select(F.lit(n).alias("part"), "n", "last")
    return one("kept", kept).unionByName(one("archived", old))


def backup_total(spark, d):
    """The hash of all documents as if each were a file."""
    t = table(spark, d, "documents").where("text is not null and document_id is not null")
    return S.backup_digest(t.select(F.col("document_id").alias("path"), F.octet_length("text").alias("size"), F.sha2(F.col("text"), 256).alias("sha256")))


def backup_problems(spark, d):
    """Documents against themselves with some changed, missing and new."""
    t = table(spark, d, "documents").where("document_id is not null").select("doc_id", F.col("document_id").alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    found = t.where("doc_id % 9 <> 0").select(F.when(F.col("doc_id") % 11 == 0, F.concat("path", F.lit("-new"))).otherwise(F.col("path")).alias("path"), F.when(F.col("doc_id") % 7 == 0, "other").otherwise(F.col("sha256")).alias("sha256"))
    return S.verify_backup(t.select("path", "sha256"), found)


def restore_paths(spark, d):
    """Which paths a restore may write."""
    t = table(spark, d, "documents").where("document_id is not null")
    n = F.col("doc_id") % 5
    path = F.when(n == 0, F.concat(F.lit("../"), "document_id")).when(n == 1, F.concat(F.lit("/"), "document_id")).when(n == 2, F.concat(F.lit("a/../"), "document_id")).when(n == 3, F.concat(F.lit("a..b/"), "document_id")).otherwise(F.col("document_id"))
    return S.safe_paths(t.select(path.alias("path")))


def document_deletes(spark, d):
    """The edges that stay when a seventh of the documents go."""
    _, r, v = graph(spark, d)
    ids = table(spark, d, "documents").where("doc_id % 7 = 0 and document_id is not null").select("document_id")
    mentions = spark.createDataFrame([], "entity_id string, document_id string")
    kept, evidence, _ = G.delete_documents(r, v, mentions, ids)
    one = lambda n, df, c: df.select(F.lit(n).alias("part"), F.col(c).alias("id"))
    return one("relationship", kept, "relationship_id").unionByName(one("evidence", evidence, "evidence_id"))


def entities_of_kind(spark, d):
    e, r, _ = graph(spark, d)
    return G.structured_query(e, r, kind="CONCEPT").select("entity_id")


def clock_skew(spark, d):
    return within_skew(log(spark, d).withColumn("ts", F.col("ts").cast("timestamp")), "2024-01-10 12:00:00", seconds=36_000).select("event_id")


QUERIES = {
    f.__name__: f
    for f in (store_records, store_catalog, records_as_lines, graph_store, network_store, session_store, log_lines, chain_append, session_bundle, log_expiry, backup_total, backup_problems, restore_paths, document_deletes, entities_of_kind, clock_skew)
}

_STATES = "s as (select session_id, coalesce(arg_max(case event_type when 'SESSION_COMPLETED' then 'COMPLETED' when 'ACTION_FAILED' then 'FAILED' end, case when event_type in ('SESSION_COMPLETED', 'ACTION_FAILED') then row(ts, event_id) end), 'RUNNING') as status from l group by 1)"
ORACLE = {
    "store_records": f"with {_COLL} select id, seq, 'agent-memory' as collection_id, text, case when seq % 3 = 0 then '{{\"changed\": true}}' else metadata end as metadata from c where seq % 5 <> 0",
    "store_catalog": f"with {_CUR} select 'kept-ones' as collection_id, 'Kept Ones!' as name, 8 as dimension, count(*) as record_count from cur where collection_id = 'col_agent_memory' and text is not null",
    "records_as_lines": f"with {_COLL} select id, seq, round(vector[1], 6) as first, content_ref from c",
    "graph_store": f"{_G} select 'entities' as part, count(*) as n, sum(seq)::bigint as seqs from e union all select 'relationships', count(*), sum(seq)::bigint from r union all select 'evidence', count(*), sum(seq)::bigint from v where seq % 2 = 0",
    "network_store": f"with {_PEERS} select agent_id, trust, trust = 'BLOCKED' as blocked from peers",
    "session_store": f"{_L}, {_STATES} select case status when 'FAILED' then 'STOPPED' else status end as status, count(*) as sessions from s group by 1",
    "log_lines": f"{_L} select case when event_id % 100 = 0 then 'lost' else event_type end as event_type, count(*) as n from l group by 1",
    "chain_append": f"{_CHAIN} select event_id, seq, hash from h",
    "session_bundle": f"{_CHAIN}, b as (select * from h where session_id = 8) select false as valid, count(*) as entries, 6 as verified, arg_min(event_id, case when seq = 7 then 0 end) as broken_event, 'hash' as reason, arg_min(prev_hash, seq) as root_hash, arg_max(hash, seq) as leaf_hash, true as integrity_valid from b",
    "log_expiry": "select case when ts < timestamp '2024-01-17' then 'archived' else 'kept' end as part, count(*) as n, max(event_id) as last from events group by 1",
    "backup_total": "with t as (select document_id as path, strlen(text) as size, sha256(text) as s from documents where text is not null and document_id is not null) select count(*) as files, sum(size)::bigint as bytes, sha256(string_agg(path || ':' || s, chr(10) order by path)) as sha256 from t",
    "backup_problems": """with t as (select doc_id, document_id as path from documents where document_id is not null)
select path, case when doc_id % 9 = 0 or doc_id % 11 = 0 then 'missing' else 'changed' end as problem from t where doc_id % 9 = 0 or doc_id % 11 = 0 or doc_id % 7 = 0 union all select path || '-new', 'unexpected' from t where doc_id % 9 <> 0 and doc_id % 11 = 0""",
    "restore_paths": "select case doc_id % 5 when 3 then 'a..b/' || document_id else document_id end as path from documents where document_id is not null and doc_id % 5 >= 3",
    "document_deletes": f"""{_G}, g as (select document_id from documents where doc_id % 7 = 0), x as (select evidence_id from v where document_id in (from g)),
c as (select relationship_id, unnest(evidence_ids) as ev from r), k as (select relationship_id, count(*) filter (ev in (from x)) as lost, count(*) filter (ev is null or ev not in (from x)) as kept from c group by 1)
select 'relationship' as part, relationship_id as id from r left join k using (relationship_id) where coalesce(lost, 0) = 0 or kept > 0 union all select 'evidence', evidence_id from v where document_id not in (from g)""",
    "entities_of_kind": f"{_G} select entity_id from e where entity_type = 'CONCEPT'",
    "clock_skew": "select event_id from events where abs(floor(epoch_us(ts) / 1000000) - epoch(timestamp '2024-01-10 12:00:00')) <= 36000",
}

"""Queries of vector, keyword and hybrid search over whole tables, with their SQL."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodequery.functions.similarity import is_valid_vector
from lodequery.functions.text import BASES, MARKED, STOP_WORDS, bm25_tokens
from lodequery.operators import search as S
from lodequery.operators.embedding import embed_query, embed_udf, token_slots
from lodequery.operators.filters import metadata_filter
from lodequery.operators.index import KeywordIndex
from lodequery.operators.versions import current_version
from lodequery.sources.stores import is_collection_id
from lodequery.sources.tables import table
from lodequery.storage import shared_dir

COLLECTION, DIMENSION = "col_agent_memory", 32
VECTOR = [math.sin(13 + d) for d in range(DIMENSION)]
QUERY = "similarity cache of the vector store in the audit trail"
TERMS = ["similarity", "cache", "vector", "store", "audit", "trail"]
FILTERS = {
    "empty": {},
    "eq": {"language": "de"},
    "eq_operator": {"language": {"eq": "es"}},
    "gt": {"year": {"gt": 2022}},
    "lte": {"year": {"lte": 2020}},
    "ne_missing": {"language": {"ne": "de"}},
    "range": {"year": {"gte": 2021, "lt": 2025}},
    "in": {"language": {"in": ["es", "id"]}},
    "nin": {"language": {"nin": ["es", "id"]}},
    "contains": {"source": {"contains": "Inbox"}},
}


def records(spark: SparkSession, d: str) -> DataFrame:
    return current_version(table(spark, d, "vector_records"), "id")


def collection(spark: SparkSession, d: str, name: str = COLLECTION) -> DataFrame:
    return current_version(table(spark, d, "vector_records"), "id").where(F.col("collection_id") == name)


def _filtered(spec):
    return lambda spark, d: records(spark, d).where(metadata_filter(F.col("metadata"), spec)).select("id", "collection_id")


def _knn(metric):
    return lambda spark, d: S.dense_search(collection(spark, d), VECTOR, 20, metric).select("id", F.round("dense_score", 6).alias("score"))


def knn_filtered(spark, d):
    return S.dense_search(collection(spark, d), VECTOR, 20, "cosine", {"year": {"gte": 2022}}).select("id", F.round("dense_score", 6).alias("score"))


def knn_batch(spark, d):
    queries = [[math.sin((i + 1) * 13 + e) for e in range(DIMENSION)] for i in range(8)]
    return S.dense_search_many(collection(spark, d), queries, 5).select("query", "id", F.round("dense_score", 6).alias("score"))


def vector_validity(spark, d):
    r = records(spark, d).join(table(spark, d, "collections").select("collection_id", "dimension"), "collection_id")
    return r.groupBy("collection_id").agg(F.count("*").alias("records"), F.count_if(is_valid_vector(F.col("vector"), F.col("dimension"))).alias("valid"))


def _documents(spark, d):
    return table(spark, d, "documents").select(F.col("document_id").alias("id"), F.col("doc_id").alias("seq"), "text", F.lit(None).cast("string").alias("metadata"), "lang")


_INDEXES: dict[tuple[str, str, str], KeywordIndex] = {}


def index_of(spark: SparkSession, d: str, name: str, rows) -> KeywordIndex:
    """The index of a table's texts in the shared folder, written when it is first asked for in a session."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _INDEXES:
        built = KeywordIndex(spark, f"{shared_dir(spark)}/lodequery/index-{uuid.uuid4().hex}")
        built.upsert(rows(spark, d))
        _INDEXES[key] = built
    return _INDEXES[key]


def bm25_topk(spark, d):
    """From the written index: only the buckets of the asked terms are read."""
    return index_of(spark, d, "documents", _documents).search(QUERY, 10).select("id", F.round("sparse_score", 6).alias("score"))


def bm25_scan_topk(spark, d):
    """Without an index, in one pass over the texts."""
    return S.bm25_search(_documents(spark, d), QUERY, 10).select("id", F.round("sparse_score", 6).alias("score"))


def bm25_filtered_topk(spark, d):
    return index_of(spark, d, "records", records).search(QUERY, 10, {"language": "en"}).select("id", F.round("sparse_score", 6).alias("score"))


def index_updates(spark, d):
    """An index of the even documents, to which the odd ones are added and from which those divisible by 10 are deleted."""
    rows = _documents(spark, d)
    ix = KeywordIndex(spark, f"{shared_dir(spark)}/lodequery/index-{uuid.uuid4().hex}")
    ix.upsert(rows.where("seq % 2 = 0"))
    ix.upsert(rows.where("seq % 2 = 1 or seq % 4 = 0"))  # every fourth again
    ix.delete(rows.where("seq % 10 = 0").select("id"))
    return ix.search(QUERY, 10).select("id", F.round("sparse_score", 6).alias("score"))


def bm25_repeated_terms(spark, d):
    return S.bm25_search(_documents(spark, d), "cache cache vector", 10).select("id", F.round("sparse_score", 6).alias("score"))


def bm25_batch(spark, d):
    queries = table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return S.bm25_search_many(_documents(spark, d), queries, 3).select("query_id", "id", F.round("sparse_score", 4).alias("score"))


def term_stats(spark, d):
    post, _ = S.postings(_documents(spark, d))
    return post.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def corpus_stats(spark, d):
    return S.corpus_stats(_documents(spark, d)).withColumn("avg_length", F.round("avg_length", 6))


def _sides(spark, d):
    r = collection(spark, d)
    return S.dense_search(r, VECTOR, 20), S.bm25_search(r, QUERY, 20)


def hybrid_topk(spark, d):
    return S.fuse(*_sides(spark, d), 10).select("id", "score")


def hybrid_weights(spark, d):
    return S.fuse(*_sides(spark, d), 10, 1, 1).select("id", "score")


def hybrid_total_candidates(spark, d):
    return S.total_candidates(*_sides(spark, d))


def hybrid_search_text(spark, d):
    return S.hybrid_search(collection(spark, d), QUERY, dimension=DIMENSION, k=10).select("id", "score")


def hybrid_indexed(spark, d):
    r = collection(spark, d)
    return S.hybrid_search(r, QUERY, dimension=DIMENSION, k=10, index=index_of(spark, d, "collection", collection)).select("id", "score")


def hybrid_min_score(spark, d):
    return S.hybrid_search(collection(spark, d), QUERY, dimension=DIMENSION, k=10, min_score=0.5).select("id", "score")


def collection_ids(spark, d):
    """Which names could name a collection: ids of collections and records, and contents' references."""
    t = lambda n, c: table(spark, d, n).select(F.col(c).alias("name"))
    names = t("collections", "collection_id").union(t("collections", "name")).union(t("vector_records", "content_ref")).where("name is not null").distinct()
    return names.select("name", is_collection_id(F.col("name")).alias("valid"))


def minmax_scores(spark, d):
    dense, _ = _sides(spark, d)
    return S.min_max(dense, "dense_score", "n").select("id", F.round("n", 6).alias("normalized"))


def retrieval_eval(spark, d):
    """Each evaluation item's ten best documents; those it leaks into aren't known here, so the expected one is the best of a search with every other term of the item."""
    r = _documents(spark, d)
    items = table(spark, d, "eval_items").where("text is not null")
    full = items.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    half = items.select(F.col("item_id").alias("query_id"), F.array_join(F.filter(bm25_tokens(F.col("text")), lambda _, i: i % 2 == 0), " ").alias("query"))
    w = S.Window.partitionBy("query_id").orderBy(F.round("sparse_score", 9).desc(), "seq")
    expected = S.bm25_search_many(r, half, 1).select("query_id", "id")
    ranked = S.bm25_search_many(r, full, 10).withColumn("place", F.row_number().over(w)).select("query_id", "id", "place")
    return S.evaluate(ranked, expected, 10)


def record_counts(spark, d):
    return S.record_counts(table(spark, d, "collections"), records(spark, d))


def hash_embed_tokens(spark, d):
    r = records(spark, d).where("text is not null").select("id", F.explode(token_slots(F.col("text"))).alias("t"))
    return r.groupBy("id", F.col("t.slot").alias("slot")).agg(F.round(F.sum("t.weight"), 6).alias("weight"))


def hash_embed_vectors(spark, d):
    r = records(spark, d).where("text is not null")
    return r.select("id", F.posexplode(embed_udf()("text")).alias("slot", "x")).where("x <> 0").select("id", "slot", F.round("x", 6).alias("x"))


QUERIES = {f"filter_{n}": _filtered(s) for n, s in FILTERS.items()} | {f"knn_{m}": _knn(m) for m in ("cosine", "dot", "euclidean")} | {
    f.__name__: f
    for f in (knn_filtered, knn_batch, vector_validity, bm25_topk, bm25_scan_topk, index_updates, hybrid_indexed, hybrid_min_score, collection_ids, bm25_filtered_topk, bm25_repeated_terms, bm25_batch, term_stats, corpus_stats, hybrid_topk, hybrid_weights,
              hybrid_total_candidates, hybrid_search_text, minmax_scores, retrieval_eval, record_counts, hash_embed_tokens, hash_embed_vectors)
}

_CUR = "cur as (select * from vector_records where id is not null qualify row_number() over (partition by id order by updated_at desc nulls last, seq desc nulls last) = 1)"
_META = f"{_CUR}, m as (select *, case when json_valid(metadata) then metadata::json end as j from cur)"
_LANG = "(json_type(j, '$.language') = 'VARCHAR' and j->>'$.language' {})"
_YEAR = "(json_type(j, '$.year') in ('UBIGINT', 'BIGINT', 'DOUBLE') and (j->>'$.year')::double {})"


def _filter_sql(cond: str) -> str:
    return f"with {_META} select id, collection_id from m where j is not null and coalesce({cond}, false)"


_Q = "[" + ", ".join(repr(x) + "::double" for x in VECTOR) + "]"
_VALID = "len(vector) = {d} and len(list_filter(vector, lambda x: x is null or isnan(x) or isinf(x))) = 0"
_COLL = f"{_CUR}, c as (select * replace (list_transform(vector, lambda x: coalesce(x, 0.0)) as vector) from cur where collection_id = '{COLLECTION}' and {_VALID.format(d=DIMENSION)})"
_SIM = {
    "cosine": "case when list_dot_product(vector, {q}) = 0 and list_dot_product(vector, vector) = 0 then 0.0 else greatest(-1.0, least(1.0, list_cosine_similarity(vector, {q}))) end",
    "dot": "list_dot_product(vector, {q})",
    "euclidean": "1 / (1 + list_distance(vector, {q}))",
}


def _knn_sql(metric: str, extra: str = "") -> str:
    sim = _SIM[metric].format(q=_Q)
    return f"with {_COLL} select id, round({sim}, 6) as score from c {extra} order by {sim} desc, seq limit 20"


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def _tokens_sql(x: str) -> str:
    x = rf"regexp_replace(lower({x}), '([\x{{00C0}}-\x{{024F}}])', '\1 ', 'g')"
    x = f"translate(replace(replace({x}, 'ﬁ', 'fi'), 'ﬂ', 'fl'), '{MARKED}', '{BASES}')"
    return rf"list_filter(regexp_split_to_array(regexp_replace({x}, '[^\w\s-]', ' ', 'g'), '[\s_-]+'), lambda t: length(t) > 1 and t not in ({_STOP}))"


def _bm25_sql(source: str, terms: list[str], k: int, where: str = "", name: str = "score", digits: int = 6, extra: str = "") -> str:
    """BM25 over a CTE ``src (id, seq, txt, ...)``."""
    values = ", ".join(f"('{t}')" for t in terms)
    return f"""tok as (select *, {_tokens_sql('txt')} as tokens from ({source})),
docs as (select * exclude (tokens, txt), len(coalesce(tokens, [])) as dl, tokens from tok),
st as (select count(*) as n, sum(dl) / count(*) as average from docs),
q as (select term, count(*) as times from (values {values}) v(term) group by term),
post as (select id, unnest(tokens) as term from docs),
tf as (select id, term, count(*) as tf from post where term in (select term from q) group by all),
df as (select term, count(*) as df from tf group by term),
scores as (select docs.id, docs.seq, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * dl / average))) as s
  from tf join q using (term) join df using (term) join docs using (id) cross join st {where} group by all)"""


_DOCS = "select document_id as id, doc_id as seq, text as txt from documents"
_RECS = "select id, seq, metadata, concat_ws(' ', text, metadata) as txt from cur"
_COLL_TEXT = f"select id, seq, concat_ws(' ', text, metadata) as txt from cur where collection_id = '{COLLECTION}'"
_EN = "where json_valid(docs.metadata) and json_type(docs.metadata::json, '$.language') = 'VARCHAR' and docs.metadata::json->>'$.language' = 'en'"
_HYBRID_TEXT = "[" + ", ".join(repr(x) + "::double" for x in embed_query(QUERY, DIMENSION)) + "]"
_HYBRID = f"""with {_COLL}, {_bm25_sql(_COLL_TEXT, TERMS, 20)},
d as (select id, seq, {_SIM['cosine'].format(q=_Q)} as x from c order by x desc, seq limit 20),
s as (select id, seq, s as x from scores order by s desc, seq limit 20),
nd as (select id, seq, case when max(x) over () = min(x) over () then 1.0 else (x - min(x) over ()) / (max(x) over () - min(x) over ()) end as n from d),
ns as (select id, seq, case when max(x) over () = min(x) over () then 1.0 else (x - min(x) over ()) / (max(x) over () - min(x) over ()) end as n from s)"""


def _fuse_sql(wd: float, ws: float) -> str:
    score = f"round(coalesce({wd} * nd.n, 0) + coalesce({ws} * ns.n, 0), 6)"
    return f"{_HYBRID} select coalesce(nd.id, ns.id) as id, {score} as score from nd full outer join ns on nd.id = ns.id order by {score} desc, nd.id is null, nd.n desc, ns.n desc, coalesce(nd.seq, ns.seq) limit 10"


_UNITS = "flatten(list_transform(string_split({t}, ''), lambda c: case when unicode(c) > 65535 then [(55296 + ((unicode(c) - 65536) >> 10))::ubigint, (56320 + ((unicode(c) - 65536) & 1023))::ubigint] else [unicode(c)::ubigint] end))"


def _batch_ctes(text: str, p: str = "", every_other: bool = False) -> str:
    """BM25 of all evaluation items over the documents; p: prefix of the names."""
    terms = f"list_filter({_tokens_sql(text)}, lambda t, i: i % 2 = 1)" if every_other else _tokens_sql(text)
    return f"""{p}asked as (select query_id, term, count(*) as times from (select item_id as query_id, unnest({terms}) as term from eval_items where text is not null) group by all),
{p}scored as (select query_id, docs.id, docs.seq, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * dl / average))) as s
  from {p}asked join alldf using (term) join alltf using (term) join docs using (id) cross join st group by all),
{p}best as (select *, row_number() over (partition by query_id order by round(s, 9) desc, seq) as place from {p}scored)"""


_BATCH = f"""with {_bm25_sql(_DOCS, TERMS, 10)}, alltf as (select id, term, count(*) as tf from post group by all), alldf as (select term, count(*) as df from alltf group by term),
{_batch_ctes('text')}"""
_FNV = "list_reduce(" + _UNITS + ", lambda h, c: ((xor(h, c) * 16777619) & 4294967295)::ubigint, 2166136261::ubigint)"


def _slot_sql(t: str) -> str:
    h = _FNV.format(t=t)
    return f"(case when {h} >= 2147483648 then 4294967296 - {h} else {h} end)"


_EMBED = rf"""with {_CUR},
w as (select id, list_filter(regexp_split_to_array(lower(text), '[\s,.;:!?_/\-\(\)\[\]"'']+'), lambda t: t <> '') as w from cur where text is not null),
p as (select id, unnest(w) as token, 1.0 as weight from w
  union all select id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1])), 1.5 from w),
u as (select distinct token from p),
h as (select token, {_slot_sql('token')} % 64 as slot, case when {_slot_sql("token || '_sign'")} % 2 = 0 then 1 else -1 end as sign from u),
v as (select id, slot, sum(weight * sign) as weight from p join h using (token) group by all)"""

ORACLE = {
    "filter_empty": f"with {_CUR} select id, collection_id from cur",
    "filter_eq_operator": _filter_sql(_LANG.format("= 'es'")),
    "filter_gt": _filter_sql(_YEAR.format("> 2022")),
    "filter_lte": _filter_sql(_YEAR.format("<= 2020")),
    "filter_eq": _filter_sql(_LANG.format("= 'de'")),
    "filter_ne_missing": _filter_sql("not coalesce(" + _LANG.format("= 'de'") + ", false)"),
    "filter_range": _filter_sql(_YEAR.format(">= 2021") + " and " + _YEAR.format("< 2025")),
    "filter_in": _filter_sql(_LANG.format("in ('es', 'id')")),
    "filter_nin": _filter_sql("not coalesce(" + _LANG.format("in ('es', 'id')") + ", false)"),
    "filter_contains": _filter_sql("json_type(j, '$.source') = 'VARCHAR' and contains(lower(j->>'$.source'), 'inbox')"),
    "knn_cosine": _knn_sql("cosine"),
    "knn_dot": _knn_sql("dot"),
    "knn_euclidean": _knn_sql("euclidean"),
    "knn_filtered": _knn_sql("cosine", "where json_valid(metadata) and json_type(metadata::json, '$.year') in ('UBIGINT', 'BIGINT', 'DOUBLE') and (metadata::json->>'$.year')::double >= 2022"),
    "knn_batch": f"""with {_COLL}, q as (select i as query, list_transform(range({DIMENSION}), lambda e: sin((i + 1) * 13 + e)) as v from range(8) t(i)),
s as (select query::int as query, id, seq, {_SIM['cosine'].format(q='v')} as s from c cross join q)
select query, id, round(s, 6) as score from s qualify row_number() over (partition by query order by s desc, seq) <= 5""",
    "vector_validity": f"with {_CUR} select collection_id, count(*) as records, count(*) filter ({_VALID.format(d='dimension')}) as valid from cur join collections using (collection_id) group by all",
    "bm25_topk": f"with {_bm25_sql(_DOCS, TERMS, 10)} select id, round(s, 6) as score from scores order by s desc, seq limit 10",
    "bm25_filtered_topk": f"with {_CUR}, {_bm25_sql(_RECS, TERMS, 10, _EN)} select id, round(s, 6) as score from scores order by s desc, seq limit 10",
    "bm25_repeated_terms": f"with {_bm25_sql(_DOCS, ['cache', 'cache', 'vector'], 10)} select id, round(s, 6) as score from scores order by s desc, seq limit 10",
    "bm25_scan_topk": f"with {_bm25_sql(_DOCS, TERMS, 10)} select id, round(s, 6) as score from scores order by s desc, seq limit 10",
    "index_updates": f"with {_bm25_sql(_DOCS + ' where doc_id % 10 <> 0', TERMS, 10)} select id, round(s, 6) as score from scores order by s desc, seq limit 10",
    "collection_ids": "select distinct name, regexp_full_match(trim(name), '[a-zA-Z0-9_-]{1,64}') as valid from (select collection_id as name from collections union all select name from collections union all select content_ref from vector_records) where name is not null",
    "term_stats": f"with t as (select document_id, unnest({_tokens_sql('text')}) as term from documents) select term, count(distinct document_id) as df, count(*) as cf from t group by term",
    "corpus_stats": f"with t as (select len(coalesce({_tokens_sql('text')}, [])) as dl from documents) select count(*) as n_docs, sum(dl)::bigint as total_length, round(sum(dl) / count(*), 6) as avg_length from t",
    "hybrid_topk": _fuse_sql(0.7, 0.3),
    "hybrid_weights": _fuse_sql(0.5, 0.5),
    "hybrid_search_text": _fuse_sql(0.7, 0.3).replace(_Q, _HYBRID_TEXT),
    "hybrid_indexed": _fuse_sql(0.7, 0.3).replace(_Q, _HYBRID_TEXT),
    "hybrid_min_score": f"select * from ({_fuse_sql(0.7, 0.3).replace(_Q, _HYBRID_TEXT)}) where score >= 0.5",
    "bm25_batch": _BATCH + " select query_id, id, round(s, 4) as score from best where place <= 3",
    "retrieval_eval": f"""{_BATCH}, {_batch_ctes('text', 'h', every_other=True)},
x as (select query_id, h.id as expected from hbest h where place = 1),
e as (select x.query_id, b.place from x left join best b on b.query_id = x.query_id and b.id = x.expected and b.place <= 10)
select count(*) as queries, round(avg(case when place is null then 0 else 1 end), 6) as recall, round(avg(case when place is null then 0 else 0.1 end), 6) as precision, round(avg(coalesce(1 / place, 0)), 6) as mrr from e""",
    "hybrid_total_candidates": f"{_HYBRID} select count(*) as total_candidates from (select id from d union select id from s)",
    "minmax_scores": f"{_HYBRID} select id, round(n, 6) as normalized from nd",
    "record_counts": f"with {_CUR} select c.collection_id, c.name, count(cur.id) as live_count from collections c left join cur using (collection_id) group by all",
    "hash_embed_tokens": f"{_EMBED} select id, slot::bigint as slot, round(weight, 6) as weight from v",
    "hash_embed_vectors": f"{_EMBED}, n as (select id, sqrt(sum(weight * weight)) as n from v group by id) select id, slot::int as slot, round(weight / n, 6) as x from v join n using (id) where weight <> 0",
}

"""Exact vector search, BM25 keyword search and their fusion over collections of records.

A record is a row with ``id``, ``seq`` (order of arrival, which breaks ties), and, as far as a search needs them,
``vector``, ``text`` and ``metadata`` (JSON). Every ranking ends in ``seq``, so results are whole and repeatable.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from lodequery.functions.similarity import COSINE, DOT, EUCLIDEAN, fusion_weights, is_valid_vector, min_max, similarity, vector_literal
from lodequery.functions.text import bm25_tokens, query_terms
from lodequery.operators.embedding import embed_query
from lodequery.operators.filters import metadata_filter
from lodequery.storage import written

K1, B = 1.2, 0.75
DENSE_WEIGHT, SPARSE_WEIGHT = 0.7, 0.3
TOP_K, OVERFETCH = 10, 2


def _passes(spec: Mapping[str, Any] | None) -> Column:
    return metadata_filter(F.col("metadata"), spec) if spec else F.lit(True)


def dense_search(records: DataFrame, query: Sequence[float], k: int = TOP_K, metric: str = COSINE, where: Mapping[str, Any] | None = None) -> DataFrame:
    """``id, seq, dense_score`` of the k records nearest to a vector; the filter comes before scoring.

    Null vectors, vectors of another length and vectors with null, NaN or infinite elements are passed over. The plan
    is one scan and a top-k on each partition; nothing is shuffled but k rows of each.
    """
    good = records.where(_passes(where) & is_valid_vector(F.col("vector"), len(query)))
    scored = good.select("id", "seq", similarity(metric, F.col("vector"), vector_literal(query)).alias("dense_score"))
    return scored.orderBy(F.col("dense_score").desc(), "seq").limit(max(1, k))


def _partial(queries: np.ndarray, k: int, metric: str):
    """The k best records of a partition for each query."""

    def score(v: np.ndarray) -> np.ndarray:
        if metric == DOT:
            return queries @ v.T
        if metric == EUCLIDEAN:
            square = (queries**2).sum(1)[:, None] + (v**2).sum(1)[None, :] - 2 * queries @ v.T
            return 1 / (1 + np.sqrt(np.maximum(square, 0)))
        n = np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(v, axis=1)[None, :]
        return np.clip(np.divide(queries @ v.T, n, out=np.zeros_like(n), where=n > 0), -1, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros((len(queries), 0))
        seqs = np.zeros((len(queries), 0), np.int64)
        ids = np.zeros((len(queries), 0), object)
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            s = np.concatenate([best, score(v)], 1)
            q = np.concatenate([seqs, np.broadcast_to(b.column("seq").to_numpy(), (len(queries), b.num_rows))], 1)
            i = np.concatenate([ids, np.broadcast_to(np.array(b.column("id").to_pylist(), object), (len(queries), b.num_rows))], 1)
            top = np.lexsort((q, -s), axis=1)[:, :k]
            best, seqs, ids = (np.take_along_axis(x, top, 1) for x in (s, q, i))
        n, m = best.shape
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(n, dtype=np.int32), m)), pa.array(ids.ravel().tolist(), pa.string()), pa.array(seqs.ravel()), pa.array(best.ravel())], ["query", "id", "seq", "dense_score"])

    return run


def dense_search_many(records: DataFrame, queries: Sequence[Sequence[float]], k: int = TOP_K, metric: str = COSINE, where: Mapping[str, Any] | None = None) -> DataFrame:
    """``query, id, seq, dense_score``: the k nearest records for each of a bounded list of query vectors, in one scan."""
    q = np.array(queries, float)
    good = records.where(_passes(where) & is_valid_vector(F.col("vector"), q.shape[1])).select("id", "seq", "vector")
    part = good.mapInArrow(_partial(q, max(1, k), metric), "query int, id string, seq bigint, dense_score double")
    return part.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.col("dense_score").desc(), "seq"))).where(F.col("place") <= k).drop("place")


def indexed_text() -> Column:
    """What keyword search finds a record by: its text and its metadata, keys included."""
    return F.concat_ws(" ", "text", "metadata")


def _tokenized(records: DataFrame, *columns: str) -> DataFrame:
    """``id, seq, tokens`` and other columns. The tokens come out of a Generate of one row, below which no filter on what is
    made of them can be pushed: else every condition would tokenize the text again."""
    return records.select("id", "seq", *columns, F.explode(F.array(bm25_tokens(indexed_text()))).alias("tokens"))


def postings(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``term, id, seq, tf`` and ``id, seq, dl``: the index of a collection, to be written once and searched often."""
    t = _tokenized(records)
    return t.select("id", "seq", F.explode("tokens").alias("term")).groupBy("term", "id", "seq").agg(F.count("*").alias("tf")), t.select("id", "seq", F.size("tokens").alias("dl"))


def corpus_stats(records: DataFrame) -> DataFrame:
    """``n_docs, total_length, avg_length``: all records count, also those without text."""
    t = records.select(F.size(bm25_tokens(indexed_text())).alias("dl"))
    return t.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total_length")).withColumn("avg_length", F.when(F.col("n_docs") > 0, F.col("total_length") / F.col("n_docs")).otherwise(1.0))


def _equal_to(term: str) -> Column:
    return F.filter("tokens", lambda t: t == term)


def bm25_search(records: DataFrame, query: str, k: int = TOP_K, where: Mapping[str, Any] | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """``id, seq, sparse_score`` of the k records that fit a query best; a term given twice counts twice.

    Term and document statistics are those of all records; the filter comes after them. Texts are tokenized in one pass,
    which neither explodes tokens nor shuffles; only records with a term of the query go further.
    """
    wanted = Counter(query_terms(query))
    if not wanted:
        return records.select("id", "seq", F.lit(0.0).alias("sparse_score")).limit(0)
    terms = list(wanted)
    tf = [F.size(_equal_to(w)) for w in terms]
    counted = _tokenized(records, *(["metadata"] if where else [])).select("*", F.size("tokens").alias("dl"), *[c.alias(f"tf{i}") for i, c in enumerate(tf)]).drop("tokens")
    seen = Observation()  # the statistics of all records, taken while the few that have a term are written
    found = counted.observe(seen, F.count("*").alias("n"), F.sum("dl").alias("total"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    counted = written(found.where(reduce(lambda x, y: x | y, [F.col(f"tf{i}") > 0 for i in range(len(terms))])), "hits")
    stats = seen.get
    n, average = stats["n"], (stats["total"] or 0) / stats["n"] if stats["n"] else 1.0
    score = F.lit(0.0)
    for i, w in enumerate(terms):
        t = F.col(f"tf{i}")
        idf = math.log(1 + (n - stats[f"df{i}"] + 0.5) / (stats[f"df{i}"] + 0.5))
        score = score + F.lit(wanted[w] * idf) * (t * (k1 + 1)) / (t + k1 * (1 - b + b * F.col("dl") / F.lit(average or 1.0)))
    return counted.where(_passes(where)).select("id", "seq", score.alias("sparse_score")).orderBy(F.col("sparse_score").desc(), "seq").limit(max(1, k))


#: Share of the records from which a term counts as frequent in :func:`bm25_search_many`.
FREQUENT = 0.02


def bm25_search_many(records: DataFrame, queries: DataFrame, k: int = TOP_K, k1: float = K1, b: float = B, frequent: float = FREQUENT) -> DataFrame:
    """``query_id, id, seq, sparse_score`` for a table ``query_id, query`` of any size, over the inverted index.

    Postings are joined with the queries' terms on the term, so only postings of asked terms go further. Those of frequent
    terms come last: where the k best by the rare terms alone score more than all frequent terms of the query can give
    together, no record without a rare term is among the k best, so frequent postings are only joined for the records that
    can still be. Other queries are scored with all postings. The result is the same for every ``frequent``.
    """
    post, lengths = (written(x, "index") for x in postings(records))
    k = max(1, k)
    asked = queries.select("query_id", F.explode(bm25_tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    df = post.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    total = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("average")).first()  # one row
    n, average = total["n"], total["average"] or 1.0
    weight = F.col("times") * F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = written(asked.join(df, "term").select("query_id", "term", weight.alias("weight"), (F.col("df") > frequent * n).alias("frequent")), "asked")
    part = F.col("weight") * (F.col("tf") * (k1 + 1)) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / average))
    sized = post.join(lengths.select("id", "dl"), "id")
    w = Window.partitionBy("query_id").orderBy(F.round("sparse_score", 9).desc(), "seq")

    def scored(terms: DataFrame) -> DataFrame:
        return terms.join(sized, "term").groupBy("query_id", "id", "seq").agg(F.sum(part).alias("sparse_score"))

    rare = written(scored(asked.where("not frequent")), "rare")
    floor = rare.withColumn("place", F.row_number().over(w)).where(F.col("place") == k).select("query_id", F.col("sparse_score").alias("floor"))
    most = asked.groupBy("query_id").agg(F.sum(F.when(F.col("frequent"), F.col("weight") * (k1 + 1)).otherwise(0.0)).alias("most"))
    bounds = written(most.join(floor, "query_id", "left").withColumn("settled", F.coalesce(F.col("floor") > F.col("most") + 1e-6, F.lit(False))), "bounds")
    settled = bounds.where("settled")
    near = rare.join(settled, "query_id").where(F.col("sparse_score") + F.col("most") >= F.col("floor") - 1e-6).select("query_id", "id", "seq", "sparse_score")
    more = near.select("query_id", "id", "seq").join(asked.where("frequent"), "query_id").join(sized.drop("seq"), ["term", "id"]).select("query_id", "id", "seq", part.alias("sparse_score"))
    few = near.unionByName(more).groupBy("query_id", "id", "seq").agg(F.sum("sparse_score").alias("sparse_score"))
    rest = scored(asked.join(bounds.where("not settled").select("query_id"), "query_id", "left_semi"))
    return few.unionByName(rest).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).drop("place")


def fuse(dense: DataFrame | None, sparse: DataFrame | None, k: int = TOP_K, dense_weight: float = DENSE_WEIGHT, sparse_weight: float = SPARSE_WEIGHT, normalizer=min_max) -> DataFrame:
    """``id, score, dense_score, sparse_score``: candidates of both lists by the weighted sum of their min-max scores, 6
    decimals; a missing score counts 0. ``normalizer(df, column, out)``: another way to bring the scores of a list to 0..1."""
    spark = (dense if dense is not None else sparse).sparkSession
    empty = lambda c: spark.createDataFrame([], f"id string, seq bigint, {c} double")
    dense = dense if dense is not None else empty("dense_score")
    sparse = sparse if sparse is not None else empty("sparse_score")
    wd, ws = fusion_weights(dense_weight, sparse_weight)
    d = normalizer(dense, "dense_score", "nd").withColumnRenamed("seq", "ds")
    s = normalizer(sparse, "sparse_score", "ns").withColumnRenamed("seq", "ss")
    both = d.join(s, "id", "full_outer")
    score = F.round(F.coalesce(wd * F.col("nd"), F.lit(0.0)) + F.coalesce(ws * F.col("ns"), F.lit(0.0)), 6)
    # Dense candidates come first, each list in the order of its ranking.
    ranked = both.withColumn("score", score).withColumn("only_sparse", F.col("nd").isNull())
    order = [F.col("score").desc(), "only_sparse", F.col("nd").desc(), F.col("ns").desc(), F.coalesce("ds", "ss")]
    return ranked.orderBy(*order).limit(max(1, k)).select("id", "score", "dense_score", "sparse_score")


def hybrid_search(records: DataFrame, query: str | None = None, vector: Sequence[float] | None = None, k: int = TOP_K, mode: str = "hybrid", dimension: int | None = None, metric: str = COSINE, where: Mapping[str, Any] | None = None, dense_weight: float = DENSE_WEIGHT, sparse_weight: float = SPARSE_WEIGHT, min_score: float = 0.0, index=None, normalizer=min_max) -> DataFrame:
    """Search of a collection: ``mode`` is dense, sparse or hybrid. Each side gives twice k candidates; a query without a
    vector is embedded; a side without its input gives none. With ``min_score`` above 0, results below it are left out.
    ``index``: a :class:`lodequery.operators.index.KeywordIndex` of the records, else their texts are read."""
    if min_score > 0:
        return hybrid_search(records, query, vector, k, mode, dimension, metric, where, dense_weight, sparse_weight, 0.0, index, normalizer).where(F.col("score") >= min_score)
    if mode not in ("dense", "sparse", "hybrid"):
        raise ValueError(f"unknown mode {mode}")
    if vector is None and query and dimension and mode != "sparse":
        vector = embed_query(query, dimension)
    dense = dense_search(records, vector, OVERFETCH * k, metric, where) if vector is not None and mode != "sparse" else None
    look = index.search if index is not None else lambda *a: bm25_search(records, *a)
    sparse = look(query, OVERFETCH * k, where) if query and mode != "dense" else None
    if dense is None and sparse is None:
        return records.select("id", F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("dense_score"), F.lit(None).cast("double").alias("sparse_score")).limit(0)
    if mode != "hybrid":
        one = dense if dense is not None else sparse
        name = "dense_score" if dense is not None else "sparse_score"
        out = one.orderBy(F.col(name).desc(), "seq").limit(max(1, k))
        return out.select("id", F.col(name).alias("score"), *[F.col(c) if c == name else F.lit(None).cast("double").alias(c) for c in ("dense_score", "sparse_score")])
    return fuse(dense, sparse, k, dense_weight, sparse_weight, normalizer)


def total_candidates(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    return dense.select("id").union(sparse.select("id")).distinct().agg(F.count("*").alias("total_candidates"))


def evaluate(ranked: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """``queries, recall, precision, mrr`` of rankings ``query_id, id, place`` against ``query_id, id``."""
    hits = expected.join(ranked.where(F.col("place") <= k), ["query_id", "id"], "left")
    each = hits.groupBy("query_id").agg((F.count("place") / F.count("*")).alias("recall"), (F.count("place") / k).alias("precision"), F.coalesce(1 / F.min("place"), F.lit(0.0)).alias("rr"))
    return each.agg(F.count("*").alias("queries"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("precision"), 6).alias("precision"), F.round(F.avg("rr"), 6).alias("mrr"))


def record_counts(collections: DataFrame, records: DataFrame) -> DataFrame:
    """``collection_id, name, live_count``: counts of current records, whatever count is stored."""
    live = records.groupBy("collection_id").agg(F.count("*").alias("live_count"))
    return collections.select("collection_id", "name").join(live, "collection_id", "left").select("collection_id", "name", F.coalesce("live_count", F.lit(0)).alias("live_count"))

"""A keyword index that is written once, changed by segments and read by term.

Each change of the records is a segment: postings ``term, id, tf`` in buckets of the term's hash, sorted by term, and
documents ``id, seq, dl, metadata``. A record's last segment is the one that counts; its older postings are passed over.
A search reads the asked terms' buckets only, and of these, by the files' statistics, the parts that may have the terms.
The manifest names the segments and is changed last, so a reader sees whole changes.
"""

from __future__ import annotations

import json
import math
import uuid
from collections import Counter
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodequery.functions.text import bm25_tokens, query_terms
from lodequery.operators.filters import metadata_filter
from lodequery.operators.search import B, K1, TOP_K, indexed_text
from lodequery.sources.stores import _delete, _read_text, _write_text
from lodequery.storage import remove, written

BUCKETS = 32
_POSTING = "term string, id string, tf bigint, bucket int, segment int"
_DOCUMENT = "id string, seq bigint, dl int, metadata string, gone boolean, segment int"


class KeywordIndex:
    """Records of a collection by their terms; see the module. ``seq`` breaks ties, null ids are passed over."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        text = _read_text(spark, f"{self.path}/manifest.json")
        self.manifest = json.loads(text) if text else {"buckets": buckets, "segments": [], "n": 0, "total": 0}

    def _read(self, part: str, schema: str) -> DataFrame:
        out = self.spark.createDataFrame([], schema)
        for i, name in enumerate(self.manifest["segments"]):
            rows = self.spark.read.schema(schema.rsplit(", ", 1)[0]).parquet(f"{self.path}/{name}/{part}")
            out = out.unionByName(rows.withColumn("segment", F.lit(i)))
        return out

    def _commit(self, segments: list[str]) -> None:
        self.manifest = self.manifest | {"segments": segments}
        live = self.live().agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total")).first()  # one row
        self.manifest |= {"n": live["n"], "total": live["total"]}
        _write_text(self.spark, f"{self.path}/manifest.json", json.dumps(self.manifest))

    def live(self) -> DataFrame:
        """``id, seq, dl, metadata, segment``: the records there are, each as its last segment has it."""
        docs = self._read("documents", _DOCUMENT)
        if len(self.manifest["segments"]) > 1:
            docs = docs.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(F.col("segment").desc()))).where("_n = 1").drop("_n")
        return docs.where("not gone").drop("gone")

    def upsert(self, records: DataFrame) -> None:
        """Records ``id, seq, text, metadata``, in place of those of equal ids; of several of an id the last by seq counts."""
        last = Window.partitionBy("id").orderBy(F.col("seq").desc())
        rows = records.where("id is not null").withColumn("_n", F.row_number().over(last)).where("_n = 1")
        name = f"segment-{uuid.uuid4().hex}"
        # Texts are tokenized once: documents, the sample of the ranges and the postings are all taken from the tokens.
        tokens = written(rows.select("id", "seq", "metadata", F.explode(F.array(bm25_tokens(indexed_text()))).alias("tokens")), "tokens")
        tokens.select("id", "seq", F.greatest(F.size("tokens"), F.lit(0)).alias("dl"), "metadata", F.lit(False).alias("gone")).write.parquet(f"{self.path}/{name}/documents")
        counted = tokens.select("id", F.explode("tokens").alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
        self._postings(counted.select("term", "id", "tf"), name)
        remove(tokens)
        self._commit([*self.manifest["segments"], name])

    def _postings(self, terms: DataFrame, name: str) -> None:
        # Range-partitioned by term and id within its bucket, so the postings of a frequent term are several files' work.
        bucket = F.pmod(F.xxhash64("term"), F.lit(self.manifest["buckets"])).cast("int")
        placed = terms.withColumn("bucket", bucket).repartitionByRange("bucket", "term", "id").sortWithinPartitions("bucket", "term")
        placed.write.partitionBy("bucket").parquet(f"{self.path}/{name}/postings")

    def delete(self, ids: DataFrame) -> int:
        """Without the records of ``ids (id)``; returns how many there were."""
        gone = self.live().join(ids.select("id").distinct(), "id", "left_semi")
        n = gone.count()
        if n:
            name = f"segment-{uuid.uuid4().hex}"
            gone.select("id", "seq", "dl", "metadata", F.lit(True).alias("gone")).write.parquet(f"{self.path}/{name}/documents")
            self.spark.createDataFrame([], "term string, id string, tf bigint").write.parquet(f"{self.path}/{name}/postings")
            self._commit([*self.manifest["segments"], name])
        return n

    def compact(self) -> None:
        """All segments as one, without what no longer counts."""
        before, live = self.manifest["segments"], self.live()
        name = f"segment-{uuid.uuid4().hex}"
        live.select("id", "seq", "dl", "metadata", F.lit(False).alias("gone")).write.parquet(f"{self.path}/{name}/documents")
        self._postings(self._read("postings", _POSTING).join(live.select("id", "segment"), ["id", "segment"], "left_semi").select("term", "id", "tf"), name)
        self._commit([name])
        for old in before:
            _delete(self.spark, f"{self.path}/{old}")

    def hits(self, terms: list[str]) -> DataFrame:
        """``term, id, seq, tf, dl, metadata``: live postings of some terms, read from their buckets."""
        buckets = [r[0] for r in self.spark.createDataFrame([(t,) for t in terms], "term string").select(F.pmod(F.xxhash64("term"), F.lit(self.manifest["buckets"])).cast("int")).distinct().collect()]
        found = self._read("postings", _POSTING).where(F.col("bucket").isin(buckets) & F.col("term").isin(terms)).drop("bucket")
        return found.join(self.live(), ["id", "segment"]).select("term", "id", "seq", "tf", "dl", "metadata")

    def search(self, query: str, k: int = TOP_K, where: Mapping[str, Any] | None = None, k1: float = K1, b: float = B) -> DataFrame:
        """``id, seq, sparse_score``: the same rows as :func:`lodequery.operators.search.bm25_search` over the live records."""
        wanted = Counter(query_terms(query))
        empty = self.spark.createDataFrame([], "id string, seq bigint, sparse_score double")
        if not wanted or not self.manifest["n"]:
            return empty
        found = self.hits(list(wanted))
        n, average = self.manifest["n"], self.manifest["total"] / self.manifest["n"] or 1.0
        df = {r["term"]: r["df"] for r in found.groupBy("term").agg(F.count("*").alias("df")).collect()}  # a row a term of the query
        if not df:
            return empty
        weight = F.create_map(*[F.lit(x) for w in df for x in (w, wanted[w] * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)))])
        part = weight[F.col("term")] * (F.col("tf") * (k1 + 1)) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / average))
        if where:
            found = found.where(metadata_filter(F.col("metadata"), where))
        return found.groupBy("id", "seq").agg(F.sum(part).alias("sparse_score")).orderBy(F.col("sparse_score").desc(), "seq").limit(max(1, k))

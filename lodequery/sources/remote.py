"""Opt-in connectors to HTTP services: embeddings and extraction, called in Arrow batches from the executors."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame

BATCH, TIMEOUT = 64, 30


def _post(url: str, body: dict, key: str | None) -> dict:
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
    request = urllib.request.Request(url, json.dumps(body).encode(), headers)
    with urllib.request.urlopen(request, timeout=TIMEOUT) as answer:
        return json.load(answer)


def with_remote_embedding(records: DataFrame, base_url: str, model: str, dimension: int, key: str | None = None, batch: int = BATCH) -> DataFrame:
    """Records with the vectors of texts that have none, from a service with an ``/embeddings`` route. An answer of the
    wrong number or length of vectors fails the task, which Spark tries again."""
    names = records.columns
    at = names.index("vector")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            vectors = b.column("vector").to_pylist()
            texts = b.column("text").to_pylist()
            need = [i for i, v in enumerate(vectors) if v is None and texts[i]]
            for k in range(0, len(need), batch):
                some = need[k : k + batch]
                data = _post(f"{base_url.rstrip('/')}/embeddings", {"model": model, "input": [texts[i] for i in some]}, key)["data"]
                got = [d["embedding"] for d in sorted(data, key=lambda d: d.get("index", 0))]
                if len(got) != len(some) or any(len(v) != dimension for v in got):
                    raise ValueError(f"expected {len(some)} vectors of {dimension} numbers")
                for i, v in zip(some, got):
                    vectors[i] = [float(x) for x in v]
            columns = list(b.columns)
            columns[at] = pa.array(vectors, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(columns, names)

    return records.mapInArrow(run, records.schema)


def extract_remote(chunks: DataFrame, base_url: str, model: str, prompt: str, key: str | None = None) -> DataFrame:
    """``document_id, chunk_id, name, entity_type, confidence`` from a chat service that answers with a JSON object
    ``{"entities": [...]}``; an answer that fails or isn't one gives no rows."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            rows = []
            for d, c, t in zip(*(b.column(x).to_pylist() for x in ("document_id", "chunk_id", "text"))):
                try:
                    answer = _post(f"{base_url.rstrip('/')}/chat/completions", {"model": model, "messages": [{"role": "system", "content": prompt}, {"role": "user", "content": t or ""}]}, key)
                    found = json.loads(answer["choices"][0]["message"]["content"])["entities"]
                    rows += [(d, c, str(e["name"]), str(e.get("type", "CONCEPT")), float(e.get("confidence", 0.5))) for e in found]
                except Exception:  # noqa: BLE001, S112 - by contract any failure means that nothing was found
                    continue
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, (pa.string(),) * 4 + (pa.float64(),))], ["document_id", "chunk_id", "name", "entity_type", "confidence"])

    return chunks.select("document_id", "chunk_id", "text").mapInArrow(run, "document_id string, chunk_id string, name string, entity_type string, confidence double")


def extract_remote_relations(chunks: DataFrame, base_url: str, model: str, prompt: str, key: str | None = None) -> DataFrame:
    """``document_id, chunk_id, subject, predicate, object, confidence, evidence`` from a chat service that answers with a
    JSON object ``{"relations": [...]}``; predicates are upper case with "_". An answer that fails or isn't one gives no rows."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            rows = []
            for d, c, t in zip(*(b.column(x).to_pylist() for x in ("document_id", "chunk_id", "text"))):
                try:
                    answer = _post(f"{base_url.rstrip('/')}/chat/completions", {"model": model, "messages": [{"role": "system", "content": prompt}, {"role": "user", "content": t or ""}]}, key)
                    found = json.loads(answer["choices"][0]["message"]["content"])["relations"]
                    rows += [(d, c, str(r["subject"]), "_".join(str(r["predicate"]).upper().split()), str(r["object"]), float(r.get("confidence", 0.5)), str(r.get("evidence", t))) for r in found]
                except Exception:  # noqa: BLE001, S112 - by contract any failure means that nothing was found
                    continue
            cols = list(zip(*rows)) or [[]] * 7
            types = (pa.string(),) * 5 + (pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, types)], ["document_id", "chunk_id", "subject", "predicate", "object", "confidence", "evidence"])

    return chunks.select("document_id", "chunk_id", "text").mapInArrow(run, "document_id string, chunk_id string, subject string, predicate string, object string, confidence double, evidence string")


def call_remote(requests: DataFrame, call: Callable[[dict], dict], workers: int = 8) -> DataFrame:
    """``request_id, status, output``: a Python callable applied to the JSON of each ``request_id, input``, some requests of
    a batch at a time; what fails has the status FAILED and the error as output."""

    def one(text: str | None) -> tuple[str, str]:
        try:
            return "COMPLETED", json.dumps(call(json.loads(text or "{}")))
        except Exception as e:  # noqa: BLE001 - a call's failure is its result
            return "FAILED", str(e)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(workers) as pool:
            for b in parts:
                done = list(pool.map(one, b.column("input").to_pylist()))
                yield pa.RecordBatch.from_arrays([b.column("request_id"), pa.array([s for s, _ in done], pa.string()), pa.array([o for _, o in done], pa.string())], ["request_id", "status", "output"])

    kind = dict(requests.dtypes)["request_id"]
    return requests.select("request_id", "input").mapInArrow(run, f"request_id {kind}, status string, output string")

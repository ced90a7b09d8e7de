"""Entities and relations found in texts by rules."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

TECHNOLOGY, CONCEPT = "TECHNOLOGY", "CONCEPT"
#: Name, type and pattern of known entities; concepts are found in any case.
CATALOG = (
    ("Rust", TECHNOLOGY, r"\bRust\b"),
    ("TypeScript", TECHNOLOGY, r"\b(?:TypeScript|TS)\b"),
    ("JavaScript", TECHNOLOGY, r"\b(?:JavaScript|JS)\b"),
    ("Python", TECHNOLOGY, r"\bPython\b"),
    ("Node.js", TECHNOLOGY, r"\b(?:Node\.js|NodeJS|Node)\b"),
    ("Linux", TECHNOLOGY, r"\bLinux\b"),
    ("Docker", TECHNOLOGY, r"\bDocker\b"),
    ("PostgreSQL", TECHNOLOGY, r"\b(?:PostgreSQL|Postgres)\b"),
    ("SQLite", TECHNOLOGY, r"\bSQLite\b"),
    ("Chromium", TECHNOLOGY, r"\bChromium\b"),
    ("Knowledge Graph", CONCEPT, r"(?i)\b(?:Knowledge Graph|KG)\b"),
    ("Vector Database", CONCEPT, r"(?i)\b(?:Vector Database|Vector Engine)\b"),
    ("Graph RAG", CONCEPT, r"(?i)\b(?:Graph RAG|Graph-RAG)\b"),
    ("Policy Engine", CONCEPT, r"(?i)\bPolicy Engine\b"),
    ("Audit Trail", CONCEPT, r"(?i)\b(?:Audit Trail|Audit Log)\b"),
    ("Systems Programming", CONCEPT, r"(?i)\bSystems Programming\b"),
    ("Browser Automation", CONCEPT, r"(?i)\bBrowser Automation\b"),
)
#: Words that begin sentences, not names.
STARTERS = "The This That These Those When Where What Why How If Then However Every Never All Each And Or But".split()
KNOWN, PHRASE = 0.95, 0.75
#: Verbs of a relation, its predicate and confidence.
RELATIONS = (
    (r"is used (?:for|to build)", "USED_FOR", 0.92),
    (r"depends on|relies on|requires", "DEPENDS_ON", 0.9),
    (r"is developed by|created by|built by", "CREATED_BY", 0.94),
    (r"is part of|belongs to|included in", "PART_OF", 0.88),
    (r"is located in|based in", "LOCATED_IN", 0.89),
    (r"implements|provides", "IMPLEMENTS", 0.85),
    (r"is an alternative to|competes with", "ALTERNATIVE_TO", 0.87),
)
_CATALOG = [(n, t, re.compile(p, re.ASCII)) for n, t, p in CATALOG]
_CAPITALS = re.compile(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2}\b", re.ASCII)
_STARTS = re.compile(rf"(?:{'|'.join(STARTERS)})\b", re.ASCII)
_RELATIONS = [(re.compile(rf"(.+?)\s+(?:{v})\s+(.+)", re.I), p, c) for v, p, c in RELATIONS]
_SENTENCE = re.compile(r"(?<=[.?!;])\s+")


def mentions_in(text: str | None, catalog=_CATALOG) -> list[tuple[str, str, int, int, float]]:
    """``name, type, start, end, confidence``: known entities in the catalog's order, then capitalised phrases; a span once.
    ``catalog``: names, types and compiled patterns, if not the one above."""
    out: dict[tuple[int, int], tuple[str, str, int, int, float]] = {}
    for name, kind, pattern in catalog:
        for m in pattern.finditer(text or ""):
            out.setdefault(m.span(), (name, kind, *m.span(), KNOWN))
    for m in _CAPITALS.finditer(text or ""):
        if len(m[0]) > 2 and not _STARTS.match(m[0]):
            out.setdefault(m.span(), (m[0], CONCEPT, *m.span(), PHRASE))
    return list(out.values())


def relations_in(text: str | None, entities: list[tuple[str, list[str]]]) -> list[tuple[str, str, str, float, str]]:
    """``subject, predicate, object, confidence, sentence`` between entities given as (name, aliases) in order; of
    several names on one side of the verb the last counts."""
    out = []
    if not text or len(entities) < 2:
        return out
    for sentence in _SENTENCE.split(text):
        low = sentence.lower()
        present = [n for n, aliases in entities if n.lower() in low or any(a.lower() in low for a in aliases)]
        if len(present) < 2:
            continue
        for pattern, predicate, confidence in _RELATIONS:
            m = pattern.search(sentence)
            if not m:
                continue
            left, right = m[1].lower(), m[2].lower()
            subject = next((n for n in reversed(present) if n.lower() in left), None)
            object_ = next((n for n in reversed(present) if n.lower() in right), None)
            if subject and object_ and subject != object_:
                out.append((subject, predicate, object_, confidence, sentence.strip()))
    return out


def _mentions(find: Callable[[str | None], list[tuple]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(d, c, *m) for d, c, t in zip(*(b.column(x).to_pylist() for x in ("document_id", "chunk_id", "text"))) for m in find(t)]
            cols = list(zip(*rows)) or [[]] * 7
            types = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["document_id", "chunk_id", "name", "entity_type", "start_offset", "end_offset", "confidence"])

    return run


def extract_mentions(chunks: DataFrame, find: Callable[[str | None], list[tuple]] = mentions_in) -> DataFrame:
    """Mentions of ``document_id, chunk_id, text``; offsets count code points of the chunk. ``find``: another extractor, which
    gives what :func:`mentions_in` gives of a text."""
    return chunks.select("document_id", "chunk_id", "text").mapInArrow(_mentions(find), "document_id string, chunk_id string, name string, entity_type string, start_offset int, end_offset int, confidence double")


def _relations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for d, c, t in zip(*(b.column(x).to_pylist() for x in ("document_id", "chunk_id", "text"))):
            names = list(dict.fromkeys(m[0] for m in mentions_in(t)))
            rows += [(d, c, *r) for r in relations_in(t, [(n, []) for n in names])]
        cols = list(zip(*rows)) or [[]] * 7
        types = (pa.string(),) * 5 + (pa.float64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["document_id", "chunk_id", "subject", "predicate", "object", "confidence", "sentence"])


def extract_relations(chunks: DataFrame) -> DataFrame:
    """Relations between the entities mentioned in a chunk."""
    return chunks.select("document_id", "chunk_id", "text").mapInArrow(_relations, "document_id string, chunk_id string, subject string, predicate string, object string, confidence double, sentence string")

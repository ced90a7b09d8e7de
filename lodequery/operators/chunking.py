"""Documents into chunks: greedy packing of parts at ever finer separators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK, OVERLAP = 500, 50
#: Separators, the coarsest first.
SEPARATORS = ("\n\n", "\n", ". ", " ")


def chunk_text(text: str | None, size: int = CHUNK, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most ``size`` (at least 50) characters; only a part without any separator is cut, with the overlap."""
    size = max(50, size)
    overlap = max(0, min(overlap, size // 2))
    if not text or not text.strip():
        return []
    done: list[str] = []
    todo: list[tuple[str, int]] = [(text, 0)]  # a stack: what comes first in the text is on top
    while todo:
        part, level = todo.pop()
        if len(part) <= size:
            done.append(part)
        elif level == len(separators):
            done.extend(part[i : i + size] for i in range(0, len(part), size - overlap))
        else:
            sep = separators[level]
            packed: list[tuple[str, int]] = []
            held: str | None = None
            for piece in part.split(sep):
                joined = held + sep + piece if held else piece
                if len(joined) <= size:
                    held = joined
                    continue
                if held:
                    packed.append((held, level))
                if len(piece) > size:
                    packed.append((piece, level + 1))
                    held = None
                else:
                    held = piece
            if held:
                packed.append((held, level))
            todo.extend(reversed(packed))
    return [c for c in (d.strip() for d in done) if c]


def _chunks(size: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, numbers, totals, texts = [], [], [], []
            for key, text in zip(b.column("document_id").to_pylist(), b.column("text").to_pylist()):
                parts = chunk_text(text, size, overlap)
                ids += [key] * len(parts)
                numbers += range(len(parts))
                totals += [len(parts)] * len(parts)
                texts += parts
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(numbers, pa.int32()), pa.array(totals, pa.int32()), pa.array(texts, pa.string())], ["document_id", "sequence_number", "total_chunks", "text"])

    return run


def chunk_documents(documents: DataFrame, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``chunk_id, document_id, sequence_number, total_chunks, text`` of ``document_id, text``; blank texts have no chunks."""
    out = documents.select("document_id", "text").mapInArrow(_chunks(size, overlap), "document_id string, sequence_number int, total_chunks int, text string")
    return out.withColumn("chunk_id", F.concat("document_id", F.lit("_chk_"), "sequence_number"))


def records_of_chunks(chunks: DataFrame, collection_id: str, source: str = "inline_text") -> DataFrame:
    """Chunks as records of a collection, with their place in the document as metadata."""
    meta = F.to_json(F.struct(F.lit(source).alias("source"), "document_id", "chunk_id", "sequence_number", "total_chunks", F.length("text").alias("char_count")))
    return chunks.select(F.col("chunk_id").alias("id"), F.lit(collection_id).alias("collection_id"), F.lit(None).cast("array<double>").alias("vector"), "text", F.lit(source).alias("content_ref"), meta.alias("metadata"))

"""Hash embeddings: signed unigrams and bigrams counted into slots, made a unit vector."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodequery.functions.similarity import FNV_BASIS, FNV_PRIME, fnv1a
from lodequery.functions.text import embed_tokens

DIMENSION, BIGRAM = 64, 1.5
_SPLIT = re.compile(r"""[\s,.;:!?_/\-\(\)\[\]"']+""")


def _fold_units(h: np.ndarray, units: np.ndarray) -> np.ndarray:
    return (h ^ units) * np.uint32(FNV_PRIME)


def _below(h: np.ndarray) -> np.ndarray:
    """The magnitude of the hash read as a signed number."""
    return np.where(h >= 1 << 31, (1 << 32) - h.astype(np.int64), h.astype(np.int64))


def _slots(terms: list[str], dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """The slot and the sign of each term: hashes of its UTF-16 units, and of these and "_sign", unit by unit for all terms."""
    units = np.frombuffer("".join(terms).encode("utf-16-le", "surrogatepass"), np.uint16).astype(np.uint32)
    size = np.fromiter(map(len, terms), np.int64, len(terms))
    if len(units) != size.sum():  # characters of two units
        size = np.fromiter((len(t) if t.isascii() else len(t.encode("utf-16-le", "surrogatepass")) // 2 for t in terms), np.int64, len(terms))
    start = np.cumsum(size) - size
    order = np.argsort(-size, kind="stable")
    start, left = start[order], np.searchsorted(-size[order], -np.arange(size.max(initial=0)), "left")  # terms longer than each place
    h = np.full(len(terms), FNV_BASIS, np.uint32)
    for place, n in enumerate(left.tolist()):
        h[:n] = _fold_units(h[:n], units[start[:n] + place])
    sign = h
    for c in "_sign":
        sign = _fold_units(sign, np.uint32(ord(c)))
    slots, signs = np.empty(len(terms), np.int64), np.empty(len(terms))
    slots[order], signs[order] = _below(h) % dimension, np.where(_below(sign) % 2 == 0, 1.0, -1.0)
    return slots, signs


def embed_texts(texts: list[str], dimension: int = DIMENSION) -> np.ndarray:
    """A row of unit length, or of zeros where there are no tokens, for each text."""
    terms: list[str] = []
    of, weights = [], []
    for i, text in enumerate(texts):
        tokens = [t for t in _SPLIT.split(text.lower()) if t]
        terms += tokens
        terms += map("{}_{}".format, tokens, tokens[1:])
        pairs = max(len(tokens) - 1, 0)
        of.append(len(tokens) + pairs)
        weights += [1.0] * len(tokens) + [BIGRAM] * pairs
    slots, signs = _slots(terms, dimension)
    row = np.repeat(np.arange(len(texts)), of)
    v = np.bincount(row * dimension + slots, signs * np.array(weights), len(texts) * dimension).astype(float).reshape(len(texts), dimension)
    n = np.sqrt((v * v).sum(1, keepdims=True))
    return np.divide(v, n, out=np.zeros_like(v), where=n > 0)


def _embed(text: str, dimension: int) -> np.ndarray:
    return embed_texts([text], dimension)[0]


def embed_query(text: str, dimension: int = DIMENSION) -> list[float]:
    return _embed(text, dimension).tolist()


def embed_udf(dimension: int = DIMENSION):
    """A pandas UDF from text to its hash embedding; null texts have none."""

    @F.pandas_udf("array<double>")
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            made = []
            for a in range(0, len(s), 1000):
                part = [t if isinstance(t, str) else None for t in s[a : a + 1000]]
                v = embed_texts([t or "" for t in part], dimension)
                made += [None if t is None else row for t, row in zip(part, v)]
            yield pd.Series(made)

    return embed


def with_embedding(records: DataFrame, dimension: int = DIMENSION, provider=None) -> DataFrame:
    """Records with the vectors of texts that have none; ``provider``: another UDF from text to vector."""
    return records.withColumn("vector", F.coalesce("vector", (provider or embed_udf(dimension))("text")))


def token_slots(text: Column, dimension: int = DIMENSION) -> Column:
    """``array<struct<token, slot, weight>>`` of the unigrams and bigrams of a text, in built-in functions."""

    def one(t: Column, weight: float) -> Column:
        sign = F.when(fnv1a(F.concat(t, F.lit("_sign"))) % 2 == 0, weight).otherwise(-weight)
        return F.struct(t.alias("token"), (fnv1a(t) % dimension).alias("slot"), sign.alias("weight"))

    tokens = embed_tokens(text)
    pairs = F.when(F.size(tokens) > 1, F.zip_with(F.slice(tokens, 1, F.size(tokens) - 1), F.slice(tokens, 2, F.size(tokens) - 1), lambda a, b: F.concat(a, F.lit("_"), b))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.transform(tokens, lambda t: one(t, 1.0)), F.transform(pairs, lambda t: one(t, BIGRAM)))

"""Problem 8: the reading level of each document.

Method: each word's acquisition grade is estimated from the distribution of graded texts that use it; a document's level
is predicted from calibrated quantiles of the grades of its known words.

Only the model is fitted on a bounded sample of labelled documents, on the driver; what it is applied to is every
document, in one pass without a shuffle. Grades used to calibrate a document come from other documents than itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodequery.llm.wordhash import buffers

LEVELS = 4
LEAST_WORDS = 50
#: Labelled documents that a model is fitted on at most, which also bounds its words; labelled documents a known word stands in.
MOST_LABELLED, KNOWN_IN = 20_000, 3
FOLDS = 4
QUANTILES = tuple(round(0.05 * i, 2) for i in range(1, 20))
_PRIOR = 1.0  # texts without a grade added to each word's


@dataclass
class ReadingModel:
    words: np.ndarray  # hashes in ascending order
    grades: np.ndarray
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def levels(self, features: np.ndarray) -> np.ndarray:
        return (_scaled(features, self.center, self.scale) @ self.weights).argmax(1) + 1


def consensus(labels: DataFrame) -> DataFrame:
    """``doc_id, level``: the mean of the raters' latest levels from 1 to 4, rounded half up."""
    last = Window.partitionBy("doc_id", "rater").orderBy(F.col("rated_at").desc_nulls_last(), F.col("level").desc())
    good = labels.select("doc_id", "rater", "level", "rated_at").where(f"doc_id is not null and level between 1 and {LEVELS}")
    each = good.withColumn("place", F.row_number().over(last)).where("place = 1")
    return each.groupBy("doc_id").agg(F.floor(F.avg("level") + 0.5).cast("int").alias("level"))


def _texts(batch: pa.RecordBatch) -> list[str]:
    return ["" if t is None else t for t in batch.column("text").to_pylist()]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``word, cell, n``: texts of a fold and level that have the word; cell = fold * LEVELS + level - 1."""
    for b in batches:
        cells = (b.column("fold").to_numpy().astype(np.int64) * LEVELS + b.column("level").to_numpy() - 1).astype(np.uint64)
        for first, w in buffers(_texts(b)):
            pair = np.unique(np.stack([w.text.astype(np.uint64), w.hash], 1), axis=0)
            key, n = np.unique(np.stack([pair[:, 1], cells[first + pair[:, 0].astype(np.int64)]], 1), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(key[:, 0]).view(np.int64)), pa.array(key[:, 1].astype(np.int32)), pa.array(n)], ["word", "cell", "n"])


def acquisition_grades(uses: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """The grade by which half of a word's use is reached, every level counting alike; NaN for words known from too few texts.

    ``uses``: texts of each level that have the word; ``texts``: texts of each level.
    """
    known = uses.sum(1)
    rate = uses / np.maximum(texts, 1)
    total = rate.sum(1, keepdims=True)
    share = np.where(total > 0, rate / np.maximum(total, 1e-12), 1 / LEVELS)
    share = (share * known[:, None] + _PRIOR / LEVELS) / (known[:, None] + _PRIOR)
    reached = np.cumsum(share, 1)
    at = np.minimum((reached < 0.5).sum(1), LEVELS - 1)
    rows = np.arange(len(uses))
    grade = 0.5 + at + (0.5 - (reached[rows, at] - share[rows, at])) / share[rows, at]
    return np.where(known >= KNOWN_IN, grade, np.nan)


def _features(hashes: np.ndarray, begin: np.ndarray, words: np.ndarray, grades: np.ndarray) -> np.ndarray:
    """Quantiles and mean of the known words' grades of each text; the middle grade for texts without known words."""
    out = np.full((len(begin) - 1, len(QUANTILES) + 1), (1 + LEVELS) / 2)
    if len(words):
        at = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
        g = np.where(words[at] == hashes, grades[at], np.nan)
        for i, (a, z) in enumerate(zip(begin[:-1], begin[1:])):
            x = g[a:z]
            x = np.sort(x[~np.isnan(x)])
            if len(x):
                place = np.array(QUANTILES) * (len(x) - 1)
                low = place.astype(np.int64)
                out[i, :-1] = x[low] + (x[np.minimum(low + 1, len(x) - 1)] - x[low]) * (place - low)
                out[i, -1] = x.mean()
    return out


def _scaled(f: np.ndarray, center: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.c_[(f - center) / scale, np.ones(len(f))]


def calibrate(features: np.ndarray, level: np.ndarray, rounds: int = 400, shrink: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multinomial logistic weights from quantiles to levels; a level without texts is never predicted."""
    center, scale = features.mean(0), features.std(0) + 1e-6
    z = _scaled(features, center, scale)
    target = np.eye(LEVELS)[level - 1]
    seen = target.any(0)
    weights = np.zeros((z.shape[1], LEVELS))
    first = second = np.zeros_like(weights)
    for t in range(1, rounds + 1):
        s = np.where(seen, z @ weights, -np.inf)
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        slope = z.T @ (p - target) / len(z) + shrink * weights
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        weights = weights - 0.05 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    weights[-1, ~seen] = -1e9
    return center, scale, weights


def _folded_features(words: np.ndarray, grades: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            folds = b.column("fold").to_numpy()
            rows: list[list[float]] = []
            keep: list[bool] = []
            for first, w in buffers(_texts(b)):
                for i in range(len(w.begin) - 1):
                    a, z = w.begin[i], w.begin[i + 1]
                    keep.append(bool(z - a >= LEAST_WORDS))
                    rows.append(_features(w.hash[a:z], np.array([0, z - a]), words, grades[folds[first + i]])[0].tolist())
            yield pa.RecordBatch.from_arrays([b.column("level"), pa.array(rows, pa.list_(pa.float64())), pa.array(keep, pa.bool_())], ["level", "features", "keep"])

    return run


def fit(documents: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED) -> ReadingModel | None:
    """The model of up to ``most_labelled`` labelled documents (those of the smallest hashed ids) and all words that at least KNOWN_IN of them use; None without any."""
    sample = consensus(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)
    held = documents.select("doc_id", "text").where("text is not null").join(F.broadcast(sample), "doc_id")  # most_labelled rows of 12 bytes
    held = held.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int")).select("level", "fold", "text")
    counted = held.mapInArrow(_counted, "word bigint, cell int, n bigint")
    cells = [F.sum(F.when(F.col("cell") == i, F.col("n")).otherwise(0)).alias(f"c{i}") for i in range(FOLDS * LEVELS)]
    known = counted.groupBy("word").agg(F.sum("n").alias("known"), *cells).where(F.col("known") >= KNOWN_IN)
    table = known.toArrow()  # words of at most most_labelled documents
    words = table.column("word").to_numpy().view(np.uint64)
    order = np.argsort(words)
    words = words[order]
    uses = np.stack([table.column(f"c{i}").to_numpy() for i in range(FOLDS * LEVELS)], 1)[order].reshape(-1, FOLDS, LEVELS).astype(float)
    sizes = np.zeros((FOLDS, LEVELS))
    for r in held.groupBy("fold", "level").count().collect():  # FOLDS * LEVELS rows
        sizes[r["fold"], r["level"] - 1] = r["count"]
    if not sizes.sum():
        return None
    all_uses, all_texts = uses.sum(1), sizes.sum(0)
    folded = [acquisition_grades(all_uses - uses[:, f], all_texts - sizes[f]) for f in range(FOLDS)]
    rows = held.mapInArrow(_folded_features(words, folded), "level int, features array<double>, keep boolean").where("keep").toArrow()
    if not len(rows):
        return None
    features = rows.column("features").combine_chunks().flatten().to_numpy().reshape(len(rows), -1)
    return ReadingModel(words, acquisition_grades(all_uses, all_texts), *calibrate(features, rows.column("level").to_numpy()))


def _apply(model: ReadingModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, levels, grades = [], [], []
            for first, w in buffers(_texts(b)):
                long = np.flatnonzero(np.diff(w.begin) >= LEAST_WORDS)
                f = _features(w.hash, w.begin, model.words, model.grades)[long]
                ids.append(long + first)
                levels.append(model.levels(f))
                grades.append(f[:, len(QUANTILES) // 2])
            if ids:
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(np.concatenate(ids))), pa.array(np.concatenate(levels).astype(np.int32)), pa.array(np.concatenate(grades))], ["doc_id", "level", "median_grade"])

    return run


def reading_levels(documents: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED) -> DataFrame:
    """``doc_id, level, median_grade`` of every document of at least 50 words: level 1 (beginners) to 4 (specialists) on
    the raters' scale, and the median acquisition grade of its known words.

    Edge cases: null, off-scale and repeated labels are left out, conflicting ones averaged; texts that are null or have
    fewer than 50 words have no level; a text without known words gets the level of middling grades; a level that no
    label names is never given; without any labels there are no rows; repeated rows give a row each; other columns are
    not read. Whole texts are read, however long.
    """
    doc_type = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {doc_type}, level int, median_grade double"
    model = fit(documents, labels, most_labelled)
    if model is None:
        return documents.sparkSession.createDataFrame([], schema)
    return documents.select("doc_id", "text").where("text is not null").mapInArrow(_apply(model), schema)

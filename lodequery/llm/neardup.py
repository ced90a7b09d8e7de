"""Problem 5: records whose texts nearly repeat each other.

Method: many universal hash minima of a text's word sequences, banded; texts that share a band are candidates, whose
signatures and then whose sets are compared; groups are connected components by alternating large-star and small-star
steps (:mod:`lodequery.llm.components`). A word sequence stands for itself as a 32-bit hash; two of a pair of texts with a
hundred sequences each are confused once in some 400,000 pairs, which then differs by one sequence from the true share.

Texts with equal word sets are one class and are compared once, however many there are. A band with more than
``bucket`` classes isn't expanded into pairs: its classes are compared block by block with their signatures inside
tasks, and only pairs that agree come out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodequery.llm.components import components
from lodequery.llm.wordhash import buffers, mix
from lodequery.operators.versions import current_version
from lodequery.storage import written

#: Words in a sequence, least share of common sequences, least words of a text (TESTDATA.md, problem 5).
WORDS, SIMILARITY, LEAST_WORDS = 3, 0.6, 25
#: Minima in a band and bands: of pairs with a similarity of 0.6, 0.65 and 0.7, 96.1, 99.3 and 99.95 % share a band.
ROWS, BANDS = 5, 40
#: Classes of a band that are expanded into pairs, and classes in a block of a larger band.
BUCKET, BLOCK = 256, 2048
#: Exact copies of one text that are paired with all others; of more copies each is paired with the one of smallest id.
EXPAND = 32
#: A candidate whose signatures agree in fewer minima than the similarity less this many standard errors is dropped.
SLACK = 4.0
_SEEN = 1 << 20  # keys that a task remembers to drop copies early


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(2024)
    n = ROWS * BANDS
    return rng.integers(1, 1 << 62, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 62, n, dtype=np.uint64)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """The least of each universal hash (a x + b) mod 2^64 div 2^32 over each non-empty set of 32-bit numbers."""
    a, b = _multipliers()
    out = np.empty((len(sets), len(a)), np.uint32)
    if not sets:
        return out
    x = np.concatenate(sets).astype(np.uint64)
    begin = np.cumsum([0, *map(len, sets[:-1])])
    for i in range(len(a)):
        out[:, i] = np.minimum.reduceat(((x * a[i] + b[i]) >> np.uint64(32)).astype(np.uint32), begin)
    return out


def _sets(words: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
            keys: list[int | None] = [None] * len(texts)
            sets: list[bytes | None] = [None] * len(texts)
            for first, w in buffers(texts):
                counts = np.diff(w.begin)
                h, at = w.runs(words)
                h = (h >> np.uint64(32)).astype(np.uint32)
                text = w.text[at]
                order = np.lexsort((h, text))
                h, text = h[order], text[order]
                new = np.r_[True, (h[1:] != h[:-1]) | (text[1:] != text[:-1])] if len(h) else np.zeros(0, bool)
                h, text = h[new], text[new]
                cut = np.searchsorted(text, np.arange(len(counts) + 1))
                sums = np.r_[np.uint64(0), np.cumsum(mix(h.astype(np.uint64) + np.uint64(1)))]
                key = mix((sums[cut[1:]] - sums[cut[:-1]]) ^ np.diff(cut).astype(np.uint64)).view(np.int64)
                for i in np.flatnonzero((counts >= max(least, words))):
                    k = int(key[i])
                    keys[first + i] = k
                    if k not in seen:
                        if len(seen) < _SEEN:
                            seen.add(k)
                        sets[first + i] = h[cut[i] : cut[i + 1]].tobytes()
            rest = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(keys, pa.int64()), pa.array(sets, pa.binary())], [*rest, "key", "set"])

    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``band, key`` for each band of each set; a band's hash carries its number."""
    for batch in batches:
        keys = batch.column("key").to_numpy()
        sets = [np.frombuffer(s, np.uint32) for s in batch.column("set").to_pylist()]
        for a in range(0, len(sets), 2000):
            m = minima(sets[a : a + 2000]).reshape(-1, BANDS, ROWS).astype(np.uint64)
            h = np.zeros(m.shape[:2], np.uint64)
            for r in range(ROWS):
                h = mix(h * np.uint64(31) + m[:, :, r] + np.uint64(1))
            band = (np.arange(BANDS, dtype=np.uint64)[None, :] << np.uint64(40)) | (h >> np.uint64(24))
            yield pa.RecordBatch.from_arrays([pa.array(band.view(np.int64).ravel()), pa.array(np.repeat(keys[a : a + 2000], BANDS))], ["band", "key"])


def _bucket_pairs(most: int):
    """Sorted ``band, key`` rows into ``a, b, hot``: pairs of a band's keys, or, of a band of more than ``most`` keys, its (band, key) rows with hot set."""

    def pairs(band: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of runs of equal bands, run by run of one length at a time."""
        first = np.flatnonzero(np.r_[True, band[1:] != band[:-1]])
        size = np.diff(np.r_[first, len(band)])
        xs, ys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for m in np.unique(size[size > 1]):
            x, y = np.triu_indices(m, 1)
            at = first[size == m][:, None]
            xs.append(key[at + x].ravel())
            ys.append(key[at + y].ravel())
        return np.concatenate(xs), np.concatenate(ys)

    def batch(a, b, hot: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(np.full(len(a), hot))], ["a", "b", "hot"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band, key, over = np.zeros(0, np.int64), np.zeros(0, np.int64), None  # the last run so far; the band known to be large
        for part in batches:
            nb, nk = part.column("band").to_numpy(), part.column("key").to_numpy()
            band, key = np.r_[band, nb], np.r_[key, nk]
            new = np.r_[True, (band[1:] != band[:-1]) | (key[1:] != key[:-1])] if len(band) else np.zeros(0, bool)
            band, key = band[new], key[new]
            yield from emit(band, key, over, last=False)
            if len(band):
                tail = band == band[-1]
                if over == band[-1] or tail.sum() > most:
                    over = band[-1]
                    band, key = band[-1:], key[-1:]  # the last row stays, so that its repetition is seen
                else:
                    over, band, key = None, band[tail], key[tail]
        yield from emit(band, key, over, last=True)

    def emit(band, key, over, last: bool):
        if not len(band):
            return
        carried = over is not None and band[0] == over  # its first row has been emitted
        first = np.flatnonzero(np.r_[True, band[1:] != band[:-1]])
        size = np.diff(np.r_[first, len(band)])
        large = size > most
        if carried:
            large[0] = True
        whole = np.repeat(~large, size)
        if not last:
            whole &= band != band[-1]
        hot = np.repeat(large, size)
        if carried:
            hot[0] = False
        if whole.any():
            x, y = pairs(band[whole], key[whole])
            code = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0) if len(x) else np.zeros((0, 2), np.int64)
            if len(code):
                yield batch(code[:, 0], code[:, 1], False)
        if hot.any():
            yield batch(band[hot], key[hot], True)

    return run


def _agree(similarity: float) -> float:
    n = ROWS * BANDS
    return similarity - SLACK * (similarity * (1 - similarity) / n) ** 0.5


def _block_pairs(least: float):
    """Two blocks of one band (or one twice): pairs whose signatures agree."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("key")
        key, side = t.column("key").to_numpy(), t.column("side").to_numpy()
        m = minima([np.frombuffer(s, np.uint32) for s in t.column("set").to_pylist()])
        xs, ys = [], []
        left, right = np.flatnonzero(side <= 0), np.flatnonzero(side >= 0)
        for i in left:
            others = right[(key[right] > key[i]) | (side[right] != side[i])]
            hit = others[(m[others] == m[i]).mean(1) >= least]
            xs.append(np.full(len(hit), key[i]))
            ys.append(key[hit])
        x, y = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (xs, ys))
        return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    return run


def _verify(similarity: float):
    """Signatures first, then the exact share of common members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [np.frombuffer(s, np.uint32) for s in batch.column("set_a").to_pylist()]
            y = [np.frombuffer(s, np.uint32) for s in batch.column("set_b").to_pylist()]
            ok = np.zeros(len(x), bool)
            for a in range(0, len(x), 2000):
                near = np.flatnonzero((minima(x[a : a + 2000]) == minima(y[a : a + 2000])).mean(1) >= _agree(similarity)) + a
                for i in near:
                    both = len(np.intersect1d(x[i], y[i], assume_unique=True))
                    ok[i] = both >= similarity * (len(x[i]) + len(y[i]) - both) - 1e-9
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return run


class NearDuplicates:
    """Classes of equal word sets and the links between them. ``members``: id, key, and of its exact text the number of
    copies and the first id; ``links``: a, b."""

    def __init__(self, records: DataFrame, id_col: str = "id", text_col: str = "text", order: tuple[str, ...] = ("updated_at", "seq"), words: int = WORDS, similarity: float = SIMILARITY, least_words: int = LEAST_WORDS, bucket: int = BUCKET, block: int = BLOCK):
        rows = records.select(F.col(id_col).alias("id"), *order, F.xxhash64(text_col).alias("body"), F.col(text_col).alias("text"))
        types = dict(rows.dtypes)
        schema = ", ".join(f"`{c}` {types[c]}" for c in ("id", *order, "body")) + ", key bigint, `set` binary"
        sets = written(rows.mapInArrow(_sets(words, least_words), schema), "sets")
        cur = current_version(sets.drop("set"), "id", order).where("key is not null").select("id", "key", "body")
        texts = cur.groupBy("key", "body").agg(F.count("*").alias("copies"), F.min("id").alias("first"))
        self.members = written(cur.join(texts, ["key", "body"]).select("id", "key", "copies", "first"), "members")
        some = sets.where("`set` is not null").select("key", "set")
        bands = some.mapInArrow(_bands, "band bigint, key bigint").repartition("band").sortWithinPartitions("band", "key")
        found = written(bands.mapInArrow(_bucket_pairs(bucket), "a bigint, b bigint, hot boolean"), "candidates")
        pairs = found.where("not hot").select("a", "b")
        hot = found.where("hot").select(F.col("a").alias("band"), F.col("b").alias("key"))
        if not hot.isEmpty():
            pairs = pairs.unionByName(self._large(hot, some, block, _agree(similarity)))
        pairs = written(pairs.distinct(), "pairs")
        wanted = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
        used = written(some.join(wanted, "key", "left_semi").groupBy("key").agg(F.first("set").alias("set")), "used")
        both = pairs.join(used.toDF("a", "set_a"), "a").join(used.toDF("b", "set_b"), "b").select("a", "b", "set_a", "set_b")
        self.links = written(both.mapInArrow(_verify(similarity), "a bigint, b bigint"), "links")

    @staticmethod
    def _large(hot: DataFrame, some: DataFrame, block: int, least: float) -> DataFrame:
        """Bands of many classes, cut into blocks; every two blocks of a band are one group of at most 2 * block rows."""
        sizes = hot.groupBy("band").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
        rows = hot.join(sizes, "band").withColumn("block", F.pmod(F.xxhash64("key", "band"), F.col("blocks")).cast("int"))
        one = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("x"), F.greatest(o, F.col("block")).alias("y"))))
        rows = rows.withColumn("p", one).select("band", "key", F.col("p.x").alias("x"), F.col("p.y").alias("y"), F.when(F.col("p.x") == F.col("p.y"), 0).when(F.col("block") == F.col("p.x"), -1).otherwise(1).alias("side"))
        rows = rows.join(some.groupBy("key").agg(F.first("set").alias("set")), "key")
        return rows.groupBy("band", "x", "y").applyInArrow(_block_pairs(least), "a bigint, b bigint")

    def pairs(self, expand: int = EXPAND) -> DataFrame:
        """``id_a, id_b``: near copies. Of a text with more than ``expand`` exact copies every copy is paired with the one of
        smallest id, which alone is paired with other texts; texts that differ in anything are paired in full."""
        m = self.members
        active = m.where((F.col("copies") <= expand) | (F.col("id") == F.col("first"))).select("id", "key", "copies")
        far = self.links.join(active.select(F.col("key").alias("a"), F.col("id").alias("x")), "a").join(active.select(F.col("key").alias("b"), F.col("id").alias("y")), "b")
        same = active.select("key", F.col("id").alias("x")).join(active.select("key", F.col("id").alias("y")), "key").where("x < y")
        star = m.where((F.col("copies") > expand) & (F.col("id") != F.col("first"))).select(F.col("first").alias("x"), F.col("id").alias("y"))
        both = far.select("x", "y").unionByName(same.select("x", "y")).unionByName(star)
        return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))

    def groups(self) -> DataFrame:
        """``id, class_id, group_id, n_links``: each eligible record, the first record with the same word set, the first class of its connected component, and the number of other classes near it."""
        joined = components(self.links)
        ends = self.links.select(F.col("a").alias("key")).unionByName(self.links.select(F.col("b").alias("key"))).groupBy("key").agg(F.count("*").alias("n_links"))
        classes = self.members.groupBy("key").agg(F.min("first").alias("first"))
        m = self.members.drop("first").join(classes, "key")
        heads = classes.join(joined.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
        lead = heads.groupBy("component").agg(F.min("first").alias("group_id"))
        named = heads.join(lead, "component").join(ends, "key", "left").select("key", "group_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
        return m.join(named, "key").select("id", F.col("first").alias("class_id"), "group_id", "n_links")


def near_pairs(records: DataFrame, **options) -> DataFrame:
    """``id_a, id_b`` of current versions whose texts share at least ``similarity`` of their distinct word sequences.

    Edge cases: a null text, or one of fewer than 25 words, is near nothing; repeated rows of an id count once; equal
    texts are near (see :meth:`NearDuplicates.pairs` for many copies); null ids are no records; an empty table gives no
    pairs; other columns, whatever their names, are not read. Very long texts are read whole.
    """
    return NearDuplicates(records, **options).pairs()

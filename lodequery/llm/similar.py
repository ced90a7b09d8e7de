"""Problem 1: the k most similar vectors for every vector of a collection.

Method: a hierarchical navigable small-world graph per shard in flat neighbour arrays (:mod:`lodequery.llm.hnsw`), the
results of the shards merged. Every collection, whatever its size, is cut into cells of about ``shard_rows`` vectors round
centroids fitted on a bounded sample for each cell, and a cell is a shard. A vector is indexed in the cell of the nearest
centroid and asks all cells whose centroid is less similar by at most ``margin``; with a margin of 2 it asks every cell. A
cell that came out much larger than a shard is dealt to several by a hash of the id, all of which are asked.

Of more than ``fanout`` cells a collection's centroids are a tree: up to ``fanout`` centroids fitted on the driver, below
each its own, fitted in a task. So what the driver fits is bounded, and all centroids together, which every task holds,
are a ``shard_rows``-th of the vectors.

Copies of one vector: a vector can only be among the k nearest of another if fewer than k copies of it have smaller ids.
Of a vector with more than ``hot_copies`` copies, only the k + 1 smallest ids of each hash slice are indexed; all other
copies have the k smallest ids as their nearest, by a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lodequery.llm.hnsw import Graph
from lodequery.llm.wordhash import mix
from lodequery.operators.versions import current_version
from lodequery.storage import written

K = 5
#: Vectors in a shard, beam of the last walk, how much less similar than the nearest centroid those of other asked cells are.
SHARD_ROWS, BEAM, MARGIN = 6_000, 32, 0.2
#: Vectors a centroid is fitted on; centroids below one node of the tree at most.
SAMPLE_PER_CELL, FANOUT = 50, 512
#: Copies from which a vector's copies are thinned before indexing, and the slices in which the smallest ids are found.
HOT_COPIES, SLICES = 256, 16
DECIMALS = 9


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id, collection_id, vector, copy``: valid vectors at unit length; copy is a hash of the direction."""
    for b in batches:
        col, dim = b.column("vector"), b.column("dimension").to_numpy(zero_copy_only=False)
        begin = col.offsets.to_numpy().astype(np.int64)
        size = np.where(col.is_null().to_numpy(zero_copy_only=False), 0, np.diff(begin))
        values = col.values.to_numpy(zero_copy_only=False).astype(float)  # nulls are NaN
        for d in np.unique(dim[(size == dim) & (size > 0)]):
            rows = np.flatnonzero((size == d) & (dim == d))
            v = values[begin[rows][:, None] + np.arange(int(d))]
            with np.errstate(invalid="ignore"):
                top = np.abs(v).max(1)
            ok = np.isfinite(top) & (top > 0)  # NaN and infinite elements show in the greatest
            rows, v = rows[ok], v[ok] / top[ok, None]
            v /= np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]
            bits = np.ascontiguousarray(np.round(v, 12) + 0.0).view(np.uint64)
            copy = mix((mix(bits + np.arange(1, int(d) + 1, dtype=np.uint64)) * (2 * np.arange(int(d), dtype=np.uint64) + np.uint64(1))).sum(1, dtype=np.uint64)).view(np.int64)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * int(d)), pa.array(v.ravel()))
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays([b.column("id").take(take), b.column("collection_id").take(take), flat, pa.array(copy)], ["id", "collection_id", "vector", "copy"])


def valid_vectors(records: DataFrame, collections: DataFrame) -> DataFrame:
    """``id, collection_id, vector, copy``: current versions with a valid vector."""
    dims = collections.where("collection_id is not null").groupBy("collection_id").agg(F.max("dimension").alias("dimension"))
    cur = current_version(records.select("id", "collection_id", "vector", "updated_at", "seq"), "id").join(dims, "collection_id")
    return cur.select("id", "collection_id", "vector", F.col("dimension").cast("int").alias("dimension")).mapInArrow(_units, "id string, collection_id string, vector array<double>, copy bigint")


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return a.flatten().to_numpy(zero_copy_only=False).reshape(len(a), -1) if len(a) else np.zeros((0, 1))


def _copies(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each group of equal directions, and each row's group."""
    key = np.ascontiguousarray(np.round(v, 12) + 0.0).view(np.dtype((np.void, v.dtype.itemsize * v.shape[1]))).ravel()
    _, first, group = np.unique(key, return_index=True, return_inverse=True)
    return first, group


def _nearest(v: np.ndarray, q: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Flat ``query, row, similarity`` of the k + 1 nearest rows of v for each group of v, then for each row of q; and
    v's groups. Rows are in order of id, so that of equal similarities the smaller row comes first."""
    first, group = _copies(v)
    shuffled = np.random.default_rng(11).permutation(len(first))
    back = np.empty_like(shuffled)
    back[shuffled] = np.arange(len(first))
    graph = Graph(v[first[shuffled]].astype(np.float32))
    wide = min(k + 4, len(first))
    own, _ = graph.search_nodes(wide, beam)
    own = own[back]
    asked, _ = graph.search(q.astype(np.float32), wide, 2 * beam) if len(q) else (np.zeros((0, wide), np.int32), None)
    found = np.concatenate([own, asked])
    query, c = np.nonzero(found < graph.n)
    near = shuffled[found[query, c]]
    x = np.concatenate([v[first], q]) if len(q) else v[first]
    sim = np.round(np.einsum("ij,ij->i", x[query], v[first[near]]), DECIMALS)
    # Each group found stands for its k + 1 smallest rows.
    order = np.argsort(group, kind="stable")
    size = np.bincount(group, minlength=len(first))
    begin = np.r_[0, np.cumsum(size)[:-1]]
    times = np.minimum(size[near], k + 1)
    at = np.repeat(np.arange(len(near)), times)
    row = order[begin[near[at]] + np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)]
    query, sim = query[at], sim[at]
    best = np.lexsort((row, -sim, query))
    query, row, sim = query[best], row[best], sim[best]
    new = np.r_[True, query[1:] != query[:-1]] if len(query) else np.zeros(0, bool)
    place = np.arange(len(query)) - np.maximum.accumulate(np.where(new, np.arange(len(query)), 0)) if len(query) else query
    keep = place <= k
    return query[keep], row[keep], sim[keep], group


def _lists(query: np.ndarray, row: np.ndarray, sim: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The flat results as n lists of k + 1 rows (-1: none) and similarities."""
    rows, sims = np.full((n, k + 1), -1), np.full((n, k + 1), -9.0)
    if len(query):
        new = np.r_[True, query[1:] != query[:-1]]
        place = np.arange(len(query)) - np.maximum.accumulate(np.where(new, np.arange(len(query)), 0))
        rows[query, place], sims[query, place] = row, sim
    return rows, sims


def _without(rows: np.ndarray, sims: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Lists of k out of lists of k + 1, without the row itself."""
    order = np.argsort(rows == own[:, None], axis=1, kind="stable")[:, :k]
    rows, sims = np.take_along_axis(rows, order, 1), np.take_along_axis(sims, order, 1)
    return np.where(rows == own[:, None], -1, rows), sims


_FOUND = "id string, other string, sim double, final boolean"


def shard_nearest(t: pa.Table, k: int = K, beam: int = BEAM) -> pa.Table:
    """A shard's rows (home) and the rows of other shards that ask it: ``id, other, sim``, the k nearest in this shard, and
    whether the row asks no other shard (final)."""
    t = t.sort_by("id")
    home = t.column("home").to_numpy()
    mine, guests = t.filter(pa.array(home)), t.filter(pa.array(~home))
    if not len(mine):
        return pa.table({"id": pa.array([], pa.string()), "other": pa.array([], pa.string()), "sim": pa.array([], pa.float64()), "final": pa.array([], pa.bool_())})
    v, q = _matrix(mine.column("vector")), _matrix(guests.column("vector"))
    query, row, sim, group = _nearest(v, q if len(guests) else v[:0], k, beam)
    groups = group.max(initial=-1) + 1
    rows, sims = _lists(query, row, sim, groups + len(guests), k)
    own_rows, own_sims = _without(rows[group], sims[group], np.arange(len(v)), k)
    rows, sims = np.concatenate([own_rows, rows[groups:, :k]]), np.concatenate([own_sims, sims[groups:, :k]])
    who = pa.chunked_array(mine.column("id").chunks + guests.column("id").chunks, pa.string()).combine_chunks()
    final = np.concatenate([mine.column("asks").to_numpy() == 1, np.zeros(len(guests), bool)])
    a, c = np.nonzero(rows >= 0)
    # Of a pair that both ends find, both being final, one row is enough.
    both = final[a] & (rows[a, c] < a) & final[rows[a, c]]
    twice = np.zeros(len(a), bool)
    twice[both] = (rows[rows[a[both], c[both]]] == a[both, None]).any(1)
    a, c = a[~twice], c[~twice]
    return pa.table({"id": who.take(pa.array(a)), "other": mine.column("id").combine_chunks().take(pa.array(rows[a, c])), "sim": pa.array(sims[a, c]), "final": pa.array(final[a])})


def _fit(x: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids of a sample of unit vectors; a centroid that loses its vectors moves to the worst-served one."""
    rng = np.random.default_rng(5)
    c = x[rng.permutation(len(x))[:cells]]
    for _ in range(rounds):
        s = x @ c.T
        to = s.argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, to, x)
        lost = np.setdiff1d(np.arange(len(c)), to)
        if len(lost):
            total[lost] = x[np.argsort(s.max(1))[: len(lost)]]
        c = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-12)
    return c


#: A collection's centroids: those of the first level, and for each the number of its first cell and its own centroids (itself, if it is one cell).
Tree = tuple[np.ndarray, list[tuple[int, np.ndarray]]]


def _sub_centroids(key: tuple, t: pa.Table) -> pa.Table:
    """Centroids below one of the first level, as many as its share of the collection's cells."""
    v = _matrix(t.column("vector"))
    c = _fit(v, max(1, min(len(v), round(len(v) / SAMPLE_PER_CELL))))
    return pa.table({"collection_id": pa.array([key[0].as_py()] * len(c), pa.string()), "node": pa.array([key[1].as_py()] * len(c), pa.int32()), "centroid": pa.array(c.tolist(), pa.list_(pa.float64()))})


def _trees(valid: DataFrame, sizes: dict[str, int], shard_rows: int, fanout: int) -> dict[str, Tree]:
    """Centroids of the collections that are more than one cell."""
    cells = {c: -(-n // shard_rows) for c, n in sizes.items() if n > shard_rows}
    if not cells:
        return {}
    share = lambda m, c: min(1.0, m * SAMPLE_PER_CELL / sizes[c])
    rows = valid.sampleBy("collection_id", {c: share(min(m, fanout), c) for c, m in cells.items()}, seed=3).select("collection_id", "vector").collect()  # SAMPLE_PER_CELL * fanout a collection
    by: dict[str, list] = {}
    for r in rows:
        by.setdefault(r[0], []).append(r[1])
    first = {c: _fit(np.array(v), min(cells[c], fanout, len(v))) for c, v in by.items()}
    deep = {c: m for c, m in cells.items() if m > fanout and c in first}
    below: dict[tuple[str, int], list] = {}
    if deep:
        sample = valid.sampleBy("collection_id", {c: share(m, c) for c, m in deep.items()}, seed=4).select("id", "collection_id", "vector")
        flat = {c: (f, [(i, f[i : i + 1]) for i in range(len(f))]) for c, f in first.items()}
        placed = sample.mapInArrow(_asks(flat, 0.0), _ASKS).where("home")
        for r in placed.groupBy("collection_id", F.col("cell").alias("node")).applyInArrow(_sub_centroids, "collection_id string, node int, centroid array<double>").collect():  # a shard_rows-th of the vectors
            below.setdefault((r[0], r[1]), []).append(r[2])
    trees = {}
    for c, f in first.items():
        start, leaves = 0, []
        for i in range(len(f)):
            own = np.array(below.get((c, i), f[i : i + 1].tolist()))
            leaves.append((start, own))
            start += len(own)
        trees[c] = f, leaves
    return trees


_ASKS = "id string, collection_id string, vector array<double>, cell int, home boolean, asks int"


def _near_cells(v: np.ndarray, tree: Tree, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat ``row, cell, home`` of the cells that each vector asks: nodes of the first level, then cells, within the margin."""
    first, leaves = tree
    s = v @ first.T
    row, node = np.nonzero(s >= s.max(1, keepdims=True) - margin)
    rows, cells, sims = [], [], []
    for i in np.unique(node):
        at = row[node == i]
        t = v[at] @ leaves[i][1].T
        rows.append(np.repeat(at, t.shape[1]))
        cells.append(np.tile(leaves[i][0] + np.arange(t.shape[1]), len(at)))
        sims.append(t.ravel())
    r, c, s = np.concatenate(rows), np.concatenate(cells), np.concatenate(sims)
    order = np.lexsort((c, -s, r))
    r, c, s = r[order], c[order], s[order]
    home = np.r_[True, r[1:] != r[:-1]]
    keep = home | (s >= s[np.flatnonzero(home)][np.cumsum(home) - 1] - margin)
    return r[keep], c[keep], home[keep]


def _asks(trees: dict[str, Tree], margin: float):
    """Adds ``cell, home, asks``: a row for each cell that a vector asks, home being the one it is indexed in; their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.column("collection_id").to_numpy(zero_copy_only=False)
            at, cell, home = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
            for name in set(names):
                rows = np.flatnonzero(names == name)
                if name in trees:
                    r, c, h = _near_cells(_matrix(b.column("vector").take(pa.array(rows))), trees[name], margin)
                else:  # one cell
                    r, c, h = np.arange(len(rows)), np.zeros(len(rows), np.int64), np.ones(len(rows), bool)
                at.append(rows[r])
                cell.append(c)
                home.append(h)
            at, cell, home = np.concatenate(at), np.concatenate(cell), np.concatenate(home)
            asks = np.bincount(at, minlength=len(names))[at]
            out = b.select(["id", "collection_id", "vector"]).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(cell.astype(np.int32)), pa.array(home), pa.array(asks.astype(np.int32))], ["id", "collection_id", "vector", "cell", "home", "asks"])

    return run


def similar_pairs(records: DataFrame, collections: DataFrame, k: int = K, beam: int = BEAM, shard_rows: int = SHARD_ROWS, margin: float = MARGIN, hot_copies: int = HOT_COPIES, fanout: int = FANOUT) -> DataFrame:
    """``id_a, id_b``: records of one collection of which at least one is among the k most similar of the other.

    Similarity is the cosine rounded to 9 decimals, ties going to the smaller id, id_a < id_b, each pair once.
    A few of the true pairs may be missed (the search is approximate); of those found, similarities are exact.

    Edge cases: a record whose current version has a vector that is null, of another length than its collection's
    dimension, all zero, or with a null, NaN or infinite element has no neighbours and is nobody's; so has one without
    a collection; a collection with one valid vector gives no pair; repeated rows of an id count once; an empty table
    gives no pairs; other columns, whatever their names, are not read.
    """
    valid = written(valid_vectors(records, collections), "vectors")
    sizes = {r[0]: r[1] for r in valid.groupBy("collection_id").count().collect()}  # a row per collection
    copies = valid.groupBy("collection_id", "copy").count().where(F.col("count") > hot_copies).drop("count")
    hot = written(copies, "hot")
    rest = None
    if not hot.isEmpty():
        marked = valid.join(hot.withColumn("hot", F.lit(True)), ["collection_id", "copy"], "left").withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(SLICES)))
        cool = marked.where("hot is null").select("id", "collection_id", "vector", "copy")
        warm = marked.where("hot").withColumn("place", F.row_number().over(Window.partitionBy("collection_id", "copy", "slice").orderBy("id")))
        warm = written(warm.select("id", "collection_id", "vector", "copy", "place"), "copies")
        few = warm.where(F.col("place") <= k + 1).drop("place")
        firsts = few.groupBy("collection_id", "copy").agg(F.slice(F.array_sort(F.collect_list("id")), 1, k).alias("firsts"))  # at most SLICES * (k + 1) ids
        rest = warm.where(F.col("place") > k + 1).join(firsts, ["collection_id", "copy"]).select(F.explode("firsts").alias("id_a"), F.col("id").alias("id_b"))
        valid = cool.unionByName(few)
    trees = _trees(valid, sizes, shard_rows, fanout)
    asks = valid.select("id", "collection_id", "vector").mapInArrow(_asks(trees, margin), _ASKS)
    if trees:  # cells that came out large; asking again is cheaper than to keep a copy of the vectors for each cell asked
        large = asks.where("home").groupBy("collection_id", "cell").count().where(F.col("count") > 2 * shard_rows)
        parts = written(large.select("collection_id", "cell", F.ceil(F.col("count") / shard_rows).cast("int").alias("parts")), "parts")
        asks = asks.join(parts, ["collection_id", "cell"], "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        asks = asks.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("home", F.col("home") & (F.col("part") == F.col("own"))).withColumn("asks", F.when(F.col("parts") > 1, 2).otherwise(F.col("asks")))
    else:
        asks = asks.withColumn("part", F.lit(0))
    near = written(asks.select("collection_id", "cell", "part", "id", "vector", "home", "asks").groupBy("collection_id", "cell", "part").applyInArrow(lambda t: shard_nearest(t, k, beam), _FOUND), "near")
    merged = near.where("not final").withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(F.col("sim").desc(), "other"))).where(F.col("place") <= k)
    both = near.where("final").select("id", "other").unionByName(merged.select("id", "other"))
    pairs = both.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
    return pairs.unionByName(rest) if rest is not None else pairs

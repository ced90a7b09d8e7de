"""Problem 7: passages of evaluation items that stand in documents.

Method: a prefix-filtered set join. Every run of ``run`` words of an item is a set of shingles of ``shingle`` words, all
of which a document must have, so one necessary prefix token is enough: the rarest of them in the whole corpus. Prefix
tokens are joined with the documents' shingles; a document too short for the run, or a position at which the run can't
lie inside the document, is passed over; the rest is verified word by word over the window round the token.

The corpus is read twice, whatever the number of items, and its texts are never shuffled: once to count the items' shingles
in all documents, once for the places of prefix tokens. A task finds both by a bit map of fixed size, which lets a few
others through; the joins that follow are exact. Equal windows of items are one row of the join, and the places of a
token that occurs often are dealt to slices. Words are compared as 64-bit hashes.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodequery.llm.wordhash import Words, buffers
from lodequery.storage import written

RUN, SHINGLE = 10, 5
#: Bits of the map that tells the items' shingles (8 MB); places of a token in one slice of the join.
MAP_BITS, SLICE = 26, 50_000

#: Characters that show nothing, besides those of category Cf.
INVISIBLE = "\u034f\u115f\u1160\u17b4\u17b5\u180b-\u180f\u2065\u3164\ufe00-\ufe0f\uffa0\U000e0100-\U000e01ef"
#: Format characters (category Cf) of the planes in use.
FORMAT = "\u00ad\u0600-\u0605\u061c\u06dd\u070f\u0890\u0891\u08e2\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufeff\ufff9-\ufffb\U000e0001\U000e0020-\U000e007f"
_UNSEEN = re.compile(f"[{INVISIBLE}{FORMAT}]")


def plain(text: str) -> str:
    """Without invisible characters, in NFKC; case is left to the comparison."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFKC", _UNSEEN.sub("", unicodedata.normalize("NFKC", text)).lower())


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, texts = b.column("item").to_pylist(), [plain(t or "") for t in b.column("text").to_pylist()]
        words: list[bytes] = []
        for _, w in buffers(texts):
            words += [w.hash[a:z].tobytes() for a, z in zip(w.begin[:-1], w.begin[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field("item").type), pa.array(words, pa.binary()), pa.array([len(x) // 8 for x in words], pa.int64())], ["item", "words", "n"])


def _shingles(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [np.frombuffer(x, np.uint64) for x in b.column("words").to_pylist()]
            w = Words.of_hashes(lists)
            h, at = w.runs(k)
            yield pa.RecordBatch.from_arrays([b.column("uid").take(pa.array(w.text[at])), pa.array((at - w.begin[w.text[at]]).astype(np.int32)), pa.array(h.view(np.int64))], ["uid", "at", "shingle"])

    return run


def _place(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = h >> np.uint64(64 - MAP_BITS)
    return (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)


def _in_map(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    byte, bit = _place(h)
    return (bits[byte] & bit) != 0


def _part_map(column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << MAP_BITS - 3, np.uint8)
        for b in batches:
            byte, bit = _place(b.column(column).to_numpy().view(np.uint64))
            np.bitwise_or.at(bits, byte, bit)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % 8], pa.int32()), pa.array([zlib.compress(bits.tobytes(), 1)])], ["part", "bits"])

    return run


def _joined_maps(parts: list[bytes]) -> np.ndarray:
    out = np.zeros(1 << MAP_BITS - 3, np.uint8)
    for x in parts:
        out |= np.frombuffer(zlib.decompress(x), np.uint8)
    return out


def _map_of(rows: DataFrame, column: str):
    """The bit map of a column of hashes, on all executors: at most 64 maps are made, 8 of them brought together in a task,
    and 8 come to the driver."""
    one = lambda t: pa.table({"bits": pa.array([zlib.compress(_joined_maps(t.column("bits").to_pylist()).tobytes(), 1)])})
    parts = rows.select(column).coalesce(64).mapInArrow(_part_map(column), "part int, bits binary").groupBy("part").applyInArrow(one, "bits binary").collect()
    return rows.sparkSession.sparkContext.broadcast(zlib.compress(_joined_maps([r[0] for r in parts]).tobytes(), 1))


def _unpacked(packed) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed.value), np.uint8)


def _prefix(run: int, k: int):
    """Of each run of an item, the rarest shingle; ties go to the smaller hash, so runs that overlap tend to share one. A run
    with a shingle that no document has is in none."""
    n, spare = run - k + 1, run - k

    def pick(words: pa.Table, counted: pa.Table) -> pa.Table:
        none = pa.table({"token": pa.array([], pa.int64()), "window": pa.array([], pa.binary()), "uid": pa.array([], pa.int64())})
        if not len(words) or not len(counted):
            return none
        w = np.frombuffer(words.column("words")[0].as_py(), np.uint64)
        counted = counted.sort_by("at")
        h, count = counted.column("shingle").to_numpy().view(np.uint64), counted.column("n").to_numpy()
        rank = np.empty(len(h), np.int64)
        rank[np.lexsort((h, count))] = np.arange(len(h))
        starts = np.arange(len(h) - n + 1)
        r = np.stack([rank[starts + i] for i in range(n)], 1)
        seen = np.stack([count[starts + i] for i in range(n)], 1).min(1) > 0
        at = np.unique((starts + r.argmin(1))[seen])
        if not len(at):
            return none
        zero, end = np.zeros(len(at), np.int64), np.full(len(at), len(w))
        windows = _around(w, zero, end, at, spare, 2 * spare + k, 1)
        return pa.table({"token": pa.array(h[at].view(np.int64)), "window": pa.array([x.tobytes() for x in windows], pa.binary()), "uid": pa.array(np.full(len(at), words.column("uid")[0].as_py()))})

    return pick


def _around(words: np.ndarray, begin: np.ndarray, end: np.ndarray, at: np.ndarray, before: int, length: int, nothing: int) -> np.ndarray:
    """The words from ``before`` words ahead of each position on; places outside the text hold ``nothing``."""
    ix = at[:, None] - before + np.arange(length)
    out = (ix < begin[:, None]) | (ix >= end[:, None])
    return np.where(out, np.uint64(nothing), words[np.clip(ix, 0, max(len(words) - 1, 0))])


def _count(packed, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = _unpacked(packed)
        for b in batches:
            for _, w in buffers([plain(t) for t in b.column("text").to_pylist() if t]):
                h, _ = w.runs(k)
                h, n = np.unique(h[_in_map(bits, h)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["shingle", "n"])

    return run


def _places(packed, run: int, k: int):
    """Documents' shingles that may be prefix tokens, each with the words round it."""
    spare = run - k  # words that a run may have before or after its token

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = _unpacked(packed)
        for b in batches:
            kind = b.column("doc")
            for first, w in buffers([plain(t or "") for t in b.column("text").to_pylist()]):
                h, at = w.runs(k)
                hit = np.flatnonzero(_in_map(bits, h))
                text = w.text[at[hit]]
                a, z = w.begin[text], w.begin[text + 1]
                long = z - a >= run  # length bound
                # Positional bound: the words on either side must be enough for the run.
                long &= np.minimum(at[hit] - a, spare) + np.minimum(z - at[hit], spare + k) >= run
                hit, text, a, z = hit[long], text[long], a[long], z[long]
                if len(hit):
                    windows = _around(w.hash, a, z, at[hit], spare, 2 * spare + k, 2)
                    yield pa.RecordBatch.from_arrays([kind.take(pa.array(text + first)), pa.array(h[hit].view(np.int64)), pa.array([x.tobytes() for x in windows], pa.binary())], ["doc", "token", "ours"])

    return find


def _verified(run: int, k: int):
    spare, length = run - k, 2 * (run - k) + k

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint64).reshape(-1, length) for c in ("ours", "window"))
            same = x == y
            before = np.cumprod(same[:, :spare][:, ::-1], axis=1).sum(1)
            after = np.cumprod(same[:, spare + k :], axis=1).sum(1)
            good = same[:, spare : spare + k].all(1) & (before + k + after >= run)
            yield b.select(["doc", "wid"]).filter(pa.array(good))

    return check


def leaks(documents: DataFrame, items: DataFrame, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", run: int = RUN, shingle: int = SHINGLE, slice_rows: int = SLICE) -> DataFrame:
    """``<doc_col>, <item_col>``: documents with at least ``run`` consecutive words of an item, each pair once.

    Case, punctuation, layout, invisible characters and compatibility forms make no difference.

    Edge cases: null and empty texts, and texts or items of fewer than ``run`` words, match nothing; repeated rows give
    a pair once; rows whose id is null are left out; empty tables give no pairs; other columns are not read. Documents
    of any length are read whole.
    """
    docs = documents.where(F.col(doc_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(doc_col).alias("doc"), F.col(text_col).alias("text"))
    held = items.where(F.col(item_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(item_col).alias("item"), F.col(text_col).alias("text"))
    doc_type, item_type = docs.schema["doc"].dataType.simpleString(), held.schema["item"].dataType.simpleString()
    words = held.mapInArrow(_item_words, f"item {item_type}, words binary, n bigint").where(F.col("n") >= run)
    words = written(words.withColumn("uid", F.monotonically_increasing_id()), "items")
    each = words.select("uid", "words").mapInArrow(_shingles(shingle), "uid bigint, at int, shingle bigint")
    counts = docs.select("text").mapInArrow(_count(_map_of(each, "shingle"), shingle), "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))
    counts = written(counts, "counts")
    counted = each.join(counts, "shingle", "left").select("uid", "at", "shingle", F.coalesce("n", F.lit(0)).alias("n"))
    prefix = words.select("uid", "words").groupBy("uid").cogroup(counted.groupBy("uid")).applyInArrow(_prefix(run, shingle), "token bigint, window binary, uid bigint")
    prefix = written(prefix.withColumn("wid", F.xxhash64("token", "window")), "prefix")
    # Equal windows are joined once; a token of many places has several slices.
    many = counts.where(F.col("n") > slice_rows).select(F.col("shingle").alias("token"), F.ceil(F.col("n") / slice_rows).cast("int").alias("slices"))
    many = written(many.join(prefix, "token", "left_semi"), "hot")
    windows = prefix.select("token", "wid", "window").distinct().join(many, "token", "left").withColumn("slice", F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1))).drop("slices")
    places = docs.mapInArrow(_places(_map_of(prefix, "token"), run, shingle), f"doc {doc_type}, token bigint, ours binary")
    places = places.join(many, "token", "left").withColumn("slice", F.pmod(F.xxhash64("doc", "ours"), F.coalesce("slices", F.lit(1))).cast("int")).drop("slices")
    found = places.join(windows, ["token", "slice"]).select("doc", "wid", "ours", "window").mapInArrow(_verified(run, shingle), f"doc {doc_type}, wid bigint").distinct()
    pairs = found.join(prefix.select("wid", "uid").distinct(), "wid").join(words.select("uid", "item"), "uid")
    return pairs.select("doc", "item").distinct().toDF(doc_col, item_col)

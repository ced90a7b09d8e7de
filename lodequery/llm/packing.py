"""Problem 6: documents packed into contexts of fixed capacity, measured in tokens of a public tokenizer.

Method: bin completion by branch and bound. The largest document left opens a context; all undominated fillings of the
rest of it are enumerated one by one, the least waste first (bit sets of the sums that the sizes left can reach keep the
enumeration off dead ends); a branch is cut when the waste so far passes what the best solution wastes. Best-fit solutions
are the first incumbents.

Documents are dealt to blocks by a hash of their id, and each block is packed by itself, so the work follows the input
and a block holds a bounded number of documents, whatever their source. One context of each block may be left part full;
with thousands of documents in a block that is the whole loss.
"""

from __future__ import annotations

import base64
import functools
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodequery.storage import written

CAPACITY = 2048
#: Pieces in a block; branches that the search may open in a block besides a dive's before the best solution so far stands (None: all).
BLOCK, BRANCHES = 20_000, 2_000
_PARTITIONS = 10_000  # tasks that blocks are spread over at most
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: how the public byte-level vocabularies cut a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.lru_cache(4)
def _tokenizer(ranks: bytes):
    import tiktoken

    known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=known, special_tokens={})


def tokenizer(vocabulary: str = VOCABULARY):
    with open(vocabulary, "rb") as f:
        return _tokenizer(f.read())


#: A text is encoded in parts of about so many characters, cut before a space that follows a letter and is followed by one, where the vocabulary's pattern always cuts.
_PART = 20_000


def _count(encode, text: str) -> int:
    total, a = 0, 0
    while len(text) - a > _PART:
        z = a + _PART
        while (z := text.find(" ", z)) > 0 and not (text[z - 1].isalpha() and text[z + 1 : z + 2].isalpha()):
            z += 1
        if z < 0:
            break
        total += len(encode(text[a:z]))
        a = z
    return total + len(encode(text[a:]))


def count_tokens(text: str, vocabulary: str = VOCABULARY) -> int:
    return _count(tokenizer(vocabulary).encode_ordinary, text)


def _sizes(ranks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _tokenizer(ranks.value).encode_ordinary
        for b in batches:
            tokens = [_count(encode, t) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("item"), pa.array(tokens, pa.int64())], ["item", "tokens"])

    return run


class _Left:
    """Sizes not yet packed: how many of each, and the sizes there are in ascending order."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        self.count = np.bincount(sizes, minlength=capacity + 1).tolist()
        self.sorted = [s for s, c in enumerate(self.count) if c]

    def take(self, s: int) -> None:
        self.count[s] -= 1
        if not self.count[s]:
            del self.sorted[bisect_left(self.sorted, s)]

    def give(self, s: int) -> None:
        if not self.count[s]:
            self.sorted.insert(bisect_left(self.sorted, s), s)
        self.count[s] += 1


def _sums(sizes: list[int], count: list[int], room: int) -> list[int]:
    """Bit x of entry i: whether some of the first i sizes add up to x."""
    mask = (1 << room + 1) - 1
    reached = [1]
    r = 1
    for s in sizes:
        n, step = min(count[s], room // s), 1
        while n:
            step = min(step, n)
            r |= r << s * step & mask
            n -= step
            step *= 2
        reached.append(r)
    return reached


def _adding_up(sizes: list[int], count: list[int], reached: list[int], need: int, top: int) -> Iterator[tuple[int, ...]]:
    """All multisets of the first ``top`` sizes that add up to ``need``, the largest sizes first; no dead end is entered."""
    if not need:
        yield ()
        return
    for i in range(bisect_right(sizes, need, 0, top) - 1, -1, -1):
        if not reached[i + 1] >> need & 1:
            return
        s = sizes[i]
        for n in range(min(count[s], need // s), 0, -1):
            if reached[i] >> need - n * s & 1:
                for rest in _adding_up(sizes, count, reached, need - n * s, i):
                    yield (s,) * n + rest


def _dominated(filling: tuple[int, ...], waste: int, sizes: list[int], count: list[int]) -> bool:
    """Whether a member, or two of them, could give way to one size that is left, is not smaller than they are and fits.

    Two members may give way to a size equal to their sum: whatever takes that size later can take the two instead."""
    spare = lambda s: count[s] > filling.count(s)
    members = sorted(set(filling))
    if waste:
        for s in (0, *members):
            for i in range(bisect_right(sizes, s), bisect_right(sizes, s + waste)):
                if spare(sizes[i]):
                    return True
    for i, s in enumerate(members):
        for t in members[i:]:
            if s == t and filling.count(s) < 2:
                continue
            for k in range(bisect_left(sizes, s + t), bisect_right(sizes, s + t + waste)):
                if spare(sizes[k]):
                    return True
    return False


def fillings(left: _Left, room: int) -> Iterator[tuple[int, ...]]:
    """All undominated sets of sizes for ``room``, the least waste first, of equal waste the largest sizes first."""
    sizes = left.sorted[: bisect_right(left.sorted, room)]
    reached = _sums(sizes, left.count, room)
    for waste in range(room + 1):
        if reached[-1] >> room - waste & 1:
            for filling in _adding_up(sizes, left.count, reached, room - waste, len(sizes)):
                if not _dominated(filling, waste, sizes, left.count):
                    yield filling


def _best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each size into the fullest context that takes it."""
    rooms: list[int] = []  # sorted free rooms
    owner: dict[int, list[int]] = {}
    bins: list[list[int]] = []
    for s in np.sort(sizes)[::-1].tolist():
        at = bisect_left(rooms, s)
        if at == len(rooms):
            bins.append([s])
            b, room = len(bins) - 1, capacity
        else:
            room = rooms.pop(at)
            b = owner[room].pop()
            bins[b].append(s)
        room -= s
        if room:
            rooms.insert(bisect_left(rooms, room), room)
            owner.setdefault(room, []).append(b)
    return bins


def least_contexts(sizes: np.ndarray, capacity: int) -> int:
    """A lower bound: by volume, and by the sizes that can't share a context with each other."""
    if not len(sizes):
        return 0
    s = np.sort(sizes)
    total = np.r_[0, np.cumsum(s)]
    small = np.unique(np.r_[1, s[s <= capacity // 2]])
    at, half, large = np.searchsorted(s, small), np.searchsorted(s, capacity // 2, "right"), np.searchsorted(s, capacity - small, "right")
    # Sizes above capacity - small are alone; those above half a context have one each, whose room the sizes from small to half fill first.
    free = (large - half) * capacity - (total[large] - total[half])
    rest = np.maximum(0, total[half] - total[at] - free)
    return int(max(-(-int(total[-1]) // capacity), (len(s) - half + -(-rest // capacity)).max()))


def pack(sizes: np.ndarray, capacity: int, branches: int | None = BRANCHES) -> list[list[int]]:
    """Contexts as lists of sizes, each size once, none above ``capacity``.

    The search stops at a solution that meets the lower bound, or after ``branches`` branches (None: only when no branch
    is left, so that the solution is a least one). Of solutions that need as many contexts as best fit, the search's is kept.
    """
    sizes = np.asarray(sizes, np.int64)
    best = _best_fit(sizes, capacity)
    bound = least_contexts(sizes, capacity)
    left = _Left(sizes, capacity)
    total = int(sizes.sum())
    may_waste = len(best) * capacity - total  # a branch that wastes more is no better than the incumbent
    bins: list[list[int]] = []
    options: list[Iterator[tuple[int, ...]]] = []
    wasted = spent = 0

    def open_next() -> None:
        big = left.sorted[-1]
        left.take(big)
        bins.append([big])
        options.append(fillings(left, capacity - big))

    if left.sorted:
        open_next()
    while bins and (branches is None or spent < branches + len(best)):
        current = bins[-1]
        filling = next(options[-1], None)
        if filling is not None:
            spent += 1
            waste = capacity - current[0] - sum(filling)
            if wasted + waste > may_waste:
                filling = None  # the fillings to come waste no less
        if filling is None:  # back to the context before, whose filling is undone
            left.give(current[0])
            bins.pop()
            options.pop()
            if bins:
                wasted -= capacity - sum(bins[-1])
                for s in bins[-1][1:]:
                    left.give(s)
                del bins[-1][1:]
            continue
        for s in filling:
            left.take(s)
        current.extend(filling)
        wasted += waste
        if left.sorted:
            open_next()
            continue
        best = [list(b) for b in bins]
        may_waste = (len(best) - 1) * capacity - total
        if len(best) <= bound:
            break
        wasted -= waste
        for s in filling:
            left.give(s)
        del current[1:]
    return best


def _pack_block(t: pa.Table, capacity: int, branches: int | None) -> tuple[np.ndarray, pa.Table, dict]:
    """The context of each row of a block, the rows in order, and what the search did."""
    t = t.sort_by([("tokens", "descending"), ("item", "ascending"), ("piece", "ascending")])
    sizes = t.column("tokens").to_numpy()
    small = np.flatnonzero(sizes < capacity)
    of: dict[int, list[int]] = {}
    for i in small[::-1].tolist():
        of.setdefault(int(sizes[i]), []).append(i)
    context = np.empty(len(sizes), np.int64)
    full = np.flatnonzero(sizes >= capacity)
    context[full] = np.arange(len(full))
    bins = pack(sizes[small], capacity, branches)
    for b, members in enumerate(bins, len(full)):
        for s in members:
            context[of[s].pop()] = b
    did = {"pieces": len(sizes), "contexts": len(full) + len(bins), "best_fit": len(full) + len(_best_fit(sizes[small], capacity)), "least": len(full) + least_contexts(sizes[small], capacity)}
    return context, t, did


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each block as one table, from rows sorted by block."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        block = b.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
        for a, z in zip(cuts[:-1], cuts[1:]):
            if held and a < z and held[-1].column("block")[0].as_py() != block[a]:
                yield pa.Table.from_batches(held)
                held = []
            if a < z:
                held.append(b.slice(a, z - a))
    if held:
        yield pa.Table.from_batches(held)


def _pack_blocks(capacity: int, branches: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches):
            context, t, _ = _pack_block(rows, capacity, branches)
            block = rows.column("block")[0].as_py()
            out = pa.table({"context_id": pa.array([f"{block}-{c}" for c in context.tolist()], pa.string()), **{c: t.column(c) for c in ("item", "piece", "start_token", "tokens")}})
            yield from out.to_batches()

    return run


def _search_blocks(capacity: int, branches: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches):
            did = _pack_block(rows, capacity, branches)[2]
            yield pa.RecordBatch.from_arrays([rows.column("block").chunk(0)[:1], *(pa.array([n], pa.int64()) for n in did.values())], ["block", *did])

    return run


def dealt(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY, block: int = BLOCK) -> DataFrame:
    """``block, item, piece, start_token, tokens``: pieces of up to ``capacity`` tokens, each block in one partition.

    The vocabulary is read on the driver and sent to the executors (a public one has about a megabyte)."""
    spark = documents.sparkSession
    with open(vocabulary, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    items = documents.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("item"), F.col(text_col).alias("text"))
    kind = items.schema["item"].dataType.simpleString()
    sizes = items.mapInArrow(_sizes(ranks), f"item {kind}, tokens bigint").where("tokens > 0")
    sizes = written(sizes.withColumn("copy", F.monotonically_increasing_id()), "sizes")
    parts = F.explode(F.sequence(F.lit(0), F.ceil(F.col("tokens") / capacity).cast("int") - 1))
    cut = sizes.withColumn("piece", parts).withColumn("start_token", F.col("piece").cast("bigint") * capacity)
    cut = cut.withColumn("tokens", F.least(F.lit(capacity).cast("bigint"), F.col("tokens") - F.col("start_token")))
    blocks = max(1, -(-cut.count() // block))
    # The pieces of one document are dealt apart; a row that is repeated many times is, too, by its place in its file.
    # Blocks cost time, not bytes, so they are spread over partitions by number, not merged by size.
    spread = min(blocks, _PARTITIONS)
    named = cut.select(F.pmod(F.xxhash64("item", "piece", "copy"), F.lit(blocks)).cast("int").alias("block"), "item", "piece", "start_token", "tokens")
    return named.repartitionById(spread, F.pmod("block", F.lit(spread))).sortWithinPartitions("block")


def packed(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY, block: int = BLOCK, branches: int | None = BRANCHES) -> DataFrame:
    """``context_id, <id_col>, piece, start_token, tokens``: every document's place; a document longer than a context is
    cut into pieces of ``capacity`` tokens and a last, shorter one.

    Edge cases: null, empty and blank texts have their number of tokens, and those of none take no place; rows without
    an id are left out; a repeated row is packed as often as it occurs; equal sizes are told apart by id; an empty table
    gives no contexts; other columns are not read. Texts of any length are counted whole.
    """
    rows = dealt(documents, id_col, text_col, capacity, vocabulary, block)
    kind = rows.schema["item"].dataType.simpleString()
    return rows.mapInArrow(_pack_blocks(capacity, branches), f"context_id string, item {kind}, piece int, start_token bigint, tokens bigint").withColumnRenamed("item", id_col)


def packing_search(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY, block: int = BLOCK, branches: int | None = BRANCHES) -> DataFrame:
    """``block, pieces, contexts, best_fit, least``: for each block the contexts of the search, those of best fit, and a lower bound."""
    rows = dealt(documents, id_col, text_col, capacity, vocabulary, block)
    return rows.mapInArrow(_search_blocks(capacity, branches), "block int, pieces bigint, contexts bigint, best_fit bigint, least bigint")


def packing_report(contexts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: contexts, tokens, contexts that the volume needs at least, and the share of unused space."""
    each = contexts.groupBy("context_id").agg(F.sum("tokens").alias("t"))
    total = each.agg(F.count("*").alias("contexts"), F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"), F.max("t").alias("fullest"))
    return total.withColumn("least_contexts", F.ceil(F.col("tokens") / capacity)).withColumn("unused", F.round(F.when(F.col("contexts") > 0, 1 - F.col("tokens") / (F.col("contexts") * capacity)), 6))

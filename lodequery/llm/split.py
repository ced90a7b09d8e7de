"""Problem 4: pieces of oversized contents, cut at natural boundaries, with an overlap.

Method: balanced targets. The least number of pieces is computed, targets of equal length are placed, each is snapped to
the strongest boundary near it, and when a piece would pass the limit the number of pieces is raised by one and all is
placed anew. Only where a stretch without white space is longer than the limit, a piece is cut inside it; the texts before
and after it are balanced all the same.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodequery.operators.versions import current_version

#: Characters (code points) in a piece at most, and shared by two pieces that follow each other.
LIMIT, OVERLAP = 500, 50
#: Further pieces tried before the fewest pieces are sought by dynamic programming, as a share of the least number.
MORE = 1.0
WHITE = " \t\r\n"

#: What ends before a cut, the strongest first: a blank line, a line, a sentence, a clause, a word.
BOUNDARIES = (
    ("paragraph", re.compile(r"\n[ \t\r]*\n\s*|\r[ \t]*\r\s*")),
    ("line", re.compile(r"[\r\n][ \t\r\n]*")),
    ("sentence", re.compile(r"[.!?…。][\"')\]”’]*[ \t\r\n]+")),
    ("clause", re.compile(r"[,;:)–—][ \t\r\n]+")),
    ("word", re.compile(r"[ \t\r\n]+")),
)
_RUN = re.compile(r"[^ \t\r\n]+")
NATURAL, FORCED = "natural", "forced"


class _Boundaries:
    """Where each kind of boundary of a text ends, the strongest kind first."""

    def __init__(self, text: str):
        self.text = text
        self.ends = [(name, [m.end() for m in pattern.finditer(text)]) for name, pattern in BOUNDARIES]

    def snap(self, low: int, target: int, high: int) -> tuple[int, str] | None:
        """The cut in low..high after the strongest boundary near the target: each weaker kind must lie nearer."""
        width = max(target - low, high - target, 1)
        for rank, (name, ends) in enumerate(self.ends):
            reach = max(width * (5 - rank) // 5, 1) if rank < 4 else width
            a, z = bisect_left(ends, max(low, target - reach)), bisect_right(ends, min(high, target + reach))
            if a < z:
                at = bisect_left(ends, target, a, z)
                near = [e for e in ends[max(a, at - 1) : min(z, at + 1)]]
                return min(near, key=lambda e: (abs(e - target), e)), name
        return None

    def fewest(self, begin: int, end: int, limit: int, overlap: int) -> list[tuple[int, int, str]] | None:
        """The fewest pieces that end in or beside white space, of equal numbers those of the least sum of squared lengths."""
        spaces = (range(m.start(), m.end(), max(overlap // 2, 1)) for m in BOUNDARIES[-1][1].finditer(self.text, begin, end))
        words = self.ends[-1][1]
        cuts = sorted({c for r in spaces for c in r if c > begin} | {*words[bisect_right(words, begin) : bisect_left(words, end)], end})
        best: list[tuple[int, int, int] | None] = []  # pieces, squares, the cut before
        for i, c in enumerate(cuts):
            found = (1, (c - begin) ** 2, -1) if c - begin <= limit else None
            for j in range(bisect_left(cuts, c - limit + overlap, 0, i), i):
                if best[j] is not None and cuts[j] - overlap > begin:
                    new = (best[j][0] + 1, best[j][1] + (c - cuts[j] + overlap) ** 2, j)
                    if found is None or new < found:
                        found = new
            best.append(found)
        if best[-1] is None:
            return None
        chain, at = [], len(cuts) - 1
        while at >= 0:
            chain.append(at)
            at = best[at][2]
        ends = [cuts[i] for i in reversed(chain)]
        kind = lambda e: next((name for name, known in self.ends if (k := bisect_left(known, e)) < len(known) and known[k] == e), "word")
        starts = [begin, *(e - overlap for e in ends[:-1])]
        return [(a, z, "end" if z == end else kind(z)) for a, z in zip(starts, ends)]


def _place(found: _Boundaries, begin: int, end: int, pieces: int, limit: int, overlap: int, low_share: float = 0.5) -> list[tuple[int, int, str]] | None:
    """``start, end, boundary`` of so many pieces, or None where a target finds no boundary that keeps the limit."""
    n = end - begin
    step = (n + (pieces - 1) * overlap) / pieces - overlap
    out, start = [], begin
    for i in range(1, pieces):
        target = begin + round(i * step) + overlap
        low = max(start + overlap + 1, end - (pieces - i) * (limit - overlap), round(target - step * low_share))
        high = min(start + limit, round(target + step * low_share), end - 1)
        if low > high:
            return None
        cut = found.snap(low, min(max(target, low), high), high)
        if cut is None:
            return None
        out.append((start, *cut))
        start = cut[0] - overlap
    return [*out, (start, end, "end")] if end - start <= limit else None


def _balanced(found: _Boundaries, begin: int, end: int, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """A part whose stretches without white space all are shorter than ``limit - overlap``."""
    least = max(1, -(-(end - begin - overlap) // (limit - overlap)))
    for pieces in range(least, least + 2 + int(MORE * least)):
        if (out := _place(found, begin, end, pieces, limit, overlap)) is not None:
            return out
    return found.fewest(begin, end, limit, overlap) or _cut_through(found, begin, end, limit, overlap)


def _cut_through(found: _Boundaries, begin: int, end: int, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """A part with a stretch longer than the limit: equal targets; a cut is forced where no boundary is near one."""
    n = end - begin
    pieces = max(1, -(-(n - overlap) // (limit - overlap)))
    out, start = [], begin
    for i in range(1, pieces):
        target = begin + round((n - overlap) * i / pieces) + overlap
        low, high = max(start + overlap + 1, end - (pieces - i) * (limit - overlap)), min(start + limit, end - 1)
        reach = (limit - overlap) // 4
        cut = found.snap(max(low, target - reach), min(max(target, low), high), min(high, target + reach)) if target - reach <= high and target + reach >= low else None
        out.append((start, *(cut or (min(max(target, low), high), FORCED))))
        start = out[-1][1] - overlap
    return [*out, (start, end, "end")]


def split(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """``start, end, boundary`` of the pieces of a text without white space at its ends; "end" ends the last piece.

    Only what surrounds a long stretch without white space is cut otherwise than the rest: the texts between such
    stretches are balanced each by itself. A stretch of up to ``limit`` characters is one piece, whose overlap with the
    piece before is shorter if it must be; a longer one is cut in equal parts, a short text beside it joining them.
    """
    n = len(text)
    if n <= limit:
        return [(0, n, "end")] if n else []
    found = _Boundaries(text)
    parts: list[list] = []  # begin, end, longest stretch
    last = 0
    for m in _RUN.finditer(text):
        a, z = m.span()
        if z - a > limit - overlap:
            if a > last:
                parts.append([last, a, 0])
            z = next((e for e in found.ends[-1][1][bisect_left(found.ends[-1][1], z) :][:1]), n) if z - a > limit else z
            parts.append([a, z, z - a if z - a > limit else m.end() - a])
            last = z
    if last < n:
        parts.append([last, n, 0])
    joined: list[list] = []
    for part in parts:  # short texts beside a stretch that is cut anyway
        before = joined[-1] if joined else None
        if before and (before[2] > limit and not part[2] and part[1] - part[0] < limit // 2 or part[2] > limit and not before[2] and before[1] - before[0] < limit // 2 or part[2] > limit and before[2] > limit):
            before[1], before[2] = part[1], max(part[2], before[2])
        else:
            joined.append(list(part))
    out: list[tuple[int, int, str]] = []
    for begin, end, longest in joined:
        start = max(begin - overlap, 0)
        if limit - overlap < longest <= limit and end - start > limit:
            start = max(start, end - limit)
        piece = _cut_through(found, start, end, limit, overlap) if longest > limit else [(start, end, "end")] if end - start <= limit else _balanced(found, start, end, limit, overlap)
        out += [*piece[:-1], (*piece[-1][:2], "end" if end == n else "word")]
    return out


def kind_of(text: str, limit: int = LIMIT) -> str:
    return FORCED if any(len(m) > limit for m in _RUN.findall(text)) else NATURAL


_PIECES = "id string, kind string, pieces int, piece int, start int, `end` int, boundary string, text string"


def _cut(limit: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(8)]
            for key, text in zip(b.column("id").to_pylist(), b.column("content").to_pylist()):
                text = (text or "").strip(WHITE)
                parts = split(text, limit, overlap)
                kind = kind_of(text, limit) if len(parts) > 1 else NATURAL
                for i, (start, end, boundary) in enumerate(parts):
                    for column, value in zip(out, (key, kind, len(parts), i, start, end, boundary, text[start:end])):
                        column.append(value)
            types = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["id", "kind", "pieces", "piece", "start", "end", "boundary", "text"])

    return run


def contents(records: DataFrame, raw_contents: DataFrame) -> DataFrame:
    """``id, content``: the current version's text or, if that is null or blank, the body its content_ref points to."""
    blank = F.coalesce(F.trim("text", F.lit(WHITE)) == "", F.lit(True))
    # Blank texts are told before versions are, so that the branch that looks up bodies moves no texts.
    rows = records.select("id", "updated_at", "seq", blank.alias("blank"), "text", "content_ref")
    own = current_version(rows.select("id", "updated_at", "seq", "blank", "text"), "id").where("not blank").select("id", F.col("text").alias("content"))
    lent = current_version(rows.select("id", "updated_at", "seq", "blank", "content_ref"), "id").where("blank and content_ref is not null").select("id", "content_ref")
    body = raw_contents.where("content_ref is not null and body is not null").select("content_ref", F.col("body").alias("content"))
    return own.unionByName(lent.join(body, "content_ref").select("id", "content"))


def pieces(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of ``id, content``, in order: no piece is longer than ``limit`` and each begins ``overlap`` characters
    before the end of the one before it (fewer only where a stretch without white space of nearly ``limit`` characters
    would otherwise be cut). start and end count code points of the content without white space at its ends; kind is
    ``forced`` for contents with more than ``limit`` characters in a row without white space.

    Edge cases: a null or blank content has no piece; one of up to ``limit`` characters is one piece; repeated rows are
    cut each; ties between boundaries of one kind go to the one nearer the target, then to the earlier; texts of any
    length are cut whole; an empty table gives no rows; other columns are not read.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    return items.select("id", "content").mapInArrow(_cut(limit, overlap), _PIECES)


def oversized(records: DataFrame, raw_contents: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``id, kind`` of the records whose contents had to be cut."""
    return pieces(contents(records, raw_contents), limit, overlap).where("piece = 0 and pieces > 1").select("id", "kind")

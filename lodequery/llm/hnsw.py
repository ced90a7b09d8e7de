"""A hierarchical navigable small-world graph in flat neighbour arrays, built and searched in numpy.

Nodes are ordered so that the nodes of every upper layer are a prefix of the layer below: layer ``l`` is the first
``sizes[l]`` nodes and one int32 array of neighbours, a fixed number of slots a node, unused slots holding ``n``.
Queries walk in lock-step: each step expands the best open node of every query's beam and evaluates all its unseen
neighbours with one gather, so the interpreter's cost is shared by a whole block of queries.
"""

from __future__ import annotations

import numpy as np

#: Links chosen for a new node, slots of a node, links kept when the slots overflow, beam while building.
LINKS, SLOTS, KEPT, BUILD_BEAM = 14, 32, 20, 32
#: Each layer has so many times fewer nodes than the one below; a layer this small is scanned, not walked.
LAYER_RATIO, SCANNED = 16, 256
#: Queries walking together, and new nodes linked together; bytes that their marks of seen nodes may take.
BLOCK, SEEN_BYTES = 1024, 32 << 20
_NEG = np.float32(-np.inf)


def _dots(x: np.ndarray, rows: np.ndarray, q: np.ndarray, of: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x[rows], q[of])


def _best(s: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k greatest of each row, greatest first."""
    if k < s.shape[1]:
        part = np.argpartition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k :]
    else:
        part = np.broadcast_to(np.arange(s.shape[1]), s.shape)
    return np.take_along_axis(part, np.argsort(-np.take_along_axis(s, part, 1), axis=1, kind="stable"), 1)


def walk(x: np.ndarray, links: np.ndarray, n: int, q: np.ndarray, ids: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Best ``beam`` nodes of one layer for each query, from the start nodes ``ids`` (no node twice in a row; n: none).

    Returns ids and similarities, in no order; missing ones are n and -inf.
    """
    count, width = len(q), links.shape[1]
    seen = np.zeros((count, n + 1), bool)
    seen[:, n] = True
    rows = np.arange(count)
    start = ids < n
    r, c = np.nonzero(start)
    s = np.full(ids.shape, _NEG)
    s[r, c] = _dots(x, ids[r, c], q, r)
    seen[r, ids[r, c]] = True
    if ids.shape[1] > beam:
        top = np.argpartition(-s, beam - 1, axis=1)[:, :beam]
        ids, s = np.take_along_axis(ids, top, 1), np.take_along_axis(s, top, 1)
    elif ids.shape[1] < beam:
        pad = beam - ids.shape[1]
        ids = np.concatenate([ids, np.full((count, pad), n, ids.dtype)], 1)
        s = np.concatenate([s, np.full((count, pad), _NEG)], 1)
    out_ids, out_s = np.empty((count, beam), np.int32), np.empty((count, beam), np.float32)
    opened = np.where(np.isneginf(s), _NEG, s)  # similarities of nodes yet to expand, -inf for others
    while len(rows):
        pick = opened.argmax(1)
        at = np.arange(len(rows))
        alive = opened[at, pick] > _NEG
        if not alive.all():
            over = ~alive
            out_ids[rows[over]], out_s[rows[over]] = ids[over], s[over]
            rows, ids, s, opened, pick = rows[alive], ids[alive], s[alive], opened[alive], pick[alive]
            if not len(rows):
                break
            at = np.arange(len(rows))
        opened[at, pick] = _NEG
        near = links[ids[at, pick]]
        r, c = np.nonzero(~seen[rows[:, None], near])
        fresh = near[r, c]
        seen[rows[r], fresh] = True
        new = np.full((len(rows), width), _NEG)
        new[r, c] = _dots(x, fresh, q, rows[r])
        all_s = np.concatenate([s, new], 1)
        top = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
        s = np.take_along_axis(all_s, top, 1)
        ids = np.take_along_axis(np.concatenate([ids, near], 1), top, 1)
        opened = np.take_along_axis(np.concatenate([opened, new], 1), top, 1)
    return out_ids, out_s


def spread(x: np.ndarray, n: int, ids: np.ndarray, s: np.ndarray, keep: int) -> np.ndarray:
    """Up to ``keep`` links out of candidates sorted by similarity: first those nearer to the node than to any link
    chosen before, then the nearest of the others."""
    v = x[ids]
    pair = np.matmul(v, v.transpose(0, 2, 1))
    real = ids < n
    chosen = np.zeros(ids.shape, bool)
    for j in range(ids.shape[1]):
        chosen[:, j] = real[:, j] & ~((pair[:, :, j] > s[:, j : j + 1]) & chosen).any(1)
    order = np.argsort(np.where(chosen, 0, np.where(real, 1, 2)), axis=1, kind="stable")[:, :keep]
    return np.where(np.take_along_axis(real, order, 1), np.take_along_axis(ids, order, 1), n).astype(np.int32)


class Graph:
    """Built over unit vectors ``x`` (n by d, float32) given in random order."""

    def __init__(self, x: np.ndarray, links: int = LINKS, slots: int = SLOTS, beam: int = BUILD_BEAM):
        self.n = n = len(x)
        self.x = np.concatenate([x, np.zeros((1, x.shape[1]), np.float32)]).astype(np.float32)
        self.sizes = [n]
        while self.sizes[-1] > SCANNED:
            self.sizes.append(-(-self.sizes[-1] // LAYER_RATIO))
        self.layers: list[np.ndarray] = [np.full((m, slots), n, np.int32) for m in self.sizes]
        for level in range(len(self.sizes) - 1, -1, -1):
            self._fill(level, links, beam)

    def _fill(self, level: int, links: int, beam: int) -> None:
        m, done = self.sizes[level], 0
        while done < m:
            block = max(64, min(BLOCK, SEEN_BYTES // (self.n + 1)))
            step = min(m, BLOCK if not done else done + min(block, max(SCANNED, done // 2)))
            self._add(level, done, step, links, beam)
            done = step

    def _add(self, level: int, a: int, b: int, links: int, beam: int) -> None:
        """Link nodes a..b-1 of a layer: candidates are a walk over the nodes before a, and the exact nearest among a..b-1."""
        x, n, layer = self.x, self.n, self.layers[level]
        q = x[a:b]
        own = q @ q.T
        np.fill_diagonal(own, _NEG)
        near = _best(own, min(links, b - a))
        ids, s = (near + a).astype(np.int32), np.take_along_axis(own, near, 1)
        if a:
            start = self._descend(q, level)
            far, far_s = walk(x, layer, n, q, start, beam)
            ids, s = np.concatenate([ids, far], 1), np.concatenate([s, far_s], 1)
        order = np.argsort(-s, axis=1, kind="stable")[:, : beam + links // 2]
        ids, s = np.take_along_axis(ids, order, 1), np.take_along_axis(s, order, 1)
        ids = np.where(np.isneginf(s), n, ids)
        to = spread(x, n, ids, s, links)
        layer[a:b, : to.shape[1]] = to
        # Links back, the nearest first; a node whose slots are full gets its links chosen anew.
        r, c = np.nonzero(to < n)
        target, source = to[r, c], (r + a).astype(np.int32)
        sim = _dots(x, target, x, source)
        order = np.lexsort((-sim, target))
        target, source = target[order], source[order]
        first = np.r_[True, target[1:] != target[:-1]]
        place = np.arange(len(target)) - np.maximum.accumulate(np.where(first, np.arange(len(target)), 0))
        used = (layer[target] < n).sum(1)
        slots = layer.shape[1]
        mine = (layer[target] == source[:, None]).any(1)
        fits = ~mine & (used + place < slots)
        layer[target[fits], (used + place)[fits]] = source[fits]
        full = np.unique(target[~mine & ~fits])
        if len(full):
            extra = ~mine & ~fits & (place < 2 * slots)
            spare = np.full((len(full), slots), n, np.int32)
            row = np.searchsorted(full, target[extra])
            free = slots - np.minimum(slots, (layer[full] < n).sum(1))  # 0: they are full now
            col = place[extra] - place_start(row, place[extra]) + free[row]
            ok = col < slots
            spare[row[ok], col[ok]] = source[extra][ok]
            for k in range(0, len(full), BLOCK):
                node = full[k : k + BLOCK]
                ids = np.concatenate([layer[node], spare[k : k + BLOCK]], 1)
                s = np.einsum("ijk,ik->ij", x[ids], x[node])
                s[ids == n] = _NEG
                order = np.argsort(-s, axis=1, kind="stable")[:, : slots + 8]
                ids, s = np.take_along_axis(ids, order, 1), np.take_along_axis(s, order, 1)
                layer[node] = n
                layer[node, :KEPT] = spread(x, n, ids, s, KEPT)

    def _descend(self, q: np.ndarray, level: int, wide: int = 4) -> np.ndarray:
        """Start nodes in ``level`` for queries that may be anywhere: scan the top layer, walk those between."""
        top = len(self.sizes) - 1
        if level == top:
            m = min(self.sizes[top], SCANNED)
            return np.broadcast_to(np.arange(min(m, wide), dtype=np.int32), (len(q), min(m, wide)))
        m = self.sizes[top]
        ids = _best(q @ self.x[:m].T, min(wide, m)).astype(np.int32)
        for between in range(top - 1, level, -1):
            ids, _ = walk(self.x, self.layers[between], self.n, q, ids, wide)
        return ids

    def search(self, q: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best nodes for each query vector, in no order (n: none)."""
        return self._blocks(q, None, k, beam)

    def search_nodes(self, k: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best nodes for every node, itself among them: the walk starts at the node and its links."""
        own = np.concatenate([np.arange(self.n, dtype=np.int32)[:, None], self.layers[0]], 1)
        return self._blocks(self.x[: self.n], own, k, beam)

    def _blocks(self, q: np.ndarray, start: np.ndarray | None, k: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        ids, sims = np.full((len(q), k), self.n, np.int32), np.full((len(q), k), _NEG)
        block = max(64, min(BLOCK, SEEN_BYTES // (self.n + 1)))
        for a in range(0, len(q), block):
            part = q[a : a + block]
            i, s = walk(self.x, self.layers[0], self.n, part, self._descend(part, 0) if start is None else start[a : a + block], max(beam, k))
            top = _best(s, min(k, s.shape[1]))
            ids[a : a + block, : top.shape[1]], sims[a : a + block, : top.shape[1]] = np.take_along_axis(i, top, 1), np.take_along_axis(s, top, 1)
        return np.where(np.isneginf(sims), self.n, ids), sims


def place_start(group: np.ndarray, place: np.ndarray) -> np.ndarray:
    """For each element the least place in its group (groups are consecutive)."""
    if not len(group):
        return place
    first = np.r_[True, group[1:] != group[:-1]]
    return np.repeat(place[first], np.diff(np.r_[np.nonzero(first)[0], len(group)]))

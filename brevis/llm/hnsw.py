"""Hierarchical navigable small-world graphs with numpy, built and searched for many vectors at a time."""

from __future__ import annotations

import numpy as np

#: Neighbours a node keeps on the upper layers and on the base layer, and the beam while building.
UPPER, LOWER, BUILD_BEAM = 12, 24, 40
#: A node is on layer l or above with probability RATIO ** -l.
RATIO = 16
FIRST, BATCH, EXPAND = 256, 512, 3
TOGETHER = 1024
#: Beam of the descent, and the nodes it hands to the layer below.
DESCENT, ENTRIES = 24, 3
#: Nodes of an upper layer up to which one product with all of them costs less than a beam.
DENSE = 1024
#: Pairs whose similarities are computed at once.
PIECE = 4096


def together(nodes: int) -> int:
    """Queries that search a graph of as many nodes at a time."""
    return max(8, min(TOGETHER, 24_000_000 // (nodes + 1)))


def _top(ids: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest of each row, in falling order."""
    if ids.shape[1] > k:
        at = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        ids, sims = np.take_along_axis(ids, at, 1), np.take_along_axis(sims, at, 1)
    at = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, at, 1), np.take_along_axis(sims, at, 1)


def _select(x: np.ndarray, ids: np.ndarray, sims: np.ndarray, m: int) -> np.ndarray:
    """Of each row's candidates (falling similarity, -1 for none) up to m that are nearer to the row's vector than to any chosen one; then the nearest others."""
    n, c = ids.shape
    v = x.take(ids, 0)
    shadows = v @ v.transpose(0, 2, 1) >= sims[:, None, :]  # a candidate that is as near to another one as to the row
    chosen, open_, left = np.zeros((n, c), bool), ids >= 0, np.full(n, m)
    for j in range(c):
        chosen[:, j] = open_[:, j] & (left > 0)
        left -= chosen[:, j]
        open_ &= ~(shadows[:, j] & chosen[:, j, None])
    rank = np.where(chosen, 0, np.where(ids >= 0, 1, 2)) * c + np.arange(c)
    at = np.argsort(rank, axis=1)[:, :m]
    out = np.take_along_axis(ids, at, 1)
    return np.pad(out, ((0, 0), (0, m - out.shape[1])), constant_values=-1)


def _dots(x: np.ndarray, at: np.ndarray, q: np.ndarray, who: np.ndarray) -> np.ndarray:
    """x[at] times q[who], pair by pair, in pieces that stay in a core's cache."""
    out = np.empty(len(at), x.dtype)
    for lo in range(0, len(at), PIECE):
        a, b = at[lo : lo + PIECE], who[lo : lo + PIECE]
        out[lo : lo + PIECE] = np.einsum("kd,kd->k", x.take(a, 0), q.take(b, 0))
    return out


def _fresh(got: np.ndarray) -> np.ndarray:
    """Rows with repeated ids put to -1."""
    got = np.sort(got, axis=1)
    got[:, 1:][got[:, 1:] == got[:, :-1]] = -1
    return got


def beam_search(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, similarities, visited) of a best-first search per query, nearest first; entry: a node or several per query.

    A step works on the few neighbours that are new, and of these only those nearer
    than a beam's last enter its sort: no array is as wide as the neighbourhoods but
    the one of places looked up in visited.
    """
    n, width = len(q), len(x) + 1
    entry = _fresh(entry.reshape(n, -1).copy())
    entry[(entry < 0).all(1), 0] = 0
    visited = np.zeros((n, width), bool)  # the last column stands for no node
    visited[:, -1] = True
    visited[np.arange(n)[:, None], entry] = True
    flat = visited.reshape(-1)
    ids, sims = _top(entry, np.where(entry >= 0, np.einsum("qkd,qd->qk", x[entry], q), -2.0).astype(x.dtype), beam)
    pad = ((0, 0), (0, beam - ids.shape[1]))
    ids, sims = np.pad(ids, pad, constant_values=-1), np.pad(sims, pad, constant_values=-2.0)
    open_ = ids >= 0
    while True:
        take = open_ & (np.cumsum(open_, 1, dtype=np.int32) <= EXPAND)  # beams are sorted: the nearest that are open
        who, place = np.nonzero(take)
        if not who.size:
            return ids, sims, visited
        open_ &= ~take
        code = (links.take(ids[who, place], 0) + (who * width)[:, None]).ravel()  # no node is -1: the column before the query's own, which is set
        code = np.sort(code[~flat.take(code, mode="wrap")])
        code = code[np.concatenate([[True], code[1:] != code[:-1]])] if code.size else code
        flat[code] = True
        who = code // width
        node = code - who * width
        new = _dots(x, node, q, who)
        near = np.flatnonzero(new > sims[who, -1])
        who, node, new = who[near], node[near], new[near]
        if not who.size:
            continue
        rows, start, count = np.unique(who, return_index=True, return_counts=True)
        at, place = np.repeat(np.arange(len(rows)), count), beam + np.arange(len(who)) - np.repeat(start, count)
        shape = len(rows), beam + int(count.max())
        all_ids, all_sims, all_open = np.full(shape, -1, ids.dtype), np.full(shape, -2.0, sims.dtype), np.zeros(shape, bool)
        all_ids[:, :beam], all_sims[:, :beam], all_open[:, :beam] = ids[rows], sims[rows], open_[rows]
        all_ids[at, place], all_sims[at, place], all_open[at, place] = node, new, True
        best = np.argsort(-all_sims, axis=1)[:, :beam]
        ids[rows], sims[rows], open_[rows] = np.take_along_axis(all_ids, best, 1), np.take_along_axis(all_sims, best, 1), np.take_along_axis(all_open, best, 1)


class Graph:
    """x: rows of length one. order: nodes by falling layer, so that layer l has the first size[l] of them; links[l]: node -> neighbours."""

    def __init__(self, x: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        level = np.minimum((-np.log(1 - rng.random(len(x))) / np.log(RATIO)).astype(int), 6)
        mixed = rng.permutation(len(x))  # neighbours in the table may be copies of each other: a batch shouldn't be made of them
        order = mixed[np.argsort(-level[mixed], kind="stable")]
        self.x, self.links = x[order], []
        self.order = order
        self.sizes = [int((level >= lo).sum()) for lo in range(int(level.max(initial=0)) + 1)]
        self.links = [None] * len(self.sizes)
        for layer in range(len(self.sizes) - 1, -1, -1):
            self._build(layer)

    def entries(self, q: np.ndarray, above: int, beam: int = DESCENT) -> np.ndarray:
        """The nearest nodes that a descent from the top finds on the layers over this one.

        A dense group of vectors has few links from outside on the base layer, but
        nodes of its own on the layer above, which a beam of this width finds. The
        layers at the top that are small are compared whole.
        """
        at = np.zeros((len(q), 1), np.int64)
        layers = range(len(self.sizes) - 1, above, -1)
        small = [layer for layer in layers if self.sizes[layer] <= DENSE]
        if small:  # layers are nested, so the lowest small one holds all above it
            size = self.sizes[small[-1]]
            s = q @ self.x[:size].T
            at = np.empty((len(q), min(ENTRIES, size)), np.int64)
            for k in range(at.shape[1]):  # a few largest of many: a pass for each
                at[:, k] = s.argmax(1)
                s[np.arange(len(q)), at[:, k]] = -2.0
        for layer in layers[len(small) :]:
            ids, sims, _ = beam_search(self.x[: self.sizes[layer]], self.links[layer], q, at, beam)
            at = _top(ids, sims, ENTRIES)[0]
        return at

    def _build(self, layer: int) -> None:
        n, m = self.sizes[layer], LOWER if layer == 0 else UPPER
        x = self.x[:n]
        links = np.full((n, m), -1, np.int64)
        self.links[layer] = links
        first = min(n, FIRST)
        if first > 1:
            s = x[:first] @ x[:first].T
            np.fill_diagonal(s, -2.0)
            ids, sims = _top(np.broadcast_to(np.arange(first), s.shape).copy(), s, min(first - 1, BUILD_BEAM))
            links[:first] = _select(x, ids, sims, m)
        at = first
        while at < n:
            end = min(n, at + BATCH, 2 * at)
            q = x[at:end]
            ids, sims, _ = beam_search(x[:at], links[:at], q, np.where((e := self.entries(q, layer)) < at, e, -1), BUILD_BEAM)
            s = q @ q.T
            np.fill_diagonal(s, -2.0)
            ids, sims = np.concatenate([ids, np.broadcast_to(np.arange(at, end), s.shape)], 1), np.concatenate([sims, s], 1)
            ids, sims = _top(ids, sims, BUILD_BEAM)
            links[at:end] = _select(x, np.where(sims > -1.5, ids, -1), sims, m)
            self._link_back(x, links, np.arange(at, end), m)
            at = end

    def _link_back(self, x: np.ndarray, links: np.ndarray, new: np.ndarray, m: int) -> None:
        """Gives the neighbours of new nodes a link back; a node with too many chooses anew."""
        to, source = links[new].ravel(), np.repeat(new, m)
        source, to = source[to >= 0], to[to >= 0]
        sims = _dots(x, source, x, to)
        by = np.lexsort((-sims, to))
        source, to = source[by], to[by]
        start = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if to.size else np.empty(0, np.int64)
        place = np.arange(len(to)) - np.repeat(start, np.diff(np.append(start, len(to))))
        keep = place < m
        nodes, row, count = np.unique(to, return_inverse=True, return_counts=True)
        more = np.full((len(nodes), m), -1, np.int64)
        more[row[keep], place[keep]] = source[keep]
        few = np.argsort(count, kind="stable")  # most get a link or two: a piece is as wide as its own most
        for lo in range(0, len(nodes), BATCH):
            part = few[lo : lo + BATCH]
            own = nodes[part]
            ids = _fresh(np.concatenate([links[own], more[part, : min(m, count[part[-1]])]], 1))
            sims = np.where(ids >= 0, np.einsum("qkd,qd->qk", x.take(ids, 0), x.take(own, 0)), -2.0)
            ids, sims = _top(ids, sims, 2 * m)
            links[own] = _select(x, ids, sims, m)

    def within(self, q: np.ndarray, least: float, beam: int, slack: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, node, similarity) pairs of at least `least`: a beam on the base layer finds the region, which is then followed while similarities stay over least - slack."""
        x, links, out = self.x, self.links[0], []
        chunk = together(len(x))
        for lo in range(0, len(q), chunk):
            part = q[lo : lo + chunk]
            ids, sims, visited = beam_search(x, links, part, self.entries(part, 0, max(DESCENT, beam)), beam)
            visited[:] = False  # the beam has seen more than it kept
            visited[np.arange(len(part))[:, None], ids] = True
            who, place = np.nonzero(sims >= least - slack)
            node, sim = ids[who, place], sims[who, place]
            while who.size:
                hit = sim >= least
                out.append((who[hit] + lo, node[hit], sim[hit]))
                parts = []
                for a in range(0, len(who), 50_000):
                    to = links[node[a : a + 50_000]]
                    w = np.broadcast_to(who[a : a + 50_000, None], to.shape)
                    new = (to >= 0) & ~visited[w, to]
                    code = np.unique(w[new] * np.int64(len(x)) + to[new])
                    w, to = code // len(x), code % len(x)
                    visited[w, to] = True
                    s = _dots(x, to, part, w)
                    near = s >= least - slack
                    parts.append((w[near], to[near], s[near]))
                who, node, sim = (np.concatenate(c) for c in zip(*parts, strict=True))
        if not out:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

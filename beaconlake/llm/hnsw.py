"""A hierarchical navigable small-world graph over unit vectors, searched for many queries at a time."""

from __future__ import annotations

import numpy as np

#: Links of a node above and on the ground layer, beam while building, nodes expanded at a time.
LINKS, GROUND_LINKS, BUILD_BEAM, EXPAND = 12, 24, 48, 4
QUERIES_AT_ONCE = 256


def _levels(n: int, seed: int) -> np.ndarray:
    u = np.random.default_rng(seed).random(n)
    return np.floor(-np.log(np.maximum(u, 1e-12)) / np.log(LINKS)).astype(np.int64)


def _pick(near: np.ndarray, sims: np.ndarray, vectors: np.ndarray, m: int) -> np.ndarray:
    """Up to m of each row's candidates, best first: those nearer to the node than to any picked before,
    then the best of the others. Candidates are padded with -1 at similarity -inf."""
    order = np.argsort(-sims, axis=1, kind="stable")
    near, sims = np.take_along_axis(near, order, 1), np.take_along_axis(sims, order, 1)
    among = np.einsum("bid,bjd->bij", vectors[near], vectors[near])
    picked = np.zeros(near.shape, dtype=bool)
    for j in range(near.shape[1]):
        blocked = (picked[:, :j] & (among[:, j, :j] > sims[:, j, None])).any(axis=1)
        picked[:, j] = ~blocked & (near[:, j] >= 0) & (picked[:, :j].sum(axis=1) < m)
    rank = np.argsort(np.where(near < 0, 2, np.where(picked, 0, 1)), axis=1, kind="stable")[:, :m]
    out = np.take_along_axis(near, rank, 1)
    return out if out.shape[1] == m else np.pad(out, ((0, 0), (0, m - out.shape[1])), constant_values=-1)


def _beam(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int, seen: int) -> tuple[np.ndarray, np.ndarray]:
    """The best ``beam`` nodes found for each query and their similarities, -1 and -inf where fewer."""
    q, rows = len(queries), np.arange(len(queries))[:, None]
    visited = np.zeros((q, seen + 1), dtype=bool)
    ids, sims = np.full((q, beam), -1, dtype=np.int64), np.full((q, beam), -np.inf, dtype=np.float32)
    ids[:, 0], sims[:, 0] = entry, np.einsum("qd,qd->q", vectors[entry], queries)
    visited[rows[:, 0], entry] = True
    visited[:, seen] = True  # what -1 stands for
    done = ids < 0
    while not done.all():
        open_ = np.where(done, -np.inf, sims)
        at = np.argpartition(-open_, min(EXPAND, beam - 1), axis=1)[:, :EXPAND]
        live = ~np.take_along_axis(done, at, 1)
        np.put_along_axis(done, at, True, 1)
        base = np.where(live, np.take_along_axis(ids, at, 1), -1)
        new = np.where(base[:, :, None] >= 0, links[base], -1).reshape(q, -1)
        new.sort(axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
        new[new < 0] = seen
        fresh = ~visited[rows, new]
        visited[rows, new] = True
        wide = fresh.sum(axis=1).max()
        if wide == 0:
            continue
        keep = np.argpartition(~fresh, min(wide, fresh.shape[1] - 1), axis=1)[:, :wide]
        new, fresh = np.take_along_axis(new, keep, 1), np.take_along_axis(fresh, keep, 1)
        new = np.where(fresh, new, -1)
        got = np.where(fresh, np.einsum("qkd,qd->qk", vectors[new], queries), -np.inf).astype(np.float32)
        ids, sims = np.concatenate([ids, new], 1), np.concatenate([sims, got], 1)
        done = np.concatenate([done, new < 0], 1)
        best = np.argpartition(-sims, beam - 1, axis=1)[:, :beam]
        ids, sims, done = (np.take_along_axis(x, best, 1) for x in (ids, sims, done))
    return ids, sims


class Hnsw:
    """``vectors`` are unit rows in single precision, in ``order`` of their highest layer: the first
    sizes[k] of them are the members of layer k, and links[k] holds their links. Layers go from the top
    to the ground."""

    def __init__(self, vectors: np.ndarray, order: np.ndarray, links: list[np.ndarray]):
        self.vectors, self.order, self.links = vectors, order, links

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int = 3) -> Hnsw:
        levels = _levels(len(vectors), seed)
        order = np.argsort(-levels, kind="stable")
        graph = cls(vectors[order], order, [])
        for level in range(int(levels.max(initial=0)), -1, -1):
            graph._add_layer(int((levels >= level).sum()), LINKS if level else GROUND_LINKS)
        return graph

    def _add_layer(self, size: int, m: int) -> None:
        """Inserts the members in batches, each no larger than what is there already."""
        x, links, at = self.vectors, np.full((size, m), -1, dtype=np.int32), 0
        while at < size:
            batch = np.arange(at, min(size, at + min(max(at, 64), 512)))
            inner = x[batch] @ x[batch].T
            np.fill_diagonal(inner, -np.inf)
            top = np.argsort(-inner, axis=1)[:, :m]
            near, sims = batch[top], np.take_along_axis(inner, top, 1)
            near[sims == -np.inf] = -1
            if at:
                ids, found = self._layer_search(links, x[batch], self._entries(x[batch], len(self.links)) % at, BUILD_BEAM, at)
                near, sims = np.concatenate([near, ids], 1), np.concatenate([sims, found], 1)
            links[batch] = _pick(near, sims, x, m)
            self._link_back(x, links, batch)
            at = batch[-1] + 1
        self.links.append(links)

    def _link_back(self, x: np.ndarray, links: np.ndarray, batch: np.ndarray) -> None:
        m = links.shape[1]
        source = np.repeat(batch, m)
        target = links[batch].ravel().astype(np.int64)
        source, target = source[target >= 0], target[target >= 0]
        sims = np.einsum("ed,ed->e", x[source], x[target])
        order = np.lexsort((-sims, target))
        source, target, sims = source[order], target[order], sims[order]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        place = np.arange(len(target)) - np.repeat(first, count)
        wide = min(int(count.max(initial=0)), 2 * m)  # of more new neighbours the nearest are tried
        kept = place < wide
        new = np.full((len(nodes), wide), -1, dtype=np.int64)
        new[np.repeat(np.arange(len(nodes)), count)[kept], place[kept]] = source[kept]
        new[(new[:, :, None] == links[nodes][:, None, :]).any(axis=2)] = -1
        for a in range(0, len(nodes), 1024):
            part = nodes[a:a + 1024]
            near = np.concatenate([links[part].astype(np.int64), new[a:a + 1024]], 1)
            s = np.where(near >= 0, np.einsum("bkd,bd->bk", x[near], x[part]), -np.inf)
            links[part] = _pick(near, s, x, m)

    def _entries(self, queries: np.ndarray, layers: int) -> np.ndarray:
        """Where to start below the first ``layers`` layers, by greedy descent through them."""
        at = np.zeros(len(queries), dtype=np.int64)
        for links in self.links[:layers]:
            at = self._layer_search(links, queries, at, EXPAND, len(links))[0][:, 0]
        return at

    def _layer_search(self, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int, seen: int) -> tuple[np.ndarray, np.ndarray]:
        """Best first. ``seen`` nodes of the layer are linked so far."""
        out = []
        for a in range(0, len(queries), QUERIES_AT_ONCE):
            ids, sims = _beam(self.vectors, links, queries[a:a + QUERIES_AT_ONCE], entry[a:a + QUERIES_AT_ONCE], beam, seen)
            order = np.argsort(-sims, axis=1, kind="stable")
            out.append((np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)))
        return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the given vectors and similarities of the best ``beam`` found for each query, best first."""
        ids, sims = self._layer_search(self.links[-1], queries, self._entries(queries, len(self.links) - 1), beam, len(self.order))
        return np.where(ids >= 0, self.order[ids], -1), sims

"""Hierarchical navigable small-world graph over unit vectors, built and searched in batches with numpy."""

from __future__ import annotations

import numpy as np

FIRST = 512  # nodes of a layer whose links are found by comparing all


class Layer:
    """Nodes of one layer (rows of the vectors) and their links (positions in nodes, -1: none)."""

    def __init__(self, nodes: np.ndarray, width: int):
        self.nodes, self.links = nodes, np.full((len(nodes), width), -1, np.int32)


class Graph:
    """links: out-links of a node above the bottom, which has twice as many; beam: candidates when building."""

    def __init__(self, vectors: np.ndarray, links: int = 12, beam: int = 48, seed: int = 7):
        self.x = np.ascontiguousarray(vectors, np.float32)
        n = len(self.x)
        level = np.floor(-np.log(np.random.default_rng(seed).random(n)) / np.log(links)).astype(int)
        order = np.argsort(-level, kind="stable")
        self.layers: list[Layer] = []  # from the top
        self.back: tuple[np.ndarray, np.ndarray] | None = None
        for at in range(int(level.max(initial=0)), -1, -1):
            count = int((level >= at).sum())
            self._build(Layer(order[:count].astype(np.int32), links * 2 if at == 0 else links), beam)

    def _build(self, layer: Layer, beam: int) -> None:
        done = min(len(layer.nodes), max(FIRST, len(self.layers[-1].nodes) if self.layers else 0))
        v = self.x[layer.nodes[:done]]
        s = v @ v.T
        np.fill_diagonal(s, -2)
        take = min(beam, done - 1)
        if take > 0:
            near = np.argsort(-s, axis=1)[:, :take]
            self._connect(layer, np.arange(done), near, np.take_along_axis(s, near, 1))
        while done < len(layer.nodes):
            new = np.arange(done, min(len(layer.nodes), done + min(done, 1024)))
            q = self.x[layer.nodes[new]]
            ids, sims = self._beam(layer, q, self._entries(q), beam, limit=done)
            s = q @ q.T
            np.fill_diagonal(s, -2)
            near = np.argsort(-s, axis=1)[:, :8]
            ids, sims = np.hstack([ids, new[near]]), np.hstack([sims, np.take_along_axis(s, near, 1)])
            best = np.argsort(-sims, axis=1)[:, :beam]
            self._connect(layer, new, np.take_along_axis(ids, best, 1), np.take_along_axis(sims, best, 1))
            done = int(new[-1]) + 1
        self._reach(layer)
        self.layers.append(layer)

    @staticmethod
    def _reach(layer: Layer, least: int = 4, through: int = 4) -> None:
        """Nodes to which fewer than `least` links lead get links from the nodes they link to, in columns added for it."""
        n = len(layer.nodes)
        incoming = np.bincount(layer.links[layer.links >= 0], minlength=n)
        low = np.flatnonzero(incoming < least)
        source = layer.links[low][:, :through]
        target = np.repeat(low, source.shape[1])[source.ravel() >= 0]
        source = source.ravel()[source.ravel() >= 0]
        order = np.argsort(source, kind="stable")
        source, target = source[order], target[order]
        counts = np.bincount(source, minlength=n)
        more = np.full((n, int(counts.max(initial=0))), -1, np.int32)
        more[source, np.arange(len(source)) - np.r_[0, np.cumsum(counts)[:-1]][source]] = target
        layer.links = np.hstack([layer.links, more])

    def _choose(self, layer: Layer, ids: np.ndarray, sims: np.ndarray, width: int) -> np.ndarray:
        """Per row the candidates (best first) that are nearer to the node than to any chosen one, then the best others."""
        ok = (ids >= 0) & (sims > -1.5)
        v = self.x[layer.nodes[np.maximum(ids, 0)]]
        between = np.einsum("bid,bjd->bij", v, v)
        chosen = np.zeros(ids.shape, bool)
        for j in range(ids.shape[1]):
            crowded = ((between[:, j, :] > sims[:, j : j + 1]) & chosen).any(1)
            chosen[:, j] = ok[:, j] & ~crowded & (chosen.sum(1) < width)
        rank = np.where(chosen, 0, np.where(ok, 1, 2)) * ids.shape[1] + np.arange(ids.shape[1])
        pick = np.argsort(rank, axis=1)[:, :width]
        out = np.where(np.take_along_axis(ok, pick, 1), np.take_along_axis(ids, pick, 1), -1)
        return np.pad(out, ((0, 0), (0, width - out.shape[1])), constant_values=-1)

    def _connect(self, layer: Layer, new: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        """Links new nodes to chosen candidates, and these back, choosing again where a node has too many."""
        width = layer.links.shape[1]
        for lo in range(0, len(new), 256):
            part = slice(lo, lo + 256)
            layer.links[new[part]] = self._choose(layer, ids[part], sims[part], width)
        source = np.repeat(new, width)
        target = layer.links[new].ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, first, counts = np.unique(target, return_index=True, return_counts=True)
        room = min(int(counts.max(initial=0)), 64)
        for lo in range(0, len(nodes), 256):
            own, start, n = nodes[lo : lo + 256], first[lo : lo + 256], np.minimum(counts[lo : lo + 256], room)
            at = start[:, None] + np.arange(room)
            incoming = np.where(np.arange(room) < n[:, None], source[np.minimum(at, len(source) - 1)], -1)
            both = np.hstack([layer.links[own], incoming])
            both = np.where((both[:, :, None] == both[:, None, :])[:, :, :].argmax(2) == np.arange(both.shape[1]), both, -1)  # each once
            s = np.einsum("bd,bjd->bj", self.x[layer.nodes[own]], self.x[layer.nodes[np.maximum(both, 0)]])
            s = np.where((both >= 0) & (both != own[:, None]), s, -2)
            best = np.argsort(-s, axis=1)
            layer.links[own] = self._choose(layer, np.take_along_axis(both, best, 1), np.take_along_axis(s, best, 1), width)

    def _entries(self, q: np.ndarray) -> np.ndarray:
        """Positions in the last finished layer's nodes, the same as in the next one's, nearest to each query."""
        at = np.zeros((len(q), 1), np.int32)
        for layer in self.layers:
            at = self._beam(layer, q, at, 4)[0][:, :1]
        return at

    def _beam(self, layer: Layer, q: np.ndarray, entries: np.ndarray, beam: int, limit: int | None = None, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """The beam's positions and similarities per query, best first; expands the best unexpanded until none is left in it."""
        n = len(layer.nodes) if limit is None else limit
        rows = np.arange(len(q))
        seen = np.zeros((len(q), n), bool)
        ids = np.full((len(q), beam), -1, np.int32)
        sims = np.full((len(q), beam), -2, np.float32)
        opened = np.ones((len(q), beam), bool)
        k = entries.shape[1]
        ids[:, :k] = entries
        sims[:, :k] = np.einsum("qd,qkd->qk", q, self.x[layer.nodes[entries]])
        opened[:, :k] = False
        seen[rows[:, None], entries] = True
        active = rows
        while len(active):
            wait = np.where(opened[active], -3, sims[active])
            pick = np.argsort(-wait, axis=1)[:, :step]
            fresh = np.take_along_axis(wait, pick, 1) > -2
            at = np.where(fresh, np.take_along_axis(ids[active], pick, 1), -1)
            opened[active[:, None], pick] = True
            near = np.where(at[:, :, None] >= 0, layer.links[np.maximum(at, 0)], -1).reshape(len(active), -1)
            near = np.where(near < n, near, -1)
            near = np.sort(near, axis=1)
            near[:, 1:] = np.where(near[:, 1:] == near[:, :-1], -1, near[:, 1:])
            new = (near >= 0) & ~seen[active[:, None], np.maximum(near, 0)]
            r, c = np.nonzero(new)
            seen[active[r], near[r, c]] = True
            s = np.full(near.shape, -2, np.float32)
            s[r, c] = np.einsum("id,id->i", q[active[r]], self.x[layer.nodes[near[r, c]]])
            all_ids, all_sims = np.hstack([ids[active], near]), np.hstack([sims[active], s])
            all_open = np.hstack([opened[active], ~new])
            best = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
            ids[active], sims[active], opened[active] = np.take_along_axis(all_ids, best, 1), np.take_along_axis(all_sims, best, 1), np.take_along_axis(all_open, best, 1)
            active = active[(~opened[active] & (sims[active] > -2)).any(1)]
        return ids, sims

    def within(self, q: np.ndarray, least: float, beam: int, most: int | None = None) -> tuple[np.ndarray, np.ndarray] | None:
        """(query, vector) pairs of similarity >= least: the beam, then whatever links lead to from what was found. None: over `most` of them."""
        if not len(self.x) or not len(q):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        bottom = self.layers[-1]
        at = np.zeros((len(q), 1), np.int32)
        for layer in self.layers[:-1]:
            at = self._beam(layer, q, at, 4)[0][:, :1]
        ids, sims = self._beam(bottom, q, at, min(beam, len(bottom.nodes)))
        if self.back is None:  # links that lead to each node, for following them backwards
            flat = bottom.links.ravel()
            order = np.argsort(flat, kind="stable")[int((flat < 0).sum()) :]
            self.back = (order // bottom.links.shape[1]).astype(np.int64), np.searchsorted(flat[order], np.arange(len(bottom.nodes) + 1))
        r, c = np.nonzero(sims >= least)
        found = np.unique(r.astype(np.int64) * len(bottom.nodes) + ids[r, c])
        edge = found
        while len(edge):
            if most is not None and len(found) > most:
                return None
            now, edge = edge[:50_000], edge[50_000:]
            r, v = now // len(bottom.nodes), now % len(bottom.nodes)
            near = bottom.links[v]
            source, bounds = self.back
            n = bounds[v + 1] - bounds[v]
            at = np.repeat(bounds[v] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            r, near = np.r_[np.repeat(r, near.shape[1]), np.repeat(r, n)], np.r_[near.ravel(), source[at]]
            key = np.unique((r * len(bottom.nodes) + near)[near >= 0])
            key = key[~np.isin(key, found, assume_unique=True)]
            fresh = [edge]
            for lo in range(0, len(key), 50_000):
                x = key[lo : lo + 50_000]
                s = np.einsum("id,id->i", q[x // len(bottom.nodes)], self.x[bottom.nodes[x % len(bottom.nodes)]])
                fresh.append(x[s >= least])
            found = np.union1d(found, np.concatenate(fresh[1:])) if len(fresh) > 1 else found
            edge = np.concatenate(fresh)
        return found // len(bottom.nodes), bottom.nodes[found % len(bottom.nodes)].astype(np.int64)

    def parts_within(self, q: np.ndarray, least: float, rows: int = 8192):
        """The same pairs as within, none missed: products of the queries with all vectors, in blocks of them, a block's pairs at a time."""
        for lo in range(0, len(self.x), rows):
            r, c = np.nonzero(q @ self.x[lo : lo + rows].T >= least)
            yield r, lo + c

    def all_within(self, q: np.ndarray, least: float, rows: int = 8192) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of parts_within at once."""
        found = list(self.parts_within(q, least, rows))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.int64))

    def recall(self, least: float, beam: int, probes: int = 256, seed: int = 11) -> float:
        """Audit: share of sampled vectors that queries at exactly the least similarity to them find."""
        rng = np.random.default_rng(seed)
        pick = rng.choice(len(self.x), min(probes, len(self.x)), replace=False)
        v = self.x[pick].astype(np.float64)
        noise = rng.standard_normal(v.shape)
        noise -= (noise * v).sum(1, keepdims=True) * v
        size = np.linalg.norm(noise, axis=1, keepdims=True)
        if v.shape[1] < 2 or size.min() == 0:
            return 1.0
        q = ((least + 0.002) * v + np.sqrt(1 - (least + 0.002) ** 2) * noise / size).astype(np.float32)
        r, c = self.within(q, least, beam)
        return float(np.isin(np.arange(len(pick)) * len(self.x) + pick, r * len(self.x) + c).mean())

"""Hierarchical navigable small-world graphs over unit vectors, searched for many queries side by side."""

from __future__ import annotations

import numpy as np

LINKS = 16
BEAM = 48
BLOCK = 256


def _diverse(own: np.ndarray, ids: np.ndarray, likeness: np.ndarray, vectors: np.ndarray, keep: int) -> np.ndarray:
    """Of each row's candidates, best first, those nearer to the row than to any kept before; then the best of the rest.

    Such links lead out of dense groups, so that these don't cut the graph.
    """
    rows, n = ids.shape
    among = np.einsum("rad,rbd->rab", vectors[ids], vectors[ids])
    taken = np.zeros((rows, n), bool)
    for c in range(n):
        nearest = np.where(taken, among[:, c, :], -2).max(1)
        taken[:, c] = (ids[:, c] >= 0) & (likeness[:, c] > nearest) & (taken.sum(1) < keep)
    spare = np.cumsum(~taken & (ids >= 0), 1) <= (keep - taken.sum(1))[:, None]
    chosen = taken | (spare & (ids >= 0) & ~taken)
    order = np.argsort(np.where(taken, 0, np.where(chosen, 1, 2)), axis=1, kind="stable")[:, :keep]
    return np.where(np.take_along_axis(chosen, order, 1), np.take_along_axis(ids, order, 1), -1)


class Graph:
    """Layers of links; a node's layers follow from its key, so a rebuilt graph is the same."""

    def __init__(self, vectors: np.ndarray, keys: np.ndarray, beam: int = BEAM):
        self.vectors = vectors.astype(np.float32)
        n = len(vectors)
        u = np.random.default_rng(17).random(n)
        order = np.argsort(keys, kind="stable")
        level = np.zeros(n, np.int64)
        level[order] = np.minimum(-np.log(np.maximum(u, 1e-12)) / np.log(LINKS), 8).astype(np.int64)
        self.level = level
        top = int(level.max()) if n else 0
        self.layers = [np.full((n, LINKS * 2 if l == 0 else LINKS), -1, np.int32) for l in range(top + 1)]
        inserted = np.argsort(-level, kind="stable")
        self.entry = int(inserted[0]) if n else -1
        done = 0
        while done < n:
            # A batch is as large as what it is searched in; it is also compared with itself.
            batch = inserted[done : done + min(max(done, LINKS * 4), 1024)]
            self._insert(batch, inserted[:done], beam)
            done += len(batch)

    def _insert(self, batch: np.ndarray, before: np.ndarray, beam: int) -> None:
        start = None
        for l in range(len(self.layers) - 1, -1, -1):
            here = batch[self.level[batch] >= l]
            if len(before) and self.level[before[0]] >= l:
                queries = self.vectors[batch]
                ids, likeness = self.search(queries, beam, l, start)
                start = ids[:, :1]
                chosen = self.level[batch] >= l
                ids, likeness = ids[chosen], likeness[chosen]
            else:
                ids, likeness = np.full((len(here), 0), -1, np.int64), np.zeros((len(here), 0), np.float32)
            if not len(here):
                continue
            own = self.vectors[here] @ self.vectors[here].T
            np.fill_diagonal(own, -2)
            n = min(beam, len(here))
            best = np.argpartition(-own, n - 1, axis=1)[:, :n]
            ids = np.concatenate((ids, np.where(np.take_along_axis(own, best, 1) > -2, here[best], -1)), 1)
            likeness = np.concatenate((likeness, np.take_along_axis(own, best, 1)), 1)
            likeness = np.where(ids >= 0, likeness, -2)
            order = np.argsort(-likeness, axis=1, kind="stable")[:, :beam]
            ids, likeness = np.take_along_axis(ids, order, 1), np.take_along_axis(likeness, order, 1)
            if ids.shape[1] < LINKS:
                fill = ((0, 0), (0, LINKS - ids.shape[1]))
                ids, likeness = np.pad(ids, fill, constant_values=-1), np.pad(likeness, fill, constant_values=-2)
            links = self.layers[l]
            for a in range(0, len(here), BLOCK):
                links[here[a : a + BLOCK], :LINKS] = _diverse(here[a : a + BLOCK], ids[a : a + BLOCK], likeness[a : a + BLOCK], self.vectors, LINKS)
            self._link_back(l, here)

    def _link_back(self, l: int, here: np.ndarray) -> None:
        """Links from chosen neighbours; a full node keeps the most diverse."""
        links = self.layers[l]
        a, b = np.repeat(here, LINKS), links[here, :LINKS].ravel()
        a, b = a[b >= 0], b[b >= 0]
        order = np.argsort(b, kind="stable")
        a, b = a[order], b[order]
        nodes, at = np.unique(b, return_index=True)
        full_ids, full_cands = [], []
        for node, new in zip(nodes.tolist(), np.split(a, at[1:])):
            row = links[node]
            new = new[~np.isin(new, row)]
            free = np.flatnonzero(row < 0)
            if len(new) <= len(free):
                row[free[: len(new)]] = new
            else:
                full_ids.append(node)
                full_cands.append(np.concatenate((row[row >= 0], new)))
        for i in range(0, len(full_ids), BLOCK):
            ids, cands = np.array(full_ids[i : i + BLOCK]), full_cands[i : i + BLOCK]
            width = max(map(len, cands))
            table = np.full((len(ids), width), -1)
            for r, c in enumerate(cands):
                table[r, : len(c)] = c
            likeness = np.where(table >= 0, np.einsum("rcd,rd->rc", self.vectors[table], self.vectors[ids]), -2)
            order = np.argsort(-likeness, axis=1, kind="stable")[:, : max(4 * LINKS, links.shape[1])]
            links[ids] = _diverse(ids, np.take_along_axis(table, order, 1), np.take_along_axis(likeness, order, 1), self.vectors, links.shape[1])

    def search(self, queries: np.ndarray, beam: int, layer: int, start: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """The best ``beam`` nodes found on a layer for each query, best first; -1 where there are fewer."""
        parts = [self._beam(queries[a : a + BLOCK], beam, layer, None if start is None else start[a : a + BLOCK]) for a in range(0, len(queries), BLOCK)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _beam(self, queries: np.ndarray, beam: int, layer: int, start: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        n, links, width = len(queries), self.layers[layer], 4
        seen = np.zeros((n, len(self.vectors) + 1), bool)
        seen[:, -1] = True
        first = np.full((n, 1), self.entry) if start is None else np.where(start < 0, self.entry, start)
        ids, likeness, opened = np.full((n, beam), -1, np.int64), np.full((n, beam), -2, np.float32), np.ones((n, beam), bool)
        ids[:, :1], opened[:, :1] = first, False
        likeness[:, :1] = np.einsum("qcd,qd->qc", self.vectors[first], queries)
        seen[np.arange(n), first[:, 0]] = True
        live = np.arange(n)
        while len(live):
            # The beam is sorted, so the first closed ones are the best.
            closed = ~opened[live]
            rank = np.cumsum(closed, 1)
            pick = closed & (rank <= width)
            some = pick.any(1)
            live, pick = live[some], pick[some]
            if not len(live):
                break
            opened[live] |= pick
            row, col = np.nonzero(pick)
            near = links[ids[live[row], col]]
            place = (np.cumsum(pick, 1) - 1)[row, col]
            table = np.full((len(live), width, links.shape[1]), -1, np.int32)
            table[row, place] = near
            table = table.reshape(len(live), -1)
            fresh = ~seen[live[:, None], table]
            # Two opened nodes may name the same neighbour.
            seen[live[:, None], table] = True
            order = np.sort(np.where(fresh, table, -1), 1)
            order[:, 1:][order[:, 1:] == order[:, :-1]] = -1
            most = int((order >= 0).sum(1).max()) if order.size else 0
            if not most:
                continue
            order = -np.sort(-order, 1)[:, :most]
            got = np.einsum("qcd,qd->qc", self.vectors[order], queries[live])
            got = np.where(order >= 0, got, -2).astype(np.float32)
            both, all_ids = np.concatenate((likeness[live], got), 1), np.concatenate((ids[live], order), 1)
            all_open = np.concatenate((opened[live], order < 0), 1)
            best = np.argsort(-both, axis=1, kind="stable")[:, :beam]
            likeness[live], ids[live], opened[live] = (np.take_along_axis(x, best, 1) for x in (both, all_ids, all_open))
        return ids, likeness

    def find(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Search from the top layer down."""
        queries, start = queries.astype(np.float32), None
        for l in range(len(self.layers) - 1, 0, -1):
            start = self.search(queries, 1, l, start)[0]
        return self.search(queries, beam, 0, start)

    def within(self, queries: np.ndarray, beam: int, least: float) -> list[np.ndarray]:
        """Nodes with likeness of at least ``least`` (and a little less); a query whose beam is full of them is asked again with a wider one."""
        found: list[np.ndarray] = [np.empty(0, np.int64)] * len(queries)
        left = np.arange(len(queries))
        while len(left):
            beam = min(beam, len(self.vectors))
            ids, likeness = self.find(queries[left], beam)
            enough = (likeness[:, -1] < least - 1e-3) | (beam >= len(self.vectors))
            for i in np.flatnonzero(enough):
                found[left[i]] = ids[i][likeness[i] >= least - 1e-3]
            left, beam = left[~enough], beam * 4
        return found

"""Navigable small-world graphs over unit vectors (numpy, one graph per index shard)."""

from __future__ import annotations

import numpy as np

#: Nodes of a graph, links a node keeps, candidates they are chosen from, and the size under which a scan is the search.
GRAPH_NODES, LINKS, CANDIDATES, SCAN_NODES = 3000, 10, 24, 192
#: Beam widths tried in turn, and the share of exhaustively found neighbours that is enough.
BEAMS, ENOUGH = (16, 32, 64), 0.99
#: Nodes a walk starts from, nodes it opens at a time, and queries that tune a beam.
ENTRIES, STEP, PROBES = 64, 4, 40


class Graph:
    """A shard of the index: its vectors, each node's links, and a beam tuned against exhaustive search.

    A node links to near ones that are nearer to it than to each other, and back; entries are nodes spread
    over the shard. Small shards are scanned.
    """

    def __init__(self, vectors: np.ndarray, least: float, tune: np.ndarray | None = None):
        self.vectors, self.least, self.beam = vectors, least, 0
        n = len(vectors)
        if n <= SCAN_NODES:
            return
        similar = vectors @ vectors.T
        np.fill_diagonal(similar, -2)
        near = np.argpartition(-similar, CANDIDATES, axis=1)[:, :CANDIDATES]
        order = np.argsort(-np.take_along_axis(similar, near, 1), axis=1)
        near = np.take_along_axis(near, order, 1)
        links, count = np.full((n, LINKS), -1, np.int32), np.zeros(n, np.int64)
        closest = np.full((n, CANDIDATES), -2, np.float32)  # each candidate's similarity to the nearest link kept so far
        rows = np.arange(n)
        for j in range(CANDIDATES):
            kept = (similar[rows, near[:, j]] > closest[:, j]) & (count < LINKS)
            who = rows[kept]
            links[who, count[who]] = near[who, j]
            count[who] += 1
            if j + 1 < CANDIDATES:
                closest[who, j + 1 :] = np.maximum(closest[who, j + 1 :], similar[near[who, j][:, None], near[who, j + 1 :]])
        source, place = np.nonzero(links >= 0)
        target = links[source, place]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        rank = np.arange(len(target)) - np.searchsorted(target, target)
        back = np.full((n, LINKS), -1, np.int32)
        fits = rank < LINKS
        back[target[fits], rank[fits]] = source[fits]
        self.links = np.concatenate([links, back], axis=1)
        self.entries = np.linspace(0, n - 1, ENTRIES).astype(np.int64)
        probes = tune if tune is not None and len(tune) else vectors
        probes = probes[np.linspace(0, len(probes) - 1, min(len(probes), PROBES)).astype(int)]
        near = probes @ vectors.T
        exact, best = near >= least, near.argmax(1)
        has_best = np.flatnonzero(exact.any(1))
        for self.beam in BEAMS:
            found, _ = self._walk(probes, self.beam)
            met = np.zeros_like(exact)
            met[np.arange(len(probes))[:, None], np.where(found < 0, self.entries[0], found)] = True
            enough = np.minimum(exact.sum(1), self.beam)  # a full beam is followed by a scan
            if (np.minimum((met & exact).sum(1), enough)).sum() >= ENOUGH * enough.sum() and met[has_best, best[has_best]].sum() >= ENOUGH * len(has_best):
                return
        self.beam = 0  # no beam finds enough here: the shard is scanned

    def links_and_beam(self) -> tuple[bytes, int]:
        """What ``of`` needs besides the vectors: each node's links, none where the shard is scanned, and the tuned beam."""
        return (self.links.astype(np.int16).tobytes() if self.beam else b""), self.beam

    @classmethod
    def of(cls, vectors: np.ndarray, links: bytes, beam: int, least: float) -> Graph:
        """A graph from what was stored of it."""
        graph = cls.__new__(cls)
        graph.vectors, graph.least, graph.beam = vectors, least, beam
        if beam:
            graph.links = np.frombuffer(links, np.int16).astype(np.int32).reshape(len(vectors), -1)
            graph.entries = np.linspace(0, len(vectors) - 1, ENTRIES).astype(np.int64)
        return graph

    def _walk(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, similarities)`` of the ``beam`` best nodes that each query's walk meets; -1 pads.

        Every step opens the ``STEP`` best unopened nodes of each beam at once and measures only nodes not seen before.
        """
        b, n = len(queries), len(self.vectors)
        links = np.full((n + 1, self.links.shape[1]), n, np.int64)  # node n stands for no link and counts as seen
        np.copyto(links[:n], self.links, where=self.links >= 0)
        seen, mark = np.zeros(b * (n + 1), bool), np.empty(b * (n + 1), np.int32)
        near = queries @ self.vectors[self.entries].T
        ids = np.broadcast_to(self.entries, near.shape).copy()
        seen.reshape(b, n + 1)[:, self.entries] = True
        seen[n :: n + 1] = True
        done = np.zeros(near.shape, bool)
        active = np.arange(b)
        out_ids, out_near = np.full((b, beam), -1, np.int64), np.full((b, beam), -2, np.float32)
        along = lambda a, places: a.take(places + (np.arange(len(a)) * a.shape[1])[:, None])
        while len(active):
            if near.shape[1] > beam:
                best = np.argpartition(-near, beam - 1, axis=1)[:, :beam]
                ids, near, done = (along(a, best) for a in (ids, near, done))
            open_ = np.where(done, np.float32(-3), near)
            width = min(STEP, open_.shape[1])
            pick = np.argpartition(-open_, width - 1, axis=1)[:, :width]
            value = along(open_, pick)
            going = (value > -2).any(1)
            if not going.all():
                stop = active[~going]
                out_ids[stop, : ids.shape[1]], out_near[stop, : ids.shape[1]] = ids[~going], near[~going]
                active, ids, near, done, pick, value = active[going], ids[going], near[going], done[going], pick[going], value[going]
                if not len(active):
                    break
            np.put_along_axis(done, pick, True, 1)
            opened = np.where(value > -2, along(ids, pick), n)
            spots = (links.take(opened, 0).reshape(len(active), -1) + (active * (n + 1))[:, None]).ravel()
            fresh = np.flatnonzero(~seen.take(spots))
            spot, order = spots[fresh], np.arange(len(fresh), dtype=np.int32)
            mark[spot[::-1]] = order[::-1]  # of a node that is linked twice the first stays
            first = mark[spot] == order
            spot, row = spot[first], fresh[first] // (len(spots) // len(active))
            seen[spot] = True
            node = spot - active[row] * (n + 1)
            count = np.bincount(row, minlength=len(active))
            place = np.arange(len(row)) - (np.cumsum(count) - count)[row]
            more, more_near = np.zeros((len(active), count.max()), np.int64), np.full((len(active), count.max()), -2, np.float32)
            more[row, place] = node
            more_near[row, place] = np.einsum("kd,kd->k", self.vectors.take(node, 0), queries.take(active[row], 0))
            ids, near, done = np.concatenate([ids, more], 1), np.concatenate([near, more_near], 1), np.concatenate([done, more_near <= -2], 1)
        return out_ids, out_near

    def search(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(query, node)`` of the pairs at least as similar as the graph is made for, as far as the beam finds them.

        Where a whole beam is that similar, more such nodes may lie outside: those queries scan the shard.
        """
        if not self.beam:
            return np.nonzero(queries @ self.vectors.T >= self.least)
        ids, near = self._walk(queries, self.beam)
        hit = (ids >= 0) & (near >= self.least)
        full = hit.all(1)
        q, place = np.nonzero(hit & ~full[:, None])
        again = np.flatnonzero(full)
        q2, node2 = np.nonzero(queries[again] @ self.vectors.T >= self.least) if len(again) else (np.zeros(0, int), np.zeros(0, int))
        return np.concatenate([q, again[q2]]), np.concatenate([ids[q, place], node2])

"""A hierarchical navigable small-world graph in numpy, built and searched in batches.

Nodes are ordered by level, highest first, so layer l holds nodes 0 to its size - 1 and
a neighbour table is one matrix, padded with -1. Nodes of a batch are inserted together:
they search the layer as it stands and compare with one another directly. Neighbours are
chosen so that none is closer to a chosen one than to the node, then filled up with the
nearest. A search moves the beams of a batch of queries in step: the best nodes not yet
expanded of every beam are expanded at once.
"""

from __future__ import annotations

import numpy as np

LINKS = 16  # neighbours a node has in upper layers; twice as many in the lowest
BUILD_BEAM = 64
STEP = 3  # nodes of a beam expanded at once
BATCH = 512


class Graph:
    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray]):
        """``vectors``: unit rows in float32, in order of level; ``layers``: neighbour
        tables, lowest first."""
        self.x, self.layers = vectors, layers

    def entries(self, queries: np.ndarray, down_to: int) -> np.ndarray:
        """The best node found in the layers above ``down_to``, for every query."""
        at = np.zeros((len(queries), 1), np.int64)
        for layer in reversed(self.layers[down_to + 1 :]):
            at = self.beams(queries, layer, at, 1)[0]
        return at

    def search(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, similarities), best first, of ``width`` nodes a query."""
        return self.beams(queries, self.layers[0], self.entries(queries, 0), width)

    def beams(self, queries, layer, start, width):
        n, x = len(queries), self.x
        nodes = np.full((n, width), -1, np.int64)
        sims = np.full((n, width), -np.inf, np.float32)
        done = np.ones((n, width), bool)
        seen = np.zeros((n, len(layer) + 1), bool)  # the last column takes the padding
        seen[:, -1] = True
        some = min(start.shape[1], width)
        nodes[:, :some] = start[:, :some]
        rows = np.arange(n)
        sims[:, :some] = np.einsum("qkd,qd->qk", x[start[:, :some]], queries)
        done[:, :some] = False
        seen[rows[:, None], start] = True
        active = rows
        while len(active):
            open_sims = np.where(done[active], -np.inf, sims[active])
            step = min(STEP, width)
            best = np.argpartition(-open_sims, step - 1, axis=1)[:, :step]
            real = np.take_along_axis(open_sims, best, 1) > -np.inf
            going = real.any(1)
            active, best, real = active[going], best[going], real[going]
            if not len(active):
                break
            at = np.where(real, np.take_along_axis(nodes[active], best, 1), -1)
            done[active[:, None], best] = True
            near = np.where(at[:, :, None] >= 0, layer[at], -1).reshape(len(active), -1)
            near = np.sort(near, axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            new = ~seen[active[:, None], near]
            r, c = np.nonzero(new)
            found = near[r, c]
            seen[active[r], found] = True
            got = np.full(near.shape, -np.inf, np.float32)
            got[r, c] = np.einsum("ij,ij->i", x[found], queries[active[r]])
            all_sims = np.concatenate([sims[active], got], axis=1)
            all_nodes = np.concatenate([nodes[active], near], axis=1)
            all_done = np.concatenate([done[active], got == -np.inf], axis=1)
            keep = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
            sims[active] = np.take_along_axis(all_sims, keep, 1)
            nodes[active] = np.take_along_axis(all_nodes, keep, 1)
            done[active] = np.take_along_axis(all_done, keep, 1)
        order = np.argsort(-sims, axis=1, kind="stable")
        sims = np.take_along_axis(sims, order, 1)
        return np.where(sims > -np.inf, np.take_along_axis(nodes, order, 1), -1), sims


def chosen(x: np.ndarray, nodes: np.ndarray, sims: np.ndarray, links: int) -> np.ndarray:
    """``links`` neighbours of each row out of its candidates (best first, -1: none)."""
    n, c = nodes.shape
    vectors = x[nodes]
    among = np.matmul(vectors, vectors.transpose(0, 2, 1))
    valid = nodes >= 0
    kept = np.zeros((n, c), bool)
    for j in range(c):
        closer = (kept[:, :j] & (among[:, j, :j] > sims[:, j, None])).any(1)
        kept[:, j] = valid[:, j] & ~closer & (kept[:, :j].sum(1) < links)
    rank = np.where(valid, np.where(kept, 0, c), 2 * c) + np.arange(c)
    order = np.argsort(rank, axis=1)[:, :links]
    out = np.where(np.take_along_axis(valid, order, 1), np.take_along_axis(nodes, order, 1), -1)
    if out.shape[1] < links:
        out = np.pad(out, ((0, 0), (0, links - out.shape[1])), constant_values=-1)
    return out


def _linked_back(x, layer, sources, targets, links):
    """Add ``sources`` to the neighbours of ``targets``; full rows are chosen anew."""
    order = np.argsort(targets, kind="stable")
    targets, sources = targets[order], sources[order]
    rows, first, counts = np.unique(targets, return_index=True, return_counts=True)
    # targets with few new neighbours and those with many are not padded alike
    for low, high in ((1, 16), (17, 256), (257, len(sources))):
        which = np.flatnonzero((counts >= low) & (counts <= high))
        if not len(which):
            continue
        wide = min(int(counts[which].max()), 512)
        for part in np.array_split(which, max(1, len(which) * (wide + links) ** 2 // (1 << 22))):
            at = first[part][:, None] + np.arange(wide)
            more = np.where(np.arange(wide) < counts[part][:, None],
                            sources[np.minimum(at, len(sources) - 1)], -1)
            nodes = np.concatenate([layer[rows[part]], more], axis=1)
            sims = np.einsum("qkd,qd->qk", x[nodes], x[rows[part]])
            sims = np.where(nodes >= 0, sims, -np.inf)
            best = np.argsort(-sims, axis=1, kind="stable")
            nodes, sims = np.take_along_axis(nodes, best, 1), np.take_along_axis(sims, best, 1)
            full = (nodes >= 0).sum(1) > links
            layer[rows[part]] = nodes[:, :links]
            if full.any():
                layer[rows[part][full]] = chosen(x, nodes[full], sims[full], links)


def levels(n: int, seed: int) -> np.ndarray:
    draw = np.random.default_rng(seed).random(n)
    return np.floor(-np.log(1 - draw) / np.log(LINKS)).astype(np.int64)


def built(vectors: np.ndarray, seed: int = 0) -> tuple[np.ndarray, list[np.ndarray]]:
    """(order, layers): the order of nodes by level, and the neighbour tables."""
    height = levels(len(vectors), seed)
    order = np.argsort(-height, kind="stable")
    x, height = vectors[order], height[order]
    layers: list[np.ndarray] = []  # highest first until the end
    for level in range(int(height.max(initial=0)), -1, -1):
        size = int((height >= level).sum())
        links = LINKS if level else 2 * LINKS
        layer = np.full((size, links), -1, np.int64)
        # entries come from the layer above, so its nodes (a sixteenth) are joined first
        at = max(min(size, BATCH), len(layers[-1]) if layers else 0)
        _joined(x, layer, 0, at, np.zeros((at, 0), np.int64), np.zeros((at, 0), np.float32), links)
        while at < size:
            end = min(size, at + min(BATCH, at))
            # layer rows behind ``at`` are empty and nothing leads there yet
            graph = Graph(x, [layer[:at], *layers[::-1]])
            nodes, sims = graph.search(x[at:end], min(BUILD_BEAM, at))
            _joined(x, layer, at, end, nodes, sims, links)
            at = end
        layers.append(layer)
    return order, layers[::-1]


def _joined(x, layer, at, end, nodes, sims, links):
    """Insert nodes ``at`` to ``end``, whose nearest earlier nodes are given."""
    among = x[at:end] @ x[at:end].T
    np.fill_diagonal(among, -np.inf)
    k = min(BUILD_BEAM, end - at)
    best = np.argpartition(-among, k - 1, axis=1)[:, :k]
    own = np.take_along_axis(among, best, 1)
    nodes = np.concatenate([nodes, np.where(own > -np.inf, best + at, -1)], axis=1)
    sims = np.concatenate([sims, own], axis=1)
    order = np.argsort(-sims, axis=1, kind="stable")[:, :BUILD_BEAM]
    nodes, sims = np.take_along_axis(nodes, order, 1), np.take_along_axis(sims, order, 1)
    picked = chosen(x, nodes, sims, links)
    layer[at:end] = picked
    r, c = np.nonzero(picked >= 0)
    _linked_back(x, layer, at + r, picked[r, c], links)

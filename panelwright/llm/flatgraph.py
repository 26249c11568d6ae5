"""A robust-pruned flat graph over one block of unit vectors: building it, and searching it by range.

Both work on batches of vectors at once, as matrices. Nodes are places in the block;
an adjacency is a matrix of places, -1 where a node has fewer neighbours.
"""

from __future__ import annotations

import numpy as np

_BATCH = 256


def medoids(x: np.ndarray, most: int = 8) -> np.ndarray:
    """Places to begin searches at: the row nearest to the mean, then each time the row farthest from those taken."""
    taken = [int(np.argmax(x @ x.mean(axis=0)))]
    nearest = x @ x[taken[0]]
    while len(taken) < min(most, len(x)):
        taken.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, x @ x[taken[-1]])
    return np.array(sorted(set(taken)))


def _fresh(near: np.ndarray, seen: np.ndarray, stamp: np.ndarray) -> np.ndarray:
    """Which places of near (a row a query, -1 for none) are seen for the first time; they are marked as seen."""
    rows = np.arange(len(near))[:, None]
    place = np.maximum(near, 0)
    columns = np.broadcast_to(np.arange(near.shape[1], dtype=stamp.dtype), near.shape)
    new = (near >= 0) & ~seen[rows, place]
    r, c = np.nonzero(new)
    stamp[r, near[r, c]] = columns[r, c]
    new[r, c] = stamp[r, near[r, c]] == columns[r, c]
    r, c = np.nonzero(new)
    seen[r, near[r, c]] = True
    return new


def greedy(x: np.ndarray, adjacency: np.ndarray, start: np.ndarray, q: np.ndarray, width: int, own: np.ndarray | None = None, at_once: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-first search of queries q from ``start``, and from each one's own place if it has one (else -1), with a beam of ``width``: (beam places, their cosines, cosines of all places seen, -2 elsewhere)."""
    m, rows = len(q), np.arange(len(q))[:, None]
    seen, stamp = np.zeros((m, len(x)), dtype=bool), np.zeros((m, len(x)), dtype=np.int32)
    known = np.full((m, len(x)), -2.0, dtype=np.float32)
    near = np.hstack([np.broadcast_to(start, (m, len(start))), (np.full(m, -1) if own is None else own)[:, None]])
    new = _fresh(near, seen, stamp)
    r, c = np.nonzero(new)
    known[r, near[r, c]] = np.einsum("ij,ij->i", q[r], x[near[r, c]])
    cosine = np.where(new, known[rows, np.maximum(near, 0)], np.float32(-2))
    order = np.argsort(-cosine, axis=1, kind="stable")[:, :width]
    k = order.shape[1]
    beam, best = np.full((m, width), -1), np.full((m, width), -2.0, dtype=np.float32)
    beam[:, :k], best[:, :k] = np.where(new[rows, order], near[rows, order], -1), cosine[rows, order]
    done = beam < 0
    while not done.all():
        pick = np.argsort(np.where(done, 3.0, -best), axis=1, kind="stable")[:, :at_once]
        live = ~done[rows, pick]
        done[rows, pick] = True
        near = np.where(live[:, :, None], adjacency[np.maximum(beam[rows, pick], 0)], -1).reshape(m, -1)
        new = _fresh(near, seen, stamp)
        r, c = np.nonzero(new)
        cosine = np.full(near.shape, -2.0, dtype=np.float32)
        cosine[r, c] = np.einsum("ij,ij->i", q[r], x[near[r, c]])
        known[r, near[r, c]] = cosine[r, c]
        every, places, flags = np.hstack([best, cosine]), np.hstack([beam, np.where(new, near, -1)]), np.hstack([done, ~new])
        keep = np.argsort(-every, axis=1, kind="stable")[:, :width]
        best, beam, done = every[rows, keep], places[rows, keep], flags[rows, keep]
    return beam, best, known


def robust_prune(x: np.ndarray, node: np.ndarray, places: np.ndarray, degree: int, alpha: float = 1.2) -> np.ndarray:
    """Up to ``degree`` neighbours of each node among its candidate places (-1 for none): the nearest left, which removes those that it is nearer to by alpha."""
    own = np.einsum("bd,bcd->bc", x[node], x[np.maximum(places, 0)])
    alive = (places >= 0) & (places != node[:, None])
    order = np.argsort(np.where(alive, -own, 3.0), axis=1, kind="stable")
    places, own, alive = (np.take_along_axis(v, order, 1) for v in (places, own, alive))
    alive[:, 1:] &= places[:, 1:] != places[:, :-1]
    vectors = x[np.maximum(places, 0)]
    apart, far = 2 - 2 * np.matmul(vectors, vectors.transpose(0, 2, 1)), 2 - 2 * own
    out, rows = np.full((len(node), degree), -1), np.arange(len(node))
    for k in range(degree):
        if not alive.any():
            break
        first = np.argmax(alive, axis=1)
        some = alive[rows, first]
        out[some, k] = places[rows, first][some]
        alive &= alpha**2 * apart[rows, first] > far
        alive[rows, first] = False
    return out


def _add_reverse(x: np.ndarray, adjacency: np.ndarray, count: np.ndarray, source: np.ndarray, target: np.ndarray, degree: int) -> None:
    """Edges target to source, pruned where a node has no room."""
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    nodes, first, more = np.unique(target, return_index=True, return_counts=True)
    place = np.arange(len(target)) - np.repeat(first, more)
    roomy = np.repeat(count[nodes] + more <= adjacency.shape[1], more)
    adjacency[target[roomy], count[target[roomy]] + place[roomy]] = source[roomy]
    full = count[nodes] + more > adjacency.shape[1]
    count[nodes[~full]] += more[~full]
    heavy = np.flatnonzero(full)[np.argsort(more[full], kind="stable")]
    for a in range(0, len(heavy), _BATCH):
        part = heavy[a : a + _BATCH]
        added = np.full((len(part), int(more[part].max())), -1)
        columns = np.arange(added.shape[1])
        some = columns < more[part][:, None]
        added[some] = source[(first[part][:, None] + columns)[some]]
        node, places = nodes[part], np.hstack([adjacency[nodes[part]], added])
        if places.shape[1] > 3 * degree:
            cosine = np.where(places >= 0, np.einsum("bd,bcd->bc", x[node], x[np.maximum(places, 0)]), -2)
            places = np.take_along_axis(places, np.argpartition(-cosine, 3 * degree, axis=1)[:, : 3 * degree], 1)
        kept = robust_prune(x, node, places, degree)
        adjacency[node] = -1
        adjacency[node, :degree] = kept
        count[node] = (kept >= 0).sum(axis=1)


def build(x: np.ndarray, degree: int = 16, width: int = 24, seed: int = 7) -> np.ndarray:
    """The adjacency of unit vectors x: batches of doubling size are searched for in the graph so far, pruned, and linked back."""
    n = len(x)
    adjacency, count = np.full((n, 3 * degree // 2), -1), np.zeros(n, dtype=np.int64)
    start = medoids(x)
    for a in start:
        others = start[start != a]
        adjacency[a, : len(others)] = others
        count[a] = len(others)
    rest = np.setdiff1d(np.random.default_rng(seed).permutation(n), start, assume_unique=True)
    rest = np.random.default_rng(seed).permutation(rest)
    at, size = 0, 8
    while at < len(rest):
        batch = rest[at : at + size]
        beam, _, _ = greedy(x, adjacency, start, x[batch], width)
        found = robust_prune(x, batch, beam, degree)
        adjacency[batch, :degree] = found
        count[batch] = (found >= 0).sum(axis=1)
        r, c = np.nonzero(found >= 0)
        _add_reverse(x, adjacency, count, batch[r], found[r, c], degree)
        at, size = at + size, min(2 * size, _BATCH)
    return _reachable(adjacency, start)


def _reachable(adjacency: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The adjacency with edges to nodes that pruning has cut off from ``start``: each gets one from its nearest neighbour that is reached, or else from the first of start."""
    reached, fresh = np.zeros(len(adjacency), dtype=bool), start
    while True:
        while len(fresh):
            reached[fresh] = True
            near = np.unique(adjacency[fresh])
            fresh = near[(near >= 0) & ~reached[np.maximum(near, 0)]]
        lost = np.flatnonzero(~reached)
        if not len(lost):
            return adjacency
        known = (adjacency[lost] >= 0) & reached[adjacency[lost]]
        some = known.any(axis=1)
        source = adjacency[lost, np.argmax(known, axis=1)]
        if not some.any():
            source, some = np.full(len(lost), start[0]), np.arange(len(lost)) == 0
        lost, source = lost[some], source[some]
        order = np.argsort(source, kind="stable")
        lost, source = lost[order], source[order]
        place = np.arange(len(source)) - np.searchsorted(source, source)
        more = np.full((len(adjacency), int(place.max()) + 1), -1)
        more[source, place] = lost
        adjacency, fresh = np.hstack([adjacency, more]), lost


def both_ways(adjacency: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, places): the neighbours of each node over edges of either direction."""
    node, k = np.nonzero(adjacency >= 0)
    near, n = adjacency[node, k], len(adjacency)
    edges = np.unique(np.r_[node * n + near, near * n + node])
    return np.searchsorted(edges, np.arange(n + 1) * n), edges % n


def range_search(x: np.ndarray, adjacency: np.ndarray, edges: tuple[np.ndarray, np.ndarray], start: np.ndarray, q: np.ndarray, least: float, width: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(query, place) of pairs of cosine ``least`` or more: a greedy search along the graph, then, over its edges of either direction, the neighbours of all in range until none is new.

    A node that many others crowd out of the lists of its neighbours is still found from them.
    """
    known, (offsets, flat) = greedy(x, adjacency, start, q, width, own)[2], edges
    opened, count = np.zeros(known.shape, dtype=bool), np.diff(offsets)
    while True:
        r, c = np.nonzero((known >= least) & ~opened)
        if not len(r):
            return np.nonzero(known >= least)
        opened[r, c] = True
        for a in range(0, len(r), 20_000):
            i, j = r[a : a + 20_000], c[a : a + 20_000]
            many = count[j]
            near = flat[np.arange(many.sum()) + np.repeat(offsets[j] - np.cumsum(many) + many, many)]
            who = np.repeat(i, many)
            new = known[who, near] == -2.0
            who, near = np.divmod(np.unique(who[new] * np.int64(known.shape[1]) + near[new]), known.shape[1])
            known[who, near] = np.einsum("ij,ij->i", q[who], x[near])

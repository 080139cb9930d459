"""Louvain over arrays: the levels of a graph that fits one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

GAIN = 1e-9  # a move must bring more than this, in units of edge weight
LONG = 256  # neighbours from which arrays are quicker than a dictionary


class Level:
    """One level: pairs ``a < b`` of 0..n-1 with weights, and the weight ``loop`` of each node to itself, both directions."""

    def __init__(self, n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, loop: np.ndarray):
        self.n, self.a, self.b, self.w, self.loop = n, a, b, w, loop
        self.k = np.bincount(a, w, n) + np.bincount(b, w, n) + loop
        self.m2 = float(self.k.sum())
        ends = np.concatenate([a, b])
        order = np.argsort(ends, kind="stable")
        self.at = np.concatenate([[0], np.cumsum(np.bincount(ends, minlength=n))])
        del ends
        self.to = np.concatenate([b, a])[order]
        self.by = np.concatenate([w, w])[order]

    def modularity(self, c: np.ndarray) -> float:
        same = c[self.a] == c[self.b]
        return float((2 * self.w[same].sum() + self.loop.sum()) / self.m2 - (np.bincount(c, self.k, self.n) ** 2).sum() / self.m2**2)

    def settle(self, start: np.ndarray, sweeps: int, eps: float) -> tuple[np.ndarray, bool]:
        """(community of each node, whether it settled), from the communities ``start``, numbers below n. Nodes move one
        after the other, each where it gains most, of equal gains to the lowest community. After a sweep of all nodes only
        those are looked at again whose neighbours moved; when none is left, all are, and the level is settled once such
        a sweep moves none or brings less than ``eps``. It is cut when ``sweeps`` times half of the nodes have been
        looked at."""
        at, k, m2 = self.at.tolist(), self.k.tolist(), self.m2
        c, tot, sums = start.copy(), np.bincount(start, self.k, self.n), np.zeros(self.n)
        cl, tl = c.tolist(), tot.tolist()
        todo, whole, left = range(self.n), True, sweeps * self.n // 2
        while left > 0:
            again, brought = set(), 0.0
            for v in todo:
                if not left:
                    break
                left -= 1
                lo, hi, now, kv = at[v], at[v + 1], cl[v], k[v]
                if lo == hi:
                    continue
                per, rest = kv / m2, tl[now] - kv
                if hi - lo < LONG:
                    to = self.to[lo:hi].tolist()
                    own: dict[int, float] = {}
                    for u, w in zip(to, self.by[lo:hi].tolist()):
                        x = cl[u]
                        own[x] = own.get(x, 0.0) + w
                    stay = own.pop(now, 0.0) - rest * per
                    best, top = now, stay + GAIN
                    for x, w in own.items():
                        g = w - tl[x] * per
                        if g > top or (g == top and best != now and x < best):
                            best, top = x, g
                else:
                    to = self.to[lo:hi]
                    x = c[to]
                    np.add.at(sums, x, self.by[lo:hi])
                    g = sums[x] - tot[x] * per
                    stay = sums[now] - rest * per
                    g[x == now] = -np.inf
                    sums[x] = 0.0
                    top = g.max()
                    best = int(x[g == top].min()) if top > stay + GAIN else now
                if best != now:
                    brought += top - stay
                    tl[now] -= kv
                    tl[best] += kv
                    tot[now], tot[best] = tl[now], tl[best]
                    c[v] = cl[v] = best
                    if hi - lo < LONG:
                        again.update(u for u in to if cl[u] != best)
                    else:
                        again.update(to[c[to] != best].tolist())
            else:
                if whole and 2 * brought / m2 < eps:
                    return c, True
                whole = not again
                todo = range(self.n) if whole else sorted(again)
        return c, False

    def merged(self, c: np.ndarray) -> tuple[Level, np.ndarray]:
        """The graph of the communities, and the number of each node's community there."""
        names, c = np.unique(c, return_inverse=True)
        n, a, b = len(names), c[self.a], c[self.b]
        loop = np.bincount(c, self.loop, n) + 2 * np.bincount(a[a == b], self.w[a == b], n)
        keys, at = np.unique((np.minimum(a, b) * n + np.maximum(a, b))[a != b], return_inverse=True)
        return Level(n, (keys // n).astype(np.int32), (keys % n).astype(np.int32), np.bincount(at, self.w[a != b], len(keys)), loop), c


def communities(a: np.ndarray, b: np.ndarray, w: np.ndarray, rounds: int, sweeps: int, eps: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, float]]]:
    """(nodes, the smallest node of each one's community, cuts) of the pairs ``a <= b``, each once; ``a = b`` is what a
    node weighs to itself in both directions. When the levels bring nothing more, they are run again from the first one
    and the communities found, until no node of it gains either. Cuts are (level, modularity), -1 where the number of
    levels ended the run."""
    nodes = np.unique(np.concatenate([np.unique(a), np.unique(b)]))
    a, b = (np.searchsorted(nodes, x).astype(np.int32) for x in (a, b))
    n, off = len(nodes), a != b
    g = Level(n, a[off], b[off], w[off], np.bincount(a[~off], w[~off], n))
    whole, label, best, cuts = g, np.arange(n), g.modularity(np.arange(n)), []
    for _ in range(rounds):
        before, g, up, start = best, whole, np.arange(n), label
        for level in range(rounds):
            c, settled = g.settle(start, sweeps, eps)
            q = g.modularity(c)
            if not settled:
                cuts.append((level, q))
            if q - best < eps:
                break
            best = q
            g, c = g.merged(c)
            label = up = c[up]
            start = np.arange(g.n)
        else:
            cuts.append((-1, best))
            break
        if best - before < eps:
            break
    else:
        cuts.append((-1, best))
    first = np.full(n, n)
    np.minimum.at(first, label, np.arange(n))
    return nodes, nodes[first[label]], cuts


def in_one_task(rounds: int, sweeps: int, eps: float):
    """For ``mapInArrow`` over one partition of (a, b, w): rows (node, community, level, q); a row without a node is a cut."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        parts = [[x.to_numpy(zero_copy_only=False) for x in batch.columns] for batch in batches if batch.num_rows]
        if not parts:
            return
        pairs = [np.concatenate(x) for x in zip(*parts)]
        parts.clear()
        nodes, label, cuts = communities(pairs.pop(0), pairs.pop(0), pairs.pop(0), rounds, sweeps, eps)
        names = ["node", "community", "level", "q"]
        for i in range(0, len(nodes), 100_000):
            x, y = nodes[i : i + 100_000], label[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.nulls(len(x), pa.int32()), pa.nulls(len(x), pa.float64())], names)
        if cuts:
            none = pa.nulls(len(cuts), pa.from_numpy_dtype(nodes.dtype))
            yield pa.RecordBatch.from_arrays([none, none, pa.array([x for x, _ in cuts], pa.int32()), pa.array([q for _, q in cuts], pa.float64())], names)

    return run

"""Exact threshold pairs by cosine: cover trees, and a traversal of two of them at once.

Angles are distances on the sphere. A node is a centre, the points it covers and the largest angle
between them; its children lie within half its level's radius. Two nodes whose centres lie further
apart than the threshold and both radii hold no pair and are passed over; where all of both nodes
lies within the threshold, every pair links and is counted without being looked at. What is left is
taken apart, the children of one node against those of the other in one product.
"""

from __future__ import annotations

import numpy as np

#: Room for rounding: angles this near a bound are looked at, cosines this near the threshold computed term by term.
SLACK = 1e-7
CANDIDATES, BLOCK = 256, 1024


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each vector divided by the power of two next to its largest component: the same cosines, and no overflow."""
    top = np.abs(vectors).max(1, keepdims=True)
    return np.ldexp(vectors, -np.frexp(top)[1]) + 0.0


def units(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1, 1))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of paired rows, sums taken over the components in their order."""
    dot, aa, bb = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    for x, y in zip(a.T, b.T, strict=True):
        dot += x * y
        aa += x * x
        bb += y * y
    return dot / (np.sqrt(aa) * np.sqrt(bb))


def covering(u: np.ndarray, at: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Centres among the points `at`, no two within the radius, and each point's nearest of those that were near when it was covered; at[0] is a centre."""
    centres: list[np.ndarray] = []
    owner = np.empty(len(at), np.int64)
    left, many = np.arange(len(at)), 0
    bound = np.cos(radius)
    while len(left):
        some = left[:CANDIDATES]
        among = u[at[some]] @ u[at[some]].T
        open_, chosen = np.ones(len(some), bool), []
        for i in range(len(some)):
            if open_[i]:
                chosen.append(i)
                open_ &= among[i] < bound
                open_[i] = False
        picked = some[chosen]
        near = u[at[left]] @ u[at[picked]].T
        which = near.argmax(1)
        top = near[np.arange(len(left)), which]
        which[np.searchsorted(left, picked)] = np.arange(len(picked))  # a centre covers itself
        done = top >= bound
        done[np.searchsorted(left, picked)] = True
        owner[left[done]] = many + which[done]
        centres.append(picked)
        many += len(picked)
        left = left[~done]
    return np.concatenate(centres), owner


class CoverTree:
    """Nodes over points in an order in which every node's points are neighbours: those of node i lie in [lo, hi)."""

    def __init__(self, x: np.ndarray, weight: np.ndarray):
        u = units(x)
        self.order: list[int] = []
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.lo: list[int] = []
        self.hi: list[int] = []
        self.children: list[np.ndarray | None] = []
        if len(x):
            self._node(u, np.arange(len(x)))
        order = np.array(self.order, np.int64)
        self.x, self.u, self.weight, self.order = x[order], u[order], weight[order], order
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.centre = place[np.array(self.centre, np.int64)]
        self.radius, self.lo, self.hi = np.array(self.radius), np.array(self.lo, np.int64), np.array(self.hi, np.int64)
        self.total = np.append(0, np.cumsum(self.weight))

    def _node(self, u: np.ndarray, at: np.ndarray) -> int:
        """Build the node of the points `at`, the first of which is its centre, and return its number."""
        me = len(self.centre)
        d = angles(u[at], u[at[:1]]).ravel()
        d[0] = 0
        radius = float(d.max())
        for part, value in ((self.centre, at[0]), (self.radius, radius), (self.lo, len(self.order)), (self.hi, 0), (self.children, None)):
            part.append(value)
        if len(at) == 1:
            self.order.append(int(at[0]))
        else:
            level = np.pi / 2
            while level >= radius > SLACK:
                level /= 2
            centres = owner = np.arange(len(at))  # points of one direction are children each
            if radius > SLACK:
                found = covering(u, at, level)
                if len(found[0]) > 1:  # one at the border of a level, by rounding
                    centres, owner = found
            by = np.argsort(owner, kind="stable")
            cuts = np.append(np.searchsorted(owner[by], np.arange(len(centres))), len(at))
            own = []
            for k, c in enumerate(centres):
                members = by[cuts[k] : cuts[k + 1]]
                own.append(self._node(u, at[np.append(c, members[members != c])]))
            self.children[me] = np.array(own, np.int64)
        self.hi[me] = len(self.order)
        return me

    def weight_of(self, nodes: np.ndarray) -> np.ndarray:
        return self.total[self.hi[nodes]] - self.total[self.lo[nodes]]


class Links:
    """Counts of linked weight and the components of points; the points of all trees share one numbering from `first`."""

    def __init__(self, sizes: list[int]):
        self.count = np.zeros(sum(sizes), np.int64)
        self.root = np.arange(sum(sizes))

    def find(self, i: np.ndarray) -> np.ndarray:
        while True:
            up = self.root[i]
            if (up == i).all():
                return i
            i = up

    def unite(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            i, j = self.find(i), self.find(j)
            apart = i != j
            i, j = np.maximum(i, j)[apart], np.minimum(i, j)[apart]
            np.minimum.at(self.root, i, j)


def dual(a: CoverTree, b: CoverTree, links: Links, first_a: int, first_b: int, cosine: float) -> None:
    """Add to `links` what pairs of a point of `a` and one of `b` link; with a tree and itself every point also meets itself."""
    if not len(a.order) or not len(b.order):
        return
    t = float(np.arccos(cosine))
    same = a is b
    add = [np.zeros(len(a.order) + 1, np.int64), np.zeros(len(b.order) + 1, np.int64)]
    joined = [np.zeros(len(a.order) + 1, np.int64), np.zeros(len(b.order) + 1, np.int64)]
    stack = [(0, 0)]

    def whole_of(tree: CoverTree, side: int, nodes: np.ndarray, weight: np.ndarray) -> None:
        """All points of the nodes link that weight, and so lie in one component: each joins the one before it."""
        for change, begin, value in ((add[side], tree.lo[nodes], weight), (joined[side], tree.lo[nodes] + 1, 1)):
            np.add.at(change, begin, value)
            np.subtract.at(change, tree.hi[nodes], value)

    def parts(tree: CoverTree, node: int) -> np.ndarray:
        return tree.children[node] if tree.children[node] is not None else np.array([node])

    while stack:
        p, q = stack.pop()
        left, right = parts(a, p), parts(b, q)
        for at in range(0, len(left), BLOCK):
            own = left[at : at + BLOCK]
            for to in range(at if same and p == q else 0, len(right), BLOCK):
                other = right[to : to + BLOCK]
                product = a.u[a.centre[own]] @ b.u[b.centre[other]].T
                radii = a.radius[own][:, None] + b.radius[other][None] if a.radius[own].any() or b.radius[other].any() else 0.0
                i, j = np.nonzero(product >= np.cos(np.minimum(t + radii + SLACK, np.pi)) - 1e-12)
                if same and p == q:
                    upper = own[i] <= other[j]
                    i, j = i[upper], j[upper]
                if not len(i):
                    continue
                n, m, d = own[i], other[j], np.arccos(np.clip(product[i, j], -1, 1))
                if same:
                    d[n == m] = 0  # of a node with itself: all within twice its radius
                rn, rm = a.radius[n], b.radius[m]
                all_in = d + rn + rm <= t - SLACK
                points = ~all_in & (a.hi[n] - a.lo[n] == 1) & (b.hi[m] - b.lo[m] == 1)
                if points.any():
                    k = np.flatnonzero(points)
                    x, y = a.centre[n[k]], b.centre[m[k]]
                    linked = d[k] <= t - SLACK
                    doubt = np.flatnonzero(~linked & (d[k] <= t + SLACK))
                    linked[doubt] = cosines(a.x[x[doubt]], b.x[y[doubt]]) >= cosine
                    all_in[k[linked]] = True
                k = np.flatnonzero(all_in)
                if len(k):
                    n_in, m_in = n[k], m[k]
                    links.unite(first_a + a.centre[n_in], first_b + b.centre[m_in])
                    whole_of(a, 0, n_in, b.weight_of(m_in))
                    once = np.ones(len(k), bool) if not same else n_in != m_in
                    whole_of(b, 1, m_in[once], a.weight_of(n_in[once]))
                k = np.flatnonzero(~all_in & ~points)
                stack.extend(zip(n[k].tolist(), m[k].tolist(), strict=True))
    for tree, side, first in ((a, 0, first_a), (b, 1, first_b)):
        links.count[first : first + len(tree.order)] += np.cumsum(add[side])[:-1]
        inside = np.flatnonzero(np.cumsum(joined[side])[:-1] > 0)
        links.unite(first + inside, first + inside - 1)

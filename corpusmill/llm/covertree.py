"""Cover trees over blocks of integer vectors, and the dual-tree step that
finds each vector's nearest centroid."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Vectors of a leaf.
LEAF = 16


def margin(largest: float, d: int) -> float:
    """What rounding can add to a distance computed in doubles from vectors
    whose components are at most `largest`; bounds are widened by it."""
    return largest * (32 * d) ** 0.5 * 2.0**-26 + 1e-9


def _distances(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    norm = (x * x).sum(axis=1)
    return np.sqrt(np.maximum(norm[:, None] + norm[None] - 2 * (x @ x.T), 0))


@dataclass
class CoverTree:
    """The rows in tree order (`order`: their old places), and for each node
    its rows [begin, end), the row of its centre, how far its rows lie from
    that at most, and its children [first, first + children)."""

    order: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    children: np.ndarray

    def arrays(self) -> list[bytes]:
        return [np.ascontiguousarray(a, t).tobytes() for a, t in ((self.begin, "<i4"), (self.end, "<i4"), (self.centre, "<i4"), (self.radius, "<f8"), (self.first, "<i4"), (self.children, "<i4"))]

    @classmethod
    def of_arrays(cls, parts: list[bytes]) -> CoverTree:
        return cls(np.zeros(0, np.int64), *(np.frombuffer(p, t) for p, t in zip(parts, ("<i4", "<i4", "<i4", "<f8", "<i4", "<i4"), strict=True)))


def cover_tree(x: np.ndarray, leaf: int = LEAF) -> CoverTree:
    """A cover tree: of a node whose rows lie within 2^i of its centre the
    children cover 2^(i-1) each, their centres are further apart than that,
    and the first of them has the node's own centre.  Levels at which nothing
    changes are left out; a node of at most `leaf` rows, or whose rows are
    all one point, is a leaf.
    """
    n, d = x.shape
    away = _distances(x)
    slack = margin(float(np.abs(x).max(initial=0)), d)
    order = np.arange(n)
    nodes: list[list] = [[0, n, 0, 0.0, 0, 0]]
    at = 0
    while at < len(nodes):
        begin, end, centre = nodes[at][:3]
        rows = order[begin:end].copy()
        far = away[centre, rows]
        radius = float(far.max(initial=0.0))
        nodes[at][3] = radius
        if len(rows) > leaf and radius > slack:
            half = 2.0 ** (np.ceil(np.log2(radius)) - 1)
            nodes[at][4] = len(nodes)
            place, left, own = begin, rows, centre
            while len(left):
                near = away[own, left] <= half
                near |= left == own
                taken = left[near]
                order[place : place + len(taken)] = taken
                nodes.append([place, place + len(taken), own, 0.0, 0, 0])
                place, left = place + len(taken), left[~near]
                own = left[0] if len(left) else -1
            nodes[at][5] = len(nodes) - nodes[at][4]
        at += 1
    begin, end, centre, radius, first, children = (np.array(c) for c in zip(*nodes, strict=True))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return CoverTree(order, begin, end, place[centre], radius + slack, first, children)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of paired rows of 64-bit integers."""
    z = x - y
    return np.einsum("rd,rd->r", z, z)


def _ranges(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (many[0] of them), first[1], ..."""
    start = np.cumsum(many) - many
    return np.repeat(first - start, many) + np.arange(many.sum())


class Centroids:
    """The centroids of a round and the tree over them, one centroid a leaf.
    Of equal centroids only the smallest number can be anyone's nearest."""

    def __init__(self, centroids: np.ndarray) -> None:
        unique, number = np.unique(centroids, axis=0, return_index=True)
        self.tree = cover_tree(unique, 1)
        self.number = number[self.tree.order]
        self.points = unique[self.tree.order]
        # centroids too close for doubles to tell apart share a leaf; each gets one of its own
        t = self.tree
        wide = np.flatnonzero((t.children == 0) & (t.end - t.begin > 1))
        for k in wide:
            rows = np.arange(t.begin[k], t.end[k])
            t.first[k], t.children[k] = len(t.begin), len(rows)
            t.begin, t.end, t.centre = np.append(t.begin, rows), np.append(t.end, rows + 1), np.append(t.centre, rows)
            t.radius, t.first, t.children = np.append(t.radius, np.full(len(rows), t.radius[k])), np.append(t.first, np.zeros(len(rows), int)), np.append(t.children, np.zeros(len(rows), int))


def assign(x: np.ndarray, tree: CoverTree, near: Centroids) -> tuple[np.ndarray, int]:
    """The nearest centroid's number of each row of x (in tree order; ties to
    the smaller number), and how many distances were computed.

    Pairs of a vector node and a centroid node descend together.  A pair goes
    when its least possible distance is beyond the largest that another pair
    of the same vector node allows.  What is left with one centroid takes it
    whole; rows of vector leaves are compared with their centroids exactly.
    """
    other, d = near.tree, x.shape[1]
    label = np.full(len(x), -1, np.int64)
    slack = margin(float(max(np.abs(x).max(initial=0), np.abs(near.points).max(initial=0))), d)
    node, mate = np.zeros(1, np.int64), np.zeros(1, np.int64)  # pairs, those of a vector node side by side
    computed = 0
    leaf_rows, leaf_mates = [], []
    while len(node):
        computed += len(node)
        away = np.sqrt(((x[tree.centre[node]].astype(np.float64) - near.points[other.centre[mate]]) ** 2).sum(axis=1))
        spread = tree.radius[node] + other.radius[mate] + slack
        starts = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        many = np.diff(np.append(starts, len(node)))
        most = np.repeat(np.minimum.reduceat(away + spread, starts), many)
        keep = away - spread <= most
        node, mate = node[keep], mate[keep]
        starts = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        many = np.diff(np.append(starts, len(node)))
        inner = other.children[mate] > 0
        # the wider side of a pair is opened; a vector node waits until none of its centroid nodes is wider
        wider = inner & ((other.radius[mate] >= tree.radius[node]) | (tree.children[node] == 0))
        waits = np.repeat(np.add.reduceat(wider.astype(np.int64), starts) > 0, many)
        whole = np.repeat((many == 1) & ~inner[starts], many)
        for v, c in zip(node[whole].tolist(), mate[whole].tolist(), strict=True):
            label[tree.begin[v] : tree.end[v]] = near.number[other.begin[c]]
        last = ~whole & ~waits & (tree.children[node] == 0)
        size = (tree.end - tree.begin)[node[last]]
        leaf_rows.append(_ranges(tree.begin[node[last]], size))
        leaf_mates.append(np.repeat(other.begin[mate[last]], size))
        # open centroid nodes
        a, m = node[waits], mate[waits]
        opened = wider[waits]
        grow = np.where(opened, other.children[m], 1)
        down = _ranges(np.where(opened, other.first[m], m), grow)
        a = np.repeat(a, grow)
        # open vector nodes: each child takes all mates
        go = ~whole & ~waits & (tree.children[node] > 0)
        v, m2 = node[go], mate[go]
        kids = _ranges(tree.first[v], tree.children[v])
        mates = np.repeat(m2, tree.children[v])
        node, mate = np.concatenate([a, kids]), np.concatenate([down, mates])
        order = np.lexsort((mate, node))
        node, mate = node[order], mate[order]
    rows, mates = np.concatenate(leaf_rows), np.concatenate(leaf_mates)
    if len(rows):
        away, number = squared(x[rows], near.points[mates]), near.number[mates]
        order = np.lexsort((number, away, rows))
        best = order[np.append(True, rows[order][1:] != rows[order][:-1])]
        label[rows[best]] = number[best]
    return label, computed + len(rows)

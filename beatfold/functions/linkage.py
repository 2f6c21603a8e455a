"""Hierarchical clustering of a bounded number of points in numpy: exact merge trees by nearest-neighbour chains."""

from __future__ import annotations

import numpy as np

LINKAGES = ("ward", "complete", "average", "single")
METRICS = ("euclidean", "manhattan", "cosine")
NEAR = 1e-5


def between(x: np.ndarray, y: np.ndarray, metric: str = "euclidean", squared: bool = False) -> np.ndarray:
    """Matrix of distances from the rows of x to those of y, some rows at a time. squared: of Euclidean distances, their squares.

    Squares come from a matrix product; where its rounding would show (points that are near for their length, or equal), from the
    differences themselves."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    out = np.empty((len(x), len(y)))
    if metric == "cosine":
        x, y = (v / np.where((n := np.linalg.norm(v, axis=1)) == 0, 1, n)[:, None] for v in (x, y))
    elif metric not in ("euclidean", "manhattan"):
        raise ValueError(f"unknown metric {metric!r}")
    if not out.size:
        return out
    columns = np.ascontiguousarray(y.T)
    if metric == "euclidean":
        own, theirs = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
        most = theirs.max()
    for a in range(0, len(x), 256):
        part, sums = x[a : a + 256], out[a : a + 256]
        if metric == "cosine":
            sums[:] = np.maximum(1 - part @ columns, 0)
        elif metric == "manhattan":
            _by_dimension(part, columns, np.abs, sums)
        else:
            np.matmul(part * -2.0, columns, out=sums)
            sums += own[a : a + 256, None]
            sums += theirs
            near = ~(sums > NEAR * (own[a : a + 256].max() + most))
            if (n := np.count_nonzero(near)) > near.size // 16:
                _by_dimension(part, columns, np.square, sums)
            elif n:
                p, q = np.nonzero(near)
                sums[p, q] = ((part[p] - y[q]) ** 2).sum(1)
            if not squared:
                np.sqrt(sums, out=sums)
    return out


def _by_dimension(x: np.ndarray, columns: np.ndarray, size, out: np.ndarray) -> None:
    """Sums of the sizes of differences, one dimension at a time, which stays in the cache."""
    out[:] = 0
    for mine, theirs in zip(x.T, columns, strict=True):
        out += size(mine[:, None] - theirs)


def distances(x: np.ndarray, metric: str = "euclidean", squared: bool = False) -> np.ndarray:
    """Square matrix of distances, alike from both sides to the last bit."""
    out = np.empty((len(x), len(x)))
    for a in range(0, len(x), 1024):
        d = between(x[a : a + 1024], x[a:], metric, squared)
        m = len(d)
        d[:, :m] = np.minimum(d[:, :m], d[:, :m].T)
        out[a : a + m, a:], out[a:, a : a + m] = d, d.T
    return out


def linkage(x: np.ndarray, method: str = "complete", metric: str = "euclidean", weights: np.ndarray | None = None) -> np.ndarray:
    """Rows (left, right, height, size), by height; points are 0..n-1, the cluster of row i is n + i. weights: points that stand for several."""
    if method not in LINKAGES:
        raise ValueError(f"unknown linkage {method!r}")
    if method == "ward" and metric != "euclidean":
        raise ValueError("ward needs the euclidean metric")
    d = distances(x, metric)
    size = np.ones(len(d)) if weights is None else np.asarray(weights, float).copy()
    if method == "ward" and weights is not None:
        d = d * np.sqrt(2 * np.outer(size, size) / np.add.outer(size, size))
    return chain(d, size, method)


def chain(d: np.ndarray, size: np.ndarray, method: str) -> np.ndarray:
    """Nearest-neighbour chain with Lance-Williams updates on a matrix of distances (which is used up). What has been joined leaves the
    matrix when a quarter of its rows are dead, so that rows are as short as the clusters are few."""
    n = len(d)
    np.fill_diagonal(d, np.inf)
    alive, merges, path, name, left = np.ones(n, bool), [], [], np.arange(n), n
    for _ in range(n - 1):
        if 4 * left < 3 * len(d):
            keep, now = np.nonzero(alive)[0], np.cumsum(alive) - 1
            for i, k in enumerate(keep):  # in place: rows and columns only move up
                d[i, :left] = d[k, keep]
            d, size, name, path, alive = d[:left, :left], size[keep], name[keep], [int(now[i]) for i in path], np.ones(left, bool)
        if not path:
            path = [int(alive.argmax())]
        while True:
            a = path[-1]
            b = int(d[a].argmin())
            if len(path) > 1 and d[a, path[-2]] <= d[a, b]:
                b = path[-2]
                break
            path.append(b)
        path = path[:-2]
        h, na, nb = d[a, b], size[a], size[b]
        merges.append((name[min(a, b)], name[max(a, b)], h))
        if method == "single":
            new = np.minimum(d[a], d[b])
        elif method == "complete":
            new = np.maximum(d[a], d[b])
        elif method == "average":
            new = (na * d[a] + nb * d[b]) / (na + nb)
        else:
            new = np.sqrt(np.maximum(((na + size) * d[a] ** 2 + (nb + size) * d[b] ** 2 - size * h * h) / (na + nb + size), 0))
        new[~alive] = np.inf
        lo, hi = min(a, b), max(a, b)
        alive[hi] = False
        new[lo] = new[hi] = np.inf
        d[lo], d[:, lo] = new, new
        d[hi], d[:, hi] = np.inf, np.inf
        size[lo] = na + nb
        left -= 1
    return ordered(merges, n)


def ordered(merges: list[tuple[int, int, float]], n: int) -> np.ndarray:
    """Merges of representatives, sorted by height and named by cluster numbers; sizes count points."""
    parent, name, count = list(range(n)), list(range(n)), [1] * n

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = np.empty((len(merges), 4))
    for k, i in enumerate(np.argsort([m[2] for m in merges], kind="stable")):
        a, b, h = merges[i]
        a, b = root(a), root(b)
        out[k] = (*sorted((name[a], name[b])), h, count[a] + count[b])
        parent[b], name[a], count[a] = a, n + k, count[a] + count[b]
    return out


def cut(tree: np.ndarray, n: int, k: int | None = None, height: float | None = None) -> np.ndarray:
    """Labels of the points when the tree is cut into k clusters, or where it is higher than `height`. Numbered by size, then first point."""
    keep = n - min(max(k, 1), n) if k is not None else int((tree[:, 2] <= height).sum())
    label = np.arange(n + keep)
    for i in range(keep - 1, -1, -1):
        for c in tree[i, :2].astype(int):
            label[c] = label[n + i]
    return canonical(label[:n])


def canonical(label: np.ndarray) -> np.ndarray:
    """Labels renumbered by falling cluster size, then by their first point."""
    names, first, where, count = np.unique(label, return_index=True, return_inverse=True, return_counts=True)
    rank = np.empty(len(names), int)
    rank[np.lexsort((first, -count))] = np.arange(len(names))
    return rank[where]

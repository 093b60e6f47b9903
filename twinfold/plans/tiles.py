"""Vector distances between blocks of rows, one tile per group.

A tile holds two blocks, or two groups of blocks that are then compared block by block.
Which tiles there are is up to ``metric``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

METRICS = ("cosine", "euclidean", "manhattan", "chebyshev")
_STRIP = 64  # left rows handled at once inside a tile; bounds its memory
_PAIRS = 1024  # pairs measured at once that one product does not rule out


def matrix(table: pa.Table) -> np.ndarray:
    vec = table.column("vec").combine_chunks()
    flat = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(vec), -1)


def unit(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(norm == 0, 1.0, norm)


def strip_distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances of each row of ``a`` to each row of ``b``; cosine wants unit rows."""
    if metric == "cosine":
        return 1.0 - a @ b.T
    if metric == "euclidean":
        sq = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
        return np.sqrt(np.maximum(sq, 0.0))
    out = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        gap = np.abs(a[:, k][:, None] - b[:, k][None, :])
        if metric == "manhattan":
            out += gap
        else:
            np.maximum(out, gap, out=out)
    return out


def _blocks(rows: np.ndarray, block: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """The row numbers of each block among ``rows``, in their order."""
    rows = rows[np.argsort(block[rows], kind="stable")]
    ends = np.flatnonzero(np.diff(block[rows])) + 1
    return [(block[part[0]], part) for part in np.split(rows, ends) if len(part)]


def strips(table: pa.Table, metric: str, keep: Callable) -> Iterator[tuple]:
    """``(matrix, row numbers, row numbers, distances, valid)`` over the pairs of one tile, each once.

    ``keep`` drops rows of one block that no pair with the other block needs."""
    m = matrix(table)
    if metric == "cosine":
        m = unit(m)
    own, block = table.column("_own").to_numpy(), table.column("block").to_numpy()
    first, second = table.column("_i")[0].as_py(), table.column("_j")[0].as_py()
    left = _blocks(np.flatnonzero(own == first), block)
    right = left if first == second else _blocks(np.flatnonzero(own == second), block)
    for i, all_rows in left:
        for j, all_cols in right:
            if first == second and j < i:
                continue
            rows, cols = all_rows, all_cols
            if i != j:
                rows = keep(table, m, rows, cols)
                cols = keep(table, m, cols, rows)
            if not len(cols):
                continue
            for at in range(0, len(rows), _STRIP):
                part = rows[at: at + _STRIP]
                if i == j:
                    ends = cols[at + 1:]
                    d = strip_distances(m[part], m[ends], metric)
                    yield m, part, ends, d, np.arange(len(ends))[None, :] >= np.arange(len(part))[:, None]
                else:
                    yield m, part, cols, strip_distances(m[part], m[cols], metric), None


def _outermost(table: pa.Table, metric: str, keep: Callable, near: float, far: float) -> tuple[list, list]:
    """Manhattan or Chebyshev distances of a tile that may be the least or the largest.

    Both lie within the square root of the number of places of the Euclidean distance, which
    one matrix product gives. Only pairs that may so be beyond ``near`` or ``far``, or what the
    tile has seen, are measured."""
    low, high = [], []
    for m, part, ends, d, valid in strips(table, "euclidean", keep):
        if not d.size:
            continue
        root = np.sqrt(m.shape[1])
        slack = 1e-6 * (1.0 + np.sqrt(max((m[part] ** 2).sum(axis=1).max(), (m[ends] ** 2).sum(axis=1).max())))
        least, most = (1.0, root) if metric == "manhattan" else (1.0 / root, 1.0)  # times the Euclidean distance
        can = ((d - slack) * least <= near) | ((d + slack) * most >= far)
        if valid is not None:
            can &= valid
        x, y = np.nonzero(can)
        if not len(x):
            continue
        about = np.empty(len(x))  # to some digits; the outermost are measured once more
        for at in range(0, len(x), _PAIRS):
            some = slice(at, at + _PAIRS)
            gap = np.abs(m[part[x[some]]] - m[ends[y[some]]])
            about[some] = gap.sum(axis=1) if metric == "manhattan" else gap.max(axis=1)
        can = (about <= min(near, about.min()) + slack) | (about >= max(far, about.max()) - slack)
        a, b = part[x[can]], ends[y[can]]
        if not len(a):
            continue
        seen = np.zeros(len(a))
        for k in range(m.shape[1]):  # in the order of strip_distances, so that sums are equal to the last digit
            gap = np.abs(m[a, k] - m[b, k])
            seen = seen + gap if metric == "manhattan" else np.maximum(seen, gap)
        low.append(seen.min())
        high.append(seen.max())
        near, far = min(near, low[-1]), max(far, high[-1])
    return low, high


def bounds_of(table: pa.Table, metric: str, keep: Callable, near: float = np.inf, far: float = 0.0) -> pa.Table:
    """One row: least and largest distance of the tile, and how many pairs of records lie below zero.

    ``near`` and ``far`` are distances that some pairs of the table have; pairs between them may be left out."""
    if metric in ("manhattan", "chebyshev"):
        low, high = _outermost(table, metric, keep, near, far)
        return pa.table({
            "low": pa.array([min(low) if low else None], pa.float64()),
            "high": pa.array([max(high) if high else None], pa.float64()), "negative": pa.array([0], pa.int64()),
        })
    low, high, negative, n = [], [], 0, table.column("n").to_numpy()
    for _, part, ends, d, valid in strips(table, metric, keep):
        seen = d[valid] if valid is not None else d.ravel()
        if len(seen):
            low.append(seen.min())
            high.append(seen.max())
            if low[-1] < 0:
                a, b = np.nonzero((d < 0) & (True if valid is None else valid))
                negative += int((n[part[a]] * n[ends[b]]).sum())
    return pa.table({
        "low": pa.array([min(low) if low else None], pa.float64()),
        "high": pa.array([max(high) if high else None], pa.float64()), "negative": pa.array([negative], pa.int64()),
    })


PAIR_COLUMNS = ("gid_l", "gid_r", "n_l", "n_r", "distance")
_BATCH = 65_536  # pairs a tile hands on at once


def pairs_of(table: pa.Table, metric: str, keep: Callable, cutoff: float) -> Iterator[pa.RecordBatch]:
    """``gid_l, gid_r, n_l, n_r, distance`` of the tile's pairs up to about ``cutoff``."""
    slack = cutoff * (1 + 1e-9) + 1e-7
    gid, n = table.column("gid").to_numpy(), table.column("n").to_numpy()
    kinds = (pa.int64(),) * 4 + (pa.float64(),)
    held, size = [], 0

    def batch():
        cols = [np.concatenate(c) if held else np.array([]) for c in (zip(*held) if held else [()] * 5)]
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, kinds)], names=list(PAIR_COLUMNS))

    for m, part, ends, d, valid in strips(table, metric, keep):
        hit = d <= slack
        if valid is not None:
            hit &= valid
        at, to = np.nonzero(hit)
        if not len(at):
            continue
        dist = d[at, to]
        a, b = part[at], ends[to]
        if metric == "euclidean":  # the fast form loses digits on close rows
            dist = np.sqrt(((m[a] - m[b]) ** 2).sum(axis=1))
        swap = gid[a] > gid[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        held.append((gid[a], gid[b], n[a], n[b], dist))
        size += len(at)
        if size >= _BATCH:
            yield batch()
            held, size = [], 0
    yield batch()


def links_of(table: pa.Table, metric: str, keep: Callable, eps: float) -> pa.Table:
    """``u, v``: a spanning forest of the tile's rows within ``eps``.

    A dense cluster has a quadratic number of close pairs, but one tile reports
    fewer links than it has rows. Joined up, the forests connect exactly the rows
    the close pairs connect.
    """
    gid = table.column("gid").to_numpy()
    parent = np.arange(len(gid))
    u, v = [], []
    for m, part, ends, d, valid in strips(table, metric, keep):
        if metric == "euclidean":
            near = (d - eps) < 1e-7
            a, b = np.nonzero(near & ((d - eps) > -1e-7))
            if len(a):
                near[a, b] = np.sqrt(((m[part[a]] - m[ends[b]]) ** 2).sum(axis=1)) <= eps
        else:
            near = np.maximum(d, 0.0) <= eps
        if valid is not None:
            near &= valid
        for at in np.flatnonzero(near.any(axis=1)):
            i, close = part[at], ends[near[at]]
            roots = np.unique(_roots(parent, close))
            top = _roots(parent, np.array([i]))[0]
            for other in roots[roots != top]:
                u.append(gid[top])
                v.append(gid[other])
                parent[other] = top
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def _roots(parent: np.ndarray, at: np.ndarray) -> np.ndarray:
    up = parent[at]
    while True:
        higher = parent[up]
        if (higher == up).all():
            parent[at] = up
            return up
        up = higher

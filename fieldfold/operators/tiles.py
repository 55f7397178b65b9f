"""Clustering within the tiles of a ground grid: what lies wholly in one tile is finished there, at any size of survey.

A tile gets its own points and those up to two radii around it, so that the neighbours of every point up to one radius
around it are all there. A cluster none of whose points has a neighbour that another tile owns is complete. The others
leave a label for each of their own points and the links by which their parts are joined over tiles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .graph import roots

#: Kinds of rows: finished label, label of a cluster that crosses tiles, link (a shared point and its label), and the
#: labels among which a border point belongs to the least.
DONE, OPEN, LINK, EITHER = range(4)


def near_pairs(x: np.ndarray, y: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of all pairs within r (inclusive), each once: points sorted by strips of width r and by y within
    these; each is held against the run of its own strip up to r further on, and the run within r in the next."""
    n = len(x)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    strip = np.floor(x / r)
    strip = strip - strip.min()
    span = float(y.max() - y.min()) + 4 * r
    line = strip * span + (y - y.min())  # strips end to end, further apart than r
    order = np.argsort(line, kind="stable")
    line = line[order]
    slack = 1e-9 * (1 + np.abs(line))
    out_i, out_j = [], []
    here = np.arange(n)
    for low, high in ((here + 1, np.searchsorted(line, line + r + slack, "right")), (np.searchsorted(line, line + span - r - slack, "left"), np.searchsorted(line, line + span + r + slack, "right"))):
        count = np.maximum(high - low, 0)
        i = np.repeat(here, count)
        j = np.repeat(low, count) + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
        i, j = order[i], order[j]
        near = (x[i] - x[j]) ** 2 + (y[i] - y[j]) ** 2 <= r * r
        out_i.append(i[near])
        out_j.append(j[near])
    i, j = np.concatenate(out_i), np.concatenate(out_j)
    return np.minimum(i, j), np.maximum(i, j)


def split(x: np.ndarray, y: np.ndarray, frame: np.ndarray, gate: float) -> np.ndarray:
    """The part of each point, by its least place: rounds in which mutually nearest parts merge that are within the gate
    and share no frame, as in dedup.split_conflicts."""
    n = len(x)
    part, members = np.arange(n), {i: [i] for i in range(n)}
    a, b = near_pairs(x, y, gate)
    apart = frame[a] != frame[b]
    a, b = a[apart], b[apart]
    cx, cy, seen = x.astype(float).copy(), y.astype(float).copy(), [{f} for f in frame.tolist()]
    while len(a):
        free = np.fromiter((seen[p].isdisjoint(seen[q]) for p, q in zip(a.tolist(), b.tolist(), strict=True)), bool, len(a))
        a, b = a[free], b[free]
        d = np.hypot(cx[a] - cx[b], cy[a] - cy[b])
        near = np.flatnonzero(d <= gate)
        if not len(near):
            break
        near = near[np.lexsort((b[near], a[near], d[near]))]
        rank = np.arange(len(near))
        best = np.full(n, len(near))
        np.minimum.at(best, a[near], rank)
        np.minimum.at(best, b[near], rank)
        merge = near[(best[a[near]] == rank) & (best[b[near]] == rank)]
        into = np.arange(n)
        for p, q in zip(a[merge].tolist(), b[merge].tolist(), strict=True):
            into[q] = p
            members[p] += members.pop(q)
            seen[p] |= seen[q]
            cx[p], cy[p] = x[members[p]].mean(), y[members[p]].mean()
        part = into[part]
        a, b = into[a], into[b]
        a, b = np.minimum(a, b), np.maximum(a, b)
        pairs = np.unique(np.stack([a, b], 1)[a != b], axis=0) if len(a) else np.zeros((0, 2), np.int64)
        a, b = pairs[:, 0], pairs[:, 1]
    return part


def cluster(points: pa.Table, eps: float, least: int, drop_noise: bool, gate: float | None) -> pa.Table:
    """idx, label, kind of one tile's points (idx, x, y, frame_id, own: this tile's, near: up to a radius around it).
    gate: split complete clusters that hold a frame twice (None: leave them)."""
    points = points.sort_by("idx")
    idx, x, y = (points.column(c).to_numpy() for c in ("idx", "x", "y"))
    own, near = (points.column(c).to_numpy().astype(bool) for c in ("own", "near"))
    n = len(idx)
    i, j = near_pairs(x, y, eps)
    core = near & (np.bincount(i, minlength=n) + np.bincount(j, minlength=n) + 1 >= least)
    both = core[i] & core[j]
    label = np.arange(n)
    if both.any():
        nodes, root = roots(i[both], j[both])
        label[nodes] = root
    # a point next to one of another tile's leaves its cluster open, and so does one that belongs to either of two clusters
    ends = np.concatenate([i, j]), np.concatenate([j, i])
    crossing = ~own
    crossing[ends[0][~own[ends[1]]]] = True
    open_ = np.zeros(n, bool)
    open_[label[core & crossing]] = True
    edge = core[ends[1]] & ~core[ends[0]]  # a border point and a core
    border, reach = ends[0][edge], label[ends[1][edge]]
    while True:
        either = np.zeros(n, bool)
        either[border[open_[reach]]] = True
        either[border[crossing[border]]] = True
        more = reach[either[border] & ~open_[reach]]
        if not len(more):
            break
        open_[more] = True
    final = np.where(core, label, n)
    np.minimum.at(final, border, reach)
    lone = final == n
    rows = []
    mine = own & core & open_[label]
    rows.append((idx[mine], idx[label[mine]], OPEN))
    link = core & open_[label] & (crossing | ~own)
    rows.append((idx[link], idx[label[link]], LINK))
    either &= own
    at = either[border]
    rows.append((idx[border[at]], idx[reach[at]], EITHER))
    done = own & ~lone & ~either & ~(core & open_[label])
    at = np.flatnonzero(done)
    if gate is not None and len(at):
        frame = points.column("frame_id").combine_chunks().dictionary_encode().indices.to_numpy()
        by = at[np.lexsort((frame[at], final[at]))]
        twice = np.unique(final[by[1:]][(final[by[1:]] == final[by[:-1]]) & (frame[by[1:]] == frame[by[:-1]])])
        order = at[np.argsort(final[at], kind="stable")]
        sorted_ = final[order]
        for c in twice:
            member = order[np.searchsorted(sorted_, c) : np.searchsorted(sorted_, c, "right")]
            final[member] = member[split(x[member], y[member], frame[member], gate)]
    rows.append((idx[at], idx[final[at]], DONE))
    alone = idx[own & lone]
    labels = pa.concat_arrays([*(pa.array(r[1]) for r in rows), pa.nulls(len(alone), pa.int64()) if drop_noise else pa.array(alone)])
    return pa.table({"idx": np.concatenate([*(r[0] for r in rows), alone]), "label": labels, "kind": np.concatenate([*(np.full(len(r[0]), r[2], np.int32) for r in rows), np.full(len(alone), DONE, np.int32)])})

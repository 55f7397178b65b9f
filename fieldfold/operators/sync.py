"""Pre-alignment of tightly packed scenes: pairwise offset votes between frames, then one pose-graph solve."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SyncConfig
from .dedup import quantile
from .graph import components
from .lineage import checkpoint
from .spatial import self_pairs


def offsets(points: DataFrame, config: SyncConfig) -> DataFrame:
    """fa, fb, dx, dy, votes: for pairs of frames (fa < fb) the offset that most pairs of their points agree on.

    Differences within the radius vote for their bin and the eight around it; the peak (of equal ones the lowest
    bin) is refined to the mean of the differences in a disc of 1.5 bins around it, and counts with enough of them.
    """
    near = self_pairs(points.select("idx", "x", "y", "frame_id"), config.radius_m, on=F.col("a.frame_id") != F.col("b.frame_id"))
    up = F.col("a.frame_id") < F.col("b.frame_id")
    diff = near.select(F.least("a.frame_id", "b.frame_id").alias("fa"), F.greatest("a.frame_id", "b.frame_id").alias("fb"), F.when(up, F.col("b.x") - F.col("a.x")).otherwise(F.col("a.x") - F.col("b.x")).alias("dx"), F.when(up, F.col("b.y") - F.col("a.y")).otherwise(F.col("a.y") - F.col("b.y")).alias("dy"))
    diff = checkpoint(diff)
    half = math.ceil(config.radius_m / config.bin_m) + 1
    at = lambda c: (F.floor(F.col(c) / config.bin_m) + half).cast("long")
    ring = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    base = diff.groupBy("fa", "fb", at("dx").alias("bx"), at("dy").alias("by")).count()
    votes = base.select("fa", "fb", "bx", "by", "count", ring.alias("o")).groupBy("fa", "fb", (F.col("bx") + F.col("o.i")).alias("bx"), (F.col("by") + F.col("o.j")).alias("by")).agg(F.sum("count").alias("votes"))
    peak = votes.groupBy("fa", "fb").agg(F.min_by(F.struct("bx", "by"), F.struct((-F.col("votes")).alias("v"), "bx", "by")).alias("p"))
    centre = lambda c: (F.col(f"p.{c}") - half + 0.5) * config.bin_m
    close = diff.join(peak, ["fa", "fb"]).where(F.hypot(F.col("dx") - centre("bx"), F.col("dy") - centre("by")) <= 1.5 * config.bin_m)
    return close.groupBy("fa", "fb").agg(F.avg("dx").alias("dx"), F.avg("dy").alias("dy"), F.count("*").alias("votes")).where(F.col("votes") >= config.min_votes)


def solve(a: np.ndarray, b: np.ndarray, d: np.ndarray, support: np.ndarray, n: int, config: SyncConfig) -> tuple[np.ndarray, np.ndarray]:
    """(shift of each frame, residual of each pair): least squares of t_b - t_a = d, weighted by support and Huber's
    weights over several rounds, with a weak pull to zero; conjugate gradients on the normal equations."""
    t, weight = np.zeros((n, 2)), support.astype(float)
    for _ in range(config.rounds):
        def apply(x, w=weight):
            r = w[:, None] * (x[b] - x[a])
            out = config.prior**2 * x
            for k in (0, 1):
                out[:, k] += np.bincount(b, r[:, k], n) - np.bincount(a, r[:, k], n)
            return out

        rhs = np.column_stack([np.bincount(b, weight * d[:, k], n) - np.bincount(a, weight * d[:, k], n) for k in (0, 1)])
        r = rhs - apply(t)
        p, rr = r.copy(), (r * r).sum(0)
        for _ in range(20 * n + 50):
            if (rr <= 1e-20 * np.maximum(1, (rhs * rhs).sum(0))).all():
                break
            q = apply(p)
            step = rr / np.maximum((p * q).sum(0), 1e-300)
            t = t + step * p
            r = r - step * q
            new = (r * r).sum(0)
            p, rr = r + new / np.maximum(rr, 1e-300) * p, new
        residual = np.hypot(*(t[b] - t[a] - d).T)
        weight = support * np.where(residual <= config.huber_m, 1.0, config.huber_m / np.maximum(residual, 1e-12))
    return t, residual


def synchronise(points: DataFrame, config: SyncConfig) -> tuple[DataFrame, dict]:
    """(points with each frame's shift taken off, what was found): n_pairs, n_links (within the Huber distance), residual_m
    (the median over all pairs).

    Frames that no chain of pairs joins don't bear on each other, so every component of the graph of pairs is solved by a
    task of its own, from one row a pair of frames (some 50 bytes).
    """
    code = lambda c: F.xxhash64(c)
    found = checkpoint(offsets(points, config))
    area = components(found.select(code("fa").alias("a"), code("fb").alias("b")))
    pairs = found.join(area, code("fa") == F.col("node")).select("root", "fa", "fb", "dx", "dy", "votes")

    def one(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("fa", "ascending"), ("fb", "ascending")])
        fa, fb = (rows.column(c).to_pylist() for c in ("fa", "fb"))
        names = sorted({*fa, *fb})
        at = {f: i for i, f in enumerate(names)}
        d = np.column_stack([rows.column(c).to_numpy() for c in ("dx", "dy")])
        t, residual = solve(np.array([at[f] for f in fa]), np.array([at[f] for f in fb]), d, rows.column("votes").to_numpy().astype(float), len(names), config)
        none = pa.nulls(len(residual), pa.string()), pa.nulls(len(residual), pa.float64())
        return pa.table({"frame_id": pa.chunked_array([names, none[0]], pa.string()), "tx": pa.chunked_array([pa.array(t[:, 0]), none[1]]), "ty": pa.chunked_array([pa.array(t[:, 1]), none[1]]), "residual": pa.chunked_array([pa.nulls(len(names), pa.float64()), pa.array(residual)])})

    solved = checkpoint(pairs.groupBy("root").applyInArrow(one, "frame_id string, tx double, ty double, residual double"))
    shifts = solved.where("frame_id is not null").select("frame_id", "tx", "ty")
    moved = points.join(shifts, "frame_id", "left").withColumns({"x": F.col("x") - F.coalesce("tx", F.lit(0.0)), "y": F.col("y") - F.coalesce("ty", F.lit(0.0))}).select(*points.columns)
    of_pairs = solved.where("residual is not null")
    counts = of_pairs.agg(F.count("*").alias("n"), F.count_if(F.col("residual") <= config.huber_m).alias("links")).first()
    return checkpoint(moved), {"n_pairs": counts.n, "n_links": counts.links, "residual_m": quantile(of_pairs, "residual", 0.5) or 0.0}

"""Connected components of edge tables.

Edges are first reduced where they lie: each task keeps a spanning forest of the edges that it holds, as stars,
which for clustered points leaves little more than one edge a node. Alternating large-star and small-star
rounds (Kiveris et al., 2014) join what is left; neighbourhoods are aggregated, never gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import checkpoint

def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, least node of each one's component) over edges a-b."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        rx, ry = root[x], root[y]
        apart = rx != ry
        if not apart.any():
            return nodes, nodes[root]
        x, y, rx, ry = x[apart], y[apart], rx[apart], ry[apart]
        np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def reduce():
        nodes, root = roots(*(np.concatenate(c) for c in zip(*held, strict=True)))
        keep = nodes != root
        return nodes[keep], root[keep]

    for b in batches:
        held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
        size += b.num_rows
        if size > 4_000_000:
            held = [reduce()]
            size = len(held[0][0])
    if held:
        u, v = reduce()
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for every node of edges(a, b); loops are ignored."""
    pairs = edges.where("a <> b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    now = checkpoint(pairs.mapInArrow(_stars, "u long, v long"))
    while not _settled(now):  # rounds grow with the logarithm of the nodes, squared at worst
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        now = checkpoint(small)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())


def _settled(edges: DataFrame) -> bool:
    """Whether all is stars: each node points to one other, and none that is pointed to points on."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    return ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 or (out = 1 and into = 1)").limit(1).count() == 0

"""Range joins and neighbours over metric points, as equi-joins on grid cells.

A theta join on distance would be a nested loop. Points that are at most r apart lie in neighbouring cells of
side r, so one side is repeated for the nine cells around it, the join is an equi-join on the cell, and the
distance is a filter; the inequality of the pair keeps each pair once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell(x: Column, r: float) -> Column:
    return F.floor(x / r).cast("long")


def squared(a: str, b: str) -> Column:
    dx, dy = F.col(f"{a}.x") - F.col(f"{b}.x"), F.col(f"{a}.y") - F.col(f"{b}.y")
    return dx * dx + dy * dy


def range_join(left: DataFrame, right: DataFrame, r: float, also: list[str] | None = None, on: Column | None = None) -> DataFrame:
    """All pairs (a, b) of rows of left and right within r of each other (inclusive), as structs a and b.

    Both have columns x and y. also: columns that must be equal too; on: a further condition over a.* and b.*.
    Spark's estimate of a side counts neither exploded nor packed rows, so by it either would be broadcast: both are sorted.
    """
    also = also or []
    a = left.select(F.struct(*left.columns).alias("a")).withColumns({"_cx": cell(F.col("a.x"), r), "_cy": cell(F.col("a.y"), r), **{f"_k{i}": F.col(f"a.{c}") for i, c in enumerate(also)}})
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    b = right.select(F.struct(*right.columns).alias("b")).select("b", around.alias("_o"))
    b = b.select("b", (cell(F.col("b.x"), r) + F.col("_o.i")).alias("_cx"), (cell(F.col("b.y"), r) + F.col("_o.j")).alias("_cy"), *(F.col(f"b.{c}").alias(f"_k{i}") for i, c in enumerate(also)))
    pairs = a.join(b.hint("merge"), ["_cx", "_cy", *(f"_k{i}" for i in range(len(also)))]).where(squared("a", "b") <= r * r)
    return (pairs.where(on) if on is not None else pairs).select("a", "b")


def self_pairs(points: DataFrame, r: float, also: list[str] | None = None, on: Column | None = None) -> DataFrame:
    """Pairs of one table within r, each once: a.idx < b.idx."""
    order = F.col("a.idx") < F.col("b.idx")
    return range_join(points, points, r, also, order if on is None else order & on)


def nearest_in_group(points: DataFrame, group: str) -> DataFrame:
    """idx and d, the distance to the nearest other point of the same group, for points in groups of two or more."""
    p = points.select("idx", "x", "y", group)
    a, b = p.select(group, F.struct("idx", "x", "y").alias("a")), p.select(group, F.struct("idx", "x", "y").alias("b"))
    near = a.join(b, group).where("a.idx <> b.idx").groupBy("a.idx").agg(F.min(squared("a", "b")).alias("d2"))
    return near.select("idx", F.sqrt("d2").alias("d"))


def nearest_within(probes: DataFrame, points: DataFrame, r: float) -> DataFrame:
    """probe (its id) and idx of the nearest point within r, or null; of equally near ones the last by idx."""
    pairs = range_join(probes, points, r)
    best = pairs.groupBy(F.col("a.id").alias("id")).agg(F.min_by("b.idx", F.struct(squared("a", "b").alias("d"), (-F.col("b.idx")).alias("i"))).alias("idx"))
    return probes.select("id").join(best, "id", "left")


def viewport(points: DataFrame, x0: float, y0: float, x1: float, y1: float, side: float) -> DataFrame:
    """What a map of this extent draws: points inside, one for each square of a side."""
    seen = points.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))
    best = seen.groupBy(cell(F.col("x"), side).alias("cx"), cell(F.col("y"), side).alias("cy")).agg(F.min("idx").alias("idx"), F.count("*").alias("n"))
    return best.select("idx", "n")

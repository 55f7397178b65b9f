"""From ground points to one record per object: suppression, density clustering, cannot-link split, resolution.

Points: idx long (input order), x, y double (metres), frame_id, label, confidence, detection_id; more columns
are carried along.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DedupConfig
from . import tiles
from .graph import components, roots
from .lineage import checkpoint
from .spatial import range_join, self_pairs


def suppress(points: DataFrame, radius: float) -> DataFrame:
    """idx, keeper: boxes of one frame within a radius are linked (transitively); the most confident one keeps the
    group, of equal ones the first. A box on its own keeps itself. A frame, the boxes of one image, is one group."""
    if radius <= 0:
        return points.select("idx", F.col("idx").alias("keeper"))

    def one(boxes: pa.Table) -> pa.Table:
        idx, x, y, confidence = (boxes.column(c).to_numpy() for c in ("idx", "x", "y", "confidence"))
        i, j = tiles.near_pairs(x, y, radius)
        group = np.arange(len(idx))
        if len(i):
            nodes, root = roots(i, j)
            group[nodes] = root
        order = np.lexsort((idx, -confidence, group))
        first = np.append(True, np.diff(group[order]) != 0)
        best = order[first]
        return pa.table({"idx": idx, "keeper": idx[best[np.searchsorted(group[best], group)]]})

    return points.select("idx", "x", "y", "confidence", "frame_id").groupBy("frame_id").applyInArrow(one, "idx long, keeper long")


#: Side of the tiles that points are clustered in, in radii, and metres at least: a tile's animals are as many as can stand on it.
TILE_RADII, TILE_M = 32, 64.0


def _clustered(points: DataFrame, eps: float, min_samples: int, drop_noise: bool, gate: float | None) -> tuple[DataFrame, DataFrame | None]:
    """(idx, cluster of all points; which points' clusters cross tiles, null if none do). Clusters within a tile are split
    at once if a gate is given."""
    side = max(TILE_M, TILE_RADII * eps)
    tile = lambda c: F.floor(F.col(c) / side).cast("long")
    reach = F.expr("explode(sequence(-1, 1))")
    p = points.select("idx", "x", "y", "frame_id")
    at = p.withColumns({"tx": tile("x"), "ty": tile("y")}).withColumn("i", reach).withColumn("j", reach)
    # how far a point lies from the tile beside its own
    gap = lambda c, t, k: F.when(F.col(k) == -1, F.col(c) - F.col(t) * side).when(F.col(k) == 1, (F.col(t) + 1) * side - F.col(c)).otherwise(0.0)
    far = F.greatest(gap("x", "tx", "i"), gap("y", "ty", "j"))
    spread = at.withColumn("far", far).where(F.col("far") <= 2 * eps)
    spread = spread.select("idx", "x", "y", "frame_id", ((F.col("i") == 0) & (F.col("j") == 0)).cast("int").alias("own"), (F.col("far") <= eps).cast("int").alias("near"), (F.col("tx") + F.col("i")).alias("tx"), (F.col("ty") + F.col("j")).alias("ty"))
    rows = checkpoint(spread.groupBy("tx", "ty").applyInArrow(lambda t: tiles.cluster(t, eps, min_samples, drop_noise, gate), "idx long, label long, kind int"))
    done = rows.where(F.col("kind") == tiles.DONE).select("idx", F.col("label").alias("cluster"))
    if rows.where(F.col("kind") != tiles.DONE).limit(1).count() == 0:
        return done, None
    found = components(rows.where(F.col("kind") == tiles.LINK).select(F.col("idx").alias("a"), F.col("label").alias("b")))
    parts = rows.where(F.col("kind").isin(tiles.OPEN, tiles.EITHER)).join(found, F.col("label") == F.col("node"), "left")
    crossing = checkpoint(parts.groupBy("idx").agg(F.min(F.coalesce("root", "label")).alias("cluster")))
    return done.unionByName(crossing), crossing


def dbscan(points: DataFrame, eps: float, min_samples: int = 1, drop_noise: bool = False) -> DataFrame:
    """idx, cluster (the least core idx in it): density clustering with an inclusive radius.

    With min_samples 1 clusters are the components at distance eps. Otherwise a point with that many points
    within eps (itself counted) is a core; a border point goes to the cluster of least number among its cores'.
    Noise gets a cluster of its own, or null with drop_noise.
    """
    return _clustered(points, eps, min_samples, drop_noise, None)[0]


def _nearest_pairs(links: DataFrame, gate: float) -> DataFrame:
    """a, b of the links (a, b, d) that are the nearest link of both their ends, within the gate (ties by lower numbers)."""
    near = links.where(F.col("d") <= gate).select("d", "a", "b")
    rank = F.struct("d", "a", "b")
    ends = near.select(F.col("a").alias("part"), rank.alias("r")).unionByName(near.select(F.col("b").alias("part"), rank.alias("r")))
    best = ends.groupBy("part").agg(F.min("r").alias("r"))
    return best.groupBy("r").count().where("count = 2").select("r.a", "r.b")


def _measured(links: DataFrame, parts: DataFrame) -> DataFrame:
    """The links whose parts share no frame, with the distance of the parts' centres."""
    side = lambda k: parts.select(F.col("part").alias(k), F.struct("x", "y", "frames").alias(f"_{k}"))
    both = links.join(side("a"), "a").join(side("b"), "b").where(~F.arrays_overlap("_a.frames", "_b.frames"))
    return both.select("a", "b", F.hypot(F.col("_a.x") - F.col("_b.x"), F.col("_a.y") - F.col("_b.y")).alias("d"))


def split_conflicts(points: DataFrame, clusters: DataFrame, gate: float) -> DataFrame:
    """idx, cluster: clusters in which a frame stands twice are split; the others pass by untouched.

    Every point of such a cluster begins as a part of its own. In each round, parts that are each other's nearest merge,
    provided that their centres are within the gate and they share no frame; a merged part has the mean of its points as
    its centre, and the links of all its points. Links come from a grid join once and only ever shrink, so no task sees a
    cluster whole, however far it chains. The rounds end when no pair may merge any more.
    """
    member = points.select("idx", "x", "y", "frame_id").join(clusters.where("cluster is not null"), "idx")
    twice = member.groupBy("cluster", "frame_id").count().where("count > 1").select("cluster").distinct()
    member = checkpoint(member.join(twice, "cluster", "left_semi"))
    # a part has its members, which are no more than there are frames, its centre, and its frames by number
    parts = member.select(F.col("idx").alias("part"), F.array("idx").alias("members"), "x", "y", F.array(F.xxhash64("frame_id")).alias("frames"))
    links = self_pairs(member, gate, ["cluster"], F.col("a.frame_id") != F.col("b.frame_id")).select(F.col("a.idx").alias("a"), F.col("b.idx").alias("b"))
    while True:
        links = checkpoint(_measured(links, parts))
        into = checkpoint(_nearest_pairs(links, gate).select(F.col("b").alias("old"), F.col("a").alias("new")))
        if into.limit(1).count() == 0:
            break
        now = lambda c: F.coalesce("new", c)
        mean = lambda c: (F.sum(F.col(c) * F.size("members")) / F.sum(F.size("members"))).alias(c)
        parts = checkpoint(parts.join(into, parts.part == into.old, "left").groupBy(now("part").alias("part")).agg(F.flatten(F.collect_list("members")).alias("members"), mean("x"), mean("y"), F.flatten(F.collect_list("frames")).alias("frames")))
        for c in "ab":
            links = links.select("a", "b").join(into, F.col(c) == F.col("old"), "left").withColumn(c, now(c)).drop("old", "new")
        links = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    of_point = parts.select("part", F.explode("members").alias("idx"))
    return clusters.join(of_point, "idx", "left").select("idx", F.coalesce("part", "cluster").alias("cluster"))


def assign(points: DataFrame, config: DedupConfig) -> DataFrame:
    """idx, cluster: a group label for each point (null: dropped as noise). Suppressed boxes follow their keeper."""
    keepers = checkpoint(suppress(points, config.frame_nms_m)) if config.frame_nms_m > 0 else points.select("idx", F.col("idx").alias("keeper"))
    kept = points.join(keepers.where("idx = keeper").select("idx"), "idx", "left_semi") if config.frame_nms_m > 0 else points
    clusters, crossing = _clustered(kept, config.eps_m, config.min_samples, config.drop_noise, config.gate if config.frame_exclusivity else None)
    if config.frame_exclusivity and crossing is not None:
        inner = clusters.join(crossing.select("idx"), "idx", "left_anti")
        clusters = inner.unionByName(split_conflicts(kept, crossing, config.gate))
    return keepers.join(clusters.select(F.col("idx").alias("keeper"), "cluster"), "keeper", "left").select("idx", "cluster")


def numbered(points: DataFrame, clusters: DataFrame) -> DataFrame:
    """cluster, number (from 1): clusters by mean x, then mean y, then first member."""
    centre = points.select("idx", "x", "y").join(clusters.where("cluster is not null"), "idx").groupBy("cluster").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.min("idx").alias("first"))
    return rank_all(centre, ["mx", "my", "first"]).select("cluster", F.col("rank").alias("number"))


def rank_all(df: DataFrame, by: list[str]) -> DataFrame:
    """df with rank (from 1) over the whole table: sorted by range, with each range's rows counted first, so that no
    single task holds the table."""
    parts = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_p", F.spark_partition_id())
    parts = checkpoint(parts)
    counts = parts.groupBy("_p").count().withColumn("before", F.sum("count").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)))
    within = F.row_number().over(W.partitionBy("_p").orderBy(*by))
    return parts.join(F.broadcast(counts.select("_p", F.coalesce("before", F.lit(0)).alias("_b"))), "_p").withColumn("rank", within + F.col("_b")).drop("_p", "_b")


def resolve(points: DataFrame, clusters: DataFrame) -> DataFrame:
    """One record per cluster: number, id, x, y, label, confidence, observations, frames, detections, spread, votes.

    Labels are counted before anything is gathered; the members of a record, which are its own content, come once.
    """
    member = points.join(clusters.where("cluster is not null"), "idx")
    # a row a cluster and label first
    by_label = member.groupBy("cluster", "label").agg(
        F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.max(F.struct("confidence", (-F.col("idx")).alias("i"))).alias("top"),
        F.collect_list(F.struct("idx", "detection_id", "frame_id", "x", "y")).alias("seen"))
    body = by_label.groupBy("cluster").agg(
        (F.sum("sx") / F.sum("n")).alias("x"), (F.sum("sy") / F.sum("n")).alias("y"), F.max_by("label", "top").alias("label"), F.max("top.confidence").alias("confidence"), F.sum("n").alias("n_observations"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", F.col("n").alias("count"))))).alias("label_votes"), F.array_sort(F.flatten(F.collect_list("seen"))).alias("seen"))
    far = F.array_max(F.transform("seen", lambda s: F.hypot(s.x - F.col("x"), s.y - F.col("y"))))
    body = checkpoint(body.withColumns({"frame_ids": F.array_sort(F.array_distinct(F.transform("seen", lambda s: s.frame_id))), "detection_ids": F.transform("seen", lambda s: s.detection_id), "spread_m": far, "first": F.get(F.col("seen"), 0).idx}).drop("seen"))
    numbers = rank_all(body.select("cluster", F.col("x").alias("mx"), F.col("y").alias("my"), "first"), ["mx", "my", "first"]).select("cluster", F.col("rank").alias("number"))
    out = body.drop("first").join(numbers, "cluster")
    return out.withColumns({"animal_id": F.format_string("A%05d", "number"), "class_conflict": F.size("label_votes") > 1})


def quantile(df: DataFrame, column: str, q: float) -> float | None:
    """The q-quantile (linear between ranks) of a column: its values are ranked over ranges, and two of them are read."""
    values = df.where(F.col(column).isNotNull()).select(column)
    ranked = checkpoint(rank_all(values, [column]))
    n = ranked.count()
    if not n:
        return None
    at = q * (n - 1)
    low = int(at)
    got = {r.rank: r[0] for r in ranked.where(F.col("rank").isin(low + 1, min(n, low + 2))).collect()}
    return got[low + 1] + (got[min(n, low + 2)] - got[low + 1]) * (at - low)


def density_spacing(points: DataFrame, share: float) -> float | None:
    """The quantile (linear) of the distances to the nearest box of the same frame; null with no such pair."""
    from .spatial import nearest_in_group

    return quantile(nearest_in_group(points, "frame_id"), "d", share)


def plan_density(spacing: float | None, config: DedupConfig) -> tuple[DedupConfig, str]:
    """(settings, mode): where objects stand closer than eps the radius shrinks to a share of their spacing."""
    if not config.adaptive or spacing is None or spacing >= config.eps_m:
        return config, "normal"
    from dataclasses import replace

    eps = min(max(config.spacing_share * spacing, config.min_eps_m), config.eps_m)
    return replace(config, eps_m=eps, split_gate_m=None, frame_nms_m=min(config.frame_nms_m, eps / 2)), "dense"


def link_lines(points: DataFrame, animals: DataFrame, r: float) -> DataFrame:
    """Pairs of records whose centres lie within r: candidates for a second look."""
    a = animals.select("number", "x", "y")
    return range_join(a, a, r, on=F.col("a.number") < F.col("b.number")).select(F.col("a.number").alias("a"), F.col("b.number").alias("b"))

"""Frame registration: each frame is moved onto the leave-one-out centres of its points' clusters.

The fit is a closed form over sums, so a pass is two grouped aggregations and a join: no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DedupConfig, RegistrationConfig
from .dedup import assign
from .lineage import checkpoint


def targets(points: DataFrame, clusters: DataFrame) -> DataFrame:
    """idx, frame_id, x, y and (tx, ty), the mean of the cluster's other points, for clusters of two or more."""
    member = points.select("idx", "frame_id", "x", "y").join(clusters.where("cluster is not null"), "idx")
    # sums of offsets from a fixed origin keep the last digits of large coordinates
    origin = points.agg(F.avg("x"), F.avg("y")).first()
    ox, oy = float(origin[0] or 0), float(origin[1] or 0)
    total = member.groupBy("cluster").agg(F.sum(F.col("x") - ox).alias("sx"), F.sum(F.col("y") - oy).alias("sy"), F.count("*").alias("n")).where("n > 1")
    return member.join(total, "cluster").select("idx", "frame_id", "x", "y", ((F.col("sx") - (F.col("x") - ox)) / (F.col("n") - 1) + ox).alias("tx"), ((F.col("sy") - (F.col("y") - oy)) / (F.col("n") - 1) + oy).alias("ty"))


def _sums(rows: DataFrame, centre: str) -> DataFrame:
    """Sums by frame over coordinates relative to the frame's centre struct."""
    sx, sy, dx, dy = F.col("x") - F.col(f"{centre}.x"), F.col("y") - F.col(f"{centre}.y"), F.col("tx") - F.col(f"{centre}.x"), F.col("ty") - F.col(f"{centre}.y")
    rows = rows.withColumns({"_sx": sx, "_sy": sy, "_dx": dx, "_dy": dy})
    s = lambda e: F.sum(F.expr(e))
    return rows.groupBy("frame_id").agg(F.count("*").alias("n"), F.first(centre).alias("c"), s("_sx").alias("sx"), s("_sy").alias("sy"), s("_dx").alias("dx"), s("_dy").alias("dy"),
                                        s("_sx*_sx+_sy*_sy").alias("ss"), s("_sx*_dx+_sy*_dy").alias("dot"), s("_sx*_dy-_sy*_dx").alias("cross"))


def similarity(sums: DataFrame, use: Column) -> DataFrame:
    """Per frame a (scale cos), b (scale sin), u, v: p -> centre + (a dx - b dy + u, b dx + a dy + v); where use is
    false a pure translation by the mean difference."""
    n = F.col("n")
    ss, dot, cross = F.col("ss") - (F.col("sx") ** 2 + F.col("sy") ** 2) / n, F.col("dot") - (F.col("sx") * F.col("dx") + F.col("sy") * F.col("dy")) / n, F.col("cross") - (F.col("sx") * F.col("dy") - F.col("sy") * F.col("dx")) / n
    fit = use & (ss > 0)
    a, b = F.when(fit, dot / ss).otherwise(1.0), F.when(fit, cross / ss).otherwise(0.0)
    out = sums.withColumns({"a": a, "b": b})
    return out.withColumns({"u": (F.col("dx") - (F.col("a") * F.col("sx") - F.col("b") * F.col("sy"))) / n, "v": (F.col("dy") - (F.col("b") * F.col("sx") + F.col("a") * F.col("sy"))) / n, "similar": fit})


def _moved() -> tuple[Column, Column]:
    px, py = F.col("x") - F.col("c.x"), F.col("y") - F.col("c.y")
    return F.col("a") * px - F.col("b") * py + F.col("u") + F.col("c.x"), F.col("b") * px + F.col("a") * py + F.col("v") + F.col("c.y")


def estimate(points: DataFrame, clusters: DataFrame, config: RegistrationConfig, trim: float) -> DataFrame:
    """frame_id, c, a, b, u, v, model, n_matches, rotation_deg, scale, shift for every frame with points."""
    centres = points.groupBy("frame_id").agg(F.struct(F.avg("x").alias("x"), F.avg("y").alias("y")).alias("centre"))
    rows = checkpoint(targets(points, clusters).join(centres, "frame_id"))
    first = _sums(rows, "centre")
    radius = F.sqrt((F.col("ss") - (F.col("sx") ** 2 + F.col("sy") ** 2) / F.col("n")) / F.col("n"))
    first = similarity(first.withColumn("wide", (F.col("n") >= config.min_matches) & (radius >= config.min_spread_m)), F.col("wide"))
    mx, my = _moved()
    fitted = rows.join(first.select("frame_id", "c", "a", "b", "u", "v", "wide", F.col("n").alias("n_all")), "frame_id")
    fitted = fitted.withColumn("good", F.hypot(mx - F.col("tx"), my - F.col("ty")) <= trim)
    kept = _sums(fitted.where("good"), "centre").join(first.select("frame_id", "wide", F.col("n").alias("n_all")), "frame_id")
    again = similarity(kept, F.col("wide") & (F.col("n") >= 3)).where("n < n_all")
    shape = ["frame_id", "c", "n", "a", "b", "u", "v", "similar"]
    mean = kept.select("frame_id", (F.col("dx") - F.col("sx")).alias("kx"), (F.col("dy") - F.col("sy")).alias("ky"), F.col("n").alias("kn"))
    mean_all = first.select("frame_id", (F.col("dx") - F.col("sx")).alias("ax"), (F.col("dy") - F.col("sy")).alias("ay"), F.col("n").alias("an"))
    best = first.join(again.select("frame_id", F.struct(*shape[2:]).alias("r")), "frame_id", "left").select("frame_id", "c", *(F.coalesce(f"r.{k}", k).alias(k) for k in shape[2:]))
    best = best.join(mean, "frame_id", "left").join(mean_all, "frame_id").withColumns({"mx": F.coalesce(F.col("kx") / F.col("kn"), F.col("ax") / F.col("an")), "my": F.coalesce(F.col("ky") / F.col("kn"), F.col("ay") / F.col("an"))})
    scale, turn = F.hypot("a", "b"), F.degrees(F.atan2("b", "a"))
    all_points = points.select("frame_id", "x", "y").join(best.select("frame_id", "c", "a", "b", "u", "v"), "frame_id")
    shift = all_points.groupBy("frame_id").agg(F.max(F.hypot(mx - F.col("x"), my - F.col("y"))).alias("shift"))
    judged = best.join(shift, "frame_id").withColumns({
        "wild": (F.col("shift") > config.max_shift_m) | (F.abs(turn) > config.max_rotation_deg) | (F.abs(scale - 1) > config.max_scale),
        "far": F.hypot("mx", "my") > config.max_shift_m,
    })
    pick = lambda fit, move, none: F.when(~F.col("wild"), fit).when(~F.col("far"), move).otherwise(none)
    zero, one = F.lit(0.0), F.lit(1.0)
    out = judged.select("frame_id", "c", pick(F.col("a"), one, one).alias("a"), pick(F.col("b"), zero, zero).alias("b"), pick(F.col("u"), F.col("mx"), zero).alias("u"), pick(F.col("v"), F.col("my"), zero).alias("v"),
                        pick(F.when(F.col("similar"), "similarity").otherwise("translation"), F.lit("translation"), F.lit("none")).alias("model"), pick(F.col("n"), F.coalesce("kn", "an"), F.col("an")).alias("n_matches"))
    every = centres.join(out.drop("c"), "frame_id", "left")
    return every.select("frame_id", F.col("centre").alias("c"), F.coalesce("a", one).alias("a"), F.coalesce("b", zero).alias("b"), F.coalesce("u", zero).alias("u"), F.coalesce("v", zero).alias("v"), F.coalesce("model", F.lit("none")).alias("model"), F.coalesce("n_matches", F.lit(0)).alias("n_matches"))


def move(points: DataFrame, fits: DataFrame) -> DataFrame:
    mx, my = _moved()
    return points.join(fits.select("frame_id", "c", "a", "b", "u", "v"), "frame_id").withColumns({"x": mx, "y": my}).select(*points.columns)


def register(points: DataFrame, config: DedupConfig, registration: RegistrationConfig) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(points moved, clusters idx-cluster, corrections of the frames) after all passes; every pass moves all frames at
    once, then clusters anew."""
    raw = now = checkpoint(points)
    clusters = checkpoint(assign(now, config))
    fits = None
    trim = registration.trim_m if registration.trim_m is not None else config.eps_m
    for _ in range(registration.iterations):
        fits = checkpoint(estimate(now, clusters, registration, trim))
        now = checkpoint(move(now, fits))
        clusters = checkpoint(assign(now, config))
    return now, clusters, corrections(raw, now, fits) if fits is not None else None


def corrections(raw: DataFrame, final: DataFrame, fits: DataFrame) -> DataFrame:
    """frame_id, model, n_matches, dx_m, dy_m, rotation_deg, scale: refitted from raw to final places."""
    rows = raw.select("idx", "frame_id", "x", "y").join(final.select("idx", F.col("x").alias("tx"), F.col("y").alias("ty")), "idx")
    centres = rows.groupBy("frame_id").agg(F.struct(F.avg("x").alias("x"), F.avg("y").alias("y")).alias("centre"))
    sums = _sums(rows.join(centres, "frame_id"), "centre")
    spread = (F.col("ss") - (F.col("sx") ** 2 + F.col("sy") ** 2) / F.col("n")) > 1e-9
    fit = similarity(sums, (F.col("n") >= 2) & spread)
    return fit.join(fits.select("frame_id", "model", "n_matches"), "frame_id").select("frame_id", "model", "n_matches", ((F.col("dx") - F.col("sx")) / F.col("n")).alias("dx_m"), ((F.col("dy") - F.col("sy")) / F.col("n")).alias("dy_m"), F.degrees(F.atan2("b", "a")).alias("rotation_deg"), F.hypot("a", "b").alias("scale"))

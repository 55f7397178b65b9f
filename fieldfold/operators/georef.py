"""Pixels to metric ground points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.camera import MAX_RANGE, attitude, cast, focal_px
from ..functions.geo import Utm
from .dedup import quantile


def survey_zone(frames: DataFrame) -> Utm:
    """The UTM zone of the medians of all frames' latitudes and longitudes."""
    lat, lon = quantile(frames, "latitude", 0.5), quantile(frames, "longitude", 0.5)
    if lat is None:
        raise ValueError("a survey needs at least one frame")
    return Utm.at(lat, lon)


def georeference(frames: DataFrame, detections: DataFrame, utm: Utm, max_range: float = MAX_RANGE) -> DataFrame:
    """detections with x, y on the ground and valid; pixel places as px, py. Camera terms are computed once a frame."""
    lon, lat = F.col("longitude"), F.col("latitude")
    frames = utm.place(utm.place(frames, lon, lat, "_e", "_n"), lon, lat + 1e-4, "_e1", "_n1")
    # headings are from true north, the grid from grid north
    frames = frames.withColumn("_g", F.col("heading_deg") + F.degrees(F.atan2(F.col("_e1") - F.col("_e"), F.col("_n1") - F.col("_n"))))
    axes = attitude(F.col("_g"), F.col("gimbal_pitch_deg"), F.col("gimbal_roll_deg"))
    f = focal_px(F.col("image_width").cast("double"), F.col("image_height").cast("double"), F.col("fov_deg"), F.col("fov_type"))
    terms = {"_e": F.col("_e"), "_n": F.col("_n"), "_f": f, "_cx": F.coalesce("cx", F.col("image_width") / 2.0), "_cy": F.coalesce("cy", F.col("image_height") / 2.0), "_h": F.col("altitude_agl_m")}
    terms |= {f"_{a}{k}": axis[k] for a, axis in zip("rdf", axes, strict=True) for k in range(3)}
    cams = frames.select("frame_id", *(c.alias(k) for k, c in terms.items()))
    rows = detections.withColumnsRenamed({"x": "px", "y": "py"}).join(cams, "frame_id")
    axis = lambda a: tuple(F.col(f"_{a}{k}") for k in range(3))
    de, dn, ok = cast(F.col("px"), F.col("py"), F.col("_cx"), F.col("_cy"), F.col("_f"), F.col("_h"), (axis("r"), axis("d"), axis("f")), max_range=max_range)
    return rows.withColumns({"x": F.col("_e") + de, "y": F.col("_n") + dn, "valid": ok}).drop(*terms)


def footprints(frames: DataFrame, utm: Utm, max_range: float = MAX_RANGE) -> DataFrame:
    """frame_id, corner (0 to 3), x, y: the ground under each image's corners that see the ground."""
    corners = F.posexplode(F.array(*(F.struct((F.col("image_width") * a).cast("double").alias("x"), (F.col("image_height") * b).cast("double").alias("y")) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1)))))
    points = frames.select("frame_id", corners.alias("corner", "p")).select("frame_id", "corner", "p.x", "p.y")
    return georeference(frames, points, utm, max_range).where("valid").select("frame_id", "corner", "x", "y")

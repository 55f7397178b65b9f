"""Outputs: record tables, audit trail, corrections, GeoJSON, datasets, the map report."""

from __future__ import annotations

import json
import os
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from ..plans.survey import Result

REJECTED = "REJECTED_NO_GROUND_INTERSECTION"
REPORT_VERSION = 1


def fixed(c: Column | str, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", c)


def votes_json(c: Column) -> Column:
    """A vote map as JSON with sorted keys, ", " and ": " between."""
    pair = lambda e: F.concat(F.lit('"'), F.regexp_replace(e.key, r'(["\\])', r"\\$1"), F.lit('": '), e.value.cast("string"))
    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_entries(c)), pair), ", "), F.lit("}"))


def animals_table(r: Result) -> DataFrame:
    a = r.animals
    return a.orderBy("number").select("animal_id", "label", fixed("confidence", 4).alias("confidence"), fixed("latitude", 8).alias("latitude"), fixed("longitude", 8).alias("longitude"), fixed("x", 3).alias("easting"), fixed("y", 3).alias("northing"),
                                      "n_observations", F.size("frame_ids").alias("n_frames"), fixed("spread_m", 3).alias("spread_m"), F.col("class_conflict").cast("int").alias("class_conflict"), votes_json(F.col("label_votes")).alias("label_votes"),
                                      F.array_join("frame_ids", ";").alias("frame_ids"), F.array_join("detection_ids", ";").alias("detection_ids"), F.lit(r.utm.epsg).alias("utm_epsg"))


def assignments_table(r: Result) -> DataFrame:
    """Every detection with its place before and after alignment and its record; rejected ones at the end."""
    names = r.clusters.join(_numbers(r), "cluster", "left").select("idx", "animal_id")
    raw = r.raw.select("idx", F.col("x").alias("rx"), F.col("y").alias("ry"))
    kept = r.ground.join(raw, "idx").join(names, "idx", "left").select("idx", "detection_id", "frame_id", "label", fixed("confidence", 4).alias("confidence"), fixed("rx", 3).alias("raw_easting"), fixed("ry", 3).alias("raw_northing"), fixed("x", 3).alias("easting"), fixed("y", 3).alias("northing"), F.coalesce("animal_id", F.lit("")).alias("animal_id"))
    blank = [F.lit("").alias(c) for c in ("frame_id", "label", "confidence", "raw_easting", "raw_northing", "easting", "northing")]
    gone = r.rejected.select((F.col("idx") + (1 << 62)).alias("idx"), "detection_id", *blank, F.lit(REJECTED).alias("animal_id"))
    return kept.unionByName(gone).orderBy("idx").drop("idx")


def _numbers(r: Result) -> DataFrame:
    return r.animals.select("cluster", "animal_id", "number")


def corrections_table(r: Result) -> DataFrame:
    return r.corrections.orderBy("frame_id").select("frame_id", "model", "n_matches", fixed("dx_m", 3).alias("dx_m"), fixed("dy_m", 3).alias("dy_m"), fixed("rotation_deg", 4).alias("rotation_deg"), fixed("scale", 5).alias("scale"))


def features(r: Result) -> DataFrame:
    """One GeoJSON feature a record, as text."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array("longitude", "latitude").alias("coordinates"))
    properties = F.struct("animal_id", "label", F.round("confidence", 4).alias("confidence"), "n_observations", F.round("spread_m", 3).alias("spread_m"), "class_conflict", "frame_ids")
    return r.animals.orderBy("number").select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties"))).alias("value"))


def statuses(r: Result) -> DataFrame:
    """idx, animal_id, status: kept (the most confident of a record, the first of equals), duplicate, or noise."""
    rank = F.row_number().over(W.partitionBy("cluster").orderBy(F.desc("confidence"), "idx"))
    rows = r.ground.select("idx", "confidence").join(r.clusters, "idx", "left").withColumn("rank", rank).join(_numbers(r), "cluster", "left")
    return rows.select("idx", "animal_id", F.when(F.col("cluster").isNull(), "noise").when(F.col("rank") == 1, "kept").otherwise("duplicate").alias("status"))


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of part files at scale; a single file where the path ends in .csv."""
    if not path.endswith(".csv"):
        df.write.mode("overwrite").option("header", True).csv(path)
        return
    with _atomic(path) as sink:
        import csv

        w = csv.writer(sink)
        w.writerow(df.columns)
        w.writerows(df.toLocalIterator(prefetchPartitions=True))


class _atomic:
    """A file that appears whole or not at all."""

    def __init__(self, path: str):
        self.path, self.part = path, f"{path}.part"

    def __enter__(self):
        os.makedirs(os.path.dirname(os.path.abspath(self.path)), exist_ok=True)
        self.sink = open(self.part, "w", encoding="utf-8", newline="")  # noqa: SIM115
        return self.sink

    def __exit__(self, kind, *_):
        self.sink.close()
        if kind is None:
            os.replace(self.part, self.path)
        else:
            os.unlink(self.part)


def write_geojson(r: Result, path: str) -> None:
    with _atomic(path) as sink:
        sink.write('{"type": "FeatureCollection", "features": [')
        for i, row in enumerate(features(r).toLocalIterator()):
            sink.write(("," if i else "") + "\n" + row.value)
        sink.write("\n]}\n")


def dataset_rows(frames: DataFrame, detections: DataFrame) -> DataFrame:
    """frames nested with their detections, rounded as datasets are saved (the camera's centre isn't)."""
    d = detections.groupBy("frame_id").agg(F.array_sort(F.collect_list(F.struct("idx", F.struct("detection_id", F.round("x", 2).alias("x"), F.round("y", 2).alias("y"), "label", F.round("confidence", 4).alias("confidence"), "truth_id").alias("d")))).alias("ds"))
    camera = F.struct("image_width", "image_height", "fov_deg", "fov_type")
    return frames.join(d, "frame_id", "left").orderBy("frame_order").select("frame_id", "timestamp", "latitude", "longitude", "altitude_agl_m", "heading_deg", "gimbal_pitch_deg", "gimbal_roll_deg", camera.alias("camera"), F.coalesce(F.transform("ds", lambda x: x.d), F.array()).alias("detections"))


def write_dataset(frames: DataFrame, detections: DataFrame, truth: DataFrame | None, path: str) -> None:
    with _atomic(path) as sink:
        sink.write('{"frames": [')
        for i, row in enumerate(dataset_rows(frames, detections).select(F.to_json(F.struct("*")).alias("v")).toLocalIterator()):
            sink.write(("," if i else "") + "\n" + row.v)
        sink.write("\n]")
        if truth is not None:
            sink.write(', "ground_truth": ' + json.dumps([r.asDict() for r in truth.orderBy("tid").drop("tid").toLocalIterator()]))
        sink.write("}\n")


def report(r: Result, warnings: list[str] | None = None, evaluation: dict | None = None) -> dict:
    """The map report of one survey, for a viewer: all records, detections, frames and paths with a summary."""
    lon, lat = r.utm.inverse(F.col("x"), F.col("y"))
    raw = r.raw.select("idx", lat.alias("raw_lat"), lon.alias("raw_lon"))
    r8 = lambda c, n: F.round(c, 8).alias(n)
    dets = (r.ground.withColumns({"lat": lat, "lon": lon}).join(raw, "idx").join(statuses(r), "idx").orderBy("idx")
            .select(F.col("detection_id").alias("id"), "frame_id", r8("lat", "lat"), r8("lon", "lon"), r8("raw_lat", "raw_lat"), r8("raw_lon", "raw_lon"), "label", F.round("confidence", 4).alias("confidence"), "animal_id", "status"))
    n = r.ground.groupBy("frame_id").count().unionByName(r.rejected.groupBy("frame_id").count()).groupBy("frame_id").agg(F.sum("count").alias("detections"))
    frames = r.frames.join(n, "frame_id", "left").orderBy("frame_order").select(F.col("frame_id").alias("id"), r8("latitude", "lat"), r8("longitude", "lon"), F.round("altitude_agl_m", 2).alias("altitude_agl_m"), F.round("heading_deg", 2).alias("heading_deg"), F.round("gimbal_pitch_deg", 2).alias("gimbal_pitch_deg"), F.coalesce("detections", F.lit(0)).alias("detections"), "timestamp")
    animals = r.animals.orderBy("number").select(F.col("animal_id").alias("id"), r8("latitude", "lat"), r8("longitude", "lon"), F.round("x", 3).alias("easting"), F.round("y", 3).alias("northing"), "label", F.round("confidence", 4).alias("confidence"), F.col("n_observations").alias("observations"), F.size("frame_ids").alias("frames"), F.round("spread_m", 3).alias("spread_m"), "class_conflict", "label_votes")
    rows = lambda df: [x.asDict(recursive=True) for x in df.collect()]  # noqa: E731  one survey's report, which a viewer loads whole
    frame_rows, animal_rows, det_rows = rows(frames), rows(animals), rows(dets)
    paths = flight_paths(r) or [{"name": "flight", "coordinates": [[f["lat"], f["lon"]] for f in frame_rows]}]
    places = [(a["lat"], a["lon"]) for a in [*animal_rows, *frame_rows]] + [tuple(c) for p in paths for c in p["coordinates"]]
    notes, d = list(warnings or []), r.density
    if d["mode"] == "dense":
        notes.append(f"Animals stand about {d['spacing_m']:.2f} m apart: frames were pre-aligned and the cluster radius went from {d['eps_m']:g} m to {d['eps_effective_m']:.2f} m.")
    summary = r.summary() | {"frames": len(frame_rows), "duplicate_detections": sum(x["status"] == "duplicate" for x in det_rows)}
    out = {"version": REPORT_VERSION, "summary": summary, "bounds": [[min(p[0] for p in places), min(p[1] for p in places)], [max(p[0] for p in places), max(p[1] for p in places)]] if places else None, "animals": animal_rows, "detections": det_rows,
           "rejected_detections": [x.detection_id for x in r.rejected.orderBy("idx").select("detection_id").collect()], "frames": frame_rows, "flight_paths": paths, "ingest": r.metadata.get("ingest"), "warnings": notes}
    return out | ({"evaluation": evaluation} if evaluation else {})


def flight_paths(r: Result) -> list[dict]:
    from ..operators.match import decimate

    samples = r.metadata.get("samples")
    if samples is None:
        return []
    by: dict[str, list] = {}
    for s in decimate(samples).orderBy("track", "seq").select("track", "latitude", "longitude").toLocalIterator():
        by.setdefault(s.track, []).append([s.latitude, s.longitude])
    return [{"name": k, "coordinates": v} for k, v in by.items()]


def write_json(value: dict, path: str) -> None:
    with _atomic(path) as sink:
        json.dump(value, sink)

"""The survey pipeline: frames and detections to one record per animal."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DedupConfig, IngestOptions, RegistrationConfig, SyncConfig
from ..functions.geo import Utm
from ..operators import align, dedup, match
from ..operators.georef import georeference, survey_zone
from ..operators.lineage import checkpoint
from ..operators.sync import synchronise
from ..sources import detections as boxes
from ..sources.dataset import Dataset
from ..sources.telemetry import read_telemetry


@dataclass
class Result:
    utm: Utm
    frames: DataFrame
    raw: DataFrame  # ground points as cast
    ground: DataFrame  # after alignment
    rejected: DataFrame
    clusters: DataFrame
    animals: DataFrame
    corrections: DataFrame | None
    density: dict
    sync: dict | None
    chosen: DedupConfig
    metadata: dict = field(default_factory=dict)

    def summary(self) -> dict:
        """Counters of the run."""
        n_ground, n_rejected, n_animals = self.ground.count(), self.rejected.count(), self.animals.count()
        keepers = checkpoint(dedup.suppress(self.ground, self.chosen.frame_nms_m))
        suppressed = keepers.where("idx <> keeper").count()
        kept = self.ground.join(keepers.where("idx = keeper").select("idx"), "idx", "left_semi")
        before = dedup.dbscan(kept, self.chosen.eps_m, self.chosen.min_samples, self.chosen.drop_noise).where("cluster is not null").select("cluster").distinct().count()
        return {
            "utm_epsg": self.utm.epsg, "input_detections": n_ground + n_rejected, "projected_detections": n_ground, "rejected_detections": n_rejected, "unique_animals": n_animals, "duplicates_removed": n_ground - n_animals,
            "dbscan_clusters": before, "frame_exclusivity_splits": n_animals - before, "label_counts": {r.label: r["count"] for r in self.animals.groupBy("label").count().orderBy("label").collect()},
            "registration": self._registration(), "density": self.density | ({"sync": self.sync} if self.sync else {}), "suppressed_duplicate_boxes": suppressed,
        }

    def _registration(self) -> dict:
        if self.corrections is None:
            return {"enabled": False}
        shift = F.hypot("dx_m", "dy_m")
        c = self.corrections.agg(F.count("*").alias("frames"), F.round(F.avg(shift), 3).alias("mean_shift_m"), F.round(F.max(shift), 3).alias("max_shift_m"), F.round(F.avg(F.abs("rotation_deg")), 3).alias("mean_abs_rotation_deg")).first().asDict()
        return {"enabled": True, "models": {r.model: r["count"] for r in self.corrections.groupBy("model").count().collect()}} | c


def run(dataset: Dataset, config: DedupConfig | None = None, registration: RegistrationConfig | None = RegistrationConfig(), sync: SyncConfig | None = None, max_range: float = 1000.0, progress: Callable[[str, float], None] | None = None) -> Result:  # noqa: B008
    """registration None: cluster once, without moving frames."""
    config, sync = config or DedupConfig(), sync or SyncConfig()
    tell = progress or (lambda stage, share: None)
    tell("georeference", 0.0)
    utm = survey_zone(dataset.frames)
    cast = checkpoint(georeference(dataset.frames, dataset.detections, utm, max_range))
    raw, rejected = cast.where("valid").drop("valid"), cast.where("not valid")
    tell("georeference", 1.0)
    spacing = dedup.density_spacing(raw, config.spacing_quantile) if config.adaptive else None
    chosen, mode = dedup.plan_density(spacing, config)
    ground, found = raw, None
    if mode == "dense":
        for radius in (sync.radius_m, 0.6):
            ground, found = synchronise(ground, replace(sync, radius_m=radius))
    tell("cluster", 0.0)
    if registration is None:
        clusters, corrections = checkpoint(dedup.assign(ground, chosen)), None
    else:
        ground, clusters, corrections = align.register(ground, chosen, registration)
        if corrections is not None and mode == "dense":
            corrections = align.corrections(raw, ground, corrections.select("frame_id", "model", "n_matches"))
    tell("align", 1.0)
    animals = dedup.resolve(ground, clusters)
    lon, lat = utm.inverse(F.col("x"), F.col("y"))
    animals = checkpoint(animals.withColumns({"longitude": lon, "latitude": lat}))
    return Result(utm, dataset.frames, raw, ground, rejected, clusters, animals, corrections, {"mode": mode, "spacing_m": spacing, "eps_m": config.eps_m, "eps_effective_m": chosen.eps_m}, found, chosen, dict(dataset.metadata))


def ingest(spark, telemetry: list[str], logs: list[str], options: IngestOptions | None = None, class_names: list[str] | None = None) -> tuple[Dataset, dict]:
    """Raw logs to a dataset and what was left out, by reason."""
    options = options or IngestOptions()
    samples = None
    for i, path in enumerate(telemetry):
        one = read_telemetry(spark, path, i)
        samples = one if samples is None else samples.unionByName(one)
    if samples is None or not logs:
        raise ValueError("ingest needs telemetry and detections")
    derived = match.derive_headings(samples) if options.derive_heading else samples.withColumn("heading_derived", F.lit(False))
    samples = checkpoint(derived)
    rows = boxes.placed(boxes.union([boxes.read_detections(spark, p, class_names) for p in logs]), options.width, options.height, options.anchor)
    matched = checkpoint(match.match(rows, samples, options))
    total = matched.count()
    if total == 0:
        raise ValueError("no detections found")
    left = {r.reason: r["count"] for r in match.unmatched(matched).collect()}
    outside = left.pop(match.OUTSIDE, 0)
    n_matched = total - outside - sum(left.values())
    if n_matched == 0:
        raise ValueError("no detection could be matched to telemetry")
    frames, dets = match.frames_of(matched)
    frames = frames.withColumns({"image_width": F.lit(options.width), "image_height": F.lit(options.height), "fov_deg": F.lit(options.fov_deg), "fov_type": F.lit(options.fov_type), "cx": F.lit(None).cast("double"), "cy": F.lit(None).cast("double")})
    dets = dets.withColumns({"detection_id": F.coalesce("detection_id", F.concat(F.lit("D"), F.lpad(F.col("idx").cast("string"), 7, "0"))), "truth_id": F.lit(None).cast("string")})
    report = {"detections_in": total, "matched": n_matched, "frames": frames.count(), "unmatched": left, "outside_image": outside, "headings_derived": samples.where("heading_derived").count(), "tracks": samples.select("track").distinct().count()}
    return Dataset(checkpoint(frames), checkpoint(dets), None, {"ingest": report, "samples": samples}), report

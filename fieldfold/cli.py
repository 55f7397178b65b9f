"""Command line: dedup, simulate, stress, validate, self-check, ingest, process, benchmark.

Exit codes: 0 fine, 1 a threshold was missed, 2 bad input.
"""

from __future__ import annotations

import argparse
import json
import sys
import time
from statistics import mean

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import __version__
from .config import DedupConfig, IngestOptions, RegistrationConfig
from .functions.geo import Utm
from .functions.mathx import NUMPY
from .operators import score
from .plans import progress as progress_
from .plans import survey
from .sources import dataset as datasets
from .sources import simulate as sim
from .sources import writers

# Options by group: flags and what argparse takes.
CLUSTER = {
    "--eps": {"type": float, "default": 2.0}, "--min-samples": {"type": int, "default": 1}, "--no-frame-exclusivity": {"action": "store_true"}, "--drop-noise": {"action": "store_true"}, "--no-adaptive-density": {"action": "store_true"},
    "--frame-nms": {"type": float, "default": 0.25}, "--max-range": {"type": float, "default": 1000.0}, "--no-registration": {"action": "store_true"}, "--registration-iterations": {"type": int, "default": 3},
}
INGEST = {
    "--telemetry": {"action": "append", "default": []}, "--detections": {"action": "append", "default": []}, "--image-width": {"type": int, "default": 4000}, "--image-height": {"type": int, "default": 3000}, "--fov": {"type": float, "default": 84.0},
    "--fov-type": {"default": "diagonal", "choices": ["horizontal", "vertical", "diagonal"]}, "--pitch": {"type": float, "default": -90.0}, "--altitude": {"type": float}, "--fps": {"type": float, "default": 30.0}, "--anchor": {"default": "center", "choices": ["center", "bottom"]},
    "--time-tolerance": {"type": float, "default": 0.5}, "--no-derive-heading": {"action": "store_true"}, "--class-names": {},
}


def session() -> SparkSession:
    spark = SparkSession.builder.appName("fieldfold").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _configs(a) -> dict:
    config = DedupConfig(eps_m=a.eps, min_samples=a.min_samples, frame_exclusivity=not a.no_frame_exclusivity, drop_noise=a.drop_noise, adaptive=not a.no_adaptive_density, frame_nms_m=a.frame_nms)
    passes = 0 if a.no_registration else a.registration_iterations
    return {"config": config, "registration": RegistrationConfig(iterations=passes) if passes > 0 else None, "max_range": a.max_range}


def _options(a) -> IngestOptions:
    return IngestOptions(a.image_width, a.image_height, a.fov, a.fov_type, a.pitch, a.altitude, a.fps, a.anchor, a.time_tolerance, not a.no_derive_heading)


def _names(a) -> list[str] | None:
    if not a.class_names:
        return None
    with open(a.class_names, encoding="utf-8") as f:
        return [x.strip() for x in f if x.strip()]


def _scores(r: survey.Result, d: datasets.Dataset, radius: float) -> dict:
    e, n = r.utm.forward(F.col("longitude"), F.col("latitude"))
    truth = d.truth.select("tid", "truth_id", "label", e.alias("x"), n.alias("y"))
    return {k: round(v, 6) if isinstance(v, float) else v for k, v in score.evaluate(r.ground, r.clusters, r.animals, truth, radius).items()}


def _has_truth(d: datasets.Dataset) -> bool:
    return d.truth is not None and d.truth.limit(1).count() > 0


def _write(r: survey.Result, a) -> None:
    for path, table in ((a.output, writers.animals_table), (a.assignments, writers.assignments_table), (getattr(a, "frame_corrections", None) if r.corrections is not None else None, writers.corrections_table)):
        if path:
            writers.write_csv(table(r), path)
    if a.geojson:
        writers.write_geojson(r, a.geojson)


def dedup(a) -> int:
    d, began = datasets.read_dataset(session(), a.input), time.time()
    r = survey.run(d, **_configs(a))
    _write(r, a)
    summary = {"input": a.input, "frames": d.frames.count(), **r.summary(), "runtime_s": round(time.time() - began, 3)}
    if a.evaluate:
        if not _has_truth(d):
            raise ValueError("--evaluate needs a dataset with ground_truth")
        summary["evaluation"] = _scores(r, d, r.density["eps_effective_m"])
    if a.summary_json:
        writers.write_json(summary, a.summary_json)
    print(json.dumps(summary, indent=2) if a.json else f"{summary['input_detections']} detections, {summary['unique_animals']} unique animals: {a.output}")
    return 0


def ingest(a) -> int:
    d, rep = survey.ingest(session(), a.telemetry, a.detections, _options(a), _names(a))
    writers.write_dataset(d.frames, d.detections, None, a.output)
    print(f"{a.output}: {rep['frames']} frames, {rep['matched']} of {rep['detections_in']} detections matched to telemetry")
    return 0


def process(a) -> int:
    tell = progress_.Progress(progress_.DATASET if a.dataset else progress_.RAW, progress_.print_event if a.progress else None)
    notes: list[str] = []
    tell("read", 0.0)
    if a.dataset:
        if a.telemetry or a.detections:
            raise ValueError("a dataset and raw logs can't be given together")
        d = datasets.read_dataset(session(), a.dataset)
    else:
        d, rep = survey.ingest(session(), a.telemetry, a.detections, _options(a), _names(a))
        notes += [f"{n} detections skipped: {why}" for why, n in sorted(rep["unmatched"].items())]
        notes += [f"{rep['outside_image']} detections lie outside the image"] * (rep["outside_image"] > 0)
        notes += [f"{rep['headings_derived']} headings were derived from the course flown"] * (rep["headings_derived"] > 0)
        tell("match", 1.0, detections=rep["matched"], frames=rep["frames"])
    r = survey.run(d, **_configs(a), progress=tell)
    tell("report", 0.0)
    rejected = r.rejected.count()
    notes += [f"{rejected} detections don't meet the ground and were left out"] * (rejected > 0)
    rep = writers.report(r, notes, _scores(r, d, r.density["eps_effective_m"]) if _has_truth(d) else None)
    writers.write_json(rep, a.report)
    _write(r, a)
    if a.dataset_out:
        writers.write_dataset(d.frames, d.detections, d.truth, a.dataset_out)
    tell("report", 1.0)
    s = rep["summary"]
    tell.done(f"Done: {s['unique_animals']} animals", report=a.report, summary=s)
    if not a.progress:
        print(f"{s['input_detections']} detections, {s['unique_animals']} unique animals ({s['duplicate_detections']} duplicates removed): {a.report}")
    return 0


def self_check(a) -> int:
    import platform

    import numpy
    import pyspark

    spark = session()
    east, _ = Utm.at(-33.87, 151.21).forward(151.21, -33.87, NUMPY)
    from .operators.dedup import dbscan

    p = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 0.0), (2, 9.0, 9.0)], "idx long, x double, y double")
    groups = dbscan(p, 2.0).select("cluster").distinct().count()
    info = {"ok": bool(abs(east - 334_163) < 5_000 and groups == 2), "version": __version__, "python": platform.python_version(), "spark": pyspark.__version__, "numpy": numpy.__version__, "utm_epsg": Utm.at(-33.87, 151.21).epsg}
    print(json.dumps(info) if a.json else "\n".join(f"{k}: {v}" for k, v in info.items()))
    return 0 if info["ok"] else 1


def simulate(a) -> int:
    given = {"seed": a.seed, "n_animals": a.animals, "altitude_agl_m": a.altitude, "gimbal_pitch_deg": a.pitch, "front_overlap": a.front_overlap, "side_overlap": a.side_overlap, "origin_latitude": a.lat, "origin_longitude": a.lon}
    s = sim.profile(a.profile, **{k: v for k, v in given.items() if v is not None})
    d = sim.simulate(session(), s)
    writers.write_dataset(d.frames, d.detections, d.truth, a.output)
    if a.export_raw:
        sim.export_logs(s, a.export_raw)
    print(f"{a.output}: {d.frames.count()} frames, {d.detections.count()} detections of {d.truth.count()} animals")
    return 0


def benchmark(a) -> int:
    spark, fine = session(), True
    for name in a.profile or ["standard"]:
        runs = []
        for k in range(a.runs):
            d = sim.simulate(spark, sim.profile(name, seed=a.seed + k, **({"n_animals": a.animals} if a.animals else {})))
            r = survey.run(d, **_configs(a))
            runs.append(_scores(r, d, r.density["eps_effective_m"]))
        count, f1 = mean(x["count_accuracy"] for x in runs), mean(x["f1"] for x in runs)
        removed = mean(1 - x["predicted_animals"] / x["raw_detections"] for x in runs)
        ok = count >= a.threshold and f1 >= a.threshold
        fine &= ok
        print(f"{name}: count accuracy {count:.2%}, F1 {f1:.2%}, {removed:.1%} of detections removed, {'pass' if ok else 'FAIL'}")
    return 0 if fine else 1


def stress(a) -> int:
    import tempfile

    spark, out = session(), []
    for n in a.animals:
        s = sim.scaled(sim.profile(a.profile, seed=a.seed), n)
        with tempfile.TemporaryDirectory() as folder:
            logs, began, laps = sim.export_logs(s, folder), time.time(), {}
            d, rep = survey.ingest(spark, [logs["telemetry"]], [logs["detections"]], IngestOptions(s.image_width, s.image_height, s.fov_deg, s.fov_type))
            laps["ingest_s"] = time.time() - began
            r = survey.run(d, **_configs(a))
            found = r.animals.count()
            laps["total_s"] = time.time() - began
        out.append({"animals": n, "detections": rep["detections_in"], "frames": rep["frames"], "predicted": found, "count_accuracy": score.accuracy(found, n), **{k: round(v, 2) for k, v in laps.items()}, "detections_per_s": round(rep["detections_in"] / laps["total_s"])})
        print(json.dumps(out[-1]), flush=True)
    if a.json:
        writers.write_json({"runs": out}, a.json)
    return 0 if min(x["count_accuracy"] for x in out) >= a.threshold else 1


def validate(a) -> int:
    if bool(a.truth) == bool(a.count):
        raise ValueError("give either --truth or --count")
    spark = session()
    animals = datasets.read_report(spark, a.report)
    if a.count:
        result = score.validate_counts(animals, score.parse_counts(a.count))
    else:
        truth = datasets.read_truth(spark, a.truth)
        first = truth.orderBy("tid").first()
        if first is None:
            raise ValueError(f"{a.truth} has no rows")
        utm = Utm.at(first.latitude, first.longitude)
        e, n = utm.forward(F.col("longitude"), F.col("latitude"))
        with open(a.report, encoding="utf-8") as f:
            own = (json.load(f).get("summary") or {}).get("density") or {}
        result = score.validate_points(animals.withColumns({"x": e, "y": n}), truth.withColumns({"x": e, "y": n}), a.radius or own.get("eps_effective_m") or 2.0)
    if a.json:
        writers.write_json(result, a.json)
    print(f"truth {result['truth']}, predicted {result['predicted']}, count accuracy {result['count_accuracy']:.2%}")
    return 0 if result["count_accuracy"] >= a.threshold else 1


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="fieldfold", description="One record per animal from overlapping aerial survey images.")
    top.add_argument("--version", action="version", version=__version__)
    sub = top.add_subparsers(dest="command", required=True)
    profiles = sorted(sim.PROFILES)
    out = {"--output": {"required": True}}
    files = {"--geojson": {}, "--assignments": {}}
    commands = {
        dedup: ({"input": {}}, out, files, {"--frame-corrections": {}, "--summary-json": {}, "--json": {"action": "store_true"}, "--evaluate": {"action": "store_true"}}, CLUSTER),
        simulate: (out, {"--profile": {"default": "standard", "choices": profiles}, "--seed": {"type": int}, "--animals": {"type": int}, **{f"--{k}": {"type": float} for k in ("altitude", "pitch", "front-overlap", "side-overlap", "lat", "lon")}, "--export-raw": {}}),
        stress: ({"--animals": {"type": int, "nargs": "+", "default": [7000, 14000, 28000]}, "--profile": {"default": "stress", "choices": profiles}, "--seed": {"type": int, "default": 0}, "--threshold": {"type": float, "default": 0.99}, "--json": {}}, CLUSTER),
        validate: ({"--report": {"required": True}, "--truth": {}, "--count": {}, "--radius": {"type": float}, "--threshold": {"type": float, "default": 0.99}, "--json": {}},),
        self_check: ({"--json": {"action": "store_true"}},),
        ingest: (INGEST, out),
        process: (INGEST, {"--dataset": {}, "--report": {"required": True}, "--output": {}, "--dataset-out": {}, "--progress": {"action": "store_true"}}, files, CLUSTER),
        benchmark: ({"--runs": {"type": int, "default": 10}, "--seed": {"type": int, "default": 0}, "--animals": {"type": int}, "--profile": {"action": "append", "choices": profiles}, "--threshold": {"type": float, "default": 0.99}}, CLUSTER),
    }
    for f, groups in commands.items():
        p = sub.add_parser(f.__name__.replace("_", "-"))
        for group in groups:
            for flag, how in group.items():
                p.add_argument(*(["-o", flag] if flag == "--output" else [flag]), **how)
        p.set_defaults(run=f)
    return top


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        return a.run(a)
    except (ValueError, OSError) as e:
        if getattr(a, "progress", False):
            progress_.print_event({"event": "error", "message": str(e)})
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())

import json

import pytest
from pyspark.sql import functions as F

from fieldfold.config import IngestOptions, RegistrationConfig
from fieldfold.operators import match, score
from fieldfold.plans import survey
from fieldfold.sources import dataset, detections, telemetry, writers
from fieldfold.sources.simulate import export_logs, profile, simulate


def scores(spark, name, registration=RegistrationConfig(), **changes):  # noqa: B008
    d = simulate(spark, profile(name, **changes))
    r = survey.run(d, registration=registration)
    e, n = r.utm.forward(F.col("longitude"), F.col("latitude"))
    truth = d.truth.select("tid", "truth_id", "label", e.alias("x"), n.alias("y"))
    return score.evaluate(r.ground, r.clusters, r.animals, truth, r.density["eps_effective_m"]), r


def test_ideal_survey_is_exact(spark):
    s, _ = scores(spark, "ideal", None, n_animals=60)
    assert s["f1"] == s["count_accuracy"] == 1 and s["mean_position_error_m"] < 1e-6


def test_noisy_survey(spark):
    s, r = scores(spark, "standard", n_animals=80)
    assert s["f1"] >= 0.99 and s["count_accuracy"] >= 0.98
    rep = writers.report(r)
    assert rep["summary"]["unique_animals"] == len(rep["animals"]) and {d["status"] for d in rep["detections"]} <= {"kept", "duplicate", "noise"}
    assert sum(d["status"] == "kept" for d in rep["detections"]) == len(rep["animals"])


def test_raw_logs_to_records_and_files(spark, tmp_path):
    p = export_logs(profile("ideal", n_animals=30), str(tmp_path))
    for kind in ("srt", "telemetry"):
        d, rep = survey.ingest(spark, [p[kind]], [p["detections"]])
        assert rep["unmatched"] == {} and rep["matched"] == rep["detections_in"]
        r = survey.run(d)
        assert r.animals.count() == 30
    truth = dataset.read_truth(spark, p["truth"])
    e, n = r.utm.forward(F.col("longitude"), F.col("latitude"))
    v = score.validate_points(r.animals, truth.select("tid", "label", e.alias("x"), n.alias("y")), 2.0)
    assert v["matched"] == 30 and v["missed"] == [] and v["extra"] == [] and v["count_error"] == 0
    writers.write_csv(writers.animals_table(r), str(tmp_path / "a.csv"))
    head, *body = (tmp_path / "a.csv").read_text().splitlines()
    assert head.startswith("animal_id,label,confidence,latitude,longitude,easting,northing,n_observations") and len(body) == 30
    writers.write_geojson(r, str(tmp_path / "a.geojson"))
    assert len(json.loads((tmp_path / "a.geojson").read_text())["features"]) == 30
    writers.write_dataset(d.frames, d.detections, None, str(tmp_path / "d.json"))
    again = dataset.read_json(spark, str(tmp_path / "d.json"))
    assert again.detections.count() == d.detections.count() and again.frames.count() == d.frames.count()
    writers.write_json(writers.report(r), str(tmp_path / "r.json"))
    assert dataset.read_report(spark, str(tmp_path / "r.json")).count() == 30


def test_subtitle_variants(spark):
    text = [
        "1\n00:00:00,000 --> 00:00:00,033\n<font>FrameCnt: 2, DiffTime: 33ms\n2024-03-08 10:12:34.123\n[latitude: -33.868810] [longitude: 151.2093] [rel_alt: 60.200 abs_alt: 120] [gb_yaw: -89.0 gb_pitch: -89.5]</font>",
        "1\n00:00:01,000 --> 00:00:02,000\nHOME(149.0251,-35.2345) 2019.01.01 12:00:00\nGPS(149.0253,-35.2346,19) BAROMETER:60.2\r\n\r\n2\n00:00:02,000 --> 00:00:03,000\nGPS(0,0,0)",
        "1\n00:00:01,5 --> 00:00:02,000\nF/2.8, ISO 100, GPS (149.0253, -35.2346, 19), D 24.18m, H 6.00m",
    ]
    df = spark.createDataFrame([(f"t{i}", 0, t) for i, t in enumerate(text)], "track string, track_order int, value string")
    a, b, c = telemetry.parse_srt(df).orderBy("track").collect()
    assert (a.latitude, a.altitude_agl_m, a.heading_deg, a.gimbal_pitch_deg, a.frame_number, a.timestamp) == (-33.86881, 60.2, 271.0, -89.5, 2, "2024-03-08 10:12:34.123")
    assert (b.latitude, b.longitude, b.altitude_agl_m, b.heading_deg) == (-35.2346, 149.0253, 60.2, None)
    assert (c.time_s, c.altitude_agl_m) == (1.5, 6.0)


def test_telemetry_units_and_headings(spark, tmp_path):
    f = tmp_path / "log.csv"
    f.write_text("Time(millisecond),Latitude,Longitude,Height Above Takeoff (feet),Gimbal Heading\n1000,-33,151,100,-90\n2000,0,0,100,5\n")
    (r,) = telemetry.read_csv(spark, str(f)).collect()
    assert (r.time_s, r.heading_deg) == (1.0, 270.0) and r.altitude_agl_m == pytest.approx(30.48)
    f.write_text("image,lat,lon,alt\n" + "".join(f"n{i}.jpg,{-33 + i * 1e-4},151,50\n" for i in range(4)) + "".join(f"s{i}.jpg,{-33 + (3 - i) * 1e-4},151.001,50\n" for i in range(4)))
    got = match.derive_headings(telemetry.read_csv(spark, str(f))).orderBy("seq").collect()
    assert [round(r.heading_deg) % 360 for r in got] == [0] * 4 + [180] * 4 and all(r.heading_derived for r in got)


@pytest.mark.parametrize(("text", "x", "y"), [("image,xmin,ymin,xmax,ymax,class,score\na.jpg,10,20,30,60,cow,0.9", 20, 40), ("image,x,y,width,height,label,confidence\na.jpg,10,20,20,40,cow,0.9", 20, 40), ("image,cx,cy,w,h,label,confidence\na.jpg,20,40,20,40,cow,0.9", 20, 40), ("frame,x,y,label,confidence\n7,20,40,cow,90", 20, 40)])
def test_box_logs(spark, tmp_path, text, x, y):
    f = tmp_path / "d.csv"
    f.write_text(text + "\n")
    (r,) = detections.read_detections(spark, str(f)).collect()
    assert (r.x, r.y, r.label, r.confidence) == (x, y, "cow", 0.9)


def test_json_coco_and_yolo(spark, tmp_path):
    f = tmp_path / "d.json"
    f.write_text(json.dumps({"detections": [{"image": "a.jpg", "bbox": [10, 20, 30, 60], "label": "cow", "score": 0.5}]}))
    (r,) = detections.read_detections(spark, str(f)).collect()
    assert (r.x, r.y, r.confidence) == (20, 40, 0.5)
    f.write_text(json.dumps({"images": [{"id": 1, "file_name": "a.jpg"}], "categories": [{"id": 3, "name": "cow"}], "annotations": [{"id": 9, "image_id": 1, "category_id": 3, "bbox": [100, 200, 50, 20]}, {"id": 10, "image_id": 7, "category_id": 4, "bbox": [1, 2, 3, 4]}]}))
    a, b = detections.read_detections(spark, str(f)).orderBy("id").collect()
    assert (a.x, a.y, a.label, a.frame_id) == (125, 210, "cow", "a.jpg") and (b.label, b.frame_id) == ("class_4", "7")
    (tmp_path / "IMG_1.txt").write_text("0 0.5 0.5 0.1 0.2 0.77\n\n1 2\n")
    rows = detections.read_detections(spark, str(tmp_path / "IMG_1.txt"), ["cow"])
    (r,) = detections.placed(rows, 4000, 3000, "center").collect()
    assert (r.x, r.y, r.x1, r.y2, r.label, r.confidence) == (2000, 1500, 1800, 1800, "cow", 0.77)


def test_counts_and_accuracy():
    assert score.parse_counts("150") == {"": 150} and score.parse_counts("cattle=120, Sheep=30") == {"cattle": 120, "sheep": 30}
    with pytest.raises(ValueError):
        score.parse_counts("cattle")
    assert score.accuracy(148, 150) == pytest.approx(1 - 2 / 150) and score.accuracy(0, 0) == 1


def test_options_are_checked():
    with pytest.raises(ValueError):
        IngestOptions(fps=0)


@pytest.mark.parametrize("name", ["standard", "harsh"])
def test_registration_by_small_tiles_equals_large_ones(spark, monkeypatch, name):
    from fieldfold.config import DedupConfig
    from fieldfold.operators import align, dedup
    from fieldfold.operators.georef import georeference, survey_zone
    from fieldfold.operators.lineage import checkpoint

    d = simulate(spark, profile(name, n_animals=25, false_positives_per_frame=0.3))
    p = checkpoint(georeference(d.frames, d.detections, survey_zone(d.frames)).where("valid").drop("valid"))
    r = RegistrationConfig(iterations=2)
    a, ca, fa = align.register(p, DedupConfig(), r)
    monkeypatch.setattr(dedup, "TILE_M", 10.0)
    monkeypatch.setattr(dedup, "TILE_RADII", 3)
    b, cb, fb = align.register(p, DedupConfig(), r)
    place = lambda df: [(x.idx, pytest.approx(x.x, abs=1e-5), pytest.approx(x.y, abs=1e-5)) for x in df.orderBy("idx").collect()]
    assert place(b) == [(x.idx, x.x, x.y) for x in a.orderBy("idx").collect()]
    groups = lambda df: sorted(sorted(g) for g in df.groupBy("cluster").agg(F.collect_list("idx").alias("g")).toPandas().g)
    assert groups(ca) == groups(cb)
    rows = lambda df: {x.frame_id: (x.model, x.n_matches, round(x.dx_m, 4) + 0.0, round(x.rotation_deg, 4) + 0.0) for x in df.collect()}
    assert rows(fa) == rows(fb)

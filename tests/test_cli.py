import json

from fieldfold import cli
from fieldfold.plans.progress import DATASET, Progress
from fieldfold.sources.classify import classify


def test_commands(spark, tmp_path, capsys):
    d, r = str(tmp_path / "d.json"), str(tmp_path / "r.json")
    assert cli.main(["simulate", "-o", d, "--profile", "ideal", "--animals", "20", "--export-raw", str(tmp_path / "raw")]) == 0
    assert cli.main(["dedup", d, "-o", str(tmp_path / "a.csv"), "--evaluate", "--json", "--no-registration"]) == 0
    s = json.loads(capsys.readouterr().out.split("\n", 1)[1])
    assert s["unique_animals"] == 20 and s["evaluation"]["f1"] == 1 and s["registration"] == {"enabled": False}
    raw = tmp_path / "raw"
    assert cli.main(["process", "--telemetry", str(raw / "flight.SRT"), "--detections", str(raw / "detections.csv"), "--report", r, "--progress", "--registration-iterations", "1"]) == 0
    events = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    shares = [e["percent"] for e in events]
    assert events[-1]["event"] == "done" and shares == sorted(shares) and events[-1]["summary"]["unique_animals"] == 20
    assert cli.main(["validate", "--report", r, "--truth", str(raw / "ground_truth.csv")]) == 0
    assert cli.main(["validate", "--report", r, "--count", "cattle=40"]) == 1
    assert cli.main(["validate", "--report", r]) == 2
    assert cli.main(["process", "--dataset", d, "--telemetry", "x.srt", "--report", r]) == 2
    assert cli.main(["self-check", "--json"]) == 0


def test_progress_never_falls():
    seen, now = [], [0.0]
    p = Progress(DATASET, seen.append, clock=lambda: now[0])
    for stage, share in (("read", 0.0), ("read", 1.0), ("cluster", 0.5), ("georeference", 0.2)):
        now[0] += 1
        p(stage, share, detections=3)
    assert [e["percent"] for e in seen] == [0.0, 10.0, 35.0, 35.0] and seen[-1]["counts"] == {"detections": 3}
    p("align", 0.1)
    p("align", 0.2)
    assert len(seen) == 4


def test_file_kinds():
    assert classify("a.SRT", "") == "telemetry" and classify("a.csv", "lat,lon,alt\n") == "telemetry"
    assert classify("a.csv", "image,xmin,ymin,xmax,ymax\n") == "detections" and classify("a.csv", "a,b\n") == "unknown"
    assert classify("a.csv", "frame_id,latitude,longitude,image_width,fov_deg,x,y") == "dataset"
    assert classify("a.json", '{"frames": []}') == "dataset" and classify("a.txt", "0 0.5 0.5 0.1 0.2") == "detections" and classify("a.bin", "") == "unknown"

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldfold.config import DedupConfig, SyncConfig
from fieldfold.operators import dedup, graph, sync


def ground(spark, places, frames, labels=None, confidences=None):
    n = len(places)
    rows = [(i, float(x), float(y), f, (labels or ["cattle"] * n)[i], float((confidences or [0.9] * n)[i]), f"D{i}") for i, ((x, y), f) in enumerate(zip(places, frames, strict=True))]
    return spark.createDataFrame(rows, "idx long, x double, y double, frame_id string, label string, confidence double, detection_id string")


def records(points, **config):
    clusters = dedup.assign(points, DedupConfig(**config))
    return dedup.resolve(points, clusters).orderBy("number").collect(), {r.idx: r.cluster for r in clusters.collect()}


def test_three_sightings_are_one(spark):
    a, _ = records(ground(spark, [(0, 0), (1, 0), (0.5, 0.8)], ["f1", "f2", "f3"]))
    assert len(a) == 1 and a[0].n_observations == 3 and (a[0].x, a[0].y) == pytest.approx((0.5, 0.8 / 3)) and a[0].animal_id == "A00001"


@pytest.mark.parametrize(("eps", "n"), [(2.0, 2), (2.5, 1), (3.0, 1)])
def test_radius_is_inclusive(spark, eps, n):
    assert len(records(ground(spark, [(0, 0), (2.5, 0)], ["f1", "f2"]), eps_m=eps)[0]) == n


@pytest.mark.parametrize(("exclusive", "n"), [(True, 2), (False, 1)])
def test_one_frame_shows_an_animal_once(spark, exclusive, n):
    assert len(records(ground(spark, [(0, 0), (1.2, 0)], ["f1", "f1"]), frame_exclusivity=exclusive)[0]) == n


def test_chained_neighbours_are_split(spark):
    places = [(x + d, d) for d in (0.0, 0.1, 0.2) for x in (0, 1.6)]
    a, _ = records(ground(spark, places, [f"f{k}" for k in range(3) for _ in range(2)]))
    assert [r.n_observations for r in a] == [3, 3]


def test_labels_by_confidence_and_votes(spark):
    a, _ = records(ground(spark, [(0, 0), (0.3, 0), (0.1, 0.2)], ["f1", "f2", "f3"], ["sheep", "cattle", "cattle"], [0.4, 0.95, 0.8]))
    assert a[0].label == "cattle" and a[0].confidence == 0.95 and a[0].class_conflict and a[0].label_votes == {"cattle": 2, "sheep": 1}


def test_noise(spark):
    p = ground(spark, [(0, 0), (0.5, 0), (50, 50)], ["f1", "f2", "f3"])
    assert len(records(p, min_samples=2)[0]) == 2
    a, c = records(p, min_samples=2, drop_noise=True)
    assert len(a) == 1 and c[2] is None


def test_double_boxes_join_their_keeper(spark):
    p = ground(spark, [(0, 0), (0.1, 0), (5, 0), (0.05, 0.02)], ["a", "a", "a", "b"], None, [0.6, 0.9, 0.8, 0.7])
    assert {r.idx: r.keeper for r in dedup.suppress(p, 0.25).collect()} == {0: 1, 1: 1, 2: 2, 3: 3}
    a, _ = records(p)
    assert sorted(r.n_observations for r in a) == [1, 3]
    assert len(records(p, frame_nms_m=0.0)[0]) == 3


def test_empty(spark):
    p = ground(spark, [(0, 0)], ["f"]).where("idx < 0")
    assert records(p) == ([], {})


def merged_by_rule(places, frames, gate):
    """The split's rule by brute force: in each round, mutually nearest parts without a common frame merge."""
    parts = {i: [i] for i in range(len(places))}
    linked = {(i, j) for i in parts for j in parts if i < j and frames[i] != frames[j] and np.hypot(*(places[i] - places[j])) <= gate}
    while True:
        centre = {k: places[v].mean(0) for k, v in parts.items()}
        seen = {k: {frames[i] for i in v} for k, v in parts.items()}
        linked = {(a, b) for a, b in linked if not seen[a] & seen[b]}
        near = sorted((float(np.hypot(*(centre[a] - centre[b]))), a, b) for a, b in linked)
        best = {}
        for link in near:
            if link[0] <= gate:
                for k in link[1:]:
                    best.setdefault(k, link)
        merge = {link[2]: link[1] for link in set(best.values()) if best[link[1]] == best[link[2]] == link}
        if not merge:
            out = {i: k for k, v in parts.items() for i in v}
            return [out[i] for i in range(len(places))]
        for b, a in merge.items():
            parts[a] = parts[a] + parts.pop(b)
        linked = {tuple(sorted((merge.get(a, a), merge.get(b, b)))) for a, b in linked} - {(k, k) for k in range(len(places))}


@pytest.mark.parametrize("seed", range(3))
def test_split_follows_its_rule(spark, seed):
    r = np.random.default_rng(seed)
    places, frames = np.round(r.random((90, 2)) * 6, 2), [f"f{k}" for k in r.integers(0, 7, 90)]
    p = ground(spark, [tuple(q) for q in places], frames)
    one = p.select("idx", F.lit(0).cast("long").alias("cluster"))
    got = {x.idx: x.cluster for x in dedup.split_conflicts(p, one, 0.8).collect()}
    want = merged_by_rule(places, frames, 0.8)
    assert len(set(want)) < 80
    assert [got[i] for i in range(90)] == want
    from fieldfold.operators import tiles

    assert tiles.split(places[:, 0], places[:, 1], np.array([int(f[1:]) for f in frames]), 0.8).tolist() == want


def test_small_tiles_change_nothing(spark, monkeypatch):
    r = np.random.default_rng(11)
    places, frames = np.round(r.random((300, 2)) * 24, 2), [f"f{k}" for k in r.integers(0, 9, 300)]
    p = ground(spark, [tuple(q) for q in places], frames)
    config = DedupConfig(eps_m=0.9)
    whole = {x.idx: x.cluster for x in dedup.assign(p, config).collect()}
    monkeypatch.setattr(dedup, "TILE_M", 4.0)
    monkeypatch.setattr(dedup, "TILE_RADII", 2)
    assert {x.idx: x.cluster for x in dedup.assign(p, config).collect()} == whole


def test_split_of_a_large_chain(spark):
    r = np.random.default_rng(4)
    grid = np.stack(np.meshgrid(np.arange(30) * 0.9, np.arange(30) * 0.9), -1).reshape(-1, 2)
    places = np.concatenate([grid + r.normal(0, 0.05, grid.shape) for _ in range(6)])
    p = ground(spark, [tuple(q) for q in places], [f"f{k}" for k in range(6) for _ in grid])
    parts = dedup.split_conflicts(p, p.select("idx", F.lit(0).cast("long").alias("cluster")), 0.4).collect()
    assert len(parts) == len(places) and abs(len({x.cluster for x in parts}) - 900) <= 5
    frame = {(x.cluster, x.idx // len(grid)) for x in parts}
    assert len(frame) == len(parts)


def test_offsets_are_recovered(spark):
    r = np.random.default_rng(1)
    grid = np.stack(np.meshgrid(np.arange(12) * 0.9, np.arange(12) * 0.9), -1).reshape(-1, 2)
    grid = grid + r.normal(0, 0.05, grid.shape)
    true = r.normal(0, 0.35, (6, 2))
    places = [tuple(q) for k in range(6) for q in grid + true[k] + r.normal(0, 0.02, grid.shape)]
    p = ground(spark, places, [f"f{k}" for k in range(6) for _ in grid])
    moved, info = sync.synchronise(p, SyncConfig())
    assert info["n_pairs"] == info["n_links"] == 15
    shift = moved.groupBy("frame_id").agg(F.avg("x").alias("x"), F.avg("y").alias("y")).orderBy("frame_id").collect()
    centre = np.array([(s.x, s.y) for s in shift])
    assert np.abs(centre - centre.mean(0)).max() < 0.05


def test_offsets_count_differences_in_a_disc(spark):
    """Thirty differences around (0.02, 0.02), one at 1.4 bins along both axes from the peak's middle: in the square, not in
    the disc."""
    config = SyncConfig()
    a = [(4.0 * k, 0.0) for k in range(31)]
    b = [(x + 0.02 + 0.001 * (k % 7), 0.02 + 0.001 * (k % 5)) if k < 30 else (x + 0.04 + 1.4 * config.bin_m, 0.04 + 1.4 * config.bin_m) for k, (x, _) in enumerate(a)]
    (o,) = sync.offsets(ground(spark, a + b, ["f0"] * 31 + ["f1"] * 31), config).collect()
    assert o.votes == 30


def test_density_plan():
    c, mode = dedup.plan_density(0.9, DedupConfig())
    assert mode == "dense" and c.eps_m == pytest.approx(0.405) and c.frame_nms_m == pytest.approx(0.2025)
    assert dedup.plan_density(2.0, DedupConfig())[1] == dedup.plan_density(None, DedupConfig())[1] == "normal"


def test_components(spark):
    r = np.random.default_rng(2)
    e = r.integers(0, 400, (300, 2))
    got = {x.node: x.root for x in graph.components(spark.createDataFrame([tuple(map(int, x)) for x in e], "a long, b long")).collect()}
    keep = e[e[:, 0] != e[:, 1]]
    assert got == dict(zip(*(v.tolist() for v in graph.roots(keep[:, 0], keep[:, 1])), strict=True))


def by_definition(places, eps, least, drop):
    """DBSCAN over the matrix of distances."""
    near = np.hypot(*(places[:, None] - places[None]).transpose(2, 0, 1)) <= eps
    core, n = near.sum(1) >= least, len(places)
    label = np.where(core, np.arange(n), n)
    while True:
        new = np.array([label[near[i] & core].min() if core[i] else n for i in range(n)])
        if (new == label).all():
            break
        label = new
    out = [int(label[i]) if core[i] else int(label[near[i] & core].min()) if (near[i] & core).any() else None if drop else i for i in range(n)]
    return out


@pytest.mark.parametrize("tile", [64.0, 5.0])
@pytest.mark.parametrize(("least", "drop"), [(1, False), (3, False), (3, True)])
def test_clusters_by_definition(spark, monkeypatch, least, drop, tile):
    monkeypatch.setattr(dedup, "TILE_M", tile)
    monkeypatch.setattr(dedup, "TILE_RADII", 2)
    places = np.round(np.random.default_rng(7).random((400, 2)) * 25, 2)
    p = ground(spark, [tuple(q) for q in places], ["f"] * 400)
    got = {x.idx: x.cluster for x in dedup.dbscan(p, 1.0, least, drop).collect()}
    assert [got[i] for i in range(400)] == by_definition(places, 1.0, least, drop)


def test_quantile_between_ranks(spark):
    v = np.random.default_rng(1).random(201).tolist()
    df = spark.createDataFrame([(x,) for x in v], "v double")
    for q in (0.0, 0.1, 0.5, 0.987, 1.0):
        assert dedup.quantile(df, "v", q) == pytest.approx(np.quantile(v, q))
    assert dedup.quantile(df.where("v > 2"), "v", 0.5) is None


def slow_course(lat, lon, least, turn):
    """The headings by looking ahead and back from each sample in turn."""
    from fieldfold.functions.geo import bearing, haversine
    from fieldfold.functions.mathx import NUMPY

    n = len(lat)
    far = lambda i, j: haversine(lat[i], lon[i], lat[j], lon[j], NUMPY) >= least
    ahead = [next((j for j in range(i + 1, n) if far(i, j)), None) for i in range(n)]
    back = [next((j for j in range(i - 1, -1, -1) if far(i, j)), None) for i in range(n)]
    course = lambda i, j: None if i is None or j is None else float(bearing(lat[i], lon[i], lat[j], lon[j], NUMPY))
    apart = lambda a, b: abs((a - b + 180) % 360 - 180) > turn
    out = []
    for i in range(n):
        leaving, coming = course(i, ahead[i]), course(back[i], i)
        before = course(back[back[i]], back[i]) if back[i] is not None else None
        own = leaving is None or (coming is not None and before is not None and apart(leaving, coming) and not apart(before, coming))
        out.append(coming if own else leaving)
    return np.array([np.nan if x is None else x for x in out])


@pytest.mark.parametrize("seed", range(4))
def test_courses_of_wandering_and_hovering_tracks(seed):
    from fieldfold.operators.match import course_over_ground

    r = np.random.default_rng(seed)
    step = r.normal(0, 1, (300, 2)) * np.repeat(r.choice([1e-7, 5e-6, 3e-5], 30), 10)[:, None]
    lat, lon = (-33.8 + step[:, 0].cumsum()), (151.2 + step[:, 1].cumsum())
    assert np.allclose(course_over_ground(lat, lon, 2.0, 30.0), slow_course(lat, lon, 2.0, 30.0), equal_nan=True)


def test_a_hovering_track_takes_its_time_in_proportion():
    import time

    from fieldfold.operators.match import course_over_ground

    r = np.random.default_rng(0)
    lat, lon = -33.8 + r.normal(0, 1e-7, 200_000), 151.2 + r.normal(0, 1e-7, 200_000)
    began = time.time()
    assert np.isnan(course_over_ground(lat, lon, 2.0, 30.0)).all()
    assert time.time() - began < 30


def test_matches_against_all_assignments(spark):
    from itertools import permutations

    from fieldfold.operators import score

    r = np.random.default_rng(3)
    for seed in range(3):
        a, b = r.random((5, 2)) * 3, r.random((6, 2)) * 3
        d = np.hypot(*(a[:, None] - b[None]).transpose(2, 0, 1))
        best = max(((sum(d[i, j] <= 1.2 for i, j in enumerate(p)), -sum(d[i, j] for i, j in enumerate(p) if d[i, j] <= 1.2)) for p in permutations(range(6), 5)))
        df = lambda v, name: spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(v)], f"{name} long, x double, y double")
        got = score.match_points(df(a, "pid"), df(b, "tid"), 1.2).collect()
        assert len({x.pid for x in got}) == len({x.tid for x in got}) == len(got) == best[0] and sum(x.distance for x in got) == pytest.approx(-best[1])

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldfold.functions import camera
from fieldfold.functions.geo import Utm, zone_column, zone_of
from fieldfold.functions.mathx import NUMPY


@pytest.mark.parametrize(("kind", "fov", "focal"), [("horizontal", 90.0, 2000.0), ("vertical", 90.0, 1500.0), ("diagonal", 90.0, 2500.0)])
def test_focal_length(kind, fov, focal):
    assert camera.focal_px(4000.0, 3000.0, fov, kind, NUMPY) == pytest.approx(focal)


@pytest.mark.parametrize(("lat", "lon", "epsg"), [(-33.87, 151.21, 32756), (51.5, -0.12, 32630), (60, 5.3, 32632), (78.2, 15.6, 32633)])
def test_epsg(lat, lon, epsg):
    assert Utm.at(lat, lon).epsg == epsg


def test_zone_edges(spark):
    assert zone_of(0, 180) == 1 and zone_of(0, 179.99) == 60
    places = [(0.0, 180.0), (0.0, 179.99), (60.0, 5.3), (78.2, 15.6), (75.0, 8.0), (-33.9, 151.2)]
    got = spark.createDataFrame(places, "lat double, lon double").select(zone_column(F.col("lat"), F.col("lon")).alias("z")).collect()
    assert [r.z for r in got] == [zone_of(*p) for p in places]


def test_known_place_and_round_trip():
    u = Utm(56, True)
    e, n = u.forward(np.array([151.21]), np.array([-33.87]), NUMPY)
    assert e[0] == pytest.approx(334435.706, abs=1e-3) and n[0] == pytest.approx(6250816.398, abs=1e-3)
    assert u.convergence(151.21, -33.87, NUMPY) == pytest.approx(-0.99781, abs=1e-4)
    lon, lat = u.inverse(e, n, NUMPY)
    assert abs(lon[0] - 151.21) < 1e-9 and abs(lat[0] + 33.87) < 1e-9
    assert u.forward(u.central_meridian, -20.0, NUMPY)[0] == pytest.approx(500000, abs=1e-6)
    assert u.convergence(u.central_meridian, -20.0, NUMPY) == pytest.approx(0, abs=1e-9)


def test_nadir_and_oblique_rays():
    f = 2000.0
    down = camera.attitude(0.0, -90.0, 0.0, NUMPY)
    assert camera.cast(2000.0, 1500.0, 2000.0, 1500.0, f, 60.0, down, NUMPY)[:2] == pytest.approx((0, 0), abs=1e-9)
    e, n, ok = camera.cast(3000.0, 1500.0, 2000.0, 1500.0, f, 60.0, down, NUMPY)
    assert ok and (e, n) == pytest.approx((30, 0), abs=1e-9)
    tilted = camera.attitude(90.0, -45.0, 0.0, NUMPY)
    e, n, ok = camera.cast(2000.0, 1500.0, 2000.0, 1500.0, f, 60.0, tilted, NUMPY)
    assert ok and (e, n) == pytest.approx((60, 0), abs=1e-9)
    assert not camera.cast(2000.0, 1500.0, 2000.0, 1500.0, f, 60.0, camera.attitude(0.0, 10.0, 0.0, NUMPY), NUMPY)[2]
    assert not camera.cast(2000.0, 1500.0, 2000.0, 1500.0, f, 60.0, camera.attitude(0.0, -1.0, 0.0, NUMPY), NUMPY, 1000.0)[2]


def test_projection_inverts_cast():
    r = np.random.default_rng(0)
    for _ in range(50):
        axes = camera.attitude(r.uniform(0, 360), r.uniform(-90, -50), r.uniform(-5, 5), NUMPY)
        u, v = r.uniform(0, 4000), r.uniform(0, 3000)
        e, n, ok = camera.cast(u, v, 2000.0, 1500.0, 2500.0, 50.0, axes, NUMPY)
        if ok:
            assert camera.project(e, n, 50.0, 2000.0, 1500.0, 2500.0, axes, NUMPY)[:2] == pytest.approx((u, v), abs=1e-6)
    assert math.isfinite(u)

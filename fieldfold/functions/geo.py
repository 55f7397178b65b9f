"""WGS84 and UTM by the Krueger series (Karney 2011), great circles, and tiles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mathx import COLUMN

# The WGS84 ellipsoid, UTM's scale and offsets, the mean earth radius.
SEMI_MAJOR, FLATTENING = 6378137.0, 1 / 298.257223563
SCALE, FALSE_EASTING, FALSE_NORTHING_SOUTH = 0.9996, 500000.0, 10000000.0
EARTH_RADIUS = 6371008.8

_n = FLATTENING / (2 - FLATTENING)
RECTIFYING = SEMI_MAJOR / (1 + _n) * (1 + _n**2 / 4 + _n**4 / 64 + _n**6 / 256)
# Series coefficients in powers of the third flattening.
ALPHA = (_n / 2 - 2 * _n**2 / 3 + 5 * _n**3 / 16 + 41 * _n**4 / 180, 13 * _n**2 / 48 - 3 * _n**3 / 5 + 557 * _n**4 / 1440, 61 * _n**3 / 240 - 103 * _n**4 / 140, 49561 * _n**4 / 161280)
BETA = (_n / 2 - 2 * _n**2 / 3 + 37 * _n**3 / 96 - _n**4 / 360, _n**2 / 48 + _n**3 / 15 - 437 * _n**4 / 1440, 17 * _n**3 / 480 - 37 * _n**4 / 840, 4397 * _n**4 / 161280)
DELTA = (2 * _n - 2 * _n**2 / 3 - 2 * _n**3 + 116 * _n**4 / 45, 7 * _n**2 / 3 - 8 * _n**3 / 5 - 227 * _n**4 / 45, 56 * _n**3 / 15 - 136 * _n**4 / 35, 4279 * _n**4 / 630)
_CONFORMAL = 2 * _n**0.5 / (1 + _n)


@dataclass(frozen=True)
class Utm:
    """One UTM zone; its constants become literals of the expressions."""

    zone: int
    south: bool

    @property
    def epsg(self) -> int:
        return (32700 if self.south else 32600) + self.zone

    @property
    def central_meridian(self) -> float:
        return 6.0 * self.zone - 183.0

    @property
    def false_northing(self) -> float:
        return FALSE_NORTHING_SOUTH if self.south else 0.0

    @classmethod
    def at(cls, latitude: float, longitude: float) -> Utm:
        return cls(zone_of(latitude, longitude), latitude < 0)

    def forward(self, longitude, latitude, m=COLUMN):
        """(easting, northing) of longitude and latitude in degrees."""
        phi, lam = m.radians(latitude), m.radians(longitude - self.central_meridian)
        t = m.sinh(m.atanh(m.sin(phi)) - m.atanh(m.sin(phi) * _CONFORMAL) * _CONFORMAL)
        return self.series(m.atan2(t, m.cos(lam)), m.atanh(m.sin(lam) / m.sqrt(t * t + 1.0)), m)

    def series(self, xi, eta, m=COLUMN):
        e, n = eta, xi
        for j, a in enumerate(ALPHA, 1):
            e = e + m.cos(xi * (2.0 * j)) * m.sinh(eta * (2.0 * j)) * a
            n = n + m.sin(xi * (2.0 * j)) * m.cosh(eta * (2.0 * j)) * a
        return e * (SCALE * RECTIFYING) + FALSE_EASTING, n * (SCALE * RECTIFYING) + self.false_northing

    def inverse(self, easting, northing, m=COLUMN):
        """(longitude, latitude) in degrees."""
        xi0, eta0 = (northing - self.false_northing) / (SCALE * RECTIFYING), (easting - FALSE_EASTING) / (SCALE * RECTIFYING)
        xi, eta = xi0, eta0
        for j, b in enumerate(BETA, 1):
            xi = xi - m.sin(xi0 * (2.0 * j)) * m.cosh(eta0 * (2.0 * j)) * b
            eta = eta - m.cos(xi0 * (2.0 * j)) * m.sinh(eta0 * (2.0 * j)) * b
        chi = m.asin(m.sin(xi) / m.cosh(eta))
        phi = chi
        for j, d in enumerate(DELTA, 1):
            phi = phi + m.sin(chi * (2.0 * j)) * d
        return m.degrees(m.atan2(m.sinh(eta), m.cos(xi))) + self.central_meridian, m.degrees(phi)

    def place(self, df: DataFrame, longitude: Column, latitude: Column, easting: str, northing: str) -> DataFrame:
        """df with easting and northing, worked out in stages: each intermediate value is a column, computed once a row,
        and the generated code stays small."""
        m, t = COLUMN, f"_{easting}_"
        df = df.withColumns({t + "phi": m.radians(latitude), t + "lam": m.radians(longitude - self.central_meridian)})
        df = df.withColumn(t + "t", m.sinh(m.atanh(m.sin(F.col(t + "phi"))) - m.atanh(m.sin(F.col(t + "phi")) * _CONFORMAL) * _CONFORMAL))
        df = df.withColumns({t + "xi": m.atan2(F.col(t + "t"), m.cos(F.col(t + "lam"))), t + "eta": m.atanh(m.sin(F.col(t + "lam")) / m.sqrt(F.col(t + "t") * F.col(t + "t") + 1.0))})
        e, n = self.series(F.col(t + "xi"), F.col(t + "eta"), m)
        return df.withColumns({easting: e, northing: n}).drop(*(t + k for k in ("phi", "lam", "t", "xi", "eta")))

    def convergence(self, longitude, latitude, m=COLUMN):
        """Degrees from true north to grid north, by a forward difference of 1e-4 degrees of latitude."""
        e0, n0 = self.forward(longitude, latitude, m)
        e1, n1 = self.forward(longitude, latitude + 1e-4, m)
        return m.degrees(m.atan2(e1 - e0, n1 - n0))


def zone_of(latitude: float, longitude: float) -> int:
    """UTM zone, with the exceptions for Norway and Svalbard."""
    if 56 <= latitude < 64 and 3 <= longitude < 12:
        return 32
    if 72 <= latitude <= 84 and 0 <= longitude < 42:
        return 31 if longitude < 9 else 33 if longitude < 21 else 35 if longitude < 33 else 37
    return int((longitude + 180) // 6) % 60 + 1


def zone_column(lat: Column, lon: Column) -> Column:
    north = (lat >= 72) & (lat <= 84) & (lon >= 0) & (lon < 42)
    return (
        F.when((lat >= 56) & (lat < 64) & (lon >= 3) & (lon < 12), 32)
        .when(north & (lon < 9), 31).when(north & (lon < 21), 33).when(north & (lon < 33), 35).when(north, 37)
        .otherwise(F.pmod(F.floor((lon + 180.0) / 6.0), F.lit(60)) + 1).cast("int")
    )


def epsg_column(lat: Column, lon: Column) -> Column:
    return F.when(lat < 0, 32700).otherwise(32600) + zone_column(lat, lon)


def haversine(lat1, lon1, lat2, lon2, m=COLUMN):
    """Great-circle distance in metres."""
    a = m.sin(m.radians(lat2 - lat1) / 2.0)
    b = m.sin(m.radians(lon2 - lon1) / 2.0)
    return m.asin(m.sqrt(a * a + m.cos(m.radians(lat1)) * m.cos(m.radians(lat2)) * b * b)) * (2.0 * EARTH_RADIUS)


def bearing(lat1, lon1, lat2, lon2, m=COLUMN):
    """Initial course in degrees clockwise from north, 0 to 360."""
    d = m.radians(lon2 - lon1)
    p, q = m.radians(lat1), m.radians(lat2)
    return m.mod(m.degrees(m.atan2(m.sin(d) * m.cos(q), m.cos(p) * m.sin(q) - m.sin(p) * m.cos(q) * m.cos(d))), 360.0)


def lerp(a: Column, b: Column, t: Column) -> Column:
    """Linear interpolation; where one side is missing, the other."""
    return F.coalesce(a + (b - a) * t, a, b)


def lerp_angle(a: Column, b: Column, t: Column) -> Column:
    """Interpolation along the shorter arc, in degrees 0 to 360; missing where a side is."""
    arc = F.pmod(b - a + 180.0, F.lit(360.0)) - 180.0
    return F.pmod(a + arc * t, F.lit(360.0))


def mercator(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Web-Mercator position in the unit square, y down."""
    s = F.sin(F.radians(lat))
    return lon / 360.0 + 0.5, F.lit(0.5) - F.log((s + 1.0) / (F.lit(1.0) - s)) / (4 * 3.141592653589793)


def tile(lat: Column, lon: Column, zoom: int) -> tuple[Column, Column]:
    """XYZ tile of a place."""
    x, y = mercator(lat, lon)
    edge = 2**zoom
    clip = lambda v: F.greatest(F.lit(0), F.least(F.lit(edge - 1), F.floor(v * edge))).cast("long")
    return clip(x), clip(y)

"""Named queries over the driver's tables and the SQL that each must equal.

The tables hold no flights, so events stand in: each is a box in the image of its user, users are frames on a
small grid of places, and views and clicks are telemetry samples and probes. Pixels, places and keys are integer
arithmetic followed by single IEEE operations, so both engines see the same numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DedupConfig, IngestOptions, RegistrationConfig, SyncConfig
from ..functions import camera, geo, text
from ..operators import align, dedup, georef, match, score, spatial, sync
from ..sources import detections as boxes
from ..sources import telemetry as logs
from . import survey

UTM = geo.Utm(56, True)
EPS = 1.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- the mapped tables, in Spark and in SQL ----

def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.selectExpr("event_id AS idx", "CAST(user_id AS STRING) AS frame_id", "CAST((event_id * 7919) % 4000 AS DOUBLE) AS x", "CAST((event_id * 104729) % 3000 AS DOUBLE) AS y", "CAST((event_id * 31) % 1000 AS DOUBLE) / 1000D AS confidence", "event_type AS label", "concat('D', event_id) AS detection_id", "CAST(NULL AS STRING) AS truth_id")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "events").select("user_id").distinct()
    return u.selectExpr("CAST(user_id AS STRING) AS frame_id", "user_id AS frame_order", "-3387e-2D + CAST(user_id % 15 AS DOUBLE) * 1e-4D AS latitude", "15121e-2D + CAST(user_id DIV 15 AS DOUBLE) * 1e-4D AS longitude", "CAST(60 + user_id % 7 AS DOUBLE) AS altitude_agl_m",
                        "CAST((user_id * 37) % 360 AS DOUBLE) AS heading_deg", "CAST(-90 + user_id % 25 AS DOUBLE) AS gimbal_pitch_deg", "0D AS gimbal_roll_deg", "4000 AS image_width", "3000 AS image_height", "84D AS fov_deg", "'diagonal' AS fov_type", "CAST(NULL AS DOUBLE) AS cx", "CAST(NULL AS DOUBLE) AS cy", "CAST(NULL AS STRING) AS timestamp")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground points whose places are exact in both engines."""
    e = table(spark, sf_dir, "events")
    return e.selectExpr("event_id AS idx", "CAST(user_id AS STRING) AS frame_id", "CAST((event_id * 7919) % 4000 AS DOUBLE) * 0.025D + CAST(user_id % 15 AS DOUBLE) * 11D AS x", "CAST((event_id * 104729) % 3000 AS DOUBLE) * 0.025D + CAST(user_id DIV 15 AS DOUBLE) * 11D AS y", "CAST((event_id * 31) % 1000 AS DOUBLE) / 1000D AS confidence", "event_type AS label", "concat('D', event_id) AS detection_id")


_FRAMES = """frames AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS frame_id, user_id, CAST(-3387e-2 AS DOUBLE) + CAST(user_id % 15 AS DOUBLE) * CAST(1e-4 AS DOUBLE) AS lat, CAST(15121e-2 AS DOUBLE) + CAST(user_id // 15 AS DOUBLE) * CAST(1e-4 AS DOUBLE) AS lon,
 CAST(60 + user_id % 7 AS DOUBLE) AS h, CAST((user_id * 37) % 360 AS DOUBLE) AS heading, CAST(-90 + user_id % 25 AS DOUBLE) AS pitch FROM events)"""
_POINTS = """p AS (SELECT event_id AS idx, CAST(user_id AS VARCHAR) AS frame_id, CAST((event_id * 7919) % 4000 AS DOUBLE) * CAST(0.025 AS DOUBLE) + CAST(user_id % 15 AS DOUBLE) * CAST(11 AS DOUBLE) AS x,
 CAST((event_id * 104729) % 3000 AS DOUBLE) * CAST(0.025 AS DOUBLE) + CAST(user_id // 15 AS DOUBLE) * CAST(11 AS DOUBLE) AS y, CAST((event_id * 31) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS confidence, event_type AS label, 'D' || event_id AS detection_id FROM events)"""
_DETS = "d AS (SELECT event_id AS idx, CAST(user_id AS VARCHAR) AS frame_id, CAST((event_id * 7919) % 4000 AS DOUBLE) AS x, CAST((event_id * 104729) % 3000 AS DOUBLE) AS y FROM events)"


def _series(names: tuple[str, str], first: str, second: str, coefficients: tuple[float, ...], sign: str) -> str:
    """Terms c * f(2j a) * g(2j b) of a UTM series in SQL."""
    return "".join(f" {sign} {names[0]}({2 * j}.0::DOUBLE * {first}) * {names[1]}({2 * j}.0::DOUBLE * {second}) * ({c!r})::DOUBLE" for j, c in enumerate(coefficients, 1))


def _forward_sql(tag: str, lat: str, lon: str) -> str:
    c, k = geo._CONFORMAL, geo.SCALE * geo.RECTIFYING
    return f"""radians({lat}) AS phi{tag}, radians({lon} - {UTM.central_meridian}::DOUBLE) AS lam{tag}, sinh(atanh(sin(phi{tag})) - atanh(sin(phi{tag}) * ({c!r})::DOUBLE) * ({c!r})::DOUBLE) AS t{tag}, atan2(t{tag}, cos(lam{tag})) AS xi{tag}, atanh(sin(lam{tag}) / sqrt(t{tag} * t{tag} + 1)) AS eta{tag},
 (eta{tag}{_series(('cos', 'sinh'), f'xi{tag}', f'eta{tag}', geo.ALPHA, '+')}) * ({k!r})::DOUBLE + 500000 AS e{tag}, (xi{tag}{_series(('sin', 'cosh'), f'xi{tag}', f'eta{tag}', geo.ALPHA, '+')}) * ({k!r})::DOUBLE + 10000000 AS n{tag}"""


_UTM_FRAMES = f"uf AS (SELECT *, {_forward_sql('0', 'lat', 'lon')}, {_forward_sql('1', 'lat + CAST(1e-4 AS DOUBLE)', 'lon')}, degrees(atan2(e1 - e0, n1 - n0)) AS conv FROM frames)"
_CAST = f"""c0 AS (SELECT d.idx, d.frame_id, radians(heading + conv) AS ps, radians(pitch) AS th, h, e0, n0, 2500.0::DOUBLE / tan(radians(84.0::DOUBLE) / 2) AS f, (x - 2000) / f AS a, (y - 1500) / f AS b, x AS u, y AS v FROM d JOIN uf USING (frame_id)),
c1 AS (SELECT *, a * cos(ps) + b * (sin(th) * sin(ps)) + cos(th) * sin(ps) AS wx, a * -sin(ps) + b * (sin(th) * cos(ps)) + cos(th) * cos(ps) AS wy, b * -cos(th) + sin(th) AS wz, sqrt(wx * wx + wy * wy + wz * wz) AS len, wz / len AS slope, CASE WHEN slope < -1e-6 THEN -h / slope END AS reach, coalesce(reach <= 1000, false) AS valid FROM c0)"""
_PAIRS = f"pairs AS (SELECT a.idx AS a, b.idx AS b FROM p a JOIN p b ON a.idx < b.idx AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {EPS * EPS}::DOUBLE)"
_COMPONENTS = """both_ways AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs), reach AS (SELECT idx AS node, idx AS root FROM p UNION SELECT e.b, r.root FROM reach r JOIN both_ways e ON e.a = r.node WHERE r.root < e.b), cc AS (SELECT node AS idx, min(root) AS cluster FROM reach GROUP BY node)"""
_CLUSTERS = f"WITH RECURSIVE {_POINTS}, {_PAIRS}, {_COMPONENTS}"

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _clusters(spark, sf_dir):
    p = points(spark, sf_dir)
    return p, dedup.dbscan(p, EPS)


# ---- projections ----

@query(f"WITH {_FRAMES}, {_UTM_FRAMES} SELECT frame_id, 32756 AS epsg, round(e0, 2) AS easting, round(n0, 2) AS northing, round(conv, 6) AS convergence FROM uf")
def prj_utm_forward(spark, sf_dir):
    f = frames(spark, sf_dir)
    e, n = UTM.forward(F.col("longitude"), F.col("latitude"))
    return f.select("frame_id", geo.epsg_column(F.col("latitude"), F.col("longitude")).alias("epsg"), F.round(e, 2).alias("easting"), F.round(n, 2).alias("northing"), F.round(UTM.convergence(F.col("longitude"), F.col("latitude")), 6).alias("convergence"))


@query(f"WITH {_FRAMES} SELECT frame_id, round(lat, 7) AS latitude, round(lon, 7) AS longitude FROM frames")
def prj_utm_inverse(spark, sf_dir):
    f = frames(spark, sf_dir)
    lon, lat = UTM.inverse(*UTM.forward(F.col("longitude"), F.col("latitude")))
    return f.select("frame_id", F.round(lat, 7).alias("latitude"), F.round(lon, 7).alias("longitude"))


@query(f"WITH {_FRAMES}, {_DETS}, {_UTM_FRAMES}, {_CAST} SELECT idx, valid, CASE WHEN valid THEN round(e0 + wx / len * reach, 2) END AS easting, CASE WHEN valid THEN round(n0 + wy / len * reach, 2) END AS northing FROM c1")
def prj_ray_cast(spark, sf_dir):
    g = georef.georeference(frames(spark, sf_dir), detections(spark, sf_dir), UTM)
    return g.select("idx", "valid", F.when(F.col("valid"), F.round("x", 2)).alias("easting"), F.when(F.col("valid"), F.round("y", 2)).alias("northing"))


@query(f"WITH {_FRAMES}, {_DETS}, {_UTM_FRAMES}, {_CAST} SELECT idx, round(u, 3) AS u, round(v, 3) AS v FROM c1 WHERE valid")
def prj_ground_to_pixel(spark, sf_dir):
    """Cast to the ground and back into the image: the pixels come out again."""
    g = georef.georeference(frames(spark, sf_dir), detections(spark, sf_dir), UTM).where("valid").select("idx", "frame_id", "x", "y")
    rows = g.join(frames(spark, sf_dir), "frame_id")
    lon, lat = F.col("longitude"), F.col("latitude")
    e, n = UTM.forward(lon, lat)
    f = camera.focal_px(F.lit(4000.0), F.lit(3000.0), F.col("fov_deg"), F.col("fov_type"))
    u, v, _ = camera.project(F.col("x") - e, F.col("y") - n, F.col("altitude_agl_m"), F.lit(2000.0), F.lit(1500.0), f, camera.attitude(F.col("heading_deg") + UTM.convergence(lon, lat), F.col("gimbal_pitch_deg"), F.col("gimbal_roll_deg")))
    return rows.select("idx", (F.round(u, 3) + 0.0).alias("u"), (F.round(v, 3) + 0.0).alias("v"))


@query(f"""WITH {_FRAMES} SELECT frame_id, round(2 * 6371008.8::DOUBLE * asin(sqrt(pow(sin(radians(lat - -33.87::DOUBLE) / 2), 2) + cos(radians(-33.87::DOUBLE)) * cos(radians(lat)) * pow(sin(radians(lon - 151.2::DOUBLE) / 2), 2))), 3) AS distance_m,
round((degrees(atan2(sin(radians(lon - 151.2::DOUBLE)) * cos(radians(lat)), cos(radians(-33.87::DOUBLE)) * sin(radians(lat)) - sin(radians(-33.87::DOUBLE)) * cos(radians(lat)) * cos(radians(lon - 151.2::DOUBLE)))) + 360) % 360, 5) AS bearing_deg FROM frames""")
def prj_great_circle(spark, sf_dir):
    at = (F.lit(-33.87), F.lit(151.2), F.col("latitude"), F.col("longitude"))
    return frames(spark, sf_dir).select("frame_id", F.round(geo.haversine(*at), 3).alias("distance_m"), F.round(geo.bearing(*at), 5).alias("bearing_deg"))


@query("""WITH e AS (SELECT event_id AS idx, event_id % 6 AS k, event_id FROM events), t AS (SELECT idx, CASE k WHEN 0 THEN 'n/a' WHEN 1 THEN ' ' || (event_id % 150) || ' ' WHEN 2 THEN 'NaN' WHEN 3 THEN '' WHEN 4 THEN (event_id % 100) || 'e-2' ELSE 'box' END AS s FROM e),
v AS (SELECT idx, CASE WHEN lower(trim(s)) IN ('', 'nan', 'null', 'none', 'n/a', '-') THEN NULL ELSE try_cast(trim(s) AS DOUBLE) END AS value FROM t)
SELECT idx, value, greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(CASE WHEN value > 1 THEN value / 100 ELSE value END, 1.0::DOUBLE))) AS confidence, CASE WHEN value IS NOT NULL THEN 'class_' || CAST(trunc(value) AS BIGINT) ELSE 'animal' END AS label FROM v""")
def prj_tolerant_fields(spark, sf_dir):
    e = table(spark, sf_dir, "events").selectExpr("event_id AS idx", "CASE event_id % 6 WHEN 0 THEN 'n/a' WHEN 1 THEN concat(' ', event_id % 150, ' ') WHEN 2 THEN 'NaN' WHEN 3 THEN '' WHEN 4 THEN concat(event_id % 100, 'e-2') ELSE 'box' END AS s")
    return e.select("idx", text.number(F.col("s")).alias("value"), boxes.confidence_of(F.col("s")).alias("confidence"), boxes.label_of(F.lit(" "), F.col("s")).alias("label"))


@query("""WITH v AS (SELECT event_id AS idx, event_id % 4 AS k, CAST((event_id * 7919) % 400 AS DOUBLE) AS a, CAST((event_id * 104729) % 300 AS DOUBLE) AS b, CAST(event_id % 40 AS DOUBLE) AS c, CAST(event_id % 50 AS DOUBLE) AS d FROM events),
w AS (SELECT idx, k, a, b, CASE k WHEN 0 THEN least(a, c) WHEN 1 THEN a WHEN 2 THEN a - c / 2 END AS x1, CASE k WHEN 0 THEN least(b, d) WHEN 1 THEN b WHEN 2 THEN b - d / 2 END AS y1, CASE k WHEN 0 THEN greatest(a, c) WHEN 1 THEN a + c WHEN 2 THEN a + c / 2 END AS x2, CASE k WHEN 0 THEN greatest(b, d) WHEN 1 THEN b + d WHEN 2 THEN b + d / 2 END AS y2 FROM v)
SELECT idx, CASE WHEN k = 3 THEN a ELSE (x1 + x2) / 2 END AS x, CASE WHEN k = 3 THEN b ELSE y2 END AS y FROM w""")
def prj_box_layouts(spark, sf_dir):
    """All four layouts, anchored at the bottom's middle."""
    e = table(spark, sf_dir, "events").selectExpr("event_id AS idx", "event_id % 4 AS k", "CAST((event_id * 7919) % 400 AS DOUBLE) AS a", "CAST((event_id * 104729) % 300 AS DOUBLE) AS b", "CAST(event_id % 40 AS DOUBLE) AS c", "CAST(event_id % 50 AS DOUBLE) AS d")
    v, out = [F.col(c) for c in "abcd"], None
    for k, kind in enumerate(("corners", "top-left", "centre", "point")):
        part = e.where(F.col("k") == k).select("idx", *(c.alias(n) for n, c in boxes.box(kind, v if kind != "point" else v[:2]).items()), F.lit(False).alias("normalised"))
        out = part if out is None else out.unionByName(part)
    return boxes.placed(out, 4000, 3000, "bottom").select("idx", "x", "y")


@query("""WITH e AS (SELECT event_id AS idx, user_id AS origin, CASE WHEN user_id % 2 = 0 THEN CAST(event_id % 100 AS DOUBLE) / 100 ELSE CAST(event_id % 100 AS DOUBLE) END AS x, CAST(event_id % 10 AS DOUBLE) / 10 AS y FROM events),
m AS (SELECT *, max(greatest(x, y)) OVER (PARTITION BY origin) <= 1 AND min(least(x, y)) OVER (PARTITION BY origin) >= 0 AS norm FROM e) SELECT idx, norm AS normalised, CASE WHEN norm THEN x * 4000 ELSE x END AS x, CASE WHEN norm THEN y * 3000 ELSE y END AS y FROM m""")
def prj_normalised_files(spark, sf_dir):
    e = table(spark, sf_dir, "events").selectExpr("event_id AS idx", "user_id AS origin", "CASE WHEN user_id % 2 = 0 THEN CAST(event_id % 100 AS DOUBLE) / 100D ELSE CAST(event_id % 100 AS DOUBLE) END AS x", "CAST(event_id % 10 AS DOUBLE) / 10D AS y", *(f"CAST(NULL AS DOUBLE) AS {c}" for c in ("x1", "y1", "x2", "y2")))
    return boxes.placed(boxes.mark_normalised(e), 4000, 3000, "center").select("idx", "normalised", "x", "y")


@query("SELECT event_id AS idx, CASE event_id % 3 WHEN 0 THEN 'img_' || event_id WHEN 1 THEN 'dji.' || user_id ELSE 'frame' || user_id END AS key FROM events")
def prj_frame_key(spark, sf_dir):
    e = table(spark, sf_dir, "events").selectExpr("event_id AS idx", "CASE event_id % 3 WHEN 0 THEN concat(' /a/b/IMG_', event_id, '.JPG ') WHEN 1 THEN concat('c\\\\DJI.', user_id, '.srt') ELSE concat('Frame', user_id) END AS s")
    return e.select("idx", text.frame_key(F.col("s")).alias("key"))


@query(f"WITH {_FRAMES} SELECT frame_id, CAST(floor((lon / 360 + 0.5) * 262144) AS BIGINT) AS tx, CAST(floor((0.5 - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / (4 * pi())) * 262144) AS BIGINT) AS ty FROM frames")
def prj_map_tiles(spark, sf_dir):
    x, y = geo.tile(F.col("latitude"), F.col("longitude"), 18)
    return frames(spark, sf_dir).select("frame_id", x.alias("tx"), y.alias("ty"))


@query(f"""WITH {_FRAMES}, k AS (SELECT * FROM (VALUES (0, 0.0, 0.0), (1, 4000.0, 0.0), (2, 4000.0, 3000.0), (3, 0.0, 3000.0)) t(corner, x0, y0)), d AS (SELECT corner AS idx, frame_id, CAST(x0 AS DOUBLE) AS x, CAST(y0 AS DOUBLE) AS y FROM k, frames), {_UTM_FRAMES}, {_CAST}
SELECT frame_id, idx AS corner, round(e0 + wx / len * reach, 2) AS x, round(n0 + wy / len * reach, 2) AS y FROM c1 WHERE valid""")
def ftp_footprints(spark, sf_dir):
    return georef.footprints(frames(spark, sf_dir), UTM).select("frame_id", "corner", F.round("x", 2).alias("x"), F.round("y", 2).alias("y"))


# ---- sources ----

@query("""SELECT event_id AS seq, round(-33.0::DOUBLE - (event_id % 1000) / 1000.0::DOUBLE, 6) AS latitude, CAST(60 + event_id % 7 AS DOUBLE) AS altitude_agl_m, CAST((event_id * 37) % 360 AS DOUBLE) AS heading_deg, round((event_id % 86400) + 0.25::DOUBLE, 3) AS time_s, CAST(event_id AS INTEGER) AS frame_number FROM events""")
def src_subtitle_blocks(spark, sf_dir):
    """Subtitle telemetry written from events and read back."""
    e = table(spark, sf_dir, "events").selectExpr("event_id", """concat(event_id + 1, '\\n', lpad((event_id % 86400) DIV 3600, 2, '0'), ':', lpad(((event_id % 86400) DIV 60) % 60, 2, '0'), ':', lpad((event_id % 86400) % 60, 2, '0'), ',250 --> 00:00:00,000\\n<font size="28">FrameCnt: ', event_id,
 ', DiffTime: 33ms\\n[latitude: -33.', lpad(event_id % 1000, 3, '0'), '] [longitude: 151.2] [rel_alt: ', 60 + event_id % 7, ' abs_alt: 99] [gb_yaw: ', (event_id * 37) % 360 - 360, ']</font>') AS value""")
    rows = logs.parse_srt(e.select(F.col("event_id").cast("string").alias("track"), F.lit(0).alias("track_order"), "value"))
    return rows.select(F.col("track").cast("long").alias("seq"), F.round("latitude", 6).alias("latitude"), "altitude_agl_m", "heading_deg", F.round("time_s", 3).alias("time_s"), "frame_number")


# ---- joins ----

def _asof_sql(track: str, scale: str) -> str:
    return f"""WITH e AS (SELECT event_id, {track} AS track, event_type, CAST(epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events) AS DOUBLE) / {scale}::DOUBLE AS t, CAST((event_id * 7) % 360 AS DOUBLE) AS heading, CAST(event_id % 90 AS DOUBLE) AS lat FROM events),
s AS (SELECT * FROM e WHERE event_type = 'view'), q AS (SELECT * FROM e WHERE event_type = 'click'),
a AS (SELECT q.event_id, q.track, q.t, s.t AS pt, s.lat AS plat, s.heading AS ph FROM q ASOF LEFT JOIN s ON q.track = s.track AND q.t > s.t),
b AS (SELECT q.event_id, s.t AS nt, s.lat AS nlat, s.heading AS nh FROM q ASOF LEFT JOIN s ON q.track = s.track AND q.t <= s.t), j AS (SELECT * FROM a JOIN b USING (event_id)),
r AS (SELECT *, CASE WHEN nt = t THEN 'n' WHEN pt IS NULL THEN CASE WHEN nt - t <= 0.5 THEN 'n' END WHEN nt IS NULL THEN CASE WHEN t - pt <= 0.5 THEN 'p' END WHEN nt - pt > 30 THEN CASE WHEN t - pt <= nt - t THEN CASE WHEN t - pt <= 0.5 THEN 'p' END ELSE CASE WHEN nt - t <= 0.5 THEN 'n' END END ELSE 'i' END AS how FROM j)
SELECT event_id AS id, round(CASE how WHEN 'n' THEN nlat WHEN 'p' THEN plat WHEN 'i' THEN plat + (nlat - plat) * ((t - pt) / (nt - pt)) END, 6) AS latitude,
round(CASE how WHEN 'n' THEN nh WHEN 'p' THEN ph WHEN 'i' THEN ((ph + (((nh - ph + 180) % 360 + 360) % 360 - 180) * ((t - pt) / (nt - pt))) % 360 + 360) % 360 END, 6) AS heading_deg FROM r"""


def _asof(spark, sf_dir, track: str, scale: float) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    low = e.agg(F.min("us")).first()[0]
    e = e.select(F.col("event_id"), F.expr(track).alias("track"), "event_type", ((F.col("us") - F.lit(low)).cast("double") / scale).alias("t"))
    none = F.lit(None).cast("double")
    tele = e.where("event_type = 'view'").select("track", F.col("event_id").alias("seq"), F.col("t").alias("time_s"), F.expr("CAST(event_id % 90 AS DOUBLE)").alias("latitude"), F.lit(151.0).alias("longitude"), none.alias("altitude_agl_m"), F.expr("CAST((event_id * 7) % 360 AS DOUBLE)").alias("heading_deg"), none.alias("gimbal_pitch_deg"), none.alias("gimbal_roll_deg"), F.lit(None).cast("string").alias("timestamp"))
    out = match.at_time(e.where("event_type = 'click'").select("track", F.col("event_id").alias("id"), "t"), tele, 0.5)
    return out.select("id", F.round("latitude", 6).alias("latitude"), F.round("heading_deg", 6).alias("heading_deg"))


@query(_asof_sql("'all'", "6e8"))
def jn_asof_one_track(spark, sf_dir):
    return _asof(spark, sf_dir, "'all'", 6e8)


@query(_asof_sql("CAST(user_id AS VARCHAR)", "6e9"))
def jn_asof_many_tracks(spark, sf_dir):
    return _asof(spark, sf_dir, "CAST(user_id AS STRING)", 6e9)


def _matched(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    none, word = F.lit(None).cast("double"), F.lit(None).cast("string")
    u = e.select("user_id").distinct()
    tele = u.where("user_id % 5 <> 0").select(F.when(F.col("user_id") % 2 == 0, "even.SRT").otherwise("odd.SRT").alias("track"), F.when(F.col("user_id") % 2 == 0, 0).otherwise(1).alias("track_order"), F.col("user_id").alias("seq"), F.lit(-33.0).alias("latitude"), F.lit(151.0).alias("longitude"), F.when(F.col("user_id") % 7 != 0, 60.0).alias("altitude_agl_m"),
                                              F.when(F.col("user_id") % 11 != 0, 10.0).alias("heading_deg"), none.alias("gimbal_pitch_deg"), none.alias("gimbal_roll_deg"), none.alias("time_s"), F.lit(None).cast("int").alias("frame_number"), F.concat(F.lit("IMG_"), "user_id").alias("frame_id"), word.alias("timestamp"))
    dets = e.select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 4 == 0, "even.srt").when(F.col("event_id") % 4 == 1, "odd").when(F.col("event_id") % 4 == 2, "other").alias("source"), F.concat(F.lit("dir/img_"), "user_id", F.lit(".JPG")).alias("frame_id"), F.lit(None).cast("int").alias("frame_number"), none.alias("time_s"),
                    F.expr("CAST((event_id * 7919) % 4200 AS DOUBLE)").alias("x"), F.expr("CAST((event_id * 104729) % 3000 AS DOUBLE)").alias("y"), F.col("event_type").alias("label"), F.lit(1.0).alias("confidence"), F.concat(F.lit("D"), "event_id").alias("detection_id"))
    return match.match(dets, tele, IngestOptions())


_MATCH = f"""WITH e AS (SELECT event_id, user_id, CASE event_id % 4 WHEN 0 THEN 'even' WHEN 1 THEN 'odd' WHEN 2 THEN 'other' END AS source, CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS track, user_id % 5 <> 0 AS there, (event_id * 7919) % 4200 AS x FROM events),
r AS (SELECT event_id AS id, CASE WHEN source = 'other' THEN '{match.UNKNOWN_SOURCE}' WHEN source IS NULL AND NOT there THEN '{match.AMBIGUOUS.replace("'", "''")}' WHEN NOT there OR source <> track THEN '{match.NO_SAMPLE}' WHEN user_id % 7 = 0 THEN '{match.NO_ALTITUDE}' WHEN user_id % 11 = 0 THEN '{match.NO_HEADING}' WHEN x > 4000 THEN '{match.OUTSIDE}' END AS reason FROM e)"""


@query(f"{_MATCH} SELECT id, reason FROM r")
def jn_match_by_name(spark, sf_dir):
    return _matched(spark, sf_dir).select("id", "reason")


@query(f"{_MATCH} SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY reason")
def ag_unmatched_reasons(spark, sf_dir):
    return match.unmatched(_matched(spark, sf_dir)).withColumnRenamed("count", "n")


@query(f"WITH {_POINTS}, {_PAIRS} SELECT a, b FROM pairs")
def jn_range_pairs(spark, sf_dir):
    return spatial.self_pairs(points(spark, sf_dir).select("idx", "x", "y"), EPS).select(F.col("a.idx").alias("a"), F.col("b.idx").alias("b"))


@query(f"WITH {_POINTS} SELECT a.idx, round(sqrt(min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))), 6) AS d FROM p a JOIN p b ON a.frame_id = b.frame_id AND a.idx <> b.idx GROUP BY a.idx")
def jn_nearest_in_frame(spark, sf_dir):
    return spatial.nearest_in_group(points(spark, sf_dir), "frame_id").select("idx", F.round("d", 6).alias("d"))


@query(f"""WITH {_POINTS}, q AS (SELECT idx AS id, x + 0.25::DOUBLE AS x, y - 0.25::DOUBLE AS y FROM p WHERE idx % 10 = 3), n AS (SELECT q.id, p.idx, row_number() OVER (PARTITION BY q.id ORDER BY (q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y), p.idx DESC) AS r FROM q JOIN p ON (q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y) <= 0.25::DOUBLE)
SELECT q.id, n.idx FROM q LEFT JOIN n ON q.id = n.id AND r = 1""")
def jn_nearest_probe(spark, sf_dir):
    p = points(spark, sf_dir)
    probes = p.where("idx % 10 = 3").select(F.col("idx").alias("id"), (F.col("x") + 0.25).alias("x"), (F.col("y") - 0.25).alias("y"))
    return spatial.nearest_within(probes, p.select("idx", "x", "y"), 0.5)


@query(f"{_CLUSTERS}, seen AS (SELECT cluster FROM cc GROUP BY cluster HAVING count(*) > 1) SELECT idx FROM cc WHERE cluster IN (SELECT cluster FROM seen)")
def jn_semi_observed(spark, sf_dir):
    _, c = _clusters(spark, sf_dir)
    return c.join(c.groupBy("cluster").count().where("count > 1"), "cluster", "left_semi").select("idx")


@query("""WITH t AS (SELECT DISTINCT user_id % 50 AS tid FROM events), p AS (SELECT DISTINCT user_id % 70 AS number FROM events), h AS (SELECT tid FROM t WHERE tid % 3 = 0 AND tid IN (SELECT number FROM p))
SELECT 'missed' AS kind, tid AS id FROM t WHERE tid NOT IN (SELECT tid FROM h) UNION ALL SELECT 'extra', number FROM p WHERE number NOT IN (SELECT tid FROM h)""")
def jn_anti_missed(spark, sf_dir):
    """What a match leaves over on either side."""
    e = table(spark, sf_dir, "events")
    truth, animals = e.select((F.col("user_id") % 50).alias("tid")).distinct(), e.select((F.col("user_id") % 70).alias("number")).distinct()
    hits = truth.where("tid % 3 = 0").join(animals, F.col("tid") == F.col("number")).select(F.col("number").alias("pid"), "tid")
    missed, extra = score.unmatched_rows(animals, truth, hits)
    return missed.select(F.lit("missed").alias("kind"), F.col("tid").alias("id")).unionByName(extra.select(F.lit("extra").alias("kind"), F.col("number").alias("id")))


@query()
def jn_one_to_one_match(spark, sf_dir):
    """Least-cost matching between even and odd boxes: the pairs themselves; tests hold them against brute force."""
    p = points(spark, sf_dir)
    m = score.match_points(p.where("idx % 2 = 0").select(F.col("idx").alias("pid"), "x", "y"), p.where("idx % 2 = 1").select(F.col("idx").alias("tid"), "x", "y"), 0.5)
    return m.select("pid", "tid", F.round("distance", 6).alias("distance"))


# ---- clustering ----

@query(f"{_CLUSTERS} SELECT idx, cluster FROM cc")
def cl_components(spark, sf_dir):
    return _clusters(spark, sf_dir)[1]


@query(f"""WITH RECURSIVE {_POINTS}, pairs AS (SELECT a.idx AS a, b.idx AS b FROM p a JOIN p b ON a.frame_id = b.frame_id AND a.idx < b.idx AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 4), {_COMPONENTS}, k AS (SELECT cc.cluster, p.idx, row_number() OVER (PARTITION BY cc.cluster ORDER BY p.confidence DESC, p.idx) AS r FROM cc JOIN p USING (idx))
SELECT cc.idx, k.idx AS keeper FROM cc JOIN k ON cc.cluster = k.cluster AND k.r = 1""")
def cl_frame_suppression(spark, sf_dir):
    return dedup.suppress(points(spark, sf_dir), 2.0)


@query(f"""WITH RECURSIVE {_POINTS}, near AS (SELECT a.idx AS a, b.idx AS b FROM p a JOIN p b ON a.idx <> b.idx AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 1), core AS (SELECT a AS idx FROM near GROUP BY a HAVING count(*) + 1 >= 4),
reach AS (SELECT idx AS node, idx AS root FROM core UNION SELECT n.b, r.root FROM reach r JOIN near n ON n.a = r.node JOIN core c ON c.idx = n.b WHERE r.root < n.b), cc AS (SELECT node AS idx, min(root) AS cluster FROM reach GROUP BY node), border AS (SELECT n.a AS idx, min(cc.cluster) AS cluster FROM near n JOIN cc ON cc.idx = n.b GROUP BY n.a)
SELECT p.idx, coalesce(cc.cluster, border.cluster) AS cluster FROM p LEFT JOIN cc ON cc.idx = p.idx LEFT JOIN border ON border.idx = p.idx""")
def cl_dbscan_four(spark, sf_dir):
    return dedup.dbscan(points(spark, sf_dir), EPS, 4, drop_noise=True)


@query()
def cl_cannot_link_split(spark, sf_dir):
    """The group of every point after the split; tests hold groups against the rule by brute force."""
    p, c = _clusters(spark, sf_dir)
    return dedup.split_conflicts(p, c, EPS)


@query(f"""WITH {_POINTS}, n AS (SELECT a.idx, sqrt(min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS d FROM p a JOIN p b ON a.frame_id = b.frame_id AND a.idx <> b.idx GROUP BY a.idx), s AS (SELECT quantile_cont(d, 0.1) AS s FROM n)
SELECT round(s, 6) AS spacing_m, CASE WHEN s IS NULL OR s >= 3 THEN 'normal' ELSE 'dense' END AS mode, round(CASE WHEN s IS NULL OR s >= 3 THEN 3 ELSE least(3, greatest(0.35, 0.45 * s)) END, 6) AS eps_m FROM s""")
def cl_density_plan(spark, sf_dir):
    s = dedup.density_spacing(points(spark, sf_dir), 0.1)
    c, mode = dedup.plan_density(s, DedupConfig(eps_m=3.0))
    return spark.createDataFrame([(round(s, 6), mode, round(c.eps_m, 6))], "spacing_m double, mode string, eps_m double")


_DIFFS = f"""{_POINTS}, df AS (SELECT least(a.frame_id, b.frame_id) AS fa, greatest(a.frame_id, b.frame_id) AS fb, CASE WHEN a.frame_id < b.frame_id THEN b.x - a.x ELSE a.x - b.x END AS dx, CASE WHEN a.frame_id < b.frame_id THEN b.y - a.y ELSE a.y - b.y END AS dy
 FROM p a JOIN p b ON a.idx < b.idx AND a.frame_id <> b.frame_id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 2.25::DOUBLE)"""


@query(f"""WITH {_DIFFS}, o AS (SELECT i, j FROM range(-1, 2) a(i), range(-1, 2) b(j)), v AS (SELECT fa, fb, CAST(floor(dx / 0.5::DOUBLE) AS BIGINT) + 4 + i AS bx, CAST(floor(dy / 0.5::DOUBLE) AS BIGINT) + 4 + j AS by_, count(*) AS votes FROM df, o GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY fa, fb ORDER BY votes DESC, bx, by_) AS r FROM v), c AS (SELECT fa, fb, (bx - 4 + 0.5::DOUBLE) * 0.5::DOUBLE AS cx, (by_ - 4 + 0.5::DOUBLE) * 0.5::DOUBLE AS cy FROM k WHERE r = 1)
SELECT fa, fb, round(avg(dx), 6) AS dx, round(avg(dy), 6) AS dy, count(*) AS votes FROM df JOIN c USING (fa, fb) WHERE sqrt((dx - cx) * (dx - cx) + (dy - cy) * (dy - cy)) <= 0.75 GROUP BY fa, fb HAVING count(*) >= 3""")
def cl_offset_votes(spark, sf_dir):
    o = sync.offsets(points(spark, sf_dir), SyncConfig(bin_m=0.5))
    return o.select("fa", "fb", F.round("dx", 6).alias("dx"), F.round("dy", 6).alias("dy"), "votes")


@query("""WITH f AS (SELECT * FROM range(0, 4) t(f)) SELECT 'f' || f AS frame_id, count(*) AS n, round(f * 0.1::DOUBLE, 1) AS dx, round(f * f * -0.1::DOUBLE, 1) AS dy FROM f, events GROUP BY f""")
def cl_pose_graph(spark, sf_dir):
    """Four frames see every event's place, each moved by a planted shift and some noise: what the pose graph takes off them, beside the
    first frame's."""
    e = table(spark, sf_dir, "events").selectExpr("event_id", "cast(event_id % 100 as double) * 3.1D + cast(event_id % 7 as double) * 0.2D AS x", "cast(event_id DIV 100 as double) * 3.3D + cast(event_id % 11 as double) * 0.1D AS y")
    seen = e.withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(3)))).selectExpr("event_id * 4 + f AS idx", "concat('f', f) AS frame_id", "x + f * 0.1D + ((event_id * 7919 + f * 104729) % 81 - 40) * 0.001D AS x", "y - f * f * 0.1D + ((event_id * 104729 + f * 7919) % 81 - 40) * 0.001D AS y", "f")
    moved, _ = sync.synchronise(seen, SyncConfig())
    shift = seen.join(moved.select("idx", F.col("x").alias("mx"), F.col("y").alias("my")).hint("merge"), "idx").groupBy("frame_id").agg(F.count("*").alias("n"), F.avg(F.col("x") - F.col("mx")).alias("dx"), F.avg(F.col("y") - F.col("my")).alias("dy"))
    first = shift.where("frame_id = 'f0'").select(F.col("dx").alias("dx0"), F.col("dy").alias("dy0")).first()
    return shift.select("frame_id", "n", (F.round(F.col("dx") - first.dx0, 1) + 0.0).alias("dx"), (F.round(F.col("dy") - first.dy0, 1) + 0.0).alias("dy"))


# ---- aggregations, windows, order ----

@query(f"""{_CLUSTERS}, m AS (SELECT cc.cluster, p.* FROM cc JOIN p USING (idx)), b AS (SELECT cluster, avg(x) AS mx, avg(y) AS my, count(*) AS n FROM m GROUP BY cluster), l AS (SELECT cluster, label, count(*) AS c FROM m GROUP BY ALL), lv AS (SELECT cluster, string_agg(label || '=' || c, ',' ORDER BY label) AS votes, count(*) > 1 AS conflict FROM l GROUP BY cluster)
SELECT b.cluster, round(mx + 1.37e-6::DOUBLE, 4) AS x, round(my + 1.37e-6::DOUBLE, 4) AS y, n AS n_observations, (SELECT m.label FROM m WHERE m.cluster = b.cluster ORDER BY confidence DESC, idx LIMIT 1) AS label, max(confidence) AS confidence, round(max(sqrt((m.x - mx) * (m.x - mx) + (m.y - my) * (m.y - my))), 4) AS spread_m,
string_agg(m.detection_id, ';' ORDER BY m.idx) AS detections, any_value(votes) AS label_votes, any_value(conflict) AS class_conflict FROM b JOIN m USING (cluster) JOIN lv USING (cluster) GROUP BY b.cluster, mx, my, n""")
def ag_resolve(spark, sf_dir):
    p, c = _clusters(spark, sf_dir)
    r = dedup.resolve(p, c)
    votes = F.array_join(F.transform(F.array_sort(F.map_entries("label_votes")), lambda e: F.concat(e.key, F.lit("="), e.value.cast("string"))), ",")
    off_tie = lambda c: F.round(F.col(c) + 1.37e-6, 4).alias(c)  # noqa: E731  means of steps of 0.025 often end in a 5
    return r.select("cluster", off_tie("x"), off_tie("y"), "n_observations", "label", "confidence", F.round("spread_m", 4).alias("spread_m"), F.array_join("detection_ids", ";").alias("detections"), votes.alias("label_votes"), "class_conflict")


@query(f"{_CLUSTERS}, b AS (SELECT cluster, avg(x) AS mx, avg(y) AS my FROM cc JOIN p USING (idx) GROUP BY cluster) SELECT cluster, row_number() OVER (ORDER BY round(mx, 9), round(my, 9), cluster) AS number FROM b")
def st_number_records(spark, sf_dir):
    """Records from west to east, then south to north (places to a nanometre, so that both engines see the same ties)."""
    p, c = _clusters(spark, sf_dir)
    centre = p.select("idx", "x", "y").join(c, "idx").groupBy("cluster").agg(F.round(F.avg("x"), 9).alias("mx"), F.round(F.avg("y"), 9).alias("my"))
    return dedup.rank_all(centre, ["mx", "my", "cluster"]).select("cluster", F.col("rank").alias("number"))


_LOO = "loo AS (SELECT m.idx, m.frame_id, m.x, m.y, (s.sx - m.x) / (s.n - 1) AS tx, (s.sy - m.y) / (s.n - 1) AS ty FROM (SELECT cc.cluster, p.* FROM cc JOIN p USING (idx)) m JOIN (SELECT cluster, sum(x) AS sx, sum(y) AS sy, count(*) AS n FROM cc JOIN p USING (idx) GROUP BY cluster HAVING count(*) > 1) s USING (cluster))"


@query(f"{_CLUSTERS}, {_LOO} SELECT idx, round(tx + 1.37e-6::DOUBLE, 4) AS tx, round(ty + 1.37e-6::DOUBLE, 4) AS ty FROM loo")
def ag_leave_one_out(spark, sf_dir):
    p, c = _clusters(spark, sf_dir)
    return align.targets(p, c).select("idx", F.round(F.col("tx") + 1.37e-6, 4).alias("tx"), F.round(F.col("ty") + 1.37e-6, 4).alias("ty"))


@query(f"""{_CLUSTERS}, {_LOO}, k AS (SELECT frame_id, avg(x) AS cx, avg(y) AS cy FROM p GROUP BY frame_id), r AS (SELECT loo.frame_id, x - cx AS sx, y - cy AS sy, tx - cx AS dx, ty - cy AS dy FROM loo JOIN k USING (frame_id)),
s AS (SELECT frame_id, count(*) AS n, sum(sx * sx + sy * sy) - (sum(sx) * sum(sx) + sum(sy) * sum(sy)) / count(*) AS ss, sum(sx * dx + sy * dy) - (sum(sx) * sum(dx) + sum(sy) * sum(dy)) / count(*) AS dot, sum(sx * dy - sy * dx) - (sum(sx) * sum(dy) - sum(sy) * sum(dx)) / count(*) AS crs FROM r GROUP BY frame_id)
SELECT frame_id, n, round(sqrt(dot * dot + crs * crs) / ss, 6) AS scale, round(degrees(atan2(crs, dot)), 5) AS rotation_deg FROM s WHERE n >= 3""")
def ag_similarity_fit(spark, sf_dir):
    p, c = _clusters(spark, sf_dir)
    centres = p.groupBy("frame_id").agg(F.struct(F.avg("x").alias("x"), F.avg("y").alias("y")).alias("centre"))
    fit = align.similarity(align._sums(align.targets(p, c).join(centres, "frame_id"), "centre"), F.col("n") >= 3).where("n >= 3")
    return fit.select("frame_id", "n", F.round(F.hypot("a", "b"), 6).alias("scale"), F.round(F.degrees(F.atan2("b", "a")), 5).alias("rotation_deg"))


@query(f"WITH {_FRAMES} SELECT round(quantile_cont(lat, 0.5), 7) AS latitude, round(quantile_cont(lon, 0.5), 7) AS longitude, 32756 AS epsg FROM frames")
def ag_survey_zone(spark, sf_dir):
    f = frames(spark, sf_dir)
    return f.agg(F.round(F.percentile("latitude", 0.5), 7).alias("latitude"), F.round(F.percentile("longitude", 0.5), 7).alias("longitude")).withColumn("epsg", F.lit(georef.survey_zone(f).epsg))


@query(f"{_CLUSTERS}, r AS (SELECT p.idx, row_number() OVER (PARTITION BY cluster ORDER BY confidence DESC, p.idx) AS r FROM cc JOIN p USING (idx)) SELECT idx, CASE WHEN r = 1 THEN 'kept' ELSE 'duplicate' END AS status FROM r")
def wn_status(spark, sf_dir):
    from pyspark.sql import Window as W

    p, c = _clusters(spark, sf_dir)
    rank = F.row_number().over(W.partitionBy("cluster").orderBy(F.desc("confidence"), "idx"))
    return p.join(c, "idx").select("idx", F.when(rank == 1, "kept").otherwise("duplicate").alias("status"))


@query(f"{_CLUSTERS}, k AS (SELECT cluster, (SELECT label FROM cc c2 JOIN p USING (idx) WHERE c2.cluster = cc.cluster ORDER BY confidence DESC, idx LIMIT 1) AS label FROM cc GROUP BY cluster) SELECT label, count(*) AS n FROM k GROUP BY label")
def ag_label_counts(spark, sf_dir):
    p, c = _clusters(spark, sf_dir)
    return dedup.resolve(p, c).groupBy("label").agg(F.count("*").alias("n"))


@query(f"{_CLUSTERS} SELECT (SELECT count(*) FROM p) AS detections, (SELECT count(DISTINCT cluster) FROM cc) AS unique_records, (SELECT count(*) FROM p) - (SELECT count(DISTINCT cluster) FROM cc) AS duplicates_removed")
def ag_summary(spark, sf_dir):
    _, c = _clusters(spark, sf_dir)
    return c.agg(F.count("*").alias("detections"), F.countDistinct("cluster").alias("unique_records")).withColumn("duplicates_removed", F.col("detections") - F.col("unique_records"))


@query(f"WITH {_POINTS} SELECT min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM p")
def ag_bounds(spark, sf_dir):
    return points(spark, sf_dir).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))


@query("WITH s AS (SELECT event_id AS seq, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT seq FROM s WHERE i % greatest(1, n // 100) = 0")
def lm_path_decimation(spark, sf_dir):
    s = table(spark, sf_dir, "events").select(F.col("event_type").alias("track"), F.col("event_id").alias("seq"))
    return match.decimate(s, 100).select("seq")


@query(f"WITH {_POINTS} SELECT min(idx) AS idx, count(*) AS n FROM p WHERE x BETWEEN 20 AND 120 AND y BETWEEN 10 AND 90 GROUP BY floor(x / 2), floor(y / 2)")
def lm_viewport(spark, sf_dir):
    return spatial.viewport(points(spark, sf_dir), 20.0, 10.0, 120.0, 90.0, 2.0)


@query(f"WITH {_FRAMES}, {_DETS}, {_UTM_FRAMES}, {_CAST} SELECT frame_id, valid AS kept, count(*) AS n FROM c1 GROUP BY ALL")
def so_audit_union(spark, sf_dir):
    g = georef.georeference(frames(spark, sf_dir), detections(spark, sf_dir), UTM)
    both = g.where("valid").select("frame_id", F.lit(True).alias("kept")).unionByName(g.where("not valid").select("frame_id", F.lit(False).alias("kept")))
    return both.groupBy("frame_id", "kept").agg(F.count("*").alias("n"))


@query("SELECT CAST(column0 AS VARCHAR) AS profile, CAST(150 AS BIGINT) AS animals, CAST(1.0 AS DOUBLE) AS f1 FROM (VALUES ('ideal'))t(column0)")
def sim_ideal_survey(spark, sf_dir):
    """A simulated survey without noise: every animal is found once."""
    from ..sources.simulate import profile, simulate

    d = simulate(spark, profile("ideal"))
    r = survey.run(d, registration=None)
    e, n = r.utm.forward(F.col("longitude"), F.col("latitude"))
    s = score.evaluate(r.ground, r.clusters, r.animals, d.truth.select("tid", "truth_id", "label", e.alias("x"), n.alias("y")), 2.0)
    return spark.createDataFrame([("ideal", s["predicted_animals"], round(s["f1"], 6))], "profile string, animals long, f1 double")


# ---- more of sources, joins and scores ----

@query("""SELECT event_id AS id, 'img_' || user_id AS frame_id, CAST(event_id % 50 AS INTEGER) AS frame_number, CAST((event_id * 7919) % 400 AS DOUBLE) + (event_id % 40) / 2.0::DOUBLE AS x, CAST((event_id * 104729) % 300 AS DOUBLE) + (event_id % 30) / 2.0::DOUBLE AS y, CASE WHEN event_id % 3 = 0 THEN 'class_' || (event_id % 9) ELSE event_type END AS label, round((event_id % 101) / 100.0::DOUBLE, 6) AS confidence
FROM events WHERE event_id % 13 <> 0""")
def src_box_records(spark, sf_dir):
    """A table of text columns under aliased headers, as a log has them; rows without a whole box are left out."""
    e = table(spark, sf_dir, "events").selectExpr("event_id AS _row", "concat('img_', user_id) AS `Image Name`", "cast(event_id % 50 as string) AS `Frame-Idx`", "CASE WHEN event_id % 13 = 0 THEN 'n/a' ELSE concat((event_id * 7919) % 400, '.0') END AS Left", "cast((event_id * 104729) % 300 as string) AS Top",
                                                  "cast(event_id % 40 as string) AS `Width (px)`", "cast(event_id % 30 as string) AS `Height [px]`", "CASE WHEN event_id % 3 = 0 THEN ' ' ELSE event_type END AS Class_Name", "cast(event_id % 9 as string) AS cls", "CASE WHEN event_id % 101 > 1 THEN cast(event_id % 101 as string) ELSE concat((event_id % 101) / 100D, '') END AS Score")
    return boxes.parse_records(e, "log.csv").select("id", "frame_id", "frame_number", "x", "y", "label", F.round("confidence", 6).alias("confidence"))


@query(f"""WITH e AS (SELECT * FROM events), s AS (SELECT event_id % 500 AS number, max(event_id) AS last FROM e WHERE event_type = 'view' GROUP BY ALL) SELECT e.event_id AS id, CASE WHEN s.number IS NULL THEN '{match.NO_SAMPLE}' END AS reason, CASE WHEN s.number IS NOT NULL THEN CAST(s.last % 90 AS DOUBLE) END AS latitude FROM e LEFT JOIN s ON e.event_id % 700 = s.number""")
def jn_match_by_number(spark, sf_dir):
    """Frame numbers that stand twice: the last sample wins; a miss is final."""
    e = table(spark, sf_dir, "events")
    none, word = F.lit(None).cast("double"), F.lit(None).cast("string")
    tele = e.where("event_type = 'view'").select(F.lit("a.SRT").alias("track"), F.lit(0).alias("track_order"), F.col("event_id").alias("seq"), F.expr("CAST(event_id % 90 AS DOUBLE)").alias("latitude"), F.lit(151.0).alias("longitude"), F.lit(60.0).alias("altitude_agl_m"), F.lit(10.0).alias("heading_deg"), none.alias("gimbal_pitch_deg"), none.alias("gimbal_roll_deg"), none.alias("time_s"), F.expr("CAST(event_id % 500 AS INT)").alias("frame_number"), word.alias("frame_id"), word.alias("timestamp"))
    dets = e.select(F.col("event_id").alias("id"), word.alias("source"), word.alias("frame_id"), F.expr("CAST(event_id % 700 AS INT)").alias("frame_number"), none.alias("time_s"), F.lit(1.0).alias("x"), F.lit(1.0).alias("y"), F.col("event_type").alias("label"), F.lit(1.0).alias("confidence"), word.alias("detection_id"))
    return match.match(dets, tele, IngestOptions()).select("id", "reason", "latitude")


@query(f"{_CLUSTERS}, l AS (SELECT cc.cluster, p.label, count(*) AS c FROM cc JOIN p USING (idx) GROUP BY ALL) SELECT cluster, '{{' || string_agg('\"' || label || '\": ' || c, ', ' ORDER BY label) || '}}' AS label_votes FROM l GROUP BY cluster")
def snk_votes_text(spark, sf_dir):
    from ..sources.writers import votes_json

    p, c = _clusters(spark, sf_dir)
    return dedup.resolve(p, c).select("cluster", votes_json(F.col("label_votes")).alias("label_votes"))


@query(f"{_CLUSTERS}, k AS (SELECT cluster FROM cc GROUP BY cluster HAVING count(*) > 2) SELECT cc.cluster, p.idx, p.x, p.y FROM k JOIN cc USING (cluster) JOIN p USING (idx)")
def jn_observation_links(spark, sf_dir):
    """The raw places of every sighting of a record that was seen more than twice."""
    p, c = _clusters(spark, sf_dir)
    a = dedup.resolve(p, c).where("n_observations > 2").select("cluster")
    return a.join(c, "cluster").join(p.select("idx", "x", "y"), "idx").select("cluster", "idx", "x", "y")


@query("WITH f AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS frame_id FROM events) SELECT frame_id, row_number() OVER (ORDER BY frame_id) AS code FROM f")
def wn_frame_codes(spark, sf_dir):
    return dedup.rank_all(frames(spark, sf_dir).select("frame_id"), ["frame_id"]).select("frame_id", F.col("rank").alias("code"))


@query(f"""{_CLUSTERS}, t AS (SELECT cc.cluster, 'T' || (idx % 400) AS truth_id FROM cc WHERE idx % 17 <> 0), o AS (SELECT cluster FROM t GROUP BY cluster HAVING count(DISTINCT truth_id) > 1), s AS (SELECT truth_id FROM t GROUP BY truth_id HAVING count(DISTINCT cluster) > 1) SELECT (SELECT count(*) FROM o) AS over_merged, (SELECT count(*) FROM s) AS split""")
def ag_identity_errors(spark, sf_dir):
    _, c = _clusters(spark, sf_dir)
    t = c.where("idx % 17 <> 0").select("cluster", F.expr("concat('T', idx % 400)").alias("truth_id"))
    both = score.identity_errors(t)
    return spark.createDataFrame([both], "over_merged long, split long")


@query("""WITH c AS (SELECT lower(event_type) AS label, count(*) FILTER (event_id % 2 = 0) AS truth, count(*) FILTER (event_id % 3 = 0) AS predicted FROM events GROUP BY ALL) SELECT label, truth, predicted, predicted - truth AS error, round(CASE WHEN truth = 0 THEN CASE WHEN predicted = 0 THEN 1 ELSE 0 END ELSE greatest(0, 1 - abs(predicted - truth) / truth::DOUBLE) END, 6) AS accuracy FROM c WHERE truth > 0""")
def ag_class_accuracy(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    predicted = e.where("event_id % 3 = 0").select(F.upper("event_type").alias("label"))
    truth = e.where("event_id % 2 = 0").select(F.col("event_type").alias("label"))
    return score.class_accuracy(predicted, truth).withColumn("accuracy", F.round("accuracy", 6))


@query("""WITH r AS (SELECT event_type AS profile, user_id % 10 AS seed, count(*) AS raw, count(DISTINCT user_id) AS predicted, avg(value) AS v FROM events GROUP BY ALL) SELECT profile, count(*) AS runs, round(avg(predicted / 100.0::DOUBLE), 6) AS count_accuracy, round(avg(1 - predicted / raw::DOUBLE), 6) AS removed, avg(predicted / 100.0::DOUBLE) >= 0.99 AS passed FROM r GROUP BY profile""")
def ag_benchmark_rollup(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("profile"), (F.col("user_id") % 10).alias("seed")).agg(F.count("*").alias("raw_detections"), F.countDistinct("user_id").alias("predicted_animals"))
    out = score.rollup(e.withColumns({"count_accuracy": F.col("predicted_animals") / 100.0, "f1": F.lit(1.0)}), 0.99)
    return out.select("profile", "runs", F.round("count_accuracy", 6).alias("count_accuracy"), F.round("removed", 6).alias("removed"), "passed")


@query("""WITH t AS (SELECT event_type AS track, event_id AS seq, value FROM events) SELECT track, count(*) AS samples, count_if(seq % 5 = 0) AS derived, min(seq) AS first_seq FROM t GROUP BY track""")
def ag_track_counts(spark, sf_dir):
    t = table(spark, sf_dir, "events").select(F.col("event_type").alias("track"), F.col("event_id").alias("seq"), (F.col("event_id") % 5 == 0).alias("heading_derived"))
    return match.track_counts(t)


@query("""SELECT event_id AS seq, track, CASE WHEN i < 4 THEN 0.0::DOUBLE ELSE 180.0::DOUBLE END AS heading_deg, NOT given AS heading_derived FROM (SELECT event_id, 't' || (event_id // 8) AS track, event_id % 8 AS i, event_id % 3 = 0 AS given FROM events)""")
def cl_derived_headings(spark, sf_dir):
    """Eight samples a flight, four to the north and four back beside them; two in three have no heading of their own."""
    e = table(spark, sf_dir, "events").selectExpr("event_id", "concat('t', event_id DIV 8) AS track", "cast(event_id % 8 as int) AS i")
    none = F.lit(None).cast("double")
    t = e.select("track", F.lit(0).alias("track_order"), F.col("event_id").alias("seq"), (F.when(F.col("i") < 4, F.col("i")).otherwise(7 - F.col("i")) * 1e-4 - 33.8).alias("latitude"), (F.when(F.col("i") < 4, 0).otherwise(1) * 1e-4 + 151.2).alias("longitude"), F.lit(60.0).alias("altitude_agl_m"),
                 F.when(F.col("event_id") % 3 == 0, F.when(F.col("i") < 4, 0.0).otherwise(180.0)).alias("heading_deg"), none.alias("gimbal_pitch_deg"), none.alias("gimbal_roll_deg"), F.col("i").cast("double").alias("time_s"), F.lit(None).cast("int").alias("frame_number"), F.lit(None).cast("string").alias("frame_id"), F.lit(None).cast("string").alias("timestamp"))
    return match.derive_headings(t).select("seq", "track", (F.round(F.pmod("heading_deg", F.lit(360.0)), 6) % 360 + 0.0).alias("heading_deg"), "heading_derived")


_MOVES = "radians(CAST(user_id % 5 - 2 AS DOUBLE)) AS turn, 1 + CAST(user_id % 3 - 1 AS DOUBLE) / 100 AS scale, CAST(user_id % 4 AS DOUBLE) / 8 AS u, CAST(user_id % 6 AS DOUBLE) / -8 AS v"


@query(f"""WITH {_POINTS}, n AS (SELECT frame_id, count(*) AS n, avg(x) AS cx, avg(y) AS cy FROM p GROUP BY frame_id HAVING count(DISTINCT (x, y)) > 1), m AS (SELECT n.*, CAST(frame_id AS BIGINT) AS user_id FROM n), k AS (SELECT *, {_MOVES} FROM m)
SELECT frame_id, round(u, 5) AS dx_m, round(v, 5) AS dy_m, round(degrees(turn), 5) AS rotation_deg, round(scale, 6) AS scale FROM k""")
def cl_correction_refit(spark, sf_dir):
    """Frames turned, scaled and moved about their centres by known amounts: what the refit reads off them."""
    p = points(spark, sf_dir)
    centre = p.groupBy("frame_id").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.countDistinct("x", "y").alias("places")).where("places > 1").withColumn("user_id", F.col("frame_id").cast("long"))
    raw = p.join(centre.selectExpr("frame_id", "cx", "cy", *_MOVES.split(", ")), "frame_id")
    dx, dy, a, b = F.col("x") - F.col("cx"), F.col("y") - F.col("cy"), F.col("scale") * F.cos("turn"), F.col("scale") * F.sin("turn")
    final = raw.select("idx", (F.col("cx") + F.col("u") + a * dx - b * dy).alias("x"), (F.col("cy") + F.col("v") + b * dx + a * dy).alias("y"))
    fits = centre.select("frame_id", F.lit("similarity").alias("model"), F.lit(3).alias("n_matches"))
    c = align.corrections(p, final, fits)
    return c.select("frame_id", *((F.round(k, 6 if k == "scale" else 5) + 0.0).alias(k) for k in ("dx_m", "dy_m", "rotation_deg", "scale")))


@query("""WITH g AS (SELECT event_id, event_id // 6 AS g, event_id % 6 AS f FROM events), k AS (SELECT g FROM g GROUP BY g HAVING count(*) = 6) SELECT 'f' || f AS frame_id, count(*) AS n FROM g JOIN k USING (g) GROUP BY f""")
def cl_registration(spark, sf_dir):
    """Six frames see the same animals, moved by a planted turn, scale and shift each; after all registration passes each
    animal's six places lie together: the sightings of each frame within 2 cm of their animal's mean.

    Every 1,600 animals are a site of their own, of 280 m, with its own six frames. One site of all would outgrow its images
    and what registration is for: three passes take a displacement to a 125th, so over 2.5 m more than 2 cm are left, and over
    5 m a move is rejected; turned by the last frame's angle that is 2.5 km and 5 km from the middle."""
    e = table(spark, sf_dir, "events").selectExpr("event_id AS idx", "event_id DIV 6 AS g", "cast(event_id % 6 as int) AS f")
    whole = e.groupBy("g").count().where("count = 6").select("g")
    world = e.join(whole, "g").selectExpr("idx", "g", "f", "g DIV 1600 AS site", "cast(g % 40 as double) * 7D + cast(g % 3 as double) AS wx", "cast(g % 1600 DIV 40 as double) * 7D + cast(g % 5 as double) * 0.5D AS wy")
    dx, dy = F.col("wx") - 140, F.col("wy") - 140
    turn, scale = F.col("f") * 2e-4, 1 + F.col("f") * 1e-4
    p = world.select("idx", "g", "f", F.concat("site", F.lit("f"), "f").alias("frame_id"), F.lit("cow").alias("label"), F.lit(0.9).alias("confidence"), F.col("idx").cast("string").alias("detection_id"),
                     (F.col("site") % 100 * 400.0 + F.col("wx") + scale * (F.cos(turn) * dx - F.sin(turn) * dy) - dx + F.col("f") * 0.05).alias("x"), (F.floor(F.col("site") / 100) * 400.0 + F.col("wy") + scale * (F.sin(turn) * dx + F.cos(turn) * dy) - dy - F.col("f") * 0.04).alias("y"))
    moved, _, _ = align.register(p, DedupConfig(eps_m=2.0, adaptive=False), RegistrationConfig())
    mean = moved.groupBy("g").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    near = moved.join(mean, "g").where(F.hypot(F.col("x") - F.col("mx"), F.col("y") - F.col("my")) <= 0.02)
    return near.groupBy("f").agg(F.count("*").alias("n")).select(F.concat(F.lit("f"), "f").alias("frame_id"), "n")


@query()
def survey_records(spark, sf_dir):
    """The whole pipeline: cast, cluster, register, resolve."""
    return flagship(spark, sf_dir)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.dataset import Dataset

    r = survey.run(Dataset(frames(spark, sf_dir), detections(spark, sf_dir)), DedupConfig(eps_m=EPS, adaptive=False), RegistrationConfig(iterations=1))
    return r.animals.select("animal_id", "label", "confidence", F.round("latitude", 7).alias("latitude"), F.round("longitude", 7).alias("longitude"), "n_observations", F.size("frame_ids").alias("n_frames"), F.round("spread_m", 3).alias("spread_m"), "class_conflict")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

"""Flight telemetry: subtitle logs and CSV, as one row per sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import Headers, header, number, present

# Column aliases in order of preference.
FRAME_ID = ("image", "image_name", "filename", "file_name", "file", "photo", "frame_id", "source_file")
FRAME_NUMBER = ("frame_number", "frame", "framecnt", "frame_idx", "frame_index")
TIME_S = ("time_s", "time_sec", "seconds", "offset_s", "elapsed_s", "time")
DATETIME = ("datetime", "timestamp", "datetime_utc", "date_time", "utc_time")
LATITUDE = ("latitude", "lat", "gps_latitude")
LONGITUDE = ("longitude", "lon", "lng", "long", "gps_longitude")
ALTITUDE = ("altitude_agl_m", "altitude_agl", "agl", "rel_alt", "relative_altitude", "height_above_takeoff", "height", "altitude", "alt")
HEADING = ("heading_deg", "gimbal_heading", "gimbal_yaw", "gimbal_yaw_degree", "gb_yaw", "camera_yaw", "heading", "yaw", "compass_heading", "flight_yaw_degree")
PITCH = ("gimbal_pitch_deg", "gimbal_pitch", "gimbal_pitch_degree", "gb_pitch", "camera_pitch")
ROLL = ("gimbal_roll_deg", "gimbal_roll", "gimbal_roll_degree", "gb_roll", "camera_roll")
FEET, MILLISECONDS = ("ft", "feet", "foot"), ("ms", "millisecond", "milliseconds")
# Keys of subtitle payloads in order of preference.
SRT_ALTITUDE = ("rel_alt", "relative_alt", "height", "barometer", "h")
SRT_HEADING = ("gb_yaw", "gimbal_yaw", "gimbal_heading", "heading", "yaw")
SRT_PITCH = ("gb_pitch", "gimbal_pitch", "camera_pitch")
SRT_ROLL = ("gb_roll", "gimbal_roll", "camera_roll")
# Patterns of subtitle payloads.
_TIME = r"(\d+):(\d{2}):(\d{2})[,.](\d{1,3})\s*-->\s*\d+:\d{2}:\d{2}[,.]\d{1,3}"
_PAIR = r"([A-Za-z_][A-Za-z_\.]*)\s*[:=]\s*(-?\d+(?:\.\d+)?)"
_GPS = r"GPS\s*\(\s*(-?\d+(?:\.\d+)?)\s*,\s*(-?\d+(?:\.\d+)?)"
_HEIGHT = r"(?:^|[\s,])H\s+(-?\d+(?:\.\d+)?)\s*m\b"
_STAMP = r"\d{4}[-.]\d{2}[-.]\d{2}[ T]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?"
_COUNT = r"(?i)(?:FrameCnt|SrtCnt)\s*[:=]\s*(\d+)"

COLUMNS = ["track", "track_order", "seq", "latitude", "longitude", "altitude_agl_m", "heading_deg", "gimbal_pitch_deg", "gimbal_roll_deg", "time_s", "frame_number", "frame_id", "timestamp"]


def _fix(lat: Column, lon: Column) -> Column:
    """A position, other than the zero that stands for none."""
    return lat.isNotNull() & lon.isNotNull() & ~((F.abs(lat) < 1e-9) & (F.abs(lon) < 1e-9))


def parse_srt(texts: DataFrame) -> DataFrame:
    """Samples of subtitle logs: texts(track, track_order, value). Blocks are split and read by expressions."""
    clean = F.trim(F.regexp_replace("value", "﻿", ""))
    block = texts.select("track", "track_order", F.posexplode(F.split(clean, r"\r?\n\s*\r?\n")).alias("seq", "b")).where(F.col("b").rlike(_TIME))
    body = F.regexp_replace(F.regexp_replace("b", r"(?s)^.*?" + _TIME, ""), r"<[^>]+>", " ")
    got = block.select("track", "track_order", F.col("seq").cast("long").alias("seq"), "b", body.alias("p"))
    part = lambda i: F.regexp_extract("b", _TIME, i)
    time_s = part(1).cast("int") * 3600 + part(2).cast("int") * 60 + part(3).cast("int") + F.rpad(part(4), 3, "0").cast("int") / 1000.0
    keys, values = F.regexp_extract_all("p", F.lit(_PAIR), F.lit(1)), F.regexp_extract_all("p", F.lit(_PAIR), F.lit(2))
    got = got.withColumns({"time_s": time_s, "kv": F.arrays_zip(F.transform(keys, F.lower).alias("k"), values.alias("v"))})

    def first(*names: str) -> Column:
        of = lambda n: F.get(F.filter("kv", lambda e: e.k == n), F.lit(0)).v.try_cast("double")
        return F.coalesce(*map(of, names))

    gps = lambda i: F.nullif(F.regexp_extract("p", _GPS, i), F.lit("")).try_cast("double")
    lat, lon = first("latitude", "lat"), first("longitude", "lon", "lng")
    pair = (lat.isNull() | lon.isNull()) & gps(1).isNotNull()
    swapped = F.abs(gps(2)) > 90
    empty = lambda c: F.nullif(c, F.lit(""))
    rows = got.select(
        "track", "track_order", "seq", F.when(pair, F.when(swapped, gps(1)).otherwise(gps(2))).otherwise(lat).alias("latitude"), F.when(pair, F.when(swapped, gps(2)).otherwise(gps(1))).otherwise(lon).alias("longitude"),
        F.coalesce(first(*SRT_ALTITUDE), empty(F.regexp_extract("p", _HEIGHT, 1)).try_cast("double")).alias("altitude_agl_m"), F.pmod(first(*SRT_HEADING), F.lit(360.0)).alias("heading_deg"),
        first(*SRT_PITCH).alias("gimbal_pitch_deg"), first(*SRT_ROLL).alias("gimbal_roll_deg"), "time_s", empty(F.regexp_extract("p", _COUNT, 1)).cast("int").alias("frame_number"),
        F.lit(None).cast("string").alias("frame_id"), empty(F.regexp_extract("p", f"({_STAMP})", 1)).alias("timestamp"))
    return rows.where(_fix(F.col("latitude"), F.col("longitude"))).select(*COLUMNS)


def read_srt(spark: SparkSession, path: str, order: int = 0) -> DataFrame:
    text = spark.read.text(path, wholetext=True)
    return parse_srt(text.select(F.col("_metadata.file_name").alias("track"), F.lit(order).alias("track_order"), "value"))


def parse_csv(rows: DataFrame, track: str, order: int = 0) -> DataFrame:
    """Samples of a telemetry table whose columns are text; _row is the line's number."""
    h = Headers([c for c in rows.columns if c != "_row"])
    if not (h.find(LATITUDE) and h.find(LONGITUDE)):
        raise ValueError("telemetry needs latitude and longitude columns")
    alt, time = h.find(ALTITUDE), h.find(TIME_S)
    altitude = number(h.column(ALTITUDE)) * (0.3048 if alt and alt[1] in FEET else 1.0)
    given = number(h.column(TIME_S)) * (0.001 if time and time[1] in MILLISECONDS else 1.0)
    stamp = present(h.column(DATETIME))
    base = rows.select(
        F.lit(track).alias("track"), F.lit(order).alias("track_order"), F.col("_row").alias("seq"), number(h.column(LATITUDE)).alias("latitude"), number(h.column(LONGITUDE)).alias("longitude"), altitude.alias("altitude_agl_m"),
        F.pmod(number(h.column(HEADING)), F.lit(360.0)).alias("heading_deg"), number(h.column(PITCH)).alias("gimbal_pitch_deg"), number(h.column(ROLL)).alias("gimbal_roll_deg"), given.alias("given"),
        number(h.column(FRAME_NUMBER)).cast("int").alias("frame_number"), present(h.column(FRAME_ID)).alias("frame_id"), stamp.alias("timestamp"), F.unix_micros(stamp.try_cast("timestamp")).alias("us")).where(_fix(F.col("latitude"), F.col("longitude")))
    start = F.first(F.when(F.col("given").isNull(), F.col("us")), ignorenulls=True).over(W.partitionBy("track").orderBy("seq").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return base.withColumn("time_s", F.coalesce("given", (F.col("us") - start) / 1e6)).select(*COLUMNS)


def numbered_csv(spark: SparkSession, path: str) -> DataFrame:
    """A headed CSV as text columns and _row, the order of its lines."""
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=False, encoding="UTF-8")
    if not df.columns:
        raise ValueError(f"{path} is empty")
    df = df.toDF(*(c.replace("﻿", "") for c in df.columns))
    # one file: rows come in file order within a partition and partitions follow the file
    return df.withColumn("_row", F.monotonically_increasing_id())


def read_csv(spark: SparkSession, path: str, order: int = 0) -> DataFrame:
    return parse_csv(numbered_csv(spark, path), path.rstrip("/").rsplit("/", 1)[-1], order)


def warnings(samples: DataFrame, headers: list[str] | None = None) -> list[str]:
    """What the reader of these samples should know."""
    out = [f"{r.track}: {r.n} samples have no height above ground; the default flight altitude will be used for them" for r in samples.groupBy("track").agg(F.count_if(F.col("altitude_agl_m").isNull()).alias("n")).where("n > 0").orderBy("track").collect()]
    alt = Headers(headers).find(ALTITUDE) if headers else None
    if alt and header(alt[0])[0] in ("altitude", "alt"):
        out.append(f"column '{alt[0]}' is read as height above ground; make sure that it isn't above sea level")
    return out


def read_telemetry(spark: SparkSession, path: str, order: int = 0) -> DataFrame:
    """By extension: .srt or .csv."""
    kind = path.lower().rsplit(".", 1)[-1]
    if kind == "srt":
        return read_srt(spark, path, order)
    if kind == "csv":
        return read_csv(spark, path, order)
    raise ValueError(f"no telemetry reader for {path}")

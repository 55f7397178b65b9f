"""Engine datasets: frames with poses, cameras and detections, from nested JSON or flat CSV."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import number, present
from .telemetry import numbered_csv

_CAMERA = "struct<image_width:int,image_height:int,fov_deg:double,fov_type:string,cx:double,cy:double>"
SCHEMA = (
    f"camera {_CAMERA}, frames array<struct<frame_id:string,timestamp:string,latitude:double,longitude:double,altitude_agl_m:double,heading_deg:double,gimbal_pitch_deg:double,gimbal_roll_deg:double,"
    f"image_width:int,image_height:int,fov_deg:double,fov_type:string,cx:double,cy:double,camera:{_CAMERA},"
    "detections:array<struct<detection_id:string,x:double,y:double,label:string,confidence:double,truth_id:string>>>>, ground_truth array<struct<truth_id:string,label:string,latitude:double,longitude:double>>"
)

FRAME_COLUMNS = ["frame_id", "frame_order", "timestamp", "latitude", "longitude", "altitude_agl_m", "heading_deg", "gimbal_pitch_deg", "gimbal_roll_deg", "image_width", "image_height", "fov_deg", "fov_type", "cx", "cy"]
DETECTION_COLUMNS = ["idx", "frame_id", "x", "y", "label", "confidence", "detection_id", "truth_id"]
#: Columns that a flat dataset must have.
REQUIRED = ("frame_id", "latitude", "longitude", "altitude_agl_m", "heading_deg", "image_width", "image_height", "fov_deg", "x", "y")


@dataclass
class Dataset:
    frames: DataFrame
    detections: DataFrame
    truth: DataFrame | None = None
    metadata: dict = field(default_factory=dict)


def check(condition: Column, what: str, value: Column) -> Column:
    """value, or an error that names what is wrong once the row is read."""
    return F.when(condition, value).otherwise(F.raise_error(F.lit(what)))


def validated(frames: DataFrame, detections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with range checks on poses, cameras and confidences that fail when a bad row is read."""
    c = F.col
    frames = frames.withColumns({
        "latitude": check(c("latitude").between(-90, 90), "latitude must lie in -90 to 90", c("latitude")), "longitude": check(c("longitude").between(-180, 180), "longitude must lie in -180 to 180", c("longitude")),
        "altitude_agl_m": check(c("altitude_agl_m") > 0, "altitude_agl_m must be positive", c("altitude_agl_m")), "gimbal_pitch_deg": check(c("gimbal_pitch_deg").between(-180, 180), "gimbal_pitch_deg must lie in -180 to 180", c("gimbal_pitch_deg")),
        "fov_deg": check((c("fov_deg") > 0) & (c("fov_deg") < 180), "fov_deg must lie between 0 and 180", c("fov_deg")), "fov_type": check(c("fov_type").isin("horizontal", "vertical", "diagonal"), "fov_type must be horizontal, vertical or diagonal", c("fov_type")),
        "image_width": check((c("image_width") > 0) & (c("image_height") > 0), "image sizes must be positive", c("image_width"))})
    return frames, detections.withColumn("confidence", check(c("confidence").between(0, 1), "confidence must lie in 0 to 1", c("confidence")))


def read_json(spark: SparkSession, path: str) -> Dataset:
    """One nested file; a frame's camera fields come from its camera block, else its own fields, else the shared camera."""
    top = spark.read.schema(SCHEMA).option("multiLine", True).json(path)
    f = top.select("camera", F.posexplode("frames").alias("frame_order", "f"))
    part = lambda k: F.coalesce(F.col(f"f.camera.{k}"), F.col(f"f.{k}"), F.col(f"camera.{k}"))
    name = F.coalesce("f.frame_id", F.format_string("frame_%05d", "frame_order"))
    frames = f.select(
        name.alias("frame_id"), F.col("frame_order").cast("long").alias("frame_order"), "f.timestamp", "f.latitude", "f.longitude", "f.altitude_agl_m", F.pmod("f.heading_deg", F.lit(360.0)).alias("heading_deg"),
        F.coalesce("f.gimbal_pitch_deg", F.lit(-90.0)).alias("gimbal_pitch_deg"), F.coalesce("f.gimbal_roll_deg", F.lit(0.0)).alias("gimbal_roll_deg"), part("image_width").alias("image_width"), part("image_height").alias("image_height"), part("fov_deg").alias("fov_deg"),
        F.coalesce(part("fov_type"), F.lit("horizontal")).alias("fov_type"), part("cx").alias("cx"), part("cy").alias("cy"))
    d = f.select(name.alias("frame_id"), "frame_order", F.posexplode("f.detections").alias("seq", "d"))
    detections = d.select(
        (F.shiftleft(F.col("frame_order").cast("long"), 24) + F.col("seq")).alias("idx"), "frame_id", "d.x", "d.y", F.coalesce("d.label", F.lit("animal")).alias("label"),
        F.coalesce("d.confidence", F.lit(1.0)).alias("confidence"), F.coalesce("d.detection_id", F.concat_ws("#", "frame_id", "seq")).alias("detection_id"), "d.truth_id")
    truth = top.select(F.posexplode("ground_truth").alias("tid", "t")).select(F.col("tid").cast("long").alias("tid"), "t.*")
    return Dataset(*validated(frames, detections), truth)


def read_csv(spark: SparkSession, path: str) -> Dataset:
    """A row a detection, with its frame's pose; the first row of a frame gives the pose. Exact column names."""
    rows = numbered_csv(spark, path)
    missing = [c for c in REQUIRED if c not in rows.columns]
    if missing:
        raise ValueError(f"{path}: missing columns {', '.join(missing)}")
    opt = lambda k, default=None: number(F.col(k)) if k in rows.columns else F.lit(default).cast("double")
    text = lambda k, default=None: F.coalesce(present(F.col(k)), F.lit(default)) if k in rows.columns else F.lit(default).cast("string")
    bad = lambda k: check(number(F.col(k)).isNotNull(), f"{path}: a row has no number in {k}", number(F.col(k)))
    pose = F.struct(text("timestamp").alias("timestamp"), *(bad(k).alias(k) for k in ("latitude", "longitude", "altitude_agl_m")), F.pmod(bad("heading_deg"), F.lit(360.0)).alias("heading_deg"), F.coalesce(opt("gimbal_pitch_deg"), F.lit(-90.0)).alias("gimbal_pitch_deg"), F.coalesce(opt("gimbal_roll_deg"), F.lit(0.0)).alias("gimbal_roll_deg"),
                    bad("image_width").cast("int").alias("image_width"), bad("image_height").cast("int").alias("image_height"), bad("fov_deg").alias("fov_deg"), text("fov_type", "horizontal").alias("fov_type"), opt("cx").alias("cx"), opt("cy").alias("cy"))
    frames = rows.groupBy("frame_id").agg(F.min_by(pose, "_row").alias("p"), F.min("_row").alias("frame_order")).select("frame_id", "frame_order", "p.*").select(*FRAME_COLUMNS)
    detections = rows.select(F.col("_row").alias("idx"), "frame_id", bad("x").alias("x"), bad("y").alias("y"), text("label", "animal").alias("label"), F.coalesce(opt("confidence"), F.lit(1.0)).alias("confidence"), F.coalesce(text("detection_id"), F.concat_ws("#", "frame_id", "_row")).alias("detection_id"), text("truth_id").alias("truth_id"))
    return Dataset(*validated(frames, detections))


def read_dataset(spark: SparkSession, path: str) -> Dataset:
    return read_csv(spark, path) if path.lower().endswith(".csv") else read_json(spark, path)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """tid (row number), truth_id, label, latitude, longitude of a truth CSV, columns by alias."""
    from ..functions.text import Headers
    from .detections import LABEL
    from .telemetry import LATITUDE, LONGITUDE

    rows = numbered_csv(spark, path)
    h = Headers([c for c in rows.columns if c != "_row"])
    if not (h.find(LATITUDE) and h.find(LONGITUDE)):
        raise ValueError(f"{path}: truth needs latitude and longitude columns")
    place = lambda a: check(number(h.column(a)).isNotNull(), f"{path}: a row has no valid position", number(h.column(a)))
    return rows.select(F.col("_row").alias("tid"), present(h.column(("truth_id", "id"))).alias("truth_id"), present(h.column(LABEL)).alias("label"), place(LATITUDE).alias("latitude"), place(LONGITUDE).alias("longitude"))


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """The records of a map report: animal_id, label, confidence, latitude, longitude, n_observations."""
    top = spark.read.option("multiLine", True).json(path)
    if "animals" not in top.columns:
        raise ValueError(f"{path} is not a report: it has no animals")
    a = top.select(F.posexplode("animals").alias("n", "a"))
    return a.select((F.col("n") + 1).cast("long").alias("number"), F.col("a.id").alias("animal_id"), "a.label", "a.confidence", F.col("a.lat").alias("latitude"), F.col("a.lon").alias("longitude"), F.col("a.observations").alias("n_observations"))

"""Detections to telemetry: by image stem, by frame number, and by time with interpolation.

Telemetry rows: track, seq, latitude, longitude, altitude_agl_m, heading_deg, gimbal_pitch_deg,
gimbal_roll_deg, time_s, frame_number, frame_id, timestamp. All lookups are joins on (track, key); the time
lookup sorts samples and probes of a track together and looks back and ahead (Spark has no as-of join).
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import IngestOptions
from ..functions.geo import EARTH_RADIUS, bearing, haversine, lerp, lerp_angle
from ..functions.mathx import NUMPY
from ..functions.text import frame_key

POSE = ["latitude", "longitude", "altitude_agl_m", "heading_deg", "gimbal_pitch_deg", "gimbal_roll_deg"]
#: Across a gap this long nothing is interpolated.
LONG_GAP_S = 30.0
#: Seconds of a track that are sorted together for time lookups.
SLOT_S = 600.0
# Why a detection found no pose.
UNKNOWN_SOURCE = "unknown telemetry source"
AMBIGUOUS = "ambiguous telemetry (add a 'video' column naming the log file)"
NO_SAMPLE, NO_ALTITUDE, NO_HEADING = "no telemetry for frame", "no altitude above ground", "no heading"
OUTSIDE = "outside image"


def at_time(probes: DataFrame, telemetry: DataFrame, tolerance: float) -> DataFrame:
    """probes (track, id, t) with the pose columns and timestamp at their time, null where there is none.

    An exact time takes the first sample with it. Before the first and after the last sample, the edge one counts
    within the tolerance; so does the nearer one across a long gap (of equal ones the earlier). Else both
    neighbours are interpolated, headings along the shorter arc.

    Samples and probes are sorted together within slots of SLOT_S seconds of a track, so that a long track spreads over
    tasks; across slots only the first and last sample of each are carried. The sample after a probe is the last one
    before it in the reverse order, which a running window finds as cheaply as the one before.
    """
    sample = F.struct("time_s", *POSE, "timestamp")
    kind_of = "struct<time_s:double," + ",".join(f"{c}:double" for c in POSE) + ",timestamp:string>"
    slot = lambda c: F.floor(F.col(c) / SLOT_S).cast("long").alias("slot")
    timed = telemetry.where("time_s is not null").select("track", slot("time_s"), F.col("time_s").alias("t"), F.lit(1).alias("kind"), F.col("seq").alias("o"), sample.alias("s"), F.lit(None).cast("long").alias("id"))
    asked = probes.select("track", slot("t"), "t", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("o"), F.lit(None).cast(kind_of).alias("s"), "id")
    both = timed.unionByName(asked)
    slots = both.groupBy("track", "slot").agg(F.min_by("s", F.when(F.col("kind") == 1, F.struct("t", "o"))).alias("first"), F.max_by("s", F.when(F.col("kind") == 1, F.struct("t", F.col("o")))).alias("last"))
    by_slot, all_before = W.partitionBy("track"), (W.unboundedPreceding, -1)
    carried = slots.select("track", "slot", F.last("last", ignorenulls=True).over(by_slot.orderBy("slot").rowsBetween(*all_before)).alias("earlier"), F.last("first", ignorenulls=True).over(by_slot.orderBy(F.desc("slot")).rowsBetween(*all_before)).alias("later"))
    within = W.partitionBy("track", "slot")
    seen = both.withColumns({
        "p": F.last("s", ignorenulls=True).over(within.orderBy("t", "kind", "o").rowsBetween(*all_before)),
        "n": F.last("s", ignorenulls=True).over(within.orderBy(F.desc("t"), F.desc("kind"), F.desc("o")).rowsBetween(*all_before)),
    }).where("kind = 0").join(carried, ["track", "slot"]).withColumns({"p": F.coalesce("p", "earlier"), "n": F.coalesce("n", "later")})
    t, p, n = F.col("t"), F.col("p"), F.col("n")
    before, after = t - p.time_s, n.time_s - t
    share = before / (n.time_s - p.time_s)
    near = F.when(before <= after, F.when(before <= tolerance, p)).otherwise(F.when(after <= tolerance, n))
    blend = F.struct(t.alias("time_s"), *((lerp_angle if c == "heading_deg" else lerp)(p[c], n[c], share).alias(c) for c in POSE), F.lit(None).cast("string").alias("timestamp"))
    found = (
        F.when(n.time_s == t, n)
        .when(p.isNull(), F.when(after <= tolerance, n))
        .when(n.isNull(), F.when(before <= tolerance, p))
        .when(n.time_s - p.time_s > LONG_GAP_S, near)
        .otherwise(blend)
    )
    return seen.select("track", "id", "t", found.alias("s")).select("track", "id", "t", *(F.col(f"s.{c}").alias(c) for c in POSE), F.col("s.timestamp").alias("timestamp"))


def _bounds(lat: np.ndarray, lon: np.ndarray) -> list[np.ndarray]:
    """Boxes (least and greatest latitude and longitude) of runs of 1, 2, 4 ... samples of a track."""
    levels = [np.stack([lat, lat, lon, lon])]
    while levels[-1].shape[1] > 1:
        low = levels[-1][:, : levels[-1].shape[1] // 2 * 2]
        pairs = low.reshape(4, -1, 2)
        levels.append(np.stack([pairs[0].min(1), pairs[1].max(1), pairs[2].min(1), pairs[3].max(1)]))
    return levels


def first_beyond(lat: np.ndarray, lon: np.ndarray, least_m: float) -> np.ndarray:
    """For each sample the next one at least so far from it, or -1. All samples look ahead at once: a run of samples that
    lies wholly nearer, by the box around it, is stepped over, so a hovering drone costs little more than a moving one."""
    n = len(lat)
    levels = _bounds(lat, lon)
    out, at, level = np.full(n, -1), np.arange(1, n + 1), np.zeros(n, int)
    open_ = np.flatnonzero(at < n)
    while len(open_):
        i, j, k = open_, at[open_], level[open_]
        skip = np.zeros(len(open_), bool)
        for step in np.unique(k):
            rows = np.flatnonzero(k == step)
            size = 1 << int(step)
            box = levels[step]
            rows = rows[(j[rows] % size == 0) & (j[rows] // size < box.shape[1])]
            if not len(rows):
                continue
            s, w, a, o = box[:, j[rows] // size], i[rows], lat[i[rows]], lon[i[rows]]
            if step == 0:
                skip[rows] = haversine(a, o, s[0], s[2], NUMPY) < least_m
            else:
                up = np.maximum(np.abs(s[0] - a), np.abs(s[1] - a))
                across = np.maximum(np.abs(s[2] - o), np.abs(s[3] - o)) * np.cos(np.radians(np.minimum(np.minimum(np.abs(s[0]), np.abs(s[1])), np.abs(a)) * (s[0] * s[1] > 0)))
                skip[rows] = np.radians(np.hypot(up, across)) * EARTH_RADIUS * (1 + 1e-9) < least_m
        found = ~skip & (k == 0)
        out[open_[found]] = j[found]
        at[open_[skip]] = j[skip] + (1 << k[skip])
        level[open_[skip]] = np.minimum(k[skip] + 1, len(levels) - 1)
        level[open_[~skip & (k > 0)]] -= 1
        open_ = open_[~found]
        open_ = open_[at[open_] < n]
    return out


def course_over_ground(lat: np.ndarray, lon: np.ndarray, baseline_m: float, turn_deg: float) -> np.ndarray:
    """The heading of each sample of a track from its own movement, NaN where it never moves a baseline.

    A sample takes the course to the next place a baseline away. Where that differs from the course by which it came by
    more than a turn, it still belongs to the leg before if that leg was straight up to here.
    """
    n = len(lat)
    ahead = first_beyond(lat, lon, baseline_m)
    back = first_beyond(lat[::-1], lon[::-1], baseline_m)[::-1]
    back = np.where(back >= 0, n - 1 - back, -1)
    place = lambda i: (lat[i], lon[i])
    every = np.arange(n)
    leaving = np.where(ahead >= 0, bearing(*place(every), *place(ahead), NUMPY), np.nan)
    coming = np.where(back >= 0, bearing(*place(back), *place(every), NUMPY), np.nan)
    before = np.where(back >= 0, coming[back], np.nan)  # the course by which the place before was reached
    apart = lambda a, b: np.abs((a - b + 180) % 360 - 180)
    with np.errstate(invalid="ignore"):
        last_of_leg = (apart(leaving, coming) > turn_deg) & (apart(before, coming) <= turn_deg)
    return np.where(np.isnan(leaving) | last_of_leg, coming, leaving)


def derive_headings(telemetry: DataFrame, baseline_m: float = 2.0, turn_deg: float = 30.0) -> DataFrame:
    """Fills null headings with the course over ground. A track, one flight's log, is one group; tracks whose samples all
    have a heading pass by."""

    def fill(track: pd.DataFrame) -> pd.DataFrame:
        by = ["time_s", "seq"] if track.time_s.notna().all() else ["seq"]
        track = track.sort_values(by, kind="stable").reset_index(drop=True)
        course = course_over_ground(track.latitude.to_numpy(float), track.longitude.to_numpy(float), baseline_m, turn_deg)
        missing = track.heading_deg.isna().to_numpy()
        filled = missing & ~np.isnan(course)
        given = track.heading_deg.to_numpy(dtype=float, na_value=np.nan)
        track["heading_deg"] = pd.Series(np.where(filled, course, given)).astype(object).where(~(missing & ~filled), None)
        track["heading_derived"] = filled
        return track[columns]

    schema = telemetry.drop("heading_derived").withColumn("heading_derived", F.lit(False)).schema
    columns = schema.names
    have = telemetry.where("heading_deg is not null").withColumn("heading_derived", F.lit(False))
    tracks = telemetry.where("heading_deg is null").select("track").distinct()
    rest = telemetry.drop("heading_derived").join(tracks, "track", "left_semi").groupBy("track").applyInPandas(fill, schema)
    return have.join(tracks, "track", "left_anti").select(*columns).unionByName(rest)


def match(detections: DataFrame, telemetry: DataFrame, options: IngestOptions) -> DataFrame:
    """Each detection with its pose, frame key and reason (null: matched). Detections: id, source, frame_id,
    frame_number, time_s, x, y, box, label, confidence, detection_id.

    Lookup order is name, number, time. A number is looked up exactly where the track has any numbers, and a miss is
    final; else it becomes a time. The first failing check names the reason.
    """
    tracks = telemetry.groupBy("track").agg(F.count_if(F.col("frame_number").isNotNull()).alias("numbered"), F.min("track_order").alias("track_order"))
    n_tracks = telemetry.select("track").distinct().count()
    tracks = tracks.withColumn("stem", frame_key(frame_key(F.col("track"))))
    det = detections.withColumns({"stem": frame_key(F.col("source")), "key": frame_key(F.col("frame_id"))})
    digits = F.when(F.col("key").rlike("^[0-9]+$"), F.col("key").try_cast("long"))
    det = det.withColumns({"number": F.coalesce(F.col("frame_number").cast("long"), digits)})

    named = telemetry.where("frame_id is not null").select("track", frame_key(F.col("frame_id")).alias("key"), "seq", "track_order", F.struct(*POSE, "timestamp").alias("s"))
    by_source = det.join(F.broadcast(tracks.select("stem", "track", "numbered")), "stem", "left") if n_tracks <= 100_000 else det.join(tracks.select("stem", "track", "numbered"), "stem", "left")
    # without a source: a single track serves all; of several, a name may still tell
    only = tracks.select("track", "numbered").first() if n_tracks == 1 else (None, 0)
    pool = by_source.withColumns({"only_track": F.lit(only[0]).cast("string"), "only_numbered": F.lit(only[1]).cast("long")})
    pool = pool.withColumns({"track": F.when(F.col("source").isNull(), F.col("only_track")).otherwise(F.col("track")), "numbered": F.when(F.col("source").isNull(), F.col("only_numbered")).otherwise(F.col("numbered"))})

    last_named = named.groupBy("track", "key").agg(F.max_by("s", "seq").alias("named"), F.min("track_order").alias("track_order"))
    any_named = last_named.groupBy("key").agg(F.min_by("named", "track_order").alias("any_named"), F.min_by("track", "track_order").alias("any_track"))
    numbers = telemetry.where("frame_number is not null").groupBy("track", F.col("frame_number").cast("long").alias("number")).agg(F.max_by(F.struct(*POSE, "timestamp"), "seq").alias("by_number"))
    full = pool.join(last_named.drop("track_order"), ["track", "key"], "left").join(any_named, "key", "left").join(numbers, ["track", "number"], "left")
    loose = F.col("source").isNull() & F.col("track").isNull()
    full = full.withColumns({
        "named": F.when(loose, F.col("any_named")).otherwise(F.col("named")),
        "time_key": F.when(F.col("number").isNotNull(), F.when(F.col("numbered") == 0, F.col("number") / options.fps)).otherwise(F.col("time_s")),
    })
    full = full.withColumn("t", F.when(F.col("named").isNull() & F.col("by_number").isNull() & F.col("track").isNotNull(), F.col("time_key")))
    timed = at_time(full.where("t is not null").select("track", "id", F.col("t").cast("double").alias("t")), telemetry, options.time_tolerance_s)
    timed = timed.where("latitude is not null").select("id", F.struct(*POSE, "timestamp").alias("timed"))
    full = full.join(timed, "id", "left")
    s = F.coalesce("named", "by_number", "timed")
    key = (
        F.when(F.col("named").isNotNull(), F.col("key"))
        .when(F.col("by_number").isNotNull() | F.col("number").isNotNull(), F.concat(F.coalesce("track", F.lit("")), F.format_string("#%06d", "number")))
        .otherwise(F.concat(F.coalesce("track", F.lit("")), F.format_string("@%.3fs", F.col("t"))))
    )
    full = full.withColumns({"s": s, "frame_key": key})
    pose = {c: F.col(f"s.{c}") for c in POSE}
    altitude = F.coalesce(pose["altitude_agl_m"], F.lit(options.altitude_m).cast("double"))
    reason = (
        F.when(F.col("source").isNotNull() & F.col("track").isNull(), UNKNOWN_SOURCE)
        .when(loose & F.col("named").isNull() & (F.lit(n_tracks) != 1), AMBIGUOUS)
        .when(F.col("s").isNull(), NO_SAMPLE)
        .when(altitude.isNull() | (altitude <= 0), NO_ALTITUDE)
        .when(pose["heading_deg"].isNull(), NO_HEADING)
        .when(~(F.col("x").between(0, options.width) & F.col("y").between(0, options.height)), OUTSIDE)
    )
    return full.select(*detections.columns, "frame_key", pose["latitude"].alias("latitude"), pose["longitude"].alias("longitude"), altitude.alias("altitude_agl_m"), pose["heading_deg"].alias("heading_deg"),
                       F.coalesce(pose["gimbal_pitch_deg"], F.lit(float(options.pitch_deg))).alias("gimbal_pitch_deg"), F.coalesce(pose["gimbal_roll_deg"], F.lit(0.0)).alias("gimbal_roll_deg"), F.col("s.timestamp").alias("timestamp"), reason.alias("reason"))


def unmatched(matched: DataFrame) -> DataFrame:
    """reason, count of the detections that were left out."""
    return matched.where("reason is not null").groupBy("reason").count()


def frames_of(matched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(frames, detections): frames with the pose of their first detection; detections in order within frames."""
    good = matched.where("reason is null")
    pose = F.struct("latitude", "longitude", "altitude_agl_m", "heading_deg", "gimbal_pitch_deg", "gimbal_roll_deg", "timestamp")
    frames = good.groupBy(F.col("frame_key").alias("frame_id")).agg(F.min_by(pose, "id").alias("p"), F.min("id").alias("frame_order"), F.count("*").alias("n_detections")).select("frame_id", "frame_order", "n_detections", "p.*")
    dets = good.select(F.col("id").alias("idx"), F.col("frame_key").alias("frame_id"), "x", "y", "label", "confidence", "detection_id")
    return frames, dets


def decimate(samples: DataFrame, most: int = 4000) -> DataFrame:
    """Every n-th place of each track, for drawing: n is the count over most, at least 1."""
    n = F.count("*").over(W.partitionBy("track"))
    i = F.row_number().over(W.partitionBy("track").orderBy("seq")) - 1
    return samples.withColumns({"_n": F.greatest(F.lit(1), F.floor(n / most)), "_i": i}).where("_i % _n = 0").drop("_n", "_i")


def track_counts(samples: DataFrame) -> DataFrame:
    """track, samples, derived (headings filled in), first_seq."""
    return samples.groupBy("track").agg(F.count("*").alias("samples"), F.count_if("heading_derived").alias("derived"), F.min("seq").alias("first_seq"))

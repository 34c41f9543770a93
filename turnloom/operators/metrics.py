"""Aggregates over the rows of a window in their order.

keys name the window; t is the time column. Rows in which nothing was detected are those whose flag is false: they count for
coverage alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Thresholds of the measures.
BLINK, SMILE, VISIBLE, GESTURE = 0.5, 0.2, 0.5, 0.15
FINGER_RADIAL, THUMB_AWAY, LEAST_SEGMENT_S = 1.15, 0.68, 0.4
PAUSE_S, JUNCTURE_S = 0.25, 0.1
FINGERS = ((6, 8), (10, 12), (14, 16), (18, 20))  # middle joint and tip in a 21-point hand
WRIST, THUMB_TIP, MIDDLE_KNUCKLE = 0, 4, 9


def by_time(keys: list[str], *t: str):
    return Window.partitionBy(*keys).orderBy(*t)


def crossings(rows: DataFrame, keys: list[str], t: str, value: str, at: float = BLINK) -> DataFrame:
    """keys, crossings: how often value rises from below at to at or more; before the first row it is 0."""
    before = F.lag(value, 1, 0.0).over(by_time(keys, t))
    up = ((before < at) & (F.col(value) >= at)).cast("int")
    return rows.withColumn("_up", up).groupBy(*keys).agg(F.sum("_up").alias("crossings"))


def face_measures(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Coverage, and over the rows with a face means, the largest smile, its share above SMILE, and spreads of the angles."""
    seen = F.col("face")
    mean = lambda c: F.avg(F.when(seen, F.col(c)))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("face_frames"),
        F.avg(seen.cast("double")).alias("face_seen_ratio"),
        mean("smile").alias("smile_mean"),
        F.max(F.when(seen, F.col("smile"))).alias("smile_max"),
        F.avg(F.when(seen, (F.col("smile") > SMILE).cast("double"))).alias("smile_ratio"),
        mean("brow_down").alias("brow_down_mean"),
        mean("press").alias("mouth_press_mean"),
        mean("gaze_off").alias("gaze_off_mean"),
        *(F.stddev_pop(F.when(seen, F.col(c))).alias(f"{c}_std_deg") for c in ("yaw", "pitch")),
    )


def face_window(rows: DataFrame, keys: list[str], t: str) -> DataFrame:
    """face_measures with blink_count and lip_motion, from row to row of those with a face: one shuffle for all."""
    dealt = rows.repartition(*keys)
    seen = Window.partitionBy(*keys, "face").orderBy(t)
    steps = dealt.withColumns({"_up": (F.lag("blink", 1, 0.0).over(seen) < BLINK) & (F.col("blink") >= BLINK), "_move": mean_distance(F.lag("lips").over(seen), F.col("lips"))})
    with_face = lambda c: F.when(F.col("face"), c)
    moves = steps.groupBy(*keys).agg(
        F.when(F.max("face"), F.count_if(with_face(F.col("_up")))).alias("blink_count"),
        F.when(F.max("face"), F.coalesce(F.avg(with_face(F.col("_move"))), F.lit(0.0))).alias("lip_motion"),
    )
    return face_measures(dealt, keys).join(moves, keys)


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two points as arrays."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d))


def mean_distance(a: Column, b: Column) -> Column:
    """Mean distance of the points of two arrays of points, pair by pair."""
    return F.aggregate(F.zip_with(a, b, distance), F.lit(0.0), lambda s, d: s + d) / F.size(a)


def velocity(rows: DataFrame, keys: list[str], t: str, points: str) -> DataFrame:
    """keys, motion: mean movement of points (an array of points) from row to row; 0 for a single row."""
    moved = rows.withColumn("_d", mean_distance(F.lag(points).over(by_time(keys, t)), F.col(points)))
    return moved.groupBy(*keys).agg(F.coalesce(F.avg("_d"), F.lit(0.0)).alias("motion"))


def pose_measures(rows: DataFrame, keys: list[str], t: str) -> DataFrame:
    """Posture, sway and wrists of rows (sh_w, sh_x, sh_y, nose_x, nose_y, lx, ly, lv, rx, ry, rv), all in shoulder widths.

    Wrist motion is the larger movement of the wrists visible both before and after; a movement over GESTURE is an event. Rows whose
    flag pose is false (if there is one) count for coverage alone.
    """
    rows = rows if "pose" in rows.columns else rows.withColumn("pose", F.lit(True))
    all_rows, rows = rows, rows.where("pose")
    w = by_time(keys, t)
    moved = lambda s: F.when(
        (F.lag(f"{s}v").over(w) > VISIBLE) & (F.col(f"{s}v") > VISIBLE),
        F.sqrt(F.pow(F.col(f"{s}x") - F.lag(f"{s}x").over(w), 2) + F.pow(F.col(f"{s}y") - F.lag(f"{s}y").over(w), 2)),
    )
    scale = rows.groupBy(*keys).agg(F.avg("sh_w").alias("_mean")).withColumn("_scale", F.when(F.col("_mean") == 0, 1e-6).otherwise(F.col("_mean")))
    steps = rows.withColumn("_move", F.greatest(moved("l"), moved("r"))).join(scale.select(*keys, "_scale"), keys)
    std = lambda a, b: (F.stddev_pop(a) + F.stddev_pop(b)) / 2 / F.first("_scale")
    enough = F.count(F.lit(1)) >= 2
    speed = F.col("_move") / F.col("_scale")
    cover = all_rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("pose_frames"), F.avg(F.col("pose").cast("double")).alias("pose_seen_ratio"))
    moves = steps.groupBy(*keys).agg(
        F.when(enough, std("sh_x", "sh_y")).alias("posture_std"),
        F.when(enough, std("nose_x", "nose_y")).alias("head_sway"),
        F.when(enough, F.avg((F.greatest("lv", "rv") > VISIBLE).cast("double"))).alias("wrist_visible"),
        F.when(enough, F.coalesce(F.avg(speed), F.lit(0.0))).alias("wrist_motion"),
        F.when(enough, F.count_if(speed > GESTURE)).alias("gesture_events"),
    )
    return cover.join(moves, keys, "left")


def stable_segments(rows: DataFrame, keys: list[str], t: str, count: str, least: float, ties: tuple[str, ...] = ()) -> DataFrame:
    """keys, count, start_t, end_t of stretches with a steady count; ties are the columns that order rows of one time.

    Counts are smoothed by the median of two rows on either side (cut to an integer), equal neighbours make runs, runs
    shorter than least go, and kept runs of equal count that meet are one.
    """
    around = by_time(keys, t, *ties).rowsBetween(-2, 2)
    near = F.array_sort(F.collect_list(count).over(around))
    n = F.size(near)
    middle = (F.element_at(near, ((n - 1) / 2).cast("int") + 1) + F.element_at(near, (n / 2).cast("int") + 1)) / 2
    smooth = rows.withColumn("_c", middle.cast("int"))
    w = by_time(keys, t, *ties)
    run = F.sum((~F.col("_c").eqNullSafe(F.lag("_c").over(w))).cast("int")).over(w)
    runs = smooth.withColumn("_run", run).groupBy(*keys, "_run").agg(F.first("_c").alias("count"), F.min(t).alias("start_t"), F.max(t).alias("end_t"))
    kept = runs.where(F.col("end_t") - F.col("start_t") >= least)
    v = by_time(keys, "start_t")
    group = F.sum((~F.col("count").eqNullSafe(F.lag("count").over(v))).cast("int")).over(v)
    return kept.withColumn("_g", group).groupBy(*keys, "_g").agg(F.first("count").alias("count"), F.min("start_t").alias("start_t"), F.max("end_t").alias("end_t")).drop("_g")


def hand_measures(rows: DataFrame, keys: list[str], t: str, least: float = LEAST_SEGMENT_S) -> DataFrame:
    """Coverage of rows (hands, fingers), the segments with a steady number of fingers, and their numbers that aren't 0."""
    cover = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("hand_frames"), F.avg((F.col("hands") > 0).cast("double")).alias("hand_seen_ratio"))
    segments = stable_segments(rows.where("hands > 0"), keys, t, "fingers", least)
    told = segments.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start_t", "end_t", "count"))).alias("finger_segments"))
    return cover.join(told.withColumn("finger_sequence", finger_sequence("finger_segments")), keys, "left")


def finger_sequence(segments: str) -> Column:
    return F.filter(F.transform(segments, lambda s: s["count"]), lambda n: n > 0)


def window_measures(face: DataFrame | None, pose: DataFrame | None, keys: list[str], hand: DataFrame | None = None) -> DataFrame:
    """The measures of all visual lanes that are on, one row for each window that any of them has rows of."""
    lanes = [lane for lane in (face, pose, hand) if lane is not None]
    return reduce(lambda a, b: a.join(b, keys, "full_outer"), lanes)


def extended_fingers(points: Column) -> Column:
    """How many fingers of a 21-point hand are stretched: tips farther from the wrist than their middle joints, the thumb's off the palm."""
    p = lambda i: F.element_at(points, i + 1)
    far = [(distance(p(WRIST), p(tip)) > distance(p(WRIST), p(joint)) * FINGER_RADIAL).cast("int") for joint, tip in FINGERS]
    palm = distance(p(WRIST), p(MIDDLE_KNUCKLE))
    thumb = ((palm > 1e-9) & (distance(p(THUMB_TIP), p(MIDDLE_KNUCKLE)) > palm * THUMB_AWAY)).cast("int")
    return sum(far[1:], far[0]) + thumb


def euler_degrees(m: Column) -> tuple[Column, Column, Column]:
    """Yaw, pitch and roll of a rotation matrix given as nine numbers, row by row."""
    at = lambda r, c: F.element_at(m, 3 * r + c + 1)
    flat = F.sqrt(at(0, 0) * at(0, 0) + at(1, 0) * at(1, 0))
    return F.degrees(F.atan2(at(1, 0), at(0, 0))), F.degrees(F.atan2(-at(2, 0), flat)), F.degrees(F.atan2(at(2, 1), at(2, 2)))


def angle_degrees(vertex: Column, a: Column, b: Column) -> Column:
    """The angle at vertex between a and b; 0 where one of them is at the vertex."""
    away = lambda x: F.zip_with(x, vertex, lambda p, q: p - q)
    dot = F.aggregate(F.zip_with(away(a), away(b), lambda p, q: p * q), F.lit(0.0), lambda s, x: s + x)
    den = distance(a, vertex) * distance(b, vertex)
    return F.when(den < 1e-9, 0.0).otherwise(F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / den)))))


def energy_trend(frames: DataFrame, keys: list[str], t: str, db: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """Slope, change from first to second half (medians) and lowest level of the frames louder than 60 % of the window.

    Windows of fewer than 8 frames, or 4 loud ones, have nulls. ties are the columns that order frames of one time. The frames are read
    once and shuffled once, by window.
    """
    order, whole = by_time(keys, t, *ties), Window.partitionBy(*keys)
    loud = frames.withColumns({"_floor": F.percentile(db, 0.4).over(whole), "frames": F.count(F.lit(1)).over(whole)}).where(F.col(db) > F.col("_floor"))
    halves = loud.withColumns({"_i": F.row_number().over(order), "_n": F.count(F.lit(1)).over(whole)})
    first = F.col("_i") <= F.floor(F.col("_n") / 2)
    ok = (F.first("frames") >= 8) & (F.count(F.lit(1)) >= 4)
    return halves.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("loud_frames"),
        F.when(ok, F.regr_slope(db, t)).alias("slope"),
        F.when(ok, F.percentile(F.when(~first, F.col(db)), 0.5) - F.percentile(F.when(first, F.col(db)), 0.5)).alias("half_to_half"),
        F.when(ok, F.min(db)).alias("trough"),
    )


def quiet_runs(frames: DataFrame, keys: list[str], t: str, quiet: Column, leading: bool = False, least: int = 1) -> DataFrame:
    """keys, start_t, frames of the runs of least quiet frames or more between loud ones (and before the first, with leading)."""
    w = by_time(keys, t)
    marked = frames.withColumn("_quiet", quiet)
    loud_before = F.sum((~F.col("_quiet")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum((~F.col("_quiet")).cast("int")).over(Window.partitionBy(*keys))
    runs = marked.withColumns({"_before": loud_before, "_all": total}).where("_quiet and _before < _all")
    runs = runs if leading else runs.where("_before > 0")
    return runs.groupBy(*keys, "_before").agg(F.min(t).alias("start_t"), F.count(F.lit(1)).alias("frames")).where(F.col("frames") >= least).drop("_before")

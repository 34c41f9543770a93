"""Rows of the visual lanes from what detectors give for a frame: plain column arithmetic.

A face has blendshapes (map of name to score), matrix (nine numbers, row by row) and points (arrays of coordinates); a pose has points
with x, y, visibility; a hand is an array of 21 points in metres. Nulls and empty arrays mean that nothing was detected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.operators.metrics import distance, euler_degrees, extended_fingers

# Blendshape names and numbers of landmarks.
PAIRS = {"smile": "mouthSmile", "brow_down": "browDown", "press": "mouthPress", "blink": "eyeBlink"}
GAZE = ("eyeLookOutLeft", "eyeLookOutRight", "eyeLookInLeft", "eyeLookInRight", "eyeLookUpLeft", "eyeLookDownLeft")
LIPS = (61, 291, 13, 14)
NOSE, LEFT_SHOULDER, RIGHT_SHOULDER, LEFT_WRIST, RIGHT_WRIST = 0, 11, 12, 15, 16


def _score(name: str) -> Column:
    return F.coalesce(F.element_at("blendshapes", name), F.lit(0.0))


def face_rows(frames: DataFrame) -> DataFrame:
    """frames with face, smile, brow_down, press, blink, gaze_off, yaw, pitch and lips."""
    seen = F.coalesce(F.size("blendshapes") > 0, F.lit(False))
    yaw, pitch, _ = euler_degrees(F.col("matrix"))
    columns = {name: (_score(f"{shape}Left") + _score(f"{shape}Right")) / 2 for name, shape in PAIRS.items()}
    columns |= {"gaze_off": F.greatest(*map(_score, GAZE)), "yaw": yaw, "pitch": pitch}
    columns["lips"] = F.array(*(F.slice(F.get("points", F.lit(i)), 1, 2) for i in LIPS))
    return frames.withColumns({"face": seen} | {name: F.when(seen, c) for name, c in columns.items()}).drop("blendshapes", "matrix", "points")


def pose_rows(frames: DataFrame) -> DataFrame:
    """frames with pose, and sh_w, sh_x, sh_y, nose_x, nose_y, and x, y and visibility of the wrists as metrics.pose_measures needs them."""
    at = lambda i, k: F.get(F.get("points", F.lit(i)), F.lit(k))
    xy = lambda i: F.array(at(i, 0), at(i, 1))
    seen = F.coalesce(F.size("points") > 0, F.lit(False))
    columns = {"sh_w": distance(xy(LEFT_SHOULDER), xy(RIGHT_SHOULDER))}
    columns |= {f"sh_{c}": (at(LEFT_SHOULDER, k) + at(RIGHT_SHOULDER, k)) / 2 for k, c in enumerate("xy")}
    columns |= {f"nose_{c}": at(NOSE, k) for k, c in enumerate("xy")}
    columns |= {f"{side}{c}": at(i, k) for side, i in (("l", LEFT_WRIST), ("r", RIGHT_WRIST)) for k, c in enumerate("xyv")}
    return frames.withColumns({"pose": seen} | {name: F.when(seen, c) for name, c in columns.items()}).drop("points")


def hand_rows(frames: DataFrame) -> DataFrame:
    """frames with hands, how many there are, and fingers, how many of all hands' are stretched."""
    hands = F.coalesce("hand_points", F.array().cast("array<array<array<double>>>"))
    fingers = F.aggregate(F.transform(hands, extended_fingers), F.lit(0), lambda s, n: s + n)
    return frames.withColumns({"hands": F.size(hands), "fingers": F.when(F.size(hands) > 0, fingers)}).drop("hand_points")

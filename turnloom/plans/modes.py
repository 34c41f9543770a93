"""What a deployment measures and evaluates, as options that decide which parts a plan has."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.operators import metrics, sentences, windows

# The modes there are, and when sentences close a window of evaluation.
TRANSCRIPTS, EVALS = ("internal", "external"), ("wall", "sentence", "off")
MOST_SENTENCES, SPAN_US = 4, 15_000_000


@dataclass(frozen=True)
class Mode:
    """transcript: windows on a grid or sentences from outside; eval: on a grid, by sentences (external only) or none; lanes that are on."""

    transcript: str = "internal"
    eval: str = "wall"
    face: bool = True
    pose: bool = True
    hand: bool = False
    prosody: bool = True

    def __post_init__(self):
        if self.transcript not in TRANSCRIPTS or self.eval not in EVALS:
            raise ValueError(f"no such mode: {self.transcript}, {self.eval}")
        if self.eval == "sentence" and self.transcript != "external":
            raise ValueError("evaluation by sentences needs transcripts from outside")


def grid_windows(mode: Mode, ends: DataFrame, width_us: int) -> DataFrame:
    """The grid's windows of readings and transcripts: none where sentences take their place."""
    found = windows.all_windows(ends, width_us)
    return found if mode.transcript == "internal" else found.where(F.lit(False))


def eval_windows(mode: Mode, ends: DataFrame, told: DataFrame, width_us: int) -> DataFrame:
    """session_id, start_us, end_us to evaluate: of the grid, of sentences (numbered, see fold_sentences), or none."""
    if mode.eval == "sentence":
        return sentences.sentence_windows(told, MOST_SENTENCES, SPAN_US)
    found = windows.all_windows(ends, width_us).select("session_id", (F.col("k") * width_us).alias("start_us"), ((F.col("k") + 1) * width_us).alias("end_us"))
    return found if mode.eval == "wall" else found.where(F.lit(False))


def tail(mode: Mode, covered: DataFrame, ends: DataFrame, least_us: int) -> DataFrame:
    """The stretch that no evaluation covers, unless none are made at all."""
    found = windows.compact_tail(covered, ends, least_us)
    return found if mode.eval != "off" else found.where(F.lit(False))


def visual_windows(mode: Mode, keys: list[str], t: str, faces: DataFrame | None = None, poses: DataFrame | None = None, hands: DataFrame | None = None) -> DataFrame | None:
    """The measures of the lanes that are on and have rows; a lane that is off isn't in the plan. None if there is none."""
    lanes = [
        metrics.face_window(faces, keys, t) if mode.face and faces is not None else None,
        metrics.pose_measures(poses, keys, t) if mode.pose and poses is not None else None,
        metrics.hand_measures(hands, keys, t) if mode.hand and hands is not None else None,
    ]
    return metrics.window_measures(*lanes[:2], keys, lanes[2]) if any(lane is not None for lane in lanes) else None


def with_lanes(windows_: DataFrame, keys: list[str], **lanes: DataFrame | None) -> DataFrame:
    """Windows with the measures of lanes as structs, null where a lane has none for a window or is off, so that no window is lost with a lane."""
    for name, lane in lanes.items():
        if lane is None:
            windows_ = windows_.withColumn(name, F.lit(None).cast("string"))
        else:
            packed = lane.select(*keys, F.struct(*(c for c in lane.columns if c not in keys)).alias(name))
            windows_ = windows_.join(packed, keys, "left")
    return windows_

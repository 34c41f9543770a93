"""Measures over ordered rows, against small loops."""

import math
import random
import statistics

from pyspark.sql import functions as F

from turnloom.operators import handoff as h
from turnloom.operators import metrics as m
from turnloom.operators import pairing as p


def test_blinks_and_smiles(spark):
    smiles = (0.9, 0.05, 0.25, 0.45, 0.15, 0.35, 0.8, 0.02)
    data = [("w", i, b, s, True) for i, (b, s) in enumerate(zip((0.8, 0.95, 0.05, 0.3, 0.55, 0.85, 0.15, 0.99), smiles))]
    df = spark.createDataFrame(data, "w string, t int, blink double, smile double, face boolean")
    assert m.crossings(df, ["w"], "t", "blink").first().crossings == 3  # the first row, the fifth and the last
    full = df.withColumns({c: F.lit(0.0) for c in ("brow_down", "press", "gaze_off", "pitch")} | {"yaw": F.col("smile")})
    r = m.face_measures(full, ["w"]).first()
    assert (r.face_frames, r.face_seen_ratio, r.smile_ratio, r.smile_max) == (8, 1.0, sum(s > 0.2 for s in smiles) / 8, 0.9)
    assert math.isclose(r.yaw_std_deg, statistics.pstdev(smiles))


def segments(counts, step, least):
    """The rule in a plain loop."""
    smooth = [int(statistics.median(counts[max(0, i - 2) : i + 3])) for i in range(len(counts))]
    out, i = [], 0
    while i < len(smooth):
        j = i
        while j + 1 < len(smooth) and smooth[j + 1] == smooth[i]:
            j += 1
        if (j - i) * step >= least:
            if out and out[-1][0] == smooth[i]:
                out[-1] = (smooth[i], out[-1][1], j * step)
            else:
                out.append((smooth[i], i * step, j * step))
        i = j + 1
    return out


def test_stable_segments(spark):
    rng = random.Random(3)
    lists = [[1] * 7 + [5, 5] + [4] * 9 + [0] + [4] * 3 + [2] * 8] + [[rng.randrange(3) for _ in range(40)] for _ in range(5)]
    df = spark.createDataFrame([(k, i * 10, c) for k, cs in enumerate(lists) for i, c in enumerate(cs)], "k int, t int, c int")
    got = sorted(tuple(r) for r in m.stable_segments(df, ["k"], "t", "c", 40).collect())
    assert got == sorted((k, *s) for k, cs in enumerate(lists) for s in segments(cs, 10, 40))
    assert [s[1] for s in sorted(got, key=lambda s: s[2]) if s[0] == 0] == [1, 4, 2]


def test_pose_wrists(spark):
    cols = "k int, t int, sh_w double, sh_x double, sh_y double, nose_x double, nose_y double, lx double, ly double, lv double, rx double, ry double, rv double"
    still = [(0, i, 0.5, 0.3, 0.6, 0.3, 0.2, 0.7 + 0.05 * i, 0.8, 0.3, 0.6, 0.8 - 0.1 * i, 0.2) for i in range(4)]
    moved = [(1, i, 0.5, 0.3, 0.6, 0.3, 0.2, 0.7, 0.8, 0.2, 0.6, 0.8 - 0.15 * i, 0.7) for i in range(4)]
    one = [(2, 0, 0.5, 0.3, 0.6, 0.3, 0.2, 0.7, 0.8, 0.6, 0.6, 0.8, 0.6)]
    r = {x.k: x for x in m.pose_measures(spark.createDataFrame(still + moved + one, cols), ["k"], "t").collect()}
    assert (r[0].wrist_visible, r[0].wrist_motion, r[0].gesture_events) == (0.0, 0.0, 0)
    assert math.isclose(r[1].wrist_motion, 0.3) and r[1].gesture_events == 3
    assert r[2].pose_frames == 1 and r[2].posture_std is None


def test_fingers_and_angles(spark):
    hand = [[0.0, 0.0, 0.0] for _ in range(21)]
    for finger, (joint, tip) in enumerate(m.FINGERS):
        hand[joint], hand[tip] = [0.1 * finger, 1.0, 0.0], [0.1 * finger, 1.5 if finger < 2 else 0.5, 0.0]
    hand[9], hand[4] = [0.0, 1.0, 0.0], [1.0, 1.0, 0.0]
    df = spark.createDataFrame([(hand, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0])], "h array<array<double>>, m array<double>")
    r = df.select(m.extended_fingers(F.col("h")).alias("n"), *m.euler_degrees(F.col("m")), m.angle_degrees(F.array(*map(F.lit, (0.0, 0.0))), F.array(*map(F.lit, (1.0, 0.0))), F.array(*map(F.lit, (0.0, 2.0)))).alias("a")).first()
    assert r.n == 3 and tuple(r)[1:4] == (0.0, 0.0, 0.0) and math.isclose(r.a, 90)


def test_quiet_runs(spark):
    df = spark.createDataFrame([("w", i, c == ".") for i, c in enumerate("..x...xx.x..")], "w string, t int, q boolean")
    run = lambda lead: sorted((r.start_t, r.frames) for r in m.quiet_runs(df, ["w"], "t", F.col("q"), lead).collect())
    assert run(False) == [(3, 3), (8, 1)] and run(True) == [(0, 2), (3, 3), (8, 1)]


def vocal(**kw):
    base = dict.fromkeys(
        ["duration_s", "voiced_frames", "voiced_ratio", *h.PITCH, "syllable_nuclei", "intensity_peak_nuclei", "phonation_s", "articulation_rate", "pause_count", "juncture_count",
         "juncture_median_s", "longest_pauses_s", "rel_db_slope_per_s", "half_to_half_delta_db", "sounding_trough_db"]
    )
    return base | {"session_id": "s"} | kw


VOCAL = "session_id string, " + ", ".join(
    f"{k} {'array<double>' if k == 'longest_pauses_s' else 'long' if k in ('voiced_frames', 'syllable_nuclei', 'intensity_peak_nuclei', 'pause_count', 'juncture_count') else 'double'}" for k in vocal() if k != "session_id"
)


def vocal_rows(spark, *rows):
    names = [c.split()[0] for c in VOCAL.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], VOCAL)


def test_vocal_rollup_sums_before_it_divides(spark):
    rows = vocal_rows(
        spark,
        vocal(duration_s=5.0, syllable_nuclei=15, phonation_s=3.0, sd_semitone=2.0, voiced_frames=100, voiced_ratio=0.5, pause_count=1, juncture_count=1, juncture_median_s=0.2, longest_pauses_s=[0.5, 0.3], half_to_half_delta_db=-2.0, sounding_trough_db=-20.0),
        vocal(duration_s=10.0, syllable_nuclei=51, phonation_s=9.0, sd_semitone=4.0, voiced_frames=300, voiced_ratio=0.8, pause_count=0, juncture_count=0, juncture_median_s=9.0, longest_pauses_s=[0.9], half_to_half_delta_db=1.0, sounding_trough_db=-30.0),
        vocal(duration_s=1.0, voiced_ratio=0.1),
    )
    r = h.vocal_rollup(rows, ["session_id"]).first()
    assert (r.windows, r.syllable_nuclei, r.voiced_frames, r.pause_count) == (3, 66, 400, 1)
    assert math.isclose(r.articulation_rate, 66 / 12) and math.isclose(r.sd_semitone, 3.5) and math.isclose(r.voiced_ratio, 0.7)
    assert math.isclose(r.juncture_median_s, 0.2) and r.longest_pauses_s == [0.9, 0.5, 0.3] and r.half_to_half_delta_db == 0.0 and r.sounding_trough_db == -30.0
    whisper = h.vocal_rollup(vocal_rows(spark, vocal(duration_s=2.0, voiced_ratio=0.1, voiced_frames=2)), ["session_id"]).first()
    assert whisper.voiced_ratio == 0.1 and whisper.voiced_frames is None and whisper.sd_semitone is None


def test_lane_rollup_weights_by_what_was_seen(spark):
    df = spark.createDataFrame([("s", 80, 1.0, 0.2, 3), ("s", 160, 0.5, 0.8, 2), ("s", 60, 0.0, None, 9)], "session_id string, face_frames long, face_seen_ratio double, smile_mean double, blink_count long")
    r = h.lane_rollup(df, ["session_id"], "face_frames", "face_seen_ratio", ["smile_mean"], ["blink_count"]).first()
    assert r.face_frames == 300 and math.isclose(r.face_seen_ratio, 160 / 300) and math.isclose(r.smile_mean, 0.5) and r.blink_count == 5


def test_merged_segments_shares_and_notes(spark):
    seg = spark.createDataFrame([("s", 3, 0.0, 1.0), ("s", 3, 2.0, 3.0), ("s", 2, 4.0, 5.0), ("s", 3, 6.0, 7.0)], "session_id string, count int, start_t double, end_t double")
    assert sorted((r.start_t, r.end_t, r["count"]) for r in h.merged_segments(seg, ["session_id"]).collect()) == [(0.0, 3.0, 3), (4.0, 5.0, 2), (6.0, 7.0, 3)]
    nv = spark.createDataFrame([("s", i, st, f"n{i}" if i % 2 else "") for i, st in enumerate(["b", "a", "a", "b", "c", "c", "d", "e", "f"])], "session_id string, k int, state string, note string")
    assert [(r.state, r.n) for r in h.state_shares(nv, ["session_id"], "k").orderBy("place").limit(3).collect()] == [("b", 2), ("a", 2), ("c", 2)]
    assert h.last_notes(nv, ["session_id"], "k").first().notes == ["n3", "n5", "n7"]


def test_pairing_fills_missing_sides(spark):
    nv = spark.createDataFrame([("s", 0, "engaged", 0.5), ("s", 2, "neutral", 0.1)], "session_id string, k long, state string, intensity double")
    tx = spark.createDataFrame([("s", 1, "hi"), ("s", 2, None)], "session_id string, k long, text string")
    rows = [tuple(r)[1:] for r in p.pair_windows(nv, tx).orderBy("k").collect()]
    assert rows == [(0, "engaged", 0.5, "", False), (1, None, None, "hi", True), (2, "neutral", 0.1, "", True)]


def test_later_text_of_a_window_wins_and_blanks_drop(spark):
    t = spark.createDataFrame([("s", 1, 1, "old"), ("s", 1, 2, "new"), ("s", 0, 1, "a"), ("s", 2, 1, "  ")], "session_id string, k long, seq long, text string")
    assert p.transcript(t).first().transcript == "a new"

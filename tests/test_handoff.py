"""The visual chain, hand-off documents and their lines, records and modes on small scripts."""

import pytest
from pyspark.sql import functions as F

from turnloom.operators import handoff, metrics, pairing, telling, windows
from turnloom.plans import modes
from turnloom.sources import landmarks

VOCAL = {
    "duration_s": 4.0, "voiced_frames": 80, "voiced_ratio": 0.6, "mean_hz": 180.0, "sd_semitone": 2.5, "pdq": 0.15, "range_st_10_90": 6.0, "detrended_sd_semitone": 2.0, "octave_error_frac": 0.0,
    "syllable_nuclei": 24, "intensity_peak_nuclei": 26, "phonation_s": 4.0, "articulation_rate": 6.0, "pause_count": 2, "juncture_count": 3, "juncture_median_s": 0.2, "longest_pauses_s": [0.5, 0.3],
    "rel_db_slope_per_s": 0.1, "half_to_half_delta_db": -2.0, "sounding_trough_db": -20.0,
}
VISUAL = {
    "face_frames": 80, "face_seen_ratio": 0.4, "smile_mean": 0.3, "smile_max": 0.9, "smile_ratio": 0.25, "brow_down_mean": 0.1, "mouth_press_mean": 0.1, "blink_count": 3, "gaze_off_mean": 0.2, "yaw_std_deg": 2.0,
    "pitch_std_deg": 1.0, "lip_motion": 0.001, "pose_frames": 80, "pose_seen_ratio": 1.0, "posture_std": 0.02, "head_sway": 0.03, "wrist_visible": 0.1, "wrist_motion": 0.1, "gesture_events": 4,
}
KINDS = {int: "long", float: "double", list: "array<double>"}
struct = lambda m: "struct<" + ", ".join(f"{k}: {KINDS[type(v)]}" for k, v in m.items()) + ">"
READING = "struct<state: string, intensity: double, note: string>"


def tables(spark, ends, said=(), evals=(), shown=()):
    return (
        spark.createDataFrame(list(ends), "session_id string, t double, transcript_full string"),
        spark.createDataFrame(list(said), f"session_id string, start_s double, end_s double, text string, speech {struct(VOCAL)}, visual {struct(VISUAL)}, nonverbal {READING}"),
        spark.createDataFrame(list(evals), f"session_id string, start_s double, speech {struct(VOCAL)}, visual {struct(VISUAL)}"),
        spark.createDataFrame(list(shown), f"session_id string, start_s double, transcript string, nonverbal {READING}"),
    )


def test_documents_of_sentences_and_every_fallback(spark):
    longer = VOCAL | {"duration_s": 8.0, "syllable_nuclei": 40, "phonation_s": 8.0, "articulation_rate": 5.0, "half_to_half_delta_db": 1.0, "pause_count": 1}
    wide = VISUAL | {"face_frames": 160}
    said = [("a", 0.0, 4.0, "First one.", VOCAL, VISUAL, ("nervous", 0.6, "n1")), ("a", 4.0, 12.0, "Second.", longer, wide, None), ("a", 12.0, 13.0, None, None, None, ("neutral", 0.2, ""))]
    said += [("b", 0.0, 4.0, "No reading.", None, None, None)]
    evals = [(s, 0.0, VOCAL, VISUAL) for s in "abc"]
    shown = [(s, 3.0 * i, t, ("engaged", 0.4, f"w{i}")) for s in "abcd" for i, t in enumerate(("one", " ", "two"))]
    ends = [("a", 5.0, "early"), ("a", 13.0, "the whole"), ("b", 4.0, ""), ("c", 4.0, None), ("e", 1.0, "only text")]
    d = {r.session_id: r for r in handoff.turn_documents(*tables(spark, ends, said, evals, shown)).collect()}
    assert set(d) == {"a", "b", "c", "e"}  # d has no turn end
    a = d["a"]
    assert a.transcript == "the whole" and a.t == 13.0 and (a.sentences, a.with_speech, a.with_visual, a.with_nv) == (3, 2, 2, 2)
    assert a.speech.windows == 2 and a.speech.syllable_nuclei == 64 and a.speech.speech_rate == pytest.approx(64 / 12) and a.visual.face_frames == 240
    assert [(s.state, s.share) for s in a.nonverbal.states] == [("nervous", 0.5), ("neutral", 0.5)] and a.nonverbal.intensity_mean == 0.4 and a.nonverbal.notes == ["n1"]
    assert [h.start_s for h in a.highlights] == [0.0]
    # b has sentences, so its evals don't count, but its readings come from its windows; c has neither; e has nothing but its end.
    assert d["b"].speech is None and d["b"].nonverbal.windows == 3 and d["b"].transcript == "one two"
    assert d["c"].speech.windows == 1 and d["c"].visual.face_frames == 80 and d["c"].sentences == 0 and d["c"].nonverbal.notes == ["w0", "w1", "w2"]
    assert d["e"].speech is None and d["e"].visual is None and d["e"].nonverbal is None and d["e"].transcript_chars == 9

    block = a.prompt_block
    heads = [line for line in block if line.startswith("#")]
    assert heads == ["## How to read this", "## Moments that stand out", "## States over the turn", "## Voice", "## Body"]
    assert block[0] == heads[0] and all(block[block.index(h) - 1] == "" for h in heads[1:]) and block.count("") == 4
    assert "* Volume stays level: +0.00 dB from one half to the other" in block and "* Silences: 3 pauses from 0.25 s up and 6 below" in block
    assert "* At the median a silence lasts 0.20 s" in block and "* Only 40% of frames show a face" in block and "* Arms unknown: wrists shown in 10% of frames" in block
    assert "* 0 to 4 s: nervous, 2 pauses, volume -2.0 dB | First one." in block and "* nervous 50%, neutral 50%; intensity 0.40" in block
    assert [line for line in d["e"].prompt_block if line.startswith("#")] == ["## How to read this"]
    assert "First one" not in a.prompt and "\n" not in a.prompt and a.prompt.endswith("moments: 0 to 4 s: nervous, 2 pauses, volume -2.0 dB")
    assert d["e"].prompt == ""


def test_lines_say_what_cannot_be_told(spark):
    whisper = VOCAL | {"sd_semitone": None, "voiced_ratio": 0.05, "syllable_nuclei": 0, "half_to_half_delta_db": 3.0}
    unseen = VISUAL | {"face_frames": 10, "face_seen_ratio": 0.0}
    d = handoff.turn_documents(*tables(spark, [("a", 1.0, "x")], evals=[("a", 0.0, whisper, unseen)])).first()
    assert "* Melody unknown: whispered, 5% voiced" in d.prompt_block and any(line.startswith("* Tempo unknown") for line in d.prompt_block)
    assert "* Face unknown: none in any frame" in d.prompt_block and not any("smile" in line for line in d.prompt_block)
    assert "* Volume goes up: +3.00 dB from one half to the other" in d.prompt_block
    short = telling.prompt_fragment(*(F.col(c) for c in ("speech", "visual", "nonverbal", "highlights", "articulation_mean")), 30)
    assert len(handoff.turn_documents(*tables(spark, [("a", 1.0, "x")], evals=[("a", 0.0, VOCAL, VISUAL)])).select(short.alias("p")).first().p) == 30


def test_fingers_are_told_where_hands_are_watched(spark):
    lines = lambda n, seen, fingers: [
        x for x in spark.createDataFrame([(n, seen, fingers)], "hand_frames long, hand_seen_ratio double, finger_sequence array<int>").select(
            telling.facts(telling.HANDS, F.struct("hand_frames", "hand_seen_ratio", "finger_sequence"), False).alias("x")
        ).first().x
    ]
    assert lines(9, 0.5, [3, 2, 5]) == ["Fingers held up, in turn: 3, 2, 5"]
    assert lines(9, 0.0, []) == ["Fingers unknown: no hand in any frame"] and lines(0, 0.0, None) == [] and lines(9, 0.5, []) == []


def test_halves_are_rounded_up(spark):
    """The mean and the shares of hundredths that lie half-way, whatever the doubles make of them."""
    rows = [("a", i, "engaged", v, "") for i, v in enumerate((0.48, 0.49))] + [("b", i, "engaged" if i else "neutral", 0.01 * (i == 0), "") for i in range(200)]
    nv = spark.createDataFrame(rows, "session_id string, k int, state string, intensity double, note string")
    r = {x.session_id: x.nonverbal for x in handoff.nonverbal_rollup(nv, ["session_id"], "k").collect()}
    assert r["a"].intensity_mean == 0.49 and r["b"].intensity_mean == 0.0
    assert [(x.state, x.share) for x in r["b"].states] == [("engaged", 1.0), ("neutral", 0.01)]


def test_rows_of_detectors(spark):
    blend = {"mouthSmileLeft": 0.2, "mouthSmileRight": 0.4, "eyeLookInLeft": 0.7, "eyeLookUpLeft": 0.9, "eyeBlinkLeft": 1.0}
    face = spark.createDataFrame([(1, blend, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0], [[i / 100, 0.5, 9.0] for i in range(300)]), (2, None, None, None)], "t int, blendshapes map<string,double>, matrix array<double>, points array<array<double>>")
    a, b = sorted(landmarks.face_rows(face).collect())
    assert a.face and a.smile == pytest.approx(0.3) and a.gaze_off == 0.9 and a.blink == 0.5 and a.brow_down == 0 and a.yaw == 0 and a.lips == [[0.61, 0.5], [2.91, 0.5], [0.13, 0.5], [0.14, 0.5]]
    assert not b.face and b.smile is None
    body = [[0.0, 0.0, 1.0] for _ in range(33)]
    body[0], body[11], body[12], body[15] = [0.5, 0.1, 1.0], [0.0, 0.0, 1.0], [3.0, 4.0, 1.0], [0.2, 0.3, 0.4]
    p = landmarks.pose_rows(spark.createDataFrame([(1, body)], "t int, points array<array<double>>")).first()
    assert p.pose and p.sh_w == 5 and (p.sh_x, p.sh_y, p.nose_x, p.lx, p.lv, p.rv) == (1.5, 2.0, 0.5, 0.2, 0.4, 1.0)
    hand = [[0.0, 0.0, 0.0]] + [[1.0, 0.0, 0.0]] * 20
    h = landmarks.hand_rows(spark.createDataFrame([(1, [hand, hand]), (2, [])], "t int, hand_points array<array<array<double>>>")).collect()
    assert sorted((r.t, r.hands, r.fingers) for r in h) == [(1, 2, 0), (2, 0, None)]


def test_windows_of_all_lanes_feed_the_roll_up(spark):
    """Unseen rows count for coverage alone; steps run from seen row to seen row; a lane that is off leaves no columns."""
    faces = [("s", 0, i, i != 2, 0.5, 0.0, 0.0, b, 0.1, float(i), 0.0, [[i / 10, 0.0]]) for i, b in enumerate((0.1, 0.7, 0.0, 0.2, 0.9))]
    f = spark.createDataFrame(faces, "s string, k int, t long, face boolean, smile double, brow_down double, press double, blink double, gaze_off double, yaw double, pitch double, lips array<array<double>>")
    m = metrics.face_window(f, ["s", "k"], "t").first()
    assert (m.face_frames, m.face_seen_ratio, m.blink_count) == (5, 0.8, 2) and m.lip_motion == pytest.approx((0.1 + 0.2 + 0.1) / 3)
    cols = "s string, k int, t long, pose boolean, sh_w double, sh_x double, sh_y double, nose_x double, nose_y double, lx double, ly double, lv double, rx double, ry double, rv double"
    p = spark.createDataFrame([("s", 0, i, i != 1, 1.0, float(i), 0.0, 0.0, 0.0, float(i), 0.0, 0.9, 0.0, 0.0, 0.1) for i in range(3)] + [("s", 1, 9, False, *[0.0] * 11)], cols)
    poses = {r.k: r for r in metrics.pose_measures(p, ["s", "k"], "t").collect()}
    assert poses[0].pose_seen_ratio == pytest.approx(2 / 3) and poses[0].wrist_motion == 2.0 and poses[0].gesture_events == 1 and poses[1].pose_frames == 1 and poses[1].posture_std is None
    counts = [3] * 10 + [4] + [0] * 6 + [2] * 10 + [1] * 2 + [5] * 10
    h = spark.createDataFrame([("s", 0, float(i) / 10, 1, c) for i, c in enumerate(counts)], "s string, k int, t double, hands int, fingers int")
    hands = metrics.hand_measures(h, ["s", "k"], "t")
    assert hands.first().finger_sequence == [3, 2, 5] and [x["count"] for x in hands.first().finger_segments] == [3, 0, 2, 5]
    on = modes.visual_windows(modes.Mode(hand=True), ["s", "k"], "t", f, p, h)
    total = handoff.visual_rollup(on, ["s"]).first()
    assert total.face_frames == 5 and total.pose_frames == 4 and total.hand_frames == len(counts) and total.finger_sequence == [3, 2, 5] and total.blink_count == 2
    off = handoff.visual_rollup(modes.visual_windows(modes.Mode(), ["s", "k"], "t", f, p, h), ["s"])
    assert not any("hand" in c or "finger" in c for c in off.columns)
    assert modes.visual_windows(modes.Mode(face=False, pose=False), ["s", "k"], "t", f, p, h) is None


def test_modes_choose_windows(spark):
    ends = spark.createDataFrame([("a", 50_000_000)], "session_id string, end_us long")
    told = spark.createDataFrame([("a", 1.0 * i, 1.0 * i + 1, "x", "punct", i) for i in range(5)], "session_id string, start_s double, end_s double, text string, source string, event_seq long")
    n = lambda mode: modes.eval_windows(mode, ends, told, 16_000_000).count()
    assert [n(modes.Mode()), n(modes.Mode("external", "sentence")), n(modes.Mode(eval="off"))] == [3, 1, 0]
    assert modes.grid_windows(modes.Mode("external"), ends, 3_000_000).count() == 0 and modes.grid_windows(modes.Mode(), ends, 3_000_000).count() == 16
    covered = spark.createDataFrame([("a", 16_000_000)], "session_id string, covered_us long")
    assert modes.tail(modes.Mode(eval="off"), covered, ends, 1).count() == 0 and modes.tail(modes.Mode(), covered, ends, 1).count() == 1
    with pytest.raises(ValueError, match="from outside"):
        modes.Mode("internal", "sentence")
    kept = modes.with_lanes(told.select("session_id", "event_seq"), ["session_id", "event_seq"], speech=told.where("event_seq = 1").select("session_id", "event_seq", "text"), visual=None)
    assert sorted((r.event_seq, r.speech is None, r.visual) for r in kept.collect()) == [(i, i != 1, None) for i in range(5)]


def test_media_of_intervals_and_records(spark):
    cut = spark.createDataFrame([("a", 1, 0, 200_000), ("a", 2, 1_000_000, 4_000_000), ("a", 3, 9_000_000, 1_000_000)], "session_id string, seq long, start_us long, dur_us long")
    frames = spark.createDataFrame([("a", 100_000, "f1"), ("a", 3_000_000, "f3"), ("a", 1_000_000, "f2"), ("a", 5_000_000, "f4")], "session_id string, t_us long, frame string")
    sound = spark.createDataFrame([("a", 2_000_000, 2, b"xy"), ("a", 3_000_000, 1, b"ab")], "session_id string, t_us long, arrival long, pcm binary")
    rows = {r.seq: r for r in windows.interval_media(cut, frames, sound, 3_000_000).collect()}
    assert rows[1].frames == ["f1"] and rows[1].window_us == 500_000 and rows[1].src_fps == 2.0 and rows[1].pcm is None
    assert rows[2].frames == ["f2", "f3"] and bytes(rows[2].pcm) == b"abxy" and rows[2].src_fps == 0.5 and rows[3].frames is None
    said = spark.createDataFrame([("a", 1.0, 2.5, "x", "punct")], "session_id string, start_s double, end_s double, text string, source string")
    r = pairing.records(said, "sentence").first()
    assert r.type == "sentence" and r.t == 1.75 and r.nonverbal is None and list(r.asDict())[:3] == ["type", "session_id", "t"]
    assert pairing.records(spark.createDataFrame([("a", 16.0, 16.0, "e")], "session_id string, start_s double, window_s double, eval string"), "eval").first().t == 24.0
    assert pairing.records(spark.createDataFrame([("a", 9.0, "all")], "session_id string, t double, transcript_full string"), "turn_end").columns == ["type", "session_id", "t", "transcript_full", "eval"]
    one, two = (spark.createDataFrame(x, "session_id string, k long") for x in ([("a", 1), ("a", 2)], [("a", 2), ("a", 3), ("b", 1)]))
    assert sorted(map(tuple, pairing.unmatched(one, two).collect())) == [("a", 2), ("b", 1)]

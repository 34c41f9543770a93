"""A turn's measures told in words, from one table of facts.

A fact has a condition on a roll-up, a sentence for the block of lines and a phrase for the one line. Braces name a measure and how it
is written: a printf format, or % for a share in whole percent, rounded down. A fact whose condition is null or false isn't told.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

_FIELD = re.compile(r"\{(\w+):([^}]+)\}")


class Fact(NamedTuple):
    holds: Callable[[Column], Column]
    sentence: str | None
    phrase: str | None


def _has(*names: str, also: Callable[[Column], Column] = lambda m: F.lit(True)) -> Callable[[Column], Column]:
    def holds(m: Column) -> Column:
        out = also(m)
        for name in names:
            out = out & m[name].isNotNull()
        return out

    return holds


def _breathy(m: Column) -> Column:
    return (m["syllable_nuclei"] == 0) & (F.coalesce(m["intensity_peak_nuclei"], F.lit(0)) > 0)


def _face(m: Column) -> Column:
    return (m["face_frames"] > 0) & (m["face_seen_ratio"] > 0)


def _body(m: Column) -> Column:
    return (m["pose_frames"] > 0) & m["posture_std"].isNotNull()


def _wrists(m: Column) -> Column:
    return F.coalesce(m["wrist_visible"], F.lit(0.0)) >= 0.2


SPEECH = (
    Fact(_has("pause_count"), "Silences: {pause_count:d} pauses from 0.25 s up and {juncture_count:d} below", "{pause_count:d} pauses"),
    Fact(_has("pause_count", "juncture_median_s"), "At the median a silence lasts {juncture_median_s:.2f} s", None),
    Fact(lambda m: ~_breathy(m) & m["articulation_rate"].isNotNull(), "Tempo: {articulation_rate:.2f} syllables per second of speech, {speech_rate:.2f} per second overall", "tempo {articulation_rate:.2f}"),
    Fact(_breathy, "Tempo unknown: no syllable was voiced; {intensity_peak_rate:.2f} bursts per second stand in for it", "{intensity_peak_rate:.2f} unvoiced bursts per second"),
    Fact(_has("half_to_half_delta_db", also=lambda m: m["half_to_half_delta_db"] > 1), "Volume goes up: {half_to_half_delta_db:+.2f} dB from one half to the other", "volume up {half_to_half_delta_db:+.1f} dB"),
    Fact(_has("half_to_half_delta_db", also=lambda m: m["half_to_half_delta_db"] < -1), "Volume goes down: {half_to_half_delta_db:+.2f} dB from one half to the other", "volume down {half_to_half_delta_db:+.1f} dB"),
    Fact(_has("half_to_half_delta_db", also=lambda m: F.abs(m["half_to_half_delta_db"]) <= 1), "Volume stays level: {half_to_half_delta_db:+.2f} dB from one half to the other", None),
    Fact(_has("sd_semitone"), "Melody: pitch spreads by {sd_semitone:.2f} semitones, coefficient {pdq:.3f}", "pitch spread {sd_semitone:.2f} st"),
    Fact(lambda m: m["sd_semitone"].isNull() & (m["voiced_ratio"] < 0.15), "Melody unknown: whispered, {voiced_ratio:%} voiced", "whispered"),
    Fact(lambda m: m["sd_semitone"].isNull() & ~F.coalesce(m["voiced_ratio"] < 0.15, F.lit(False)), "Melody unknown: not enough voiced sound", None),
)
HANDS = (
    Fact(lambda m: F.size(m["finger_sequence"]) > 0, "Fingers held up, in turn: {finger_sequence:s}", "fingers {finger_sequence:s}"),
    Fact(lambda m: (m["hand_frames"] > 0) & (m["hand_seen_ratio"] == 0), "Fingers unknown: no hand in any frame", None),
)
SIGHT = (
    Fact(lambda m: _body(m) & _wrists(m), "Arms: {gesture_events:d} large gestures, on average {wrist_motion:.4f} shoulder widths per frame", "{gesture_events:d} gestures"),
    Fact(lambda m: _body(m) & ~_wrists(m), "Arms unknown: wrists shown in {wrist_visible:%} of frames", "arms unknown"),
    Fact(_body, "Stance: trunk sways {posture_std:.4f} and head {head_sway:.4f} shoulder widths", None),
    Fact(_face, "Gaze: {gaze_off_mean:.3f} away from the camera, {blink_count:d} blinks", "gaze {gaze_off_mean:.3f} away"),
    Fact(_face, "Head turns by {yaw_std_deg:.2f} and nods by {pitch_std_deg:.2f} degrees (deviation)", None),
    Fact(_face, "Mouth: smile {smile_mean:.3f} on average and {smile_max:.3f} at most, above the mark in {smile_ratio:%} of frames; lips move {lip_motion:.5f}", "smile {smile_mean:.3f}"),
    Fact(lambda m: _face(m) & (m["face_seen_ratio"] < 0.5), "Only {face_seen_ratio:%} of frames show a face", None),
    Fact(lambda m: ~F.coalesce(_face(m), F.lit(False)), "Face unknown: none in any frame", None),
)
MOMENT = (
    Fact(lambda h: (h["state"] != "neutral"), None, "{state:s}"),
    Fact(lambda h: h["pause_count"] >= 2, None, "{pause_count:d} pauses"),
    Fact(lambda h: F.abs(h["energy_delta_db"]) >= 2.0, None, "volume {energy_delta_db:+.1f} dB"),
)
READING_THIS = (
    "Figures cover the whole turn unless a time stands before them.",
    "Unknown means that nothing was measured; it isn't zero.",
    "States are read from video by a model and can be wrong.",
)


def told(template: str, m: Column) -> Column:
    """The template with measures of m in it."""
    values = []
    for name, form in _FIELD.findall(template):
        value = m[name]
        if name == "finger_sequence":
            value = F.array_join(F.transform(value, lambda n: n.cast("string")), ", ")
        elif form == "%":
            value = F.floor(value * 100)
        else:
            value = value.cast({"d": "long", "s": "string"}.get(form[-1], "double"))
        values.append(value)
    text = _FIELD.sub(lambda f: "%d%%" if f[2] == "%" else f"%{f[2]}", template)
    return F.format_string(text, *values) if values else F.lit(template)


def facts(table: tuple[Fact, ...], m: Column, short: bool) -> Column:
    """What a table tells of m: sentences, or phrases if short."""
    kept = [(f.holds(m), f.phrase if short else f.sentence) for f in table]
    texts = F.array(*(F.when(m.isNotNull() & holds, told(text, m)) for holds, text in kept if text))
    return F.filter(texts, lambda t: t.isNotNull())


def moment(h: Column, mean: Column) -> Column:
    """When a sentence stands out, and by what."""
    odd = F.when(F.abs(h["articulation_rate"] - mean) > 1.0, F.format_string("tempo %.2f against %.1f", h["articulation_rate"].cast("double"), mean))
    why = F.concat(facts(MOMENT, h, True), F.filter(F.array(odd), lambda t: t.isNotNull()))
    at = [F.coalesce(h[c], F.lit(0)).cast("long") for c in ("start_s", "end_s")]
    return F.concat(F.format_string("%d to %d s: ", *at), F.array_join(why, ", "))


def shares(nonverbal: Column) -> Column:
    return F.array_join(F.transform(nonverbal["states"], lambda s: F.format_string("%s %d%%", s["state"], F.floor(s["share"] * 100))), ", ")


def _sight(visual: Column, hands: bool, short: bool) -> Column:
    return F.concat(facts(HANDS, visual, short), facts(SIGHT, visual, short)) if hands else facts(SIGHT, visual, short)


def prompt_block(speech: Column, visual: Column, nonverbal: Column, highlights: Column, mean: Column, hands: bool = False) -> Column:
    """Lines for a reader, in sections under a heading, a blank line between two; sections without a line are left out."""
    states = F.when(nonverbal["windows"] > 0, F.array(F.concat(shares(nonverbal), F.format_string("; intensity %.2f", nonverbal["intensity_mean"]))))
    said = lambda h: F.concat(moment(h, mean), F.lit(" | "), F.substring(h["text"], 1, 40))
    parts = (
        ("How to read this", F.array(*map(F.lit, READING_THIS))),
        ("Moments that stand out", F.transform(highlights, said)),
        ("States over the turn", states),
        ("Voice", facts(SPEECH, speech, False)),
        ("Body", _sight(visual, hands, False)),
    )
    sections = F.array(*(F.when(F.size(lines) > 0, F.concat(F.array(F.lit(f"## {title}")), F.transform(lines, lambda x: F.concat(F.lit("* "), x)))) for title, lines in parts))
    some = F.filter(sections, lambda s: s.isNotNull())
    return F.flatten(F.transform(some, lambda s, i: F.when(i == 0, s).otherwise(F.concat(F.array(F.lit("")), s))))


def prompt_fragment(speech: Column, visual: Column, nonverbal: Column, highlights: Column, mean: Column, most_chars: int = 880, hands: bool = False) -> Column:
    """The same in one line of at most most_chars, without a word of the transcript."""
    moments = F.transform(highlights, lambda h: moment(h, mean))
    parts = (
        ("voice", facts(SPEECH, speech, True)),
        ("body", F.when(visual["face_frames"] > 0, _sight(visual, hands, True))),
        ("states", F.when(nonverbal["windows"] > 0, F.array(shares(nonverbal)))),
        ("moments", moments),
    )
    told_ = F.array(*(F.when(F.size(x) > 0, F.concat(F.lit(f"{name}: "), F.array_join(x, ", " if name != "moments" else "; "))) for name, x in parts))
    return F.substring(F.array_join(F.filter(told_, lambda t: t.isNotNull()), " / "), 1, most_chars)

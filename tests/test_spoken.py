"""The chain of live sentences and their windows against the batch forms, where polls are rows."""

import random

from turnloom.operators.sentences import fold_sentences, sentence_windows
from turnloom.streaming.spoken import timed_sentences, timed_windows

from test_turns import play

EVENTS = "session_id string, seq long, media_now double, kind string, item_id string, text string"


def talk(sessions=4, n=60, poll=2.0, seed=3):
    """Events at quarters of a second, and the same with a tick after those up to each poll."""
    rng, live, batch = random.Random(seed), [], []
    for s in range(sessions):
        now, rows = 0.0, []
        for _ in range(n):
            now += rng.choice([0.25, 0.5, 2.0, 2.0, 7.0])
            kind = rng.choice(["vad.speech_started", "vad.speech_stopped", "transcript.delta", "transcript.delta", "transcript.delta", "transcript.completed", "noise"])
            text = rng.choice(["One. Two", "more words here ", " ", "End."]) if kind == "transcript.delta" or (kind == "transcript.completed" and rng.random() < 0.5) else None
            rows.append((now, kind, rng.choice(["i", "j", None]), text))
        rows.append((now + 1.0, "turn_end", None, None))
        ticks = [(k * poll, "tick", None, None) for k in range(1, int(now / poll) + 1)]
        live += [(f"s{s}", i, *r) for i, r in enumerate(rows)]
        batch += [(f"s{s}", i, *r) for i, r in enumerate(sorted(rows + ticks, key=lambda r: (r[0], r[1] == "tick")))]
    return live, batch


def test_timers_end_utterances_as_polls_do(spark, tmp_path):
    live, batch = talk()
    folded = fold_sentences(spark.createDataFrame(batch, EVENTS), numbered=True).cache()
    want = sorted(tuple(r)[:5] for r in folded.collect())
    assert sum(w[4] == "timeout" for w in want) > 5 and sum(w[4] == "punct" for w in want) > 5
    names = [c.split()[0] for c in EVENTS.split(", ")]
    rows = [{**dict(zip(names, r)), "at": int(r[2] * 1_000_000)} for r in sorted(live, key=lambda r: (r[2], r[0], r[1]))]
    rows.append({"session_id": "z", "seq": 0, "media_now": 0.0, "at": 10**9, "kind": "noise"})
    got = play(spark, tmp_path, rows, EVENTS + ", at long", lambda s: timed_sentences(s, delay="1 second"))
    assert sorted((r.session_id, r.start_s, r.end_s, r.text, r.source) for r in got) == want


def test_the_chain_gives_the_windows_of_the_batch_form(spark, tmp_path):
    live, batch = talk(seed=5)
    want = sorted(map(tuple, sentence_windows(fold_sentences(spark.createDataFrame(batch, EVENTS), numbered=True), 4, 15_000_000).collect()))
    assert len(want) > 20
    names = [c.split()[0] for c in EVENTS.split(", ")]
    rows = [{**dict(zip(names, r)), "at": int(r[2] * 1_000_000)} for r in sorted(live, key=lambda r: (r[2], r[0], r[1]))]
    rows.append({"session_id": "z", "seq": 0, "media_now": 0.0, "at": 10**9, "kind": "noise"})
    got = play(spark, tmp_path, rows, EVENTS + ", at long", lambda s: timed_windows(timed_sentences(s, delay="1 second"), 4, 15_000_000))
    assert sorted((r.session_id, r.start_us, r.end_us) for r in got) == want


def test_a_silent_stream_ends_its_utterance_by_a_timer(spark, tmp_path):
    rows = [{"session_id": "a", "seq": 0, "media_now": 1.0, "at": 1_000_000, "kind": "transcript.delta", "text": "Left alone"}, {"session_id": "z", "seq": 0, "media_now": 0.0, "at": 60_000_000, "kind": "noise"}]
    got = play(spark, tmp_path, rows, EVENTS + ", at long", lambda s: timed_sentences(s, delay="1 second"), parts=2, stop=1)
    assert [(r.session_id, r.number, r.start_s, r.end_s, r.text, r.source) for r in got] == [("a", 1, 0.0, 12.0, "Left alone", "timeout")]

"""Model calls, sinks and resampling."""

import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnloom.functions import audio, critics
from turnloom.sources.lanes import frame_times
from turnloom.streaming.live import SinkFailure, fan_out


def test_failed_calls_are_values(spark):
    def make():
        def primary(row):
            if row["k"] % 3 == 0:
                raise ValueError("no model")
            return {"text": f"w{row['k']}"}

        def fallback(row):
            if row["k"] == 3:
                raise RuntimeError("none")
            return {"text": "local"}

        return critics.with_fallback(primary, fallback)

    df = critics.scored(spark.range(5).withColumnRenamed("id", "k"), make, "text string, engine string")
    rows = {r.k: (r.text, r.engine, r.error) for r in df.collect()}
    assert rows[0] == ("local", "fallback", None) and rows[1] == ("w1", "primary", None) and rows[3] == (None, None, "RuntimeError: none")


def test_gates_and_mock(spark):
    df = spark.createDataFrame([(1, 0), (0, 2), (3, 4)], "n_frames int, n_audio int")
    assert [critics.gated(df, a, b).count() for a, b in ((True, False), (False, True), (True, True))] == [2, 2, 1]
    r = df.select(critics.mock_reading(F.lit(3.0), F.lit(1.5)).alias("m")).first().m
    assert r.note == "window 3.0+1.5" and r.state == "neutral"


def test_a_failing_sink_does_not_stop_the_others(spark):
    seen, lost = [], []

    def broken(batch, batch_id):
        raise OSError("disk")

    def counts(batch, batch_id):
        seen.append(batch.count())

    with pytest.raises(SinkFailure, match="1 of 2 sinks failed: broken: disk"):
        fan_out(broken, counts)(spark.range(4), 7)
    fan_out(broken, counts, dead_letter=lambda batch, batch_id, name: lost.append((batch.count(), batch_id, name)))(spark.range(3), 8)
    assert seen == [4, 3] and lost == [(3, 8, "broken")]


def test_resampling_joins_chunks_without_seams(spark):
    t = np.arange(48000) / 48000
    pcm = (np.sin(2 * np.pi * 440 * t) * 16000).astype("<i2").tobytes()
    cut = [("s", "t", i, 48000, pcm[i * 9600 : (i + 1) * 9600]) for i in range(10)]
    df = spark.createDataFrame(cut[::-1], "session_id string, track string, seq int, rate int, pcm binary")
    y = audio.samples(bytes(audio.resample_tracks(df).first().pcm))
    want = np.sin(2 * np.pi * 440 * np.arange(16000) / 16000) * 16000 / 32768
    assert len(y) == 16000 and np.abs(y - want)[200:-200].max() < 0.01


def test_frames_without_a_time_get_their_number(spark):
    df = spark.createDataFrame([("s", 1, 5), ("s", 2, None)], "s string, seq int, pts long")
    assert sorted(r.t_us for r in frame_times(df, ["s"], "seq", "pts", 100).collect()) == [5, 100]


def test_calls_side_by_side_keep_order_and_memory_bounds():
    running, most = [], []

    def slow(row):
        running.append(row["k"])
        most.append(len(running))
        time.sleep(0.02 if row["k"] % 2 else 0.001)
        running.remove(row["k"])
        if row["k"] == 7:
            raise KeyError("seven")
        return {"twice": row["k"] * 2}

    taken = []

    def rows():
        for k in range(40):
            taken.append(k)
            yield {"k": k}

    told = critics.in_order(slow, rows(), 4)
    next(told)
    assert len(taken) <= 5
    rest = list(told)
    assert [r and r["twice"] for r, _ in rest] == [None if k == 7 else k * 2 for k in range(1, 40)] and rest[6][1] == "KeyError: 'seven'"
    assert 1 < max(most) <= 4


def test_calls_past_their_deadline_are_values_until_too_many(monkeypatch):
    never = threading.Event()

    def stuck(row):
        if row["k"] % 2:
            never.wait(20)
        return {"k": row["k"]}

    told = list(critics.in_order(stuck, ({"k": k} for k in range(6)), 6, 0.2))
    assert [e for _, e in told] == [None, "DeadlineExceeded: 0.2 s"] * 3
    monkeypatch.setattr(critics, "MOST_LOST", 2)
    with pytest.raises(RuntimeError, match="3 calls are past"):
        list(critics.in_order(stuck, ({"k": k} for k in range(6)), 6, 0.2))
    own = list(critics.in_order(lambda row: (_ for _ in ()).throw(TimeoutError("busy")), [{}], 1, 5.0))
    assert own == [(None, "TimeoutError: busy")]
    never.set()


def test_calls_are_tried_again_with_the_same_key(spark):
    def make():
        def critic(row):
            if row["call_try"] <= (row["k"] or 0):
                raise OSError(f"try {row['call_try']}")
            return {"seen": row["call_key"], "n": row["n"]}

        return critics.with_tries(critic, 3, 0.001)

    df = spark.createDataFrame([(0, 1.5, b"x"), (1, None, None), (2, 0.0, b""), (3, 1.0, b"y"), (None, None, None), (0, 1.5, b"x")], "k int, n double, pcm binary")
    rows = critics.scored(df, make, "seen string, tries int", ["k"], in_flight=3)
    told = rows.collect()
    assert [r.tries for r in told if r.k is not None and r.k < 3] == [1, 2, 3, 1]
    assert all(r.seen == r.call_key for r in told if r.error is None) and len({r.call_key for r in told}) == 5
    assert [r.error for r in told if r.k == 3] == ["OSError: try 3"]
    assert told[2].n == 0.0 and told[1].n is None and bytes(told[0].pcm) == b"x"
    again = {(r.k, r.call_key) for r in rows.repartition(3).collect()}
    assert again == {(r.k, r.call_key) for r in told}
    assert critics.scored(df.limit(0), make, "seen string").count() == 0
    with pytest.raises(ValueError, match="error"):
        critics.scored(df.withColumn("error", F.lit(1)), make, "seen string")


def test_a_result_of_another_type_is_an_error_of_its_row(spark):
    rows = critics.scored(spark.range(4, numPartitions=1), lambda: lambda row: {"n": "many" if row["id"] == 2 else 1}, "n int").collect()
    assert [r.n for r in rows] == [1, 1, None, 1] and [r.error is None for r in rows] == [True, True, False, True]

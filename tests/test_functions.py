"""Replies, sound, sources, the catalogue and the entry points."""

import base64
import json
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnloom.functions import audio
from turnloom.functions.replies import evaluation, mended, reply_json
from turnloom.operators.pairing import valid_reading
from turnloom.sources.lanes import audio_clock, stream_text, turn_events


@pytest.mark.parametrize(
    ("reply", "want"),
    [
        ('{"a": 1}', {"a": 1}),
        ('```json\n{"a": [1, 2]}\n```', {"a": [1, 2]}),
        ('So: {"a": "x {y}"} done', {"a": "x {y}"}),
        ('{"a": "cut of', {"a": "cut of"}),
        ('{"a": "x", "b": [1, 2', {"a": "x", "b": [1, 2]}),
        ('{"a": {"b":', {"a": {"b": None}}),
        ('{"a": "q\\" {", "b": [', {"a": 'q" {', "b": []}),
        ('{"a": 1, "b": tru', None),
        ('{"a": 1, "b', None),
        ('{"a": 1, ', {"a": 1}),
        ('```\n{"a": 1}\n```\nThat is all.', {"a": 1}),
        ('{"a": "x\\', None),
        ("nothing", None),
        ("", None),
        (None, None),
    ],
)
def test_reply_json(reply, want):
    got = reply_json(reply)
    assert (json.loads(got) if got else None) == want


def test_mended_gives_up_on_nonsense():
    assert mended("{]]") is None


def test_evaluation_is_cut_to_size(spark):
    reply = json.dumps({"verbal": {"x": "1"}, "vocal": "no", "critique": list("abcdefgh"), "key_observations": list("abcdefghijk"), "summary": "s"})
    df = spark.createDataFrame([(reply,), ("none",)], "reply string")
    full, none = evaluation(df, "reply").collect()
    assert full.verbal == {"x": "1"} and full.vocal == {} and len(full.critique) == 5 and len(full.key_observations) == 8
    assert none.critique == [] and none.verbal == {}
    assert evaluation(df, "reply", compact=True).first().key_observations == ["s"]


def test_readings_are_made_valid(spark):
    df = spark.createDataFrame([("bored", "7", None), ("engaged", "x", "n" * 200), ("nervous", "NaN", "")], "s string, i string, n string")
    rows = [tuple(r) for r in df.select(*valid_reading(F.col("s"), F.col("i"), F.col("n"))).collect()]
    assert rows == [("neutral", 1.0, ""), ("engaged", 0.0, "n" * 120), ("nervous", 1.0, "")]


def tone(hz, seconds, loud=0.5):
    t = np.arange(int(audio.RATE * seconds)) / audio.RATE
    return loud * np.sin(2 * np.pi * hz * t)


def pcm(y):
    return (np.clip(y, -1, 1) * 32767).astype("<i2").tobytes()


def test_tone_pitch_and_pauses():
    y = np.concatenate([tone(200, 1), np.zeros(8000), tone(200, 1), np.zeros(2400), tone(200, 0.5)])
    r = audio.vocal_measures(pcm(y))
    assert abs(r["mean_hz"] - 200) < 3 and r["sd_semitone"] < 0.5
    assert r["pause_count"] == 1 and r["juncture_count"] == 1 and abs(r["longest_pauses_s"][0] - 0.5) < 0.04
    sweep = np.sin(2 * np.pi * np.cumsum(np.linspace(150, 300, 32000)) / audio.RATE) * 0.5
    assert audio.vocal_measures(pcm(sweep))["sd_semitone"] > 2
    assert audio.vocal_measures(pcm(tone(200, 0.9))) is None and audio.vocal_measures(None) is None


def test_energy_falls_in_a_fade_and_syllables_follow_the_beat():
    fade = tone(200, 2) * np.linspace(1, 0.2, 32000)
    assert audio.vocal_measures(pcm(fade))["half_to_half_delta_db"] < -2
    beat = tone(200, 3) * (0.55 - 0.45 * np.cos(2 * np.pi * 4 * np.arange(48000) / audio.RATE))
    assert 10 <= audio.vocal_measures(pcm(beat))["syllable_nuclei"] <= 13
    assert audio.vocal_measures(pcm(np.zeros(32000)))["voiced_frames"] == 0


def test_leading_silence_counts_for_positions_alone():
    y = np.concatenate([np.zeros(8000), tone(200, 1), np.zeros(8000)])
    assert audio.pauses(audio.levels(audio.samples(pcm(y)))) == []
    at = audio.pauses(audio.levels(audio.samples(pcm(y))), leading=True)
    assert len(at) == 1 and at[0][0] == 0.0


def test_wav_of_the_last_seconds(spark):
    df = spark.createDataFrame([(bytes(range(7)),), (b"",)], "pcm binary")
    tail = [bytes(r.t) for r in df.select(audio.last_seconds(F.col("pcm"), 1, 2).alias("t")).collect()]
    assert tail == [bytes(range(3, 7)), b""]
    url = df.select(audio.audio_url(F.col("pcm")).alias("u")).first().u
    assert base64.b64decode(url.split(",")[1])[:4] == b"RIFF"
    assert audio.without_padding(b"abcXdefX", 2, 4, 3) == b"abcdef"


def test_sources(spark):
    df = spark.createDataFrame([(1, 1, ": x"), (1, 2, "data: {bad"), (1, 3, 'data: {"choices":[{"delta":{"content":"Hi"}}]}'), (1, 4, "data: [DONE]"), (1, 5, 'data: {"choices":[{"delta":{"content":"no"}}]}')], "id int, seq int, line string")
    assert [tuple(r) for r in stream_text(df, ["id"], "seq", "line").collect()] == [(1, 3, "Hi")]
    chunks = spark.createDataFrame([("s", 1, 5), ("s", 2, 7), ("s", 3, 1)], "s string, seq int, d long")
    assert sorted(r.at for r in audio_clock(chunks, ["s"], "seq", "d", "at").collect()) == [0, 5, 12]
    payloads = spark.createDataFrame([('{"eventKind":"","type":"t","detail":{"text":"x","itemId":""},"itemId":"i"}',), ("broken",), ('{"detail":"no"}',)], "p string")
    assert [(r.kind, r.text, r.item_id) for r in turn_events(payloads, "p").collect()] == [("t", "x", "i"), ("", None, None), ("", None, None)]


@pytest.mark.parametrize("size", ["0.001", "0.01"])
def test_every_query_with_sql_agrees_with_it(spark, size):
    duckdb = pytest.importorskip("duckdb")
    from turnloom.plans import catalog

    sf = Path(f"/root/testdata/sf{size}")
    if not sf.exists():
        pytest.skip("no test tables")
    con = duckdb.connect()
    for f in sf.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")

    def plain(v):
        if isinstance(v, list | tuple):
            return tuple(map(plain, v))
        return v if isinstance(v, str | bool | None) else round(float(v), 5)

    for name, plan in catalog.QUERIES.items():
        if size != "0.001" and name not in catalog.ORACLE_SQL:
            continue
        df = plan(spark, str(sf))
        cols = sorted(df.columns)
        rows = df.collect()
        if name in catalog.ORACLE_SQL:
            r = con.execute(catalog.ORACLE_SQL[name])
            names = [d[0] for d in r.description]
            assert sorted(names) == cols, name
            want = sorted(repr(tuple(plain(x[names.index(c)]) for c in cols)) for x in r.fetchall())
            assert sorted(repr(tuple(plain(x[c]) for c in cols)) for x in rows) == want, name


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(3).count() == 3
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_works_without_the_corpus_folder(tmp_path):
    """Without turnloom/llm and corpus_pipeline.py the other queries are still there."""
    import shutil

    root = Path(__file__).parents[1]
    shutil.copytree(root / "turnloom", tmp_path / "turnloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'turn_handoff' in q and 'pipeline' not in q; print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr


def test_pitch_in_blocks_without_quiet_frames(monkeypatch):
    """Frames are transformed a few at a time, quiet ones not at all, and peaks are found in one pass; each gives what the plain way gives."""
    y = np.concatenate([tone(180, 1), np.zeros(12000), tone(260, 1.2)])
    widths, plain = [], np.fft.rfft
    monkeypatch.setattr(audio.np.fft, "rfft", lambda x, *a, **k: widths.append(len(x)) or plain(x, *a, **k))
    whole = audio._pitch(y, 60.0, 600.0)
    assert max(widths) <= audio.BLOCK and sum(widths) < len(whole)
    assert (whole > 0).sum() > 150 and not whole[len(whole) // 2 - 10]
    monkeypatch.setattr(audio, "BLOCK", 5)
    assert np.allclose(audio._pitch(y, 60.0, 600.0), whole, rtol=1e-12)

    db = np.random.default_rng(4).integers(-12, 0, 300).astype(float)

    def dip(i):
        left, right = (next((k for k in side if db[k] > db[i]), None) for side in (range(i, -1, -1), range(i, len(db))))
        return db[i] - max(db[(left + 1 if left is not None else 0) : i + 1].min(), db[i : right if right is not None else len(db)].min())

    assert audio.peaks(db) == [i for i in range(1, len(db) - 1) if db[i - 1] < db[i] >= db[i + 1] and dip(i) >= audio.DIP_DB]

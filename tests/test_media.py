"""Frames and sound: one stream for both branches against the batch forms, and resampling from chunk to chunk."""

import json
import os
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnloom.functions import audio
from turnloom.operators import pairing, windows
from turnloom.plans import turn_queries as q
from turnloom.sources.lanes import audio_clock, event_lanes
from turnloom.streaming.live import fan_out
from turnloom.streaming.media import live_media
from test_turns import SF, YEAR_US

ROW = "session_id string, seq long, at long, lane string, t_us long, dur_us long"
DAY_US = 86_400_000_000  # Turns begin a day after time 0, at which the first batch's watermark stands.


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_one_stream_feeds_all_frames_sampled_ones_and_the_clock(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    lanes = event_lanes(spark, SF).where("lane in ('frame', 'audio')").cache()
    frames = lanes.where("lane = 'frame'")
    want = {(str(r.session_id), r.t_us) for r in windows.rate_limited(frames.select("session_id", "t_us"), q.RATE_US).collect()}
    clock = audio_clock(lanes.where("lane = 'audio'").withColumn("o", F.struct("t_us", "seq")), ["session_id"], "o", "cents", "begins")
    begins = {(str(r.session_id), r.seq): r.begins for r in clock.collect()}
    rows = [{"session_id": str(r.session_id), "seq": r.seq, "at": r.t_us + DAY_US, "lane": r.lane, "t_us": r.t_us, "dur_us": r.cents} for r in lanes.orderBy("t_us", "session_id", "seq").collect()]
    dense, sampled = str(tmp_path / "dense"), str(tmp_path / "sampled")
    write_dense, write_sampled, fails = pairing.json_lines_by_batch(dense), pairing.json_lines_by_batch(sampled), [True]

    def to_dense(batch, batch_id):
        write_dense(batch.drop("sampled"), batch_id)

    def to_sampled(batch, batch_id):
        if batch_id == 1 and fails:
            fails.clear()
            raise OSError("no room")
        write_sampled(batch.where("sampled"), batch_id)

    (tmp_path / "in").mkdir()
    for part in range(4):
        chunk = [r for i, r in enumerate(rows) if i * 4 // len(rows) == part]
        (tmp_path / "in" / f"{part}.json").write_text("".join(json.dumps(r) + "\n" for r in chunk))
        os.utime(tmp_path / "in" / f"{part}.json", (1_000_000 + part, 1_000_000 + part))

    def start():
        told = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")).withColumn("at", F.timestamp_micros("at"))
        media = live_media(told, q.RATE_US, delay="1 day", life_us=YEAR_US)
        return media.writeStream.foreachBatch(fan_out(to_dense, to_sampled)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()

    # The sampled branch fails in the second batch, after the dense one has had it; both have every row once after the next start.
    with pytest.raises(Exception, match="no room"):
        start().awaitTermination(120)
    start().awaitTermination(120)
    read = lambda path: spark.read.schema("session_id string, seq long, lane string, t_us long, sampled boolean").json(path + "/*").collect()
    assert sorted((r.session_id, r.seq) for r in read(dense)) == sorted((r["session_id"], r["seq"]) for r in rows)
    assert {(r.session_id, r.seq): r.t_us for r in read(dense) if r.lane == "audio"} == begins
    kept = [(r.session_id, r.t_us) for r in read(sampled)]
    assert set(kept) == want and len(kept) == len(want) < frames.count()


@pytest.mark.parametrize("rate", [48_000, 44_100, 8_000])
def test_chunks_are_resampled_as_the_whole(rate):
    y = np.random.default_rng(1).normal(0, 0.2, 20_011)
    whole, parts, r = audio.resampled(y, rate), [], audio.Resampler(rate)
    bounds = [0, 1, 2, 31, 480, 481, 5_000, 20_011]
    for a, b in zip(bounds, bounds[1:]):
        parts.append(r.take(y[a:b], last=b == len(y)))
        assert len(r.held) <= 2 * r.HALF + 2 or b == len(y)
    assert np.allclose(np.concatenate(parts), whole, atol=1e-12) and len(whole) == len(y) * audio.RATE // rate


def test_tracks_pass_chunk_by_chunk(spark):
    t = np.arange(48_000) / 48_000
    sound = (np.sin(2 * np.pi * 440 * t) * 16_000).astype("<i2").tobytes()
    cuts = [0, 3, 1_001, 40_000, 40_000, len(sound)]
    rows = [(s, "mic", i, 48_000, bytearray(sound[a:b])) for s in ("a", "b") for i, (a, b) in enumerate(zip(cuts, cuts[1:]))] + [("c", None, 0, 8_000, None), ("b", "other", 0, 16_000, bytearray(b"\1\2\3"))]
    df = spark.createDataFrame(rows, "session_id string, track string, seq long, rate int, pcm binary").repartition(3)
    told = {(r.session_id, r.track, r.seq): bytes(r.pcm) for r in audio.resample_chunks(df).collect()}
    assert sorted(map(str, told)) == sorted(str((r[0], r[1], r[2])) for r in rows)
    whole = (np.clip(audio.resampled(audio.samples(sound), 48_000), -1, 32767 / 32768) * 32768).round().astype("<i2").tobytes()
    assert all(b"".join(told[s, "mic", i] for i in range(5)) == whole for s in ("a", "b"))
    assert told["c", None, 0] == b"" and told["b", "other", 0] == b"\1\2"
    one = {(r.session_id, r.track): bytes(r.pcm) for r in audio.resample_tracks(df).collect()}
    assert one["a", "mic"] == whole and len(one) == 4
    assert audio.resample_chunks(df.limit(0)).count() == 0

"""Frames and sound of live turns from one stream: every frame, those a throttle keeps, and chunks on the clock of their own length."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from turnloom.streaming.turns import LIFE_US

MEDIA = "session_id string, seq long, lane string, t_us long, sampled boolean"


class Media(StatefulProcessor):
    """When the throttle last kept a frame, and how much sound there has been: two numbers a turn."""

    def __init__(self, interval_us: int, tolerance_us: int, life_us: int):
        self.closed_us, self.life_us = interval_us - tolerance_us, life_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turn = handle.getValueState("turn", "kept_us long, clock_us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        told, out = pd.concat(rows).sort_values(["t_us", "seq"], kind="stable"), []
        if self.turn.exists():
            kept, clock = self.turn.get()
        else:
            kept, clock = None, 0
            self.handle.registerTimer((int(told["at_us"].min()) + self.life_us) // 1000)
        for row in told.itertuples():
            if row.lane == "audio":
                out.append((key[0], row.seq, row.lane, clock, False))
                clock += int(row.dur_us)
            elif row.lane == "frame":
                keeps = kept is None or row.t_us - kept >= max(self.closed_us, 1)
                kept = int(row.t_us) if keeps else kept
                out.append((key[0], row.seq, row.lane, int(row.t_us), keeps))
        self.turn.update((kept, clock))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in MEDIA.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.turn.clear()
        return iter(())

    def close(self) -> None:
        pass


def live_media(rows: DataFrame, interval_us: int, tolerance_us: int = 1, delay: str = "10 seconds", life_us: int = LIFE_US) -> DataFrame:
    """MEDIA of a stream (session_id, seq, at, lane, t_us, dur_us): every frame, and whether windows.rate_limited keeps it; every chunk of sound
    with the time at which lanes.audio_clock has it begin. Other lanes drop out.

    The dense branch is all frames, the sampled one those with sampled: both come of one read, so streaming.live.fan_out can give each its sink.
    at is the time of arrival; each session's rows must come in the order of (t_us, seq). A null dur_us counts as 0. A turn's state goes
    life_us after its first row. Needs the RocksDB state store.
    """
    told = rows.where("t_us is not null").withWatermark("at", delay).select(
        F.col("session_id").cast("string").alias("session_id"), F.col("seq").cast("long").alias("seq"), "at", F.unix_micros("at").alias("at_us"), "lane",
        F.col("t_us").cast("long").alias("t_us"), F.coalesce(F.col("dur_us").cast("long"), F.lit(0)).alias("dur_us"),
    )
    return told.groupBy("session_id").transformWithStateInPandas(Media(interval_us, tolerance_us, life_us), MEDIA, "Append", "EventTime")

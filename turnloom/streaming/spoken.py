"""Spoken turns as a chain of stateful steps in one query: events to sentences, with timeouts by timers, and sentences to windows for evaluation.

Event time is handed from step to step, so each knows how far the one before it has come. Needs the RocksDB state store.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from math import floor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from turnloom.operators.sentences import SENTENCE, TIMEOUT_S, Event, Heard, event_of, hear
from turnloom.streaming.turns import LIFE_US

TOLD = f"session_id string, number long, at timestamp, {SENTENCE}"
WINDOW = "session_id string, at timestamp, start_us long, end_us long"


def due_poll(heard: Heard, last_s: float, poll_s: float, timeout_s: float) -> float | None:
    """The first poll, a multiple of poll_s, that ends an utterance by its length: none while no text is pending."""
    if not heard.items:
        return None
    k = max(floor((heard.start + timeout_s) / poll_s), floor(last_s / poll_s))
    while k * poll_s < last_s or k * poll_s - heard.start <= timeout_s:
        k += 1
    return k * poll_s


def _frame(rows: list[tuple], columns: str) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in columns.split(", ")])
    return frame.assign(at=pd.to_datetime(frame["at"], unit="us"))


class TimedSentences(StatefulProcessor):
    """What a turn has heard, and a timer for the poll that would end its utterance; polls come after the events up to their time."""

    def __init__(self, poll_s: float, timeout_s: float, life_us: int):
        self.poll_s, self.timeout_s, self.life_us = poll_s, timeout_s, life_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.heard = handle.getValueState("heard", "began_us long, life_ms long, last_s double, number long, told string")

    def _ms(self, began_us: int, at_s: float) -> int:
        return -(-(began_us + round(at_s * 1_000_000)) // 1000)

    def _poll(self, key, turn: dict, upto_s: float | None) -> list[tuple]:
        """The sentences that polls before upto_s end; with no bound, what the one due now ends."""
        due = due_poll(turn["heard"], turn["last_s"], self.poll_s, self.timeout_s)
        if due is None or (upto_s is not None and due >= upto_s):
            return []
        return self._told(key, turn, Event("tick", due, due, None, None))

    def _told(self, key, turn: dict, event: Event) -> list[tuple]:
        turn["heard"], given = hear(turn["heard"], event, self.timeout_s)
        turn["last_s"] = event.now
        turn["number"] += bool(given)
        return [(key[0], turn["number"], turn["began_us"] + round(event.now * 1_000_000), *s) for s in given]

    def _keep(self, turn: dict) -> None:
        due = due_poll(turn["heard"], turn["last_s"], self.poll_s, self.timeout_s)
        if due is not None:
            self.handle.registerTimer(self._ms(turn["began_us"], due))
        self.heard.update((turn["began_us"], turn["life_ms"], turn["last_s"], turn["number"], json.dumps(turn["heard"])))

    def _turn(self) -> dict | None:
        if not self.heard.exists():
            return None
        began, life, last, number, told = self.heard.get()
        start, stopped, items = json.loads(told)
        return {"began_us": began, "life_ms": life, "last_s": last, "number": number, "heard": Heard(start, stopped, tuple(map(tuple, items)))}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        turn, out = self._turn(), []
        for row in pd.concat(rows).sort_values("seq", kind="stable").itertuples():
            if turn is None:
                turn = {"began_us": int(row.at_us) - round(row.media_now * 1_000_000), "life_ms": (int(row.at_us) + self.life_us) // 1000, "last_s": 0.0, "number": 0, "heard": Heard()}
                self.handle.registerTimer(turn["life_ms"])
            event = event_of(row)
            out += self._poll(key, turn, event.now)
            out += self._told(key, turn, event)
            if event.kind == "turn_end":
                turn["heard"] = Heard()
        self._keep(turn)
        if out:
            yield _frame(out, TOLD)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        turn, now = self._turn(), expiredTimerInfo.getExpiryTimeInMs()
        if turn is None:
            return
        if now == turn["life_ms"]:
            self.heard.clear()
            return
        due = due_poll(turn["heard"], turn["last_s"], self.poll_s, self.timeout_s)
        out = self._poll(key, turn, None) if due is not None and self._ms(turn["began_us"], due) <= now else []
        if out or due is not None:
            self._keep(turn)
        if out:
            yield _frame(out, TOLD)

    def close(self) -> None:
        pass


def timed_sentences(events: DataFrame, poll_s: float = 2.0, timeout_s: float = TIMEOUT_S, delay: str = "10 seconds", life_us: int = LIFE_US) -> DataFrame:
    """session_id, number, at and the sentences of a stream of events (session_id, seq, at, media_now, kind, item_id, text), without rows for polls.

    They are those that sentences.fold_sentences gives if a `tick` follows the events up to each multiple of poll_s. at is the time of an
    event; number counts a turn's events that gave sentences. Each session's events must come in the order of seq, which is that of media_now.
    A turn's state goes life_us after its first event. A column near may hold media_now at the pause it is snapped to.
    """
    near = F.col("near" if "near" in events.columns else "media_now").alias("near")
    told = events.withWatermark("at", delay).select(F.col("session_id").cast("string").alias("session_id"), "seq", "at", F.unix_micros("at").alias("at_us"), F.col("media_now").cast("double").alias("media_now"), near, "kind", "item_id", "text")
    return told.groupBy("session_id").transformWithStateInPandas(TimedSentences(poll_s, timeout_s, life_us), TOLD, "Append", "EventTime", None, "at")


class SentenceWindows(StatefulProcessor):
    """How many sentences are pending since the anchor, and where it is."""

    def __init__(self, most: int, span_us: int, life_us: int):
        self.most, self.span_us, self.life_us = most, span_us, life_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", "anchor_us long, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        told, out = pd.concat(rows), []
        if self.pending.exists():
            anchor, pending = self.pending.get()
        else:
            anchor, pending = 0, 0
            self.handle.registerTimer((int(told["at_us"].min()) + self.life_us) // 1000)
        for _, batch in told[told["source"] != "flush"].groupby("number"):
            pending += len(batch)
            end = int(batch["end_us"].max())
            if end > anchor and (pending >= self.most or end - anchor >= self.span_us):
                out.append((key[0], int(batch["at_us"].max()), anchor, end))
                anchor, pending = end, 0
        self.pending.update((anchor, pending))
        if out:
            yield _frame(out, WINDOW)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.pending.clear()
        return iter(())

    def close(self) -> None:
        pass


def timed_windows(sentences: DataFrame, most: int, span_us: int, life_us: int = LIFE_US) -> DataFrame:
    """session_id, at, start_us, end_us: the windows for evaluation that timed_sentences close, as sentences.sentence_windows gives them."""
    us = F.round(F.col("end_s") * 1_000_000).cast("long").alias("end_us")
    told = sentences.select("session_id", "number", "at", F.unix_micros("at").alias("at_us"), us, "source")
    return told.groupBy("session_id").transformWithStateInPandas(SentenceWindows(most, span_us, life_us), WINDOW, "Append", "EventTime", None, "at")

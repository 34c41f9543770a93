"""Live turns with timers: windows looked at again when their rows come late, and a turn's records as its signals come in.

Both keep time by the watermark of the column at, so what they give doesn't depend on how rows fall into batches, and needs no rows
that only tell the time. Both need the RocksDB state store. Where a stream goes on after a restart, state and timers are those of its checkpoint.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from turnloom.operators.turns import HALVES, RECORD, SIGNAL

LIFE_US = 6 * 3600 * 1_000_000


def _ms(us: int) -> int:
    """The first millisecond at or after a time, as timers count."""
    return -(-us // 1000)


class LateWindows(StatefulProcessor):
    """Arrivals by window until the window is looked at. Each time to look is a timer; so are the turn's end and the end of its state."""

    def __init__(self, width_us: int, step_us: int, catch_up: bool, life_us: int):
        self.width, self.step, self.catch_up, self.life = width_us, step_us, catch_up, life_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turn = handle.getValueState("turn", "began_us long, end_us long, life_ms long")
        self.arrived = handle.getMapState("arrived", "k long", "arrivals string")
        self.given = handle.getMapState("given", "k long", "at_us long")

    def _poll(self, us: int) -> int:
        return -(-us // self.step) * self.step

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        told = pd.concat(rows)
        if self.turn.exists():
            began, end, life = self.turn.get()
        else:
            began, end = int((told["at_us"] - told["arrival_us"]).iloc[0]), None
            life = _ms(int(told["at_us"].max()) + self.life)
            self.handle.registerTimer(life)
        for arrival in told.loc[told["ended"], "arrival_us"][:1] if end is None else ():
            end = int(arrival)
            self.handle.registerTimer(_ms(began + end))
        self.turn.update((began, end, life))
        looks = set()
        heard = told[~told["ended"] & told["t_us"].notna()]
        for k, arrivals in heard["arrival_us"].groupby(heard["t_us"].astype("int64") // self.width):
            k = (int(k),)
            if self.given.containsKey(k):
                continue
            before = json.loads(self.arrived.getValue(k)[0]) if self.arrived.containsKey(k) else []
            self.arrived.updateValue(k, (json.dumps(sorted([*before, *map(int, arrivals)])),))
            looks.add(self._poll(max(int(arrivals.min()), (k[0] + 1) * self.width)))
        for look in looks:
            self.handle.registerTimer(_ms(began + look))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if not self.turn.exists():
            return
        began, end, life = self.turn.get()
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000 - began
        ended = end is not None and now >= end
        out = []
        for k, (arrivals,) in [(k[0], v) for k, v in self.arrived.iterator()]:
            arrivals = json.loads(arrivals)
            over = (k + 1) * self.width
            due = self._poll(over)
            look = due if arrivals[0] <= due else self._poll(arrivals[0])
            if ended and look > end:
                # What no poll has found by then is looked at in the end, unless it was looked at by a poll before, in vain, without catching up.
                look = end if over <= end and arrivals[0] <= end and (due > end or self.catch_up) else None
            elif look > now:
                continue
            elif look > due and not self.catch_up:
                look = None
            if look is not None:
                out.append((key[0], k, look, sum(a <= look for a in arrivals)))
            self.arrived.removeKey((k,))
            self.given.updateValue((k,), (look if look is not None else due,))
        if expiredTimerInfo.getExpiryTimeInMs() == life:
            for state in (self.turn, self.arrived, self.given):
                state.clear()
        if out:
            yield pd.DataFrame(out, columns=["session_id", "k", "at_us", "n"])

    def close(self) -> None:
        pass


def live_late(rows: DataFrame, width_us: int, step_us: int, catch_up: bool, delay: str = "10 seconds", life_us: int = LIFE_US) -> DataFrame:
    """session_id, k, at_us, n as windows.late_replay gives them, of a stream (session_id, at, arrival_us, t_us, ended).

    at is the time of arrival, arrival_us the same since the turn began; the row that says a turn has ended arrives at its end. A window is
    told once the watermark, delay behind the latest arrival, has passed the poll that finds it. A turn's state goes life_us after it was first heard of.
    """
    told = rows.withWatermark("at", delay).select(
        F.col("session_id").cast("string").alias("session_id"), "at", F.unix_micros("at").alias("at_us"), F.col("arrival_us").cast("long").alias("arrival_us"),
        F.col("t_us").cast("long").alias("t_us"), F.coalesce("ended", F.lit(False)).alias("ended"),
    )
    return told.groupBy("session_id").transformWithStateInPandas(LateWindows(width_us, step_us, catch_up, life_us), "session_id string, k long, at_us long, n long", "Append", "EventTime")


#: What is known of a turn: when it ended and how long it is, whether it is closed, how many results it owes, its tail, and when its state goes.
NEW = {"ended": None, "end_us": None, "closed": False, "owed": 0, "tail": None, "eval": None, "life": None}


class TurnRecords(StatefulProcessor):
    """A window's halves in a map by its start, evaluations in another, and the turn itself as one small value."""

    def __init__(self, deadline_us: int, least_us: int, life_us: int):
        self.deadline, self.least, self.life = deadline_us, least_us, life_us
        self.names = ["session_id", *(c.split()[0] for c in RECORD.split(", "))]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turn = handle.getValueState("turn", "told string")
        self.windows = handle.getMapState("windows", "start_us long", "told string")
        self.ahead = handle.getMapState("ahead", "start_us long", "ends string")

    def _record(self, key, kind: str, at: int, **told) -> dict:
        return {**dict.fromkeys(self.names), "session_id": key[0], "type": kind, "at_us": at, **told}

    def _frame(self, out: list[dict]) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=self.names)
        return frame.astype({"at_us": "Int64", "start_us": "Int64", "window_us": "Int64", "intensity": "Float64", "heard": "boolean", "n": "Int64"})

    def _window(self, start: int) -> dict:
        there = self.windows.containsKey((start,))
        return json.loads(self.windows.getValue((start,))[0]) if there else {"owed": [], "came": [], "half": {}}

    def _of_halves(self, key, at: int, start: int, half: dict) -> dict:
        a, b = half.get("nonverbal"), half.get("transcript")
        told = {"state": a and a["state"], "intensity": a and a["intensity"], "text": b["text"] if b else "", "heard": b is not None}
        return self._record(key, "window", at, start_us=start, window_us=next((h["window"] for h in (a, b) if h and h["window"] is not None), None), **told)

    def _close(self, key, turn: dict, at: int) -> list[dict]:
        """Halves left alone, by time, and the turn's end."""
        windows = sorted((k[0], json.loads(v[0])) for k, v in self.windows.iterator())
        out = [self._of_halves(key, at, start, w["half"]) for start, w in windows if len(w["half"]) == 1]
        said = " ".join(w["half"]["transcript"]["text"] for _, w in windows if (w["half"].get("transcript") or {"text": ""})["text"].strip(" "))
        turn["closed"] = True
        return [*out, self._record(key, "turn_end", at, start_us=turn["end_us"], text=said, eval=turn["eval"], n=turn["owed"])]

    def _evaluated(self, start: int, end: int) -> None:
        before = json.loads(self.ahead.getValue((start,))[0]) if self.ahead.containsKey((start,)) else []
        self.ahead.updateValue((start,), (json.dumps(sorted([*before, end])),))

    def _covered(self) -> int:
        """As windows.covered_prefix counts: in order of start and end, each begins where the one before it ends."""
        at = 0
        for start, end in sorted((k[0], end) for k, v in self.ahead.iterator() for end in json.loads(v[0])):
            if start != at:
                break
            at = end
        return at

    def _result(self, key, turn: dict, row) -> list[dict]:
        window = self._window(int(row.start_us))
        if turn["closed"] or row.kind in window["came"]:
            return [self._record(key, "dropped", int(row.at_us), n=1)]
        window["came"].append(row.kind)
        turn["owed"] -= row.kind in window["owed"]
        out = []
        if row.ok:
            text = row.text if isinstance(row.text, str) else ""
            whole = lambda x: None if pd.isna(x) else x
            window["half"][row.kind] = {"window": None if pd.isna(row.window_us) else int(row.window_us), "state": whole(row.state), "intensity": whole(row.intensity), "text": text}
            if len(window["half"]) == 2:
                out = [self._of_halves(key, int(row.at_us), int(row.start_us), window["half"])]
        self.windows.updateValue((int(row.start_us),), (json.dumps(window),))
        return out

    def _ended(self, key, turn: dict, row) -> list[dict]:
        turn["ended"], turn["end_us"] = int(row.at_us), int(row.start_us)
        covered = self._covered()
        left = turn["end_us"] - covered
        if not (left > 0 and (covered == 0 or left > self.least)):
            return []
        turn["owed"] += 1
        turn["tail"] = "due"
        return [self._record(key, "tail", int(row.at_us), start_us=covered, window_us=left)]

    def _hear(self, key, turn: dict, row) -> list[dict]:
        if row.kind == "submitted" and row.lane in HALVES and turn["ended"] is None:
            window = self._window(int(row.start_us))
            if row.lane not in window["owed"]:
                window["owed"].append(row.lane)
                turn["owed"] += row.lane not in window["came"]
                self.windows.updateValue((int(row.start_us),), (json.dumps(window),))
        elif row.kind in HALVES:
            return self._result(key, turn, row)
        elif row.kind == "eval" and row.ok:
            if turn["ended"] is None:
                self._evaluated(int(row.start_us), int(row.start_us + row.window_us))
            return [self._record(key, "eval", int(row.at_us), start_us=int(row.start_us), window_us=int(row.window_us), text=row.text if isinstance(row.text, str) else None)]
        elif row.kind == "tail":
            if turn["closed"] or turn["tail"] != "due":
                return [self._record(key, "dropped", int(row.at_us), n=1)]
            turn["tail"], turn["owed"] = "come", turn["owed"] - 1
            turn["eval"] = row.text if row.ok and isinstance(row.text, str) else None
        elif row.kind == "ended" and turn["ended"] is None:
            return self._ended(key, turn, row)
        return []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        turn, out = json.loads(self.turn.get()[0]) if self.turn.exists() else dict(NEW), []
        waits = turn["ended"] is not None and not turn["closed"]
        for row in pd.concat(rows).sort_values(["at_us", "seq"], kind="stable").itertuples():
            if turn["life"] is None:
                turn["life"] = _ms(int(row.at_us) + self.life)
                self.handle.registerTimer(turn["life"])
            if turn["ended"] is not None and not turn["closed"] and row.at_us > turn["ended"] + self.deadline:
                out += self._close(key, turn, turn["ended"] + self.deadline)
            out += self._hear(key, turn, row)
            if turn["ended"] is not None and not turn["closed"] and turn["owed"] == 0:
                out += self._close(key, turn, int(row.at_us))
        if turn["ended"] is not None and not turn["closed"] and not waits:
            self.handle.registerTimer(_ms(turn["ended"] + self.deadline))
        self.turn.update((json.dumps(turn),))
        if out:
            yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if not self.turn.exists():
            return
        turn, out, now = json.loads(self.turn.get()[0]), [], expiredTimerInfo.getExpiryTimeInMs()
        if turn["ended"] is not None and not turn["closed"] and now >= _ms(turn["ended"] + self.deadline):
            out = self._close(key, turn, turn["ended"] + self.deadline)
            self.turn.update((json.dumps(turn),))
        if now == turn["life"]:
            halves = sum(len(json.loads(v[0])["half"]) == 1 for v in self.windows.values())
            if halves and not turn["closed"]:
                out.append(self._record(key, "dropped", now * 1000, n=halves))
            for state in (self.turn, self.windows, self.ahead):
                state.clear()
        if out:
            yield self._frame(out)

    def close(self) -> None:
        pass


def live_turns(signals: DataFrame, deadline_us: int = 3_000_000, least_us: int = 1_000_000, delay: str = "10 seconds", life_us: int = LIFE_US) -> DataFrame:
    """The records that operators.turns.turn_records gives, of a stream of its signals with at, a timestamp, in place of at_us.

    A window is told when its second half comes. A turn that has ended closes with the last result it owes or, by a timer, at the deadline:
    then come the halves left alone, by time, and the turn's end. Results after that, or told again, are told as dropped, each by itself, and so are the halves
    of a turn without an end, when its state goes life_us after its first signal. Each session's signals must come in the order of (at, seq).
    """
    names = [c.split()[0] for c in SIGNAL.split(", ")]
    at = {"at_us": F.unix_micros("at"), "ok": F.coalesce("ok", F.lit(True)), "session_id": F.col("session_id").cast("string")}
    told = signals.withWatermark("at", delay).select("at", *(at.get(c, F.col(c)).alias(c) for c in names))
    return told.groupBy("session_id").transformWithStateInPandas(TurnRecords(deadline_us, least_us, life_us), f"session_id string, {RECORD}", "Append", "EventTime")


def with_drops_observed(records: DataFrame, name: str = "turns") -> DataFrame:
    """records with counts of dropped results and of results owed at a turn's end, as observed metrics of each batch."""
    n = lambda kind: F.coalesce(F.sum(F.when(F.col("type") == kind, F.col("n"))), F.lit(0))
    return records.observe(name, n("dropped").alias("dropped"), n("turn_end").alias("stragglers"))

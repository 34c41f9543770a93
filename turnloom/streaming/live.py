"""Live turns: the sentence fold and window counts as stateful streams, and sinks that don't stop one another."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from turnloom.operators.sentences import SENTENCE, TIMEOUT_S, Heard, event_of, hear


class SentenceProcessor(StatefulProcessor):
    """Keeps what a session has heard between batches; a turn's end gives up its state."""

    def __init__(self, timeout_s: float = TIMEOUT_S):
        self.timeout_s = timeout_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.heard = handle.getValueState("heard", "state string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        start, stopped, items = json.loads(self.heard.get()[0]) if self.heard.exists() else Heard()
        heard, out = Heard(start, stopped, tuple(map(tuple, items))), []
        for row in pd.concat(rows).sort_values("seq", kind="stable").itertuples():
            heard, given = hear(heard, event_of(row), self.timeout_s)
            out += [(key[0], *s) for s in given]
            if row.kind == "turn_end":
                heard = Heard()
        if heard == Heard():
            self.heard.clear()
        else:
            self.heard.update((json.dumps(heard),))
        if out:
            yield pd.DataFrame(out, columns=["session_id", *(c.split()[0] for c in SENTENCE.split(", "))])

    def close(self) -> None:
        pass


def live_sentences(events: DataFrame, timeout_s: float = TIMEOUT_S) -> DataFrame:
    """The sentences of a stream of events (session_id, seq, media_now, kind, item_id, text), as sentences.fold_sentences gives them.

    A column near, if there is one, holds media_now at the pause it is snapped to. Needs the RocksDB state store; each session's
    rows must arrive in the order of seq.
    """
    near = F.col("near" if "near" in events.columns else "media_now").alias("near")
    rows = events.select("session_id", "seq", "media_now", near, "kind", "item_id", "text")
    return rows.groupBy("session_id").transformWithStateInPandas(SentenceProcessor(timeout_s), f"session_id string, {SENTENCE}", "Append", "None")


class WindowProcessor(StatefulProcessor):
    """Counts the rows of a turn by window, and gives up a window when its time is over: when a row lateness_us later has come, or the turn's end."""

    def __init__(self, width_us: int, lateness_us: int):
        self.width_us, self.lateness_us = width_us, lateness_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "state string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        counts, seen, given = json.loads(self.open.get()[0]) if self.open.exists() else ({}, -1, -1)
        ended = False
        for batch in rows:
            ended |= bool(batch["ended"].any())
            at = batch.loc[batch["t_us"].notna() & ~batch["ended"], "t_us"].astype("int64")
            for k, n in (at // self.width_us).value_counts().items():
                if k > given:
                    counts[str(k)] = counts.get(str(k), 0) + int(n)
            seen = max(seen, int(at.max()) if len(at) else -1)
        over = [int(k) for k in counts if ended or (int(k) + 1) * self.width_us + self.lateness_us <= seen]
        out = sorted((k, counts.pop(str(k))) for k in over)
        given = max([given, *over])
        if ended:
            self.open.clear()
        else:
            self.open.update((json.dumps((counts, seen, given)),))
        if out:
            yield pd.DataFrame([(key[0], k, n) for k, n in out], columns=["session_id", "k", "n"])

    def close(self) -> None:
        pass


def live_windows(rows: DataFrame, width_us: int, lateness_us: int = 0) -> DataFrame:
    """session_id, k, n: the rows of a stream (session_id, t_us, ended) in each window of a turn, once, when the window is over.

    A window is over when a row has come that lies lateness_us or more after its end, or the row that says the turn has ended; later rows
    of it are left out. A turn's state is the counts of its open windows; its end clears it. Needs the RocksDB state store.
    """
    told = rows.select(F.col("session_id").cast("string").alias("session_id"), F.col("t_us").cast("long").alias("t_us"), F.coalesce("ended", F.lit(False)).alias("ended"))
    return told.groupBy("session_id").transformWithStateInPandas(WindowProcessor(width_us, lateness_us), "session_id string, k long, n long", "Append", "None")


class SinkFailure(RuntimeError):
    """Names the sinks that failed for a batch, after all have had it."""


def fan_out(*sinks: Callable[[DataFrame, int], None], dead_letter: Callable[[DataFrame, int, str], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that gives each batch to every sink, whichever of them fail.

    What a sink failed to take goes to dead_letter with the sink's name. Without one, SinkFailure is raised once all sinks have had
    the batch, so that the query stops and the batch comes again: then sinks must tell a repeated batch_id.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        failed = []
        for sink in sinks:
            name = getattr(sink, "__name__", str(sink))
            try:
                sink(batch, batch_id)
            except Exception as error:  # noqa: BLE001
                failed.append(f"{name}: {error}")
                if dead_letter:
                    dead_letter(batch, batch_id, name)
        batch.unpersist()
        if failed and not dead_letter:
            raise SinkFailure(f"batch {batch_id}: {len(failed)} of {len(sinks)} sinks failed: {'; '.join(failed)}")

    return each

"""Model calls on windows: any function of a row, run by Spark, with failures as values.

A critic takes a dict of a window's columns and returns a dict of results. It is made once in each task, by a factory, so
clients and models load there. A window whose call fails keeps its row with the error and null results; other windows aren't
touched. A retried task calls again: `call_key`, a hash of the key columns, is the same then, so that a service can tell.
"""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import Future
from threading import Thread

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

Critic = Callable[[dict], dict]

#: So many calls past their deadline may still run beside a task; with more of them the task fails, and Spark tries it elsewhere.
MOST_LOST = 64


def with_tries(critic: Critic, tries: int, pause_s: float = 0.0) -> Critic:
    """critic's result, called again after failures, so many times in all; `tries` tells how many it took.

    The row it sees holds `call_try`, from 1. Pauses double from call to call. The last failure is the one that is raised.
    """

    def tried(row: dict) -> dict:
        for n in range(1, tries):
            try:
                return {"tries": n} | critic({**row, "call_try": n})
            except Exception:  # noqa: BLE001
                time.sleep(pause_s * 2 ** (n - 1))
        return {"tries": tries} | critic({**row, "call_try": tries})

    return tried


def with_fallback(primary: Critic, fallback: Critic) -> Critic:
    """primary's result, or where it fails fallback's; `engine` names the one that answered."""

    def either(row: dict) -> dict:
        try:
            return {"engine": "primary"} | primary(row)
        except Exception:  # noqa: BLE001
            return {"engine": "fallback"} | fallback(row)

    return either


def _started(critic: Critic, row: dict) -> tuple[Future, float]:
    """A call under way in its own thread, and when it began."""
    answer: Future = Future()

    def call():
        try:
            answer.set_result(critic(row))
        except BaseException as failure:  # noqa: BLE001
            answer.set_exception(failure)

    Thread(target=call, daemon=True).start()
    return answer, time.monotonic()


def in_order(critic: Critic, rows: Iterable[dict], in_flight: int, deadline_s: float | None = None) -> Iterator[tuple[dict | None, str | None]]:
    """(result, None) or (None, error) for each row in the order of rows, with at most in_flight calls waited for at once.

    A call that isn't back deadline_s after it began is an error; its thread can't be stopped and isn't waited for.
    """
    waiting: deque[tuple[Future, float]] = deque()
    lost: list[Future] = []

    def answer() -> tuple[dict | None, str | None]:
        call, begun = waiting.popleft()
        try:
            return call.result(None if deadline_s is None else max(0.0, begun + deadline_s - time.monotonic())), None
        except Exception as failure:  # noqa: BLE001
            if call.done():
                return None, f"{type(failure).__name__}: {failure}"
        lost[:] = [c for c in lost if not c.done()] + [call]
        if len(lost) > MOST_LOST:
            raise RuntimeError(f"{len(lost)} calls are past their deadline of {deadline_s} s and still run")
        return None, f"DeadlineExceeded: {deadline_s} s"

    for row in rows:
        if len(waiting) >= in_flight:
            yield answer()
        waiting.append(_started(critic, row))
    while waiting:
        yield answer()


def scored(windows: DataFrame, make_critic: Callable[[], Critic], results: str, keys: list[str] | None = None, in_flight: int = 1, deadline_s: float | None = None) -> DataFrame:
    """windows with call_key (of keys; all columns if not given), the columns of results (a DDL schema) and error (null if the call went well).

    Rows keep their order, a task's memory is that of an Arrow batch and its results. Columns of windows mustn't have these names.
    A result that isn't of its column's type is an error of its row.
    """
    added = T.StructType([*T.StructType.fromDDL(results).fields, T.StructField("error", T.StringType())])
    names = [f.name for f in added.fields]
    taken = {"call_key", *names} & {*windows.columns}
    if taken:
        raise ValueError(f"windows have columns of the results' names: {sorted(taken)}")
    asked = windows.withColumn("call_key", F.sha2(F.to_json(F.struct(*(keys or windows.columns)), {"ignoreNullFields": "false"}), 256))

    def score(batches):
        critic, schema = make_critic(), to_arrow_schema(added)
        forms = [schema.field(n).type for n in names[:-1]]

        def checked(row: dict) -> list:
            result = critic(row)
            return [pa.scalar(result.get(n), form).as_py() for n, form in zip(names, forms)]

        for batch in batches:
            told = [[*(result or [None] * len(forms)), error] for result, error in in_order(checked, batch.to_pylist(), in_flight, deadline_s)]
            columns = [pa.array([t[i] for t in told], schema.field(n).type) for i, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *names])

    return asked.mapInArrow(score, T.StructType([*asked.schema.fields, *added.fields]))


def gated(windows: DataFrame, needs_frames: bool, needs_sound: bool) -> DataFrame:
    """Windows (n_frames, n_audio) that have what a lane needs, so that no call is made for others."""
    ok = F.lit(True)
    if needs_frames:
        ok = ok & (F.col("n_frames") > 0)
    if needs_sound:
        ok = ok & (F.col("n_audio") > 0)
    return windows.where(ok)


def mock_reading(start_s: Column, width_s: Column) -> Column:
    """A reading that tells nothing but where its window lies, as a column, for plans that need no model."""
    return F.struct(F.lit("neutral").alias("state"), F.lit(0.5).alias("intensity"), F.format_string("window %.1f+%.1f", start_s, width_s).alias("note"))

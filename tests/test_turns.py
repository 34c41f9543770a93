"""Live turns against their batch forms: scripted streams in several batches, with a restart in between."""

import json
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from turnloom.operators import turns, windows
from turnloom.plans import turn_queries as q
from turnloom.sources.lanes import event_lanes, turn_ends
from turnloom.streaming.turns import live_late, live_turns, with_drops_observed

SF = "/root/testdata/sf0.001"
YEAR_US = 365 * 86_400_000_000
needs_tables = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def play(spark, tmp_path, rows, schema, plan, parts=5, stop=3, listen=None):
    """The output of plan over rows (dicts, with at in microseconds) that come in parts by time; the query stops after some and starts again."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    folder = tmp_path / "in"
    folder.mkdir()
    times = sorted({r["at"] for r in rows})
    bounds = [times[len(times) * i // parts] for i in range(1, parts)]
    chunks = [[r for r in rows if sum(r["at"] >= b for b in bounds) == part] for part in range(parts)]
    for files in (range(stop), range(stop, parts)):
        for part in files:
            (folder / f"{part}.json").write_text("".join(json.dumps(r) + "\n" for r in chunks[part]))
            os.utime(folder / f"{part}.json", (1_000_000 + part, 1_000_000 + part))
        told = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder)).withColumn("at", F.timestamp_micros("at"))
        query = plan(told).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination(300)
        assert query.exception() is None
        if listen:
            listen(query.recentProgress)
    return spark.read.parquet(str(tmp_path / "out")).collect()


def signals_of(rows):
    names = [c.split()[0] for c in turns.SIGNAL.split(", ")]
    return [{**{n: r.get(n) for n in names if n != "at_us"}, "at": r["at_us"]} for r in rows]


def told(records):
    """Records as sorted text, with all dropped ones of a turn as one count."""
    out, dropped = [], {}
    for r in records:
        if r.type == "dropped":
            dropped[str(r.session_id)] = dropped.get(str(r.session_id), 0) + r.n
        else:
            out.append((str(r.session_id), *(r[c.split()[0]] for c in turns.RECORD.split(", "))))
    return sorted(map(repr, out)), dropped


LIVE = turns.SIGNAL.replace("at_us long", "at long")


@needs_tables
def test_live_turns_tell_what_the_batch_form_tells(spark, tmp_path):
    signals = q.turn_signals(spark, SF).cache()
    want = told(turns.turn_records(signals, q.DEADLINE, q.SECOND_US).collect())
    rows = signals_of(sorted((r.asDict() for r in signals.collect()), key=lambda r: (r["at_us"], r["session_id"], r["seq"])))
    rows = [{**r, "session_id": str(r["session_id"])} for r in rows]
    rows.append({"session_id": "last", "seq": 0, "at": rows[-1]["at"] + 20 * q.DEADLINE, "kind": "other"})
    seen = []

    def listen(progress):
        seen.extend(p.observedMetrics["turns"] for p in progress if p.observedMetrics.get("turns"))

    got = told(play(spark, tmp_path, rows, LIVE, lambda s: with_drops_observed(live_turns(s, q.DEADLINE, q.SECOND_US, "1 second", YEAR_US)), listen=listen))
    assert got[0] == want[0] and got[1] == want[1]
    assert sum(m.dropped for m in seen) == sum(want[1].values()) > 0
    assert sum(m.stragglers for m in seen) > 0


@needs_tables
@pytest.mark.parametrize("catch_up", [True, False])
def test_live_late_windows_are_those_of_the_replay(spark, tmp_path, catch_up):
    lanes = event_lanes(spark, SF)
    ends = turn_ends(lanes)
    frames = lanes.where("lane = 'frame'").withColumn("arrival_us", F.expr(q.ARRIVAL))
    want = sorted((str(r.session_id), r.k, r.at_us, r.n) for r in windows.late_replay(frames, ends, q.W3, q.STEP, catch_up).collect())
    rows = [{"session_id": str(r.session_id), "at": r.arrival_us, "arrival_us": r.arrival_us, "t_us": r.t_us} for r in frames.collect()]
    rows += [{"session_id": str(r.session_id), "at": r.end_us, "arrival_us": r.end_us, "ended": True} for r in ends.collect()]
    rows.append({"session_id": "last", "at": max(r["at"] for r in rows) + 10 * q.STEP, "arrival_us": 0})
    got = play(spark, tmp_path, rows, "session_id string, at long, arrival_us long, t_us long, ended boolean", lambda s: live_late(s, q.W3, q.STEP, catch_up, "1 second", YEAR_US))
    assert sorted(map(tuple, got)) == want


def script():
    """Halves of windows at 0, 3 and 6, of which one never comes; an evaluation that leaves a tail; the tail comes after the deadline."""
    s = 1_000_000
    rows = []

    def tell(at, kind, start=None, **more):
        rows.append({"session_id": "a", "seq": len(rows), "at_us": int(at * s), "kind": kind, "start_us": None if start is None else start * s, "window_us": 3 * s, **more})

    for at, start in ((3, 0), (6, 3), (9, 6)):
        for lane in turns.HALVES:
            tell(at, "submitted", start, lane=lane)
    tell(9.1, "transcript", 6, text="three")
    tell(9.2, "nonverbal", 0, state="engaged", intensity=0.5)
    tell(9.3, "transcript", 0, text="one")
    tell(9.4, "transcript", 0, text="again")
    tell(9.5, "nonverbal", 3, ok=False)
    tell(9.6, "eval", 0, text="good")
    tell(10, "ended", 10)
    tell(10.5, "transcript", 3, text=" ")
    tell(13.5, "tail", text="late")
    return rows


def test_a_turn_waits_until_its_deadline(spark, tmp_path):
    s = 1_000_000
    rows = script()
    frame = spark.createDataFrame([tuple(r.get(c.split()[0]) for c in turns.SIGNAL.split(", ")) for r in rows], turns.SIGNAL)
    batch = turns.turn_records(frame).collect()
    kinds = {r.type: r for r in batch}
    # Owed at the deadline: the reading of the window at 6, and the tail. The failed reading at 3 is an answer.
    end = kinds["turn_end"]
    assert (end.at_us, end.start_us, end.text, end["eval"], end.n) == (13 * s, 10 * s, "one three", None, 2)
    assert (kinds["tail"].start_us, kinds["tail"].window_us, kinds["tail"].at_us) == (3 * s, 7 * s, 10 * s)
    assert sorted((r.at_us, r.start_us, r.state, r.text, r.heard) for r in batch if r.type == "window") == [
        (9_300_000, 0, "engaged", "one", True),
        (13 * s, 3 * s, None, " ", True),
        (13 * s, 6 * s, None, "three", True),
    ]
    assert kinds["dropped"].n == 2
    # The deadline is told by a timer: nothing but another turn's row comes after it.
    live = play(spark, tmp_path, [*signals_of(rows[:-1]), {"session_id": "b", "seq": 0, "at": 60 * s, "kind": "other"}], LIVE, lambda x: live_turns(x, delay="1 second"), parts=3, stop=2)
    want = told([r for r in batch if r.type != "dropped"])[0]
    assert told(live) == (want, {"a": 1})
    assert [r.type for r in live if r.at_us == 13 * s][-1] == "turn_end"


def test_a_turn_without_debts_closes_at_once_and_one_without_end_tells_its_halves(spark, tmp_path):
    s = 1_000_000
    names = [c.split()[0] for c in turns.SIGNAL.split(", ")]
    rows = [dict(zip(names, r)) for r in [
        ("a", 0, 3 * s, "submitted", "nonverbal", 0, 3 * s, True, None, None, None),
        ("a", 1, 4 * s, "nonverbal", None, 0, 3 * s, True, None, "nervous", 0.1),
        ("a", 2, 5 * s, "eval", None, 0, 16 * s, True, "all", None, None),
        ("a", 3, 16 * s, "ended", None, 16 * s, None, True, None, None, None),
        ("a", 4, 17 * s, "transcript", None, 0, 3 * s, True, "late", None, None),
        ("b", 0, 3 * s, "transcript", None, 0, 3 * s, True, "half", None, None),
        ("b", 1, 4 * s, None, None, None, None, None, None, None, None),
    ]]
    batch = turns.turn_records(spark.createDataFrame([tuple(r[n] for n in names) for r in rows], turns.SIGNAL)).collect()
    assert sorted((r.session_id, r.type, r.at_us, r.n) for r in batch) == [("a", "dropped", 17 * s, 1), ("a", "eval", 5 * s, None), ("a", "turn_end", 16 * s, 0), ("a", "window", 16 * s, None)]
    rows = sorted(signals_of(rows), key=lambda r: r["at"])
    live = play(spark, tmp_path, [*rows, {"session_id": "c", "seq": 0, "at": 500 * s, "kind": "other"}], LIVE, lambda x: live_turns(x, delay="1 second", life_us=100 * s), parts=2, stop=1)
    assert told(live) == (told(batch)[0], {"a": 1, "b": 1})
    assert turns.turn_records(spark.createDataFrame([], turns.SIGNAL)).count() == 0

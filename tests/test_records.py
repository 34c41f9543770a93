"""What lies between records and their readers: lines, lookups, streams of payloads, and the measured part of a prompt."""

import json

from pyspark.sql import functions as F

from turnloom.functions.replies import grounding
from turnloom.operators import pairing
from turnloom.sources.lanes import read_turn_event_stream, turn_events


def test_json_lines_are_appended_whole_with_their_nulls(spark, tmp_path):
    records = spark.createDataFrame([("window", "a", "한\nb", None), ("turn_end", "a", None, 2)], "type string, session_id string, text string, n int")
    for _ in range(2):
        pairing.write_json_lines(records, str(tmp_path / "lines"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "lines")).collect()]
    assert len(lines) == 4 and {"type": "window", "session_id": "a", "text": "한\nb", "n": None} in lines
    assert {"type": "turn_end", "session_id": "a", "text": None, "n": 2} in lines


def test_a_batch_that_comes_again_replaces_itself(spark, tmp_path):
    write = pairing.json_lines_by_batch(str(tmp_path / "out"))
    write(spark.createDataFrame([(1,), (2,)], "n int"), 0)
    write(spark.createDataFrame([(3,)], "n int"), 1)
    write(spark.createDataFrame([(1,), (2,)], "n int").repartition(2), 0)
    assert sorted(r.n for r in spark.read.json(str(tmp_path / "out")).collect()) == [1, 2, 3]


def test_the_latest_record_of_each_kind(spark):
    rows = [("a", "window", 1, "w1"), ("a", "window", 3, "w3"), ("a", "window", 2, "w2"), ("a", "eval", 9, "e"), ("b", "turn_end", 4, "t"), ("b", "other", 5, "o")]
    df = spark.createDataFrame(rows, "session_id string, kind string, at int, json string")
    got = {r.session_id: tuple(r)[1:] for r in pairing.latest_by_session(df, ["window", "eval", "turn_end"], "at").collect()}
    assert got == {"a": ("w3", "e", None), "b": (None, None, "t")}


def test_payloads_are_read_as_a_stream(spark, tmp_path):
    payload = json.dumps({"eventKind": "transcript.delta", "detail": {"text": "Hi", "itemId": "i"}})
    rows = [{"session_id": "a", "seq": 1, "media_now": 0.5, "payload": payload}, {"session_id": "a", "seq": 2, "media_now": 0.7, "payload": "broken"}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
    told = turn_events(read_turn_event_stream(spark, str(tmp_path / "in")), "payload")
    query = told.writeStream.format("memory").queryName("payloads").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [(r.seq, r.kind, r.text, r.item_id) for r in spark.table("payloads").orderBy("seq").collect()] == [(1, "transcript.delta", "Hi", "i"), (2, "", None, None)]


def test_a_prompt_tells_what_is_measured_and_nothing_without(spark):
    df = spark.createDataFrame([("smiles", "fast"), (None, "fast"), ("", None)], "v string, p string")
    told = [r.g for r in df.select(grounding(F.col("v"), F.col("p")).alias("g")).collect()]
    assert told[0].split("\n")[1:3] == ["smiles", "fast"] and told[1].split("\n")[1] == "fast" and told[2] == ""
    assert told[0].split("\n")[-1] == told[1].split("\n")[-1]

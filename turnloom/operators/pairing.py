"""Pairing of lanes, signals as one table, records and sinks' text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The states a nonverbal reading may have; anything else counts as neutral.
STATES = ("engaged", "attentive", "hesitant", "nervous", "confident", "disengaged", "neutral")


def pair_windows(nonverbal: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Nonverbal (session_id, k, state, intensity) and transcripts (session_id, k, text) of the same window in one row.

    Either side may be missing: no reading gives nulls, no transcript an empty one that isn't final.
    """
    told = transcripts.select("session_id", "k", F.coalesce("text", F.lit("")).alias("text"), F.lit(True).alias("heard"))
    both = nonverbal.join(told, ["session_id", "k"], "full_outer")
    return both.select(
        "session_id", "k", "state", "intensity", F.coalesce("text", F.lit("")).alias("transcript"), F.coalesce("heard", F.lit(False)).alias("transcript_final")
    )


def valid_reading(state: Column, intensity: Column, note: Column) -> tuple[Column, Column, Column]:
    """State, intensity and note as a reading may have them: a known state, 0 to 1 (NaN counts as 1), 120 characters."""
    number = F.coalesce(intensity.try_cast("double"), F.lit(0.0))
    return (
        F.when(state.isin(*STATES), state).otherwise("neutral"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)),
        F.substring(F.coalesce(note, F.lit("")), 1, 120),
    )


def unmatched(nonverbal: DataFrame, transcripts: DataFrame) -> DataFrame:
    """session_id, halves: how many windows of a session have one lane alone, which a reset before the turn's end gives up."""
    sides = [df.select("session_id", "k").distinct() for df in (nonverbal, transcripts)]
    lanes = sides[0].unionAll(sides[1]).groupBy("session_id", "k").agg(F.count(F.lit(1)).alias("lanes"))
    return lanes.groupBy("session_id").agg(F.count_if(F.col("lanes") == 1).alias("halves"))


def _centre(start: Column, width: Column) -> Column:
    return start + width / 2


def record_columns(kind: str) -> dict[str, Column]:
    """The columns of the records of a kind over its signals; all tell their type, session and time besides."""
    return {
        "window": {"t": _centre(F.col("start_s"), F.col("window_s")), **{c: F.col(c) for c in ("window_s", "nonverbal", "transcript", "transcript_final", "objective_nonverbal")}},
        "eval": {"t": _centre(F.col("start_s"), F.col("window_s")), "window_s": F.col("window_s"), "eval": F.col("eval")},
        "sentence": {"t": F.round(_centre(F.col("start_s"), F.col("end_s") - F.col("start_s")), 2), **{c: F.col(c) for c in ("start_s", "end_s", "text", "source", "speech", "visual", "nonverbal")}},
        "turn_end": {"t": F.col("t"), "transcript_full": F.col("transcript_full"), "eval": F.col("eval")},
    }[kind]


def records(signals_: DataFrame, kind: str) -> DataFrame:
    """Signals of a kind as its records: type, session_id and record_columns; what the signals lack is null."""
    absent = {c for c in ("nonverbal", "objective_nonverbal", "eval", "speech", "visual") if c not in signals_.columns}
    told = signals_.withColumns({c: F.lit(None).cast("string") for c in absent})
    return told.select(F.lit(kind).alias("type"), "session_id", *(c.alias(n) for n, c in record_columns(kind).items()))


def transcript(texts: DataFrame) -> DataFrame:
    """session_id, transcript: the non-blank texts of texts (session_id, k, seq, text) by k; the last one told for a k counts."""
    last = texts.groupBy("session_id", "k").agg(F.max_by("text", "seq").alias("text")).where("trim(text) != ''")
    parts = F.array_sort(F.collect_list(F.struct("k", "text")))
    return last.groupBy("session_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("transcript"))


def signals(**kinds: DataFrame) -> DataFrame:
    """All signals as one table with their kind; what a kind doesn't have is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (df.withColumn("kind", F.lit(kind)) for kind, df in kinds.items()))


def as_json(record: Column, keep_nulls: bool = True) -> Column:
    """One JSON line; keys that must be there even when null need keep_nulls."""
    return F.to_json(record, {"ignoreNullFields": str(not keep_nulls).lower()})


def sse_frame(record: Column) -> Column:
    return F.concat(F.lit("data: "), as_json(record), F.lit("\n\n"))


def ordered_records(records: DataFrame, at: str, turn_end: str = "turn_end") -> DataFrame:
    """records (session_id, kind) with their number: by time, the turn's end last."""
    order = Window.partitionBy("session_id").orderBy((F.col("kind") == turn_end).cast("int"), at, "kind")
    return records.withColumn("number", F.row_number().over(order))


def latest_by_session(records: DataFrame, wanted: list[str], at: str) -> DataFrame:
    """The last record of each wanted kind in a session, as one row of JSON columns."""
    last = [F.max_by("json", F.when(F.col("kind") == k, F.col(at))).alias(k) for k in wanted]
    return records.groupBy("session_id").agg(*last)


def write_json_lines(records: DataFrame, path: str) -> None:
    """Append records, one JSON object a line."""
    records.select(as_json(F.struct(*records.columns))).write.mode("append").text(path)


def json_lines_by_batch(path: str):
    """A sink for streams (foreachBatch, or streaming.live.fan_out): records, one JSON object a line, in a folder a batch.

    A batch that comes again takes the place of what was written of it, so records are there once however often a query starts again.
    """

    def write(records: DataFrame, batch_id: int) -> None:
        records.select(as_json(F.struct(*records.columns))).write.mode("overwrite").text(f"{path}/batch={batch_id}")

    return write

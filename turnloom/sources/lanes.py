"""Sources: relative time, media lanes, event payloads, server-sent lines.

Time in a session is whole microseconds since its first row, so window numbers are integer divisions and join keys are
exact. The driver's tables hold no media; their `events` stand in for it: a user is a session, clicks and views are
frames, purchases and signups are audio chunks, errors are failed evaluations, and one media second is SECOND_US.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SECOND_US = 14_400_000_000
FRAME_KINDS, AUDIO_KINDS = ("click", "view"), ("purchase", "signup")


def relative_time(rows: DataFrame, session: list[str], at_us: str, out: str = "t_us") -> DataFrame:
    """rows with out: at_us since the session's first. A grouped minimum joined back, so a huge session is no single task's."""
    first = rows.groupBy(*session).agg(F.min(at_us).alias("_first"))
    return rows.join(first, session).withColumn(out, F.col(at_us) - F.col("_first")).drop("_first")


def event_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, seq, t_us, lane (frame, audio or error), kind, value, cents."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.col("event_type")
    lane = F.when(kind.isin(*FRAME_KINDS), "frame").when(kind.isin(*AUDIO_KINDS), "audio").otherwise("error")
    rows = events.select(
        F.col("user_id").alias("session_id"),
        F.col("event_id").alias("seq"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"),
        lane.alias("lane"),
        kind.alias("kind"),
        "value",
        F.floor(F.col("value") * 100).cast("long").alias("cents"),
    )
    return relative_time(rows, ["session_id"], "at_us").drop("at_us")


def turn_ends(lanes: DataFrame) -> DataFrame:
    """session_id, end_us: the last row of each session."""
    return lanes.groupBy("session_id").agg(F.max("t_us").alias("end_us"))


def audio_clock(chunks: DataFrame, session: list[str], seq: str, duration: str, out: str) -> DataFrame:
    """Chunks with the time at which each begins: the sum of the durations before it."""
    before = Window.partitionBy(*session).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumn(out, F.coalesce(F.sum(duration).over(before), F.lit(0)))


def first_tracks(tracks: DataFrame, session: str, track: str, seq: str) -> DataFrame:
    """The first sighting of each track of a session; later ones are repeats."""
    return tracks.groupBy(session, track).agg(F.min(seq).alias(seq))


PAYLOAD = T.StructType(
    [
        T.StructField("eventKind", T.StringType()),
        T.StructField("normalizedType", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("transcript", T.StringType()),
        T.StructField("itemId", T.StringType()),
        T.StructField(
            "detail",
            T.StructType([T.StructField(n, T.StringType()) for n in ("transcript", "text", "itemId")]),
        ),
    ]
)


def turn_events(payloads: DataFrame, column: str) -> DataFrame:
    """payloads with kind, text and item_id read from the JSON in column; the first of the accepted names that isn't empty wins."""
    p = F.from_json(F.col(column), PAYLOAD)
    first = lambda *cols: F.coalesce(*(F.nullif(c, F.lit("")) for c in cols))
    return payloads.withColumns(
        {
            "kind": F.coalesce(first(p["eventKind"], p["normalizedType"], p["type"]), F.lit("")),
            "text": first(p["detail"]["transcript"], p["detail"]["text"], p["transcript"]),
            "item_id": first(p["detail"]["itemId"], p["itemId"]),
        }
    )


def stream_text(lines: DataFrame, key: list[str], seq: str, line: str) -> DataFrame:
    """The text of server-sent chat lines: key, seq, delta.

    Lines that don't start with `data: ` or hold no JSON are skipped; the first `data: [DONE]` ends its stream.
    """
    data = lines.where(F.col(line).startswith("data: ")).withColumn("_body", F.expr(f"substring({line}, 7)"))
    done = data.where("trim(_body) = '[DONE]'").groupBy(*key).agg(F.min(seq).alias("_done"))
    open_ = data.join(done, key, "left").where(F.col("_done").isNull() | (F.col(seq) < F.col("_done")))
    delta = F.get_json_object("_body", "$.choices[0].delta.content")
    return open_.withColumn("delta", delta).where("delta is not null and delta != ''").select(*key, seq, "delta")


def read_turn_event_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of turn events from JSON files: session_id, seq, media_now, payload."""
    return spark.readStream.schema("session_id string, seq long, media_now double, payload string").json(path)


def frame_times(frames: DataFrame, session: list[str], seq: str, pts_us: str, interval_us: int) -> DataFrame:
    """frames with t_us: their own time, or for those without one their number times the interval."""
    number = F.row_number().over(Window.partitionBy(*session).orderBy(seq)) - 1
    return frames.withColumn("t_us", F.coalesce(F.col(pts_us), (number * interval_us).cast("long")))

"""Table functions for SQL: what a walk over a partition's ordered rows gives, called on any table."""

from __future__ import annotations

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn
from pyspark.sql.types import DoubleType, LongType, StringType, StructType

from turnloom.operators.sentences import TIMEOUT_S, Event, Heard, hear

NEEDED = ("session_id", "seq", "media_now", "kind", "item_id", "text")


class _Sentences:
    """sentences_of(TABLE(events), timeout_s => 10.0): the sentences of a table of events (operators.sentences.fold_sentences).

    It deals rows out by session_id and sorts them by seq itself, so a caller needs no PARTITION BY. Columns may come in any
    order, and others may stand beside them. A table that lacks one is refused when the query is analyzed.
    """

    def __init__(self, *_):
        self.heard = Heard()

    @staticmethod
    def analyze(events: AnalyzeArgument, timeout_s: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not events.isTable:
            raise ValueError("sentences_of takes a table of events")
        missing = [c for c in NEEDED if c not in events.dataType.names]
        if missing:
            raise ValueError(f"events lack {', '.join(missing)}")
        schema = StructType().add("session_id", StringType()).add("start_s", DoubleType()).add("end_s", DoubleType())
        schema = schema.add("text", StringType()).add("source", StringType()).add("event_seq", LongType())
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("session_id")], orderBy=[OrderingColumn("seq")])

    def eval(self, events: Row, timeout_s: float | None = None):
        now = float(events["media_now"])
        event = Event(events["kind"] or "", now, now, events["item_id"], events["text"])
        self.heard, told = hear(self.heard, event, TIMEOUT_S if timeout_s is None else float(timeout_s))
        session = events["session_id"]
        for sentence in told:
            yield (None if session is None else str(session), *sentence, events["seq"])


def register(spark: SparkSession) -> None:
    """Make the table functions known to a session's SQL."""
    spark.udtf.register("sentences_of", udtf(_Sentences))

"""A turn's records from the signals of its lanes: halves that meet, the end that waits for what is owed, and what comes too late.

signals: session_id, seq, at_us, kind, lane, start_us, window_us, ok, text, state, intensity. Kinds are
  submitted   the lane (nonverbal or transcript) owes a result for the window at start_us
  nonverbal, transcript, eval, tail   a result; with ok false it is an answer without one
  ended       the turn is over and start_us long
Signals of a session count in the order of (at_us, seq). streaming.turns gives the same records as they come about.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.operators.windows import compact_tail, covered_prefix

HALVES = ("nonverbal", "transcript")
RECORD = "type string, at_us long, start_us long, window_us long, state string, intensity double, text string, heard boolean, eval string, n long"
SIGNAL = "session_id string, seq long, at_us long, kind string, lane string, start_us long, window_us long, ok boolean, text string, state string, intensity double"


def _record(kind: str, **columns: Column) -> list[Column]:
    told = {"type": F.lit(kind), **columns}
    return ["session_id", *(told.get(name, F.lit(None)).cast(form).alias(name) for name, form in (c.split() for c in RECORD.split(", ")))]


def ends_of(signals: DataFrame) -> DataFrame:
    """session_id, ended (at_us, seq), end_us of the first end of each turn."""
    order = F.struct("at_us", "seq")
    return signals.where("kind = 'ended'").groupBy("session_id").agg(F.min(order).alias("ended"), F.min_by("start_us", order).alias("end_us"))


def answers(signals: DataFrame) -> DataFrame:
    """The first result of each lane for each window: session_id, kind, start_us, came (at_us, seq), window_us, ok, text, state, intensity.

    A tail counts only after the turn's end, and has no window.
    """
    order = F.struct("at_us", "seq")
    told = signals.join(ends_of(signals).select("session_id", "ended"), "session_id", "left")
    results = told.where(F.col("kind").isin(*HALVES) | ((F.col("kind") == "tail") & (order > F.col("ended"))))
    start = F.when(F.col("kind") != "tail", F.col("start_us"))
    first = F.min(F.struct(order.alias("came"), "window_us", F.coalesce("ok", F.lit(True)).alias("ok"), "text", "state", "intensity"))
    return results.groupBy("session_id", "kind", start.alias("start_us")).agg(first.alias("r")).select("session_id", "kind", "start_us", "r.*")


def tails_due(signals: DataFrame, least_us: int) -> DataFrame:
    """session_id, start_us, dur_us of what evaluations told before the turn's end leave to be evaluated."""
    ends = ends_of(signals)
    before = signals.where("kind = 'eval' and coalesce(ok, true)").join(ends, "session_id").where(F.struct("at_us", "seq") < F.col("ended"))
    done = before.select("session_id", "start_us", (F.col("start_us") + F.col("window_us")).alias("end_us"))
    return compact_tail(covered_prefix(done, ends), ends, least_us)


def closings(signals: DataFrame, found: DataFrame, tails: DataFrame, deadline_us: int) -> DataFrame:
    """session_id, end_us, closed (at_us, seq), stragglers: when a turn that has ended is closed, and how many results it then still owes.

    It is closed by the last result it owes, at once if there is none, or deadline_us after its end.
    """
    ends = ends_of(signals)
    submitted = signals.where(F.col("kind").eqNullSafe("submitted") & F.col("lane").isin(*HALVES)).join(ends, "session_id").where(F.struct("at_us", "seq") < F.col("ended"))
    owed = submitted.select("session_id", F.col("lane").alias("kind"), "start_us").distinct()
    owed = owed.unionByName(tails.select("session_id", F.lit("tail").alias("kind"), F.lit(None).cast("long").alias("start_us")))
    same = F.expr("o.session_id = a.session_id and o.kind = a.kind and o.start_us <=> a.start_us")
    come = owed.alias("o").join(found.alias("a"), same, "left").select("o.session_id", "a.came").join(ends, "session_id")
    late = F.col("came").isNull() | (F.col("came.at_us") > F.col("ended.at_us") + deadline_us)
    waited = come.groupBy("session_id").agg(F.count_if(late).alias("stragglers"), F.max("came").alias("last"))
    deadline = F.struct((F.col("ended.at_us") + deadline_us).alias("at_us"), F.lit(2**63 - 1).alias("seq"))
    closed = F.when(F.col("stragglers") > 0, deadline).otherwise(F.greatest("ended", "last"))
    return ends.join(waited, "session_id", "left").select("session_id", "end_us", closed.alias("closed"), F.coalesce("stragglers", F.lit(0)).alias("stragglers"))


def turn_records(signals: DataFrame, deadline_us: int = 3_000_000, least_us: int = 1_000_000) -> DataFrame:
    """session_id and RECORD of the signals.

      window    both halves of a window, at the later one's time; a half alone, when the turn closes
      eval      each evaluation that has one, whenever it comes
      tail      what is left to evaluate, at the turn's end
      turn_end  the transcripts of all windows by time, the tail's text, and n results that are owed still
      dropped   n results of a turn that came again or after it closed, at the last one's time

    A turn without an end gives whole windows and evaluations only. The first result of a lane for a window counts.
    """
    found, tails = answers(signals), tails_due(signals, least_us)
    closing = closings(signals, found, tails, deadline_us)
    told = found.join(closing, "session_id", "left").where(F.col("closed").isNull() | (F.col("came") <= F.col("closed")))
    half = lambda lane: F.max(F.when((F.col("kind") == lane) & F.col("ok"), F.struct("came", "window_us", "state", "intensity", F.coalesce("text", F.lit("")).alias("text"))))
    pairs = told.where(F.col("kind").isin(*HALVES)).groupBy("session_id", "start_us").agg(half("nonverbal").alias("a"), half("transcript").alias("b"), F.max("closed.at_us").alias("closed_us"))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    pairs = pairs.where("a is not null or b is not null").withColumn("at", F.when(both, F.greatest("a.came.at_us", "b.came.at_us")).otherwise(F.col("closed_us"))).where("at is not null")
    text = F.coalesce("b.text", F.lit(""))
    out = pairs.select(*_record("window", at_us=F.col("at"), start_us=F.col("start_us"), window_us=F.coalesce("a.window_us", "b.window_us"), state=F.col("a.state"), intensity=F.col("a.intensity"), text=text, heard=F.col("b").isNotNull()))
    out = out.unionByName(signals.where("kind = 'eval' and coalesce(ok, true)").select(*_record("eval", **{c: F.col(c) for c in ("at_us", "start_us", "window_us", "text")})))
    out = out.unionByName(tails.join(ends_of(signals), "session_id").select(*_record("tail", at_us=F.col("ended.at_us"), start_us=F.col("start_us"), window_us=F.col("dur_us"))))
    said = F.array_sort(F.collect_list(F.when((F.col("kind") == "transcript") & F.col("ok") & (F.trim("text") != ""), F.struct("start_us", "text"))))
    last = told.groupBy("session_id").agg(said.alias("said"), F.max(F.when((F.col("kind") == "tail") & F.col("ok"), F.col("text"))).alias("eval"))
    whole = F.array_join(F.transform(F.coalesce("said", F.array().cast("array<struct<start_us:long,text:string>>")), lambda x: x["text"]), " ")
    ended = closing.join(last, "session_id", "left").select(*_record("turn_end", at_us=F.col("closed.at_us"), start_us=F.col("end_us"), text=whole, eval=F.col("eval"), n=F.col("stragglers")))
    results = signals.where(F.col("kind").isin(*HALVES, "tail")).groupBy("session_id").agg(F.count(F.lit(1)).alias("all"), F.max("at_us").alias("last_us"))
    kept = told.join(tails.select("session_id", F.lit("tail").alias("kind"), F.lit(True).alias("due")), ["session_id", "kind"], "left").where("kind != 'tail' or due").groupBy("session_id").agg(F.count(F.lit(1)).alias("kept"))
    n = F.col("all") - F.coalesce("kept", F.lit(0))
    dropped = results.join(kept, "session_id", "left").where(n > 0).select(*_record("dropped", at_us=F.col("last_us"), n=n))
    return out.unionByName(ended).unionByName(dropped)

"""Windows aligned to the start of a turn.

Times are whole microseconds since the turn began; intervals are half open. A grid window k of width w covers
[k * w, (k + 1) * w). lanes: session_id, seq, t_us, lane and others; ends: session_id, end_us.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.operators import chains
from turnloom.sources.staging import staged


def window_number(t_us: str, width_us: int) -> Column:
    return F.expr(f"{t_us} div {width_us}L")


def tumbling(rows: DataFrame, ends: DataFrame, width_us: int, *aggregates: Column) -> DataFrame:
    """session_id, k, n and the aggregates of rows in every grid window that is over when the turn ends, empty ones left out."""
    counted = rows.withColumn("k", window_number("t_us", width_us)).groupBy("session_id", "k").agg(F.count(F.lit(1)).alias("n"), *aggregates)
    return counted.join(ends, "session_id").where((F.col("k") + 1) * width_us <= F.col("end_us")).drop("end_us")


def all_windows(ends: DataFrame, width_us: int) -> DataFrame:
    """session_id, k of every grid window over at the turn's end, whether anything lies in it or not."""
    n = F.expr(f"end_us div {width_us}L")
    return ends.where(n > 0).select("session_id", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("k"))


def trailing_partial(ends: DataFrame, width_us: int, least_us: int) -> DataFrame:
    """session_id, start_us, dur_us of what the grid leaves at the turn's end, if it is longer than least_us."""
    start = F.expr(f"end_us div {width_us}L") * width_us
    return ends.select("session_id", start.alias("start_us"), (F.col("end_us") - start).alias("dur_us")).where(F.col("dur_us") > least_us)


def covered_prefix(done: DataFrame, ends: DataFrame) -> DataFrame:
    """session_id, covered_us: how far windows that follow one another without a gap from 0 reach.

    done: session_id, start_us, end_us of windows that succeeded, of any width.
    """
    order = Window.partitionBy("session_id").orderBy("start_us", "end_us")
    follows = F.col("start_us") == F.coalesce(F.lag("end_us").over(order), F.lit(0))
    chained = done.withColumn("_ok", follows.cast("int")).withColumn("_all", F.min("_ok").over(order))
    reach = chained.where("_all = 1").groupBy("session_id").agg(F.max("end_us").alias("covered_us"))
    return ends.select("session_id").join(reach, "session_id", "left").select("session_id", F.coalesce("covered_us", F.lit(0)).alias("covered_us"))


def compact_tail(covered: DataFrame, ends: DataFrame, least_us: int) -> DataFrame:
    """session_id, start_us, dur_us of the stretch after the covered prefix: any, if nothing is covered, else if longer than least_us."""
    dur = F.col("end_us") - F.col("covered_us")
    tail = covered.join(ends, "session_id").select("session_id", F.col("covered_us").alias("start_us"), dur.alias("dur_us"))
    return tail.where((F.col("dur_us") > 0) & ((F.col("start_us") == 0) | (F.col("dur_us") > least_us)))


def rows_in(intervals: DataFrame, rows: DataFrame, bucket_us: int) -> DataFrame:
    """Each interval (session_id, start_us, dur_us and others) with each row (session_id, t_us and others) in it.

    Joined on time buckets, so a session's intervals meet only the rows near them; intervals without rows drop out.
    """
    last = F.expr(f"(start_us + dur_us - 1) div {bucket_us}L")
    cut = intervals.where("dur_us > 0").withColumn("_b", F.explode(F.sequence(F.expr(f"start_us div {bucket_us}L"), last)))
    near = rows.withColumn("_b", F.expr(f"t_us div {bucket_us}L"))
    return cut.join(near, ["session_id", "_b"]).where("t_us >= start_us and t_us < start_us + dur_us").drop("_b")


def interval_media(intervals: DataFrame, frames: DataFrame, sound: DataFrame, bucket_us: int, least_us: int = 500_000) -> DataFrame:
    """intervals (session_id, seq, start_us, dur_us) with what lies in them: frames, pcm, window_us and src_fps.

    frames (session_id, t_us, frame) come by time; the pcm of sound (session_id, t_us, arrival, pcm) is joined in the order of arrival.
    window_us is the duration, least_us at least, and src_fps the frames a second of that, half a one at least.
    """
    key = ["session_id", "seq"]
    bounds = intervals.select(*key, "start_us", "dur_us")
    seen = rows_in(bounds, frames, bucket_us).groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("t_us", "frame"))), lambda x: x["frame"]).alias("frames"))
    chunks = F.transform(F.array_sort(F.collect_list(F.struct("arrival", "pcm"))), lambda x: x["pcm"])
    heard = rows_in(bounds, sound, bucket_us).groupBy(*key).agg(F.aggregate(chunks, F.lit(b""), lambda all_, x: F.concat(all_, x)).alias("pcm"))
    window = F.greatest(F.col("dur_us"), F.lit(least_us))
    both = intervals.join(seen, key, "left").join(heard, key, "left").withColumn("window_us", window)
    return both.withColumn("src_fps", F.greatest(F.lit(0.5), F.coalesce(F.size("frames"), F.lit(0)) * 1e6 / F.col("window_us")))


def rate_limited(rows: DataFrame, interval_us: int, tolerance_us: int = 1) -> DataFrame:
    """session_id, t_us of the rows that a greedy throttle keeps: each kept row closes the gate for interval_us.

    A row counts as at the gate up to tolerance_us early. Rows of one time are one, unless nothing closes the gate. After a gap as long
    as the gate is closed a row is kept whatever came before it.
    """
    closed = interval_us - tolerance_us
    if closed <= 0:
        return rows.select("session_id", "t_us")
    placed = chains.in_stretches(rows.select("session_id", F.col("t_us").cast("long").alias("t_us")).where("t_us is not null").distinct(), "t_us", closed)
    before = F.lag("t_us").over(Window.partitionBy("session_id", "_stretch").orderBy("t_us"))
    placed = placed.withColumn("begins", F.coalesce(F.col("t_us") - before >= closed, F.lit(True)))
    return chains.touched(chains.first_from(placed, "t_us", F.col("t_us") + closed, ["t_us"], "next"), ["t_us"])


def capped(items: Column, cap: int) -> Column:
    """At most cap items, spread evenly: item int(i * n / cap) for each i."""
    n = F.size(items)
    spread = F.transform(F.sequence(F.lit(0), F.lit(cap - 1)), lambda i: F.element_at(items, (F.floor(i * (n.cast("double") / cap)) + 1).cast("int")))
    return F.when(n > cap, spread).otherwise(items)


def latest(items: Column, k: Column | int) -> Column:
    """The last k items, or all."""
    k = F.lit(k) if isinstance(k, int) else k
    return F.slice(items, F.greatest(F.size(items) - k + 1, F.lit(1)), k)


def count_or_span(batches: DataFrame, most: int, span_us: int) -> DataFrame:
    """session_id, start_us, end_us of windows that close on a count or a span.

    batches: session_id, seq, n (0 or more), last_end_us, which doesn't fall from one seq to the next. After each batch, if the last end lies
    behind the anchor, at first 0, and either most items are pending or the span from the anchor is reached, [anchor, last end) is a
    window and the anchor moves there. A batch that ends span_us or more after the one before it closes a window in any case.
    """
    typed = batches.select("session_id", *(F.col(c).cast("long").alias(c) for c in ("seq", "n", "last_end_us")))
    # A row at 0 before the first stands for the first anchor.
    first = typed.groupBy("session_id").agg((F.min("seq") - 1).alias("seq")).select("session_id", "seq", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("last_end_us"))
    key = ["last_end_us", "seq"]
    placed = chains.in_stretches(typed.withColumn("begins", F.lit(False)).unionByName(first.withColumn("begins", F.lit(True))), "last_end_us", span_us)
    order = Window.partitionBy("session_id", "_stretch").orderBy(*key)
    apart = F.col("last_end_us") - F.lag("last_end_us").over(order) >= span_us
    placed = chains.spread(staged(placed, "placed"))
    placed = placed.withColumn("begins", F.col("begins") | F.coalesce(apart, F.lit(True))).withColumn("upto", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    placed, found = staged(placed.drop("n"), "summed"), None
    for at, wanted, name in (("upto", F.col("upto") + most, "full"), ("last_end_us", F.col("last_end_us") + 1, "later"), ("last_end_us", F.col("last_end_us") + span_us, "spanned")):
        found = chains.first_from(placed, at, wanted, key, name, found)
    both = F.when(F.col("full").isNotNull() & F.col("later").isNotNull(), F.greatest("full", "later"))
    closing = chains.touched(found.select("session_id", *key, "begins", F.least(both, F.col("spanned")).alias("next")), key)
    return between(closing)


def between(ends: DataFrame) -> DataFrame:
    """session_id, start_us, end_us from each of ends (session_id, last_end_us, seq) to the next of its session, found by stretches of time."""
    placed = ends.withColumn("_b", F.expr(f"last_end_us div {chains.STRETCH_US}L"))
    last = placed.groupBy("session_id", "_b").agg(F.max("last_end_us").alias("_last"))
    last = last.withColumn("_last", F.lag("_last").over(Window.partitionBy("session_id").orderBy("_b")))
    inside = placed.withColumn("_start", F.lag("last_end_us").over(Window.partitionBy("session_id", "_b").orderBy("last_end_us", "seq")))
    joined = inside.alias("a").join(last.alias("b"), F.expr("a.session_id <=> b.session_id and a._b = b._b"))
    start = F.coalesce("_start", "_last")
    return joined.select("a.session_id", start.alias("start_us"), F.col("last_end_us").alias("end_us")).where("start_us is not null")


def first_poll(deadline: Column, ends: Column, step_us: int) -> tuple[Column, Column]:
    """The first poll (multiples of step_us up to the turn's end) at or after a deadline, else the end; and whether it is a poll."""
    poll = F.ceil(deadline / F.lit(step_us)).cast("long") * step_us
    return F.when(poll <= ends, poll).otherwise(ends), poll <= ends


def late_replay(rows: DataFrame, ends: DataFrame, width_us: int, step_us: int, catch_up: bool) -> DataFrame:
    """session_id, k, at_us, n: the windows that are submitted when rows arrive late, when, and with how many rows.

    rows have arrival_us besides t_us. A window looks at what has arrived when first polled after its deadline. Without
    catch_up, an empty one is lost. With it, one that was empty at a poll is looked at again at later polls and at the turn's
    end, until rows have come; one that was first due at the end is not.
    """
    k = window_number("t_us", width_us)
    keyed = rows.withColumn("k", k).join(ends, "session_id").where((F.col("k") + 1) * width_us <= F.col("end_us"))
    at, polled = first_poll((F.col("k") + 1) * width_us, F.col("end_us"), step_us)
    arrived = keyed.groupBy("session_id", "k", "end_us").agg(F.min("arrival_us").alias("first_us")).withColumns({"due_us": at, "polled": polled})
    again, _ = first_poll(F.col("first_us"), F.col("end_us"), step_us)
    late = F.when(F.col("polled") & (F.col("first_us") <= F.col("end_us")), again) if catch_up else F.lit(None).cast("long")
    submitted = arrived.withColumn("at_us", F.when(F.col("first_us") <= F.col("due_us"), F.col("due_us")).otherwise(late)).where("at_us is not null")
    counted = keyed.join(submitted.select("session_id", "k", "at_us"), ["session_id", "k"]).where("arrival_us <= at_us")
    return counted.groupBy("session_id", "k", "at_us").agg(F.count(F.lit(1)).alias("n"))


def snapped(boundaries: DataFrame, pauses: DataFrame, reach_us: int) -> DataFrame:
    """boundaries (session_id, seq, t_us) with snap_us: the nearest pause (session_id, t_us) within reach_us, the earlier on ties, else t_us."""
    width = reach_us + 1
    cut = boundaries.withColumn("_b", F.explode(F.array(*(F.expr(f"t_us div {width}L") + d for d in (-1, 0, 1)))))
    near = pauses.select("session_id", F.expr(f"t_us div {width}L").alias("_b"), F.col("t_us").alias("p_us"))
    gap = F.abs(F.col("p_us") - F.col("t_us"))
    found = cut.join(near, ["session_id", "_b"]).where(gap <= reach_us).groupBy("session_id", "seq").agg(F.min(F.struct(gap.alias("gap"), "p_us")).alias("best"))
    return boundaries.join(found, ["session_id", "seq"], "left").withColumn("snap_us", F.coalesce("best.p_us", "t_us")).drop("best")

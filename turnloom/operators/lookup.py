"""What was last known at a time: an as-of join, and the session that a worker answers for when it is asked."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(rows: DataFrame, facts: DataFrame, key: str, at: str, name: str, stretch_us: int, before: bool = False) -> DataFrame:
    """rows with a struct, called name, of their key's last fact at or before their time (only before it, if so asked); null if there is none.

    Rows meet the facts of their own stretch of time, and of earlier ones only the last fact, so a key of any share of all rows
    is spread over its stretches, and rows are shuffled once. Of facts of one time the greatest counts, by their columns' order.
    Rows without a key or a time have none, nor do facts.
    """
    known = facts.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.struct(*facts.columns).alias("_fact"))
    asked = rows.select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.struct(*rows.columns).alias("_row"))
    both = asked.withColumn("_own", F.lit(True)).unionByName(known.withColumn("_own", F.lit(False)), allowMissingColumns=True)
    both = both.withColumn("_stretch", F.floor(F.col("_at") / stretch_us))
    # Of one time, facts come first, or last if only those before count.
    order = F.col("_own") if not before else ~F.col("_own")
    here = Window.partitionBy("_key", "_stretch").orderBy("_at", order, "_fact").rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("_near", F.last("_fact", ignorenulls=True).over(here)).where("_own")
    ends = both.where("_key IS NOT NULL AND _at IS NOT NULL").groupBy("_key", "_stretch").agg(F.max(F.when(~F.col("_own"), F.struct("_at", "_fact")))["_fact"].alias("_last"))
    earlier = Window.partitionBy("_key").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    far = ends.select("_key", "_stretch", F.last("_last", ignorenulls=True).over(earlier).alias("_far"))
    found = F.when(F.col("_at").isNotNull(), F.coalesce("_near", "_far"))
    return near.join(far, ["_key", "_stretch"], "left").select("_row.*", found.alias(name))


def sessions_asked(asks: DataFrame, sessions: DataFrame, stretch_us: int) -> DataFrame:
    """asks (worker, at_us, asked) with found, the session that answers, and active, whether it was going on then.

    A worker has one session at a time (worker, session_id, at_us when it began, ended_us or null): a new one ends the one before. It
    answers for the one going on and for the last one that ended; asked for none by name it gives the first of these that there
    is. Found is null if the worker has no such session.
    """
    begun = sessions.select("worker", "at_us", "session_id", "ended_us")
    told = as_of(begun, begun.select("worker", "at_us", "session_id"), "worker", "at_us", "_before", stretch_us, before=True)
    told = told.select("worker", "at_us", "session_id", "ended_us", F.col("_before.session_id").alias("previous"))
    met = as_of(asks, told, "worker", "at_us", "_now", stretch_us)
    going_on = F.coalesce(F.col("_now.ended_us") > F.col("at_us"), F.col("_now").isNotNull())
    latest = F.col("asked").isNull() | (F.col("asked") == F.col("_now.session_id"))
    previous = going_on & (F.col("asked") == F.col("_now.previous"))
    found = F.when(latest, F.col("_now.session_id")).when(previous, F.col("_now.previous"))
    return met.select(*asks.columns, found.alias("found"), F.when(found.isNotNull(), latest & going_on).alias("active"))

"""Greedy chains over rows in order, in parallel: which rows does a walk touch that goes from each row to a next one it determines?

A throttle goes from the row kept last to the first row behind its gate; a trigger from the row that closed a window to the first that closes the next.
Where a walk goes on from a row doesn't depend on how it came there, so every row's next one is found at once, by a search in the row's stretch of
time. Then the rows touched are found by jumps of 1, 2, 4, ... steps, each a join, until none is new: as many joins as the logarithm of the
longest chain. After a gap the walk begins anew whatever came before, so chains are no longer than what lies between gaps.

No step needs a session in one task: searches are by session and stretch of time, joins by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.sources.staging import drop_staged, staged

#: Stretches of time in which rows are searched, at least twice as long as the search reaches.
STRETCH_US = 600 * 1_000_000
#: Rows that a task sorts at once, on average.
PART_ROWS = 500_000


def in_stretches(rows: DataFrame, at: str, reach_us: int) -> DataFrame:
    """rows by stretch, own where they lie; those near its ends are in the neighbouring one, too, so that a search may look 2 * reach_us on and reach_us back."""
    width = max(STRETCH_US, 2 * reach_us)
    home = F.expr(f"{at} div {width}L")
    rest = F.col(at) - F.col("_home") * width
    near = F.array(F.col("_home"), F.when(rest < 2 * reach_us, F.col("_home") - 1), F.when(width - rest <= reach_us, F.col("_home") + 1))
    placed = rows.withColumn("_home", home).withColumn("_stretch", F.explode(F.array_compact(near)))
    return placed.withColumn("_own", F.col("_home") == F.col("_stretch")).drop("_home")


def spread(placed: DataFrame) -> DataFrame:
    """placed (a staged table) by session and stretch in partitions of PART_ROWS rows on average, or more partitions, so that no task grows with the table."""
    parts = max(int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-placed.count() // PART_ROWS))
    return placed.repartition(parts, "session_id", "_stretch")


def first_from(placed: DataFrame, at: str, wanted: Column, order: list[str], name: str, asks: DataFrame | None = None) -> DataFrame:
    """asks, by default the own rows of placed, with the first row (struct of order) in the stretch whose at is wanted or more as name; null if there is none.

    Rows and questions are read in one sorted pass from the end, each question taking the row seen last. What one search gives may ask the next.
    """
    asks = placed.where("_own") if asks is None else asks
    row = F.struct(*order)
    is_row = placed.select("session_id", "_stretch", F.col(at).alias("_at"), F.lit(1).alias("_is"), row.alias("_row"), F.lit(None).cast(asks.select(F.struct("*")).schema[0].dataType).alias("_ask"))
    asked = asks.select("session_id", "_stretch", wanted.alias("_at"), F.lit(0).alias("_is"), F.lit(None).cast(placed.select(row).schema[0].dataType).alias("_row"), F.struct("*").alias("_ask"))
    back = Window.partitionBy("session_id", "_stretch").orderBy(F.desc("_at"), F.desc("_is"), F.desc("_row")).rowsBetween(Window.unboundedPreceding, 0)
    found = spread(staged(is_row.unionAll(asked), "searched")).withColumn(name, F.last("_row", ignorenulls=True).over(back)).where("_is = 0")
    return found.select("_ask.*", name)


def touched(links: DataFrame, key: list[str]) -> DataFrame:
    """session_id and key of the rows that walks touch. links: session_id, key, begins, next (struct of key, or null), a row for each row."""
    row = F.struct(*key)
    links = staged(links.select("session_id", row.alias("row"), "begins", "next"), "links")
    kept = links.where("begins").select("session_id", "row")
    jumps = links.where("next is not null").select("session_id", "row", "next")
    made: list[DataFrame] = []
    while True:
        there = F.expr("a.session_id <=> b.session_id and a.row = b.row")
        reached = jumps.alias("b").join(kept.alias("a"), there, "left_semi").select("session_id", F.col("next").alias("row")).distinct()
        new = staged(reached.alias("b").join(kept.alias("a"), there, "left_anti"), "reached")
        if new.isEmpty():
            return kept.select("session_id", "row.*")
        on = jumps.alias("x").join(jumps.alias("y"), F.expr("x.session_id <=> y.session_id and x.next = y.row")).select("x.session_id", "x.row", F.col("y.next").alias("next"))
        kept, jumps = staged(kept.unionByName(new), "kept"), staged(on, "jumps")
        drop_staged(new, *made)
        made = [kept, jumps]

"""Windows, late rows and throttling on small scripts, against plain loops."""

import random

from pyspark.sql import functions as F

from turnloom.operators import chains
from turnloom.operators import windows as w


def ends(spark, **turns):
    return spark.createDataFrame(list(turns.items()), "session_id string, end_us long")


def rows(spark, data):
    return spark.createDataFrame(data, "session_id string, seq long, t_us long, lane string")


def got(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_grid_leaves_windows_that_are_not_over(spark):
    data = rows(spark, [("a", 1, 0, "frame"), ("a", 2, 29, "frame"), ("a", 3, 30, "frame"), ("a", 4, 60, "frame")])
    assert got(w.tumbling(data, ends(spark, a=65), 30), "k", "n") == [(0, 2), (1, 1)]
    assert got(w.all_windows(ends(spark, a=65, b=29), 30), "session_id", "k") == [("a", 0), ("a", 1)]


def test_trailing_part_must_be_longer_than_the_least(spark):
    e = ends(spark, a=65, b=60, c=66)
    assert got(w.trailing_partial(e, 30, 5), "session_id", "start_us", "dur_us") == [("c", 60, 6)]


def test_covered_prefix_stops_at_a_gap(spark):
    done = spark.createDataFrame([("a", 0, 16), ("a", 16, 32), ("a", 48, 64), ("b", 16, 32), ("c", 0, 9), ("c", 9, 20)], "session_id string, start_us long, end_us long")
    e = ends(spark, a=70, b=40, c=20, d=5)
    covered = w.covered_prefix(done, e)
    assert got(covered, "session_id", "covered_us") == [("a", 32), ("b", 0), ("c", 20), ("d", 0)]
    assert got(w.compact_tail(covered, e, 10), "session_id", "start_us", "dur_us") == [("a", 32, 38), ("b", 0, 40), ("d", 0, 5)]


def test_rate_limit_follows_the_last_kept_row(spark):
    rng = random.Random(4)
    data = [(s, i, rng.randrange(1000), "frame") for s in "abc" for i in range(60)]
    want = []
    for s in "abc":
        gate = None
        for t in sorted(r[2] for r in data if r[0] == s):
            if gate is None or t + 1 >= gate:
                want.append((s, t))
                gate = t + 37
    assert got(w.rate_limited(rows(spark, data), 37), "session_id", "t_us") == sorted(want)


def test_throttle_and_trigger_across_stretches(spark, monkeypatch):
    """Long walks over dense and sparse rows, ties and nulls, in stretches far shorter than a session, against plain loops."""
    monkeypatch.setattr(chains, "STRETCH_US", 100)
    rng = random.Random(8)
    data, batches = [], []
    for s in ("dense", "sparse", None):
        t, seq = 0, 0
        for _ in range(300):
            t += rng.choice((0, 1, 2, 5)) if s == "dense" else rng.choice((0, 3, 20, 36, 37, 38, 250))
            data.append((s, seq, t, "frame"))
            batches.append((s, seq, rng.choice((0, 1, 1, 3)), t))
            seq += 1
    kept, closed = [], []
    for s in ("dense", "sparse", None):
        gate = None
        for t in sorted({r[2] for r in data if r[0] == s}):
            if gate is None or t + 1 >= gate:
                kept.append((s, t))
                gate = t + 37
        anchor = pending = 0
        for _, _, n, e in (b for b in batches if b[0] == s):
            pending += n
            if e > anchor and (pending >= 9 or e - anchor >= 37):
                closed.append((s, anchor, e))
                anchor, pending = e, 0
    by = lambda r: tuple(str(x) if i == 0 else x for i, x in enumerate(r))
    got_kept = [tuple(r) for r in w.rate_limited(rows(spark, data), 37).collect()]
    assert sorted(got_kept, key=by) == sorted(kept, key=by)
    b = spark.createDataFrame(batches, "session_id string, seq long, n long, last_end_us long")
    assert sorted((tuple(r) for r in w.count_or_span(b, 9, 37).collect()), key=by) == sorted(closed, key=by)


def test_throttle_and_trigger_of_nothing(spark):
    assert w.rate_limited(rows(spark, []), 37).collect() == []
    assert w.count_or_span(spark.createDataFrame([], "session_id string, seq long, n long, last_end_us long"), 4, 15).collect() == []


def test_count_or_span_windows(spark):
    batches = spark.createDataFrame([("a", i, n, e) for i, (n, e) in enumerate([(1, 3), (2, 5), (1, 6), (1, 6), (4, 6), (1, 30), (1, 31)])], "session_id string, seq long, n long, last_end_us long")
    assert got(w.count_or_span(batches, 4, 15), "start_us", "end_us") == [(0, 6), (6, 30)]


def test_caps(spark):
    df = spark.range(1).select(w.capped(F.sequence(F.lit(0), F.lit(19)), 12).alias("c"), w.capped(F.array(F.lit(1)), 3).alias("d"), w.latest(F.sequence(F.lit(1), F.lit(4)), 3).alias("e"), w.latest(F.array(F.lit(7)), 3).alias("f"))
    r = df.first()
    assert r.c == [int(i * (20 / 12)) for i in range(12)] and r.d == [1] and r.e == [2, 3, 4] and r.f == [7]


def test_late_rows_are_caught_up_in_one_lane_and_lost_in_the_other(spark):
    # Polls at 10, 20, ...; window 0 ends at 30. Its only row arrives at 41: the catch-up finds it at the poll of 50.
    late = spark.createDataFrame([("a", 5, 41), ("a", 35, 36), ("a", 40, 95), ("b", 5, 31), ("c", 62, 64)], "session_id string, t_us long, arrival_us long")
    e = ends(spark, a=90, b=31, c=95)
    assert got(w.late_replay(late, e, 30, 10, True), "session_id", "k", "at_us", "n") == [("a", 0, 50, 1), ("a", 1, 60, 1), ("b", 0, 31, 1), ("c", 2, 90, 1)]
    # Without it windows are only looked at when due: that of b at the poll of 30, before its row has come.
    assert got(w.late_replay(late, e, 30, 10, False), "session_id", "k", "at_us", "n") == [("a", 1, 60, 1), ("c", 2, 90, 1)]


def test_snap_takes_the_nearest_and_the_earlier_on_ties(spark):
    b = spark.createDataFrame([("a", 1, 100), ("a", 2, 200), ("a", 3, 300), ("b", 4, 50)], "session_id string, seq long, t_us long")
    p = spark.createDataFrame([("a", 93), ("a", 107), ("a", 208), ("a", 311)], "session_id string, t_us long")
    assert got(w.snapped(b, p, 8), "seq", "snap_us") == [(1, 93), (2, 208), (3, 300), (4, 50)]


def test_rows_in_intervals(spark):
    rng = random.Random(9)
    iv = [(s, i, rng.randrange(500), rng.randrange(0, 90)) for s in "ab" for i in range(20)]
    rs = [(s, rng.randrange(600)) for s in "ab" for _ in range(50)]
    a = spark.createDataFrame(iv, "session_id string, seq long, start_us long, dur_us long")
    b = spark.createDataFrame(rs, "session_id string, t_us long")
    want = sorted((s, i, t) for s, i, x, d in iv for z, t in rs if s == z and x <= t < x + d)
    assert got(w.rows_in(a, b, 40), "session_id", "seq", "t_us") == want


def test_searches_have_partitions_by_rows(spark, monkeypatch):
    """A table of more rows is sorted in more partitions, not in larger ones."""
    monkeypatch.setattr(chains, "PART_ROWS", 10)
    rows = spark.range(400).selectExpr("id as session_id", "id as _stretch")
    assert chains.spread(rows).rdd.getNumPartitions() == max(40, int(spark.conf.get("spark.sql.shuffle.partitions")))

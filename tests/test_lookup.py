"""As-of joins and the sessions that answer."""

import random

from turnloom.operators.lookup import as_of, sessions_asked


def test_as_of_against_a_plain_search(spark):
    rng = random.Random(5)
    pick = lambda: rng.choice(("hot", "hot", "hot", "a", "b", None))
    rows = [(i, pick(), rng.choice((None, *[rng.randint(-50, 400) for _ in range(9)]))) for i in range(300)]
    facts = [(pick(), rng.choice((None, *[rng.randint(-50, 400) for _ in range(9)])), rng.choice("xyz")) for _ in range(120)]
    facts += facts[:10]
    left = spark.createDataFrame(rows, "id long, k string, t long").repartition(3)
    right = spark.createDataFrame(facts, "k string, t long, v string")
    for before in (False, True):
        for stretch in (7, 1000):
            got = {r.id: r.fact and (r.fact.t, r.fact.v) for r in as_of(left, right, "k", "t", "fact", stretch, before).collect()}
            for i, k, t in rows:
                own = [(u, v) for j, u, v in facts if k is not None and t is not None and j == k and u is not None and (u < t or (u == t and not before))]
                assert got[i] == max(own, default=None), (before, stretch, i)
            assert len(got) == len(rows)


def test_as_of_keeps_repeated_rows_and_clashing_columns(spark):
    left = spark.createDataFrame([("a", 5, "mine")] * 2, "k string, t long, v string")
    right = spark.createDataFrame([("a", 5, "yours")], "k string, t long, v string")
    told = as_of(left, right, "k", "t", "fact", 10)
    assert [(r.v, r.fact.v) for r in told.collect()] == [("mine", "yours")] * 2 and told.columns == ["k", "t", "v", "fact"]
    assert as_of(left.limit(0), right, "k", "t", "fact", 10).count() == 0
    assert [r.fact for r in as_of(left, right.limit(0), "k", "t", "fact", 10).collect()] == [None, None]


def test_the_active_session_answers_then_the_last(spark):
    sessions = spark.createDataFrame([(1, "one", 0, None), (1, "two", 100, 180), (1, "three", 200, None), (2, "four", 50, 60)], "worker int, session_id string, at_us long, ended_us long")
    asks = [
        (1, -5, None, None), (1, 50, None, ("one", True)), (1, 50, "two", None), (1, 150, "one", ("one", False)), (1, 150, "two", ("two", True)), (1, 190, None, ("two", False)),
        (1, 190, "one", None), (1, 190, "two", ("two", False)), (1, 200, "three", ("three", True)), (1, 999, "two", ("two", False)), (1, 999, "one", None), (2, 70, None, ("four", False)),
        (3, 70, None, None), (None, 70, None, None),
    ]
    df = spark.createDataFrame([(i, w, t, name) for i, (w, t, name, _) in enumerate(asks)], "i int, worker int, at_us long, asked string")
    told = {r.i: (r.found, r.active) if r.found else None for r in sessions_asked(df, sessions, 90).collect()}
    assert told == {i: want for i, (*_, want) in enumerate(asks)}

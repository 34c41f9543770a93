"""Substring dedup and the n-gram join against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnloom.llm import ngram_join as nj
from turnloom.llm.common import lower_words_of, rolling, words_of
from turnloom.llm.components import connected_components
from turnloom.llm.substring_dedup import block_hits, remove_repeats, spots_of, windows_around

DOCS = "doc_id long, text string"


def corpus(seed=1, n=60):
    """Texts with copies, near copies, shared passages, very short and very long ones, nulls and repeated rows."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    words = lambda k: [rng.choice(vocab) for _ in range(k)]
    passage, base = words(70), words(200)
    out = []
    for i in range(n):
        kind = i % 6
        if kind == 0:
            w = words(rng.randrange(0, 120))
        elif kind == 1:
            w = words(30) + passage[rng.randrange(0, 15) :] + words(20)
        elif kind == 2:
            w = [x if rng.random() > 0.01 else "edit" for x in base]
        elif kind == 3:
            w = list(base)
        elif kind == 4:
            w = ["again"] * rng.randrange(1, 130)
        else:
            w = words(rng.choice([1, 2, 49, 50, 51]))
        out.append((i, (" " if i % 2 else "\n").join(w)))
    long_ = words(5000)
    out += [(100, None), (101, ""), (102, " \t\n"), (103, " ".join(long_)), (104, " ".join(long_[1000:4000] + ["é"] + long_[:500])), (105, out[3][1]), (105, out[3][1]), (None, out[3][1]), (None, None)]
    return out


def dedup_by_hand(rows, window):
    first = {}
    for i, t in rows:
        if i is not None:
            w = words_of(t)
            for p in range(len(w) - window + 1):
                first[tuple(w[p : p + window])] = min(i, first.get(tuple(w[p : p + window]), i))
    for i, t in rows:
        w = words_of(t)
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if i is not None and first[tuple(w[p : p + window])] < i:
                gone[p : p + window] = [True] * window
        yield i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()


@pytest.mark.parametrize("window", [50, 12])
def test_repeats_are_removed_as_by_hand(spark, window):
    rows = corpus()
    got = remove_repeats(spark.createDataFrame(rows, DOCS).withColumn("n_words", F.lit("x")), window=window, gram=min(5, window // 2))
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(dedup_by_hand(rows, window), key=key)


def test_repeats_text_and_empty_table(spark):
    rows = [(1, " ".join(map(str, range(60)))), (2, "a b " + " ".join(map(str, range(55))) + " c")]
    got = {r.doc_id: r for r in remove_repeats(spark.createDataFrame(rows, DOCS), keep_text=True).collect()}
    assert got[1].kept_text is None and got[2].kept_text == "a b c" and got[2].n_removed == 55
    assert remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_probes_hit_blocks_of_earlier_documents_and_hits_grow_to_windows(spark):
    # Document 1 owns the blocks k and m; 2 has k off its grid; 3 has k at its grid, after 1; x is in one document alone.
    probes = [(1, 7, 0, 10), (1, 7, 25, 11), (2, 8, 3, 10), (3, 9, 50, 10), (3, 9, 75, 12), (4, 9, 1, 13), (5, 9, 2, 13)]
    got = block_hits(spark.createDataFrame(probes, "doc_id long, tag int, at int, key long"), 25).collect()
    assert sorted(map(tuple, got)) == [(1, 7, 0, 1), (2, 8, 3, 1), (3, 9, 50, 1)]
    assert windows_around(100, np.array([0, 60]), 50).tolist() == [0, *range(35, 51)]
    assert windows_around(49, np.array([0]), 50).tolist() == [] and windows_around(60, np.array([], int), 50).tolist() == []
    assert spots_of(100, np.array([10, 12]), 50).tolist() == list(range(10, 38)) and spots_of(50, np.array([0]), 50).tolist() == list(range(26))


def join_by_hand(rows, n, percent):
    sets = []
    for i, t in rows:
        w = lower_words_of(t)
        sets.append((i, frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])))
    at = list(range(len(sets)))

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    for x, (_, a) in enumerate(sets):
        for y, (_, b) in enumerate(sets[:x]):
            both = len(a & b)
            if a and b and 100 * both >= percent * (len(a) + len(b) - both):
                at[max(root(x), root(y))] = min(root(x), root(y))
    least = {}
    for x, (i, _) in enumerate(sets):
        if i is not None:
            least[root(x)] = min(i, least.get(root(x), i))
    return [(i, len(s), least.get(root(x), i)) for x, (i, s) in enumerate(sets)]


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_join_finds_every_component(spark, n, percent):
    rows = corpus(2)
    rng = random.Random(8)
    base = [f"v{rng.randrange(300)}" for _ in range(150)]
    for i in range(200, 260):  # near copies at all distances around the threshold
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(1000)}"
        rows.append((i, " ".join(w[: rng.choice([150, 150, 145, 130])])))
    got = nj.similar_documents(spark.createDataFrame(rows, DOCS).withColumn("key", F.lit(1)), n, percent).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:]))
    assert sorted(map(tuple, got), key=key) == sorted(join_by_hand(rows, n, percent), key=key)


def test_rows_without_id_link_others(spark):
    w = [f"n{i}" for i in range(120)]
    near = lambda *at: " ".join("x" if i in at else x for i, x in enumerate(w))
    rows = [(5, near()), (None, near(0, 119)), (6, near(0, 119, 60)), (None, "a b c d"), (None, "a b c d"), (None, None), (7, "a b c e")]
    for some in (rows, rows[3:6], rows[:1] + rows[2:3]):
        got = nj.similar_documents(spark.createDataFrame(some, DOCS), 3, 90).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, join_by_hand(some, 3, 90)))


def test_join_in_small_blocks_and_empty_table(spark, monkeypatch):
    monkeypatch.setattr(nj, "BLOCK_MEMBERS", 4)
    monkeypatch.setattr(nj, "PAIRED_MEMBERS", 3)
    rng = random.Random(3)
    base = [f"v{i}" for i in range(60)]
    rows = []
    for i in range(30):
        w = list(base)
        for _ in range(2):
            w[rng.randrange(len(w))] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    got = nj.similar_documents(spark.createDataFrame(rows, DOCS), 3, 80).collect()
    assert sorted(map(tuple, got)) == sorted(join_by_hand(rows, 3, 80))
    assert nj.similar_documents(spark.createDataFrame([], DOCS)).count() == 0


def test_pairs_at_the_bound_share_a_tile():
    """Sets that differ as much as a link allows have a tile in common, and bit counts never overstate differences."""
    rng = np.random.default_rng(5)
    for percent in (80, 90):
        bands = nj.Bands(percent)
        for size in [*range(1, 40), 100, 333, 1000]:
            for _ in range(20):
                pool = np.unique(rng.integers(0, 2**63, 3 * size + 4).astype(np.uint64))
                rng.shuffle(pool)
                out = int(rng.integers(0, size + 1))
                a, b = np.sort(pool[:size]), np.sort(np.concatenate([pool[: size - out], pool[size : size + int(rng.integers(0, out + 2))]]))
                both = nj.overlap(a, b)
                assert both == len(np.intersect1d(a, b))
                assert nj.bit_difference(nj.bitmap(a), nj.bitmap(b)) <= len(a) + len(b) - 2 * both if len(b) else True
                if len(b) and 100 * both >= percent * (len(a) + len(b) - both):
                    (x, f, need), (y, g, more) = nj.tiles_of(a, bands), nj.tiles_of(b, bands)
                    common = [int(np.isin(x[f == k], y[g == k]).sum()) for k in set(f.tolist()) & set(g.tolist())]
                    wanted = [max(int(need[f == k][0]), int(more[g == k][0])) for k in set(f.tolist()) & set(g.tolist())]
                    assert any(c >= w for c, w in zip(common, wanted))


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 440)]
    at = {x: x for e in edges for x in e}

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in edges:
        at[max(root(a), root(b))] = min(root(a), root(b))
    want = {(x, root(x)) for a, b in edges if a != b for x in (a, b)}
    got = connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert set(map(tuple, got.collect())) == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rolling_hash_depends_on_the_run_alone():
    h = np.random.default_rng(1).integers(0, 2**63, 50).astype(np.uint64)
    assert (rolling(np.concatenate([h, h]), 7)[:44] == rolling(h, 7)).all() and rolling(np.concatenate([h, h]), 7)[50] == rolling(h, 7)[0]
    assert len(rolling(h[:3], 4)) == 0

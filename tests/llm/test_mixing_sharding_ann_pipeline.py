"""Mixing, sharding, nearest neighbours and the pipeline against brute force."""

import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnloom.llm import ann, mixing, sharding


def sources(n=300, hot=0.4, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        source = "hot" if rng.random() < hot else rng.choice(["a", "b", "c", None])
        out.append((i, " ".join(["w"] * rng.randrange(0, 60)), source))
    return [*out, (5, out[5][1], out[5][2]), (900, None, "a"), (None, "x y", "b"), (901, "", "empty")]


SCHEMA = "doc_id long, text string, source string"


@pytest.mark.parametrize(("budget", "blocks"), [(0.6, 20_000), (2.0, 20_000), (0.6, 10)])
def test_mix_meets_weights(spark, monkeypatch, budget, blocks):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", blocks)
    rows = sources()
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"weight": F.lit("own"), "rounds": F.lit(1), "of": F.lit(2)})
    got = mixing.mix(df, budget=budget, entropy=0.97, max_repeats=3.0).collect()
    assert len(got) == len(rows)
    tokens, taken, weight = collections.Counter(), collections.Counter(), {}
    for r in got:
        assert r.n_tokens == len((r.text or "").split()) and r.rounds == 1 and r.of == 2
        tokens[r.source] += r.n_tokens
        taken[r.source] += r.n_tokens * r.copies
        weight[r.source] = r.weight
    total = sum(tokens.values())
    assert math.isclose(sum(weight.values()), 1)
    for s, n in tokens.items():
        if n:
            assert 0 <= weight[s] * budget * total - taken[s] <= 121
            assert weight[s] * budget * total / n <= 3.0 + 1e-6
    h = -sum(w * math.log(w) for w in weight.values() if w)
    assert h >= 0.97 * math.log(5) - 1e-4
    copies = {}
    for r in got:
        copies.setdefault((r.doc_id, r.text, r.source), set()).add(r.copies)
    assert all(len(c) == 1 for c in copies.values())
    assert {r.copies for r in got if r.source == "empty"} == {1}


@pytest.mark.parametrize(("budget", "blocks"), [(0.6, 20_000), (2.3, 20_000), (0.6, 10)])
def test_copies_against_a_plain_walk(spark, monkeypatch, budget, blocks):
    """Each source's permutation walked row by row, block after block, till its quota is used up."""
    monkeypatch.setattr(mixing, "BLOCK_ROWS", blocks)
    df = spark.createDataFrame(sources(), SCHEMA)
    got = mixing.mix(df, budget=budget, entropy=0.97, max_repeats=3.0, seed=17)
    key = F.xxhash64(F.lit(17), F.coalesce(F.col("source"), F.lit("")), "doc_id", "text")
    by = {}
    for r in got.select("source", "weight", "copies", key.alias("key"), F.xxhash64(key).alias("deal"), "text").collect():
        by.setdefault(r.source, []).append((r.key, r.deal, len((r.text or "").split()), r.copies, r.weight))
    total = sum(n for rows in by.values() for _, _, n, *_ in rows)
    for source, rows in by.items():
        tokens, weight = sum(n for _, _, n, *_ in rows), rows[0][4]
        if not tokens:
            assert {c for *_, c, _ in rows} == {1}, source
            continue
        rounds, left = divmod(math.floor(weight * budget * total + 1e-6), tokens)
        n_blocks = math.ceil(len(rows) / min(blocks, math.ceil(math.sqrt(len(rows)))))
        told = {}
        for key_, deal, n, *_ in rows:
            told.setdefault((deal % n_blocks, key_), []).append(n)
        once_more, used = set(), 0
        for place in sorted(told):
            used += sum(told[place])
            if used > left:
                break
            once_more.add(place)
        assert all(c == rounds + ((deal % n_blocks, key_) in once_more) for key_, deal, _, c, _ in rows), source


def test_exponent_against_a_fine_grid(spark):
    p = [0.7, 0.2, 0.05, 0.05]
    shares = spark.createDataFrame([(x,) for x in p], "share double")

    def measure(a):
        w = np.array(p) ** a / (np.array(p) ** a).sum()
        return -(w * np.log(w)).sum(), (w / np.array(p)).max()

    a = mixing.find_exponent(shares, 0.9, 100.0, 1.0)
    assert measure(a)[0] >= 0.9 * math.log(4) - 1e-9 and measure(a + 1e-4)[0] < 0.9 * math.log(4)
    a = mixing.find_exponent(shares, 0.99, 2.0, 1.0)
    assert measure(a)[1] <= 2 + 1e-9 and measure(a - 1e-4)[1] > 2
    assert mixing.find_exponent(shares.limit(1), 0.9, 2.0, 1.0) == 1.0


def test_mix_of_nothing(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [r.copies for r in mixing.mix(spark.createDataFrame([(1, "a b", "s")], SCHEMA)).collect()] == [2]


def test_shards(spark):
    rows = [(i, "é" * (i % 50)) for i in range(3000)] + [(7, "é" * 7), (None, None), (-5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("x"))
    placed, versions = sharding.shard_rows(df)
    got = placed.collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for r in got:
        text = "" if r.doc_id in (None, -5) else "é" * (r.doc_id % 50)
        assert r.size == len(text.encode()) + 8 and r.text_crc32 == zlib.crc32(text.encode()) and r.law == "key"
        assert r.grown_shard in (r.shard, 24) and 0 <= r.shard < 24
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    part = {r.doc_id: r.shard for r in sharding.shard_rows(df.where("doc_id % 3 = 0"))[0].collect()}
    whole = {r.doc_id: r.shard for r in got}
    assert part and all(whole[d] == s for d, s in part.items())
    grown = {r.doc_id: r.shard for r in sharding.shard_rows(df, 25)[0].collect()}
    assert all(grown[r.doc_id] == r.grown_shard for r in got)
    stored = versions.collect()
    assert len(stored) == 3 * sharding.SLOTS and {(r.version, r.edit, r.n_shards) for r in stored} == {(1, "base", 24), (2, "grow", 25), (3, "rebalance", 24)}
    assert all(sum(r.n_rows for r in stored if r.version == v) == len(rows) for v in (1, 2, 3))
    assert sum(r.n_bytes for r in stored if r.version == 1) == sum(r.size for r in got)
    assert sharding.shard_rows(df.limit(0))[0].count() == 0


def test_shards_by_bytes(spark):
    rng = random.Random(3)
    rows = [(i, "x" * (rng.randrange(50) ** 2)) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    placed, versions = sharding.shard_rows(df, law="bytes")
    size, slots = collections.Counter(), collections.defaultdict(list)
    for r in placed.collect():
        assert r.law == "bytes" and r.grown_shard is None
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert max(size.values()) <= 1.001 * min(size.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    by_key = collections.Counter()
    for r in sharding.shard_rows(df)[0].collect():
        by_key[r.shard] += r.size
    assert max(by_key.values()) > 1.05 * min(by_key.values())
    moved = {v: {r.vslot: r.shard for r in versions.where(F.col("version") == v).collect()} for v in (1, 3)}
    assert 0 < sum(moved[1][s] != moved[3][s] for s in moved[1]) < sharding.SLOTS / 4
    assert sharding.shard_rows(df.limit(0), law="bytes")[0].count() == 0


def test_slots_of_many_rows_are_cut(spark, monkeypatch):
    """A third of all rows alike in all columns, and more rows with one id."""
    monkeypatch.setattr(sharding, "SORT_ROWS", 50)
    rows = [(None, "same")] * 1000 + [(7, f"t{i}") for i in range(500)] + [(i, "x" * 3000) for i in range(1500)]
    placed = sharding.shard_rows(spark.createDataFrame(rows, "doc_id long, text string").repartition(7))[0].collect()
    by = collections.defaultdict(list)
    for r in placed:
        by[r.shard].append(r.slot)
    assert len(placed) == len(rows) and all(sorted(s) == list(range(len(s))) for s in by.values())


def test_sharding_runs_no_python(spark):
    """The plan of the main path, and what its tables are read from, hold no Python."""
    placed, versions = sharding.shard_rows(spark.range(100).selectExpr("id as doc_id", "cast(id as string) as text"))
    for x in (placed, versions, sharding.map_table(spark, [("base", 2, [0, 1])])):
        assert "Python" not in x._jdf.queryExecution().executedPlan().toString() and "PythonRDD" not in x._jdf.rdd().toDebugString()


def test_slot_maps():
    m = sharding.map_for(24)
    counts = collections.Counter(m)
    assert max(counts.values()) - min(counts.values()) <= 1
    bigger = sharding.grow(m, 24)
    assert all(b in (a, 24) for a, b in zip(m, bigger)) and collections.Counter(bigger)[24] == sharding.SLOTS // 25
    rng = random.Random(1)
    load = [rng.randrange(100) for _ in m]
    even = sharding.rebalance(m, load)
    total = lambda x: [sum(b for s, b in zip(x, load) if s == k) for k in range(24)]
    assert max(total(even)) - min(total(even)) <= 2 < max(total(m)) - min(total(m))


def neighbours_by_hand(rows, k, step):
    ok = [(i, np.array(v, float)) for i, v in rows]
    out = []
    for i, v in ok:
        if i % step == 0:
            near = sorted((-float(v @ x), j) for j, x in ok if j != i)[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(near, 1)]
    return out


VECTORS = "vec_id long, embedding array<double>"


def test_neighbours_of_small_and_odd_tables(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=8).round(3).tolist()
    good = [(i, base) for i in range(60)] + [(i, rng.normal(size=8).round(3).tolist()) for i in range(60, 100)]
    odd = [(200, None), (220, [0.0] * 8), (240, [math.nan] * 8), (None, base), (260, [1.0] * 3), (280, [None] * 8), (300, [math.inf] * 8), (0, base)]
    got = ann.nearest(spark.createDataFrame(good + odd, VECTORS).withColumn("rank", F.lit(1))).collect()
    want = neighbours_by_hand(good, 20, 20)
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == sorted(w[:3] for w in want)
    assert all(math.isclose(a, b) for a, b in zip((r.score for r in sorted(got)), (w[3] for w in sorted(want))))
    few = ann.nearest(spark.createDataFrame(good[60:64], VECTORS), query_step=1).collect()
    assert len(few) == 12
    assert ann.nearest(spark.createDataFrame([], VECTORS)).count() == 0


def test_recall_of_sharded_graphs(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 16))
    x = (centres[rng.integers(0, 20, 5000)] + 0.5 * rng.normal(size=(5000, 16))) * rng.uniform(0.5, 2, (5000, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = collections.defaultdict(set)
    for r in ann.nearest(spark.createDataFrame(rows, VECTORS), shard_vectors=2500).collect():
        got[r.query_id].add(r.vec_id)
    want = collections.defaultdict(set)
    scores = x[::20] @ x.T
    for q, s in zip(range(0, 5000, 20), scores):
        s[q] = -np.inf
        want[q] = set(np.argsort(-s)[:20].tolist())
    assert all(len(v) == 20 for v in got.values()) and sum(len(got[q] & want[q]) for q in want) / (20 * len(want)) >= 0.95


def test_ties_go_to_the_smallest_ids(spark):
    """More vectors with one product than a walk is wide, in one shard and in several; and equal vectors under many ids."""
    rng = np.random.default_rng(1)
    rows = [(0, [1.0, 0.0, 0.0])] + [(i, [1.0, *rng.normal(size=2).round(6).tolist()]) for i in range(1, 400)]
    for shard in (16384, 100):
        got = sorted((r.rank, r.vec_id) for r in ann.nearest(spark.createDataFrame(rows, VECTORS), query_step=1000, shard_vectors=shard).collect())
        assert got == [(i, i) for i in range(1, 21)]
    same = [(i, [1.0, 2.0]) for i in range(100)] + [(i, [1.0, 2.0 + i / 1000]) for i in range(100, 130)]
    got = ann.nearest(spark.createDataFrame(same, VECTORS)).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == sorted(w[:3] for w in neighbours_by_hand(same, 20, 20))


def test_vectors_of_all_sizes(spark):
    """Products that overflow, vectors of two lengths, one vector far longer than the rest."""
    huge = [(0, [1e200, 1e200]), (1, [1e200, 1.0]), (2, [1e200, -1e200]), (3, [1.0, 1.0]), (4, [-1e200, 0.0]), (5, [1e-200, 1e-200]), (20, [1.0, 2.0, 3.0]), (21, [1.0, 1.0, 1.0])]
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest(spark.createDataFrame(huge, VECTORS)).collect())
    assert [g[:3] for g in got] == [(0, 1, 1), (0, 2, 3), (0, 3, 5), (0, 4, 2), (0, 5, 4), (20, 1, 21)]
    assert got[0][3] == math.inf and math.isnan(got[3][3]) and got[4][3] == -math.inf and got[5][3] == 6.0
    rng = np.random.default_rng(9)
    x = rng.normal(size=(2000, 16)) * rng.uniform(0.5, 2, (2000, 1))
    x[7], x[8] = x[7] * 1e4, x[8] * 1e9
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    found = collections.defaultdict(set)
    for r in ann.nearest(spark.createDataFrame(rows, VECTORS)).collect():
        found[r.query_id].add(r.vec_id)
    scores, right = x[::20] @ x.T, 0
    for q, s in zip(range(0, 2000, 20), scores):
        s[q] = -np.inf
        right += len(found[q] & set(np.argsort(-s)[:20].tolist()))
    assert right / 2000 >= 0.95


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as cp

    rng = random.Random(5)
    vocab = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in ("n", "r", "st", "l")]
    words = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(words(20))) for i in range(3)]
    clean = [(i, " ".join(words(60)), "en", f"s{i % 3}", 0) for i in range(150)]
    junk = [(300 + i, " ".join(w.upper() + "!!" for w in words(50)), "en", "s0", 0) for i in range(50)]
    copies = [(400 + i, clean[7][1] if i % 2 else clean[7][1].replace(clean[7][1].split()[3], "zzz", 1), "en", "s1", 0) for i in range(20)]
    leaks = [(500 + i, " ".join(words(20)) + " " + items[i][1] + " end", "en", "s2", 0) for i in range(3)]
    docs = clean + junk + copies + leaks + [(600, None, None, None, None), (601, "", "en", "s0", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(d[0], int(d[0] < 300), 0) for d in clean + junk], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept, at = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        at = cp.staged(stage(spark, at, str(tmp_path)), "t")
        assert at.columns == schema.replace(" long", "").replace(" string", "").split(", ")
        kept[name] = [r.doc_id for r in at.collect()]
    ids = {d[0] for d in clean}
    assert ids <= set(kept["quality"]) and not {d[0] for d in junk} & set(kept["quality"])
    assert ids <= set(kept["near duplicates"]) and not {d[0] for d in copies} & set(kept["near duplicates"])
    assert ids <= set(kept["decontamination"]) and not {d[0] for d in leaks} & set(kept["decontamination"])
    assert ids <= set(kept["mixing"]) and max(collections.Counter(kept["mixing"]).values()) <= 4
    placed = cp.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in placed) == sorted(kept["mixing"])


def test_pipeline_over_odd_tables(spark, tmp_path, monkeypatch):
    """Empty tables, clashing columns, very long texts, and a budget that leaves documents out."""
    import corpus_pipeline as cp

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    clash = {c: F.lit("x") for c in ("row", "_row", "component_id", "_mix_round", "_mix_key", "score", "shard", "slot", "copies", "weight", "item_id")}
    items = spark.createDataFrame([(1, " ".join(f"i{k}" for k in range(20)))], "item_id long, text string")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    good = " ".join(f"w{k}" for k in range(60))
    rows = [(i, f"{good} d{i} e{i} f{i} g{i} h{i} " * 3 if i % 2 else "XX!! " * 40, "en", f"s{i % 3}", 0) for i in range(60)]
    rows += [(100, " ".join(f"l{k % 9000}" for k in range(60_000)), "en", "s0", 0), (None, good, None, None, None), (101, None, None, None, None), (102, "", "", "", 0)]
    for table in (spark.createDataFrame([], schema), spark.createDataFrame(rows, schema)):
        docs, n = table.withColumns(clash), table.count()
        for _, stage in cp.STAGES[:-1]:
            docs = cp.staged(stage(spark, docs, str(tmp_path)), "t")
            assert docs.columns == [*schema.replace(" long", "").replace(" string", "").split(", "), *clash]
        placed = cp.sharded(spark, docs, str(tmp_path))
        assert placed.count() == docs.count() and (docs.count() > 0) == (n > 0)
    monkeypatch.setattr(cp, "TOKEN_BUDGET", 0.5)
    fair = spark.createDataFrame([(i, "a b c d", "en", "big" if i < 800 else "small", 0) for i in range(1000)], schema)
    taken = collections.Counter(r.source for r in cp.mixed_sources(spark, fair, str(tmp_path)).collect())
    assert taken["big"] < 400 and taken["small"] > 100 and abs(sum(taken.values()) - 500) <= 2


def test_pipeline_keeps_one_row_of_a_repeated_id(spark, tmp_path):
    import corpus_pipeline as cp

    rows = [(1, "a b c d e f g", "s"), (1, "a b c d e f g", "s"), (2, "x y z", "s"), (2, "k l m n o", "s"), (None, "q", "s")]
    got = cp.one_of_each(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), str(tmp_path)).collect()
    assert sorted(map(str, (r.text for r in got))) == ["a b c d e f g", "k l m n o", "q", "x y z"]
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert cp.one_of_each(spark, empty, str(tmp_path)).count() == 0 and cp.mixed_sources(spark, empty, str(tmp_path)).count() == 0


def test_pipeline_keeps_unlike_texts_of_a_repeated_id(spark, tmp_path):
    import corpus_pipeline as cp

    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long, "s"), (1, long, "s"), (1, long + " end", "t"), (2, "a b c d e f g", "s"), (2, "k l m n o p q", "t"), (3, "k l m n o p q", "s")]
    rows += [(4, None, "s"), (4, "", "s"), (4, "r s t u v w x", "s"), (5, "", "s"), (None, long, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = cp.one_of_each(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    kept = [(r.doc_id, r.text or "") for r in got.collect()]
    assert kept.count((None, long)) == 1 and sum(k[0] == 1 for k in kept) == 1 and sum(k == (4, "") for k in kept) == 1
    assert sorted(k for k in kept if k[0] and k[0] != 1) == [(2, "a b c d e f g"), (2, "k l m n o p q"), (4, ""), (4, "r s t u v w x"), (5, "")]

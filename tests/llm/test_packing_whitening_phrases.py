"""Packing, whitening and phrases against plain loops, and their edge cases."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnloom.llm import packing, phrases, whitening
from turnloom.llm.common import staged

SF = "/root/testdata/sf0.001"


# ---- packing ----


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.VOCABULARY)


def test_units_have_the_ids_of_whole_texts(tokenizer):
    encode, rng = packing.UnitEncoder(packing.VOCABULARY), random.Random(3)
    parts = ["a", "The", "word", "'", "'s", "re", " ", "  ", "\n", "\t", "\r", "\x1c", "\x85", "\xa0", "　", "᠎", "​", "﻿", "1", "23", "!", "?", ".", "é", "漢字", "<|endoftext|>", "\U0001f600", "́"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(4000)] + ["x" * 5000, " ".join(["lorem."] * 3000), "é" * 700 + ". " + "à b. " * 50]
    for text in texts:
        assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_new_units_of_a_text_are_tokenized_as_one(tokenizer):
    """Units with digits, marks and line feeds, too, and each once; only white space at a unit's end or within it takes it apart from the others."""
    encode, sent = packing.UnitEncoder(packing.VOCABULARY), []
    encode.encoded = lambda units, plain=encode.encoded: sent.extend(units) or plain(units)
    text = "First one, two22 oi.\nLes %%% don't one, café\n\nAnd the rest."
    for odd in ("", " \n x", " end \n", "  twice", "\u200b space "):
        expected = np.array(tokenizer.encode(text + odd, add_special_tokens=False).ids, "<u4").tobytes()
        assert encode(text + odd) == encode(text + odd) == expected
        if not odd:
            assert sent == ["First"]


def test_forgetting_units_changes_nothing(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "MEMORY", 5)
    encode = packing.UnitEncoder(packing.VOCABULARY)
    for text in ("one two three, four five six. seven", "one two, three!", "", "seven one"):
        assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_fullest_combination_is_found():
    rng = random.Random(5)
    for _ in range(300):
        counts = Counter(rng.randint(1, 30) for _ in range(rng.randint(0, 9)))
        room, items = rng.randint(0, 60), list(counts.elements())
        best = max(sum(c) for k in range(len(items) + 1) for c in combinations(items, k) if sum(c) <= room)
        taken = packing.fullest(dict(counts), room)
        assert sum(n * k for n, k in taken.items()) == best and all(k <= counts[n] for n, k in taken.items())


def test_bins_taken_at_once_are_those_taken_one_by_one():
    rng = random.Random(6)
    for _ in range(60):
        counts = Counter(rng.choice((3, 7, 7, 7, 12, 20, 31, 40)) for _ in range(rng.randint(1, 80)))
        left, one_by_one = Counter(counts), []
        while left:
            longest = max(left)
            left[longest] -= 1
            taken = packing.fullest({n: c for n, c in left.items() if c}, 40 - longest)
            taken[longest] = taken.get(longest, 0) + 1
            left[longest] += 1
            left = +(left - Counter(taken))
            one_by_one.append(tuple(sorted(taken.items())))
        at_once = [tuple(sorted(t.items())) for times, t in packing.bins(dict(counts), 40) for _ in range(times)]
        assert at_once == one_by_one


def _packed_rightly(rows, capacity):
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in held.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= capacity
    return len(held)


def test_whole_table_is_packed_into_hardly_more_sequences_than_its_tokens_fill(spark, tokenizer):
    rows = packing.op11_packing(spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    pieces = defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
    assert pieces.keys() == texts.keys()
    total = 0
    for doc_id, text in texts.items():
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        own, start = sorted(pieces[doc_id], key=lambda r: r["piece"]), 0
        lengths = [len(ids) % 2048] * (len(ids) % 2048 > 0) + [2048] * (len(ids) // 2048)
        assert [r["length"] for r in own] == lengths and [r["piece"] for r in own] == list(range(len(own)))
        for r in own:
            assert r["start"] == start and r["ids_crc32"] == zlib.crc32(ids[start : start + r["length"]].tobytes())
            start += r["length"]
        total += len(ids)
    # No packing needs fewer than all tokens fill; the last bins are of what is left.
    assert _packed_rightly(rows, 2048) <= -(-total // 2048) + 1


def test_packed_sequences_hold_all_tokens(spark, tokenizer):
    words = "alpha beta gamma delta epsilon"
    docs = [(i, " ".join(words.split()[: 1 + i % 5] * (1 + i % 7)), "x") for i in range(60)] + [(7, "same id", "y"), (7, "same id", "y"), (None, None, None), (90, "", ""), (91, "long " * 300, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string, length string").repartition(5)
    packed = staged(packing.pack(staged(packing.tokenized(df, capacity=64, keep_ids=True), "p"), 64), "packed")
    rows = packed.collect()
    assert _packed_rightly(rows, 64) == packed.select("sequence_id").distinct().count()
    sequences = {r["sequence_id"]: r["ids"] for r in packing.sequences(packed).collect()}
    by_doc = defaultdict(list)
    for r in rows:
        assert sequences[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == r["ids"]
        by_doc[r["doc_id"]].append(r)
    for doc_id, text, _ in docs:
        if doc_id != 7:
            got = [i for r in sorted(by_doc[doc_id], key=lambda r: r["start"]) for i in r["ids"]]
            assert got == tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
    assert len(by_doc[7]) == 3


def test_nothing_is_packed_into_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(staged(packing.tokenized(df), "p")).collect() == []


# ---- whitening ----


def _whitened_plainly(rows, k):
    """n, exact deviations, eigenvalues, trace and projections by the definition, in exact whole numbers where it asks for them."""
    x = [[math.floor(1024 * c) + 100000 for c in v] for _, v in rows]
    n, s = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * c - t) ** 2 for c, t in zip(row, s)) for row in x]
    centred = np.array([[(n * c - t) / n for c, t in zip(row, s)] for row in x])
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:k]
    return n, deviation, values[order], float(np.trace(cov)), centred @ vectors[:, order] / np.sqrt(values[order])


def test_whole_table_is_whitened(spark):
    source = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    rows = [(r[0], r[1]) for r in source if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]
    n, deviation, values, trace, white = _whitened_plainly(rows, 8)
    got = defaultdict(dict)
    for r in whitening.op12_whitening(spark, SF).collect():
        got[r["vec_id"]][r["component"]] = r
        assert r["n"] == n and r["identity_error"] <= 1e-9
    assert got.keys() == {i for i, _ in rows}
    sign = np.sign(white[0]) * np.sign([got[rows[0][0]][k]["whitened"] for k in range(1, 9)])
    for (vec_id, _), d, w in zip(rows, deviation, white):
        own = [got[vec_id][k] for k in range(1, 9)]
        assert {r["deviation"] for r in own} == {d}
        assert np.allclose([r["whitened"] for r in own] * sign, w, atol=1e-8)
        assert np.allclose([r["explained"] for r in own], values / trace, rtol=1e-9)


def test_merge_is_that_of_one_list():
    rng = np.random.default_rng(2)
    x = rng.integers(-(10**6), 10**6, (500, 7)).astype(float) + 1e9
    whole = whitening.summary(x, whitening.exact_sums(x.astype(np.int64)))
    parts = [whitening.summary(p, whitening.exact_sums(p.astype(np.int64))) for p in np.split(x, [1, 2, 90, 300])]
    got = parts[0]
    for p in parts[1:]:
        got = whitening.merged(got, p)
    assert got[:2] == whole[:2] and np.allclose(got[2], whole[2], rtol=1e-15) and np.allclose(got[3], whole[3], rtol=1e-12)


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(i % 5), float(i % 3), 0.5], "x") for i in range(30)]
    rows += [(30, None, ""), (31, [1.0, nan, 0.0], ""), (32, [inf, 0.0, 0.0], ""), (33, [None, 1.0, 1.0], ""), (34, [], ""), (None, [9.0, 9.0, 0.5], "")]
    rows += [(2, [2.0, 2.0, 0.5], "again"), (40, [1.0, 2.0], "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, whitened string").repartition(4)
    got = whitening.whiten(df).collect()
    by = defaultdict(list)
    for r in got:
        by[r["vec_id"]].append(r)
    assert set(by) == {*range(30), None, 40} and len(by[2]) == 6 and len(by[0]) == 3
    assert {r["n"] for i, rs in by.items() if i != 40 for r in rs} == {32}
    constant = [r for r in got if r["component"] == 3]
    assert all(r["whitened"] is None and r["explained"] < 1e-12 for r in constant)
    assert all(r["whitened"] is not None and r["identity_error"] < 1e-9 for r in got if r["vec_id"] != 40 and r["component"] < 3)
    alone = by[40]
    assert len(alone) == 2 and all(r["n"] == 1 and r["deviation"] == 0 and r["whitened"] is None and r["explained"] is None and r["identity_error"] is None for r in alone)
    assert whitening.whiten(df.limit(0)).collect() == []


def test_deviations_beyond_64_bits(spark):
    rows = [(i, [1e9 * i, 1.0]) for i in range(40)] + [(40, [1e300, 0.0])]
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("component = 1").collect()}
    x = [[min(math.floor(1024 * c), 2**53) + 100000 for c in v] for _, v in rows]
    s = [sum(c) for c in zip(*x)]
    assert {i: (None if d is None else int(d)) for i, d in got.items()} == {i: sum((41 * c - t) ** 2 for c, t in zip(v, s)) for (i, _), v in zip(rows, x)}


# ---- phrases ----


def _phrases_plainly(docs, least, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, 5):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, count in f.items():
        longer = defaultdict(int)
        found = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i : i + k]] = max(longer[p[i : i + k]], a)
        rows = []
        for p, a in found.items():
            if 100 * longer[p] < 80 * a:
                score, _, l, r = min((2000000 * a // (count[p[:k]] + count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def _rows(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def _odd_documents():
    rng = random.Random(9)
    words = ["The", "the", "cat", "sat", "on", "a", "mat", "\x01", "b\x01", "été", "漢", "\U0001f600", "\xa0", "x\xffy"]
    docs = [(rng.choice(["en", "fr", None, "und"]), "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ", "]) for _ in range(rng.randint(0, 60)))) for _ in range(200)]
    return docs + [("en", "the old cat " * 400), ("en", None), ("fr", ""), (None, "!?"), ("de", "word " * 29), ("en", "w" * 5000)]


@pytest.mark.parametrize("hot, run_words, held", [(10_000, 400_000, 400_000), (3, 50, 7)])
def test_phrases_of_odd_texts(spark, monkeypatch, hot, run_words, held):
    """With small limits first words are dealt out, texts are taken in many runs and counts are handed on early."""
    monkeypatch.setattr(phrases, "HOT", hot)
    monkeypatch.setattr(phrases, "RUN_WORDS", run_words)
    monkeypatch.setattr(phrases, "HELD", held)
    docs = _odd_documents()
    df = spark.createDataFrame([(i, *d, 1) for i, d in enumerate(docs)], "doc_id long, lang string, text string, n int").repartition(3)
    for least, top in ((30, 2000), (2, 40)):
        assert _rows(phrases.collocations(df, least=least, top=top)) == _phrases_plainly(docs, least, top)


def test_a_full_screen_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(phrases, "screen_of", lambda frequent: phrases.Screen(np.full(4096, 255, np.uint8)))
    docs = _odd_documents()
    df = spark.createDataFrame([(i, *d) for i, d in enumerate(docs)], "doc_id long, lang string, text string")
    assert _rows(phrases.collocations(df, least=5)) == _phrases_plainly(docs, 5, 2000)


def test_screen_has_what_was_put_in(spark):
    values = [0, 1, -1, 2**62, -(2**63), 12345678901]
    hashes = staged(spark.createDataFrame([(v,) for v in values], "hash long"), "hashes")
    screen = phrases.screen_of(hashes)
    assert screen.has(np.array(values, np.int64).view(np.uint64)).all()
    others = np.random.default_rng(1).integers(0, 2**63, 1000).astype(np.uint64)
    assert screen.has(others).mean() < 0.01


def test_each_different_word_of_a_run_is_hashed_once(monkeypatch):
    hashed, plain = [], phrases.hashes_of
    monkeypatch.setattr(phrases, "hashes_of", lambda words: hashed.extend(words) or plain(words))
    words = [b"a", b"b", b"a", phrases.GAP, b"a", b"b"]
    gaps, (h, pairs) = phrases.grams("en", *phrases.coded(words), 2)
    assert hashed == [b"a", b"b", phrases.GAP] and gaps.tolist() == [w == phrases.GAP for w in words]
    assert h[0] == h[2] == h[4] != h[1] == h[5] and pairs[0] == pairs[4] != pairs[1]


@pytest.mark.parametrize("most", [3, 1 << 17, 1 << 40])
def test_different_rows_are_told_apart_exactly(most):
    rng = np.random.default_rng(6)
    rows = rng.choice([-1, 0, 1, most - 2, most - 1], (500, 4))
    columns, n = phrases.different_rows(list(rows.T), most)
    assert dict(zip(zip(*(c.tolist() for c in columns)), n.tolist())) == Counter(map(tuple, rows.tolist()))


def test_words_of_a_long_text_in_stretches(monkeypatch):
    text = "One two,three\tfour. " * 50
    whole = [w for part in phrases.words_and_gaps(text) for w in part]
    monkeypatch.setattr(phrases, "STRETCH", 7)
    assert [w for part in phrases.words_and_gaps(text) for w in part] == whole


def test_no_phrases_in_no_texts(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []

"""Toxicity by cumulative-link ordinal regression.

Severity has GRADES ordered grades. The labels only tell toxic from clean, so the grades of the training rows come from
them: a clean row has grade 0; a toxic one has 1, 2 or 3 as the number of different words of toxic vocabulary in it (words that
stand in toxic training rows MARKED times as often as in clean ones) lies in the lower, middle or upper third of the toxic rows'.

The model is P(grade > k) = sigmoid(w . x - b_k), one weight vector w for all thresholds b_0 <= b_1 <= b_2, fitted by
gradient descent (Adam) on the log-likelihood of the grades with a small L2 penalty, toxic and clean rows weighing the same in
all. x has a 1 for each term that occurs in
the text: words, and the beginnings of words in four to six letters, since a stem may take many
endings (a beginning that one word mostly makes up is left to that word). Only terms enter
the model whose rates in toxic and in clean training rows differ LIFT times and by LEAST_Z standard errors, MOST_TERMS
at most; their names are kept, not hashes, so that no other word of a large corpus falls on them. Expected severity is the sum of
P(grade > k), and a text counts as toxic where P(grade > 0) is 0.5 or more.

At most SAMPLE labelled rows are learned from (see quality.sample_rows: those with crc32(doc_id as text) modulo 5
not 0). Texts become counts of their words where they lie; only those meet in the one task that fits, and only the model
comes to the driver. So the fit is bounded at any size of the corpus.

Defined results: null and empty texts have no features and the severity of the thresholds alone. Without labels all
texts have severity 0. Repeated rows are scored alike; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import hashes_of, mixed, rolling, text_rows, words_of
from turnloom.llm.quality import ORDER, held_out, in_order, sample_rows

SAMPLE = 6000
GRADES = 4
MARKED = 8.0
LIFT, LEAST_Z, LEAST_ROWS, MOST_TERMS = 8.0, 5.0, 10, 5000
STEPS, RATE, PENALTY = 600, 0.2, 1e-4
_WORD = re.compile(r"\w+")


def words_in(text: str | None) -> Counter:
    """The lower-cased words and how often each occurs."""
    return Counter(_WORD.findall(text.lower())) if text else Counter()


def terms_of(words: Counter) -> set[str]:
    """The distinct words, and their beginnings of four to six letters, marked by ^."""
    return set(words) | {f"^{w[:n]}" for w in words for n in (4, 5, 6) if len(w) > n}


def severity_grades(rows: list[Counter], toxic: np.ndarray) -> np.ndarray:
    """0 for clean rows, 1 to GRADES - 1 for toxic ones by thirds of how many words of toxic vocabulary they hold."""
    bad = Counter(w for words, y in zip(rows, toxic) if y for w in words)
    often = {w: 0 for w, c in bad.items() if c >= 5}
    for words, y in zip(rows, toxic):
        if not y:
            for w in words.keys() & often.keys():
                often[w] += 1
    n = [max(1, int((toxic == y).sum())) for y in (0, 1)]
    marked = {w for w, c in often.items() if bad[w] / n[1] >= MARKED * (c + 1) / n[0]}
    held = np.array([len(marked & words.keys()) if y else 0 for words, y in zip(rows, toxic)])
    edges = np.quantile(held[toxic == 1], np.arange(1, GRADES - 1) / (GRADES - 1)) if (toxic == 1).any() else np.zeros(GRADES - 2)
    return np.where(toxic == 1, 1 + np.searchsorted(edges, held, "left"), 0)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Model:
    weights: dict[str, float]
    thresholds: np.ndarray  # rising

    def above(self, text: str | None) -> np.ndarray:
        """P(grade > k) for each k."""
        get, z = self.weights.get, 0.0
        words = set(_WORD.findall(text.lower())) if text and self.weights else ()
        begun = set()
        for w in words:
            z += get(w, 0.0)
            n = len(w)
            if n > 4:
                begun.add("^" + w[:4])
                if n > 5:
                    begun.add("^" + w[:5])
                    if n > 6:
                        begun.add("^" + w[:6])
        for b in begun:
            z += get(b, 0.0)
        return _sigmoid(z - self.thresholds)


def marks_of(text: str | None) -> list[int]:
    """Four minima of hashed three-word runs, which near copies have in common; of a text without runs the hash of the text."""
    runs = rolling(hashes_of(words_of(text)), 3)
    if not len(runs):
        return [xxhash.xxh3_64_intdigest((text or "").encode()) >> 1]
    return [int(mixed(mixed(runs ^ np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)).min(keepdims=True) + np.uint64(k))[0] >> np.uint64(1)) for k in range(4)]


def unlike(marks: list[list[int]]) -> list[int]:
    """Indices of the texts that are not copies or near copies of earlier ones, so that these don't pass their words off as telling.

    A text that has a mark in common with an earlier one is left out.
    """
    seen, keep = set(), []
    for i, own in enumerate(marks):
        if seen.isdisjoint(own):
            keep.append(i)
        seen.update(own)
    return keep


def hashed_terms(words: Counter) -> np.ndarray:
    terms = terms_of(words)
    return np.fromiter(map(xxhash.xxh64_intdigest, terms), np.uint64, len(terms))


def telling_terms(texts: list[Counter], rows: list[np.ndarray], toxic: np.ndarray) -> list[str]:
    """Terms that tell toxic texts from clean ones, the surest first. rows: the hashed terms of each text."""
    none = [np.empty(0, np.uint64)]
    clean, bad = (np.concatenate(none + [r for r, y in zip(rows, toxic) if y == k]) for k in (0, 1))
    n = [max(1, int((toxic == y).sum())) for y in (0, 1)]
    marks, b = np.unique(bad, return_counts=True)
    known, a = np.unique(clean, return_counts=True)
    all_ = np.union1d(marks, known)
    count = np.zeros((2, len(all_)))
    count[1, np.searchsorted(all_, marks)], count[0, np.searchsorted(all_, known)] = b, a
    p, q, both = count[1] / n[1], count[0] / n[0], count.sum(axis=0) / sum(n)
    z = (p - q) / np.maximum(1e-9, np.sqrt(both * (1 - both) * (1 / n[0] + 1 / n[1])))
    ok = (count.sum(axis=0) >= min(LEAST_ROWS, max(8, n[1] // 20))) & (np.abs(z) >= LEAST_Z) & (np.maximum(p, q) >= LIFT * np.minimum(p, q))
    sure, rate = dict(zip(all_[ok].tolist(), np.abs(z[ok]).tolist())), dict(zip(marks.tolist(), b.tolist()))
    named, fullest = {}, Counter()  # fullest: the most toxic rows that one word gives a beginning
    for text in texts:
        for t in terms_of(text):
            if (h := xxhash.xxh64_intdigest(t)) in sure:
                named[t] = h
            if t[0] != "^" and h in rate:
                for k in (4, 5, 6):
                    fullest[f"^{t[:k]}"] = max(fullest[f"^{t[:k]}"], rate[h]) if xxhash.xxh64_intdigest(f"^{t[:k]}") in sure else 0
    kept = [t for t, h in named.items() if t[0] != "^" or 2 * fullest[t] <= rate.get(h, 0) or h not in rate]
    return sorted(kept, key=lambda t: (-sure[named[t]], t))[:MOST_TERMS]


def fit(texts: list[Counter], marks: list[list[int]], toxic: list[int]) -> Model:
    """The model of labelled texts, given by their words and marks."""
    keep, far = unlike(marks), np.arange(GRADES - 1) + 40.0
    texts, y = [texts[i] for i in keep], np.array([toxic[i] for i in keep], np.int64).clip(0, 1)
    if not len(y) or not y.any():
        return Model({}, far)
    rows, grades = [hashed_terms(t) for t in texts], severity_grades(texts, y)
    names = telling_terms(texts, rows, y)
    column = {xxhash.xxh64_intdigest(t): i for i, t in enumerate(names)}
    hits = [np.array(sorted(column[t] for t in r.tolist() if t in column), np.int64) for r in rows]
    flat, of = np.concatenate(hits), np.repeat(np.arange(len(hits)), [len(h) for h in hits])
    share = np.array([np.clip((grades > k).mean(), 1e-3, 1 - 1e-3) for k in range(GRADES - 1)])
    w, b = np.zeros(len(names)), np.maximum.accumulate(np.log((1 - share) / share) + np.arange(GRADES - 1) * 1e-3)
    state = [(x, np.zeros_like(x), np.zeros_like(x)) for x in (w, b)]
    row, parts = np.arange(len(y)), np.where(y == 1, (y == 0).sum() / y.sum() if (y == 0).any() else 1.0, 1.0)
    parts = parts / parts.sum()
    for step in range(1, STEPS + 1):
        s = _sigmoid(np.bincount(of, w[flat], len(y))[:, None] - b)
        s = np.concatenate([np.ones((len(y), 1)), s, np.zeros((len(y), 1))], axis=1)
        # P(grade = g) is s[g] - s[g + 1]; the slope of its logarithm in w . x is 1 - s[g] - s[g + 1].
        slope = 1 - s[row, grades] - s[row, grades + 1]
        each = (parts / np.maximum(s[row, grades] - s[row, grades + 1], 1e-9))[:, None] * s * (1 - s)
        db = np.array([each[grades == k + 1, k + 1].sum() - each[grades == k, k + 1].sum() for k in range(GRADES - 1)])
        dw = -np.bincount(flat, (parts * slope)[of], len(names)) + PENALTY * w
        for (x, m, v), d in zip(state, (dw, db)):
            m += 0.1 * (d - m)
            v += 0.01 * (d * d - v)
            x -= RATE / (1 + step / 40) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        b[:] = np.maximum.accumulate(b)
    return Model({t: float(x) for t, x in zip(names, w) if x}, b)


def _score(shared):
    def score(batches):
        model = shared.value
        for batch in batches:
            above = np.array([model.above(t) for t in text_rows(batch)]).reshape(batch.num_rows, GRADES - 1)
            grade = (above >= 0.5).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(above.sum(axis=1)), pa.array(grade, pa.int32()), pa.array(above[:, 0])],
                ["doc_id", "severity", "grade", "p_toxic"],
            )

    return score


def _counts(batches):
    for batch in batches:
        rows = [(words_in(text), marks_of(text)) for text in text_rows(batch)]
        arrays = [
            pa.array([list(w) for w, _ in rows], pa.list_(pa.string())), pa.array([list(w.values()) for w, _ in rows], pa.list_(pa.int32())),
            pa.array([m for _, m in rows], pa.list_(pa.int64())), *batch.columns[1:],
        ]
        yield pa.RecordBatch.from_arrays(arrays, ["words", "counts", "marks", *ORDER])


def _fit_task(batches):
    """The model of all rows of one task, pickled."""
    rows = in_order(batches)
    model = fit([Counter(dict(zip(r["words"], r["counts"]))) for r in rows], [r["marks"] for r in rows], [r["label"] for r in rows])
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])


def toxicity_model(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fitted in one task over the words of the bounded sample; only the model comes to the driver."""
    rows = sample_rows(docs, labels, "toxic", sample, _counts, "words array<string>, counts array<int>, marks array<long>")
    fitted = rows.coalesce(1).mapInArrow(_fit_task, "model binary").first()
    return pickle.loads(bytes(fitted.model)) if fitted else fit([], [], [])


def toxicity_scores(docs: DataFrame, model: Model) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, held_out, severity (expected), grade, p_toxic, toxic (0 or 1)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = rows.mapInArrow(_score(shared), "doc_id long, severity double, grade int, p_toxic double")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "severity", "grade", "p_toxic", (F.col("grade") > 0).cast("int").alias("toxic")
    )


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity_scores(docs, toxicity_model(docs, labels))

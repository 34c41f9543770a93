"""Quality by nearest-neighbour voting in a latent-semantic space.

Fitting: of the labelled rows whose crc32(doc_id as text) modulo 5 isn't 0, those SAMPLE rows whose ids have the
smallest hashes (all, if there are fewer) are turned into sparse vectors of hashed words and word shapes
(text_features), weighted by inverse document frequency, and projected on the DIMENSIONS leading right singular vectors
of their matrix. The model is that projection, the sample's unit vectors there and their labels: at most a few MB at
any size of the corpus, sent to the executors by broadcast. Texts become sparse vectors where they lie; only those meet in the
one task that fits.

Scoring: every text, whole, is projected likewise, and its cosines with all labelled vectors are computed exactly, a
block of documents at a time. The NEIGHBOURS nearest vote with their labels, each weighted by cosine ** SHARPNESS; of
equally near ones those that come first in the sample's order (hash of the id, then id and label). The score is the weighted mean, 0 to 1. Only the text enters it.

Defined results: null and empty texts have vectors too (they are short), so they are scored like others. Where no
neighbour has a positive cosine, or no row is labelled, the score is the mean label, or 0.5. Rows with null labels or
ids aren't learned from; of several labels of a document each counts. Repeated rows are scored alike; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import list_array, text_rows
from turnloom.llm.text_features import SHAPES, WORDS, features

SAMPLE = 2000
DIMENSIONS = 64
NEIGHBOURS = 15
SHARPNESS = 4
WORD_WEIGHT = 0.4
THRESHOLD = 0.3
BLOCK = 256
LEAST_VALUE = 1e-6  # of an eigenvalue, as a part of the largest


@dataclass
class Model:
    projection: np.ndarray  # columns by DIMENSIONS
    vectors: np.ndarray  # sample by DIMENSIONS, of length 1
    labels: np.ndarray
    prior: float

    def vector(self, text: str | None) -> np.ndarray:
        columns, values = features(text)
        v = values.astype(np.float32) @ self.projection[columns]
        return v / (np.linalg.norm(v) or 1.0)

    def scores(self, vectors: np.ndarray) -> np.ndarray:
        """Votes for a block of vectors."""
        if not len(self.labels):
            return np.full(len(vectors), self.prior)
        cosines = vectors @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        least = np.take_along_axis(cosines, near, axis=1).min(axis=1)
        tied = np.flatnonzero((cosines >= least[:, None]).sum(axis=1) > k)
        near[tied] = np.argsort(-cosines[tied], axis=1, kind="stable")[:, :k]
        weight = np.maximum(np.take_along_axis(cosines, near, axis=1), 0).astype(np.float64) ** SHARPNESS
        total = weight.sum(axis=1)
        votes = (weight * self.labels[near]).sum(axis=1)
        return np.where(total > 0, votes / np.where(total > 0, total, 1), self.prior)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> Model:
    """The model of labelled texts, given as columns and values of their features, and label."""
    size = WORDS + SHAPES
    labels = np.array([y for *_, y in rows], np.float64)
    if not rows:
        return Model(np.zeros((size, 1), np.float32), np.zeros((0, 1), np.float32), labels, 0.5)
    matrix = np.zeros((len(rows), size), np.float32)
    for i, (columns, values, _) in enumerate(rows):
        matrix[i, columns] = values
    weight = (np.log((1 + len(rows)) / (1 + (matrix > 0).sum(axis=0))) + 0.1).astype(np.float32)
    weight[:WORDS] *= WORD_WEIGHT
    matrix *= weight
    # The leading right singular vectors, from the eigenvectors of the smaller Gram matrix; fewer, if the rest is rounding.
    values, left = np.linalg.eigh(matrix @ matrix.T)
    k = max(1, min(DIMENSIONS, int((values > LEAST_VALUE * values[-1]).sum())))
    right = matrix.T @ (left[:, ::-1][:, :k] / np.sqrt(np.maximum(values[::-1][:k], 1e-12)))
    projection, vectors = weight[:, None] * right, matrix @ right
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    return Model(projection.astype(np.float32), vectors.astype(np.float32), labels, float(labels.mean()))


def held_out(doc_id):
    """Whether a document's label is kept for testing."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


ORDER = ("place", "doc_id", "label", "digest")


def sample_rows(docs: DataFrame, labels: DataFrame, label: str, size: int, make, columns: str, seed: int = 3) -> DataFrame:
    """At most size labelled rows that may be learned from, as columns made of their texts, and those of ORDER, by which they come.

    They are the same however the tables are cut up. The sample is chosen among the ids before any text is looked at, and make
    works on its texts where they lie.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).distinct()
    there = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    placed = known.withColumn("place", F.xxhash64(F.lit(seed), "doc_id"))
    chosen = placed.join(there.select("doc_id"), "doc_id", "left_semi").orderBy("place", "doc_id", "label").limit(size)
    rows = there.join(F.broadcast(chosen), "doc_id").select("text", "place", "doc_id", "label", F.md5("text").alias("digest"))
    # Ids may be repeated in docs, so the rows may be more again.
    return rows.mapInArrow(make, f"{columns}, place long, doc_id long, label int, digest string").orderBy(*ORDER).limit(size)


def in_order(batches) -> list[dict]:
    return sorted((r for batch in batches for r in batch.to_pylist()), key=lambda r: (*(r[c] for c in ORDER[:3]), r["digest"] or ""))


def _features(batches):
    for batch in batches:
        rows = [features(text) for text in text_rows(batch)]
        made = [list_array([c.astype(np.int32) for c, _ in rows], pa.int32()), list_array([v for _, v in rows], pa.float64())]
        yield pa.RecordBatch.from_arrays([*made, *batch.columns[1:]], ["columns", "values", *ORDER])


def _fit_task(batches):
    """The model of all rows of one task, pickled."""
    model = fit([(np.array(r["columns"], np.int64), np.array(r["values"]), r["label"]) for r in in_order(batches)])
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])


def scores_of(model: Model, texts) -> np.ndarray:
    """Scores of texts, a block at a time."""
    scores, block = [], []
    for text in texts:
        block.append(model.vector(text))
        if len(block) == BLOCK:
            scores.append(model.scores(np.stack(block)))
            block = []
    if block:
        scores.append(model.scores(np.stack(block)))
    return np.clip(np.concatenate(scores), 0, 1) if scores else np.empty(0)


def _score(shared):
    def score(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores_of(shared.value, text_rows(batch)), pa.float64())], ["doc_id", "score"])

    return score


def _keep(shared, threshold: float):
    def keep(batches):
        for batch in batches:
            yield batch.filter(pa.array(scores_of(shared.value, text_rows(batch)) >= threshold, pa.bool_()))

    return keep


def quality_model(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fitted in one task over the bounded sample; only the model comes to the driver."""
    rows = sample_rows(docs, labels, "quality", sample, _features, "columns array<int>, values array<double>")
    fitted = rows.coalesce(1).mapInArrow(_fit_task, "model binary").first()
    return pickle.loads(bytes(fitted.model)) if fitted else fit([])


def quality_scores(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, held_out, score, predicted."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_score(shared), "doc_id long, score double").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs (text and any others) whose score reaches the threshold, in one pass and with all their columns."""
    return docs.mapInArrow(_keep(docs.sparkSession.sparkContext.broadcast(model), threshold), docs.schema)


def op3_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return quality_scores(docs, quality_model(docs, labels))

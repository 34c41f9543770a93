r"""Benchmark decontamination by spaced seeds.

Words are `\w+` of the lower-cased text. A mask such as 11101111 hashes the words of a window that stand at its
ones and ignores the others, so a window with other words at the zeros hashes alike. Test and training windows with
equal hashes under one mask are a hit. Each hit names a diagonal: item and document laid over one another. There
the whole item is compared word by word. A document is contaminated by an item if 80 % of the item's words match there, or if
the stretch with the best sum of +1 for a match and -3 for a substitution (of equal ones that which ends first, the shortest) has
WHOLE matches or more. The overlap that is returned is the item's extent in the first case, else that stretch.

The index of the test set goes to the executors if its seeds number at most INDEX_LIMIT; that is counted
first. A larger test set is joined by hash: both sides' seeds are shuffled, and hot seeds (a phrase of a third of
all documents) are split by the sort-merge join. Both ways give the same rows.

The HEAVY masks miss some placements of the substitutions that the 80 % allow in items of 8-17, 20-22, 25 and 30 words.
Items of up to LIGHT_ITEM words are searched under all MASKS; so each placement in an item of any length has a seed.
Items of fewer than MIN_ITEM words are found where a document holds them whole and unchanged.

Defined results: null and empty texts, items and ids give no rows. Repeated rows give one row for each document and item. Of equally good overlaps the
first in the document, then in the item, is returned. Extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import hashes_of, list_array, mixed, signed, text_rows

HEAVY = ("1111111", "11101111", "110110111", "1101011011")
MASKS = (*HEAVY, "1111", "11011")
LIGHT_ITEM = 30
MIN_ITEM = 8
WHOLE = 13
INDEX_LIMIT = 2_000_000
SUBSTITUTION = 3
_WORD = re.compile(r"\w+")
_FILTER_BITS = 23


def plain_words(text: str | None) -> np.ndarray:
    """Hashes of the words."""
    return hashes_of([w.encode() for w in _WORD.findall(text.lower())]) if text else np.empty(0, np.uint64)


def seeds(hashes: np.ndarray, mask: str) -> np.ndarray:
    """A hash of the unmasked words of each window."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.full(n, int(mask, 2), np.uint64)
    for j, bit in enumerate(mask):
        if bit == "1":
            total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + n]
    return mixed(total)


def masks_of(n: int) -> tuple[str, ...]:
    """The masks under which an item of n words is searched."""
    if n < MIN_ITEM:
        return ("1" * n,) if n else ()
    return MASKS if n <= LIGHT_ITEM else HEAVY


def best_overlap(item: np.ndarray, doc: np.ndarray, shift: int) -> tuple[int, int, int] | None:
    """With doc[shift + i] laid under item[i]: matches, start in the item and length of the overlap; None if it is too small."""
    lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
    same = item[lo:hi] == doc[shift + lo : shift + hi]
    if 5 * (matched := int(same.sum())) >= 4 * len(item):
        at = np.flatnonzero(same)
        return matched, lo + int(at[0]), int(at[-1] - at[0] + 1)
    total = np.concatenate([[0], np.cumsum(np.where(same, 1, -SUBSTITUTION))])
    floor = np.minimum.accumulate(total)
    end = int((total - floor).argmax())
    start = int(np.flatnonzero(total[: end + 1] == floor[end])[-1])
    matched = int(same[start:end].sum())
    return (matched, lo + start, end - start) if matched >= WHOLE else None


class Index:
    """Seeds of a test set with their places, and a bit table that lets most other seeds go by."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.items = items
        found = [
            np.stack([s, np.full(len(s), i, np.uint64), np.arange(len(s), dtype=np.uint64)])
            for i, (_, words) in enumerate(items)
            for mask in masks_of(len(words))
            if len(s := seeds(words, mask))
        ]
        self.masks = sorted({mask for _, words in items for mask in masks_of(len(words))})
        table = np.concatenate(found, axis=1) if found else np.empty((3, 0), np.uint64)
        self.seeds, self.item, self.at = table[:, np.argsort(table[0], kind="stable")]
        self.bits = np.zeros(1 << _FILTER_BITS, bool)
        self.bits[(self.seeds & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)] = True

    def overlaps(self, doc: np.ndarray):
        """item number, (matches, start in the item, length), shift: for each item with enough matches the best."""
        diagonals = set()
        for mask in self.masks:
            s = seeds(doc, mask)
            at = np.flatnonzero(self.bits[(s & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)])
            lo, hi = np.searchsorted(self.seeds, s[at]), np.searchsorted(self.seeds, s[at], "right")
            for p, a, b in zip(at[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist()):
                diagonals.update((int(self.item[k]), p - int(self.at[k])) for k in range(a, b))
        best: dict[int, tuple] = {}
        for item, shift in sorted(diagonals):
            found = best_overlap(self.items[item][1], doc, shift)
            if found and (item not in best or found[0] > best[item][0][0]):
                best[item] = (found, shift)
        return [(item, *x) for item, x in sorted(best.items())]


_NAMES = ["doc_id", "item_id", "matched", "length", "item_words", "doc_start", "item_start"]
_SCHEMA = "doc_id long, item_id long, matched int, length int, item_words int, doc_start int, item_start int"
_KINDS = [pa.int64(), pa.int64(), *[pa.int32()] * 5]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [()] * 7, _KINDS)], _NAMES)


def _search(shared):
    def search(batches):
        index = shared.value
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), text_rows(batch)):
                doc = plain_words(text)
                for item, (matched, start, length), shift in index.overlaps(doc):
                    item_id, words = index.items[item]
                    rows.append((doc_id, item_id, matched, length, len(words), shift + start, start))
            yield _batch(rows)

    return search


def _item_masks(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(sorted({m for text in text_rows(batch) for m in masks_of(len(plain_words(text)))}), pa.string())], ["mask"])


def _seed_rows(masks: list[str] | None):
    """Seeds under masks; None: under those of an item of the text's length."""

    def seed_rows(batches):
        for batch in batches:
            keys, places = [], []
            for text in text_rows(batch):
                words = plain_words(text)
                found = [np.empty(0, np.uint64), *(seeds(words, mask) for mask in (masks_of(len(words)) if masks is None else masks))]
                keys.append(signed(np.concatenate(found)))
                places.append(np.concatenate([np.arange(len(f), dtype=np.int32) for f in found]))
            yield pa.RecordBatch.from_arrays([batch.column(0), list_array(keys, pa.int64()), list_array(places, pa.int32())], ["id", "keys", "places"])

    return seed_rows


def _compare(batches):
    for batch in batches:
        col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        rows = []
        for i, text in enumerate(text_rows(batch)):
            doc, item = plain_words(text), plain_words(col["item_text"][i].as_py())
            found = [(best_overlap(item, doc, shift), shift) for shift in sorted(set(col["shifts"][i].as_py())) if -len(item) < shift < len(doc)]
            found = [x for x in found if x[0]]
            if found:
                (matched, start, length), shift = max(found, key=lambda x: x[0][0])
                rows.append((col["doc_id"][i].as_py(), col["item_id"][i].as_py(), matched, length, len(item), shift + start, start))
        yield _batch(rows)


def contaminated(docs: DataFrame, benchmark: DataFrame, index_limit: int = INDEX_LIMIT) -> DataFrame:
    """Overlaps of docs (doc_id, text) with benchmark (item_id, text), the best of each document and item.

    doc_id, item_id, matched words, length of the overlap, words of the item, and where it starts in both.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null and doc_id is not null")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(
        "text is not null and item_id is not null"
    )
    size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    if len(MASKS) * (size[0] + size[1]) // 2 <= index_limit:  # a word and what parts it from the next are two characters at least
        rows = [(r.item_id, plain_words(r.text)) for r in items.distinct().collect()]
        index = Index(sorted(((i, w) for i, w in rows if len(w)), key=lambda x: (x[0], len(x[1]))))
        found = docs.mapInArrow(_search(docs.sparkSession.sparkContext.broadcast(index)), _SCHEMA)
    else:
        masks = sorted(r.mask for r in items.select("item_id", "text").mapInArrow(_item_masks, "mask string").distinct().collect())
        seed = lambda df, name, masks: df.mapInArrow(_seed_rows(masks), "id long, keys array<long>, places array<int>").select(
            F.col("id").alias(name), F.explode(F.arrays_zip("keys", "places")).alias("s")
        ).select(name, F.col("s.keys").alias("key"), F.col("s.places").alias(f"{name}_at"))
        hits = seed(docs, "doc_id", masks).join(seed(items, "item_id", None), "key")
        shifts = hits.select("doc_id", "item_id", (F.col("doc_id_at") - F.col("item_id_at")).alias("shift")).groupBy("doc_id", "item_id")
        pairs = shifts.agg(F.collect_set("shift").alias("shifts"))
        found = pairs.join(items.withColumnRenamed("text", "item_text"), "item_id").join(docs, "doc_id").mapInArrow(_compare, _SCHEMA)
    best = F.max_by(F.struct(*_NAMES[2:]), F.struct("matched", (-F.col("doc_start")).alias("d"), (-F.col("item_start")).alias("i")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", "best.*")


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))

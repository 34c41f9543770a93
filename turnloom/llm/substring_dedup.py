"""Substring dedup by fixed-block anchors.

A window of `window` words that occurs in two documents covers, wherever the first document's grid stands, one
whole block of `window // 2` words of that grid. So the index holds each document's non-overlapping blocks by hash, with the
smallest doc_id that has them, and every rolling window of block length in every document probes it. A hit is a place in a
document whose next words are a block of an earlier document; for the owner of a block that later documents hit, the block's own place
is one. Hits are extended on both sides to whole windows, and an extended window is a repeat if its 128-bit hash starts in a document
with a smaller doc_id, too. (Equal hashes extend a hit against all owners of its block at once; word by word it would take a pair of
each document with each owner.) The removed words of a document are the union of its repeated windows, that is, its maximal exact
repeats of `window` words and more.

Most rolling windows hit nothing, so they are screened before they are shipped: neighbouring ones mostly share their smallest
inner gram (the leftmost one on ties, so equal windows agree on it), and each run of them asks by that gram alone whether
another text has it. A screen that lets more pass costs time, but changes nothing.

Nothing is paired: a block, gram or window that a third of all documents hold costs a row for each of them.
Grams, blocks and windows are counted by aggregates that combine before the shuffle, and joined back; those that very many rows hold by
broadcast, since there are few of them.

Defined results: null and empty texts have no words, lose none and keep the empty string. Rows with a null doc_id
lose nothing and take nothing from others. Rows with the same doc_id are not smaller than one another. Other
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import digest128, drop_staged, hashes_of, join_counted, list_array, rolling, signed, small_or_not, staged, text_rows, words_of

WINDOW = 50
GRAM = 5
#: Runs or windows of one key beyond which it is joined by broadcast. There are no more such keys than rows over HOT_RUNS.
HOT_RUNS = 10_000
_BASE_A, _BASE_B = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def anchors(n_words: int, hashes: np.ndarray, block: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of rolling windows that share their smallest inner gram: gram hash, first window, holds a grid block."""
    grams = rolling(hashes, gram)
    inner = block - gram + 1
    at = np.lib.stride_tricks.sliding_window_view(grams, inner).argmin(axis=1) + np.arange(n_words - block + 1)
    starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    grid = np.zeros(len(starts), bool)
    grid[np.searchsorted(starts, np.arange(0, n_words - block + 1, block), "right") - 1] = True
    return grams[at[starts]], starts, grid


def candidate_windows(n_words: int, starts: np.ndarray, shared: np.ndarray, hit: np.ndarray, window: int) -> np.ndarray:
    """Windows all of whose rolling windows have a gram that other texts share, one of them at an indexed block."""
    block = window // 2
    lengths = np.diff(np.append(starts, n_words - block + 1))
    count = lambda flags: np.concatenate([[0], np.cumsum(np.repeat(flags, lengths), dtype=np.int64)])
    span = window - block + 1
    s, h = count(shared), count(hit)
    return np.flatnonzero((s[span:] - s[:-span] == span) & (h[span:] - h[:-span] > 0))


def _scan(window: int, gram: int):
    block = window // 2

    def scan(batches):
        for batch in batches:
            ids, cols = batch.column(0), [[] for _ in range(5)]
            keys, starts, grids = [], [], []
            for text in text_rows(batch):
                words = words_of(text)
                joined = b" ".join(words)
                a, b = digest128(joined)
                for col, x in zip(cols, (a, b, len(words), hashlib.sha256(joined).hexdigest(), (a & 0x7FFFFFFF))):
                    col.append(x)
                if len(words) >= window:
                    k, s, g = anchors(len(words), hashes_of(words), block, gram)
                else:
                    k, s, g = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, bool)
                keys.append(signed(k))
                starts.append(s.astype(np.int32))
                grids.append(g)
            yield pa.RecordBatch.from_arrays(
                [ids.cast(pa.int64()), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32()))),
                 list_array(keys, pa.int64()), list_array(starts, pa.int32()), list_array(grids, pa.bool_())],
                ["doc_id", "text_a", "text_b", "n_words", "sha", "tag", "keys", "starts", "grid"],
            )

    return scan


def spots_of(n_words: int, windows: np.ndarray, window: int) -> np.ndarray:
    """Places of the rolling windows of block length that lie in one of `windows`."""
    block = window // 2
    edge = np.zeros(n_words - block + 2, np.int64)
    np.add.at(edge, windows, 1)
    np.add.at(edge, windows + window - block + 1, -1)
    return np.flatnonzero(np.cumsum(edge[:-1]) > 0)


def windows_around(n_words: int, hits: np.ndarray, window: int) -> np.ndarray:
    """Starts of the windows that hold the whole block at one of the hits, which rise."""
    starts = np.arange(n_words - window + 1)
    return starts[np.searchsorted(hits, starts + window - window // 2, "right") > np.searchsorted(hits, starts)]


def _of_text(batch: pa.RecordBatch):
    """Number and words of the rows whose text has their tag; others are other texts under the same doc_id."""
    tags = batch.column(batch.schema.get_field_index("tag")).to_numpy(False)
    for i, text in enumerate(text_rows(batch)):
        words = words_of(text)
        if digest128(b" ".join(words))[0] & 0x7FFFFFFF == tags[i]:
            yield i, words


def _probes(window: int):
    """Hashes of the rolling windows of block length that the screen lets pass."""

    def probes(batches):
        for batch in batches:
            shared, hits, starts = (batch.column(batch.schema.get_field_index(c)) for c in ("shared", "hits", "starts"))
            keep, places, keys = [], [], []
            for i, words in _of_text(batch):
                first = np.asarray(starts[i].values)
                flags = np.zeros((2, len(first)), bool)
                flags[0, np.asarray(shared[i].values)] = True
                flags[1, np.asarray(hits[i].values, dtype=np.int64)] = True
                at = spots_of(len(words), candidate_windows(len(words), first, *flags, window), window)
                if len(at):
                    keep.append(i)
                    places.append(at.astype(np.int32))
                    keys.append(signed(rolling(hashes_of(words), window // 2)[at]))
            rows = pa.array(keep, pa.int64())
            ids, tags = (batch.column(batch.schema.get_field_index(c)).take(rows) for c in ("doc_id", "tag"))
            yield pa.RecordBatch.from_arrays([ids, tags, list_array(places, pa.int32()), list_array(keys, pa.int64())], ["doc_id", "tag", "places", "keys"])

    return probes


def _extended(window: int):
    """Hashes of the whole windows around hits."""

    def extended(batches):
        for batch in batches:
            hits, ids = batch.column(batch.schema.get_field_index("hits")), batch.column(batch.schema.get_field_index("doc_id")).to_numpy(False)
            tags = batch.column(batch.schema.get_field_index("tag")).to_numpy(False)
            out = [[] for _ in range(5)]
            for i, words in _of_text(batch):
                at = windows_around(len(words), np.unique(np.asarray(hits[i].values)), window)
                h = hashes_of(words)
                for col, x in zip(out, (signed(rolling(h, window, _BASE_A)[at]), signed(rolling(h, window, _BASE_B)[at]), np.full(len(at), ids[i]), at, np.full(len(at), tags[i]))):
                    col.append(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x) if x else [], t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()))],
                ["hash_a", "hash_b", "doc_id", "at", "tag"],
            )

    return extended


def kept_words(words: list[bytes], windows: np.ndarray, window: int) -> list[bytes]:
    """What stays when every word in a window that starts at one of `windows` goes."""
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, windows, 1)
    np.add.at(edge, windows + window, -1)
    gone = np.cumsum(edge[:-1]) > 0
    return [w for w, g in zip(words, gone.tolist()) if not g]


def _cut(window: int, keep_text: bool):
    def cut(batches):
        for batch in batches:
            index = {n: i for i, n in enumerate(batch.schema.names)}
            out = [[] for _ in range(5)]
            at, tags = batch.column(index["at"]), batch.column(index["tag"]).to_numpy(False)
            ids = batch.column(index["doc_id"]).to_numpy(False)
            for i, words in _of_text(batch):
                kept = kept_words(words, np.unique(np.asarray(at[i].values)), window)
                joined = b" ".join(kept)
                for col, x in zip(out, (ids[i], tags[i], len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode() if keep_text else None)):
                    col.append(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string()))],
                ["doc_id", "tag", "cut_words", "cut_sha", "cut_text"],
            )

    return cut


def block_hits(probes: DataFrame, block: int) -> DataFrame:
    """The hits among probes (doc_id, tag, at, key), rolling windows of block words at a place of a document, with the block's owner.

    Those at multiples of block are the index. A probe hits if a document with a smaller id owns its block, and a block of the
    index is a hit itself if a document with a greater id probes it.
    """
    indexed = F.col("at") % block == 0
    index = probes.groupBy("key").agg(F.min(F.when(indexed, F.col("doc_id"))).alias("owner"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n"))
    found = join_counted(probes, staged(index.where("owner < last"), "blocks"), "key")
    return found.where((F.col("owner") < F.col("doc_id")) | (indexed & (F.col("doc_id") < F.col("last")))).select("doc_id", "tag", "at", "owner")


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, keep_text: bool = False) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, n_words, n_removed, kept_sha256, and with keep_text kept_text.

    kept_text is null where nothing goes (the text stands) and for an exact copy of an earlier document, which
    loses all its words if it has a window at all. gram is the length of the inner grams, at most window // 2.
    """
    if not 1 <= gram <= window // 2:
        raise ValueError("gram must lie between 1 and window // 2")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = staged(
        docs.mapInArrow(
            _scan(window, gram),
            "doc_id long, text_a long, text_b long, n_words long, sha string, tag int, keys array<long>, starts array<int>, grid array<boolean>",
        ),
        "anchors",
    )
    light = staged(base.drop("keys", "starts", "grid"), "texts")
    known = base.where("doc_id is not null and n_words > 0")

    # The screen: one row for each run of rolling windows; a run at an indexed block has that in its number.
    runs = known.select("doc_id", "tag", F.posexplode(F.arrays_zip("keys", "grid")).alias("i", "run")).select(
        F.col("run.keys").alias("key"), "doc_id", "tag", (F.col("i") * 2 + F.col("run.grid").cast("int")).alias("run")
    )
    live = (
        runs.groupBy("key")
        .agg(
            F.min("tag").alias("t0"), F.max("tag").alias("t1"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n"),
            F.min(F.when(F.col("run") % 2 == 1, F.col("doc_id"))).alias("first_block"),
        )
        .where("t0 < t1")
        .select("key", "n", F.coalesce(F.col("first_block") < F.col("last"), F.lit(False)).alias("hit"))
    )
    live = staged(live, "live")
    # Keys of a great many runs are few: these runs find theirs without a shuffle.
    hot = small_or_not(staged(live.where(F.col("n") > HOT_RUNS).drop("n"), "hot"))
    found = runs.join(hot, "key").unionByName(runs.join(hot, "key", "left_anti").join(live.where(F.col("n") <= HOT_RUNS).drop("n"), "key"))
    hits = found.groupBy("doc_id", "tag").agg(
        F.collect_list((F.col("run") / 2).cast("int")).alias("shared"),
        F.collect_list(F.when(F.col("hit"), (F.col("run") / 2).cast("int"))).alias("hits"),
    )
    # Of equal texts only the first stands for all: the others start every window of theirs in it.
    firsts = light.where("doc_id is not null and n_words > 0").groupBy("text_a", "text_b").agg(F.min("doc_id").alias("first_doc"))
    marked = light.join(firsts, ["text_a", "text_b"], "left")
    distinct = (
        known.where(F.size("keys") > 0)
        .join(firsts, ["text_a", "text_b"])
        .where("doc_id = first_doc")
        .dropDuplicates(["doc_id", "text_a", "text_b"])
        .select("doc_id", "tag", "n_words", "starts")
        .join(hits, ["doc_id", "tag"])
    )
    span = window - window // 2 + 1
    candidates = distinct.where(F.size("shared") * (window // 2) >= span).where(F.size("hits") > 0)
    probes = staged(
        docs.join(candidates.select("doc_id", "tag", "starts", "shared", "hits"), "doc_id").mapInArrow(
            _probes(window), "doc_id long, tag int, places array<int>, keys array<long>"
        ),
        "probes",
    )
    drop_staged(base, live, hot)

    # Probes meet the index, and hits are extended.
    probed = probes.select("doc_id", "tag", F.explode(F.arrays_zip("places", "keys")).alias("p")).select("doc_id", "tag", F.col("p.places").alias("at"), F.col("p.keys").alias("key"))
    hits = block_hits(probed, window // 2).groupBy("doc_id", "tag").agg(F.collect_list("at").alias("hits"))
    windows = staged(docs.join(hits, "doc_id").mapInArrow(_extended(window), "hash_a long, hash_b long, doc_id long, at int, tag int"), "windows")
    drop_staged(probes)
    origin = windows.groupBy("hash_a", "hash_b").agg(F.min("doc_id").alias("origin"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n"))
    origin = staged(origin.where("origin < last").drop("last"), "origins")
    hot = small_or_not(staged(origin.where(F.col("n") > HOT_RUNS).drop("n"), "hot-windows"))
    both = ["hash_a", "hash_b"]
    held = windows.join(hot, both).unionByName(windows.join(hot, both, "left_anti").join(origin.where(F.col("n") <= HOT_RUNS).drop("n"), both))
    gone = held.where("origin < doc_id").groupBy("doc_id", "tag").agg(F.collect_list("at").alias("at"))
    cut = docs.join(gone, "doc_id").mapInArrow(
        _cut(window, keep_text), "doc_id long, tag int, cut_words long, cut_sha string, cut_text string"
    ).dropDuplicates(["doc_id", "tag"])

    copied = (F.col("first_doc") < F.col("doc_id")) & (F.col("n_words") >= window)
    result = marked.join(cut, ["doc_id", "tag"], "left").select(
        "doc_id",
        "n_words",
        F.when(copied, F.col("n_words")).otherwise(F.coalesce("cut_words", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copied, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
        F.when(copied, F.lit("")).otherwise(F.col("cut_text")).alias("kept_text"),
    )
    return result if keep_text else result.drop("kept_text")


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Whole windows by list functions; quadratic in nothing, but a window's words are written out once each.
OP1_SQL = f"""WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
h AS (SELECT doc_id, list_transform(range(1, len(w) - {WINDOW} + 2), lambda p: md5(array_to_string(w[p:p + {WINDOW - 1}], ' '))) AS hs FROM d),
win AS (SELECT doc_id, unnest(hs) AS h, generate_subscripts(hs, 1) AS p FROM h),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + {WINDOW})) AS i FROM win JOIN (SELECT h, min(doc_id) AS first FROM win GROUP BY h) USING (h) WHERE first < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (SELECT count(*) FROM gone WHERE gone.doc_id = d.doc_id)::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""

"""Token counts by a Viterbi search that keeps counts only.

The vocabulary is a unigram one: pieces with scores. Text is cut before each space, every space becomes the mark
U+2581, and one mark is put before the text (that is how the tokenizers library's Metaspace does it). In each
cut, an Aho-Corasick automaton lists the pieces that end at each character; dynamic programming carries the best
score and the number of pieces on that path, and no path is stored. Where no piece of one character fits, an
unknown character may stand, at the lowest score less 10, counted as its UTF-8 bytes (byte fallback).

Ties are decided as in the tokenizers library's Unigram model: ends are reached in the order of their starts, a
later start replaces an earlier one only with a strictly higher score, and an unknown comes after the pieces of its
start. Scores are summed as doubles in the same order, so counts agree exactly.

Cuts repeat, so each Python worker remembers the counts of those seen last, MEMORY of them at most. The work on
a document depends on it alone: no shuffle, and any task can be run again elsewhere.

Defined results: null and empty texts have no tokens. Rows are kept as they are, repeated ones too; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import text_rows

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_PENALTY = 10.0
MEMORY = 400_000
_CUT = re.compile(f"{MARK}[^{MARK}]*|[^{MARK}]+")


def pieces_of(path: str) -> list[tuple[str, float]]:
    """The pieces of a sentencepiece model file with their scores, in the order of their ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.vocab_size())]


class UnigramCounter:
    """Counts the pieces of the best segmentation of a text."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.memory: dict[str, int] = {}

    def best(self, cut: str) -> int:
        """Pieces of the best segmentation of one cut."""
        n = len(cut)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for last, (length, score) in self.automaton.iter(cut):
            ends[last].append((length, score))
        total, count = [0.0] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            fits = ends[end - 1]
            fits.sort(reverse=True)  # longest piece, so first start, first
            best, pieces = None, 0
            for length, score in fits:
                s = score + total[end - length]
                if best is None or s > best:
                    best, pieces = s, count[end - length] + 1
            if not fits or fits[-1][0] > 1:
                s = self.unknown + total[end - 1]
                if best is None or s > best:
                    best, pieces = s, count[end - 1] + len(cut[end - 1].encode())
            total[end], count[end] = best, pieces
        return count[n]

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = text.replace(" ", MARK)
        if not text.startswith(MARK):
            text = MARK + text
        memory, total = self.memory, 0
        for cut in _CUT.findall(text):
            known = memory.get(cut)
            if known is None:
                if len(memory) >= MEMORY:
                    memory.clear()
                known = self.best(cut)
                if len(cut) <= 64:
                    memory[cut] = known
            total += known
        return total


#: One counter for each vocabulary file in a Python worker.
_COUNTERS: dict[str, UnigramCounter] = {}


def _counts(path: str):
    def counts(batches):
        if path not in _COUNTERS:
            _COUNTERS[path] = UnigramCounter(pieces_of(path))
        counter = _COUNTERS[path]
        for batch in batches:
            tokens = [counter.count(text or "") for text in text_rows(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.int64())], ["doc_id", "n_tokens"])

    return counts


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and n_tokens for each row of docs (doc_id, text). vocabulary is a path that every executor can read."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_counts(vocabulary), "doc_id long, n_tokens long")


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))

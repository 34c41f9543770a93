"""Best-fit packing of tokenized documents into sequences by minimum bin slack.

Tasks tokenize documents, add the end id and cut what is longer than a sequence into pieces, the shorter one first. From
then on only lengths matter, and there are no more of them than a sequence has tokens: pieces are counted by length, and bins are filled
from these counts. Each bin starts with the longest length left; a bitset of the sums that the other lengths can reach, longest
lengths first, gives the fullest combination, which is removed. As long as the counts last the next bin would choose the same
combination, so it is removed as many times at once. So the plan holds some thousand combinations, whatever the number of documents:
its size and time are bounded by the sequence length.

Pieces then find their places without meeting each other. Every piece is the i-th of its length, numbered within the task that made it and
moved on by what earlier tasks hold of that length; the plan says by length and number which sequence and which offset that is.

Tokens come from the tokenizers library: text is cut into units before each space that follows a character that isn't white space, where no
token can reach across. Each worker remembers the ids of the units it has seen, MEMORY of them at most; a text's new units are tokenized as one
text and parted by their bytes. The library's own cache of words, which would see none of them again, is off.

Defined results: null texts are empty; an empty text has the end id alone. Rows are kept as they are, repeated ones and null
ids too, each packed for itself. Equal lengths are alike for the plan. Extra columns are ignored; an empty table gives an empty result.
A text is held whole by the task that tokenizes it.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnloom.llm.common import staged, text_rows

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
CAPACITY = 2048
END_ID = 0
MEMORY = 600_000
#: Units longer than this aren't remembered.
LONG_UNIT = 64
#: Rows of pieces in one Arrow batch.
ROWS = 20_000

#: White space, or what some libraries take for it.
_BLANK = "\\s\x85\u180e\u200b\ufeff"
_CUT = re.compile(f"(?<=[^{_BLANK}])(?= )")
#: Where a space follows white space, not every space may be a cut.
_RUN = re.compile(f"[{_BLANK}] ")


class UnitEncoder:
    """Ids of texts, as bytes of little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.model._resize_cache(0)
        self.spaced: dict[str, bytes] = {}  # of a unit after a space, with that space
        self.plain: dict[str, bytes] = {}  # of other units
        # Bytes of text behind each id.
        sizes = {i: len(token) for token, i in self.tokenizer.get_vocab().items()}
        self.sizes = np.array([sizes.get(i, 0) for i in range(max(sizes) + 1)])

    def __call__(self, text: str) -> bytes:
        if _RUN.search(text):
            units = _CUT.split(text)
        else:
            first, *rest = text.split(" ")
            return b"".join([*self.of_plain([first] if first else []), *self.of_spaced(rest)])
        spaced = iter(self.of_spaced([u[1:] for u in units if u[0] == " "]))
        plain = iter(self.of_plain([u for u in units if u[0] != " "]))
        return b"".join(next(spaced if u[0] == " " else plain) for u in units)

    def encoded(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def of_plain(self, units: list[str]) -> list[bytes]:
        return self._resolved(units, self.plain, self.encoded)

    def of_spaced(self, units: list[str]) -> list[bytes]:
        """Ids of each unit with a space before it."""
        return self._resolved(units, self.spaced, self._together)

    def _together(self, units: list[str]) -> list[bytes]:
        """Ids of each of some units with a space before it, tokenized as one text and parted by their bytes."""
        text = " " + " ".join(units)
        if text.count(" ") > len(units) or _RUN.search(text + " "):  # a unit with a space in it, or white space at its end
            odd = [u for u in units if " " in u or _RUN.search(f" {u} ")]
            even = [u for u in units if not (" " in u or _RUN.search(f" {u} "))]
            ids = dict(zip(odd, self.encoded([f" {u}" for u in odd]))) | dict(zip(even, self._together(even) if even else []))
            return [ids[u] for u in units]
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        data = np.frombuffer(text.encode(), np.uint8)
        ends = np.append(np.flatnonzero(data == 32)[1:], len(data))
        upto = np.searchsorted(np.cumsum(self.sizes[ids]), ends) + 1
        data, at = ids.tobytes(), [0, *(4 * upto).tolist()]
        return [data[i:j] for i, j in zip(at, at[1:])]

    def _resolved(self, units: list[str], known: dict[str, bytes], tokenized) -> list[bytes]:
        new = list(set(units).difference(known))
        if not new:
            return list(map(known.__getitem__, units))
        ids = tokenized(new)
        if len(known) + len(new) <= MEMORY and max(map(len, new)) <= LONG_UNIT:
            known.update(zip(new, ids))
            return list(map(known.__getitem__, units))
        here = dict(zip(new, ids))
        out = [here[u] if u in here else known[u] for u in units]
        if len(known) + len(here) > MEMORY:
            known.clear()
        known.update((u, ids) for u, ids in here.items() if len(u) <= LONG_UNIT)
        return out


_ENCODERS: dict[str, UnitEncoder] = {}


def encoder(path: str) -> UnitEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = UnitEncoder(path)
    return _ENCODERS[path]


def cut_lengths(n: int, capacity: int) -> list[int]:
    """The lengths of the pieces of n tokens, in order: what is over comes first."""
    full, over = divmod(n, capacity)
    return [over] * (over > 0) + [capacity] * full


def tokenized(docs: DataFrame, path: str = VOCABULARY, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, task, nth (and ids): a row for each piece, the nth of its length in its task."""
    end = np.array([end_id], "<u4").tobytes()

    def pieces(batches):
        encode, task = encoder(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        ids_kept: list[np.ndarray] = []
        rows: list[tuple] = []

        def batch(doc_ids, kind):
            at, *columns = zip(*rows)
            arrays = [doc_ids.take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds))]
            return pa.RecordBatch.from_arrays(arrays + ([pa.array(ids_kept, pa.list_(pa.int64()))] if keep_ids else []), kind)

        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth", *["ids"] * keep_ids]
        for source in batches:
            doc_ids = source.column(source.schema.get_field_index("doc_id"))
            for i, text in enumerate(text_rows(source)):
                ids, start = memoryview((encode(text) if text else b"") + end), 0
                for k, length in enumerate(cut_lengths(len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + length)]
                    rows.append((i, k, start, length, zlib.crc32(part), task, int(seen[length])))
                    if keep_ids:
                        ids_kept.append(np.frombuffer(part, "<u4").astype(np.int64))
                    seen[length] += 1
                    start += length
                    if len(rows) >= ROWS:
                        yield batch(doc_ids, names)
                        rows, ids_kept = [], []
            if rows:
                yield batch(doc_ids, names)
                rows, ids_kept = [], []

    kind = "piece int, start bigint, length bigint, ids_crc32 bigint, task int, nth bigint" + ", ids array<bigint>" * keep_ids
    return docs.select("doc_id", "text").mapInArrow(pieces, T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL(kind).fields]))


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The numbers of lengths, no more than counts has, whose sum is as near to room as can be, not above it; long ones are preferred."""
    reach, before, full = 1, [], 1 << room
    mask = (full << 1) - 1
    for length in sorted((n for n in counts if n <= room), reverse=True):
        before.append((length, reach))
        left, step = min(counts[length], room // length), 1
        while left:  # copies by powers of two: 1, 2, 4, ..., rest
            step = min(step, left)
            reach |= (reach << (step * length)) & mask
            left, step = left - step, step * 2
        if reach & full:
            break
    taken, total = {}, reach.bit_length() - 1
    for length, earlier in reversed(before):
        n = 0
        while not earlier >> (total - n * length) & 1:
            n += 1
        if n:
            taken[length] = n
            total -= n * length
    return taken


def bins(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """How often each combination of lengths fills a bin."""
    counts, out = {n: c for n, c in counts.items() if c}, []
    while counts:
        longest = max(counts)
        rest = {n: c - (n == longest) for n, c in counts.items() if c > (n == longest)}
        taken = fullest(rest, capacity - longest)
        taken[longest] = taken.get(longest, 0) + 1
        times = min(counts[n] // k for n, k in taken.items())
        out.append((times, taken))
        counts = {n: c for n, c in ((n, c - times * taken.get(n, 0)) for n, c in counts.items()) if c}
    return out


def slots(plan: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Rows length, first number, first sequence, how many in a sequence, offset of the first: for the pieces of a length, by number."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for times, taken in plan:
        offset = 0
        for length, k in sorted(taken.items(), reverse=True):
            rows.append((length, used.get(length, 0), sequence, k, offset))
            used[length] = used.get(length, 0) + times * k
            offset += k * length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces, a staged table as from tokenized(), with sequence_id and offset for task and nth."""
    at = pieces.groupBy("task", "length").agg((F.max("nth") + 1).alias("n"))
    at = staged(at, "piece-counts")
    total = {r["length"]: r["n"] for r in at.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    table = slots(bins(total, capacity))
    kept = [c for c in pieces.columns if c not in ("task", "nth")]

    def place(batches):
        for b in batches:
            length, number = (np.asarray(b.column(b.schema.get_field_index(c))) for c in ("length", "number"))
            # The last row of the length that begins at the number or before it.
            first = np.searchsorted(table[:, 0], length)
            span = np.searchsorted(table[:, 0], length, "right")
            key = np.empty(len(length), np.int64)
            for n in np.unique(length):
                own = length == n
                lo, hi = first[own][0], span[own][0]
                key[own] = lo + np.searchsorted(table[lo:hi, 1], number[own], "right") - 1
            _, start, sequence, k, offset = table[key].T
            nth, within = np.divmod(number - start, k)
            columns = [b.column(b.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence + nth), pa.array(offset + within * length)], [*kept, "sequence_id", "offset"])

    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    base = at.select("task", "length", F.coalesce(before, F.lit(0)).alias("base"))
    numbered = pieces.join(base, ["task", "length"]).withColumn("number", F.col("base") + F.col("nth")).select(*kept, "number")
    kind = T.StructType([*pieces.select(kept).schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return numbered.mapInArrow(place, kind)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids: the tokens of each sequence, from packed pieces with ids. A sequence has capacity tokens at most."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def op11_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(staged(tokenized(docs), "pieces"))

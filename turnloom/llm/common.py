"""What the corpus operators share: staged tables, words, hashes, Arrow lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.sources.staging import drop_staged, shared_dir, staged  # noqa: F401

#: A staged table of at most this many narrow rows (about 100 bytes each) may be broadcast.
BROADCAST_ROWS = 100_000


def small_or_not(stage: DataFrame) -> DataFrame:
    """A staged table of narrow rows, marked for broadcast if it has no more than BROADCAST_ROWS of them.

    Beyond that it is joined by shuffle. Counting reads the footers of its files.
    """
    return F.broadcast(stage) if stage.count() <= BROADCAST_ROWS else stage


#: A key is hot if more than HOT_ROWS rows and more than one in HOT_KEYS of all rows hold it, so there are fewer hot keys than HOT_KEYS.
HOT_ROWS = 1_000
HOT_KEYS = 10_000


def join_counted(rows: DataFrame, facts: DataFrame, keys: str | list[str], how: str = "inner") -> DataFrame:
    """rows joined (inner or left) with facts, a staged table with one row for each of the keys and n, the number of rows that hold it.

    The rows of hot keys find theirs by broadcast, where they lie; the others go by shuffle, in which no key is hot. facts may
    leave keys out; for a left join only those of few rows.
    """
    limit = F.greatest(F.lit(HOT_ROWS), F.lit(rows.count() // HOT_KEYS))
    hot = F.broadcast(facts.where(F.col("n") > limit))
    return rows.join(hot, keys).unionByName(rows.join(hot.select(keys), keys, "left_anti").join(facts.where(F.col("n") <= limit), keys, how))


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores after it as make it unlike all columns of df (whatever their case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def words_of(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` as UTF-8; bytes.split() without argument splits at exactly these six bytes."""
    return text.encode("utf-8").split() if text else []


def lower_words_of(text: str | None) -> list[bytes]:
    """The same after lower-casing A-Z alone."""
    return text.encode("utf-8").lower().split() if text else []


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits whose output bits all depend on all input bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least; base is odd."""
    up, down = _POWERS.get(base, (np.empty(0, np.uint64),) * 2)
    if len(up) < n:
        n = max(n, 2 * len(up), 4096)
        up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        _POWERS[base] = (up[: 1 << 20], down[: 1 << 20])
    return up[:n], down[:n]


def rolling(hashes: np.ndarray, k: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A hash of each k consecutive values, alike for equal runs wherever they stand: sum of h[i+j] * base**j modulo 2**64, mixed."""
    n = len(hashes)
    if n < k:
        return np.empty(0, np.uint64)
    up, down = _powers(base, n)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[:n], dtype=np.uint64)])
    return mixed((total[k:] - total[:-k]) * down[: n - k + 1])


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, np.uint64).view(np.int64)


def digest128(data: bytes) -> tuple[int, int]:
    """128 bits as two signed longs."""
    d = xxhash.xxh3_128_digest(data)
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """One list a row."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, kind))


def text_rows(batch: pa.RecordBatch, name: str = "text"):
    """The texts of a batch one at a time, so that only one is held as a Python string."""
    for x in batch.column(batch.schema.get_field_index(name)):
        yield x.as_py()


def utf8_size(text) -> F.Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")

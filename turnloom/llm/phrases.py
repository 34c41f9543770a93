"""Phrases that occur often, by sorted suffixes: counted, scored against their parts, freed of what longer ones explain.

Every word occurrence starts a suffix, the up to max_n words from it on within its piece of text. Equal suffixes are summed in the run of words that holds
them, in the task and over all tasks, then shuffled by language and first word and sorted in reverse, so that all that share a beginning follow one another: one stack of max_n open
beginnings counts them all in one reading, batch by batch. The counts of beginnings are the counts of all phrases; phrases then meet their parts by joins.

A suffix ends early where it can't be part of a frequent phrase: where a run of fewer than max_n neighbours is rarer than least. Which are is known from
earlier readings that sum up hashes, first of words and pairs, then of triples whose pairs are frequent, and so on; those with enough occurrences set
bits of a map, shared with all tasks. Hashes that fall together, and bits set by others, only let a suffix go on needlessly, so no phrase is lost and every count stays
exact. A map has SCREEN_BITS bits for each frequent hash, MOST_BITS (128 MiB) at most: beyond some 100 million frequent words and pairs it lets more
and more through, which costs shuffle only.

The suffixes of a first word with more than HOT rows (or one in HOT_KEYS of all, if more) are dealt out by their second word, and those of such a pair by the
rest; what was parted so is summed up afterwards. Phrases meet parts by join_counted: those with a part that very many share find it by broadcast. The
last rank of each language is taken from the best of 16 parts, theirs from 1,024.

Defined results: a null lang is `und`, and so is one that is written so. Null and empty texts have no words. Repeated rows count each. doc_id
plays no part, and extra columns are ignored. Ties are settled to the last by the phrase itself. An empty table gives an empty result. A long text
is taken in runs of words that overlap by max_n - 1.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.llm.common import hashes_of, join_counted, mixed, signed, small_or_not, staged, text_rows

LEAST = 30
LONGEST = 4
COVERED = 80
TOP = 2000
SCALE = 2_000_000
#: Words held before their suffixes are counted, and different hashes held before they are handed on.
RUN_WORDS = 200_000
HELD = 400_000
SCREEN_BITS = 16
MOST_BITS = 1 << 30
HOT = 5_000
HOT_KEYS = 10_000

#: Stands between pieces: no word has this byte, since it isn't UTF-8.
GAP = b"\xff"
_ENDS = bytes(0xFF if c in b".,;:!?\n\x0b\x0c\r" else 0x20 if c == 9 else c for c in range(256))
#: Bytes of a text whose words are listed at once.
STRETCH = 1 << 20


def words_and_gaps(text: str):
    """Lists of the words of a text with A-Z lower-cased and a GAP where a piece ends, and at the end."""
    data, at = text.encode("utf-8").lower().translate(_ENDS).replace(GAP, b" \xff ") + b" \xff", 0
    while at < len(data):
        end = data.find(b" ", at + STRETCH)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


class Run:
    """Words of one language, whose suffixes are handed over with the words that follow them."""

    def __init__(self, context: int):
        self.context, self.words = context, []

    def add(self, lists):
        """Runs of words and how many of them start suffixes now; the others are only seen."""
        for words in lists:
            self.words += words
            if len(self.words) >= RUN_WORDS:
                yield self.taken(len(self.words) - self.context)

    def taken(self, starts: int) -> tuple[list[bytes], int]:
        run, self.words = self.words, self.words[starts:]
        return run, starts

    def end(self) -> tuple[list[bytes], int]:
        starts = len(self.words)
        self.words += [GAP] * self.context
        return self.taken(starts)


def runs_of(batches, context: int):
    """(lang, words, starts) of all texts of some batches of lang, text."""
    runs: dict[str, Run] = {}
    for b in batches:
        for lang, text in zip(text_rows(b, "lang"), text_rows(b, "text")):
            if text:
                lang = "und" if lang is None else lang
                for words, starts in runs.setdefault(lang, Run(context)).add(words_and_gaps(text)):
                    yield lang, words, starts
    for lang, run in runs.items():
        yield lang, *run.end()


def coded(words: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The different words of a run, and for each word its number among them."""
    different = list(dict.fromkeys(words))
    number = dict(zip(different, range(len(different))))
    return different, np.fromiter(map(number.__getitem__, words), np.int64, len(words))


def grams(lang: str, different: list[bytes], codes: np.ndarray, longest: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Where words (as from coded) are gaps, and hashes of the 1, 2, .. longest words from each on; each different word is hashed once."""
    gaps = np.fromiter(map(GAP.__eq__, different), bool, len(different))[codes]
    h = (hashes_of(different) ^ np.uint64(xxhash.xxh64_intdigest(lang.encode(), 1)))[codes]
    out, so_far = [], np.zeros(len(h) + 1, np.uint64)
    for k in range(longest):
        so_far = so_far[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[k:]
        out.append(mixed(so_far + np.uint64(k)))
    return gaps, out


def possible(gaps: np.ndarray, hashes: list[np.ndarray], screens: list[Screen]) -> list[np.ndarray]:
    """Whether the 1, 2, .. words from each on may be frequent: they are in the screen of their number, and so is all within them.

    There is one more than there are screens, where hashes has it.
    """
    out = [~gaps]
    for k, h in enumerate(hashes):
        if k:
            out.append(out[-1][:-1] & out[-1][1:])
        if k == len(screens):
            break
        at = np.flatnonzero(out[k])
        out[k][at] = screens[k].has(h[at])
    return out


def hash_counts(docs: DataFrame, shared: list, k: int) -> DataFrame:
    """hash, n: occurrences of the k words from each word on (k = 2: of words, too), summed by hash; lang, n: words by language, with k = 2.

    shared holds a screen for each smaller number of words, none for k = 2.
    """

    def counts(batches):
        total: Counter[str] = Counter()
        screens = [Screen(bits.value) for bits in shared]
        held, size = [], 0

        def handed_on():
            hashes, at = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
            n = np.bincount(at, np.concatenate([c for _, c in held])).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.nulls(len(n), pa.string()), pa.array(signed(hashes)), pa.array(n)], ["lang", "hash", "n"])

        for lang, words, starts in runs_of(batches, k - 1):
            gaps, hashes = grams(lang, *coded(words), k)
            ok = possible(gaps, hashes, screens) if screens else [~gaps, ~(gaps[:-1] | gaps[1:])]
            total[lang] += int((~gaps[:starts]).sum())
            keys = np.concatenate([h[:starts][o[:starts]] for h, o in zip(hashes[k - 1 if screens else 0 :], ok[k - 1 if screens else 0 :])])
            held.append(np.unique(keys, return_counts=True))
            size += len(held[-1][0])
            if size >= HELD:
                yield handed_on()
                held, size = [], 0
        if held:
            yield handed_on()
        if not screens:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.nulls(len(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["lang", "hash", "n"])

    return docs.mapInArrow(counts, "lang string, hash long, n long").groupBy("lang", "hash").agg(F.sum("n").alias("n"))


class Screen:
    """A map of bits: each hash has set two of them."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(8 * len(bits) - 1)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for shift in (0, 32):
            at = (hashes >> np.uint64(shift)) & self.mask
            out &= (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return out


def screen_of(frequent: DataFrame) -> Screen:
    """The map of a staged table of hashes. Blocks of 32,768 bits are made in tasks; together they have MOST_BITS at most."""
    size = 1 << 15
    while size < min(SCREEN_BITS * frequent.count(), MOST_BITS):
        size *= 2
    places = F.explode(F.array(*(F.shiftrightunsigned("hash", s).bitwiseAND(F.lit(size - 1)) for s in (0, 32))))
    at = frequent.select(places.alias("at")).select(F.shiftright("at", 15).alias("block"), F.col("at").bitwiseAND(F.lit(32767)).alias("bit"))
    bits = np.zeros(size // 8, np.uint8)
    for row in at.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits")).toLocalIterator():
        bits[row["block"] * 4096 : (row["block"] + 1) * 4096] = np.frombuffer(row["bits"], np.uint8)
    return Screen(bits)


def different_rows(columns: list[np.ndarray], most: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The different rows of columns of numbers from -1 to most - 1, and how often each is there. Rows are told apart by exact numbers, not by hashes."""
    key, bound = np.zeros(len(columns[0]), np.int64), 1
    for c in columns:
        if bound * (most + 1) >= 1 << 63:
            key, bound = np.unique(key, return_inverse=True)[1].astype(np.int64), len(key)
        key, bound = key * (most + 1) + c + 1, bound * (most + 1)
    _, first, n = np.unique(key, return_index=True, return_counts=True)
    return [c[first] for c in columns], n.astype(np.int64)


def suffix_counts(docs: DataFrame, shared: list, longest: int) -> DataFrame:
    """lang, w1 .. w<longest>, n: occurrences of suffixes in each run of words, as long as the screens let them go on."""
    names = ["lang", *(f"w{i}" for i in range(1, longest + 1)), "n"]

    def counts(batches):
        screens = [Screen(bits.value) for bits in shared]
        for lang, words, starts in runs_of(batches, longest - 1):
            different, codes = coded(words)
            gaps, hashes = grams(lang, different, codes, longest)
            # A suffix of k words is possible only where its beginnings are, so their number is its length.
            length = np.zeros(starts, np.int64)
            for ok in possible(gaps, hashes, screens):
                length[: len(ok)] += ok[:starts]
            at = np.flatnonzero(length)
            suffixes, n = different_rows([np.where(length[at] > k, codes[np.minimum(at + k, len(codes) - 1)], -1) for k in range(longest)], len(different))
            known = pa.array(different, pa.binary())
            columns = [known.take(pa.array(c, mask=c < 0)).cast(pa.string()) for c in suffixes]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), *columns, pa.array(n)], names)

    schema = ", ".join(f"{c} {'long' if c == 'n' else 'string'}" for c in names)
    return docs.mapInArrow(counts, schema)


class Stack:
    """The open beginnings of a sorted reading, by length, with what they count so far."""

    def __init__(self, longest: int):
        self.longest = longest
        self.open: list[tuple | None] = [None] * (longest + 1)  # at k: (lang, salt, parted, k words), count

    def read(self, batch: pa.RecordBatch):
        """Arrays of lang, parted, phrase, k and count for the beginnings that a batch closes."""
        n = len(batch)
        column = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
        counts = np.asarray(column["n"])
        head = ("lang", "salt")
        differs = np.zeros(n, bool)
        differs[0] = True
        there = np.ones(n, bool)
        for k in range(0, self.longest + 1):
            for c in head if k == 0 else (f"w{k}",):
                a = column[c]
                changed = pc.fill_null(pc.not_equal(a[1:], a[:-1]), True) if k else pc.not_equal(a[1:], a[:-1])
                differs[1:] |= np.asarray(changed)
            if k == 0:
                continue
            there &= np.asarray(column[f"w{k}"].is_valid())
            # Rows without a k-th word end their beginning without being part of one; what shares one follows on.
            first = np.flatnonzero(differs & there)
            total = np.add.reduceat(np.where(there, counts, 0), np.flatnonzero(differs))[there[differs]]
            rows = batch.take(pa.array(first)) if len(first) else batch.slice(0, 0)
            yield from self._close(k, rows, total, bool(there[0]), bool(there[-1]))

    def _close(self, k: int, rows: pa.RecordBatch, total: np.ndarray, starts: bool, ends: bool):
        """The beginnings of k words that a batch closes; the last stays open if the batch ends within it."""
        names = ("lang", "salt", "parted", *(f"w{i}" for i in range(1, k + 1)))
        key = lambda i: tuple(rows.column(rows.schema.get_field_index(c))[i].as_py() for c in names)
        before, self.open[k] = self.open[k], None
        if before and starts and len(total) and key(0) == before[0]:
            total[0] += before[1]
            before = None
        if before:
            yield self._arrays(k, [pa.array([v]) for v in before[0]], np.array([before[1]]))
        if ends and len(total):
            self.open[k] = key(len(total) - 1), int(total[-1])
            rows, total = rows.slice(0, len(total) - 1), total[:-1]
        if len(total):
            yield self._arrays(k, [rows.column(rows.schema.get_field_index(c)) for c in names], total)

    def end(self):
        for k, held in enumerate(self.open):
            if held:
                yield self._arrays(k, [pa.array([v]) for v in held[0]], np.array([held[1]]))

    def _arrays(self, k: int, key: list, total: np.ndarray):
        lang, _, parted, *words = key
        return lang, parted, pc.binary_join_element_wise(*words, " ") if k > 1 else words[0], k, total


def beginning_counts(suffixes: DataFrame, longest: int, least: int) -> DataFrame:
    """lang, phrase, k, n: all beginnings of suffixes (a staged table) that occur least times."""
    words = [f"w{i}" for i in range(1, longest + 1)]
    limit = max(HOT, suffixes.count() // HOT_KEYS)
    held = lambda *by: suffixes.groupBy("lang", *by).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > limit)
    hot = held("w1").select("lang", "w1", F.ceil(F.col("rows") / limit * 2).cast("int").alias("salts"))
    hot_pairs = held("w1", "w2").where("w2 is not null").select("lang", "w1", "w2", F.lit(True).alias("by_rest"))
    dealt = suffixes.join(F.broadcast(staged(hot, "hot-words")), ["lang", "w1"], "left").join(F.broadcast(staged(hot_pairs, "hot-pairs")), ["lang", "w1", "w2"], "left")
    salt = F.when(F.col("by_rest"), F.xxhash64(*words[1:])).otherwise(F.xxhash64("w2"))
    dealt = dealt.withColumn("salt", F.coalesce(F.pmod(salt, F.col("salts")).cast("int"), F.lit(0)))
    # Up to how many words a beginning may have rows elsewhere, too.
    dealt = dealt.withColumn("parted", F.when(F.col("by_rest"), longest - 1).when(F.col("salts").isNotNull(), 1).otherwise(0)).drop("by_rest", "salts")
    order = ["lang", "w1", "salt", *(F.col(w).desc() for w in words[1:])]
    ordered = dealt.repartition("lang", "w1", "salt").sortWithinPartitions(*order)

    def counted(batches):
        stack = Stack(longest)

        def rows(closed):
            for lang, parted, phrase, k, total in closed:
                keep = (total >= least) | (k <= np.asarray(parted))
                batch = pa.RecordBatch.from_arrays([lang, phrase, pa.array(np.full(len(total), k, np.int32)), pa.array(total)], ["lang", "phrase", "k", "n"])
                yield batch.filter(pa.array(keep))

        for b in batches:
            if len(b):
                yield from rows(stack.read(b))
        yield from rows(stack.end())

    parts = ordered.mapInArrow(counted, "lang string, phrase string, k int, n long")
    return parts.groupBy("lang", "phrase", "k").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _best(rows: DataFrame, by: list[str], top: int) -> DataFrame:
    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)


def _part(first: Column | int, size: Column | int) -> Column:
    return F.array_join(F.slice("words", first, size), " ")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, covered: int = COVERED, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of two to longest words."""
    texts = docs.select("lang", "text")
    shared: list = []
    for k in range(2, max(longest, 3)):
        sums = staged(hash_counts(texts, shared, k).where(F.col("hash").isNull() | (F.col("n") >= least)), f"frequent-{k}")
        bits = docs.sparkSession.sparkContext.broadcast(screen_of(sums.where("hash is not null")).bits)
        if k == 2:  # words and pairs share one screen
            totals, shared = sums.where("hash is null").select("lang", "n"), [bits]
        shared.append(bits)
    words = [f"w{i}" for i in range(1, longest + 1)]
    suffixes = staged(suffix_counts(texts, shared, longest).groupBy("lang", *words).agg(F.sum("n").alias("n")), "suffixes")
    counts = staged(beginning_counts(suffixes, longest, least), "phrases")

    phrases = counts.where("k > 1").select("lang", "phrase", "k", F.col("n").alias("a"))
    split = phrases.withColumn("words", F.split("phrase", " ", -1))
    # Longer candidates hide what they consist of.
    inner = F.filter(
        F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda size: F.transform(F.sequence(F.lit(1), F.col("k") - size + 1), lambda first: _part(first, size)))),
        lambda p: p.isNotNull(),
    )
    longer = split.where("k > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), F.col("a").alias("longer"))
    most = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    hidden = exact("longer") * 100 >= exact("a") * covered
    kept = split.join(most, ["lang", "phrase"], "left").where(~F.coalesce(hidden, F.lit(False))).drop("longer")

    cuts = kept.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = staged(cuts.select("lang", "phrase", "a", "cut", _part(1, F.col("cut")).alias("left"), _part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right")), "cuts")
    parts = cuts.select("lang", F.explode(F.array("left", "right")).alias("phrase")).groupBy("lang", "phrase").agg(F.count(F.lit(1)).alias("n"))
    facts = staged(parts.join(counts.select("lang", "phrase", F.col("n").alias("f")), ["lang", "phrase"]), "parts")
    for side, name in (("left", "l"), ("right", "r")):
        known = facts.select("lang", F.col("phrase").alias(side), F.col("n").alias("n"), F.col("f").alias(name))
        cuts = staged(join_counted(cuts, known, ["lang", side]).drop(side, "n"), f"cuts-{name}")
    score = F.expr(f"cast(cast(a as decimal(20,0)) * {SCALE} div (cast(l as decimal(20,0)) + r) as bigint)")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("least"))
    rows = scored.select("lang", "phrase", "a", "least.l", "least.r", "least.score")

    for salts in (1024, 16):
        rows = _best(rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts))), ["lang", "salt"], top).drop("rank", "salt")
    return _best(rows, ["lang"], top).join(small_or_not(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("rank", F.col("rank").cast("long"))


#: The contract in SQL.
OP13_SQL = r"""
with pieces as (
    select coalesce(lang, 'und') as lang,
        unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
    from documents
), listed as (
    select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as ws from pieces
), grams as (
    select lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i : i + k - 1], ' '))) as phrase
    from listed, (select unnest([1, 2, 3, 4]) as k) where len(ws) >= k
), f as (
    select lang, k, phrase, count(*)::hugeint as f from grams group by all
), totals as (
    select lang, sum(f)::bigint as n from f where k = 1 group by lang
), cand as (
    select lang, k, phrase, f as a, string_split(phrase, ' ') as ws from f where k >= 2 and f >= 30
), inside as (
    select lang, array_to_string(ws[i : i + s - 1], ' ') as phrase, max(a) as longer
    from cand, (select unnest([2, 3]) as s) sizes, (select unnest([1, 2, 3]) as i) starts
    where s < k and i + s - 1 <= k group by all
), kept as (
    select c.* from cand c left join inside i using (lang, phrase) where i.longer is null or 100 * i.longer < 80 * c.a
), cuts as (
    select kept.lang, kept.phrase, a, c, x.f as l, y.f as r, (2000000 * a) // (x.f + y.f) as score
    from kept join (select unnest([1, 2, 3]) as c) cs on c < kept.k
    join f x on x.lang = kept.lang and x.phrase = array_to_string(ws[1 : c], ' ')
    join f y on y.lang = kept.lang and y.phrase = array_to_string(ws[c + 1 : kept.k], ' ')
), lowest as (
    select * from cuts qualify row_number() over (partition by lang, phrase order by score, c) = 1
), ranked as (
    select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from lowest
)
select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score::bigint as score
from ranked join totals using (lang) where rank <= 2000
"""

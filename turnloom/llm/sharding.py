"""Sharding over fixed virtual slots.

A row's doc_id hashes to one of SLOTS virtual slots, for good. A slot map says which shard holds each slot; maps are
kept as a versioned table (version, edit, n_shards, vslot, shard, n_rows, n_bytes) and each version but the first is an edit of
an earlier one:

* 1, base: the map for n shards, which is the map for one shard grown n - 1 times;
* 2, grow: one more shard takes its fair count of slots from those shards that hold most; nothing else moves;
* 3, rebalance: slots of the first move from the shard with most bytes to the one with fewest while that narrows the gap, by
  the bytes counted in each slot.

Under the law `key` version 1 places the rows and version 2 tells where they go with one shard more, so doc_id and shard
count decide. Under the law `bytes` version 3 places them.

The maps have SLOTS rows at any size of the data, so they and the slots' sums are the one thing held on the driver and
broadcast. Rows are numbered by slot: a row's number in its shard is the count of rows in the shard's earlier slots plus
its rank in its own. A slot of more than SORT_ROWS rows is dealt to parts first, so no task sorts a whole shard, nor all
rows of a repeated or null id. DataFrame functions only.

Defined results: a null text has no bytes and CRC-32 0; a null doc_id hashes like a value of its own. Repeated rows
are numbered one by one, in no particular order among equals. Extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnloom.llm.common import small_or_not, staged, utf8_size

SLOTS = 4096
SHARDS = 24
ROW_BYTES = 8
#: Rows of a slot that are sorted in one task.
SORT_ROWS = 500_000


def grow(slot_map: list[int], n_shards: int) -> list[int]:
    """The map for one shard more than n_shards: shard n_shards takes SLOTS // (n_shards + 1) slots.

    They come one at a time from the shard that holds most then (ties: the smallest number), its highest slot first.
    """
    held: dict[int, list[int]] = {s: [] for s in range(n_shards)}
    for slot, shard in enumerate(slot_map):
        held[shard].append(slot)
    out = list(slot_map)
    for _ in range(len(slot_map) // (n_shards + 1)):
        most = max(held, key=lambda s: (len(held[s]), -s))
        out[held[most].pop()] = n_shards
    return out


def map_for(n_shards: int, n_slots: int = SLOTS) -> list[int]:
    slot_map = [0] * n_slots
    for n in range(1, n_shards):
        slot_map = grow(slot_map, n)
    return slot_map


def rebalance(slot_map: list[int], slot_bytes: list[int]) -> list[int]:
    """Move slots from the fullest shard to the emptiest while the gap between the two narrows."""
    out, n_shards = list(slot_map), max(slot_map) + 1
    load = [0] * n_shards
    for shard, size in zip(out, slot_bytes):
        load[shard] += size
    while True:
        full, free = max(range(n_shards), key=load.__getitem__), min(range(n_shards), key=load.__getitem__)
        gap = load[full] - load[free]
        fits = [(abs(gap - 2 * b), s) for s, b in enumerate(slot_bytes) if out[s] == full and 0 < b < gap]
        if not fits:
            return out
        slot = min(fits)[1]
        out[slot] = free
        load[full] -= slot_bytes[slot]
        load[free] += slot_bytes[slot]


def virtual_slot(doc_id, n_slots: int = SLOTS):
    """The first 32 bits of the MD5 of the id's digits, modulo n_slots; the same in any engine."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % n_slots).cast("int")


def map_table(spark, versions: list[tuple[str, int, list[int]]]) -> DataFrame:
    """Versions (edit, number of shards, map) in their order as rows: version, edit, n_shards, vslot, shard."""
    one = lambda v, edit, n, m: spark.range(1).select(
        F.lit(v).alias("version"), F.lit(edit).alias("edit"), F.lit(n).alias("n_shards"),
        F.posexplode(F.split(F.lit(",".join(map(str, m))), ",").cast("array<int>")).alias("vslot", "shard"),
    )
    return reduce(DataFrame.unionByName, (one(v, *x) for v, x in enumerate(versions, 1)))


def place_rows(rows: DataFrame, slots: DataFrame) -> DataFrame:
    """rows (vslot, doc_id, text_crc32, size, _id) with slot: gapless numbers from 0 in each shard of slots (vslot, shard, n_rows)."""
    slots = slots.withColumn("_parts", F.greatest(F.lit(1), F.ceil(F.col("n_rows") / SORT_ROWS)).cast("int"))
    part = F.when(F.col("_parts") == 1, 0).otherwise(F.pmod(F.xxhash64("doc_id", "text_crc32", "size", "_id"), F.col("_parts"))).cast("int")
    dealt = rows.join(F.broadcast(slots.select("vslot", "shard", "_parts")), "vslot").withColumn("_part", part)
    whole = slots.where("_parts = 1").select("shard", "vslot", F.lit(0).alias("_part"), F.col("n_rows").cast("long").alias("_n"))
    cut = dealt.where("_parts > 1").groupBy("shard", "vslot", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("vslot", "_part").rowsBetween(Window.unboundedPreceding, -1)
    first = whole.unionByName(cut).withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n", "shard")
    rank = F.row_number().over(Window.partitionBy("vslot", "_part").orderBy("doc_id", "text_crc32", "size", "_id")) - 1
    # One row for each slot, and one for each SORT_ROWS rows of those that are cut.
    numbered = dealt.withColumn("_rank", rank).join(small_or_not(staged(first, "slot-firsts")), ["vslot", "_part"])
    return numbered.withColumn("slot", (F.col("_first") + F.col("_rank")).cast("long")).drop("_parts", "_part", "_rank", "_first")


def shard_rows(docs: DataFrame, n_shards: int = SHARDS, n_slots: int = SLOTS, law: str = "key") -> tuple[DataFrame, DataFrame]:
    """Rows with their places under a law (key or bytes), and the versioned map that gave them, with what each slot holds.

    The rows: doc_id, size, text_crc32, law, shard, slot, grown_shard (null under bytes), vslot.
    """
    if law not in ("key", "bytes"):
        raise ValueError(f"no such law: {law}")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (utf8_size(F.col("text")) + ROW_BYTES).alias("size"),
        F.crc32(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_crc32"),
    )
    rows = staged(rows.withColumns({"vslot": virtual_slot(F.col("doc_id"), n_slots), "_id": F.monotonically_increasing_id()}), "rows")
    loads = staged(rows.groupBy("vslot").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("n_bytes")), "slot-loads")
    held = {r.vslot: r.n_bytes for r in loads.collect()}  # n_slots rows at most

    base = map_for(n_shards, n_slots)
    edits = [("base", n_shards, base), ("grow", n_shards + 1, grow(base, n_shards)), ("rebalance", n_shards, rebalance(base, [held.get(v, 0) for v in range(n_slots)]))]
    known = map_table(docs.sparkSession, edits).join(F.broadcast(loads), "vslot", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    versions = staged(known.select("version", "edit", "n_shards", "vslot", "shard", zero("n_rows"), zero("n_bytes")).coalesce(1), "slot-map", partition_by="version")

    used = versions.where(F.col("edit") == ("base" if law == "key" else "rebalance"))
    grown = versions.where("edit = 'grow'").select("vslot", F.col("shard").alias("grown_shard"))
    placed = place_rows(rows, used.select("vslot", "shard", "n_rows")).join(F.broadcast(grown), "vslot")
    told = F.col("grown_shard") if law == "key" else F.lit(None).cast("int")
    return placed.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", "slot", told.alias("grown_shard"), "vslot"), versions


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))[0]


#: The map is given as it stands; bytes, hashes and CRC-32 (its table by rule) are reckoned in SQL.
OP6_SQL = f"""WITH t AS (
  SELECT list(list_reduce(range(0, 9), lambda c, k: CASE WHEN k = 0 THEN c WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) ORDER BY i) AS crc
  FROM (SELECT unnest(range(0, 256)) AS i)),
m AS (SELECT v AS vslot, ([{",".join(map(str, map_for(SHARDS)))}])[v + 1] AS shard, ([{",".join(map(str, grow(map_for(SHARDS), SHARDS)))}])[v + 1] AS grown_shard
  FROM (SELECT unnest(range(0, {SLOTS})) AS v)),
d AS (SELECT doc_id, strlen(coalesce(text, '')) + {ROW_BYTES} AS size,
  list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % {SLOTS} AS vslot FROM documents),
c AS (SELECT doc_id, size, vslot, xor(list_reduce(bytes, lambda a, b: xor(a >> 8, crc[xor(a & 255, b) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS text_crc32 FROM d, t)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard, row_number() OVER (PARTITION BY shard ORDER BY vslot, doc_id, text_crc32, size) - 1 AS slot,
  grown_shard::INT AS grown_shard, vslot::INT AS vslot FROM c JOIN m USING (vslot)"""

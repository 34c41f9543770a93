"""Jaccard self-join on word n-grams.

A document's set holds the hashes of its distinct word n-grams. Documents with equal sets are one class from the
start. Two sets A and B reach the similarity p/100 only if they differ in at most
D = floor((|A| + |B|) * (100 - p) / (100 + p)) n-grams. So the sets of a size band are cut by hash into more than D
parts: however the differences fall, some part is equal in both. A tile is a size band, a part's number and a
signature of the part; every pair that can be linked shares a tile, and unlike single n-grams a whole part is
hardly ever shared by documents that have only a passage in common. A set that can have partners in a larger band
is entered there too. Empty parts say nothing: there are as many parts more as empty ones are expected, and a
set with more empty parts than that enters its empty parts as well.

In a tile, bit counts of hashed bitmaps (parity of the n-grams at each bit) bound the overlap from above:
|A xor B| >= popcount(bits A xor bits B). What passes is decided by intersecting the sorted arrays.

A tile may hold a great group of near copies, so tiles aren't paired out. Their members are first compared with
one hub, the member that shares tiles with most others. Members that a hub links are one component, and only members
of different components that share a tile are compared further, blocks of bitmaps against blocks inside a task, from
which only the pairs come that the bit counts let pass. No link that joins two components is lost; links inside a
component need no proof.

Defined results: null and empty texts have no n-grams, are linked with nothing and are their own component. Texts
with fewer words than an n-gram have one n-gram, the whole sequence. Rows with a null doc_id link like others, and have a null
component_id where no row of their component has an id. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnloom.llm.common import digest128, drop_staged, hashes_of, join_counted, list_array, lower_words_of, mixed, rolling, signed, small_or_not, staged, text_rows
from turnloom.llm.components import connected_components

BAND_GROWTH = 1.6
MIN_BITS = 256
#: Tiles of at most so many members give their pairs; those of more are compared in blocks of so many members.
PAIRED_MEMBERS = 32
BLOCK_MEMBERS = 1024


def shingles(words: list[bytes], n: int) -> np.ndarray:
    """Sorted hashes of the distinct n-grams."""
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(rolling(hashes_of(words), min(n, len(words))) + np.uint64(len(words) if len(words) < n else 0))


def most_differences(size_sum: int, percent: int) -> int:
    return size_sum * (100 - percent) // (100 + percent)


class Bands:
    """Size bands and the number of parts in each."""

    def __init__(self, percent: int):
        self.percent, self.edges = percent, [1]

    def band(self, size: int) -> int:
        while self.edges[-1] <= size:
            self.edges.append(max(self.edges[-1] + 1, int(self.edges[-1] * BAND_GROWTH)))
        return int(np.searchsorted(self.edges, size, "right")) - 1

    def families(self, size: int) -> range:
        """The bands in which a set of this size can be the smaller or the larger of a pair."""
        return range(self.band(size), self.band(100 * size // self.percent) + 1)

    def parts(self, family: int) -> tuple[int, int]:
        """Number of parts, and how many of them a linked pair has equal at least."""
        most = most_differences(2 * (self.edges[family + 1] - 1), self.percent)
        spare = 2 + math.ceil((most + 1) * 2 * math.exp(-self.edges[family] / (most + 1)))
        return most + 1 + spare, 1 + spare


def tiles_of(s: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tiles of a set, the band of each, and how many tiles of that band it shares with a linked set at least."""
    keys, families, needs = [], [], []
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(s), dtype=np.uint64)])
    for family in bands.families(len(s)):
        n, equal = bands.parts(family)
        part = (s >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)  # rises with s
        edge = np.searchsorted(part, np.arange(n + 1, dtype=np.uint64))
        empty = edge[1:] == edge[:-1]
        need = equal - int(empty.sum())
        keep = np.ones(n, bool) if need < 1 else ~empty
        label = np.arange(n, dtype=np.uint64) + np.uint64(family << 40)
        keys.append(mixed(total[edge[1:]] - total[edge[:-1]] ^ mixed(label + np.uint64(1)))[keep])
        families.append(np.full(int(keep.sum()), family))
        needs.append(np.full(int(keep.sum()), max(1, need)))
    return np.concatenate(keys), np.concatenate(families), np.concatenate(needs)


def bitmap(s: np.ndarray) -> bytes:
    """Parity of the n-grams at each of two bits an n-gram or more, a power of two of them."""
    n = max(MIN_BITS, 1 << (2 * len(s) - 1).bit_length())
    odd = np.bincount((mixed(s) & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def bit_difference(a: bytes, b: bytes) -> int:
    """Bits in which two bitmaps differ, the longer one folded to the shorter; at most the sets' differences."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays without repeats."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def _signatures(n: int):
    def signatures(batches):
        for batch in batches:
            light = [[] for _ in range(4)]
            for text in text_rows(batch):
                s = shingles(lower_words_of(text), n)
                a, b = digest128(s.tobytes())
                for col, x in zip(light, (len(s), a, b, bitmap(s) if len(s) else None)):
                    col.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(light, kinds))], ["doc_id", "n_shingles", "set_a", "set_b", "bits"])

    return signatures


def short_tag(set_a: int) -> int:
    """A few bits of a set's digest, to tell texts apart that have the same doc_id."""
    return set_a & 0xFFFF


def _tiles(n: int, percent: int):
    def tiles(batches):
        bands = Bands(percent)
        for batch in batches:
            keys, labels = [], []
            for text in text_rows(batch):
                s = shingles(lower_words_of(text), n)
                key, family, need = tiles_of(s, bands) if len(s) else (s, s, s)
                tag = short_tag(digest128(s.tobytes())[0])
                keys.append(signed(key))
                labels.append(need.astype(np.int64) << 24 | family.astype(np.int64) << 16 | tag)
            yield pa.RecordBatch.from_arrays([batch.column(0), list_array(keys, pa.int64()), list_array(labels, pa.int64())], ["doc_id", "keys", "labels"])

    return tiles


def _sets(n: int):
    def sets(batches):
        for batch in batches:
            want = batch.column(batch.schema.get_field_index("tag")).to_numpy(False)
            out, keep = [], []
            for i, text in enumerate(text_rows(batch)):
                s = shingles(lower_words_of(text), n)
                if digest128(s.tobytes())[0] == want[i]:
                    keep.append(i)
                    out.append(signed(s))
            rows = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), list_array(out, pa.int64())], ["doc_id", "sub", "grams"]
            )

    return sets


def _passing(percent: int):
    """Pairs whose bit counts leave a link possible."""

    def passing(batches):
        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("n_a", "n_b", "bits_a", "bits_b")]
            ok = [
                100 * min(na, nb) >= percent * max(na, nb) and bit_difference(xa, xb) <= most_differences(na + nb, percent)
                for na, nb, xa, xb in zip(*cols)
            ]
            yield batch.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    return passing


def _linked(percent: int):
    """Pairs whose sets are similar enough."""

    def linked(batches):
        for batch in batches:
            xs, ys = (batch.column(batch.schema.get_field_index(c)) for c in ("grams_a", "grams_b"))
            ok = []
            for x, y in zip(xs, ys):
                x, y = (np.asarray(v.values).view(np.uint64) for v in (x, y))
                both = overlap(x, y)
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    return linked


def _folded(bits: list[bytes]) -> np.ndarray:
    """Bitmaps as rows of equal length, the shortest one's."""
    rows = [np.frombuffer(b, np.uint64) for b in bits]
    width = min(map(len, rows))
    return np.stack([np.bitwise_xor.reduce(r.reshape(-1, width), axis=0) for r in rows])


def near_pairs(bits: list[bytes], sizes: np.ndarray, comps: np.ndarray, percent: int, left: np.ndarray | None = None):
    """Indices i, j of a tile's members in different components whose bit counts leave a link possible.

    left marks the members of one block, if those are to be held against the others alone.
    """
    rows = _folded(bits)
    of_i, of_j = (np.arange(len(rows)),) * 2 if left is None else (np.flatnonzero(left), np.flatnonzero(~left))
    found = [np.empty((2, 0), np.int64)]  # one of two blocks may be without members
    for lo in range(0, len(of_i), 64):
        i = of_i[lo : lo + 64]
        n, m = sizes[i][:, None], sizes[of_j][None, :]
        differ = np.bitwise_count(rows[i][:, None, :] ^ rows[of_j][None, :, :]).sum(axis=2)
        ok = (differ <= (n + m) * (100 - percent) // (100 + percent)) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
        ok &= comps[i][:, None] != comps[of_j][None, :]
        if left is None:
            ok &= i[:, None] < of_j[None, :]
        x, y = np.nonzero(ok)
        found.append(np.stack([i[x], of_j[y]]))
    return np.concatenate(found, axis=1)


def _tile_pairs(percent: int):
    """near_pairs of one or two blocks of a tile."""

    def pairs(table: pa.Table) -> pa.Table:
        col = {n: table.column(n).to_numpy() for n in ("doc_id", "sub", "n", "comp_doc", "comp_sub", "block")}
        ends = table.column("pair")[0].as_py()
        left = col["block"] == ends["i"] if ends["i"] != ends["j"] else None
        comps = np.unique(np.stack([col["comp_doc"], col["comp_sub"]], axis=1), axis=0, return_inverse=True)[1].ravel()
        x, y = near_pairs(table.column("bits").to_pylist(), col["n"], comps, percent, left)
        node = lambda k: pa.StructArray.from_arrays([pa.array(col["doc_id"][k], pa.int64()), pa.array(col["sub"][k], pa.int32())], ["doc_id", "sub"])
        return pa.table({"a": node(x), "b": node(y)})

    return pairs


NODE = "struct<doc_id: bigint, sub: int>"


def _verified(pairs: DataFrame, bits: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The linked ones of pairs (a, b) of nodes: by bit counts first, then by their sorted arrays."""
    of = lambda df, side: df.select(F.col("node").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in df.columns if c != "node"))
    near = pairs.join(of(bits, "a"), "a").join(of(bits, "b"), "b").mapInArrow(_passing(percent), f"a {NODE}, b {NODE}")
    near = staged(near, "near")
    wanted = near.select(F.col("a").alias("node")).union(near.select(F.col("b").alias("node"))).distinct()
    sets = sets.join(small_or_not(staged(wanted, "wanted")), "node", "left_semi")
    pairs = small_or_not(near).join(of(sets, "a"), "a").join(of(sets, "b"), "b")
    return pairs.mapInArrow(_linked(percent), f"a {NODE}, b {NODE}").distinct()


def _worth_a_look(members: DataFrame) -> DataFrame:
    """Staged members (key, node, family, need), which go, without those that can't be linked with anyone, as key, node.

    A linked set shares `need` tiles of one band; so a node with fewer tiles there that others are in drops out, and with
    it the tiles that it alone kept open.
    """
    several = lambda df: staged(df.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "several")
    counts = several(members)
    enough = join_counted(members, counts, "key").groupBy("node", "family").agg(F.count(F.lit(1)).alias("n"), F.first("need").alias("least"))
    enough = staged(enough.where("n >= least").select("node", "family"), "enough")
    kept = staged(members.join(small_or_not(enough), ["node", "family"]).select("key", "node"), "kept")
    drop_staged(members, counts, enough)
    counts = several(kept)
    tiles = staged(join_counted(kept, counts, "key").select("key", "node"), "tiles")
    drop_staged(kept, counts)
    return tiles


def _hub_pairs(tiles: DataFrame) -> DataFrame:
    """Each member of a tile (key, node) with the tile's hub.

    The hub is the member that shares tiles with the most others, so the text that near copies were made from, if
    it is there.
    """
    sizes = staged(tiles.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "sizes")
    weights = small_or_not(staged(join_counted(tiles, sizes, "key").groupBy("node").agg(F.sum("n").alias("weight")), "weights"))
    hubs = tiles.join(weights, "node").groupBy("key").agg(F.max_by("node", F.struct("weight", -F.col("node.doc_id"))).alias("hub"), F.count(F.lit(1)).alias("n"))
    pairs = join_counted(tiles, staged(hubs, "hubs"), "key").where("node != hub")
    return pairs.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def _residual_pairs(tiles: DataFrame, links: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """Pairs in one tile that links leave in different components, as far as their bit counts let them be linked.

    A member counts to the component of the least node it is linked with. Small tiles give their pairs; the members of a large
    one are dealt to blocks, and each two blocks are compared in a task of their own, which tells what the bit counts let pass.
    """
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
    labels = small_or_not(staged(both.groupBy("node").agg(F.least("node", F.min("other")).alias("comp")), "labels"))
    members = staged(tiles.join(labels, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp")), "labelled")
    mixed_tiles = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("c0"), F.max("comp").alias("c1"))
    mixed_tiles = staged(mixed_tiles.where("c0 != c1").select("key", "n"), "mixed-tiles")
    rest = staged(join_counted(members, mixed_tiles, "key").withColumnRenamed("n", "members"), "open-tiles")
    drop_staged(members, mixed_tiles)
    small = rest.where(F.col("members") <= PAIRED_MEMBERS)
    one, other = (small.select("key", F.col("node").alias(c), F.col("comp").alias(f"comp_{c}")) for c in ("a", "b"))
    pairs = one.join(other, "key").where("a < b and comp_a != comp_b").select("a", "b")

    n_blocks = F.ceil(F.col("members") / BLOCK_MEMBERS).cast("int")
    large = rest.where(F.col("members") > PAIRED_MEMBERS).withColumn("block", F.pmod(F.xxhash64("node"), n_blocks).cast("int")).join(bits, "node")
    dealt = large.withColumn("other", F.explode(F.sequence(F.lit(0), n_blocks - 1))).select(
        F.struct(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).alias("pair"), "key",
        "node.doc_id", "node.sub", F.col("comp.doc_id").alias("comp_doc"), F.col("comp.sub").alias("comp_sub"), "n", "bits", "block",
    )
    blocks = dealt.groupBy("key", "pair").applyInArrow(_tile_pairs(percent), f"a {NODE}, b {NODE}")
    return pairs.union(blocks.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()


def _with_ids(docs: DataFrame) -> tuple[DataFrame, int | None]:
    """docs whose rows without an id have ones above all others, and the greatest id of the others (None: all have one)."""
    lacking, top = docs.agg(F.count_if(F.col("doc_id").isNull()), F.max("doc_id")).first()
    if not lacking:
        return docs, None
    top = -1 if top is None else top
    number = F.monotonically_increasing_id() + F.lit(top + 1)
    named = staged(docs.where("doc_id is null").withColumn("doc_id", number), "rows-without-id")
    return docs.where("doc_id is not null").unionByName(named), top


def similar_documents(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, n_shingles, component_id.

    Documents are linked when 100 * |A & B| >= percent * |A | B|; component_id is the smallest doc_id that links
    reach, the document's own included. Ids may not come within the number of rows of the greatest long.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs, top = _with_ids(docs)
    found = _similar(docs, n, percent)
    real = lambda c: (F.col(c) if top is None else F.when(F.col(c) <= top, F.col(c))).alias(c)
    return found.select(real("doc_id"), "n_shingles", real("component_id"))


def _similar(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """similar_documents of rows that all have an id."""
    base = staged(docs.mapInArrow(_signatures(n), "doc_id long, n_shingles long, set_a long, set_b long, bits binary"), "signatures")
    classes = base.where("n_shingles > 0").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n"))
    # The first document of a class stands for it. sub tells classes apart that have the same first doc_id.
    nodes = classes.where("first_doc is not null").withColumn(
        "sub", F.row_number().over(Window.partitionBy("first_doc").orderBy("set_a", "set_b")) - 1
    )
    nodes = nodes.select(F.col("first_doc").alias("doc_id"), "sub", "set_a", "set_b", (F.col("set_a").bitwiseAND(0xFFFF)).cast("int").alias("tag"))
    nodes = staged(nodes, "nodes")

    # The tiles of all documents, made twice rather than kept: first to count, then to join. Copies come along and drop out
    # when only first documents are kept.
    made = docs.where("doc_id is not null").mapInArrow(_tiles(n, percent), "doc_id long, keys array<long>, labels array<long>")
    entered = made.select("doc_id", F.explode(F.arrays_zip("keys", "labels")).alias("t")).select(F.col("t.keys").alias("key"), "doc_id", F.col("t.labels").alias("label"))
    shared = staged(entered.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "shared")
    firsts = nodes.select("doc_id", "tag", F.struct("doc_id", "sub").alias("node"))
    label = F.col("label")
    members = (
        entered.join(shared, "key")
        .withColumn("tag", label.bitwiseAND(0xFFFF).cast("int"))
        .join(firsts, ["doc_id", "tag"])
        .select("key", "node", F.shiftright(label, 16).bitwiseAND(0xFF).cast("int").alias("family"), F.shiftright(label, 24).cast("int").alias("need"))
        .distinct()
    )
    members = staged(members, "members")
    drop_staged(shared)
    tiles = _worth_a_look(members)
    in_tiles = nodes.withColumn("node", F.struct("doc_id", "sub")).join(tiles.select("node").distinct(), "node")
    in_tiles = staged(in_tiles.drop("tag"), "tile-nodes")
    few = small_or_not(in_tiles)
    bits = base.join(few, ["doc_id", "set_a", "set_b"]).select("node", F.col("n_shingles").alias("n"), "bits")
    bits = staged(bits.dropDuplicates(["node"]), "bits")
    sets = docs.join(few, "doc_id").select("doc_id", "sub", F.col("set_a").alias("tag"), "text")
    sets = sets.mapInArrow(_sets(n), "doc_id long, sub int, grams array<long>")
    sets = staged(sets.select(F.struct("doc_id", "sub").alias("node"), "grams"), "sets")

    links = staged(_verified(_hub_pairs(tiles), bits, sets, percent), "links")
    more = staged(_verified(_residual_pairs(tiles, links, bits, percent), bits, sets, percent), "links")
    labels = connected_components(links.union(more))
    drop_staged(tiles, bits, sets, links, more, in_tiles)

    named = labels.select("node.doc_id", "node.sub", F.col("comp.doc_id").alias("comp_doc")).join(nodes, ["doc_id", "sub"])
    # Only rows of classes with several rows or links have to look up their component.
    groups = classes.join(named.select("set_a", "set_b", "comp_doc"), ["set_a", "set_b"], "left").where("n > 1 or comp_doc is not null")
    groups = staged(groups.select("set_a", "set_b", "n", F.coalesce("comp_doc", "first_doc").alias("component_id")), "groups")
    rows = base.where("n_shingles > 0").select("doc_id", "n_shingles", "set_a", "set_b")
    found = join_counted(rows, groups, ["set_a", "set_b"], "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return found.unionByName(base.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def op8_ngram_join(spark, sf_dir: str) -> DataFrame:
    return similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=3, percent=90)


#: All pairs that share a shingle are counted: for tables of test size.
OP8_SQL = """WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda p: w[p] || ' ' || w[p + 1] || ' ' || w[p + 2])) END AS g FROM d),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS common FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs WHERE 100 * common >= 90 * (na + nb - common)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a)
SELECT doc_id, len(g)::BIGINT AS n_shingles, least(doc_id, coalesce(m, doc_id))::BIGINT AS component_id FROM s LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a) USING (doc_id)"""

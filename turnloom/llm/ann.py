"""Approximate nearest neighbours by one navigable small-world graph for each shard.

Vectors that are equal share one place, known by 128 bits of hash: they score alike, and only the least ids among them can be
among a query's nearest. The places of each band of lengths are dealt by hash to shards of about SHARD_VECTORS: a shard holds vectors of
nearly one length, for which near in angle is near in inner product. Each shard is indexed in one task by
a hierarchical navigable small-world graph (Malkov and Yashunin, 2016) whose layers are flat arrays: row i holds the
neighbours of node i, filled up with -1. The graphs are stored as rows of the shared folder.

Links follow distances between points that have one component more than their vectors, which puts all points of a shard on one
sphere, so that near points are near in inner product too. Queries walk by the inner product itself. Nodes enter the graph in batches: each batch searches the graph of the earlier ones at once, and each node is
joined to those candidates that are nearer to it than to one another, both ways. What can't be reached then is linked from the
nearest node that can.

Queries go to every shard of vectors as long as they are, in groups, and search it likewise, EF candidates wide; where the last
candidate ties with the K-th, again and wider, until it doesn't. A shard answers each query with its K best places, scored on
the original vectors in double precision, ties to the place with the least vec_id; answers are merged in the same order. As every
query meets every shard, with queries a fixed part of the rows the search (not the indexing) grows with the square of the table, by
rows * rows / (QUERY_STEP * SHARD_VECTORS) walks of some thousand steps.

Defined results: rows with a null id or a vector that is null, empty, zero or holds null or non-finite components take
no part, neither as queries nor as candidates. A vector's candidates are those of its own length; between others there is no
inner product. Repeated rows of one id and vector are one candidate. A query with fewer candidates than K gets them all.
Products that overflow are infinite and rank so; one that is infinite both ways is NaN and ranks last. Extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnloom.llm.common import small_or_not, staged

K = 20
QUERY_STEP = 20
SHARD_VECTORS = 16384
DEGREE = 16
EF_BUILD = 64
EF = 128
#: Bands of length to a factor of two; lengths of about 1 lie in the middle of one.
BANDS = 4
BATCH = 256
QUERY_GROUP = 2048
#: Products closer than this part of the largest possible one count as ties when a walk is widened.
TIE = 1e-9


def _top(distance: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's k smallest distances and their ids, sorted."""
    if distance.shape[1] > k:
        at = np.argpartition(distance, k - 1, axis=1)[:, :k]
        distance, ids = np.take_along_axis(distance, at, 1), np.take_along_axis(ids, at, 1)
    order = np.argsort(distance, axis=1, kind="stable")
    return np.take_along_axis(distance, order, 1), np.take_along_axis(ids, order, 1)


class Space:
    """Points, and what is added to the negative product with a query to get a distance to rank by.

    With 2 * p for a query and the points' squares to add, that is the squared distance to p but for p's own square; with nothing to
    add it is the inner product, largest first.
    """

    def __init__(self, points: np.ndarray, add: np.ndarray):
        self.points, self.add = points, add

    def __len__(self) -> int:
        return len(self.points)

    def part(self, nodes: np.ndarray) -> Space:
        return Space(self.points[nodes], self.add[nodes])


def beam_search(space: Space, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the width nodes nearest to it that a best-first walk from its entry (queries by 1 or more) finds.

    All queries walk at once: in each step every query expands its nearest unexpanded candidate.
    """
    n, points, add = len(queries), space.points, space.add
    seen = np.zeros((n, len(points)), bool)
    rows = np.arange(n)[:, None]
    ids = np.full((n, width), -1)
    dist = np.full((n, width), np.inf)
    ids[:, : entry.shape[1]] = entry
    dist[:, : entry.shape[1]] = add[entry] - np.einsum("qd,qed->qe", queries, points[entry])
    dist[ids < 0] = np.inf
    seen[rows, entry] = True
    done = ids < 0
    while True:
        open_ = np.where(done, np.inf, dist)
        best = open_.argmin(axis=1)
        active = np.flatnonzero(np.isfinite(open_[np.arange(n), best]))
        if not len(active):
            return dist, ids
        best = best[active]
        done[active, best] = True
        near = links[ids[active, best]]
        fresh = (near >= 0) & ~seen[active[:, None], near]
        a, b = np.nonzero(fresh)
        node = near[a, b]
        seen[active[a], node] = True
        d = np.full(near.shape, np.inf)
        d[a, b] = add[node] - np.einsum("ij,ij->i", queries[active[a]], points[node])
        all_d = np.concatenate([dist[active], d], axis=1)
        at = np.argpartition(all_d, width - 1, axis=1)[:, :width]
        dist[active] = np.take_along_axis(all_d, at, 1)
        ids[active] = np.take_along_axis(np.concatenate([ids[active], near], axis=1), at, 1)
        done[active] = np.take_along_axis(np.concatenate([done[active], ~fresh], axis=1), at, 1)
        ids[active] = np.where(np.isfinite(dist[active]), ids[active], -1)
        done[active] |= ids[active] < 0


def _choose(space: Space, near: np.ndarray, dist: np.ndarray, degree: int) -> np.ndarray:
    """Of each row's candidates, sorted by distance, those nearer to the node than to a chosen one; then the rest."""
    n, width = near.shape
    x, square = space.points[np.maximum(near, 0)], space.add[np.maximum(near, 0)]
    between = square[:, :, None] + square[:, None, :] - 2 * np.matmul(x, x.transpose(0, 2, 1))
    chosen = np.zeros((n, width), bool)
    valid = (near >= 0) & np.isfinite(dist)
    for j in range(width):
        blocked = (chosen[:, :j] & (between[:, j, :j] < dist[:, j, None])).any(axis=1)
        chosen[:, j] = valid[:, j] & ~blocked & (chosen.sum(axis=1) < degree)
    # The chosen come first in their order, then others up to the degree.
    order = np.argsort(np.where(chosen, 0, np.where(valid, 1, 2)), axis=1, kind="stable")[:, :degree]
    out = np.take_along_axis(near, order, 1)
    return np.where(np.take_along_axis(valid, order, 1), out, -1)


def _add_back(space: Space, links: np.ndarray, nodes: np.ndarray) -> None:
    """Link the nodes' neighbours back to them; a full neighbour chooses anew among all."""
    source, slot = np.nonzero(links[nodes] >= 0)
    target = links[nodes[source], slot]
    order = np.argsort(target, kind="stable")
    target, source = target[order], nodes[source[order]]
    at, start, count = np.unique(target, return_index=True, return_counts=True)
    degree = links.shape[1]
    wide = np.full((len(at), degree + int(count.max(initial=0))), -1)
    wide[:, :degree] = links[at]
    rank = np.arange(len(target)) - np.repeat(start, count)
    wide[np.repeat(np.arange(len(at)), count), degree + rank] = source
    for lo in range(0, len(at), BATCH):
        w, own = wide[lo : lo + BATCH], at[lo : lo + BATCH]
        to = np.maximum(w, 0)
        d = space.add[own][:, None] + space.add[to] - 2 * np.einsum("nd,nwd->nw", space.points[own], space.points[to])
        d[w < 0] = np.inf
        free = (w >= 0).sum(axis=1) <= degree
        d, w = _top(d, w, min(w.shape[1], 2 * degree))
        links[at[lo : lo + BATCH]] = np.where(free[:, None], np.where(np.isfinite(d), w, -1)[:, :degree], _choose(space, w, d, degree))


def _entries(above: list[tuple[np.ndarray, np.ndarray]], nodes: np.ndarray, space: Space, queries: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where queries enter a layer: at the best node of the layer above, which is in this one too."""
    if not above:
        return np.repeat(first[None, :1], len(queries), axis=0)
    upper, links = above[0]
    at = np.searchsorted(nodes, upper)  # the upper layer's nodes in this layer
    start = _entries(above[1:], upper, space.part(at), queries, np.zeros(1, int))
    dist, ids = beam_search(space.part(at), links, queries, start, 8)
    return at[_top(dist, ids, 1)[1]]


def _reach_all(space: Space, links: np.ndarray, first: int) -> np.ndarray:
    """Links by which a walk from first comes to every node: one that can't be reached is added to the nearest that can."""
    while True:
        seen = np.zeros(len(links), bool)
        edge = np.array([first])
        while len(edge):
            seen[edge] = True
            edge = np.unique(links[edge])
            edge = edge[(edge >= 0)]
            edge = edge[~seen[edge]]
        if seen.all():
            return links
        lost, there = int(np.flatnonzero(~seen)[0]), np.flatnonzero(seen)
        near = there[(space.add[there] - 2 * (space.points[there] @ space.points[lost])).argmin()]
        if (links[near] >= 0).all():
            links = np.concatenate([links, np.full((len(links), 1), -1)], axis=1)
        links[near, np.flatnonzero(links[near] < 0)[0]] = lost


def build_graph(points: np.ndarray, degree: int = DEGREE, ef: int = EF_BUILD, seed: int = 11) -> list[tuple[np.ndarray, np.ndarray]]:
    """Layers of the graph over points, the lowest first: the nodes of a layer (rising) and their links.

    Links are numbers in the layer; layer 0 holds all nodes and has twice the degree.
    """
    n, rng = len(points), np.random.default_rng(seed)
    space = Space(points, np.einsum("ij,ij->i", points, points))
    level = np.minimum(np.floor(-np.log(1 - rng.random(n)) / np.log(degree)).astype(int), 8)
    layers = []
    for l in range(int(level.max(initial=0)), -1, -1):
        nodes = np.flatnonzero(level >= l)
        part = space.part(nodes)
        links = np.full((len(nodes), degree * 2 if l == 0 else degree), -1)
        # The nodes of the layer above come first: they are there to enter by.
        order = np.argsort(-level[nodes], kind="stable")
        done = 0
        while done < len(order):
            # Up to its end the layer above isn't wholly here yet.
            upto = len(layers[0][0]) if layers and done < len(layers[0][0]) else len(order)
            new = order[done : min(upto, done + max(1, min(BATCH, done)))]
            if done:
                inside = layers if layers and done >= len(layers[0][0]) else []
                asked = 2 * part.points[new]
                entry = _entries(inside, nodes, part, asked, order[:1])
                dist, near = beam_search(part, links, asked, entry, ef)
                dist, near = _top(dist + part.add[new][:, None], near, ef)
                links[new] = _choose(part, near[:, : ef // 2], dist[:, : ef // 2], links.shape[1])
                _add_back(part, links, new)
            done += len(new)
        layers.insert(0, (nodes, _reach_all(part, links, int(order[0])) if not layers else links))
    nodes, links = layers[0]
    if len(layers) > 1:
        layers[0] = nodes, _reach_all(space, links, int(layers[1][0][0]))
    return layers


def search_graph(vectors: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], queries: np.ndarray, ef: int = EF) -> np.ndarray:
    """For each query the ef nodes found with the largest products, -1 where fewer."""
    nodes, links = layers[0]
    space = Space(vectors, np.zeros(len(vectors)))
    entry = _entries(layers[1:], nodes, space, queries, np.zeros(1, int))
    return _top(*beam_search(space, links, queries, entry, ef), ef)[1]


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors over the largest component of them all, so that no square overflows."""
    return vectors / (np.abs(vectors).max(initial=0.0) or 1.0)


def on_sphere(vectors: np.ndarray) -> np.ndarray:
    """Points on one sphere about (0, ..., 0, radius) whose order by distance to far points is that of inner products."""
    square = np.einsum("ij,ij->i", vectors, vectors)
    most = square.max(initial=0.0)
    # The radius less the root of most - square, without the loss of digits.
    depth = square / np.maximum(np.sqrt(most) + np.sqrt(np.maximum(most - square, 0)), 1e-300)
    return np.concatenate([vectors, depth[:, None]], axis=1)


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1)


_GRAPH = "dim int, band int, shard int, layer int, nodes array<int>, links array<int>"


def _index(table: pa.Table) -> pa.Table:
    """The graph of a shard's vectors in the order of their places."""
    key = [table.column(c)[0].as_py() for c in ("dim", "band", "shard")]
    order = np.argsort(table.column("place").to_numpy(), kind="stable")
    layers = build_graph(on_sphere(scaled(_matrix(table.column("vector"))[order])))
    rows = [(*key, i, n.astype(np.int32), k.ravel().astype(np.int32)) for i, (n, k) in enumerate(layers)]
    kinds = [pa.int32()] * 4 + [pa.list_(pa.int32())] * 2
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["dim", "band", "shard", "layer", "nodes", "links"])


def best_nodes(x: np.ndarray, least: np.ndarray, layers: list, q: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query, node and score of the k best nodes found for each query, by score and then least.

    A query whose last candidate ties with its k-th walks again, eight times as wide.
    """
    small = scaled(x)
    reach = np.sqrt(np.einsum("ij,ij->i", small, small).max(initial=0.0))
    unit = q / np.abs(q).max(axis=1, keepdims=True)
    length = np.sqrt(np.einsum("ij,ij->i", unit, unit))
    out, todo, width = [], np.arange(len(q)), min(max(ef, k), len(x))
    while len(todo):
        again = []
        for lo in range(0, len(todo), BATCH):
            ask = todo[lo : lo + BATCH]
            found = search_graph(small, layers, unit[ask], width)
            there, node = found >= 0, np.maximum(found, 0)
            with np.errstate(over="ignore", invalid="ignore"):
                score = np.einsum("qd,qfd->qf", q[ask], x[node])
            near = np.where(there, np.einsum("qd,qfd->qf", unit[ask], small[node]), np.inf)
            rank = np.where(there, np.where(np.isnan(score), -np.inf, score), -np.inf)
            order = np.lexsort((least[node], -rank, ~there), axis=1)[:, :k]
            kth = np.take_along_axis(near, order[:, -1:], 1)[:, 0]
            tied = (near.min(axis=1) >= kth - TIE * reach * length[ask]) & there.all(axis=1) & (width < len(x))
            a, b = np.nonzero(np.take_along_axis(there, order, 1) & ~tied[:, None])
            at = order[a, b]
            out.append((ask[a], node[a, at], score[a, at]))
            again.append(ask[tied])
        todo, width = np.concatenate(again), min(8 * width, len(x))
    return tuple(np.concatenate(c) for c in zip(*out))


def _answers(k: int, ef: int):
    def answers(part: pa.Table, graph: pa.Table) -> pa.Table:
        """The k best places of a shard for each of a group of queries; the part holds both, marked."""
        asks = np.asarray(part.column("is_query"), bool)
        vectors, queries = part.filter(pa.array(~asks)), part.filter(pa.array(asks))
        names = ("query", "found", "least", "score")
        if not len(vectors) or not len(queries):
            return pa.table([pa.array([], pa.int64())] * 3 + [pa.array([], pa.float64())], names)
        places = vectors.column("place").to_numpy()
        order = np.argsort(places, kind="stable")
        places, least, x = places[order], vectors.column("least").to_numpy()[order], _matrix(vectors.column("vector"))[order]
        by_layer = sorted(zip(graph.column("layer").to_pylist(), graph.column("nodes").to_pylist(), graph.column("links").to_pylist()))
        layers = [(np.array(n), np.array(links).reshape(len(n), -1)) for _, n, links in by_layer]
        query, node, score = best_nodes(x, least, layers, _matrix(queries.column("vector")), k, ef)
        return pa.table([queries.column("place").to_numpy()[query], places[node], least[node], score], names)

    return answers


def usable(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, embedding) that take part, as vec_id, vector (doubles), dim."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")).where(
        F.col("vec_id").isNotNull() & (F.size("vector") > 0)
    )
    finite = ~F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return rows.where(finite & F.exists("vector", lambda v: v != 0)).withColumn("dim", F.size("vector"))


def length_band(vector) -> F.Column:
    """The number of a vector's band of length, taken over the largest component so that no square overflows."""
    most = F.array_max(F.transform(vector, F.abs))
    square = F.aggregate(vector, F.lit(0.0), lambda s, v: s + (v / most) * (v / most))
    return F.floor((F.log2(most) + F.log2(square) / 2) * BANDS + 0.5).cast("int")


def nearest(vectors: DataFrame, k: int = K, query_step: int = QUERY_STEP, shard_vectors: int = SHARD_VECTORS, ef: int = EF) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest others of each row whose vec_id is divisible by query_step."""
    key = F.concat(F.hex(F.xxhash64("vector")), F.lit("."), F.hex(F.xxhash64(F.lit(1), "vector")))
    rows = staged(usable(vectors).withColumn("vkey", key), "vectors")
    distinct = rows.groupBy("vkey").agg(F.first("vector").alias("vector"), F.first("dim").alias("dim"), F.min("vec_id").alias("least"))
    distinct = distinct.withColumns({"place": F.monotonically_increasing_id(), "band": length_band(F.col("vector"))})
    places = staged(distinct, "places")
    at = rows.select("vkey", "vec_id").join(places.select("vkey", "place", "dim"), "vkey").drop("vkey")
    asked = staged(at.where(F.col("vec_id") % query_step == 0).select("place", F.col("vec_id").alias("query_id")).distinct(), "asked")

    sizes = places.groupBy("dim", "band").agg(F.ceil(F.count(F.lit(1)) / shard_vectors).cast("int").alias("shards"))
    sizes = staged(sizes, "shard-counts")
    number = F.pmod(F.xxhash64("vkey"), F.col("shards")).cast("int")
    dealt = places.join(small_or_not(sizes), ["dim", "band"]).select("dim", "band", number.alias("shard"), "place", "least", "vector")
    graphs = staged(dealt.groupBy("dim", "band", "shard").applyInArrow(_index, _GRAPH), "graphs")

    # Each group of queries meets each shard's vectors in one task.
    groups = max(1, -(-asked.select("place").distinct().count() // QUERY_GROUP))
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    queries = places.join(asked.select("place").distinct(), "place", "left_semi").drop("band").join(small_or_not(sizes), "dim")
    group = F.pmod(F.xxhash64("place"), F.lit(groups)).cast("int").alias("group")
    part = queries.select("dim", "band", each(F.col("shards")).alias("shard"), group, "place", "least", "vector", F.lit(True).alias("is_query"))
    part = part.unionByName(dealt.select("*", each(F.lit(groups)).alias("group"), F.lit(False).alias("is_query")))
    graph_part = graphs.select("*", each(F.lit(groups)).alias("group"))
    keys = ("dim", "band", "shard", "group")
    answers = part.groupBy(*keys).cogroup(graph_part.groupBy(*keys)).applyInArrow(_answers(k + 1, ef), "query long, found long, least long, score double")

    # The best places of each query over the shards, then the ids at them. One place may be the query's own, so k + 1 of both are enough.
    value = F.when(F.isnan("score"), float("-inf")).otherwise(F.col("score"))
    first = lambda df, by, *order: df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= k + 1).drop("_r")
    best = first(answers, ["query"], value.desc(), "least")
    salted = first(at.select("place", "vec_id", F.pmod("vec_id", F.lit(64)).alias("salt")).distinct(), ["place", "salt"], "vec_id")
    ids = first(salted, ["place"], "vec_id").select(F.col("place").alias("found"), "vec_id")
    named = staged(first(best.join(ids, "found"), ["query"], value.desc(), "vec_id").select("query", "vec_id", "score"), "named")
    ranked = Window.partitionBy("query_id").orderBy(value.desc(), "vec_id")
    return (
        asked.join(named, F.col("place") == F.col("query"))
        .where("query_id != vec_id")
        .withColumn("rank", F.row_number().over(ranked).cast("int"))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def op7_ann(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

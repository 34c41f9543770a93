"""Mixing sources to target weights by temperature.

A source with the share p of all tokens gets the weight p**a / sum of p**a. The exponent a lies between 0 (all
sources alike) and 1 (as they are) and is found by bisection: the largest a whose weights have at least the target
entropy (given as a part of log of the number of sources), or, where that would repeat a source more often than
max_repeats times over the token budget, the smallest a that doesn't. Each round of the bisection evaluates many
exponents in one aggregate over the sources, whose number may grow with the data; nothing but sums comes to the
driver.

The weights times the budget are quotas of tokens. A source's rows are dealt by hash to blocks of about as
many rows as there are blocks (but BLOCK_ROWS at most), and the blocks in their order, each permuted by hash, are the source's permutation. The quota takes
whole rounds of it, and in the last round its blocks, and then the rows of one block, up to what is left. So the plan
needs the sums of blocks and the order of one block's rows for each source, and no task ever sorts a whole source (the square root of
its rows is what a task sorts: the sums of its blocks, or the rows of one); each
row then reads off how often it is taken (copies). A quota is missed by less than one row, or one set of repeated rows.

Defined results: a null source is a source of its own; a null text has no tokens. A source without tokens is taken
once. Repeated rows are taken alike. Columns of docs named like the added ones are replaced; an empty table gives an
empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnloom.llm.common import free_name, staged

#: A block's rows at most. Only sources of more than its square have more blocks than a block has rows.
BLOCK_ROWS = 20_000
STEPS = 16
ROUNDS = 8
#: A plan of more sources than this (a hundred bytes each) is joined by shuffle.
BROADCAST_SOURCES = 100_000


def word_count(text):
    """Words `[^\\x20\\x09-\\x0D]+`."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _measures(shares: DataFrame, exponents: list[float], ratio: float) -> list[tuple[float, float, float]]:
    """For each exponent: itself, the entropy of the weights and the largest number of repeats, in one pass.

    ratio is the budget over all tokens, so a source is repeated weight * ratio / share times.
    """
    columns = []
    for i, a in enumerate(exponents):
        power = F.pow("share", F.lit(a))
        columns += [F.sum(power).alias(f"s{i}"), F.sum(power * F.log("share")).alias(f"l{i}"), F.max(power / F.col("share")).alias(f"m{i}")]
    row = shares.where("share > 0").agg(*columns).first()
    # entropy of w = p**a / S: log S - a * sum(p**a log p) / S
    return [(a, math.log(row[f"s{i}"]) - a * row[f"l{i}"] / row[f"s{i}"], ratio * row[f"m{i}"] / row[f"s{i}"]) for i, a in enumerate(exponents)]


def find_exponent(shares: DataFrame, entropy: float, max_repeats: float, ratio: float) -> float:
    """The exponent for shares (share), by repeated section of 0 to 1; both measures are monotone in it.

    The repetition limit comes first. 1.0 where there is one source or none.
    """
    n = shares.where("share > 0").count()
    if n < 2:
        return 1.0
    target = entropy * math.log(n)

    def section(keeps, low: float, high: float) -> tuple[float, float]:
        """Narrow low, high to a step; keeps(measure) holds at low and not at high."""
        for _ in range(ROUNDS):
            grid = [low + (high - low) * k / STEPS for k in range(1, STEPS)]
            measured = _measures(shares, grid, ratio)
            ok = [a for a, *m in measured if keeps(*m)]
            low, high = max([low, *ok]), min([high, *(a for a, *m in measured if not keeps(*m))])
        return low, high

    (_, h1, _), (_, _, r0), (_, _, r1) = *_measures(shares, [1.0], ratio), *_measures(shares, [0.0, 1.0], ratio)
    flat = 1.0 if h1 >= target else section(lambda h, r: h >= target, 0.0, 1.0)[0]
    if r0 <= max_repeats:
        return flat
    if r1 > max_repeats:
        return 1.0  # even the shares as they are repeat more: the budget is that large
    least = section(lambda h, r: r > max_repeats, 0.0, 1.0)[1]
    return max(flat, least)


def mixing_plan(light: DataFrame, budget: float, entropy: float, max_repeats: float) -> DataFrame:
    """For rows (source, key, n_tokens), one row a source: weight, rounds, n_blocks, cut_block, cut_key.

    A row is taken rounds times, and once more if its block lies before cut_block, or is it and key <= cut_key.
    """
    sources = light.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    sources = staged(sources, "sources")
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    shares = sources.withColumn("share", F.col("tokens") / F.lit(float(max(total, 1))))
    power = F.when(F.col("share") > 0, F.pow("share", F.lit(find_exponent(shares, entropy, max_repeats, budget)))).otherwise(0.0)
    norm = shares.agg(F.sum(power)).first()[0] or 1.0
    quota = F.floor(F.col("weight") * F.lit(budget * total) + F.lit(1e-6)).cast("long")
    quotas = staged(
        shares.withColumn("weight", power / norm).select(
            F.col("source").alias("of"),
            "weight",
            F.when(F.col("tokens") > 0, F.floor(quota / F.col("tokens"))).otherwise(1).cast("long").alias("rounds"),
            F.when(F.col("tokens") > 0, quota % F.col("tokens")).otherwise(0).cast("long").alias("left"),
            F.ceil(F.col("rows") / F.least(F.lit(BLOCK_ROWS), F.ceil(F.sqrt("rows")))).cast("long").alias("n_blocks"),
        ),
        "quotas",
    )
    dealt = light.join(quotas, F.col("source").eqNullSafe(F.col("of"))).withColumn("block", block_of(F.col("key"), F.col("n_blocks")))
    blocks = dealt.groupBy("of", "block").agg(F.sum("n_tokens").alias("size"), F.first("left").alias("left"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("of").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = staged(
        blocks.withColumn("before", before)
        .where("before <= left and left < before + size")
        .select(F.col("of").alias("cut_of"), F.col("block").alias("cut_block"), (F.col("left") - F.col("before")).alias("rest")),
        "cuts",
    )
    keys = (
        dealt.join(cuts, F.col("of").eqNullSafe(F.col("cut_of")) & (F.col("block") == F.col("cut_block")))
        .groupBy("cut_of", "rest", "key")
        .agg(F.sum("n_tokens").alias("size"))
        .withColumn("upto", F.sum("size").over(Window.partitionBy("cut_of").orderBy("key")))
    )
    last = keys.where("upto <= rest").groupBy(F.col("cut_of").alias("last_of")).agg(F.max("key").alias("cut_key"))
    return (
        quotas.join(cuts, F.col("of").eqNullSafe(F.col("cut_of")), "left")
        .join(last, F.col("of").eqNullSafe(F.col("last_of")), "left")
        .select("of", "weight", "rounds", "n_blocks", "cut_block", "cut_key")
    )


def block_of(key, n_blocks):
    return F.pmod(F.xxhash64(key), n_blocks)


def mix(
    docs: DataFrame, budget: float = 2.0, entropy: float = 0.95, max_repeats: float = 4.0, seed: int = 17, names=("n_tokens", "weight", "copies")
) -> DataFrame:
    """docs (doc_id, text, source and others) with its tokens, the weight of its source and copies, under the given names.

    budget is the number of tokens to draw as a part of all tokens there are. With more than there are, sources that
    hold less than their weight are repeated; with the default, even one that holds a third of all tokens among many keeps all
    its documents.
    """
    n_tokens = word_count(F.col("text"))
    key = F.xxhash64(F.lit(seed), F.coalesce(F.col("source").cast("string"), F.lit("")), "doc_id", "text")
    light = staged(docs.select(F.col("source").cast("string").alias("source"), key.alias("key"), n_tokens.alias("n_tokens")), "mixing")
    of, plan_name, key_name = (free_name(docs, c) for c in ("_mix_of", "_mix_plan", "_mix_key"))
    plan = mixing_plan(light, budget, entropy, max_repeats)
    plan = staged(plan.select(F.col("of").alias(of), F.struct("weight", "rounds", "n_blocks", "cut_block", "cut_key").alias(plan_name)), "plan")
    if plan.count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    own, row_key = F.col(plan_name), F.col(key_name)
    block = block_of(row_key, own["n_blocks"])
    once_more = (block < own["cut_block"]) | ((block == own["cut_block"]) & (row_key <= own["cut_key"]))
    return (
        docs.drop(*names)
        .withColumns({names[0]: n_tokens, key_name: key})
        .join(plan, F.col("source").cast("string").eqNullSafe(F.col(of)))
        .withColumns({names[1]: own["weight"], names[2]: (own["rounds"] + F.coalesce(once_more, F.lit(False)).cast("long")).cast("long")})
        .drop(key_name, of, plan_name)
    )


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "source", "n_tokens", "weight", "copies")

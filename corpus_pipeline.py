"""From raw documents to training shards: five stages over turnloom.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. The
result of a stage is written as Parquet and read again before the next begins, so an executor lost later costs nothing
of what is done. Null texts are low in quality by their shape and go in the first stage, like empty ones.

All stages keep columns that they don't need, whatever their names; an empty table stays empty. What each makes of nulls, empty
texts, ties and repeated rows stands with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.llm.common import free_name, small_or_not, staged
from turnloom.llm.decontamination import contaminated
from turnloom.llm.mixing import mix
from turnloom.llm.ngram_join import similar_documents
from turnloom.llm.quality import keep_good, quality_model
from turnloom.llm.sharding import shard_rows


#: Tokens to draw as a part of all tokens there are: enough that a source of a third of them keeps every document among twenty.
#: Below 1 documents are left out, too.
TOKEN_BUDGET = 2.0


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from those of them that have labels, doesn't reject.

    Null and empty texts are scored like others, by their shape; equal texts share a score, so repeated rows stay or go together, and a
    score at the threshold stays. Ids play no part. Without labels all have the score 0.5 and stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return keep_good(docs, quality_model(docs, labels))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group linked by five-word shingles at a similarity of 0.8 or more.

    If a doc_id is repeated, its rows are told apart by number: those with unlike texts all stay, and of a group's rows one
    with the smallest doc_id does. Texts without words are copies of those with the same id alone. Rows without an id stay.
    """
    ids = docs.agg(F.count("doc_id"), F.countDistinct("doc_id")).first()
    if ids[0] != ids[1]:
        return _one_row_of_each(docs)
    gone = similar_documents(docs, n=5, percent=80).where("doc_id != component_id").select("doc_id")
    return docs.join(small_or_not(staged(gone, "gone")), "doc_id", "left_anti").select(docs.columns)


def _one_row_of_each(docs: DataFrame) -> DataFrame:
    """one_of_each for documents with repeated ids: groups are of rows, not of ids."""
    row = free_name(docs, "_row")
    rows = staged(docs.where("doc_id is not null").withColumn(row, F.monotonically_increasing_id()), "rows")
    groups = similar_documents(rows.select(F.col(row).alias("doc_id"), "text"), n=5, percent=80).select(
        F.col("doc_id").alias("row"), F.when(F.col("n_shingles") > 0, F.col("component_id")).alias("group")
    )
    # Ties go by the row's hash, so that only rows alike in all columns are left to chance.
    order = rows.select(F.col(row).alias("row"), "doc_id", F.xxhash64(*docs.columns).alias("hash"))
    wordless = F.when(F.col("group").isNull(), F.col("doc_id")).alias("wordless")
    best = order.join(groups, "row").groupBy("group", wordless).agg(F.min(F.struct("doc_id", "hash", "row")).alias("best"))
    kept = small_or_not(staged(best.select(F.col("best.row").alias(row)), "kept"))
    return rows.join(kept, row, "left_semi").select(docs.columns).unionByName(docs.where("doc_id is null"))


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't contain an item of the benchmark.

    Null and empty texts, and all without a benchmark, stay; so do rows without an id. Rows that share an id go together.
    """
    found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    return docs.join(small_or_not(staged(found, "contaminated")), "doc_id", "left_anti").select(docs.columns)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix of sources takes it.

    A null source is one of its own; a null or empty text has no tokens and is taken as often as the whole rounds of its source, like
    the rows of a source without tokens, once. Repeated rows are taken alike.
    """
    tokens, weight, copies, round_ = (free_name(docs, c) for c in ("_mix_tokens", "_mix_weight", "_mix_copies", "_mix_round"))
    taken = mix(docs, budget=TOKEN_BUDGET, names=(tokens, weight, copies)).where(F.col(copies) > 0)
    return taken.withColumn(round_, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(docs.columns)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every row, in shards of nearly equal bytes: the copies that mixing made share a slot, so the map is rebalanced.

    Rows without an id share a slot; repeated rows are numbered one by one.
    """
    return shard_rows(docs, law="bytes")[0]


STAGES = [
    ("quality", good_documents),
    ("near duplicates", one_of_each),
    ("decontamination", clean_of_benchmark),
    ("mixing", mixed_sources),
    ("sharding", sharded),
]

#: SQL can't express the classifier, and the later stages work on what it keeps.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of the rows of documents that the stages keep."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

"""From documents to token shards: toxicity, near duplicates, benchmark leaks, mixing, training order.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. ``run`` writes each stage's result as Parquet and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import decontaminate, mixing, near_dup, shards, toxicity
from fieldloom.llm.common import cut
from fieldloom.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the cut of a classifier fitted on the labelled ones; texts without words stay."""
    rows = docs.select(F.struct("*").alias("row"), "text")
    scored = toxicity.toxicity(rows, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.where(F.col("toxic_score") < toxicity.CUT).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each class of near duplicates."""
    return near_dup.one_of_each(docs, near_dup.near_classes(docs))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    hits = decontaminate.contaminated_words(docs, table(spark, sf_dir, "benchmark")).where("n_hit > 0")
    hits = hits.select(F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key")).distinct()
    rows = docs.select(F.struct("*").alias("row"))
    key = F.xxhash64(F.coalesce(F.col("row.text").cast("string"), F.lit("")))
    left = rows.join(hits, F.col("row.doc_id").cast("long").eqNullSafe(F.col("hit_id")) & (key == F.col("hit_key")), "left_anti")
    return left.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies that the mix takes, in the order of the curriculum."""
    return mixing.training_order(docs, mixing.mix(docs))


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Index of the sequences in the shard files."""
    return shards.write_shards(docs)[1]


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("token_shards", token_shards),
]

#: Model fit, MinHash and tokenizer have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

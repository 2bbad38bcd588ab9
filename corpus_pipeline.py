"""A corpus pipeline: quality rules, near copies, benchmark leaks, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents, and any other
columns, whatever their names. An empty table goes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm import latent_leaks, mixing, ngram_jaccard, quality_rules, sharding
from quillframe.llm.common import written

SHARDS = 24


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules and their host's verdict keep.

    Null, empty and short texts are rejected; repeated rows go or stay together; very long texts are judged whole.
    """
    return quality_rules.keep_good(docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8.

    The least id stays; rows equal in id and text count once; documents without words stay.
    """
    return ngram_jaccard.keep_one(docs, n=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts stay; repeated rows go or stay together; very long texts are searched window by window.
    """
    return latent_leaks.drop_leaking(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources meet their target shares, in the order of the shuffle.

    Rows travel whole, so that columns called copy, n_copies, rate or shuffle_key stay as they came. A null source is a
    source of its own, a null id draws as 'null', repeated rows draw the same number.
    """
    whole = docs.select("doc_id", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"))
    return mixing.poisson_mix(whole).select("own.*")


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their size, text_crc32, law, shard, slot and grown_shard, which replace columns of these names.

    Null ids come first, a null text counts as empty, repeated rows get places of their own.
    """
    return sharding.feistel_shards(docs, SHARDS)


STAGES = [
    ("quality rules", keep_good),
    ("n-gram Jaccard join", keep_one_of_each),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources", mix_sources),
    ("sharding", deal_shards),
]

#: SQL cannot express the permutation; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

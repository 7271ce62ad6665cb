"""A corpus pipeline over the documents table: quality, near duplicates, decontamination, mixing, sharding.

Every stage takes what the one before it kept, with the columns of documents, and passes null ids and sources, repeated
rows and empty tables on as its operator defines them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thalweg.llm.common import saved, table
from thalweg.llm.decontam import drop_contaminated
from thalweg.llm.jaccard import keep_one
from thalweg.llm.mixing import mix_documents
from thalweg.llm.quality import filter_quality
from thalweg.llm.sharding import assign_shards

#: Near duplicates in the pipeline: shingles of five words, similarity of 0.8 or more.
SHINGLE, PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the quality rules, and failing lines of the others; no text fails, no rows give none."""
    return filter_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates; those without words, if any come this far, all stay."""
    return keep_one(docs, SHINGLE, PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item; an empty benchmark drops none, null texts contain nothing."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents as often as the mix does, the last of a source in part; a null source is a source of its own."""
    return mix_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places every document with its text, repeats included, in its shard; null texts weigh their overhead alone."""
    return assign_shards(docs, carry=("text", "lang", "source", "n_chars")).withColumn("law", F.lit("bytes"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs


#: Not SQL: shingle similarity groups and spaced seeds.  Each stage is tested against a brute-force version.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}

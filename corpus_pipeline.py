"""Documents to a training mix: five stages, each of which is written and read again before the next.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All return the columns of
documents; the last gives its rows in the order of the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, jaccard, lines, mixing, quality
from tessera.llm.common import free, settle


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.kept(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat, or nearly, are cut but for their first occurrence; a document left without text goes."""
    dropped = free(docs, "__dropped")
    out = lines.without_repeated_lines(docs)
    out = out.where((F.col(dropped) == 0) | F.col("text").rlike("[^\\s]"))
    return out.withColumn("n_chars", F.when(F.col(dropped) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def one_of_alike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of the least id."""
    return jaccard.one_of_each(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), drop="documents")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order in which their sources have their target shares."""
    return mixing.mixed(docs, block=mixing.BLOCK)


STAGES = [("quality", good), ("lines", fresh_lines), ("near_duplicates", one_of_alike), ("decontamination", uncontaminated), ("mix", mix)]

#: The classifier and SimHash cannot be said in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

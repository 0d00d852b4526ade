"""The cleaning pipeline over documents: each stage calls one operator of hostweave.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostweave.llm.decontaminate import decontaminated
from hostweave.llm.fair_mix import mixed_documents
from hostweave.llm.parity_join import one_of_each
from hostweave.llm.quality_rules import fit_rules, kept_documents
from hostweave.llm.substring_dedup import without_repeats
from hostweave.llm.tables import stored
from hostweave.session import ship_package


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the label model reject go."""
    ship_package(spark)
    return kept_documents(docs, fit_rules(docs))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the least id."""
    ship_package(spark)
    return one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words and more that occur twice or more are cut out; documents that were nothing else go."""
    ship_package(spark)
    out = without_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go."""
    ship_package(spark)
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def fair_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the words it takes of each and the number of copies."""
    ship_package(spark)
    return mixed_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources", fair_mix),
]

# SQL cannot state the label model's and the spaced seeds' decisions; tests/llm compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, applied to the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

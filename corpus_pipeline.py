"""From raw documents to token ids: rules, near duplicates, personal data, mixture, pieces.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import jaccard, mixing, pieces, pii, quality
from quillon.llm.common import durable

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.kept_rows(docs.select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each similarity class stays, that of the least id."""
    return jaccard.one_of_each(docs).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and terms that disclose it are masked; no document goes."""
    return pii.sanitise(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat a Poisson number of times, so that sources near their target weights."""
    return mixing.mix(docs, F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with the ids of its pieces."""
    return pieces.encode(docs.select(*COLUMNS))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("personal data", personal_data),
    ("source mixture", source_mixture),
    ("token ids", token_ids),
]

#: The classes, the disclosing terms and the ids are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = durable(docs, f"pipeline-{k}")
    return docs

"""A training-data pipeline over ``documents``: five stages, each one corpus operator.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``. All but the last return the columns
of ``documents``; the last returns one row per document that is left, with its share of
the mix.

1. language ID: texts without letters, or in no language the model knows, go
2. line dedup: lines that at least ten documents hold go, documents stay
3. n-gram Jaccard join: of each group of near duplicates the smallest id stays
4. benchmark decontamination: documents in which a benchmark window occurs go
5. mixing: how many words of each document the mix takes
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm.common import Workspace
from loomgraph.llm.decontaminate import clean_rows
from loomgraph.llm.jaccard import keep_one
from loomgraph.llm.language import with_language
from loomgraph.llm.lines import without_common_lines
from loomgraph.llm.mixing import mix_sources


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return with_language(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_common_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_sources(docs)


STAGES = [
    ("language ID", language),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing", mixture),
]

#: A trained classifier and a seeded draw have no SQL twin; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written to the shared folder and read again."""
    workspace = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = workspace.write(stage(spark, docs, sf_dir), f"stage-{i}")
        if i:
            workspace.drop(f"stage-{i - 1}")
    return docs

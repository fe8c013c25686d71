"""A corpus made ready in five stages: language, near copies, leaks, personal data, source weights.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm import decontaminate, language_id, mixing, pii, similar
from tallymark.llm.common import Workspace, table


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model, trained on these documents, doesn't reject."""
    return language_id.keep_identified(docs, language_id.train(docs))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, a similarity of 0.8 or more."""
    return similar.keep_one(docs)


def remove_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.remove_leaks(docs, decontaminate.leaks(docs, table(spark, sf_dir, "benchmark")))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars counts the new text."""
    clean = pii.redact(docs, pii.find_personal_data(docs))
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes words of, with size, source_size, target and taken (columns so named before give way)."""
    mixed = mixing.mix(docs, carry=tuple(docs.columns)).where("taken > 0")
    own = ["size", "source_size", "target", "taken"]
    return mixed.select(*[c for c in docs.columns if c.lower() not in own], *own)


STAGES = [
    ("language", keep_identified),
    ("near_duplicates", keep_one_of_each),
    ("decontaminate", remove_leaks),
    ("pii", redact),
    ("mix", mix_sources),
]

#: Training, hashing and retrieval have no SQL; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work, docs = Workspace(spark), table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = work.write(stage(spark, docs, sf_dir), name)
        if i:
            work.drop(STAGES[i - 1][0])
    return docs

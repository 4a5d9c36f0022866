"""The corpus pipeline: each stage reads the documents that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidalframe.llm import classifier, packing, quality_rules, simhash
from tidalframe.sources.work import scope, work_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from labels outside the held-out quarter.

    A null or empty text gets a score like any other, a null id has no label, repeated rows
    are judged alike, and without labels of both kinds every text gets their share. A long text
    is scored whole.
    """
    return classifier.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie beyond their group's fences go.

    A null or blank text has no words and goes; null languages and sources are groups of
    their own; repeated rows and equal rates are judged alike. A long text is measured whole.
    """
    return quality_rules.kept_only(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that with the smallest id: texts are near
    copies if their five-word shingles are alike by 0.8.

    Null and blank texts are copies of each other, and so are repeated rows; of rows with one
    id the first of the scan stays; a row without an id stays only if its group has no id. A long text's shingles all count.
    """
    return simhash.one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, cut into the pieces of padded sequences.

    A null text is an empty document, its end token alone; repeated rows are packed each; a
    long text fills many sequences.
    """
    # smaller slices and fewer words than alone: the executors' memory has grown in the stages before
    return packing.packed(docs, packing.Settings(slice_bytes=2 << 20, remembered=100_000, thrifty=True))


# All but the last return the columns of docs as they are, extra ones too, whatever their names; of an empty table they return one.
STAGES = [("quality_classifier", quality_classifier), ("quality_rules", rules), ("near_dedup", near_dedup), ("packing", pack)]

#: SQL can express neither the trained classifier nor the packing; tests compare each stage with a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written as Parquet and read again, and what
    it wrote on the way is deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = work_path(spark, name)
        with scope(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

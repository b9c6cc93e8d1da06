"""The corpus pipeline: five stages from raw documents to a training mixture."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from quarrion.llm import factorization, forest, mixing, substring, winnowing
from quarrion.storage import shared_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return factorization.keep_good(docs, _table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near duplicates."""
    return forest.keep_first(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the word windows that occur earlier; what is left without a word goes."""
    return substring.remove_repeats(docs).where(r"text rlike '[^\\x20\\x09-\\x0D]'")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return winnowing.decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with the number of their copies."""
    return mixing.mix(docs)


#: Stages in order; each gets what its predecessor kept.
STAGES = [
    ("quality_classifier", quality),
    ("minhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", decontamination),
    ("source_mixture", mixture),
]

#: The classifier and the signatures are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written and read again in the shared checkpoint folder.

    A stage's table goes when its successor's has been written; that of the last but one stays, as the result reads it.
    """
    docs = _table(spark, sf_dir, "documents")
    before = None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = f"{shared_folder(spark)}/pipeline-{uuid4().hex}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                _delete(spark, before)
            before = path
    return docs


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)

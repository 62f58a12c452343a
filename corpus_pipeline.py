"""The corpus pipeline: classifier, line dedup, near-duplicate join, decontamination, mixing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs. All stages but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltlog.llm import decontam, jaccard, linededup, mixing, quality
from siltlog.runtime import delete, shared_folder

#: SQL can't express the first stage, a trained classifier; tests/llm/test_pipeline.py holds run() and each stage to a brute-force version.
ORACLE_SQL = None


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; junk and toxic ones go. Null and empty texts stay, repeated rows go or stay together, an empty table stays empty; other columns are carried along."""
    return quality.keep_clean(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three lines go; so do documents of which nothing is left. Null, empty and short texts stay, as do repeated rows (one document) and an empty table; see line_dedup."""
    return linededup.line_dedup(docs, drop_emptied=True).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the least doc_id, null first. Texts without words stay, repeated rows stay once, an empty table stays empty."""
    return jaccard.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a passage with the benchmark go. Null and empty texts share none; repeated rows go or stay together; an empty table stays empty."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources, shuffled; ``copy`` numbers the repeats. Rows of one doc_id, null
    included, are drawn alike, sources that are null are one source, an empty table stays empty."""
    return mixing.mix_sources(docs)


STAGES = [
    ("quality classifier", clean_documents),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("source mixing", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each one's result written to the shared folder and read again. What a stage wrote is deleted when the next one has
    written; the last result stays, as the DataFrame that is returned reads it."""
    folder = f"{shared_folder(spark).rstrip('/')}/corpus-pipeline-{spark.sparkContext.applicationId}-{spark.sparkContext._jvm.System.nanoTime()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            delete(spark, f"{folder}/{k - 1}")
    return docs

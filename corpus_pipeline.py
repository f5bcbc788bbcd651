"""From raw documents to token files: five stages, each on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finlattice.llm import decontam, mixing, ngram_join, quality, queries, token_files
from finlattice.llm.shared import discard, scratch_scope, shared_folder, unused


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~quality.held_out())
    into = unused(docs, "_quality")
    scored = quality.score(docs, quality.fit(docs, labels), into=into)
    return scored.where(F.col(into) >= queries.QUALITY_FROM).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest id."""
    return ngram_join.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontam.drop_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out until sources have their target shares of words."""
    return mixing.resample(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all that is left, and what reading them back gives for each document."""
    path = shared_folder(spark, "token-files")
    token_files.write_tokens(docs, path, queries.tokenizer_path())
    return token_files.read_tokens(spark, path)


STAGES = [
    ("quality classifier", quality_filter),
    ("n-gram jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix_sources),
    ("token-id binary output", write_token_ids),
]

#: Classifier, forest and codec have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; a stage's scratch tables go when its result is written, and the result when the next stage's is."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = shared_folder(spark, f"pipeline-{name.replace(' ', '-')}")
        with scratch_scope(spark, "pipeline-scratch"):
            kept = stage(spark, docs, sf_dir)
            kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
        if before:
            discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: language ID, line dedup, near dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns the rows that it keeps; run() writes each stage's rows as Parquet in the
shared folder and rereads them as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontam, langid, line_dedup, mixing, near_dedup
from millrace.llm.common import scratch


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others carry the language that was found.

    Evidence is the text and the priors of its source: documents have no markup or address, and a row's own `lang` is not shown to
    its judgement, as the text models are learned from that column; rows are judged by models that saw none of their fold.
    """
    models = langid.learn(docs, "text", "lang", folds=langid.FOLDS)
    found = langid.identify(docs, models, host=F.col("source"))
    return found.where("accepted").withColumn("lang", F.col("language")).select(docs.columns)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are boilerplate of their source go; every document stays."""
    out = line_dedup.drop_boilerplate_lines(docs)
    return out.withColumns({"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group at a similarity of 0.8 or more one document stays, that of the smallest id; texts that share an id are documents of their own."""
    return near_dedup.drop_near_duplicates(docs).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of the texts; every document stays."""
    out = decontam.remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per copy that the mix takes: the columns of documents, size, source_size, target and the copy's number."""
    taken = mixing.mix_sources(docs, keep=True).where("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies", "taken")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_boilerplate),
    ("near_dedup", drop_near_copies),
    ("decontamination", decontaminate),
    ("source_mixing", mix),
]

#: Likelihoods, sketches and spans of words aren't SQL; tests/llm/test_contracts.py compares each stage with plain Python on what the
#: stage before kept: line dedup, near dedup and decontamination row by row, language ID by the planted `lang`, mixing by its targets.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

"""A corpus pipeline of the operators in envsense.llm: each stage works on all that the one before kept.

All stages but the last return the columns of the documents they get, whatever else these hold, and an empty table for
an empty one. Null ids and texts, repeated rows and ids are as each stage's operator states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from envsense.llm import bpe, decontamination, line_dedup, merges, ngram_join, quality
from envsense.llm.common import new_dir, vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, null and empty texts among them; from the others the lines that are frequent on their host."""
    kept = quality.cleaned_documents(docs)
    return kept.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.lit(0).cast("long")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-equal lines of 40 characters or more one stays. ``n_chars`` follows the text; documents without a word left go."""
    cut = line_dedup.dedup_lines(docs, shortest=line_dedup.MIN_CHARS)
    cut = cut.drop(cut.columns[-1])
    cut = cut.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.lit(0).cast("long")))
    return cut.where(F.coalesce(F.translate("text", quality.BLANKS, ""), F.lit("")) != "")


def join_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents one row with the least id stays; documents without words all do."""
    return ngram_join.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item, copied or edited, go; each row is judged by its text alone."""
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the bytes decoded from them, for each row; a null text has no ids."""
    return bpe.digests(docs.select("doc_id", "text"), merges.read_ranks(vocabulary("byte_bpe_50k.tiktoken")))


STAGES = [("quality_rules", quality_rules), ("line_dedup", dedup_lines), ("ngram_join", join_documents), ("decontamination", decontaminate), ("bpe", encode)]

#: MinHash candidates, union-find, alignments and merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

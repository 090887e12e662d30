"""A corpus pipeline of five stages, each one of the training-data operators.

Each stage reads all that its predecessor kept, written as Parquet, and all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm.bpe import bpe_digests, default_vocabulary
from citeloom.llm.cdc_dedup import substring_dedup
from citeloom.llm.common import Scratch, free_name, numbered, without
from citeloom.llm.decontam import decontaminate
from citeloom.llm.ngram_join import ngram_jaccard_join
from citeloom.llm.quality_cnn import THRESHOLD, fit_quality, score_quality
from citeloom.session import ship


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, rejects go."""
    model = fit_quality(docs, ship(spark).read.parquet(f"{sf_dir}/labels.parquet"))
    score = free_name(docs.columns, "score")
    return score_quality(spark, docs, model, score).where(F.col(score) >= THRESHOLD).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts that link, the document with the smallest id stays; of rows that agree in id and text one stays.

    Rows that only share an id are documents of their own, which come after those with an id of their own.
    """
    scratch, number = Scratch(ship(spark), "near"), free_name(docs.columns, "number")
    rows, _ = numbered(docs, number)
    groups = ngram_jaccard_join(spark, rows, number)
    out = without(rows, scratch.write(groups.where("doc_id <> component_id").select("doc_id")), number, once=True)
    return out.select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document or place holds are cut out; documents that consist of them go."""
    kept = substring_dedup(ship(spark), docs)
    if "n_chars" not in kept.columns:
        return kept
    size = F.when(F.col("text").isNotNull(), F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", size).select(*docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of ten words of a benchmark item go; of rows that share an id only those."""
    scratch, number = Scratch(ship(spark), "leaks"), free_name(docs.columns, "number")
    rows, _ = numbered(docs, number)
    texts = rows.select(F.col(number).alias("doc_id"), "text")
    found = decontaminate(spark, texts, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(rows, scratch.write(found.where("contaminated").select("doc_id")), number).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token count and the digests of its tokens and of what they decode to."""
    return bpe_digests(ship(spark), docs, default_vocabulary())


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("BPE encoding and decoding", tokens),
]

#: The classifier is a learned network, which SQL can't express; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(ship(spark), "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir))
    return docs

"""A corpus from raw documents to packed training sequences: five stages, each written and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from censora.llm import packing, pairwise, perplexity, pii, shingles
from censora.llm.frames import aside
from censora.session import materialise

TOKENIZER, CAPACITY = "byte_bpe_50k.json", 2048


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the simple rules or the perplexity band of their language reject go."""
    own, back = aside(docs, (*perplexity.ADDED, "_lang"))
    return back(perplexity.judged(own).where("kept"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the accepting quantile go. The model is learnt from the labelled documents of the whole table."""
    ranking = pairwise.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    own, back = aside(docs, ("score", "predicted"))
    return back(pairwise.scored(own, ranking).where(F.col("predicted") == 1))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles with a Jaccard similarity of 0.8 or more. SimHash
    fingerprints in vantage-point trees give the first links, common rare shingles all others; each is verified exactly."""
    return shingles.deduplicated(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked; ``n_chars`` follows."""
    return pii.mask(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document goes."""
    return packing.packed_documents(docs, public_tokenizers.path(TOKENIZER), CAPACITY)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit),
]

# Learnt models, links and packing are beyond SQL; the tests hold the rows against the stages' brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

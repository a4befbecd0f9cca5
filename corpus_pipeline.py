"""From raw documents to packed training sequences.

Each stage reads the documents that the stage before kept, as Parquet, and its
decisions take effect: language identification drops what it rejects, the n-gram
join keeps one document of each group, substring removal cuts repeated passages,
mixing repeats and drops documents to target weights, and packing returns pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twofold.llm.language import fit_language, learnable, predict_language
from twofold.llm.mixing import mixed_documents
from twofold.llm.ngram_join import ngram_components
from twofold.llm.packing import pack
from twofold.llm.queries import SEQUENCE_TOKENS, vocabulary
from twofold.llm.substrings import deduplicated_documents
from twofold.sources.tables import stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised, whatever their label says."""
    docs = docs.select(*COLUMNS)
    predicted = predict_language(docs, fit_language(learnable(docs)))
    return predicted.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id."""
    groups = ngram_components(docs).where("component_id < doc_id").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(groups, "doc_id", "left_anti").select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that a document with a smaller id has."""
    return deduplicated_documents(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of the mix, a document once for each time it is taken."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    return pack(docs, vocabulary("byte_bpe_50k.json"), SEQUENCE_TOKENS, ranks=vocabulary("byte_bpe_50k.tiktoken"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("source_mixing", source_mixing),
    ("packing", packing),
]

# A fitted classifier and a vocabulary's ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs

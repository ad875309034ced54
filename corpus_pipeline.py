"""Corpus pipeline: language, near copies, repeated passages, mixture of sources, packing.

Each stage takes the documents that the one before kept, as Parquet in the shared folder, and all but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantage.llm import dedup, language, mixing, packing, storage, substrings

#: A document whose language has less than this share of its positions' probability is rejected, and so is one without letters.
LEAST_CONFIDENCE = 0.35


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned; those without letters or of no clear language go.

    Null and empty texts have no letter. Rows without an id are judged but never learned from, repeated rows each for
    itself; if no row has a language, all go.
    """
    labelled = language.predict(docs, language.fit(docs))
    return labelled.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_CONFIDENCE)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each class of near copies.

    Rows without an id cannot be judged and stay; rows that repeat an id stay or go together.
    """
    gone = dedup.near_copies(docs).where("class_id <> doc_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without windows of 20 words that also start earlier; a text that loses nothing keeps its white space."""
    cut = substrings.deduplicate(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    return cut.withColumn("text", text).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents once for each pass that the mixture makes over them; every document at least once.

    Null sources are one source, null and empty texts have no tokens, and rows that repeat are mixed each for itself.
    """
    return mixing.mix_sources(docs, mixing.plan_mixture(docs)).select(*docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 tokens; null and empty texts are the end id, repeated rows are packed each."""
    pieces = storage.materialise(packing.pieces(docs))
    return packing.pack(pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("repeated_passages", drop_repeated_passages),
    ("mixture", mix_sources),
    ("packing", pack_windows),
]

#: The language model, the sampling hashes and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = storage.materialise(stage(spark, docs, sf_dir))
    return docs

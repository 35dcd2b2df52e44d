"""Corpus pipeline over ``documents``: stages of training-data operators, each written as Parquet and read by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import queries
from tidemark.llm._common import written
from tidemark.llm.bpe import encode_decode
from tidemark.llm.chunk_dedup import substring_dedup
from tidemark.llm.mixing import mix
from tidemark.llm.ngram_join import ngram_jaccard, within
from tidemark.llm.toxicity import rejected, score, train

ORACLE_SQL = None  # classifier, content-defined chunks and merges are outside SQL; tests/llm compares with brute force


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not reject; null and empty texts score by the intercept and stay, and so do all if the labels teach nothing."""
    chain = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, chain, prefix="__p_")
    return scored.where(~rejected(F.col("__p_toxic"), chain)).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group (5-word shingles, Jaccard of 0.8 or more); rows equal in all columns stay once.

    Documents without words, and rows with null doc_id, are no one's duplicates.
    """
    found = ngram_jaccard(docs.select("doc_id", "text"), size=5, num=4, den=5)
    keep = written(found.where("doc_id = component_id").select(F.col("doc_id").alias("__id")).distinct(), "near")
    named = within(docs, "doc_id", keep)
    if named.count() != keep.count():  # repeated rows
        named = named.distinct()
    return named.unionByName(docs.where("doc_id is null"))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document has; n_chars follows."""
    cut = substring_dedup(docs)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*[F.col(f"`{c}`") for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the target mixture, one row per epoch; nulls, empty texts, repeated ids and ties as ``mix`` states."""
    return mix(docs).select(*[F.col(f"`{c}`") for c in docs.columns])


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What trainers read: token ids of each row; null and empty texts have none, repeated rows are encoded alike."""
    encoded = encode_decode(docs.select("doc_id", "lang", "source", "text"), queries.tokenizer("word_bpe_49k.json"))
    return encoded.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("substrings", substrings),
    ("mixture", mixture),
    ("bpe", bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

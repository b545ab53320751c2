"""A corpus pipeline of five operators: each stage's rows are written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm import exact_dedup, minmax_dedup, mixing, piece_table, zstd_langid
from tamis.llm.common import bounded_broadcast, discard, materialise
from tamis.llm.queries import piece_model


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a margin; lang becomes the language found. Learned from the labels of three quarters."""
    model = zstd_langid.fit(docs, ~zstd_langid.held_out("doc_id", 4, 2))
    found = zstd_langid.identify(docs, model).where(~F.col("rejected"))
    return found.select(*(F.col("lang_pred").alias("lang") if c == "lang" else F.col(f"`{c}`") for c in docs.columns))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal without white space."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near copies: five-word shingles, similarity 0.8.

    Rows are told apart by id and text, so that two texts under one id are two documents.
    """
    key = F.struct(F.col("doc_id"), F.xxhash64("text").alias("text"))
    found = minmax_dedup.near_components(docs.select(key.alias("key"), "text"), width=5, percent=80, id_col="key")
    dropped = materialise(found.where(~F.col("kept")).select(F.col("key").alias("__dropped")), "near-dropped")
    return docs.join(bounded_broadcast(dropped), key.eqNullSafe(F.col("__dropped")), "left_anti")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents so that sources come to weights in proportion to the square root of their bytes; the whole stays as large."""
    return mixing.replicate(docs, power=0.5, epochs=1.0).select(*(F.col(f"`{c}`") for c in docs.columns))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of each whole text, and the text that they decode to."""
    return piece_table.encode_documents(docs, piece_model(), out="ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("mixed", mixed),
    ("pieces", pieces),
]

#: SQL can express neither the compression nor the tokenizer.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)

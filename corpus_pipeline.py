"""Raw documents to packed training windows, one table after another."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logloom.llm import contamination, line_dedup, near_duplicates, packing, quality_compression
from logloom.llm.arrow_text import free_name, quoted, text_key
from logloom.session import stage


def own_columns(docs: DataFrame) -> list[Column]:
    """The columns of ``docs`` by their exact names."""
    return [quoted(c) for c in docs.columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier, learned from the labels, gives a score of at least 0.7.

    A null or empty text gets the neutral score, so all of them stay or none does; repeated
    rows get equal scores and stay or go together. All columns come back as they were,
    whatever they are called; an empty table gives an empty table.
    """
    model = quality_compression.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), usable=~quality_compression.held_out())
    name = free_name("score", docs.columns)
    return quality_compression.score(docs, model, name=name).where(F.col(name) >= 0.7).select(*own_columns(docs))


def shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that at least 10 of them share. n_chars follows the text.

    A null text comes back empty, and so does one whose lines all go. Repeated rows are
    documents of their own: ten of them share all their lines. All other columns come back
    as they were, whatever they are called; an empty table gives an empty table.
    """
    names = (free_name("n_lines", docs.columns), free_name("n_dropped", docs.columns))
    return with_length(line_dedup.drop_shared_lines(docs, names=names).select(*own_columns(docs)))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class of near copies: the least doc_id, null last, then the least key of the text.

    Null and empty texts, and all others without words, are one class. Of rows that agree in text and
    doc_id one stays, by a hash of all columns. All columns come back as they were,
    whatever they are called; an empty table gives an empty table.
    """
    return near_duplicates.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark.

    Null and empty texts hold none. Documents are told apart by their texts, so repeated
    rows and rows without an id stay or go with their text. All columns come back as they were,
    whatever they are called; an empty table gives an empty table.
    """
    names = tuple(free_name(n, docs.columns) for n in ("text_key", "text_key_again"))
    keyed = docs.select("*", *text_key(F.coalesce("text", F.lit("")), names))
    found = contamination.leaks(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=names)
    return keyed.join(found.select(*names).distinct(), list(names), "left_anti").select(*own_columns(docs))


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into windows of 4096 tokens: a row a piece, as op9_packing gives them.

    A null or empty text is its closing token alone; repeated rows are packed each; columns other than
    doc_id and text are not looked at; an empty table gives an empty table.
    """
    return packing.pack(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


def with_length(docs: DataFrame) -> DataFrame:
    """n_chars, where the table has it, as the length of the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


STAGES = [("quality", quality), ("shared_lines", shared_lines), ("near_copies", near_copies), ("benchmark", benchmark), ("windows", windows)]

#: The first stage learns and the third and fourth search, so SQL can't say the same.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents, each result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

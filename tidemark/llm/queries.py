"""Queries of the text problems (p6 to p8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.bpe import encode_texts
from tidemark.llm.mixing import document_sizes, mix_documents, reached_shares
from tidemark.llm.sentences import split_sentences
from tidemark.sources.tables import table


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_texts(table(spark, d, "documents"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """Longer documents come first: the odds grow with the root of the size."""
    sizes = document_sizes(table(spark, d, "documents"))
    return mix_documents(sizes, table(spark, d, "mix_targets"), weight=F.sqrt("tokens")).withColumnRenamed("doc", "doc_id")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return reached_shares(document_sizes(table(spark, d, "documents")), table(spark, d, "mix_targets"), weight=F.sqrt("tokens"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return split_sentences(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p6_ids, p7_mix, p7_shares, p8_found)}
SQL: dict[str, str] = {}

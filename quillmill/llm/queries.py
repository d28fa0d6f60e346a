"""Queries of the problems on text, p8 to p10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmill.llm import encoding, garbling, packing
from quillmill.runtime import persisted, table

CAPACITY = 2048


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode(table(spark, d, "documents"), encoding.vocabulary())


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    sizes = persisted(encoding.token_counts(spark, table(spark, d, "documents")), "p9-sizes")
    return packing.pack(sizes, CAPACITY)


def _corpus(spark: SparkSession, d: str) -> garbling.Corpus:
    return garbling.Corpus.of(table(spark, d, "documents").select("doc_id", "text"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    corpus = _corpus(spark, d)
    return garbling.found_ids(corpus, *garbling.fit(corpus))


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    """The documents found, with the text restored as far as possible and whether characters in it are lost for good."""
    corpus = _corpus(spark, d)
    return garbling.inspect(corpus, *garbling.fit(corpus)).where("found").select("doc_id", "restored", "lost")


def queries() -> dict:
    return {f.__name__: f for f in (p8_ids, p9_containers, p10_found, p10_restored)}


def oracle_sql() -> dict[str, str]:
    return {}

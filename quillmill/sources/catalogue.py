"""Catalogues of models as JSON: one object of models, or providers with models (SRC-33, SRC-34)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.sources.text import Place, read_documents

_FLAT = "map<string,struct<input_cost_per_token:double,output_cost_per_token:double,cache_creation_input_token_cost:double,cache_read_input_token_cost:double,max_input_tokens:bigint,i:double,o:double,cc:double,cr:double,ctx:bigint>>"
_NESTED = "map<string,struct<models:map<string,struct<id:string,cost:struct<input:double,output:double,cache_read:double,cache_write:double>,limit:struct<context:bigint>>>>>"


def flat_catalogue(spark: SparkSession, path: Place) -> DataFrame:
    """model, rates per token and context of a catalogue with full or short member names."""
    rows = read_documents(spark, path).select(F.explode(F.from_json("value", _FLAT)).alias("model", "r"))
    return rows.select("model", F.coalesce("r.input_cost_per_token", "r.i").alias("input"), F.coalesce("r.output_cost_per_token", "r.o").alias("output"), F.coalesce("r.cache_creation_input_token_cost", "r.cc").alias("cache_write"), F.coalesce("r.cache_read_input_token_cost", "r.cr").alias("cache_read"), F.coalesce("r.max_input_tokens", "r.ctx").alias("context")).where("input is not null or output is not null")


def provider_catalogue(spark: SparkSession, path: Place) -> DataFrame:
    """provider, model, rates per token (from rates per million) and context."""
    rows = read_documents(spark, path).select(F.explode(F.from_json("value", _NESTED)).alias("provider", "p")).select("provider", F.explode("p.models").alias("key", "m"))
    per = lambda c: (F.col(f"m.cost.{c}") / 1e6).alias(c)
    return rows.select("provider", F.coalesce("m.id", "key").alias("model"), per("input"), per("output"), per("cache_write"), per("cache_read"), F.col("m.limit.context").alias("context"))

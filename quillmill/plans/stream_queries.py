"""Queries that drive the streams over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.plans.core_queries import BLOCKS
from quillmill.runtime import prepare
from quillmill.streaming import usage_streams as S


def _events(spark: SparkSession, d: str) -> DataFrame:
    return S.parquet_stream(prepare(spark), f"{d}/events.parquet")


def str_01(spark: SparkSession, d: str) -> DataFrame:
    return S.collected(S.quarter_cells(_events(spark, d), "ts", ["event_type"]), "complete")


def str_02(spark: SparkSession, d: str) -> DataFrame:
    path = S.new_path(spark, "str02")
    daily = _events(spark, d).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    S.into_table(daily, path, ["day"], "complete").awaitTermination()
    return spark.read.schema("event_type string, n bigint, day string").parquet(path)


def str_03(spark: SparkSession, d: str) -> DataFrame:
    keyed = _events(spark, d).withColumn("key", F.concat_ws(":", F.floor(F.col("event_id") / 2)))
    return S.collected(S.once_each(keyed, ["key"], "ts")).select("key")


def str_04(spark: SparkSession, d: str) -> DataFrame:
    return S.all_blocks(S.streamed_blocks(_events(spark, d), F.col("user_id"), "ts"))


def queries() -> dict:
    return {"STR_01_quarter_cells": str_01, "STR_02_partition_overwrite": str_02, "STR_03_once_each": str_03, "STR_04_blocks": str_04}


def oracle_sql() -> dict[str, str]:
    return {
        "STR_01_quarter_cells": "select (epoch_us(ts) // 900000000) * 900000 as start_ms, event_type, count(*) as n from events group by 1, 2",
        "STR_02_partition_overwrite": "select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n from events group by 1, 2",
        "STR_04_blocks": BLOCKS + "select key, start_ms, from_ms, to_ms, entries as n from b",
        "STR_03_once_each": "select distinct cast(event_id // 2 as varchar) as key from events",
    }

"""Blocks of fixed length over a stream of entries, with gaps, rates and projections (WIN-01 to WIN-06)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.functions.usage import HOUR_MS, floor_hour

_BOUNDS = T.StructType([T.StructField("_key", T.StringType()), T.StructField("start_ms", T.LongType()), T.StructField("from_ms", T.LongType()), T.StructField("to_ms", T.LongType())])


def _cut(times: np.ndarray, length: int) -> Iterator[tuple[int, int, int]]:
    """(block start, first, last) of sorted distinct times; a block starts at the hour of its first time."""
    k = 0
    while k < len(times):
        start = int(times[k]) // HOUR_MS * HOUR_MS
        # Up to here times belong by length; the first pause longer than a block may end it before.
        # (A length under an hour may have run out before the first time, which then is a block by itself.)
        end = max(k + 1, int(np.searchsorted(times, start + length, side="right")))
        pauses = np.flatnonzero(np.diff(times[k:end]) > length)
        end = k + int(pauses[0]) + 1 if len(pauses) else end
        yield start, int(times[k]), int(times[end - 1])
        k = end


def _by_minute(length: int) -> bool:
    """Whether blocks of this length end at full minutes only."""
    return length >= HOUR_MS and length % 60_000 == 0


def block_bounds(times: DataFrame, length_ms: int) -> DataFrame:
    """_key, start_ms, from_ms, to_ms of each block; times: _key and _at.

    A block ends where a time is more than the length after the block's start or after the time before it.
    As its start depends on where the block before ended, no window function gives it, so each key's times
    are folded in order. They are first reduced to the first and last time of each minute and the first
    after the full minute, which can't hide an end: block starts are whole hours, so a block's length runs
    out just after a full minute. (Of lengths under an hour, or not of whole minutes, all distinct times are
    kept; rows of one time share a block.) That
    bounds a key by its time span, three rows a minute, whatever its number of rows, and the reduction is
    partially aggregated before the shuffle.
    """
    if _by_minute(length_ms):
        minute = F.floor(F.col("_at") / 60_000)
        reduced = times.groupBy("_key", minute.alias("_m")).agg(F.min("_at").alias("a"), F.min(F.when(F.pmod("_at", F.lit(60_000)) > 0, F.col("_at"))).alias("b"), F.max("_at").alias("c"))
        reduced = reduced.select("_key", F.explode(F.array_distinct(F.array("a", F.coalesce("b", "a"), "c"))).alias("_at"))
    else:
        reduced = times.distinct()

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        rows = list(_cut(np.sort(part["_at"].to_numpy()), length_ms))
        return pd.DataFrame([(part["_key"].iloc[0], *r) for r in rows], columns=_BOUNDS.names)

    return reduced.groupBy("_key").applyInPandas(fold, _BOUNDS)


def blocks(entries: DataFrame, at: str, length_hours: float = 5.0, key: Column | None = None, now_ms: int | None = None) -> DataFrame:
    """WIN-01, WIN-03, AGG-09: one row a block with sums, cost, models and whether it is active.

    entries: at (epoch ms), the four counters, cost, model; key: blocks are apart for each (all together if
    not given). Rows without a time are left out; an empty table gives no block. Sums are aggregated by a
    range join of at most one block a row: blocks of a key don't overlap.
    """
    length = int(length_hours * HOUR_MS)
    rows = entries.withColumn("_key", (F.lit("") if key is None else key.cast("string"))).withColumn("_at", F.col(at)).where("_at is not null and _key is not null")
    bounds = block_bounds(rows.select("_key", "_at"), length)
    # Equi-join on (key, hour): each block is listed under the hours it spans, at most its length and one.
    hours = bounds.withColumn("_hour", F.explode(F.sequence(F.floor(F.col("from_ms") / HOUR_MS), F.floor(F.col("to_ms") / HOUR_MS))))
    # A block may end just after a full minute, never within one, so rows of a minute go together but for those at its very start.
    within = [F.floor(F.col("_at") / 60_000).alias("_m"), (F.pmod("_at", F.lit(60_000)) == 0).alias("_full")] if _by_minute(length) else [F.col("_at").alias("_m")]
    by_minute = rows.groupBy("_key", *within, "model").agg(F.min("_at").alias("_at"), *[F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens", "cost")], F.count(F.lit(1)).alias("entries"))
    joined = by_minute.withColumn("_hour", F.floor(F.col("_at") / HOUR_MS)).join(hours, ["_key", "_hour"]).where("_at between from_ms and to_ms")
    found = joined.groupBy("_key", "start_ms", "from_ms", "to_ms").agg(
        *[F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens", "cost", "entries")], F.array_sort(F.collect_set("model")).alias("models")
    )
    end = F.col("start_ms") + length
    active = F.lit(False) if now_ms is None else (F.lit(now_ms) - F.col("to_ms") < length) & (F.lit(now_ms) < end)
    return found.select(F.col("_key").alias("key"), "start_ms", end.alias("end_ms"), "from_ms", "to_ms", active.alias("active"), "input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens", "cost", "entries", "models")


def gaps(found: DataFrame, length_hours: float = 5.0) -> DataFrame:
    """WIN-02: rows between blocks whose times lie further apart than a block is long."""
    length = int(length_hours * HOUR_MS)
    before = F.lag("to_ms").over(Window.partitionBy("key").orderBy("start_ms", "from_ms"))
    pauses = found.select("key", (before + length).alias("start_ms"), F.col("from_ms").alias("end_ms"), before.alias("_before"))
    return pauses.where(F.col("end_ms") - F.col("_before") > length).select("key", "start_ms", "end_ms")


def burn_rate(found: DataFrame) -> DataFrame:
    """WIN-04: tokens a minute with and without cached ones and cost an hour; null for blocks of no duration."""
    minutes = F.nullif((F.col("to_ms") - F.col("from_ms")) / 60_000, F.lit(0.0))
    plain = F.col("input_tokens") + F.col("output_tokens")
    tokens = plain + F.col("cache_creation_tokens") + F.col("cache_read_tokens")
    return found.withColumns({"tokens_per_minute": tokens / minutes, "plain_per_minute": plain / minutes, "cost_per_hour": F.col("cost").cast("double") / minutes * 60})


def projection(rated: DataFrame, now_ms: int) -> DataFrame:
    """WIN-05: tokens and cost at the end of a block if the rate holds."""
    left = F.greatest((F.col("end_ms") - F.lit(now_ms)) / 60_000, F.lit(0.0))
    tokens = F.col("input_tokens") + F.col("output_tokens") + F.col("cache_creation_tokens") + F.col("cache_read_tokens")
    return rated.withColumns({"projected_tokens": F.round(tokens + F.col("tokens_per_minute") * left).cast("long"), "projected_cost": F.round(F.col("cost").cast("double") + F.col("cost_per_hour") / 60 * left, 2), "minutes_left": F.round(left).cast("long")})


def limit_status(tokens: Column, limit: Column) -> Column:
    """WIN-06: ok, warning over 80 % of the limit, exceeds over it."""
    return F.when(tokens > limit, "exceeds").when(tokens > limit * 0.8, "warning").otherwise("ok")


def largest_completed(found: DataFrame) -> DataFrame:
    """AGG-10: the greatest total of blocks that aren't active, null if there is none."""
    tokens = F.col("input_tokens") + F.col("output_tokens") + F.col("cache_creation_tokens") + F.col("cache_read_tokens")
    return found.where(~F.col("active")).agg(F.max(tokens).alias("max_tokens"))


def recent(found: DataFrame, now_ms: int, days: int = 3) -> DataFrame:
    """FIL-12: blocks that start within the last days or are active."""
    return found.where((F.col("start_ms") >= now_ms - days * 24 * HOUR_MS) | F.col("active"))

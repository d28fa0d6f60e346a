"""Aggregation of usage entries: by period, project and session, with a breakdown by model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTERS = ["input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens"]


def summarize(entries: DataFrame, keys: list[str], order: Column, extra: list[Column] | None = None) -> DataFrame:
    """AGG-01: sums by the keys, models in order of first sight, and a breakdown sorted by falling cost.

    entries: the keys, model, the four counters and cost; order: an ordinal of the rows (any sortable
    column), whose least value in a model gives its first sight; ties go by name. Two levels of hash
    aggregation: the first, with partial sums, leaves one row for each key and model, so a key that holds a
    third of all rows reaches the second as a few rows. Null keys and models are groups of their own; a
    null model is in no list. An empty table gives no rows.
    """
    sums = [F.sum(c).alias(c) for c in COUNTERS]
    by_model = entries.groupBy(*keys, "model").agg(*sums, F.sum("cost").alias("cost"), F.count(F.lit(1)).alias("entries"), F.min(order).alias("_first"), *(extra or []))
    row = F.struct((-F.col("cost")).alias("k"), F.col("_first").alias("f"), F.col("model").alias("name"), *[F.col(c) for c in COUNTERS], F.col("cost"))
    named = F.col("model").isNotNull()
    carried = [c for c in by_model.columns if c not in {*keys, "model", *COUNTERS, "cost", "entries", "_first"}]
    total = by_model.groupBy(*keys).agg(
        *sums,
        F.sum("cost").alias("cost"),
        F.sum("entries").alias("entries"),
        F.array_sort(F.collect_list(F.when(named, F.struct(F.col("_first").alias("f"), F.col("model").alias("name"))))).alias("_models"),
        F.array_sort(F.collect_list(F.when(named, row))).alias("_rows"),
        *[(F.min(c) if c.startswith("min_") else F.max(c) if c.startswith("max_") else F.sum(c)).alias(c) for c in carried],
    )
    tokens = sum((F.col(c) for c in COUNTERS[1:]), F.col(COUNTERS[0]))
    return total.select(
        *keys,
        *COUNTERS,
        tokens.alias("total_tokens"),
        "cost",
        "entries",
        F.col("_models.name").alias("models"),
        F.transform("_rows", lambda r: F.struct(r["name"].alias("model"), *[r[c].alias(c) for c in COUNTERS], r["cost"].alias("cost"))).alias("breakdown"),
        *carried,
    )


def by_session(entries: DataFrame, keys: list[str], at: str, labels: list[str]) -> DataFrame:
    """AGG-03: one row a session: sums, first and last activity, labels of the latest row, sorted versions.

    entries: the keys, at (epoch ms), the counters, cost, version and the labels. Of rows at the latest
    instant the one with the least labels gives them. max_by and min are partially aggregated.
    """
    latest = F.min(F.struct((-F.col(at)).alias("_t"), *labels))
    return (
        entries.groupBy(*keys)
        .agg(*[F.sum(c).alias(c) for c in COUNTERS], F.sum("cost").alias("cost"), F.min(at).alias("first_ms"), F.max(at).alias("last_ms"), F.count(F.lit(1)).alias("entries"), latest.alias("_l"), F.array_sort(F.collect_set("version")).alias("versions"))
        .select("*", *[F.col(f"_l.{c}").alias(f"last_{c}") for c in labels])
        .drop("_l")
    )


def totals(rows: DataFrame) -> DataFrame:
    """AGG-08, PRJ-12: one row of sums over result rows; zeros for an empty result."""
    return rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS], F.sum("cost").alias("cost"), F.count(F.lit(1)).alias("rows"))


def across_agents(rows: DataFrame, period: str, agent: str) -> DataFrame:
    """AGG-07: one row a period with nested rows of its agents, and the sorted sets of agents and models.

    rows: period, agent, model, the counters and cost. Rows of no tokens are left out (FIL-10).
    """
    tokens = sum((F.col(c) for c in COUNTERS[1:]), F.col(COUNTERS[0]))
    sums = [F.sum(c).alias(c) for c in COUNTERS]
    by_agent = rows.groupBy(period, agent).agg(*sums, F.sum("cost").alias("cost"), F.array_sort(F.collect_set("model")).alias("models")).where(tokens > 0)
    return by_agent.groupBy(period).agg(
        *sums,
        F.sum("cost").alias("cost"),
        F.array_sort(F.collect_list(F.struct(agent, *COUNTERS, "cost", "models"))).alias("agents"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("models")))).alias("models"),
    )


def derived_rollups(cells: DataFrame, period: Column) -> DataFrame:
    """AGG-14: sums of cells by period, and by period with each of agent, machine and model, in one pass."""
    sets = cells.withColumn("period", period).groupingSets([["period"], ["period", "agent"], ["period", "machine"], ["period", "model"]], "period", "agent", "machine", "model")
    return sets.agg(F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"), F.grouping_id().alias("level"))


def by_model(entries: DataFrame) -> DataFrame:
    """AGG-11: sums by model with the flat count of cache writes, without placeholders, falling by cost."""
    named = entries.where(F.col("model").isNotNull() & ~F.col("model").rlike("^<.*>$"))
    return named.groupBy("model").agg(*[F.sum(c).alias(c) for c in COUNTERS], F.sum("cost").alias("cost")).orderBy(F.desc("cost"), "model")


def bucketed(entries: DataFrame, keys: list[str], context: Column, limit: int, tier: Column) -> DataFrame:
    """AGG-05: sums by key split into short and long contexts and by recorded tier, as conditional sums."""
    long = context > limit
    tokens = F.col("input_tokens") + F.col("output_tokens")
    return entries.groupBy(*keys).agg(
        F.sum(F.when(long, tokens).otherwise(0)).alias("long_tokens"),
        F.sum(F.when(~long, tokens).otherwise(0)).alias("short_tokens"),
        F.sum(F.when(tier == "fast", tokens).otherwise(0)).alias("fast_tokens"),
        F.sum(F.when(tier == "standard", tokens).otherwise(0)).alias("standard_tokens"),
    )

"""What the same usage would have come to elsewhere: counterfactual totals by provider."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counterfactual(usage: DataFrame, mapping: DataFrame, rates: DataFrame) -> DataFrame:
    """PRC-13, AGG-12, SRT-08: per provider the actual and the other cost of the comparable rows, and the rest.

    usage: model, tokens, cost (one row a model); mapping: model, provider, target; rates: target, rate.
    Rows without a target or rate are left out of both sides and counted as excluded. Providers with
    nothing comparable come last, then falling saving: by other cost and name. The percentage is null
    without actual cost.
    """
    # The number of models is an aggregate of its own, joined by a constant key: one row.
    number = usage.agg(F.count(F.lit(1)).alias("_all")).withColumn("_one", F.lit(1))
    rows = mapping.join(usage, "model", "left").join(rates, "target", "left")
    priced = F.col("rate").isNotNull() & F.col("tokens").isNotNull()
    found = rows.groupBy("provider").agg(
        F.sum(F.when(priced, F.col("cost"))).alias("actual"),
        F.sum(F.when(priced, F.col("tokens") * F.col("rate"))).alias("other"),
        F.sum(priced.cast("long")).alias("_priced"),
    )
    found = found.withColumn("_one", F.lit(1)).join(F.broadcast(number), "_one").withColumn("excluded", F.col("_all") - F.col("_priced")).drop("_one", "_all", "_priced")
    return found.withColumn("saving", F.col("actual") - F.col("other")).withColumn("percent", F.when(F.col("actual") > 0, F.col("saving") * 100 / F.col("actual"))).orderBy(F.col("other").isNull(), "other", "provider")

"""Activity into sessions by pauses (problem 7): a sweep line over deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR_MS = 3_600_000


def sweep_sessions(df: DataFrame, key: str, at_ms: str, gap_ms: Column) -> DataFrame:
    """key, start_ms, end_ms, duration_ms, n_rows of each session.

    gap_ms: the pause, constant in a key; a session ends where the next row comes more than gap_ms later.

    All rows of a key that fall into one time slot as wide as the gap belong to the same session, whatever
    their number. So slots are counted first, with partial aggregation before the shuffle: a key that
    holds a third of all rows shrinks to at most (time span / gap) rows, whatever its row count. Each slot
    then adds one at its first row and subtracts one at its last row plus the gap; where the running sum
    returns to zero, a session closes.

    Defined results: rows with null instants are left out, null keys are one key, a gap under 0 or null
    counts as 0 (each distinct instant is a session), ties and repeated rows count as rows, an empty table
    gives no session.
    """
    gap = F.greatest(F.coalesce(gap_ms, F.lit(0)), F.lit(0)).cast("long")
    rows = df.where(F.col(at_ms).isNotNull()).select(F.col(key).alias("_key"), F.col(at_ms).alias("_at"), gap.alias("_gap"))
    width = F.greatest(F.col("_gap"), F.lit(1))
    slots = rows.groupBy("_key", "_gap", ((F.col("_at") - F.pmod(F.col("_at"), width)) / width).cast("decimal(20,0)").alias("_slot")).agg(F.min("_at").alias("_first"), F.max("_at").alias("_last"), F.count(F.lit(1)).alias("_n"))
    deltas = slots.select(
        "_key",
        F.inline(
            F.array(
                F.struct(F.col("_first").alias("_t"), F.lit(1).alias("_d"), F.col("_first"), F.lit(None).cast("long").alias("_last"), F.lit(0).cast("long").alias("_n")),
                F.struct((F.col("_last") + F.col("_gap")).alias("_t"), F.lit(-1).alias("_d"), F.lit(None).cast("long").alias("_first"), F.col("_last"), F.col("_n")),
            )
        ),
    )
    # At equal times the addition goes first: a pause of exactly the gap doesn't end a session.
    order = Window.partitionBy("_key").orderBy("_t", F.col("_d").desc()).rowsBetween(Window.unboundedPreceding, 0)
    swept = deltas.withColumn("_open", F.sum("_d").over(order))
    closed = swept.withColumn("_session", F.sum((F.col("_open") == 0).cast("long")).over(order) - (F.col("_open") == 0).cast("long"))
    return (
        closed.groupBy("_key", "_session")
        .agg(F.min("_first").alias("start_ms"), F.max("_last").alias("end_ms"), F.sum("_n").alias("n_rows"))
        .select(F.col("_key").alias(key), "start_ms", "end_ms", (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"), "n_rows")
    )


def gap_of_hours(hours: Column, default: float = 5.0) -> Column:
    """Milliseconds of a number of hours, cut; null counts as the default."""
    return F.floor(F.coalesce(hours, F.lit(default)) * HOUR_MS).cast("long")

"""Mixed time writings to one UTC instant (problem 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.functions.instants import CANONICAL, odd_utc_millis, utc_millis, zone_version


def machine_settings(commands: DataFrame) -> DataFrame:
    """machine_id, zone and session hours, one row a machine; of repeated machines the least values count.

    No broadcast is asked for: Spark broadcasts the table only while it is under its size threshold.
    """
    return commands.where("machine_id is not null").groupBy(F.col("machine_id").alias("_machine")).agg(F.min("timezone").alias("_zone"), F.min("blocks.sessionLength").alias("_hours"))


def with_instants(df: DataFrame, settings: DataFrame, column: str, out: str = "utc_ms", version: str | None = None) -> DataFrame:
    """Add milliseconds UTC of a time column; needs machine_id and received_at. version: a column for the version of the zone data.

    Rows are never dropped: values that name no instant, null and empty ones get null. A machine without
    settings has no zone, so its local times name no instant. Other columns pass unchanged.
    """
    joined = df.join(settings.select("_machine", "_zone"), F.col("machine_id") == F.col("_machine"), "left")
    timed = joined.withColumn(out, utc_millis(F.col(column), F.col("_zone"), F.col("received_at"))).drop("_machine", "_zone")
    return timed.withColumn(version, F.lit(zone_version())) if version else timed


def odd_instants(tables: dict[str, tuple[DataFrame, str]], settings: DataFrame) -> DataFrame:
    """tab, row_id, utc_ms of all values that name an instant but aren't in canonical form.

    tables: name to (rows with row_id, machine_id and received_at; name of the time column). Canonical
    values are filtered in the scan stage, so that only the others are joined and go to Python.
    """
    parts = [
        df.select(F.lit(name).alias("tab"), "row_id", "machine_id", F.col(column).alias("written"), "received_at").where(F.col("written").isNotNull() & ~F.col("written").rlike(CANONICAL))
        for name, (df, column) in tables.items()
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    rows = rows.join(settings.select("_machine", "_zone"), F.col("machine_id") == F.col("_machine"), "left")
    return rows.select("tab", "row_id", odd_utc_millis(F.col("written"), F.col("_zone"), F.col("received_at")).alias("utc_ms")).where("utc_ms is not null")

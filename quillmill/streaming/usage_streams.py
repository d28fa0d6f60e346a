"""Structured Streaming versions of the usage operators (STR-01 to STR-05)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quillmill.functions.usage import HOUR_MS
from quillmill.runtime import new_path, temporary


def parquet_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A table's files, one or a folder of them, as a stream."""
    path = path.rstrip("/")
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern, as the source takes a plain path for a folder


def quarter_cells(stream: DataFrame, at: str, keys: list[str], late: str = "48 hours") -> DataFrame:
    """STR-01: quarter-hour cells; a cell is final when the watermark has passed it."""
    timed = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return timed.groupBy(F.window(at, "15 minutes"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.unix_millis("window.start").alias("start_ms"), *keys, "n")


def once_each(stream: DataFrame, key: list[str], at: str, within: str = "48 hours") -> DataFrame:
    """STR-03: the first row of each key within the watermark."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, within).dropDuplicatesWithinWatermark(key)


_STATE = StructType([StructField("start", LongType()), StructField("first", LongType()), StructField("last", LongType()), StructField("n", LongType())])
_BLOCK = StructType([StructField("key", StringType()), *[StructField(f"{n}", LongType()) for n in ("start_ms", "from_ms", "to_ms", "n")]])


def streamed_blocks(stream: DataFrame, key: Column, at: str, length_hours: float = 5.0, late: str = "1 hour") -> DataFrame:
    """STR-04: blocks of fixed length as they end; the state of a key is one open block.

    Within a trigger rows are taken in order of time; a row older than the open block's start is counted in
    it. The last block of a key ends when the watermark passes its length.
    """
    length = int(length_hours * HOUR_MS)

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            out.append((k[0], *state.get))
            state.remove()
        else:
            held = list(state.get) if state.exists else None
            for t in sorted(int(t) for frame in frames for t in frame["_at"]):
                if held and (t - held[0] > length or t - held[2] > length):
                    out.append((k[0], *held))
                    held = None
                held = [held[0], held[1], max(held[2], t), held[3] + 1] if held else [t // HOUR_MS * HOUR_MS, t, t, 1]
            if held:
                state.update(tuple(held))
                state.setTimeoutTimestamp(max(min(held[0], held[2]) + length + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=_BLOCK.names)

    timed = stream.withColumn("_ts", F.col(at).cast("timestamp")).withWatermark("_ts", late).select("_ts", key.cast("string").alias("_key"), F.unix_millis("_ts").alias("_at"))
    return timed.groupBy("_key").applyInPandasWithState(step, _BLOCK, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def into_table(df: DataFrame, path: str, partition: list[str], mode: str = "update") -> StreamingQuery:
    """STR-02: each trigger replaces the partitions it has rows for; running a trigger twice changes nothing."""

    def apply(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)

    return run(df, apply, mode)


def run(df: DataFrame, apply: Callable[[DataFrame, int], None], mode: str = "append", state: str | None = None) -> StreamingQuery:
    """STR-05: one query over what is there now, with its checkpoint in the shared folder (or at state); for a standing one use a processing-time trigger."""
    spark = df.sparkSession
    return df.writeStream.outputMode(mode).foreachBatch(apply).option("checkpointLocation", state or new_path(spark, "stream-state")).trigger(availableNow=True).start()


def collected(df: DataFrame, mode: str = "append", state: str | None = None) -> DataFrame:
    """All output of a stream over what is there now, as a table in the shared folder."""
    path = new_path(df.sparkSession, "stream-out")

    def append(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    run(df, append, mode, state).awaitTermination()
    temporary(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/batch=*")


def all_blocks(stream: DataFrame) -> DataFrame:
    """STR-04: the blocks of streamed_blocks over what is there now, those still open included.

    A block ends in the stream only when the watermark has passed it, so after the run the open one of each
    key is read from the stream's state.
    """
    spark = stream.sparkSession
    state = new_path(spark, "stream-state")
    closed = collected(stream, state=state)
    temporary(spark, state)
    held = spark.read.format("statestore").load(state).select(F.col("key._key").alias("key"), *[F.col(f"value.groupState.{f.name}").alias(n) for f, n in zip(_STATE.fields, _BLOCK.names[1:], strict=True)])
    return closed.unionByName(held.where("start_ms is not null"))

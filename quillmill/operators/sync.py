"""Merged rollups of several machines: folding to quarter-hour cells, idempotent application, refresh and anomalies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions.usage import DAY_MS, iso_week, local_date, quarter, salted_key
from quillmill.operators.dedupe import claimed_cells, keep_best, without
from quillmill.operators.summarize import derived_rollups
from quillmill.sources.text import Place, read_documents

SHARD = ["machine", "agent", "utc_date"]


def folded(entries: DataFrame, salt: str) -> DataFrame:
    """DED-17: entries with one salted key in each (machine, agent, day); the first entry of a key wins.

    entries: machine, agent, at (epoch ms), ord, model, message_id, request_id, session, counters, cost.
    """
    keyed = entries.where("at is not null").withColumns(
        {
            "utc_date": local_date(F.col("at")),
            "bucket": quarter(F.col("at")),
            "key": F.when(F.col("message_id").isNotNull(), salted_key(salt, F.lit("m"), F.col("message_id"), F.col("request_id"))).otherwise(salted_key(salt, F.lit("c"), F.col("session"), F.col("at"), F.col("input_tokens"), F.col("output_tokens"), F.col("model"))),
        }
    )
    return keep_best(keyed, [F.col(c) for c in (*SHARD, "key")], [F.col("ord")])


def cells(entries: DataFrame) -> DataFrame:
    """AGG-13: quarter-hour cells by model of folded entries."""
    return entries.groupBy(*SHARD, "bucket", "model").agg(
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cost").alias("cost"), F.count(F.lit(1)).alias("messages"), F.array_sort(F.collect_set("key")).alias("keys")
    )


def session_days(entries: DataFrame) -> DataFrame:
    """AGG-13: first and last instant and cost of each session in a day."""
    return entries.groupBy(*SHARD, "session").agg(F.min("at").alias("first_ms"), F.max("at").alias("last_ms"), F.sum("cost").alias("cost"))


def content_hash(cell: DataFrame) -> DataFrame:
    """FN-H3: a hash of each shard's cells that doesn't depend on their order or the time of writing.

    The digests of the cells are added up in four parts of 60 bits, partially aggregated, so no shard's
    cells meet in one place; the sums and the count are hashed.
    """
    row = F.sha2(F.concat_ws("|", "bucket", F.coalesce("model", F.lit("\0")), "input_tokens", "output_tokens", F.round(F.col("cost").cast("decimal(38,10)") * 10_000_000, 0).cast("decimal(38,0)").cast("string"), "messages", F.array_join("keys", ",")), 256)
    parts = [F.sum(F.conv(F.substring(row, 1 + 15 * k, 15), 16, 10).cast("decimal(28,0)")).cast("string") for k in range(4)]
    return cell.groupBy(*SHARD).agg(F.sha2(F.concat_ws(",", F.count(F.lit(1)).cast("string"), *parts), 256).alias("hash"))


def in_order(cell: DataFrame) -> DataFrame:
    """SRT-07: cells by quarter hour, machine, agent and model, the days in turn."""
    return cell.orderBy("utc_date", "bucket", "machine", "agent", "model")


def apply_shards(cell: DataFrame, path: str) -> None:
    """SYN-01, SNK-09: replace all cells of the shards present; others stay. Applying twice changes nothing."""
    cell.repartition(*SHARD).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*SHARD).parquet(path)


def live(rollup: DataFrame, index: DataFrame) -> DataFrame:
    """SYN-02, JOIN-16: the rollup without shards that the index no longer has."""
    return rollup.join(index.select(*SHARD).distinct(), SHARD, "left_semi")


def changed(index: DataFrame, applied: DataFrame) -> DataFrame:
    """JOIN-15: shards whose content hash isn't the one already applied."""
    return without(index, applied, [*SHARD, "hash"])


def planned(now: DataFrame, index: DataFrame, now_ms: int, hours: int = 48) -> DataFrame:
    """SYN-04, SYN-05: unchanged, upload or lateEdit (a change after the day was final) of each shard."""
    ended = F.unix_date(F.col("utc_date").cast("date")).cast("long") * DAY_MS + DAY_MS
    old = index.select(*SHARD, F.col("hash").alias("_old"))
    plan = F.when(F.col("hash").isNull(), "unhashable").when(F.col("_old") == F.col("hash"), "unchanged").when(F.col("_old").isNotNull() & (F.lit(now_ms) - ended > hours * 3_600_000), "lateEdit").otherwise("upload")
    return now.join(old, SHARD, "left").select(*SHARD, plan.alias("plan"))


def anomalies(shards: DataFrame) -> DataFrame:
    """SYN-06: lateEdit, unreadableShard and misplacedShard rows of shards with path and content columns."""
    place = F.concat_ws("/", *SHARD)
    kind = F.array_compact(
        F.array(F.when(F.col("late_edits") > 0, "lateEdit"), F.when(~F.col("readable"), "unreadableShard"), F.when(F.col("readable") & (F.col("place") != place), "misplacedShard"))
    )
    return shards.select(*SHARD, F.explode(kind).alias("anomaly"))


def refreshed(applied: DataFrame, incoming: DataFrame, index: DataFrame) -> DataFrame:
    """SYN-03: applied cells, with the incoming shards in their place, without stale shards, duplicates marked."""
    merged = live(without(applied, incoming, SHARD).unionByName(incoming), index)
    keys = merged.select(F.col("utc_date").alias("date"), "agent", "bucket", F.coalesce("model", F.lit("")).alias("model"), F.lit("").alias("salt"), "machine", F.explode("keys").alias("key"))
    verdicts = claimed_cells(keys).select(F.col("date").alias("utc_date"), "agent", "bucket", "model", "machine", "verdict")
    return merged.withColumn("model", F.coalesce("model", F.lit(""))).join(verdicts, ["utc_date", "agent", "bucket", "model", "machine"], "left").withColumn("verdict", F.coalesce("verdict", F.lit("kept")))


def clashes(index: DataFrame, one: str, other: str) -> DataFrame:
    """SYN-08: days that both machines have, which forbid moving one into the other."""
    a, b = (index.where(F.col("machine") == m).select("agent", "utc_date") for m in (one, other))
    return a.join(b, ["agent", "utc_date"], "left_semi").distinct()


def moved(index: DataFrame, one: str, other: str) -> DataFrame:
    """SYN-08: shards of one machine under the other's name."""
    return index.withColumn("machine", F.when(F.col("machine") == one, other).otherwise(F.col("machine")))


def pruned(index: DataFrame, today: Column, days: int) -> DataFrame:
    """SYN-09: shards of the last days only."""
    return index.where(F.date_diff(today, F.col("utc_date").cast("date")) <= days)


def repaired(cell: DataFrame, old_index: DataFrame) -> DataFrame:
    """SYN-07: the index anew from the shards; the history of those with an unchanged hash is kept."""
    fresh = content_hash(cell)
    return fresh.join(old_index.select(*SHARD, "hash", "late_edits"), [*SHARD, "hash"], "left").withColumn("late_edits", F.coalesce("late_edits", F.lit(0)))


def read_shards(spark: SparkSession, path: Place, schema: str) -> DataFrame:
    """SRC-37, SRC-38: shard documents below <machine>/shards/<agent>/<Y>/<M>/<D>.json with status columns; unreadable ones stay as rows."""
    raw = read_documents(spark, path)
    place = F.col("file_path")
    pattern = r"([^/]+)/shards/([^/]+)/(\d{4})/(\d{2})/(\d{2})\.json$"
    part = [F.regexp_extract(place, pattern, k) for k in range(1, 6)]
    return raw.select(
        part[0].alias("machine"), part[1].alias("agent"), F.concat_ws("-", *part[2:]).alias("utc_date"), place.alias("place"), F.from_json("value", schema).alias("shard"), F.try_parse_json("value").isNotNull().alias("readable")
    ).where("machine <> ''")


def write_rollups(cell: DataFrame, path: str) -> None:
    """SNK-10: the derived tables daily, weekly, monthly and models below a path, each replaced as a whole."""
    day = F.col("utc_date").cast("date")
    rows = cell.withColumn("tokens", F.col("input_tokens") + F.col("output_tokens"))
    for name, period in {"daily": F.col("utc_date"), "weekly": iso_week(day), "monthly": F.substring("utc_date", 1, 7)}.items():
        derived_rollups(rows, period).write.mode("overwrite").parquet(f"{path}/{name}")
    rows.groupBy("model").agg(F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost")).write.mode("overwrite").parquet(f"{path}/models")

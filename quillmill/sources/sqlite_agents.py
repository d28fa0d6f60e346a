"""Readers of usage stores in SQLite."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.functions.usage import counter, iso_ms
from quillmill.operators.dedupe import keep_best, merged_identities, migrated, without
from quillmill.sources.document_agents import read_documents
from quillmill.sources.entries import entries, used, with_total
from quillmill.sources.sqlite import read_table
from quillmill.sources.text import Place, stem, text

_DATA = "struct<id:string,sessionID:string,role:string,modelID:string,providerID:string,model:struct<id:string,providerID:string>,cost:double,time:struct<created:double>,tokens:struct<input:bigint,output:bigint,reasoning:bigint,total:bigint,cache:struct<read:bigint,write:bigint>>>"


def epoch_ms(x: Column) -> Column:
    """Seconds or milliseconds since 1970 as milliseconds."""
    return F.when(x.cast("double") < 1e11, x.cast("double") * 1000).otherwise(x.cast("double")).cast("long")


def _message(rows: DataFrame, agent: str, project: str, created: Column) -> DataFrame:
    t = F.col("r.tokens")
    cols = {"input_tokens": t["input"], "output_tokens": t["output"], "cache_creation_tokens": t["cache"]["write"], "cache_read_tokens": t["cache"]["read"]}
    return used(entries(rows, agent, keep=["rank"], ts_ms=F.coalesce(epoch_ms(F.col("r.time.created")), created), session_id=F.coalesce(text(F.col("r.sessionID")), "session_id"), project_path=F.lit(project), message_id=F.coalesce(text(F.col("r.id")), "id"), model=text(F.coalesce("r.modelID", "r.model.id")), stored_cost=F.col("r.cost"), **with_total(t["total"], cols, t["reasoning"])))


def opencode(spark: SparkSession, path: Place) -> DataFrame:
    """SRC-13, SRC-14, DED-06, DED-09: messages of both tables, then JSON files, by rank; one row an id; totals of sessions without any message."""
    cols = "id string, session_id string, time_created bigint, data string"
    db = read_table(spark, path, "message", cols).withColumn("rank", F.lit(0)).unionByName(read_table(spark, path, "session_message", cols).withColumn("rank", F.lit(1)))
    files = read_documents(spark, path, "*.json").where(F.contains("file_path", F.lit("/storage/message/"))).select("file_path", stem(F.col("file_path")).alias("id"), F.lit(None).cast("string").alias("session_id"), F.lit(None).cast("long").alias("time_created"), F.col("value").alias("data"), F.lit(2).alias("rank"))
    rows = db.unionByName(files).withColumn("r", F.from_json("data", _DATA))
    found = keep_best(_message(rows, "opencode", "OpenCode", epoch_ms(F.col("time_created"))), [F.col("message_id")], [F.col("rank"), F.col("file_path")])
    session_cols = "id string, time_created bigint, cost double, tokens_input bigint, tokens_output bigint, tokens_cache_read bigint, tokens_cache_write bigint, tokens_reasoning bigint, model string"
    sessions = read_table(spark, path, "session_v2", session_cols).unionByName(read_table(spark, path, "session", session_cols)).withColumn("rank", F.lit(3))
    totals = used(entries(sessions, "opencode", keep=["rank"], ts_ms=epoch_ms(F.col("time_created")), session_id=F.col("id"), project_path=F.lit("OpenCode"), model=F.coalesce(F.get_json_object("model", "$.id"), text(F.col("model"))), input_tokens=F.col("tokens_input"), output_tokens=F.col("tokens_output"), cache_creation_tokens=F.col("tokens_cache_write"), cache_read_tokens=F.col("tokens_cache_read"), extra_tokens=F.col("tokens_reasoning"), stored_cost=F.col("cost")))
    totals = keep_best(totals, [F.col("session_id")], [F.col("rank"), F.col("file_path")])
    return found.unionByName(without(totals, found, ["session_id"])).drop("rank")


def kilo(spark: SparkSession, path: Place) -> DataFrame:
    """SRC-23, DED-06: assistant messages, the first of each id."""
    rows = read_table(spark, path, "message", "id string, session_id string, data string").withColumns({"r": F.from_json("data", _DATA), "rank": F.lit(0)}).where("r.role = 'assistant'")
    return keep_best(_message(rows, "kilo", "Kilo", F.lit(None).cast("long")), [F.col("message_id")], [F.col("file_path"), F.col("ts_ms")]).drop("rank")


def goose(spark: SparkSession, path: Place) -> DataFrame:
    """SRC-21: one entry a session; accumulated counts first; what the total has beyond input and output is reasoning."""
    cols = "id string, model_config_json string, provider_name string, created_at string, total_tokens bigint, input_tokens bigint, output_tokens bigint, accumulated_total_tokens bigint, accumulated_input_tokens bigint, accumulated_output_tokens bigint"
    rows = read_table(spark, path, "sessions", cols)
    into, out = (F.coalesce(f"accumulated_{c}_tokens", f"{c}_tokens", F.lit(0)) for c in ("input", "output"))
    total = F.coalesce("accumulated_total_tokens", "total_tokens", into + out)
    at = F.col("created_at")
    ts = F.coalesce(epoch_ms(F.when(at.rlike(r"^[0-9]+(\.[0-9]+)?$"), at)), iso_ms(at), F.unix_millis(F.try_to_timestamp(at)))
    return used(entries(rows, "goose", ts_ms=ts, session_id=F.col("id"), project_path=F.lit("Goose"), message_id=F.col("id"), model=text(F.get_json_object("model_config_json", "$.model_name")), input_tokens=into, output_tokens=out, extra_tokens=F.greatest(total - into - out, F.lit(0))))


def hermes(spark: SparkSession, path: Place) -> DataFrame:
    """SRC-18: one entry a session with a model; the actual cost before the estimate."""
    cols = "id string, source string, model string, started_at double, message_count bigint, input_tokens bigint, output_tokens bigint, cache_read_tokens bigint, cache_write_tokens bigint, reasoning_tokens bigint, billing_provider string, estimated_cost_usd double, actual_cost_usd double"
    return hermes_rows(read_table(spark, path, "sessions", cols), epoch_ms(F.col("started_at")))


def hermes_rows(rows: DataFrame, ts: Column) -> DataFrame:
    return used(entries(rows, "hermes", ts_ms=ts, session_id=F.col("id"), project_path=F.lit("Hermes"), message_id=F.col("id"), model=text(F.col("model")), input_tokens=F.col("input_tokens"), output_tokens=F.col("output_tokens"), cache_creation_tokens=F.col("cache_write_tokens"), cache_read_tokens=F.col("cache_read_tokens"), extra_tokens=F.col("reasoning_tokens"), stored_cost=F.coalesce("actual_cost_usd", "estimated_cost_usd"), message_count=F.col("message_count")))


def zcode(spark: SparkSession, path: Place) -> DataFrame:
    """SRC-32, JOIN-11, DED-06: completed usage rows with their session's folder; the first of each id in order of the files."""
    cols = "id string, session_id string, started_at bigint, model_id string, provider_id string, status string, input_tokens bigint, output_tokens bigint, cache_creation_input_tokens bigint, cache_read_input_tokens bigint, computed_total_tokens bigint"
    rows = read_table(spark, path, "model_usage", cols).where("status = 'completed'")
    sessions = read_table(spark, path, "session", "id string, directory string, version string").select("file_path", F.col("id").alias("session_id"), "directory", F.col("version").alias("app"))
    joined = rows.join(sessions, ["file_path", "session_id"], "left")
    return keep_best(zcode_rows(joined, epoch_ms(F.col("started_at")), F.col("directory")), [F.col("message_id")], [F.col("file_path"), F.col("ts_ms")])


def zcode_rows(rows: DataFrame, ts: Column, directory: Column) -> DataFrame:
    cached, written = counter(F.col("cache_read_input_tokens")), counter(F.col("cache_creation_input_tokens"))
    cols = {"input_tokens": F.greatest(counter(F.col("input_tokens")) - cached - written, F.lit(0)), "output_tokens": F.col("output_tokens"), "cache_creation_tokens": written, "cache_read_tokens": cached}
    return used(entries(rows, "zcode", ts_ms=ts, session_id=F.col("session_id"), project_path=directory, message_id=F.col("id"), model=text(F.col("model_id")), **with_total(F.col("computed_total_tokens"), cols)))


def openclaw_store(spark: SparkSession, path: Place) -> DataFrame:
    """SRC-22: transcript events in order of session and number, as entries."""
    schema = "struct<id:string,timestamp:string,message:struct<role:string,model:string,modelId:string,usage:struct<input:bigint,output:bigint,cacheRead:bigint,cacheWrite:bigint,totalTokens:bigint,cost:struct<total:double>>>>"
    rows = read_table(spark, path, "transcript_events", "session_id string, seq bigint, event_json string, created_at bigint").withColumn("r", F.from_json("event_json", schema)).where("r.message.usage is not null and r.message.role = 'assistant'")
    u = F.col("r.message.usage")
    cols = {"input_tokens": u["input"], "output_tokens": u["output"], "cache_read_tokens": u["cacheRead"], "cache_creation_tokens": u["cacheWrite"]}
    return used(entries(rows, "openclaw", ts_ms=F.coalesce(iso_ms(F.col("r.timestamp")), epoch_ms(F.col("created_at"))), session_id=F.col("session_id"), project_path=F.lit("OpenClaw"), message_id=F.col("r.id"), model=F.concat(F.lit("[openclaw] "), F.coalesce("r.message.modelId", "r.message.model")), stored_cost=u["cost"]["total"], **with_total(u["totalTokens"], cols)))


def openclaw_merged(lines: DataFrame, store: DataFrame) -> DataFrame:
    """DED-10: rows of the store in place of the matching lines."""
    key = F.sha2(F.concat_ws("\1", F.col("ts_ms").cast("string"), "model", *[F.col(c).cast("string") for c in ("input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens")]), 256)
    columns = store.columns
    keyed = [df.select(*columns, key.alias("content_id"), F.col("session_id").alias("session")) for df in (lines, store)]
    return migrated(*keyed).select(*columns)


# --- protobuf ---------------------------------------------------------------------------------------------


def wire(blob: bytes) -> dict[int, list]:
    """Fields of a protobuf message by number: whole numbers and bytes in order; a broken message raises ValueError."""
    fields: dict[int, list] = {}
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            if at >= len(blob) or shift > 63:
                raise ValueError("broken varint")
            byte = blob[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(blob):
        tag = varint()
        number, kind = tag >> 3, tag & 7
        if kind == 0:
            value: object = varint()
        else:
            size = {1: 8, 5: 4}.get(kind)
            size = varint() if kind == 2 else size
            if size is None or at + size > len(blob):
                raise ValueError("broken field")
            value = blob[at : at + size]
            at += size
            if kind != 2:
                continue
        fields.setdefault(number, []).append(value)
    return fields


# Field numbers of a usage message.
_USAGE = {"model_id": 1, "input_tokens": 2, "output_tokens": 3, "cache_creation_tokens": 4, "cache_read_tokens": 5, "provider": 6, "k1": 7, "k2": 11, "k3": 12}


def _usage_of(blob: bytes) -> dict:
    fields = wire(blob)
    first = {n: fields.get(k, [None])[-1] for n, k in _USAGE.items()}
    return {n: (v.decode("utf-8", "replace") or None if isinstance(v, bytes) else v) if n[0] == "k" else v if isinstance(v, int) else None for n, v in first.items()}


def _time_of(blob: object) -> int | None:
    if not isinstance(blob, bytes):
        return None
    f = wire(blob)
    seconds, nanos = f.get(1, [0])[-1], f.get(2, [0])[-1]
    return seconds * 1000 + min(nanos, 999_999_999) // 1_000_000 if isinstance(seconds, int) and seconds > 0 and isinstance(nanos, int) else None


_EVENT = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "file_path", "k1", "k2", "k3", "model")] + [T.StructField(n, T.LongType()) for n in ("ts", "input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens")])


def antigravity(spark: SparkSession, path: Place) -> DataFrame:
    """SRC-28, DED-13: usage of step records in protobuf, retries included; events that share an identity are one.

    A broken message fails the read.
    """
    steps = read_table(spark, path, "steps", "idx bigint, metadata binary")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for file, idx, blob in zip(batch["file_path"], batch["idx"], batch["metadata"], strict=True):
                if blob is None:
                    continue
                f = wire(bytes(blob))
                info = wire(f[24][-1]) if 24 in f else {}
                name = info.get(12, info.get(8, [None]))[-1]
                at = _time_of(f.get(8, f.get(1, [None]))[-1])
                usages = [*f.get(9, []), *(u for r in f.get(28, []) for u in wire(r).get(2, []))]
                for k, usage in enumerate(usages):
                    u = _usage_of(usage)
                    model = name.decode("utf-8", "replace") if isinstance(name, bytes) else f"model-{u['model_id']}" if u["model_id"] else None
                    out.append((f"{file}:{idx}:{k}", file, u["k1"], u["k2"], u["k3"], model, at, *(u[c] or 0 for c in ("input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens"))))
            yield pd.DataFrame(out, columns=_EVENT.names).astype({"ts": "Int64"})

    events = steps.mapInPandas(decode, _EVENT)
    merged = merged_identities(events, ["k1", "k2", "k3"], ["input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens"])
    files = events.select(F.col("id").alias("component"), "file_path")
    rows = merged.join(files, "component")
    return used(entries(rows, "antigravity", ts_ms=F.col("ts"), session_id=stem(F.col("file_path")), project_path=F.lit("Antigravity"), message_id=F.col("component"), model=text(F.col("model")), **{c: F.col(c) for c in ("input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens")}))


READERS = {"opencode": opencode, "kilo": kilo, "goose": goose, "hermes": hermes, "zcode": zcode, "antigravity": antigravity}

"""Queries of the readers and reports over the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions.usage import cache_creation, counter, model_label
from quillmill.operators import dedupe, instants
from quillmill.options import Options
from quillmill.plans import reports
from quillmill.runtime import table
from quillmill.sources import jsonl_agents, sqlite_agents
from quillmill.sources.entries import COLUMNS, entries, used


def _timed(spark: SparkSession, d: str, name: str, column: str) -> DataFrame:
    return instants.with_instants(table(spark, d, name), instants.machine_settings(table(spark, d, "commands")), column, "ts_ms")


def chat_entries(spark: SparkSession, d: str, daily: bool = False) -> DataFrame:
    """Entries of the chat table, merged as the logs are (DED-01 or DED-03)."""
    u = F.col("message.usage")
    split = u["cache_creation"]
    written = cache_creation(u["cache_creation_input_tokens"], split["ephemeral_5m_input_tokens"], split["ephemeral_1h_input_tokens"], split.isNotNull())
    tokens = counter(u["input_tokens"]) + counter(u["output_tokens"]) + written + counter(u["cache_read_input_tokens"])
    rows = _timed(spark, d, "chat", "timestamp").select(
        F.col("row_id").alias("ord"), F.col("message.id").alias("message_id"), F.col("requestId").alias("request_id"), F.col("sessionId").alias("session"), F.col("ts_ms").alias("ts"), F.col("isSidechain").alias("is_sidechain"), tokens.alias("tokens"), F.col("message.usage.speed").alias("speed"), F.col("costUSD").alias("cost"),
        "project", "version", F.col("message.model").alias("model"), u["input_tokens"].alias("i"), u["output_tokens"].alias("o"), written.alias("w"), u["cache_read_input_tokens"].alias("c"),
    )
    kept = dedupe.greedy_entries(rows, daily)
    return entries(kept, "claude", ts_ms=F.col("ts"), session_id=F.col("session"), project=F.col("project"), project_path=F.col("project"), message_id=F.col("message_id"), request_id=F.col("request_id"), version=F.col("version"), model=model_label(F.col("model"), F.col("speed")), speed=F.col("speed"), is_sidechain=F.coalesce("is_sidechain", F.lit(False)), input_tokens=F.col("i"), output_tokens=F.col("o"), cache_creation_tokens=F.col("w"), cache_read_tokens=F.col("c"), stored_cost=F.col("cost"))


def session_entries(spark: SparkSession, d: str) -> DataFrame:
    rows = dedupe.keep_best(_timed(spark, d, "sessions", "started_at"), [F.col("id")], [F.col("row_id")])
    return sqlite_agents.hermes_rows(rows, F.col("ts_ms"))


def usage_entries(spark: SparkSession, d: str) -> DataFrame:
    rows = dedupe.keep_best(_timed(spark, d, "model_usage", "started_at").where("status = 'completed'"), [F.col("id")], [F.col("row_id")])
    return sqlite_agents.zcode_rows(rows, F.col("ts_ms"), F.lit(None))


def span_entries(spark: SparkSession, d: str) -> DataFrame:
    """Spans with dotted or nested attributes, an export of a machine being a file."""
    rows = _timed(spark, d, "trace", "endTime")
    return jsonl_agents.copilot_spans(rows.select(F.col("machine_id").alias("file_path"), F.lpad(F.col("row_id").cast("string"), 20, "0").alias("ord"), "type", "traceId", "name", "ts_ms", F.try_parse_json("attributes").alias("attributes")))


def all_entries(spark: SparkSession, d: str) -> DataFrame:
    """SET-01: the agents' entries in one table."""
    found = None
    for part in (chat_entries(spark, d, daily=True), session_entries(spark, d), usage_entries(spark, d), span_entries(spark, d)):
        part = used(part.select(*COLUMNS))
        found = part if found is None else found.unionByName(part)
    return found


def rpt_01(spark: SparkSession, d: str) -> DataFrame:
    return reports.unified(all_entries(spark, d), "daily", Options(zone="Europe/Berlin"))


def rpt_03(spark: SparkSession, d: str) -> DataFrame:
    return reports.periods(chat_entries(spark, d), "weekly")


def rpt_04(spark: SparkSession, d: str) -> DataFrame:
    return reports.sessions(chat_entries(spark, d))


def rpt_05(spark: SparkSession, d: str) -> DataFrame:
    return reports.block_report(chat_entries(spark, d), Options(now_ms=1_793_700_000_000))


def rpt_08(spark: SparkSession, d: str) -> DataFrame:
    return reports.periods(usage_entries(spark, d), "monthly")


def src_18(spark: SparkSession, d: str) -> DataFrame:
    rows = dedupe.keep_best(table(spark, d, "sessions"), [F.col("id")], [F.col("row_id")])
    return sqlite_agents.hermes_rows(rows, F.lit(0)).select(F.col("session_id").alias("id"), "model", "input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens", "extra_tokens", "stored_cost")


def src_32(spark: SparkSession, d: str) -> DataFrame:
    rows = dedupe.keep_best(table(spark, d, "model_usage").where("status = 'completed'"), [F.col("id")], [F.col("row_id")])
    return sqlite_agents.zcode_rows(rows, F.lit(0), F.lit(None)).select(F.col("message_id").alias("id"), "model", "input_tokens", "cache_creation_tokens", "cache_read_tokens")


def src_35(spark: SparkSession, d: str) -> DataFrame:
    return jsonl_agents.hooks(table(spark, d, "statusline"), "payload", ["row_id"])


def queries() -> dict:
    return {
        "RPT_01_unified_daily": rpt_01, "RPT_03_chat_weekly": rpt_03, "RPT_04_chat_sessions": rpt_04, "RPT_05_chat_blocks": rpt_05, "RPT_08_usage_monthly": rpt_08,
        "SRC_18_sessions": src_18, "SRC_32_model_usage": src_32, "SRC_35_hooks": src_35,
    }


def oracle_sql() -> dict[str, str]:
    count = lambda c: f"greatest(coalesce({c}, 0), 0)"
    return {
        "SRC_18_sessions": f"""with s as (select * from sessions qualify row_number() over (partition by id order by row_id) = 1), e as (select id, nullif(trim(model), '') as model, {count('input_tokens')} as input_tokens, {count('output_tokens')} as output_tokens, {count('cache_write_tokens')} as cache_creation_tokens,
            {count('cache_read_tokens')} as cache_read_tokens, {count('reasoning_tokens')} as extra_tokens, coalesce(actual_cost_usd, estimated_cost_usd) as stored_cost from s) select * from e where model is not null and input_tokens + output_tokens + cache_creation_tokens + cache_read_tokens + extra_tokens > 0""",
        "SRC_32_model_usage": f"""with s as (select *, {count('cache_read_input_tokens')} as c, {count('cache_creation_input_tokens')} as w from model_usage where status = 'completed' qualify row_number() over (partition by id order by row_id) = 1)
            select id, nullif(trim(model_id), '') as model, greatest({count('input_tokens')} - c - w, 0) as input_tokens, w as cache_creation_tokens, c as cache_read_tokens from s where nullif(trim(model_id), '') is not null and greatest({count('input_tokens')}, {count('output_tokens')}, c, w, {count('computed_total_tokens')}) > 0""",
        "SRC_35_hooks": """select row_id, json_extract_string(payload, '$.session_id') as session_id, json_extract_string(payload, '$.transcript_path') as transcript_path, coalesce(json_extract_string(payload, '$.model.display_name'), json_extract_string(payload, '$.model.id')) as model,
            cast(json_extract_string(payload, '$.cost.total_cost_usd') as double) as cost, cast(json_extract_string(payload, '$.context_window.total_input_tokens') as bigint) as context, cast(json_extract_string(payload, '$.context_window.context_window_size') as bigint) as size, json_extract_string(payload, '$.effort.level') as effort from statusline""",
    }

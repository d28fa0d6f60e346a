"""The reports over entries that readers gave, with SQL: RPT-01, 03 to 05, 07 to 09, and the orders they are in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.operators import sync
from quillmill.options import Options
from quillmill.plans import core_queries, reports, source_queries
from quillmill.runtime import persisted, table
from quillmill.sources import jsonl_agents, registry

_SUMS = "cast(sum(input_tokens) as bigint) as input_tokens, cast(sum(output_tokens) as bigint) as output_tokens, cast(sum(cache_creation_tokens) as bigint) as cache_creation_tokens, cast(sum(cache_read_tokens) as bigint) as cache_read_tokens"
_COUNTS = ["input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens"]
_PI, _QWEN = (source_queries.oracle_sql()[n] for n in ("SRC_19_pi", "SRC_30_qwen"))
_BASE = f"with x as ({_PI}), y as ({_QWEN}), z as (select 'pi' as agent, * from x union all select 'qwen', * from y), e as (select *, strftime(timezone('Europe/Berlin', timezone('UTC', epoch_ms(ts_ms))), '%Y-%m-%d') as day from z)"
ZONE = "Europe/Berlin"


def entries(spark: SparkSession, d: str) -> DataFrame:
    """Two agents' logs through the registry."""
    qwen = source_queries.usage(spark, d)
    s, c = source_queries.s, F.col
    usage_of = s(promptTokenCount=c("i") + c("c"), candidatesTokenCount=c("o"), thoughtsTokenCount=c("w"), cachedContentTokenCount=c("c"), totalTokenCount=c("t"))
    lines = source_queries.lines(qwen, F.concat(F.lit("q/projects/"), "m", F.lit("/chats/"), "s", F.lit(".jsonl")), s(type="assistant", sessionId=c("s"), timestamp=c("iso"), model=c("model"), uuid=c("id"), usageMetadata=usage_of))
    return registry.load(spark, {"pi": source_queries._pi_lines(spark, d), "qwen": lines})[0]


def _ranked(rows: DataFrame, *order) -> DataFrame:
    """Rows with their place in the order the report has."""
    return rows.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def rpt_01(spark: SparkSession, d: str) -> DataFrame:
    return reports.unified_rows(entries(spark, d), "daily", Options(zone=ZONE, order="desc")).select("period", "agent", *_COUNTS, F.array_join("models", ",").alias("models"))


def srt_04(spark: SparkSession, d: str) -> DataFrame:
    """The order of the rows as the report gives them."""
    rows = reports.unified_rows(entries(spark, d), "monthly", Options(zone=ZONE, order="desc")).select("period", "agent")
    return rows.withColumn("place", F.monotonically_increasing_id()).withColumn("place", F.row_number().over(Window.orderBy("place")))


def _periods(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        found = reports.periods(entries(spark, d).where("agent = 'pi'"), kind, Options(zone=ZONE, first_day=3, since="2026-09-20", until="2026-12-31"))
        return found.select("period", *_COUNTS, "entries", F.array_join(F.array_sort("models"), ",").alias("models"))

    return run


def rpt_08_sessions(spark: SparkSession, d: str) -> DataFrame:
    return reports.sessions(entries(spark, d), Options(zone=ZONE), ("agent", "session_id")).select("agent", "session_id", *_COUNTS, "entries", "first_ms", "last_ms")


def rpt_05(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of all entries, of the last days before a moment, with their share of a limit."""
    found = reports.block_report(entries(spark, d), Options(now_ms=1_793_000_000_000, recent=True, token_limit=5_000_000))
    return found.select("start_ms", "from_ms", "to_ms", "active", *_COUNTS, "entries", "limit_status")


def rpt_07(spark: SparkSession, d: str) -> DataFrame:
    """Usage by model against rates of two providers that know some of the models."""
    found = persisted(entries(spark, d), "rpt-entries")
    models = found.where("model is not null").select("model").distinct()
    mapping = models.where(~F.col("model").endswith("0")).select("model", F.explode(F.array(F.lit("one"), F.lit("two"))).alias("provider")).withColumn("target", F.concat_ws("/", "provider", "model"))
    rates = mapping.where("provider = 'one' or model like 'v%'").select("target", (F.length("target") / 1e6).alias("rate"))
    return reports.comparison(found, mapping, rates).select("provider", "actual", "other", "excluded")


def rpt_09(spark: SparkSession, d: str) -> DataFrame:
    found = reports.codex(jsonl_agents.codex(spark, source_queries.log_lines(spark, d).where(F.contains("file_path", F.lit("sessions/")))), "daily")
    return found.select("period", F.explode("models").alias("model", "v")).select("period", "model", *[F.col(f"v.{c}").alias(c) for c in ("input_tokens", "output_tokens")])


def srt_07(spark: SparkSession, d: str) -> DataFrame:
    """Cells in their order, numbered as they come."""
    cells = sync.in_order(core_queries.quarter_cells(spark, d)).select("utc_date", "bucket", "machine", "agent", "model")
    return cells.withColumn("place", F.monotonically_increasing_id()).withColumn("place", F.row_number().over(Window.orderBy("place")))


def prj_10(spark: SparkSession, d: str) -> DataFrame:
    """Limit messages made of chat rows, with the seconds after the first bar."""
    from quillmill.functions.usage import limit_reset

    chat = table(spark, d, "chat").select("row_id", "isApiErrorMessage", F.concat(F.lit("Claude AI usage limit reached"), F.when(F.col("row_id") % 2 == 0, " for now").otherwise(""), F.lit("|"), (F.col("row_id") * 7919).cast("string"), F.lit("|9")).alias("text"))
    return chat.select("row_id", limit_reset(F.col("text"), F.coalesce("isApiErrorMessage", F.lit(False))).alias("reset_ms"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "RPT_01_agents_daily": rpt_01, "SRT_04_agents_monthly": srt_04, "RPT_03_weeks_from_wednesday": _periods("weekly"), "RPT_08_pi_daily": _periods("daily"), "RPT_08_pi_monthly": _periods("monthly"), "RPT_08_sessions": rpt_08_sessions,
        "RPT_05_recent_blocks": rpt_05, "RPT_07_comparison": rpt_07, "RPT_09_codex_daily": rpt_09, "SRT_07_cells": srt_07, "PRJ_10_limit_reset": prj_10,
    }


def _period_sql(period: str) -> str:
    return f"{_BASE} select {period} as period, {_SUMS}, count(*) as entries, list_aggregate(list_sort(list_distinct(list(model))), 'string_agg', ',') as models from e where agent = 'pi' and day between '2026-09-20' and '2026-12-31' group by 1"


def oracle_sql() -> dict[str, str]:
    tokens = "input_tokens + output_tokens + cache_creation_tokens + cache_read_tokens"
    blocks = f"""{_BASE}, t as (select distinct ts_ms as ms from e), w as (select ms, row_number() over (order by ms) as n from t)"""
    return {
        "RPT_01_agents_daily": f"{_BASE} select day as period, agent, {_SUMS}, list_aggregate(list_sort(list_distinct(list(model))), 'string_agg', ',') as models from e group by 1, 2",
        "SRT_04_agents_monthly": f"{_BASE} select period, agent, row_number() over (order by period desc, agent desc) as place from (select distinct substr(day, 1, 7) as period, agent from e)",
        "RPT_03_weeks_from_wednesday": _period_sql("strftime(cast(day as date) - cast((dayofweek(cast(day as date)) + 4) % 7 as integer), '%Y-%m-%d')"),
        "RPT_08_pi_daily": _period_sql("day"),
        "RPT_08_pi_monthly": _period_sql("substr(day, 1, 7)"),
        "RPT_08_sessions": f"{_BASE} select agent, session_id, {_SUMS}, count(*) as entries, min(ts_ms) as first_ms, max(ts_ms) as last_ms from e group by 1, 2 having sum({tokens}) > 0",
        "RPT_05_recent_blocks": blocks.replace("with x as", "with recursive x as") + f""", b(start_ms, from_n, to_n, n) as (select ms // 3600000 * 3600000, 1, 1, 1 from w where n = 1 union all
  select case when t.ms > b.start_ms + 18000000 or t.ms - p.ms > 18000000 then t.ms // 3600000 * 3600000 else b.start_ms end, case when t.ms > b.start_ms + 18000000 or t.ms - p.ms > 18000000 then t.n else b.from_n end, t.n, t.n from b join w p on p.n = b.n join w t on t.n = b.n + 1),
  g as (select start_ms, from_n, max(to_n) as to_n from b group by 1, 2), h as (select g.start_ms, f.ms as from_ms, l.ms as to_ms from g join w f on f.n = g.from_n join w l on l.n = g.to_n),
  k as (select h.*, 1793000000000 - to_ms < 18000000 and 1793000000000 < start_ms + 18000000 as active from h) select k.start_ms, from_ms, to_ms, active, {_SUMS}, count(*) as entries, case when sum({tokens}) > 5000000 then 'exceeds' when sum({tokens}) > 4000000 then 'warning' else 'ok' end as limit_status
  from k join e on e.ts_ms between k.from_ms and k.to_ms where active or start_ms >= 1793000000000 - 259200000 group by 1, 2, 3, 4""",
        "RPT_07_comparison": f"{_BASE}, u as (select model, sum({tokens}) as tokens from e group by 1), m as (select model, p as provider, p || '/' || model as target from u, (values ('one'), ('two')) v(p) where model not like '%0'), r as (select *, length(target) / 1e6 as rate from m where provider = 'one' or model like 'v%') select m.provider, sum(case when rate is not null then 0.0 end) as actual, sum(u.tokens * rate) as other, (select count(*) from u) - count(rate) as excluded from m join u using (model) left join r on r.target = m.target group by 1",
        "RPT_09_codex_daily": source_queries.oracle_sql()["SRC_10_codex_logs"].replace("select model, count(*) as n, cast(sum(i)", "select strftime(cast(ts as timestamptz), '%Y-%m-%d') as period, model, cast(sum(i)").replace("where i + o > 0 group by 1", "where i + o > 0 group by 1, 2"),
        "SRT_07_cells": core_queries.oracle_sql()["AGG_13_quarter_hour_cells"].join(["select utc_date, bucket, machine, agent, model, row_number() over (order by utc_date, bucket, machine, agent, model) as place from (", ")"]),
        "PRJ_10_limit_reset": "select row_id, case when isApiErrorMessage and row_id > 0 then row_id * 7919 * 1000 end as reset_ms from chat",
    }

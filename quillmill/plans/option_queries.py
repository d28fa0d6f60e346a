"""Queries of options, sinks, sync writers and the smaller functions, with SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill import sinks
from quillmill.functions import usage as U
from quillmill.operators import lookups, summarize, sync
from quillmill.operators.redelivery import SPACES, bare
from quillmill.options import Options, bound, last_periods
from quillmill.plans import core_queries, reports, report_queries, source_queries
from quillmill.runtime import new_path, table, temporary
from quillmill.sources.jsonl_agents import raw_usage

_DAYS = "select l_shipdate, strftime(l_shipdate, '%Y-%m-%d') as day from lineitem"


def _days(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"))


def fil_03(spark, d):
    """Bounds in both writings."""
    return _days(spark, d).where(U.in_window(F.col("day"), bound("19970305"), bound("1997-04-01"))).groupBy("day").count().withColumnRenamed("count", "n")


def fil_04(spark, d):
    """The last periods up to 1998-05-20, by unit."""
    found = None
    for unit, n in (("day", 3), ("week", 2), ("month", 4)):
        since = last_periods(n, unit, date(1998, 5, 20), 1)
        part = _days(spark, d).where(U.in_window(F.col("day"), since, "1998-05-20")).groupBy("day").count().select(F.lit(unit).alias("unit"), "day", F.col("count").alias("n"))
        found = part if found is None else found.unionByName(part)
    return found


def prj_05(spark, d):
    """Names of projects from encoded paths that end in an id."""
    chat = table(spark, d, "chat").select("project", bare(F.col("sessionId")).alias("sessionId")).distinct()
    return chat.select("project", "sessionId", U.project_name(F.concat(F.lit("-Users-me-"), "project", F.coalesce(F.concat(F.lit("-"), "sessionId"), F.lit("")))).alias("name"))


def prj_09(spark, d):
    """Raw usage under three sets of names, with impossible shares and absent totals."""
    u, k = source_queries.usage(spark, d), F.col("row_id") % 3
    names = {"input_tokens": F.when(k == 0, F.col("i")), "prompt_tokens": F.when(k == 1, F.col("i")), "input": F.when(k == 2, F.col("i")), "cached_input_tokens": F.when(k == 0, F.col("c")), "cache_read_input_tokens": F.when(k == 1, F.col("c")), "cached_tokens": F.when(k == 2, F.col("c"))}
    names |= {"cache_write_input_tokens": F.when(k == 0, F.col("w")), "cache_creation_input_tokens": F.when(k > 0, F.col("w")), "output_tokens": F.when(k == 0, F.col("o")), "completion_tokens": F.when(k == 1, F.col("o")), "output": F.when(k == 2, F.col("o")), "reasoning_output_tokens": F.lit(1).cast("long"), "reasoning_tokens": F.lit(2).cast("long"), "total_tokens": F.when(k == 0, F.lit(0).cast("long")).when(k == 1, F.col("t"))}
    return u.withColumn("u", F.struct(*[v.alias(n) for n, v in names.items()])).select("row_id", raw_usage(F.col("u")).alias("r")).select("row_id", "r.*")


def prj_12(spark, d):
    found = reports.periods(report_queries.entries(spark, d), "daily", Options(zone=report_queries.ZONE))
    return summarize.totals(found).select(*summarize.COUNTERS, "rows")


def fn_s1(spark, d):
    return table(spark, d, "part").select("p_partkey", lookups.normal(F.concat("p_brand", F.lit(".V1@"), "p_type")).alias("name"))


def fn_h3(spark, d):
    cells = core_queries.quarter_cells(spark, d).withColumn("keys", F.array(F.col("messages").cast("string"), F.lit("k")))
    return sync.content_hash(cells)


def fil_09(spark, d):
    """Log lines with a null where none may be."""
    from quillmill.sources import jsonl_agents

    u = source_queries.usage(spark, d)
    usage = F.to_json(F.struct(F.lit(1).alias("input_tokens"), F.lit(2).alias("output_tokens")))
    null = F.when(F.col("row_id") % 4 == 0, F.lit(',"requestId":null')).when(F.col("row_id") % 4 == 1, F.lit(',"other":null')).otherwise(F.lit(""))
    line = F.concat(F.lit('{"timestamp":"'), "iso", F.lit('"'), null, F.lit(',"message":{"id":"r'), F.col("row_id").cast("string"), F.lit('","model":"m","usage":'), usage, F.lit("}}"))
    rows = u.select(line.alias("value"), F.concat(F.lit("c/projects/p/"), "s", F.lit(".jsonl")).alias("file_path"), F.col("row_id").alias("ord"))
    return jsonl_agents.claude(spark, rows).select("message_id", "session_id", "ts_ms")


def _placed(rows: DataFrame) -> DataFrame:
    """Rows numbered as they come."""
    return rows.withColumn("place", F.monotonically_increasing_id()).withColumn("place", F.row_number().over(Window.orderBy("place")))


def srt_01(spark, d):
    rows = reports.periods(report_queries.entries(spark, d), "daily", Options(zone=report_queries.ZONE, order="desc"), ["agent"])
    return _placed(rows.select("period", "agent"))


def srt_02(spark, d):
    costs = report_queries.entries(spark, d).withColumn("stored_cost", F.col("input_tokens").cast("double"))
    return _placed(reports.sessions(costs, keys=("agent", "session_id")).select("agent", "session_id"))


def srt_05(spark, d):
    return _placed(reports.block_report(report_queries.entries(spark, d)).select("start_ms"))


def srt_08(spark, d):
    return _placed(report_queries.rpt_07(spark, d).select("provider"))


def snk_01(spark, d):
    found = reports.periods(report_queries.entries(spark, d), "daily", Options(zone=report_queries.ZONE))
    return sinks.json_rows(found.select("period", "input_tokens", (F.col("output_tokens") / 2).alias("half")))


def _shards(spark, d):
    cells = core_queries.quarter_cells(spark, d).select("machine", "agent", "utc_date", "bucket", "model", "input_tokens", "output_tokens", "cost")
    path = new_path(spark, "shards")
    return cells, path


def syn_01(spark, d):
    """Applied twice, once with doubled counts for one machine: the last counts, other shards stay."""
    cells, path = _shards(spark, d)
    sync.apply_shards(cells, path)
    doubled = cells.where("machine = 'even'").withColumn("input_tokens", F.col("input_tokens") * 2)
    sync.apply_shards(doubled, path)
    sync.apply_shards(doubled, path)
    return spark.read.parquet(temporary(spark, path)).groupBy("machine", "agent").agg(F.sum("input_tokens").alias("input_tokens"), F.count(F.lit(1)).alias("cells"))


def syn_07(spark, d):
    """The index anew: the history of shards with an unchanged hash stays."""
    cells = core_queries.quarter_cells(spark, d).withColumn("keys", F.array(F.col("messages").cast("string")))
    old = sync.content_hash(cells.where("agent <> 'error'")).withColumn("late_edits", F.lit(3))
    return sync.repaired(cells, old).groupBy("machine", "agent").agg(F.sum("late_edits").cast("long").alias("late_edits"), F.count(F.lit(1)).alias("shards"))


def snk_10(spark, d):
    cells, path = _shards(spark, d)
    sync.write_rollups(cells, path)
    daily = spark.read.parquet(f"{temporary(spark, path)}/daily")
    return daily.select("period", "agent", "machine", "model", "tokens")


def agg_06(spark, d):
    """Partial sums of shards, merged: the sums of all."""
    e = report_queries.entries(spark, d).select("model", *summarize.COUNTERS)
    partial = e.repartition(7).groupBy(F.spark_partition_id().alias("part"), "model").agg(*[F.sum(c).alias(c) for c in summarize.COUNTERS])
    return partial.groupBy("model").agg(*[F.sum(c).alias(c) for c in summarize.COUNTERS])


def src_03(spark, d):
    """One project's folder of many, read by its path."""
    chat = table(spark, d, "chat").select(F.col("row_id").cast("string").alias("value"), F.coalesce(F.substring("project", 1, 1), F.lit("-")).alias("project"))
    path = new_path(spark, "src-projects")
    chat.repartition("project").write.partitionBy("project").text(path)
    from quillmill.sources.text import read_lines

    return read_lines(spark, f"{temporary(spark, path)}/project=a", "part-*").select(F.col("value").cast("long").alias("row_id"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "FIL_03_bounds": fil_03, "FIL_04_last_periods": fil_04, "FIL_09_null_fields": fil_09, "PRJ_05_project_names": prj_05, "PRJ_09_raw_usage": prj_09, "PRJ_12_totals": prj_12, "FN_S1_normal_names": fn_s1, "FN_H3_content_hash": fn_h3, "SRT_01_periods": srt_01, "SRT_02_sessions": srt_02,
        "SRT_05_blocks": srt_05, "SRT_08_comparison": srt_08, "SNK_01_json_rows": snk_01, "SYN_01_applied_twice": syn_01, "SYN_07_repaired": syn_07, "SNK_10_rollups": snk_10, "AGG_06_partial_sums": agg_06, "SRC_03_one_project": src_03,
    }


def oracle_sql() -> dict[str, str]:
    cells = core_queries.oracle_sql()["AGG_13_quarter_hour_cells"]
    row = "sha256(bucket || '|' || model || '|' || input_tokens || '|' || output_tokens || '|' || cast(cast(cost as hugeint) * 10000000 as varchar) || '|' || messages || '|' || {keys})"
    parts = lambda r: " || ',' || ".join(f"cast(sum(cast('0x' || substr(r, {1 + 15 * k}, 15) as hugeint)) as varchar)" for k in range(4))
    hashed = lambda keys, where="true": f"(select machine, agent, utc_date, sha256(cast(count(*) as varchar) || ',' || {parts('r')}) as hash from (select *, {row.format(keys=keys)} as r from ({cells}) where {where}) group by 1, 2, 3)"
    base, counts, tokens = report_queries._BASE, report_queries._SUMS, "input_tokens + output_tokens + cache_creation_tokens + cache_read_tokens"
    usage = source_queries.USAGE
    return {
        "FIL_03_bounds": f"select day, count(*) as n from ({_DAYS}) where day between '1997-03-05' and '1997-04-01' group by 1",
        "FIL_04_last_periods": f"select u.unit, day, count(*) as n from ({_DAYS}) x join (values ('day', '1998-05-18'), ('week', '1998-05-11'), ('month', '1998-02-01')) u(unit, since) on day between since and '1998-05-20' group by 1, 2",
        "FIL_09_null_fields": f"with {usage} select 'r' || row_id as message_id, s as session_id, ms as ts_ms from u where row_id % 4 <> 0",
        "PRJ_05_project_names": f"select distinct project, trim(sessionId, '{SPACES}') as sessionId, case when project is not null then project else 'unknown' end as name from chat",
        "PRJ_09_raw_usage": f"with {usage}, v as (select *, least(c, i) as cc, 1 as one from u) select row_id, i, cc as c, least(w, i - cc) as w, o, 1 as r, case when row_id % 3 = 1 and t > 0 then t else i + o end as t from v",
        "PRJ_12_totals": f"{base} select {counts}, count(distinct day) as rows from e",
        "FN_S1_normal_names": "select p_partkey, replace(replace(lower(p_brand || '.V1@' || p_type), '.', '-'), '@', '-') as name from part",
        "FN_H3_content_hash": f"select * from {hashed('cast(messages as varchar) || chr(44) || chr(107)')}",
        "SRT_01_periods": f"{base} select day as period, agent, row_number() over (order by day desc, agent) as place from (select distinct day, agent from e)",
        "SRT_02_sessions": f"{base}, g as (select agent, session_id, sum(input_tokens) as cost from e group by 1, 2 having sum({tokens}) > 0) select agent, session_id, row_number() over (order by cost desc, agent, session_id) as place from g",
        "SRT_05_blocks": report_queries.oracle_sql()["RPT_05_recent_blocks"].rpartition(" select k.start_ms, from_ms")[0] + " select start_ms, row_number() over (order by start_ms) as place from k",
        "SRT_08_comparison": f"select provider, row_number() over (order by other, provider) as place from ({report_queries.oracle_sql()['RPT_07_comparison']})",
        "SNK_01_json_rows": f"""{base}, g as (select day, sum(input_tokens) as i, sum(output_tokens) as o from e group by 1) select '{{"period":"' || day || '","input_tokens":' || cast(cast(i as bigint) as varchar) || ',"half":' || case when o % 2 = 0 then cast(cast(o // 2 as bigint) as varchar) else cast(cast(o // 2 as bigint) as varchar) || '.5' end || '}}' as value from g""",
        "SYN_01_applied_twice": f"select machine, agent, cast(sum(case when machine = 'even' then 2 else 1 end * input_tokens) as bigint) as input_tokens, count(*) as cells from ({cells}) group by 1, 2",
        "SYN_07_repaired": f"select machine, agent, cast(sum(case when agent <> 'error' then 3 else 0 end) as bigint) as late_edits, count(*) as shards from (select distinct machine, agent, utc_date from ({cells})) group by 1, 2",
        "SNK_10_rollups": f"select utc_date as period, agent, machine, model, cast(sum(input_tokens + output_tokens) as bigint) as tokens from ({cells}) group by grouping sets ((utc_date), (utc_date, agent), (utc_date, machine), (utc_date, model))",
        "AGG_06_partial_sums": f"{base} select model, {counts} from e group by 1",
        "SRC_03_one_project": "select row_id from chat where substr(project, 1, 1) = 'a'",
    }

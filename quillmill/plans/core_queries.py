"""Queries of the usage operators over the given tables, each with SQL for comparison where SQL can say it.

Usage entries are a view of the star schema: a line is an entry, its order the session, the customer the
project, the part's brand the model. events give activity of users.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.functions import usage as U
from quillmill.operators import blocks, compare, dedupe, deltas, lookups, summarize, sync
from quillmill.runtime import table

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

USAGE = """with usage as (select l_orderkey as session_id, o_custkey as project, p_brand as model, l_shipdate as ts, strftime(l_shipdate, '%Y-%m-%d') as day, epoch_ms(l_shipdate) as at_ms,
 cast(floor(l_quantity) as bigint) as input_tokens, cast(floor(l_extendedprice) as bigint) as output_tokens, l_suppkey as cache_read_tokens, l_partkey as cache_creation_tokens,
 cast(cast(l_extendedprice as decimal(15,2)) * cast(l_discount as decimal(15,2)) as decimal(18,4)) as cost, l_returnflag as agent, l_linestatus as machine, o_orderpriority as version, l_linenumber as line
 from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey) """
SUMS = "cast(sum(input_tokens) as bigint) as input_tokens, cast(sum(output_tokens) as bigint) as output_tokens, cast(sum(cache_creation_tokens) as bigint) as cache_creation_tokens, cast(sum(cache_read_tokens) as bigint) as cache_read_tokens"


def query(name: str, sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return register


def usage(spark: SparkSession, d: str) -> DataFrame:
    lines, orders, parts = (table(spark, d, t) for t in ("lineitem", "orders", "part"))
    money = "decimal(15,2)"
    return (
        lines.join(orders.select("o_orderkey", "o_custkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(parts.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("l_orderkey").alias("session_id"), F.col("o_custkey").alias("project"), F.col("p_brand").alias("model"), F.col("l_shipdate").alias("ts"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"), U.ntz_ms(F.col("l_shipdate")).alias("at"),
            F.floor("l_quantity").alias("input_tokens"), F.floor("l_extendedprice").alias("output_tokens"), F.col("l_suppkey").alias("cache_read_tokens"), F.col("l_partkey").alias("cache_creation_tokens"),
            (F.col("l_extendedprice").cast(money) * F.col("l_discount").cast(money)).cast("decimal(18,4)").alias("cost"), F.col("l_returnflag").alias("agent"), F.col("l_linestatus").alias("machine"), F.col("o_orderpriority").alias("version"), F.col("l_linenumber").alias("line"),
        )
    )


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("at", U.ntz_ms(F.col("ts")))


def _flat(summary: DataFrame) -> DataFrame:
    """A summary with its lists as text, so that results of engines compare."""
    row = F.transform("breakdown", lambda r: F.concat_ws(":", r["model"], r["input_tokens"].cast("string"), r["cost"].cast("string")))
    return summary.withColumns({"models": F.array_join("models", ","), "breakdown": F.array_join(row, ","), "cost": F.col("cost").cast("double")})


def _summary_sql(keys: str, order: str = "ts", start: str = USAGE, source: str = "usage") -> str:
    return f"""{start}, m as (select {keys}, model, {SUMS}, sum(cost) as cost, count(*) as entries, min({order}) as f from {source} group by {keys}, model)
    select {keys}, {SUMS}, cast(sum(input_tokens + output_tokens + cache_creation_tokens + cache_read_tokens) as bigint) as total_tokens, cast(sum(cost) as double) as cost, cast(sum(entries) as bigint) as entries,
    string_agg(model, ',' order by f, model) as models, string_agg(model || ':' || input_tokens || ':' || cost, ',' order by cost desc, f, model) as breakdown from m group by {keys}"""


# --- aggregation ------------------------------------------------------------------------------------------


@query("AGG_01_by_agent_and_machine", _summary_sql("agent, machine"))
def agg_01(spark, d):
    return _flat(summarize.summarize(usage(spark, d), ["agent", "machine"], F.col("ts")))


@query("AGG_02_daily", _summary_sql("day"))
def daily(spark, d):
    return _flat(summarize.summarize(usage(spark, d), ["day"], F.col("ts")))


@query("RPT_02_daily_by_project", _summary_sql("day, project", start=USAGE + ", u as (select * from usage where day between '1996-01-01' and '1996-12-31')", source="u"))
def daily_by_project(spark, d):
    kept = usage(spark, d).where(U.in_window(F.col("day"), "1996-01-01", "1996-12-31"))
    return _flat(summarize.summarize(kept, ["day", "project"], F.col("ts")))


@query(
    "AGG_03_sessions",
    f"""{USAGE} select session_id, project, {SUMS}, cast(sum(cost) as double) as cost, min(at_ms) as first_ms, max(at_ms) as last_ms, count(*) as entries, list_aggregate(list_sort(list_distinct(list(version))), 'string_agg', ',') as versions,
    arg_min(model, (-at_ms, model)) as last_model from usage group by session_id, project""",
)
def sessions(spark, d):
    return summarize.by_session(usage(spark, d), ["session_id", "project"], "at", ["model"]).withColumns({"versions": F.array_join("versions", ","), "cost": F.col("cost").cast("double")})


_WEEK = " union all ".join(f"select {k} as first_day, strftime(cast(ts as date) - cast((dayofweek(ts) - {k} + 7) % 7 as integer), '%Y-%m-%d') as week, {SUMS}, count(*) as entries from usage group by all" for k in range(7))


@query("AGG_04_weekly_any_start", f"{USAGE} {_WEEK}")
def weekly(spark, d):
    rows = usage(spark, d)
    out = None
    for k in range(7):
        part = rows.groupBy(F.lit(k).alias("first_day"), F.date_format(U.week_start(F.to_date("ts"), k), "yyyy-MM-dd").alias("week")).agg(*[F.sum(c).alias(c) for c in summarize.COUNTERS], F.count(F.lit(1)).alias("entries"))
        out = part if out is None else out.unionByName(part)
    return out


@query("AGG_04_monthly", _summary_sql("month", start=USAGE + ", u as (select *, substr(day, 1, 7) as month from usage)", source="u"))
def monthly(spark, d):
    return _flat(summarize.summarize(usage(spark, d).withColumn("month", F.substring("day", 1, 7)), ["month"], F.col("ts")))


@query(
    "AGG_05_conditional_buckets",
    f"""{USAGE} select day, model, cast(sum(case when output_tokens > 40000 then input_tokens + output_tokens else 0 end) as bigint) as long_tokens, cast(sum(case when output_tokens > 40000 then 0 else input_tokens + output_tokens end) as bigint) as short_tokens,
    cast(sum(case when agent = 'A' then input_tokens + output_tokens else 0 end) as bigint) as fast_tokens, cast(sum(case when agent = 'N' then input_tokens + output_tokens else 0 end) as bigint) as standard_tokens from usage group by day, model""",
)
def conditional_buckets(spark, d):
    tier = F.when(F.col("agent") == "A", "fast").when(F.col("agent") == "N", "standard").otherwise("none")
    return summarize.bucketed(usage(spark, d), ["day", "model"], F.col("output_tokens"), 40_000, tier)


@query(
    "AGG_07_across_agents",
    f"""{USAGE}, a as (select substr(day, 1, 7) as month, agent, {SUMS}, sum(cost) as cost, list_sort(list_distinct(list(model))) as models from usage group by 1, 2)
    select month, {SUMS}, cast(sum(cost) as double) as cost, string_agg(agent || ':' || input_tokens || ':' || len(models), ',' order by agent) as agents, list_aggregate(list_sort(list_distinct(flatten(list(models)))), 'string_agg', ',') as models from a group by month""",
)
def across_agents(spark, d):
    out = summarize.across_agents(usage(spark, d).withColumn("month", F.substring("day", 1, 7)), "month", "agent")
    text = F.transform("agents", lambda a: F.concat_ws(":", a["agent"], a["input_tokens"].cast("string"), F.size(a["models"]).cast("string")))
    return out.withColumns({"agents": F.array_join(text, ","), "models": F.array_join("models", ","), "cost": F.col("cost").cast("double")})


@query("AGG_08_totals", f"{USAGE} select {SUMS}, cast(sum(cost) as double) as cost, count(*) as rows from usage")
def totals(spark, d):
    return summarize.totals(usage(spark, d)).withColumn("cost", F.col("cost").cast("double"))


@query("AGG_11_by_model", f"{USAGE} select model, {SUMS}, cast(sum(cost) as double) as cost from usage group by model")
def by_model(spark, d):
    return summarize.by_model(usage(spark, d)).withColumn("cost", F.col("cost").cast("double"))


@query(
    "AGG_12_counterfactual",
    f"""{USAGE}, u as (select model, cast(sum(input_tokens) as bigint) as tokens, sum(cost) as cost from usage group by model),
    m as (select p_brand as model, s.provider, p_brand || s.provider as target from (select distinct p_brand from part) cross join (values ('a', 1), ('b', 2), ('c', 9)) s(provider, k) where cast(substr(p_brand, 7, 1) as int) % s.k = 0),
    r as (select target, cast(substr(target, 7, 1) as bigint) + 1 as rate from m where provider <> 'c' and length(target) = 8),
    j as (select m.provider, tokens, cost, rate from m left join u using (model) left join r using (target))
    select provider, cast(sum(case when rate is not null and tokens is not null then cost end) as double) as actual, cast(sum(tokens * rate) as bigint) as other, (select count(*) from u) - cast(sum(case when rate is not null and tokens is not null then 1 else 0 end) as bigint) as excluded from j group by provider""",
)
def counterfactual(spark, d):
    models = usage(spark, d).groupBy("model").agg(F.sum("input_tokens").alias("tokens"), F.sum("cost").alias("cost"))
    brands = table(spark, d, "part").select(F.col("p_brand").alias("model")).distinct()
    group = F.substring("model", 7, 1).cast("int")
    offered = F.filter(F.array(*[F.struct(F.lit(p).alias("provider"), F.lit(k).alias("k")) for p, k in (("a", 1), ("b", 2), ("c", 9))]), lambda s: group % s["k"] == 0)
    mapping = brands.select("model", F.explode(offered).alias("o")).select("model", "o.provider", F.concat("model", "o.provider").alias("target"))
    rates = mapping.where((F.col("provider") != "c") & (F.length("target") == 8)).select("target", (F.substring("target", 7, 1).cast("long") + 1).alias("rate"))
    return compare.counterfactual(models, mapping, rates).select("provider", F.col("actual").cast("double").alias("actual"), "other", "excluded")


def _folded(spark, d):
    e = events(spark, d)
    rows = e.select(F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("machine"), F.col("event_type").alias("agent"), "at", F.col("event_id").alias("ord"), F.concat(F.lit("m"), F.col("user_id") % 7).alias("model"), F.concat(F.lit("msg"), F.col("event_id") % 5000).alias("message_id"), F.lit(None).cast("string").alias("request_id"), F.col("user_id").cast("string").alias("session"), F.floor("value").alias("input_tokens"), F.floor(F.col("value") / 2).alias("output_tokens"), F.floor("value").cast("decimal(18,4)").alias("cost"))
    return sync.folded(rows, "salt")


_FOLDED = """with e as (select case when user_id % 2 = 0 then 'even' else 'odd' end as machine, event_type as agent, (epoch_us(ts) // 1000) as at_ms, event_id as ord, 'm' || (user_id % 7) as model, 'msg' || (event_id % 5000) as message_id, user_id as session,
 cast(floor(value) as bigint) as input_tokens, cast(floor(value / 2) as bigint) as output_tokens, strftime(ts, '%Y-%m-%d') as utc_date, cast(floor(((epoch_us(ts) // 1000) % 86400000) / 900000) as integer) as bucket from events),
 f as (select * from e qualify row_number() over (partition by machine, agent, utc_date, message_id order by ord) = 1) """


@query("AGG_13_quarter_hour_cells", _FOLDED + "select machine, agent, utc_date, bucket, model, cast(sum(input_tokens) as bigint) as input_tokens, cast(sum(output_tokens) as bigint) as output_tokens, cast(sum(input_tokens) as double) as cost, count(*) as messages, count(distinct message_id) as keys from f group by all")
def quarter_cells(spark, d):
    return sync.cells(_folded(spark, d)).withColumns({"keys": F.size("keys").cast("long"), "cost": F.col("cost").cast("double")})


@query("AGG_13_session_days", _FOLDED + "select machine, agent, utc_date, cast(session as varchar) as session, min(at_ms) as first_ms, max(at_ms) as last_ms, cast(sum(input_tokens) as double) as cost from f group by all")
def session_days(spark, d):
    return sync.session_days(_folded(spark, d)).withColumn("cost", F.col("cost").cast("double"))


@query(
    "AGG_14_rollups",
    f"""{USAGE}, c as (select strftime(ts, '%G-W%V') as period, agent, machine, model, input_tokens as tokens, cost from usage)
    select period, agent, machine, model, cast(sum(tokens) as bigint) as tokens, cast(sum(cost) as double) as cost from c group by grouping sets ((period), (period, agent), (period, machine), (period, model))""",
)
def rollups(spark, d):
    cells = usage(spark, d).withColumn("tokens", F.col("input_tokens"))
    return summarize.derived_rollups(cells, U.iso_week(F.to_date("ts"))).drop("level").withColumn("cost", F.col("cost").cast("double"))


@query("AGG_15_local_days", "select strftime(timezone('America/New_York', timezone('UTC', ts)), '%Y-%m-%d') as local_day, count(*) as n, cast(sum(floor(value)) as bigint) as tokens from events group by 1")
def local_days(spark, d):
    return events(spark, d).groupBy(U.local_date(F.col("at"), "America/New_York").alias("local_day")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor("value")).alias("tokens"))


@query("AGG_16_filtered_series", f"{USAGE} select day, model, {SUMS} from usage where agent in ('A', 'R') and machine = 'F' group by day, model")
def filtered_series(spark, d):
    return usage(spark, d).where(F.col("agent").isin("A", "R") & (F.col("machine") == "F")).groupBy("day", "model").agg(*[F.sum(c).alias(c) for c in summarize.COUNTERS])


@query("AGG_17_one_session", f"{USAGE} select {SUMS}, cast(sum(cost) as double) as cost, string_agg(at_ms || ':' || line || ':' || input_tokens, ',' order by at_ms, line, input_tokens, output_tokens) as entries from usage where session_id = 100 or project = 100")
def one_session(spark, d):
    rows = usage(spark, d).where((F.col("session_id") == 100) | (F.col("project") == 100))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("at", "line", "input_tokens", "output_tokens"))), lambda r: F.concat_ws(":", r["at"].cast("string"), r["line"].cast("string"), r["input_tokens"].cast("string")))
    return rows.agg(*[F.sum(c).alias(c) for c in summarize.COUNTERS], F.sum("cost").cast("double").alias("cost"), F.array_join(listed, ",").alias("entries"))


@query("AGG_18_distinct_sets", f"{USAGE} select agent, list_aggregate(list_sort(list_distinct(list(model))), 'string_agg', ',') as models, list_aggregate(list_sort(list_distinct(list(version))), 'string_agg', ',') as versions, count(distinct session_id) as sessions from usage group by agent")
def distinct_sets(spark, d):
    return usage(spark, d).groupBy("agent").agg(F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"), F.array_join(F.array_sort(F.collect_set("version")), ",").alias("versions"), F.countDistinct("session_id").alias("sessions"))


# --- windows ----------------------------------------------------------------------------------------------

BLOCKS = """with recursive t as (select user_id, (epoch_us(ts) // 1000) as at_ms, cast(floor(value) as bigint) as v, event_type, row_number() over (partition by user_id order by ts, event_id) as n from events),
 w as (select user_id, n, at_ms, v, event_type, at_ms - at_ms % 3600000 as start_ms from t where n = 1
 union all select t.user_id, t.n, t.at_ms, t.v, t.event_type, case when t.at_ms - w.start_ms > 18000000 or t.at_ms - w.at_ms > 18000000 then t.at_ms - t.at_ms % 3600000 else w.start_ms end from w join t on t.user_id = w.user_id and t.n = w.n + 1),
 b as (select cast(user_id as varchar) as key, start_ms, min(at_ms) as from_ms, max(at_ms) as to_ms, cast(sum(v) as bigint) as input_tokens, count(*) as entries, list_aggregate(list_sort(list_distinct(list(event_type))), 'string_agg', ',') as models from w group by user_id, start_ms) """
_NOW = 1_706_600_000_000


def _blocks(spark, d):
    rows = events(spark, d).select("user_id", "at", F.floor("value").alias("input_tokens"), *[F.lit(0).cast("long").alias(c) for c in summarize.COUNTERS[1:]], F.floor("value").cast("decimal(18,4)").alias("cost"), F.col("event_type").alias("model"))
    return blocks.blocks(rows, "at", 5.0, F.col("user_id"), _NOW)


@query("WIN_01_blocks", BLOCKS + f"select key, start_ms, start_ms + 18000000 as end_ms, from_ms, to_ms, ({_NOW} - to_ms < 18000000 and {_NOW} < start_ms + 18000000) as active, input_tokens, entries, models from b")
def win_01(spark, d):
    return _blocks(spark, d).select("key", "start_ms", "end_ms", "from_ms", "to_ms", "active", "input_tokens", "entries", F.array_join("models", ",").alias("models"))


@query("WIN_02_gaps", BLOCKS + ", p as (select key, lag(to_ms) over (partition by key order by start_ms, from_ms) as before, from_ms from b) select key, before + 18000000 as start_ms, from_ms as end_ms from p where from_ms - before > 18000000")
def win_02(spark, d):
    return blocks.gaps(_blocks(spark, d))


@query("WIN_04_burn_rate", BLOCKS + "select key, start_ms, input_tokens / nullif((to_ms - from_ms) / 60000.0, 0) as tokens_per_minute, input_tokens / nullif((to_ms - from_ms) / 60000.0, 0) * 60 as cost_per_hour from b")
def win_04(spark, d):
    return blocks.burn_rate(_blocks(spark, d)).select("key", "start_ms", "tokens_per_minute", "cost_per_hour")


@query("WIN_05_projection", BLOCKS + f""", r as (select key, start_ms, input_tokens, input_tokens / nullif((to_ms - from_ms) / 60000.0, 0) as rate, greatest((start_ms + 18000000 - {_NOW}) / 60000.0, 0.0) as left_ from b)
 select key, start_ms, cast(round(input_tokens + rate * left_) as bigint) as projected_tokens, round(input_tokens + rate * 60 / 60 * left_, 2) as projected_cost, cast(round(left_) as bigint) as minutes_left from r""")
def win_05(spark, d):
    return blocks.projection(blocks.burn_rate(_blocks(spark, d)), _NOW).select("key", "start_ms", "projected_tokens", "projected_cost", "minutes_left")


@query("WIN_06_limit_status", BLOCKS + "select key, start_ms, case when input_tokens > 200 then 'exceeds' when input_tokens > 160 then 'warning' else 'ok' end as status from b")
def win_06(spark, d):
    return _blocks(spark, d).select("key", "start_ms", blocks.limit_status(F.col("input_tokens"), F.lit(200)).alias("status"))


@query("AGG_10_largest_completed", BLOCKS + f"select max(input_tokens) as max_tokens from b where not ({_NOW} - to_ms < 18000000 and {_NOW} < start_ms + 18000000)")
def agg_10(spark, d):
    return blocks.largest_completed(_blocks(spark, d))


@query("FIL_12_recent_blocks", BLOCKS + f"select key, start_ms from b where start_ms >= {_NOW} - 3 * 86400000 or ({_NOW} - to_ms < 18000000 and {_NOW} < start_ms + 18000000)")
def fil_12(spark, d):
    return blocks.recent(_blocks(spark, d), _NOW).select("key", "start_ms")


@query("FIL_07_blocks_by_start_day", BLOCKS + "select key, start_ms from b where strftime(epoch_ms(start_ms), '%Y-%m-%d') between '2024-01-10' and '2024-01-12'")
def fil_07(spark, d):
    return _blocks(spark, d).where(U.in_window(U.local_date(F.col("start_ms")), "2024-01-10", "2024-01-12")).select("key", "start_ms")


@query("WIN_07_cumulative_delta", "select event_id, greatest(cast(floor(value) as bigint) - coalesce(lag(cast(floor(value) as bigint)) over (partition by user_id, event_type order by ts, event_id), 0), 0) as v_delta from events")
def win_07(spark, d):
    rows = events(spark, d).withColumn("v", F.floor("value"))
    return deltas.from_cumulative(rows, ["user_id", "event_type"], ["ts", "event_id"], ["v"]).select("event_id", "v_delta")


@query("WIN_08_last_or_delta", "with e as (select event_id, cast(floor(value) as bigint) as v, case when event_id % 3 = 0 then event_id % 50 end as l, coalesce(lag(cast(floor(value) as bigint)) over (partition by user_id order by ts, event_id), 0) as b from events) select event_id, case when v > b and l is not null then l else greatest(v - b, 0) end as used from e")
def win_08(spark, d):
    rows = events(spark, d).withColumns({"v": F.floor("value"), "l": F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 50)})
    return deltas.last_or_delta(rows, ["user_id"], ["ts", "event_id"], "v", "l").select("event_id", "used")


@query("WIN_09_calendar_windows", "select strftime(ts, '%Y-%m-%d') as day, cast(floor(((epoch_us(ts) // 1000) % 86400000) / 900000) as integer) as quarter, count(*) as n from events group by 1, 2")
def win_09(spark, d):
    return events(spark, d).groupBy(U.local_date(F.col("at")).alias("day"), U.quarter(F.col("at")).alias("quarter")).agg(F.count(F.lit(1)).alias("n"))


@query("STATE_01_tier_with_clear", "with e as (select *, case when event_type = 'error' then '!' when event_type in ('view', 'click') then event_type end as s from events), c as (select event_id, last_value(s ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as s from e) select event_id, nullif(s, '!') as state_tier from c")
def state_01(spark, d):
    kind = F.col("event_type")
    says = F.when(kind == "error", F.lit("\0")).when(kind.isin("view", "click"), kind)
    return deltas.carried(events(spark, d), ["user_id"], ["ts", "event_id"], {"state_tier": says}).select("event_id", "state_tier")


@query("STATE_03_carried_value", "select event_id, last_value(case when event_type = 'view' then value end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as carried from events")
def state_03(spark, d):
    return deltas.carried(events(spark, d), ["user_id"], ["ts", "event_id"], {"carried": F.when(F.col("event_type") == "view", F.col("value"))}).select("event_id", "carried")


# --- de-duplication ---------------------------------------------------------------------------------------

_ALL = "l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus"
_LINE = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


@query("DED_06_first_wins", f"select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity from lineitem qualify row_number() over (partition by l_orderkey, l_linenumber order by {_ALL}) = 1")
def ded_06(spark, d):
    lines = table(spark, d, "lineitem")
    return dedupe.keep_best(lines, [F.col("l_orderkey"), F.col("l_linenumber")], [F.col(c) for c in _LINE], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"])


@query("DED_07_last_wins", f"select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity from lineitem qualify row_number() over (partition by l_orderkey, l_linenumber order by {', '.join(c + ' desc' for c in _LINE)}) = 1")
def ded_07(spark, d):
    lines = table(spark, d, "lineitem")
    return dedupe.keep_last(lines, [F.col("l_orderkey"), F.col("l_linenumber")], [F.col(c) for c in _LINE], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"])


@query("DED_08_latest_snapshot", "select user_id, event_id, event_type, value from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def ded_08(spark, d):
    return dedupe.keep_last(events(spark, d), [F.col("user_id")], [F.col("ts"), F.col("event_id")], ["user_id", "event_id", "event_type", "value"])


@query("DED_02_preference", f"{USAGE} select session_id, line, model, input_tokens from usage qualify row_number() over (partition by session_id, line order by case when machine = 'F' then 1 else 0 end, -(input_tokens + output_tokens), at_ms, model, cache_read_tokens, cache_creation_tokens) = 1")
def ded_02(spark, d):
    order = [(F.col("machine") == "F").cast("int"), -(F.col("input_tokens") + F.col("output_tokens")), F.col("at"), F.col("model"), F.col("cache_read_tokens"), F.col("cache_creation_tokens")]
    return dedupe.keep_best(usage(spark, d), [F.col("session_id"), F.col("line")], order, ["session_id", "line", "model", "input_tokens"])


def chat_entries(spark, d) -> DataFrame:
    chat = table(spark, d, "chat")
    u = F.col("message.usage")
    tokens = U.counter(u["input_tokens"]) + U.counter(u["output_tokens"]) + U.counter(u["cache_creation_input_tokens"]) + U.counter(u["cache_read_input_tokens"])
    return chat.select(F.col("row_id").alias("ord"), F.col("message.id").alias("message_id"), F.col("requestId").alias("request_id"), F.col("sessionId").alias("session"), F.col("timestamp").alias("ts"), F.col("isSidechain").alias("is_sidechain"), tokens.alias("tokens"), u["speed"].alias("speed"), F.col("costUSD").alias("cost"))


@query("DED_01_entries")
def ded_01(spark, d):
    return dedupe.greedy_entries(chat_entries(spark, d)).select("ord", "place", "tokens")


@query("DED_03_daily_entries")
def ded_03(spark, d):
    return dedupe.greedy_entries(chat_entries(spark, d), daily=True).select("ord", "place", "tokens")


@query("DED_04_merged_tiers", "select l_orderkey, l_linenumber, case min(case l_returnflag when 'N' then 0 when 'A' then 1 else 2 end) when 0 then 'standard' when 1 then 'fast' end as tier, count(*) as copies from lineitem group by 1, 2")
def ded_04(spark, d):
    tier = F.when(F.col("l_returnflag") == "N", "standard").when(F.col("l_returnflag") == "A", "fast")
    return dedupe.merged_tiers(table(spark, d, "lineitem").withColumn("tier", tier), ["l_orderkey", "l_linenumber"], "tier")


@query("DED_05_event_key", "select user_id, event_type, cast(floor(value) as bigint) as v, count(*) as copies from events group by 1, 2, 3")
def ded_05(spark, d):
    return dedupe.merged_tiers(events(spark, d).withColumns({"v": F.floor("value"), "tier": F.lit("none")}), ["user_id", "event_type", "v"], "tier").drop("tier")


@query("DED_09_source_precedence", "select o_orderkey, o_orderstatus from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)")
def ded_09(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return dedupe.without(table(spark, d, "orders"), lines, ["o_orderkey"]).select("o_orderkey", "o_orderstatus")


@query(
    "DED_10_migration",
    """with e as (select event_id, user_id as session, case when event_id % 4 <> 0 then event_id % 1000 end as message_id, cast(floor(value) as bigint) as content_id from events), o as (select * from e where event_id % 2 = 0), n as (select * from e where event_id % 2 = 1 or event_id % 10 = 0)
    select event_id, 'new' as store from n union all select event_id, 'old' from o where not exists (select 1 from n where n.message_id is not null and n.session = o.session and n.message_id = o.message_id) and not exists (select 1 from n where n.message_id is null and n.session = o.session and n.content_id = o.content_id)""",
)
def ded_10(spark, d):
    e = events(spark, d).select("event_id", F.col("user_id").alias("session"), F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 1000).alias("message_id"), F.floor("value").alias("content_id"))
    old, new = e.where("event_id % 2 = 0").withColumn("store", F.lit("old")), e.where("event_id % 2 = 1 or event_id % 10 = 0").withColumn("store", F.lit("new"))
    return dedupe.migrated(old, new).select("event_id", "store")


@query(
    "DED_11_source_priority",
    """with e as (select event_id, user_id as trace, cast(floor(value) as bigint) as response, event_type from events),
    a as (select * from e where event_type = 'purchase'), b as (select * from e where event_type = 'signup' and trace not in (select trace from a) and response not in (select response from a)), ab as (select * from a union all select * from b),
    c as (select * from e where event_type = 'error' and trace not in (select trace from ab) and response not in (select response from ab)) select event_id from ab union all select event_id from c""",
)
def ded_11(spark, d):
    e = events(spark, d).select("event_id", F.col("user_id").alias("trace"), F.floor("value").alias("response"), "event_type")
    return dedupe.by_precedence([e.where(F.col("event_type") == t) for t in ("purchase", "signup", "error")], [["trace"], ["response"]]).select("event_id")


@query("DED_12_after_last_mark", "with m as (select user_id, max(ts) as mark from events where event_type = 'purchase' group by 1) select event_id from events left join m using (user_id) where event_type = 'view' and (mark is null or ts > mark)")
def ded_12(spark, d):
    e = events(spark, d)
    return dedupe.after_last(e.where("event_type = 'view'"), e.where("event_type = 'purchase'"), ["user_id"], "ts").select("event_id")


@query("DED_13_identities", """with recursive e as (select row_id as id, 'k1:' || spanId as key from trace where spanId is not null union all select row_id, 'k2:' || traceId from trace where name = 'chat' and traceId is not null),
 l as (select a.id, b.id as other from e a join (select key, min(id) as id from e group by 1) b on a.key = b.key), w as (select id, other from l union select other, id from l), r(id, root) as (select row_id, row_id from trace union select w.other, r.root from r join w on w.id = r.id), c as (select id, min(root) as component from r group by 1)
 select c.component, max(length(attributes)) as tokens, max(epoch_us(received_at)) as ts, arg_max(name, {'a': epoch_us(received_at), 'b': name}) filter (where name is not null) as model, count(*) as merged from c join trace on c.id = trace.row_id group by 1""")
def ded_13(spark, d):
    rows = table(spark, d, "trace").select(F.col("row_id").alias("id"), F.col("spanId").alias("k1"), F.when(F.col("name") == "chat", F.col("traceId")).alias("k2"), F.length("attributes").cast("long").alias("tokens"), F.unix_micros(F.col("received_at").cast("timestamp")).alias("ts"), F.col("name").alias("model"))
    return dedupe.merged_identities(rows, ["k1", "k2"], ["tokens"])


_REPLAY = """with e as (select event_id, user_id, user_id - user_id % 2 as parent, event_type, row_number() over (partition by user_id order by ts, event_id) as n from events),
 j as (select c.event_id, c.user_id, c.n, coalesce(c.event_type = p.event_type, false) as same from e c left join e p on p.user_id = c.parent and p.n = c.n where c.user_id % 2 = 1), w as (select *, min(case when same then 1 else 0 end) over (partition by user_id order by n rows between unbounded preceding and current row) as lead from j) select event_id from w where lead = 0"""


@query("DED_15_replay", _REPLAY)
def ded_15(spark, d):
    e = events(spark, d).withColumn("parent", F.col("user_id") - F.col("user_id") % 2)
    return dedupe.without_replay(e.where("user_id % 2 = 1"), e.where("user_id % 2 = 0").drop("parent"), "user_id", "parent", ["ts", "event_id"], ["event_type"]).select("event_id")


@query("DED_15_burst", "with s as (select event_id, user_id, coalesce((epoch_us(ts) // 1000) - lag((epoch_us(ts) // 1000)) over (partition by user_id order by ts), 0) > 7200000 as calm, ts from events), c as (select *, max(case when calm then 1 else 0 end) over (partition by user_id order by ts rows between unbounded preceding and current row) as c from s), l as (select user_id, sum(1 - c) as lead from c group by 1) select event_id from c join l using (user_id) where c = 1 or lead < 2")
def ded_15_burst(spark, d):
    return dedupe.without_burst(events(spark, d), "user_id", "at", 7_200_000).select("event_id")


@query("DED_16_tree_replay", _REPLAY.replace("c.event_type = p.event_type", "c.event_type = p.event_type and c.n <= 3"))
def ded_16(spark, d):
    e = events(spark, d).withColumns({"parent": F.col("user_id") - F.col("user_id") % 2, "n": F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))})
    fork = e.where("user_id % 2 = 0 and n <= 3").drop("parent")
    return dedupe.without_replay(e.where("user_id % 2 = 1"), fork, "user_id", "parent", ["ts", "event_id"], ["event_type"]).select("event_id")


@query("DED_17_fold", _FOLDED + "select machine, agent, utc_date, ord, bucket from f")
def ded_17(spark, d):
    return _folded(spark, d).select("machine", "agent", "utc_date", "ord", "bucket")


@query(
    "DED_18_claimed_cells",
    """with k as (select distinct strftime(ts, '%Y-%m-%d') as date, event_type as agent, cast(floor(((epoch_us(ts) // 1000) % 86400000) / 900000) as integer) as bucket, 'm' as model, 's' as salt, m.machine, event_id % 3000 as key from events join (values ('a', 0), ('b', 1), ('c', 2)) m(machine, r) on event_id % (r + 2) <> 0 or event_id % 5 = r),
    o as (select *, min(machine) over (partition by date, agent, bucket, model, salt, key) as owner from k), s as (select date, agent, bucket, machine, count(*) as keys, sum(case when machine > owner then 1 else 0 end) as claimed from o group by all)
    select date, agent, bucket, machine, keys, cast(claimed as bigint) as claimed, case when claimed = keys then 'suppressed' when claimed > 0 then 'duplicateSuspected:' || cast(floor(claimed * 100 / keys) as bigint) || '%' else 'kept' end as verdict from s""",
)
def ded_18(spark, d):
    e = events(spark, d)
    held = F.filter(F.array(*[F.struct(F.lit(m).alias("machine"), F.lit(r).alias("r")) for m, r in (("a", 0), ("b", 1), ("c", 2))]), lambda m: (F.col("event_id") % (m["r"] + 2) != 0) | (F.col("event_id") % 5 == m["r"]))
    keys = e.select(U.local_date(F.col("at")).alias("date"), F.col("event_type").alias("agent"), U.quarter(F.col("at")).alias("bucket"), F.lit("m").alias("model"), F.lit("s").alias("salt"), F.explode(held).alias("m"), (F.col("event_id") % 3000).alias("key")).withColumn("machine", F.col("m.machine")).drop("m")
    return dedupe.claimed_cells(keys).select("date", "agent", "bucket", "machine", "keys", "claimed", "verdict")


# --- joins ------------------------------------------------------------------------------------------------


@query("JOIN_01_entry_price", f"{USAGE}, r as (select p_brand as model, min(p_size) as rate from part group by 1) select agent, cast(sum(input_tokens * rate) as bigint) as cost from usage left join r using (model) group by agent")
def join_01(spark, d):
    rates = table(spark, d, "part").groupBy(F.col("p_brand").alias("model")).agg(F.min("p_size").alias("rate"))
    return lookups.resolved(usage(spark, d), "model", rates).groupBy("agent").agg(F.sum(F.col("input_tokens") * F.col("rate")).alias("cost"))


@query("JOIN_03_bounded_match")
def join_03(spark, d):
    names = table(spark, d, "chat").select(F.col("message.model").alias("model"))
    keys = table(spark, d, "model_usage").select(F.col("model_id").alias("key"), F.lit(False).alias("exact")).where("key is not null").distinct()
    return lookups.fuzzy(names, "model", keys, "key")


_PRICES = "select p_brand as model, date_trunc('month', l_shipdate) as since, max(l_partkey) as price from lineitem join part on l_partkey = p_partkey where month(l_shipdate) in (2, 7) group by 1, 2"


@query("JOIN_05_as_of", f"{USAGE}, p as ({_PRICES}) select u.agent, u.model, cast(sum(p.price) as bigint) as paid, count(p.price) as priced, count(*) as n from usage u asof left join p on u.model = p.model and u.ts >= p.since group by 1, 2")
def join_05(spark, d):
    rows = usage(spark, d)
    prices = rows.where(F.month("ts").isin(2, 7)).groupBy("model", F.trunc("ts", "month").cast("timestamp_ntz").alias("since")).agg(F.max("cache_creation_tokens").alias("price"))
    return lookups.as_of(rows, prices, "model", "ts", "since", ["price"]).groupBy("agent", "model").agg(F.sum("price").alias("paid"), F.count("price").alias("priced"), F.count(F.lit(1)).alias("n"))


@query(
    "JOIN_06_first_candidate",
    "with c as (select distinct p_brand, p_type, unnest([p_type, p_brand, 'any']) as name, unnest([0, 1, 2]) as pos from part), t as (select p_type as name, max(p_size) as v from part where p_size > 20 group by 1 having max(p_size) % 2 = 0 union all select p_brand, max(p_size) from part group by 1 having max(p_size) % 5 = 0 union all select 'any', 1) select p_brand, p_type, arg_min(name, pos) as name, arg_min(v, pos) as v from c join t using (name) group by 1, 2",
)
def join_06(spark, d):
    parts = table(spark, d, "part")
    by_type = parts.where("p_size > 20").groupBy(F.col("p_type").alias("name")).agg(F.max("p_size").alias("v")).where("v % 2 = 0")
    by_brand = parts.groupBy(F.col("p_brand").alias("name")).agg(F.max("p_size").alias("v")).where("v % 5 = 0")
    known = by_type.unionByName(by_brand).unionByName(spark.range(1).select(F.lit("any").alias("name"), F.lit(1).alias("v")))
    return lookups.first_candidate(parts, ["p_brand", "p_type"], F.array("p_type", "p_brand", F.lit("any")), known, "name", ["v"])


@query("JOIN_07_strongest_claim", "select p_brand, p_partkey, p_size, p_retailprice from part qualify row_number() over (partition by p_brand order by p_size desc, p_retailprice desc, p_partkey desc) = 1")
def join_07(spark, d):
    parts = table(spark, d, "part").select("p_brand", "p_partkey", "p_size", "p_retailprice")
    return lookups.strongest_claim(parts, "p_brand", [F.col("p_size"), F.col("p_retailprice"), F.col("p_partkey")])


@query("JOIN_08_graft", "with a as (select s_suppkey as k, case when s_suppkey % 3 = 0 then s_nationkey end as x, case when s_suppkey % 5 = 0 then s_nationkey end as y from supplier), b as (select c_custkey as k, c_nationkey as x, c_nationkey + 1 as y from customer) select a.k, case when a.x is null and a.y is null then b.x else a.x end as x, case when a.x is null and a.y is null then b.y else a.y end as y from a left join b using (k)")
def join_08(spark, d):
    a = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.when(F.col("s_suppkey") % 3 == 0, F.col("s_nationkey")).alias("x"), F.when(F.col("s_suppkey") % 5 == 0, F.col("s_nationkey")).alias("y"))
    b = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("x"), (F.col("c_nationkey") + 1).alias("y"))
    return lookups.grafted(a, b, "k", ["x", "y"])


@query("JOIN_09_override", "with o as (select c_custkey as k, case when c_custkey % 2 = 0 then c_nationkey end as x from customer) select s_suppkey as k, coalesce(o.x, s_nationkey) as x from supplier left join o on o.k = s_suppkey")
def join_09(spark, d):
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("x"))
    other = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey")).alias("x"))
    return lookups.overridden(rows, other, "k", ["x"])


@query("JOIN_10_ledger_messages", "select o_orderkey, count(l_orderkey) as n, cast(sum(l_suppkey) as bigint) as cached from orders left join lineitem on l_orderkey = o_orderkey group by 1")
def join_10(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_suppkey").alias("cached"))
    return table(spark, d, "orders").select("o_orderkey").join(lines, "o_orderkey", "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query("JOIN_11_usage_session", "select m.row_id, s.source, s.model from model_usage m left join (select id, min(source) as source, min(model) as model from sessions group by id) s on s.id = 'ses_' || substr(m.session_id, 4)")
def join_11(spark, d):
    sessions_by_id = table(spark, d, "sessions").groupBy("id").agg(F.min("source").alias("source"), F.min("model").alias("model"))
    return table(spark, d, "model_usage").select("row_id", F.concat(F.lit("ses_"), F.substring("session_id", 4, 100)).alias("id")).join(sessions_by_id, "id", "left").select("row_id", "source", "model")


@query("JOIN_12_trace_context", "with b as (select traceId, arg_min(json_extract_string(attributes, '$.\"gen_ai.request.model\"'), (case name when 'chat' then 0 when 'inference' then 1 else 2 end, row_id)) filter (json_extract_string(attributes, '$.\"gen_ai.request.model\"') is not null) as m from trace where traceId is not null group by 1) select row_id, coalesce(json_extract_string(attributes, '$.\"gen_ai.request.model\"'), m) as model from trace left join b using (traceId)")
def join_12(spark, d):
    spans = table(spark, d, "trace").select("row_id", "traceId", F.get_json_object("attributes", "$['gen_ai.request.model']").alias("model"), F.when(F.col("name") == "chat", 0).when(F.col("name") == "inference", 1).otherwise(2).alias("priority"))
    return lookups.trace_context(spans, "traceId", "model", "priority", "row_id").select("row_id", "model")


@query("JOIN_13_parent_session", "select c.o_orderkey, p.o_orderkey as parent from orders c join orders p on p.o_orderkey = c.o_orderkey // 2 where c.o_orderstatus = 'F'")
def join_13(spark, d):
    orders = table(spark, d, "orders")
    parents = orders.select(F.col("o_orderkey").alias("parent"))
    return orders.where("o_orderstatus = 'F'").withColumn("parent", F.expr("o_orderkey div 2")).join(parents, "parent").select("o_orderkey", "parent")


_PATTERNS = "select pattern, dense_rank() over (order by pattern) as ordinal from (select distinct split_part(model_id, '-', 1) as pattern from model_usage union select distinct split_part(model_id, '-', 1) || '-' || split_part(model_id, '-', 2) from model_usage) where pattern <> ''"


@query("JOIN_14_longest_pattern", f"with p as ({_PATTERNS}), n as (select distinct message.model as model from chat where message.model is not null) select model, pattern from n join p on contains(lower(model), lower(pattern)) qualify row_number() over (partition by model order by length(pattern) desc, ordinal desc) = 1")
def join_14(spark, d):
    """Model names of all chat rows against the families that the usage table has."""
    parts = F.split("model_id", "-")
    known = table(spark, d, "model_usage").where("model_id is not null").select("model_id").distinct()
    patterns = known.select(F.explode(F.array(parts[0], F.concat_ws("-", parts[0], F.coalesce(F.get(parts, F.lit(1)), F.lit(""))))).alias("pattern")).where("pattern <> ''").distinct()
    ranked = patterns.withColumn("ordinal", F.dense_rank().over(Window.orderBy("pattern")))  # the distinct families
    return lookups.longest_pattern(table(spark, d, "chat").select(F.col("message.model").alias("model")), "model", ranked).select("model", "pattern")


_INDEX = "select l_linestatus as machine, l_returnflag as agent, strftime(l_shipdate, '%Y-%m-%d') as utc_date, cast(sum(l_partkey) % 97 as bigint) as hash from lineitem group by 1, 2, 3"


def _index(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_linestatus").alias("machine"), F.col("l_returnflag").alias("agent"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("utc_date")).agg((F.sum("l_partkey") % 97).alias("hash"))


@query("JOIN_15_changed_shards", f"with i as ({_INDEX}) select machine, agent, utc_date from i where not exists (select 1 from i a where a.machine = i.machine and a.agent = i.agent and a.utc_date = i.utc_date and (case when a.hash % 4 = 0 then a.hash + 1 else a.hash end) = i.hash)")
def join_15(spark, d):
    index = _index(spark, d)
    applied = index.withColumn("hash", F.when(F.col("hash") % 4 == 0, F.col("hash") + 1).otherwise(F.col("hash")))
    return sync.changed(index, applied).select(*sync.SHARD)


@query("JOIN_16_stale_shards", f"with i as ({_INDEX}) select machine, agent, utc_date, hash from i where exists (select 1 from i a where a.machine = i.machine and a.agent = i.agent and a.utc_date = i.utc_date and a.hash % 3 <> 0)")
def join_16(spark, d):
    index = _index(spark, d)
    return sync.live(index, index.where("hash % 3 <> 0"))


@query("JOIN_17_semi_and_anti", "select c_custkey, exists (select 1 from orders where o_custkey = c_custkey) as active from customer")
def join_17(spark, d):
    customers, orders = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    on = customers.join(orders, "c_custkey", "left_semi").withColumn("active", F.lit(True))
    return on.unionByName(dedupe.without(customers, orders, ["c_custkey"]).withColumn("active", F.lit(False)))


# --- functions and filters --------------------------------------------------------------------------------


@query("FN_D_calendar", "select distinct strftime(l_shipdate, '%Y-%m-%d') as day, strftime(l_shipdate, '%G-W%V') as iso_week, strftime(cast(l_shipdate as date) - cast((dayofweek(l_shipdate) + 6) % 7 as integer), '%Y-%m-%d') as monday, strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S.') || '000Z' as text, 1000000000000 - (epoch_ms(l_shipdate) + 86400000) > 48 * 3600000 as final from lineitem")
def fn_d(spark, d):
    at, day = U.ntz_ms(F.col("l_shipdate")), F.to_date("l_shipdate")
    return table(spark, d, "lineitem").select(U.local_date(at).alias("day"), U.iso_week(day).alias("iso_week"), F.date_format(U.week_start(day, 1), "yyyy-MM-dd").alias("monday"), U.rfc3339(at).alias("text"), U.finalised(day, F.lit(1_000_000_000_000)).alias("final")).distinct()


@query("FN_D1_iso_text", r"select row_id, case when regexp_full_match(timestamp, '\d{4}-\d\d-\d\dT\d\d:\d\d:[0-5]\d(\.\d{3})?(Z|[+-]\d\d:\d\d)') then epoch_ms(cast(timestamp as timestamptz)) end as at from chat")
def fn_d1(spark, d):
    return table(spark, d, "chat").select("row_id", U.iso_ms(F.col("timestamp")).alias("at"))


@query("FN_D4_hour_and_peak", "select event_id, (epoch_us(ts) // 1000) - (epoch_us(ts) // 1000) % 3600000 as hour_ms, dayofweek(ts) between 1 and 5 and (hour(ts) in (1, 2, 3) or hour(ts) between 6 and 9) as peak from events")
def fn_d4(spark, d):
    return events(spark, d).select("event_id", U.floor_hour(F.col("at")).alias("hour_ms"), U.peak(F.col("at")).alias("peak"))


@query("FN_H1_salted_keys", "select event_id, substr(sha256('4:salt;' || length(cast(user_id as varchar)) || ':' || user_id || ';' || coalesce(length(nullif(event_type, 'view')) || ':' || nullif(event_type, 'view') || ';', '-;')), 1, 16) as key from events")
def fn_h1(spark, d):
    return events(spark, d).select("event_id", U.salted_key("salt", F.col("user_id"), F.nullif(F.col("event_type"), F.lit("view"))).alias("key"))


@query("FN_H2_project_hash", "select distinct project, 'sha256:' || substr(sha256('4:salt;' || coalesce(length(project) || ':' || project || ';', '-;')), 1, 32) as hash from chat")
def fn_h2(spark, d):
    return table(spark, d, "chat").select("project", U.project_hash("salt", F.col("project")).alias("hash")).distinct()


@query("FN_J1_json", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def fn_j1(spark, d):
    return events(spark, d).select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("FN_A1_arrays", "select user_id, len(list_distinct(list(event_type))) as kinds, list_contains(list(event_type), 'error') as failed, len(list_intersect(list_distinct(list(event_type)), ['view', 'click'])) as shared from events group by 1")
def fn_a1(spark, d):
    kinds = F.collect_set("event_type")
    return events(spark, d).groupBy("user_id").agg(F.size(kinds).cast("long").alias("kinds"), F.array_contains(kinds, "error").alias("failed"), F.size(F.array_intersect(kinds, F.array(F.lit("view"), F.lit("click")))).cast("long").alias("shared"))


@query("FN_S2_display", "select project, format('{:,}', n) as n, '$' || printf('%.2f', n / 4) as cost from (select project, count(*) as n from chat group by 1)")
def fn_s2(spark, d):
    counted = table(spark, d, "chat").groupBy("project").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("project", U.thousands(F.col("n")).alias("n"), U.money(F.col("n") / 4).alias("cost"))


@query("FN_M1_rounding", "select event_id, cast(round((epoch_us(ts) // 1000) / 1000.0) as bigint) as s from events")
def fn_m1(spark, d):
    return events(spark, d).select("event_id", U.half_away(F.col("at") / 1000).cast("long").alias("s"))


@query("FIL_01_date_window", f"{USAGE} select session_id, line, day from usage where day between '1997-03-05' and '1997-04-01'")
def fil_01(spark, d):
    return usage(spark, d).where(U.in_window(F.col("day"), "1997-03-05", "19970401")).select("session_id", "line", "day")


@query("FIL_02_zone_bounds", "select event_id from events where timezone('UTC', ts) >= timezone('Europe/Berlin', timestamp '2024-01-10') and timezone('UTC', ts) < timezone('Europe/Berlin', timestamp '2024-01-13')")
def fil_02(spark, d):
    a, b = U.day_bounds("2024-01-10", "2024-01-12", "Europe/Berlin")
    return events(spark, d).where((F.col("at") >= a) & (F.col("at") < b)).select("event_id")


@query("FIL_05_summary_filter", f"{USAGE} select day, {SUMS} from usage group by day having day >= '2000-01-01'")
def fil_05(spark, d):
    return usage(spark, d).groupBy("day").agg(*[F.sum(c).alias(c) for c in summarize.COUNTERS]).where(U.in_window(F.col("day"), "2000-01-01", None)).orderBy("day")


@query("FIL_06_last_activity", f"{USAGE} select session_id from usage group by session_id having replace(strftime(max(ts), '%Y-%m-%dT%H:%M:%S.000Z'), '-', '') between '19970101' and '19970301'")
def fil_06(spark, d):
    last = U.rfc3339(F.max("at"))
    return usage(spark, d).groupBy("session_id").agg(last.alias("last")).where(F.replace("last", F.lit("-"), F.lit("")).between("19970101", "19970301")).select("session_id")


@query("FIL_08_validity", r"select row_id from chat where (version is null or regexp_matches(version, '^[0-9]+\.[0-9]+\.[0-9]')) and coalesce(sessionId, '?') <> '' and coalesce(requestId, '?') <> '' and coalesce(message.id, '?') <> '' and coalesce(message.model, '?') <> ''")
def fil_08(spark, d):
    keep = U.valid_version(F.col("version")) & U.not_empty(F.col("sessionId"), F.col("requestId"), F.col("message.id"), F.col("message.model"))
    return table(spark, d, "chat").where(keep).select("row_id")


@query("FIL_10_zero_usage", "select row_id from sessions where coalesce(input_tokens, 0) + coalesce(output_tokens, 0) + coalesce(cache_read_tokens, 0) + coalesce(cache_write_tokens, 0) > 0")
def fil_10(spark, d):
    tokens = sum((U.counter(F.col(c)) for c in ("output_tokens", "cache_read_tokens", "cache_write_tokens")), U.counter(F.col("input_tokens")))
    return table(spark, d, "sessions").where(tokens > 0).select("row_id")


@query("FIL_11_session_id", "select file_id from log_files where regexp_extract(path, '([0-9a-f]{8})-', 1) in (select min(regexp_extract(path, '([0-9a-f]{8})-', 1)) from log_files)")
def fil_11(spark, d):
    files = table(spark, d, "log_files").select("file_id", F.regexp_extract("path", "([0-9a-f]{8})-", 1).alias("s"))
    return files.join(files.agg(F.min("s").alias("s")), "s", "left_semi").select("file_id")


@query("PRJ_01_paths", r"select file_id, coalesce(nullif(trim(regexp_extract(path, '(?:^|/)projects/([^/]+)/', 1)), ''), 'unknown') as project, case when path like 'projects/%/subagents/%' then regexp_extract(path, '([^/]+)/subagents/', 1) when len(string_split(path, '/')) > 3 then regexp_extract(path, '([^/]+)/[^/]+$', 1) else regexp_replace(regexp_extract(path, '([^/]+)$', 1), '\.jsonl$', '') end as session from log_files where path like 'projects/%'")
def prj_01(spark, d):
    return table(spark, d, "log_files").where(F.col("path").startswith("projects/")).select("file_id", U.project_of(F.col("path")).alias("project"), U.session_of(F.col("path")).alias("session"))


@query("PRJ_03_labels", "select row_id, case when message.model is null or regexp_full_match(message.model, '<.*>') then null when message.usage.speed = 'fast' then message.model || '-fast' else message.model end as label, regexp_replace(message.model, '-[0-9]{8}$', '') as short from chat")
def prj_03(spark, d):
    return table(spark, d, "chat").select("row_id", U.model_label(F.col("message.model"), F.col("message.usage.speed")).alias("label"), U.short_model(F.col("message.model")).alias("short"))


@query("PRJ_04_aliases", "select row_id, case model_id when 'quillon-4' then 'q4' when 'tessel-70' then 't70' else model_id end as model from model_usage")
def prj_04(spark, d):
    return table(spark, d, "model_usage").select("row_id", U.aliased(F.col("model_id"), {"quillon-4": "q4", "tessel-70": "t70"}).alias("model"))


@query("PRJ_07_total_fallback", "with m as (select row_id, greatest(coalesce(output_tokens, 0), 0) as o, greatest(greatest(coalesce(computed_total_tokens, 0), 0) - (greatest(coalesce(input_tokens, 0), 0) + greatest(coalesce(output_tokens, 0), 0)), 0) as miss from model_usage) select row_id, case when o = 0 then miss else o end as output, case when o = 0 then 0 else miss end as extra from m")
def prj_07(spark, d):
    o = U.counter(F.col("output_tokens"))
    output, extra = U.total_fallback(F.col("computed_total_tokens"), U.counter(F.col("input_tokens")) + o, o)
    return table(spark, d, "model_usage").select("row_id", output.alias("output"), extra.alias("extra"))


@query("PRJ_08_split_cached", "with m as (select row_id, greatest(coalesce(input_tokens, 0), 0) as i, greatest(coalesce(cache_read_input_tokens, 0), 0) as c, greatest(coalesce(cache_creation_input_tokens, 0), 0) as w from model_usage) select row_id, greatest(i - least(c, i) - w, 0) as fresh, least(c, i) as cached from m")
def prj_08(spark, d):
    fresh, cached = U.split_cached(F.col("input_tokens"), F.col("cache_read_input_tokens"), F.col("cache_creation_input_tokens"))
    return table(spark, d, "model_usage").select("row_id", fresh.alias("fresh"), cached.alias("cached"))


@query("PRJ_11_advisors", "with e as (select row_id, message.id as id, unnest(message.usage.iterations) as e, generate_subscripts(message.usage.iterations, 1) as p from chat) select row_id, id || ':advisor:' || (row_number() over (partition by row_id order by p) - 1) as entry, e.model as model, e.input_tokens as input_tokens from e where e.type = 'advisor_message'")
def prj_11(spark, d):
    advisors = F.filter("message.usage.iterations", lambda e: e["type"] == "advisor_message")
    rows = table(spark, d, "chat").select("row_id", F.col("message.id").alias("id"), F.posexplode(advisors).alias("i", "e"))
    return rows.select("row_id", F.concat("id", F.lit(":advisor:"), F.col("i")).alias("entry"), F.col("e.model").alias("model"), F.col("e.input_tokens").alias("input_tokens"))


@query("PRJ_split_cache_writes", "select row_id, case when message.usage.cache_creation is not null then coalesce(message.usage.cache_creation.ephemeral_5m_input_tokens, 0) + coalesce(message.usage.cache_creation.ephemeral_1h_input_tokens, 0) else coalesce(message.usage.cache_creation_input_tokens, 0) end as written from chat")
def prj_cc(spark, d):
    u = F.col("message.usage")
    split = u["cache_creation"]
    return table(spark, d, "chat").select("row_id", U.cache_creation(u["cache_creation_input_tokens"], split["ephemeral_5m_input_tokens"], split["ephemeral_1h_input_tokens"], split.isNotNull()).alias("written"))


@query("PRC_02_marginal_tier", f"{USAGE} select session_id, cast(sum(least(output_tokens, 50000) * 3 + greatest(output_tokens - 50000, 0) * 5) as bigint) as cost from usage group by session_id")
def prc_02(spark, d):
    return usage(spark, d).groupBy("session_id").agg(F.sum(U.marginal(F.col("output_tokens"), F.lit(3), F.lit(5), 50_000)).alias("cost"))


@query("PRC_03_whole_request_tier", f"{USAGE} select session_id, cast(sum(output_tokens * case when input_tokens + cache_read_tokens > 60 then 5 else 3 end) as bigint) as cost from usage group by session_id")
def prc_03(spark, d):
    return usage(spark, d).groupBy("session_id").agg(F.sum(U.whole_request(F.col("output_tokens"), F.col("input_tokens") + F.col("cache_read_tokens"), F.lit(3), F.lit(5), F.lit(60))).alias("cost"))


# --- order, sets, sync ------------------------------------------------------------------------------------


@query("SRT_03_sessions_by_cost", f"{USAGE} select agent, session_id, cast(sum(cost) as double) as cost from usage group by 1, 2")
def srt_03(spark, d):
    found = usage(spark, d).groupBy("agent", "session_id").agg(F.sum("cost").cast("double").alias("cost"))
    return found.orderBy(F.desc("cost"), "session_id", "agent")


@query("SET_01_union", "select 'sessions' as agent, id, input_tokens from sessions union all select 'model_usage', id, input_tokens from model_usage")
def set_01(spark, d):
    a, b = (table(spark, d, t).select(F.lit(t).alias("agent"), "id", "input_tokens") for t in ("sessions", "model_usage"))
    return a.unionByName(b)


@query("SET_02_difference_and_overlap", "select user_id, 'both' as part from (select user_id from events where event_type = 'purchase' intersect select user_id from events where event_type = 'error') union all select user_id, 'only' from (select user_id from events where event_type = 'purchase' except select user_id from events where event_type = 'error')")
def set_02(spark, d):
    e = events(spark, d)
    a, b = (e.where(F.col("event_type") == t).select("user_id").distinct() for t in ("purchase", "error"))
    return a.join(b, "user_id", "left_semi").withColumn("part", F.lit("both")).unionByName(a.join(b, "user_id", "left_anti").withColumn("part", F.lit("only")))


@query("SET_03_sections", f"{USAGE} select 'daily' as section, day as period, cast(sum(input_tokens) as bigint) as tokens from usage group by 2 union all select 'monthly', substr(day, 1, 7), cast(sum(input_tokens) as bigint) from usage group by 2")
def set_03(spark, d):
    # One scan serves both sections: the day's sums are expanded to both periods before the shuffle.
    periods = F.array(F.struct(F.lit("daily").alias("section"), F.col("day").alias("period")), F.struct(F.lit("monthly").alias("section"), F.substring("day", 1, 7).alias("period")))
    by_day = usage(spark, d).groupBy("day").agg(F.sum("input_tokens").alias("t"))
    return by_day.select(F.explode(periods).alias("p"), "t").groupBy("p.section", "p.period").agg(F.sum("t").alias("tokens"))


@query("SYN_02_without_machine", f"{USAGE} select agent, cast(sum(input_tokens) as bigint) as tokens from usage where machine <> 'F' group by agent")
def syn_02(spark, d):
    rows = usage(spark, d)
    gone = rows.where("machine = 'F'").select("machine")
    return dedupe.without(rows, gone, ["machine"]).groupBy("agent").agg(F.sum("input_tokens").alias("tokens"))


@query("SYN_03_refresh")
def syn_03(spark, d):
    cell = sync.cells(_folded(spark, d))
    incoming = cell.where("utc_date >= '2024-01-20'")
    return sync.refreshed(cell.where("utc_date < '2024-01-25'"), incoming, cell.select(*sync.SHARD)).select("utc_date", "agent", "bucket", "model", "machine", "messages", "verdict")


@query("SYN_04_plan", f"with i as ({_INDEX}), o as (select machine, agent, utc_date, case when hash % 4 = 0 then hash + 1 else hash end as old from i where hash % 5 <> 0) select machine, agent, utc_date, case when old = hash then 'unchanged' when old is not null and utc_date < '1998-01-01' then 'lateEdit' else 'upload' end as plan from i left join o using (machine, agent, utc_date)")
def syn_04(spark, d):
    index = _index(spark, d)
    old = index.where("hash % 5 <> 0").withColumn("hash", F.when(F.col("hash") % 4 == 0, F.col("hash") + 1).otherwise(F.col("hash")))
    return sync.planned(index, old, 883_785_600_000)  # 1998-01-03T12:00Z: days before 1998 are final


@query("SYN_06_anomalies", "select p_brand as machine, p_type as agent, cast(p_partkey as varchar) as utc_date, unnest(list_filter([case when p_size > 45 then 'lateEdit' end, case when p_size % 7 = 0 then 'unreadableShard' end, case when p_size % 7 <> 0 and p_size % 5 = 0 then 'misplacedShard' end], lambda x: x is not null)) as anomaly from part")
def syn_06(spark, d):
    parts = table(spark, d, "part").select(F.col("p_brand").alias("machine"), F.col("p_type").alias("agent"), F.col("p_partkey").cast("string").alias("utc_date"), (F.col("p_size") > 45).cast("int").alias("late_edits"), (F.col("p_size") % 7 != 0).alias("readable"), "p_size")
    return sync.anomalies(parts.withColumn("place", F.when(F.col("p_size") % 5 == 0, F.lit("elsewhere")).otherwise(F.concat_ws("/", *sync.SHARD))))


@query("SYN_08_clashes", f"with i as ({_INDEX}) select distinct agent, utc_date from i where machine = 'F' and exists (select 1 from i b where b.machine = 'O' and b.agent = i.agent and b.utc_date = i.utc_date)")
def syn_08(spark, d):
    return sync.clashes(_index(spark, d), "F", "O")


@query("SYN_09_prune", f"with i as ({_INDEX}) select * from i where date_diff('day', cast(utc_date as date), date '2001-01-01') <= 400")
def syn_09(spark, d):
    return sync.pruned(_index(spark, d), F.lit("2001-01-01").cast("date"), 400)


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)

"""The reports: unified and by agent, by day, week, month, session and block (RPT-01 to RPT-09)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.functions.usage import in_window, local_date, week_start
from quillmill.operators import blocks, compare, summarize
from quillmill.options import Options


def dated(entries: DataFrame, options: Options) -> DataFrame:
    """Entries with their local date, within the window; the filter comes after de-duplication, as copies may lie on two days."""
    rows = entries.withColumn("date", local_date(F.col("ts_ms"), options.zone)).withColumn("cost", F.coalesce("stored_cost", F.lit(0.0)))
    if options.project:
        rows = rows.where(F.col("project") == options.project)
    return rows.where(in_window(F.col("date"), options.since, options.until))


def periods(entries: DataFrame, kind: str, options: Options = Options(), keys: list[str] | None = None) -> DataFrame:
    """Daily, weekly or monthly usage: dates are filtered first, then put into periods."""
    rows = dated(entries, options)
    day = F.col("date")
    period = {"daily": day, "weekly": F.date_format(week_start(F.to_date(day), options.first_day), "yyyy-MM-dd"), "monthly": F.substring(day, 1, 7)}[kind]
    found = summarize.summarize(rows.withColumn("period", period), ["period", *(keys or [])], F.col("ts_ms"))
    return found.orderBy(F.asc("period") if options.order == "asc" else F.desc("period"), *(keys or []))


def sessions(entries: DataFrame, options: Options = Options(), keys: tuple[str, ...] = ("project_path", "session_id")) -> DataFrame:
    """Usage of each session, by falling cost; sessions without tokens are left out."""
    rows = dated(entries, options)
    found = summarize.by_session(rows, list(keys), "ts_ms", ["model"])
    return found.where(sum((F.col(c) for c in summarize.COUNTERS[1:]), F.col(summarize.COUNTERS[0])) > 0).orderBy(F.desc("cost"), *keys)


def one_session(entries: DataFrame, session: str) -> DataFrame:
    """Entries of one session in order of time."""
    return entries.where(F.col("session_id") == session).orderBy("ts_ms")


def unified(entries: DataFrame, kind: str, options: Options = Options()) -> DataFrame:
    """All agents: one row a period with nested rows of its agents. Weeks start on Monday."""
    rows = dated(entries, options)
    day = F.col("date")
    period = {"daily": day, "weekly": F.date_format(week_start(F.to_date(day), 1), "yyyy-MM-dd"), "monthly": F.substring(day, 1, 7), "session": F.col("session_id")}[kind]
    found = summarize.across_agents(rows.withColumn("period", period), "period", "agent")
    return found.orderBy(F.desc("cost"), "period") if kind == "session" else found.orderBy(F.asc("period") if options.order == "asc" else F.desc("period"))


def unified_rows(entries: DataFrame, kind: str, options: Options = Options()) -> DataFrame:
    """SRT-04: the agents of each period as rows, by period and agent, in reverse for falling order."""
    rows = unified(entries, kind, options).select("period", F.explode("agents").alias("a")).select("period", "a.*")
    return rows.orderBy("period", "agent") if options.order == "asc" else rows.orderBy(F.desc("period"), F.desc("agent"))


def block_report(entries: DataFrame, options: Options = Options()) -> DataFrame:
    """RPT-05: blocks with rates and projections, by start.

    recent: only those of the last days or active; token_limit: a number, or max for the greatest completed
    block shown, gives each block its share of the limit and its status.
    """
    found = blocks.blocks(entries.withColumn("cost", F.coalesce("stored_cost", F.lit(0.0))), "ts_ms", options.length_hours, None, options.now_ms)
    kept = found.where(in_window(local_date(F.col("start_ms"), options.zone), options.since, options.until))
    if options.recent and options.now_ms is not None:
        kept = blocks.recent(kept, options.now_ms)
    rated = blocks.burn_rate(kept)
    if options.now_ms is not None:
        rated = blocks.projection(rated, options.now_ms)
    if options.token_limit is not None:
        limit = blocks.largest_completed(kept).first()[0] if options.token_limit == "max" else int(options.token_limit)
        tokens = sum((F.col(c) for c in summarize.COUNTERS[1:]), F.col(summarize.COUNTERS[0]))
        if limit:
            rated = rated.withColumns({"token_limit": F.lit(limit).cast("long"), "limit_percent": tokens * 100 / limit, "limit_status": blocks.limit_status(tokens, F.lit(limit))})
    return rated.orderBy("start_ms")


def codex(entries: DataFrame, kind: str, options: Options = Options()) -> DataFrame:
    """RPT-09: usage by day, week, month or session file with a map from model to its own usage; sessions have the file's name and folder."""
    rows = dated(entries, options)
    day = F.col("date")
    period = {"daily": day, "weekly": F.date_format(week_start(F.to_date(day), options.first_day), "yyyy-MM-dd"), "monthly": F.substring(day, 1, 7), "session": F.col("session_id")}[kind]
    sums = [F.sum(c).alias(c) for c in (*summarize.COUNTERS, "cost")]
    by_model = rows.withColumn("period", period).groupBy("period", "model").agg(*sums, F.max("ts_ms").alias("last_ms"))
    named = F.struct(*summarize.COUNTERS, "cost")
    found = by_model.groupBy("period").agg(*sums, F.max("last_ms").alias("last_ms"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", named)))).alias("models"))
    if kind != "session":
        return found.drop("last_ms").orderBy(F.asc("period") if options.order == "asc" else F.desc("period"))
    file = F.regexp_extract("period", "([^/]*)$", 1)
    return found.withColumns({"session_file": file, "directory": F.regexp_extract("period", "^(.*)/[^/]*$", 1)}).orderBy("last_ms", "period")


def comparison(entries: DataFrame, mapping: DataFrame, rates: DataFrame, providers: list[str] | None = None, options: Options = Options()) -> DataFrame:
    """RPT-07: what the usage of each model would come to by other providers: mapping (model, provider, target), rates (target, rate)."""
    used = summarize.by_model(dated(entries, options))
    tokens = sum((F.col(c) for c in summarize.COUNTERS[1:]), F.col(summarize.COUNTERS[0]))
    chosen = mapping.where(F.col("provider").isin(providers)) if providers else mapping
    return compare.counterfactual(used.select("model", tokens.alias("tokens"), "cost"), chosen, rates)


def status(entries: DataFrame, session: str, options: Options) -> dict:
    """RPT-06: cost of a session, of today and of the active block."""
    rows = dated(entries, Options(zone=options.zone))
    today = local_date(F.lit(options.now_ms), options.zone)
    sums = rows.agg(F.sum(F.when(F.col("session_id") == session, F.col("cost"))).alias("session"), F.sum(F.when(F.col("date") == today, F.col("cost"))).alias("today")).first()
    active = block_report(entries, options).where("active").first()
    return {"session": sums["session"], "today": sums["today"], "block": active and active["cost"], "minutes_left": active and active["minutes_left"]}


def sections(entries: DataFrame, kinds: list[str], first: str, options: Options = Options()) -> dict[str, DataFrame]:
    """SET-03: several reports of one base; the command's own first, then in the usual order."""
    order = [first, *(k for k in ("daily", "weekly", "monthly", "session") if k in kinds and k != first)]
    return {k: unified(entries, k, options) for k in order}

"""Readers of logs with one JSON record a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.functions.usage import cache_creation, counter, iso_ms, limit_reset, model_label, not_empty, project_of, session_of, split_cached, valid_version
from quillmill.operators.dedupe import after_last, by_precedence, greedy_entries, keep_best, without_burst, without_replay
from quillmill.runtime import persisted
from quillmill.sources.entries import entries, used, with_total
from quillmill.sources.text import Place, parent_name, read_lines, stem, strict_json, text

_SPLIT = "cache_creation:struct<ephemeral_5m_input_tokens:bigint,ephemeral_1h_input_tokens:bigint>"
_COUNTS = "input_tokens:bigint,output_tokens:bigint,cache_creation_input_tokens:bigint,cache_read_input_tokens:bigint"
_MESSAGE = f"struct<id:string,model:string,content:string,usage:struct<{_COUNTS},speed:string,{_SPLIT},iterations:array<struct<type:string,model:string,{_COUNTS}>>>>"
_CLAUDE = f"struct<timestamp:string,sessionId:string,version:string,requestId:string,costUSD:double,isApiErrorMessage:boolean,isSidechain:boolean,message:{_MESSAGE},data:struct<message:struct<timestamp:string,requestId:string,costUSD:double,isSidechain:boolean,message:{_MESSAGE}>>>"
# Members that must not be null anywhere in a record, but for model within iterations.
_NO_NULL = "id|cwd|speed|costUSD|version|sessionId|requestId|isApiErrorMessage|cache_read_input_tokens|cache_creation_input_tokens"


def claude(spark: SparkSession, paths: Place, daily: bool = False) -> DataFrame:
    """SRC-08, SRC-09, PRJ-11, FIL-08, FIL-09, DED-01 to DED-03: entries of Claude logs, with the advisors' own rows, each once.

    daily: nested progress records count as well. Records with a repeated member, a forbidden null, an
    empty id, no plain version, no strict time or without whole token counts are dropped. A session is that
    of the file; the one within a record counts for de-duplication only.
    """
    lines = read_lines(spark, paths, any_of=['"usage":{'])
    parsed = strict_json(lines, "value").withColumn("r", F.from_json("value", _CLAUDE))
    calls = F.regexp_replace("value", r'"iterations":\[[^\]]*\]', "")
    parsed = parsed.where(~F.col("value").rlike(rf'"(?:{_NO_NULL})"\s*:\s*null') & ~calls.rlike(r'"model"\s*:\s*null'))
    direct = F.col("r.message.usage.input_tokens").isNotNull() & F.col("r.message.usage.output_tokens").isNotNull()
    nested = F.col("r.data.message")
    m = F.when(direct, F.col("r.message")).otherwise(nested["message"]) if daily else F.col("r.message")
    pick = (lambda a, b: F.when(direct, a).otherwise(b)) if daily else (lambda a, b: a)
    rows = parsed.select(
        "file_path", "ord", m.alias("m"), pick(F.col("r.timestamp"), nested["timestamp"]).alias("timestamp"), F.col("r.sessionId").alias("own"), "r.version", pick(F.col("r.requestId"), nested["requestId"]).alias("requestId"),
        pick(F.col("r.costUSD"), nested["costUSD"]).alias("costUSD"), pick(F.col("r.isSidechain"), nested["isSidechain"]).alias("side"), F.coalesce("r.isApiErrorMessage", F.lit(False)).alias("error"), "value",
    )
    usage = F.col("m.usage")
    rows = rows.where((usage["input_tokens"] >= 0) & (usage["output_tokens"] >= 0) & valid_version(F.col("version")) & not_empty(F.col("own"), F.col("requestId"), F.col("m.id"), F.col("m.model")) & iso_ms(F.col("timestamp")).isNotNull())
    split = usage["cache_creation"]
    main = F.struct(
        F.lit(-1).alias("i"), F.col("m.id").alias("id"), F.col("m.model").alias("model"), usage["input_tokens"].alias("a"), usage["output_tokens"].alias("b"),
        cache_creation(usage["cache_creation_input_tokens"], split["ephemeral_5m_input_tokens"], split["ephemeral_1h_input_tokens"], split.isNotNull()).alias("c"), usage["cache_read_input_tokens"].alias("d"), F.col("costUSD").alias("cost"),
    )
    advisors = F.transform(
        F.filter(F.coalesce(usage["iterations"], F.array()), lambda e: e["type"] == "advisor_message"),
        lambda e, i: F.struct(i.alias("i"), F.concat("m.id", F.lit(":advisor:"), i.cast("string")).alias("id"), e["model"].alias("model"), e["input_tokens"].alias("a"), e["output_tokens"].alias("b"), counter(e["cache_creation_input_tokens"]).alias("c"), e["cache_read_input_tokens"].alias("d"), F.lit(None).cast("double").alias("cost")),
    )
    each = rows.withColumn("e", F.explode(F.concat(F.array(main), advisors)))
    found = entries(
        each, "claude", keep=["own", "ord"], ts_ms=iso_ms(F.col("timestamp")), session_id=session_of(F.col("file_path")), project=project_of(F.col("file_path")), project_path=project_of(F.col("file_path")), message_id=F.col("e.id"),
        request_id=F.col("requestId"), version=F.col("version"), model=model_label(F.col("e.model"), F.when(F.col("e.i") < 0, F.col("m.usage.speed"))), speed=F.col("m.usage.speed"), is_sidechain=F.coalesce("side", F.lit(False)),
        input_tokens=F.col("e.a"), output_tokens=F.col("e.b"), cache_creation_tokens=F.col("e.c"), cache_read_tokens=F.col("e.d"), stored_cost=F.col("e.cost"), limit_reset_ms=limit_reset(F.col("value"), F.col("error")),
    )
    return once(found, daily)


def once(found: DataFrame, daily: bool) -> DataFrame:
    """DED-01 or DED-03 over the entries of all files, in order of their paths and lines."""
    tokens = F.col("input_tokens") + F.col("output_tokens") + F.col("cache_creation_tokens") + F.col("cache_read_tokens")
    helpers = {"place_of": F.concat_ws("\0", "file_path", "ord", "message_id"), "session": F.coalesce("own", "session_id"), "tokens": tokens}
    rows = found.withColumns(helpers).withColumnsRenamed({"ord": "line", "place_of": "ord", "ts_ms": "ts", "stored_cost": "cost"})
    kept = greedy_entries(rows, daily).withColumnsRenamed({"ts": "ts_ms", "cost": "stored_cost", "line": "line_ord"})
    return kept.drop("ord", "place", "session", "tokens", "own").withColumnRenamed("line_ord", "ord")


_RAW = "input_tokens:bigint,prompt_tokens:bigint,input:bigint,cached_input_tokens:bigint,cache_read_input_tokens:bigint,cached_tokens:bigint,cache_write_input_tokens:bigint,cache_creation_input_tokens:bigint,output_tokens:bigint,completion_tokens:bigint,output:bigint,reasoning_output_tokens:bigint,reasoning_tokens:bigint,total_tokens:bigint"
_NAMES = "model:string,model_name:string,metadata:struct<model:string>"
_RESULT = f"usage:struct<{_RAW}>,timestamp:string,created_at:string,createdAt:string,{_NAMES}"
_CODEX = f"struct<type:string,{_RESULT},data:struct<{_RESULT}>,result:struct<{_RESULT}>,response:struct<{_RESULT}>,payload:struct<type:string,id:string,timestamp:string,forked_from_id:string,{_NAMES},thread_settings:struct<service_tier:string>,info:struct<{_NAMES},last_token_usage:struct<{_RAW}>,total_token_usage:struct<{_RAW}>>>>"


def raw_usage(u: Column) -> Column:
    """PRJ-09: counts by their aliases, cached and written tokens within the input, a total derived where absent or 0."""
    first = lambda *names: F.greatest(F.coalesce(*[u[n] for n in names], F.lit(0).cast("long")), F.lit(0).cast("long"))
    into, out = first("input_tokens", "prompt_tokens", "input"), first("output_tokens", "completion_tokens", "output")
    cached = F.least(first("cached_input_tokens", "cache_read_input_tokens", "cached_tokens"), into)
    written = F.least(first("cache_write_input_tokens", "cache_creation_input_tokens"), into - cached)
    total = F.when(first("total_tokens") > 0, first("total_tokens")).otherwise(into + out)
    return F.when(u.isNotNull(), F.struct(into.alias("i"), cached.alias("c"), written.alias("w"), out.alias("o"), first("reasoning_output_tokens", "reasoning_tokens").alias("r"), total.alias("t")))


def codex(spark: SparkSession, paths: Place, default_model: str = "gpt-5", by_session: bool = False) -> DataFrame:
    """SRC-10 to SRC-12, WIN-08, STATE-01, DED-04, DED-05, DED-15: usage events of Codex sessions, one state a file in line order.

    The model and the service tier in force are the last ones said before a line (an unknown tier clears it,
    an absent one keeps it); usage is the last turn's where the running total changed, else the total's
    growth. Records of runs without a session have their usage, model and time in themselves or in data,
    result or response. Of a session in both folders the one not archived counts. A fork drops the events
    that repeat its parent's usage up to the time of the fork; a fork without known parent drops a dense
    leading burst. An event of one time, model and usage counts once (by_session: once a session), with the
    service tiers merged.
    """
    lines = read_lines(spark, paths, any_of=["turn_context", "event_msg", "session_meta", '"usage"'])
    rows = lines.withColumn("r", F.from_json("value", _CODEX)).withColumn("rel", F.regexp_extract("file_path", r"(?:archived_)?sessions/(.*?)(?:\.jsonl)?$", 1)).withColumn("home", F.regexp_extract("file_path", r"^(.*?)(?:archived_)?sessions/", 1))
    chosen = keep_best(rows.select("home", "rel", "file_path").distinct(), [F.col("home"), F.col("rel")], [F.col("file_path").rlike("(^|/)archived_sessions/"), F.col("file_path")], ["file_path"])
    rows = rows.join(chosen, "file_path", "left_semi")
    p = F.col("r.payload")
    named = lambda x: text(F.coalesce(x["model"], x["model_name"], x["metadata"]["model"]))
    kind = F.when(F.col("r.type") == "event_msg", p["type"]).otherwise(F.col("r.type"))
    places = [F.col("r"), F.col("r.data"), F.col("r.result"), F.col("r.response")]
    within = raw_usage(F.coalesce(*[x["usage"] for x in places]))
    alone = within.isNotNull() & ~F.coalesce(F.col("r.type").isin("event_msg", "turn_context", "session_meta"), F.lit(False))
    kind = F.when(alone, "alone").otherwise(kind)
    said_at = F.coalesce(*[iso_ms(x[c]) for x in places for c in ("timestamp", "created_at", "createdAt")])
    total, last = raw_usage(p["info"]["total_token_usage"]), raw_usage(p["info"]["last_token_usage"])
    counting = kind == "token_count"
    tier_said = F.when((kind == "thread_settings_applied") & p["thread_settings"]["service_tier"].isNotNull(), F.when(F.lower(p["thread_settings"]["service_tier"]).isin("fast", "priority"), "fast").when(F.lower(p["thread_settings"]["service_tier"]).isin("standard", "default"), "standard").otherwise("\0"))
    meta = kind == "session_meta"
    state = rows.select(
        "file_path", "rel", "home", "ord", kind.alias("kind"), said_at.alias("ts_ms"), F.when(counting, total).alias("total"), F.when(alone, within).otherwise(F.when(counting, last)).alias("last"), F.when(alone, F.coalesce(*[named(x) for x in places])).otherwise(F.coalesce(named(p["info"]), named(p))).alias("own"),
        F.when(kind == "turn_context", named(p)).alias("said"), tier_said.alias("tier"), F.when(meta, p["id"]).alias("id"), F.when(meta, p["forked_from_id"]).alias("parent"), F.when(meta & p["forked_from_id"].isNotNull(), F.coalesce(iso_ms(p["timestamp"]), said_at)).alias("forked_ms"),
    )
    before = Window.partitionBy("file_path").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file_path").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("file_path")
    once_said = {c: F.first(c, True).over(whole) for c in ("id", "parent", "forked_ms")}
    state = state.withColumns({"previous": F.last("total", True).over(before), "model": F.last(F.coalesce("said", F.when(F.col("kind").isin("token_count", "alone"), F.col("own"))), True).over(upto), "state": F.nullif(F.last("tier", True).over(upto), F.lit("\0")), **once_said})
    less = lambda f: F.greatest(F.col(f"total.{f}") - F.coalesce(F.col(f"previous.{f}"), F.lit(0)), F.lit(0)).alias(f)
    grown = F.struct(*[less(f) for f in "icwort"])
    advanced = F.col("total").isNull() | F.col("previous").isNull() | (F.col("total") != F.col("previous"))
    counted = state.where("kind in ('token_count', 'alone') and ts_ms is not null").withColumn("u", F.coalesce(F.when(advanced, F.col("last")), F.when(F.col("total").isNotNull(), grown))).where("u is not null and u.i + u.c + u.w + u.o + u.r > 0")
    # A table, as its forks, their parents and the rest are read from it in turn.
    counted = persisted(counted.select("file_path", "rel", "ord", "ts_ms", F.coalesce("own", "model", F.lit(default_model)).alias("model"), "state", "u", "parent", "forked_ms", F.coalesce("id", "rel").alias("session")), "codex-events")
    own = counted.where("parent is null")
    forks = counted.where("parent is not null")
    parents = counted.select(F.col("session").alias("parent")).distinct()
    known, unknown = (forks.join(parents, "parent", how).select(*counted.columns) for how in ("left_semi", "left_anti"))
    kept = own.unionByName(without_replay(known, counted.drop("parent", "forked_ms"), "session", "parent", ["ord"], ["u"], "forked_ms", "ts_ms").select(*counted.columns)).unionByName(without_burst(unknown, "session", "ts_ms").select(*counted.columns))
    fresh, cached = split_cached(F.col("u.i"), F.col("u.c"), F.col("u.w"))
    found = entries(kept, "codex", keep=["ord", "state", "u"], ts_ms=F.col("ts_ms"), session_id=F.col("rel"), model=F.col("model"), speed=F.col("state"), input_tokens=fresh, output_tokens=F.col("u.o"), cache_creation_tokens=F.col("u.w"), cache_read_tokens=cached)
    tier_rank = F.when(F.col("speed") == "standard", 0).when(F.col("speed") == "fast", 1).otherwise(2)
    key = [F.col("ts_ms"), F.col("model"), F.col("u"), *([F.col("session_id")] if by_session else [])]
    tiers = found.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(key)]).agg(F.min(F.struct(tier_rank.alias("r"), "speed"))["speed"].alias("_tier"))
    first = keep_best(found, key, [F.col("file_path"), F.col("ord")])
    same = F.lit(True)
    for i, k in enumerate(["ts_ms", "model", "u", *(["session_id"] if by_session else [])]):
        same &= F.col(k) == F.col(f"_k{i}")
    return first.join(tiers, same).withColumns({"speed": F.col("_tier"), "state": F.col("_tier")}).select("ord", "state", *found.columns[3:])


_PI = "struct<type:string,timestamp:string,id:string,parentId:string,parentSession:string,message:struct<role:string,model:string,modelId:string,provider:string,usage:struct<input:bigint,output:bigint,cacheRead:bigint,cacheWrite:bigint,totalTokens:bigint,cost:struct<total:double>>>,customType:string,modelId:string,provider:string,data:struct<modelId:string,provider:string>>"


def _content_id(*columns: str) -> Column:
    return F.sha2(F.concat_ws("\1", *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns]), 256)


def _pi_like(rows: DataFrame, agent: str, model: Column, session: Column, project: Column) -> DataFrame:
    u = F.col("r.message.usage")
    cols = {"input_tokens": u["input"], "output_tokens": u["output"], "cache_read_tokens": u["cacheRead"], "cache_creation_tokens": u["cacheWrite"]}
    cost = F.when((u["cost"]["total"] >= 0) & (u["cost"]["total"] < 1e300), u["cost"]["total"])
    found = used(entries(rows.where("r.message.usage is not null and r.message.role = 'assistant'"), agent, keep=["ord", "r"], ts_ms=iso_ms(F.col("r.timestamp")), session_id=session, project=project, project_path=project, message_id=F.col("r.id"), model=text(model), stored_cost=cost, **with_total(u["totalTokens"], cols)))
    return found


def _first_copy(found: DataFrame) -> DataFrame:
    """DED-06: of entries with one content the first."""
    key = _content_id("session_id", "message_id", "ts_ms", "model", "input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens")
    return keep_best(found, [key], [F.col("file_path"), F.col("ord")])


def _active_path(lines: DataFrame) -> DataFrame:
    """file_path, id, depth of the records on the way from the last record of a file up to its root; none of a file whose links are partial, repeated, dangling or cyclic.

    Pointers are doubled, each round in a table: from the last record, the records 1, 2, 4, ... steps up.
    """
    links = lines.where("coalesce(r.type, '') <> 'session'").select("file_path", "ord", F.col("r.id").alias("id"), F.col("r.parentId").alias("up"))
    linked = links.groupBy("file_path").agg(F.max(F.col("id").isNotNull() | F.col("up").isNotNull()).alias("any"), F.max(F.col("id").isNull()).alias("partial"), F.count("id").alias("n"), F.count_distinct("id").alias("d"), F.max_by("id", "ord").alias("leaf")).where("any and not partial and n = d")
    nodes = persisted(links.join(linked.select("file_path", "n"), "file_path"), "pi-links")
    dangling = nodes.where("up is not null").alias("a").join(nodes.alias("b"), F.expr("a.file_path = b.file_path and a.up = b.id"), "left_anti").select("file_path").distinct()
    hops = persisted(nodes.join(dangling, "file_path", "left_anti").select("file_path", "id", "up", "n"), "pi-hops")
    reached = persisted(linked.join(dangling, "file_path", "left_anti").select("file_path", F.col("leaf").alias("id"), F.lit(0).cast("long").alias("depth")), "pi-path")
    longest, step = hops.agg(F.max("n")).first()[0] or 0, 1
    while step <= longest:
        up = reached.join(hops, ["file_path", "id"]).where("up is not null").select("file_path", F.col("up").alias("id"), (F.col("depth") + step).alias("depth"))
        reached = persisted(reached.unionByName(up), "pi-path")
        over = hops.select("file_path", F.col("id").alias("up"), F.col("up").alias("_next"))
        hops = persisted(hops.join(over, ["file_path", "up"], "left").select("file_path", "id", F.col("_next").alias("up"), "n"), "pi-hops")
        step *= 2
    # After as many steps as there are records only a circle still leads on.
    circles = hops.where("up is not null").select("file_path").distinct()
    return reached.join(circles, "file_path", "left_anti")


def without_pi_replay(found: DataFrame, lines: DataFrame) -> DataFrame:
    """DED-16: entries of sessions without the leading ones that repeat the active path of their parent, up to the time of the fork.

    found: entries with file_path, ord and r; lines: all lines of the files. A session whose line of parents
    is malformed, unknown or a circle stays whole, as does one of a parent whose links are.
    """
    heads = lines.where("r.type = 'session'").groupBy("file_path").agg(F.min_by(F.struct(F.col("r.parentSession").alias("parent"), iso_ms(F.col("r.timestamp")).alias("forked_ms")), "ord").alias("h")).select("file_path", "h.*")
    folder = F.regexp_extract("file_path", r"^(.*)/[^/]*$", 1)
    named = heads.where("parent is not null").select("file_path", "forked_ms", F.explode(F.array_distinct(F.array("parent", F.concat(folder, F.lit("/"), "parent")))).alias("parent"))
    files = heads.select(F.col("file_path").alias("parent"), F.regexp_replace("file_path", "^file:(//)?", "").alias("plain"))
    matched = named.join(files.select(F.explode(F.array_distinct(F.array("parent", "plain"))).alias("parent"), F.col("parent").alias("up")), "parent")
    pairs = persisted(matched.where("up <> file_path").groupBy("file_path").agg(F.min("up").alias("up"), F.max("forked_ms").alias("forked_ms")), "pi-parents")
    bad = heads.where("forked_ms is null").select("file_path").unionByName(heads.where("parent is not null").select("file_path").join(pairs, "file_path", "left_anti")).distinct()
    # Lineages are short; a session is bad if any of its parents is, or if they lead back to it.
    climb, invalid = pairs.select("file_path", "up"), persisted(bad, "pi-bad")
    for _ in range(max(1, pairs.count().bit_length())):
        through = climb.join(invalid.select(F.col("file_path").alias("up")), "up", "left_semi").select("file_path")
        circle = climb.where("file_path = up").select("file_path")
        invalid = persisted(invalid.unionByName(through).unionByName(circle).distinct(), "pi-bad")
        over = climb.select(F.col("file_path").alias("up"), F.col("up").alias("_next"))
        climb = persisted(climb.join(over, "up").select("file_path", F.col("_next").alias("up")), "pi-climb")
    fair = pairs.join(invalid, "file_path", "left_anti")
    usage = F.struct("ts_ms", "message_id", "model", "input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens")
    path = _active_path(lines)
    unlinked = lines.where("coalesce(r.type, '') <> 'session'").groupBy("file_path").agg(F.max(F.col("r.id").isNotNull() | F.col("r.parentId").isNotNull()).alias("any")).where("not any").select("file_path")
    active = found.join(path.select("file_path", F.col("id").alias("message_id"), "depth"), ["file_path", "message_id"]).select("file_path", (-F.col("depth")).alias("at"), F.lit("").alias("line"), usage.alias("theirs"), "ts_ms")
    plain = found.join(unlinked, "file_path", "left_semi").select("file_path", F.lit(0).cast("long").alias("at"), F.col("ord").alias("line"), usage.alias("theirs"), "ts_ms")
    order = Window.partitionBy("file_path").orderBy("at", "line")
    parents = active.unionByName(plain).withColumn("_n", F.row_number().over(order)).withColumnsRenamed({"file_path": "up", "ts_ms": "their_ms"}).drop("at", "line")
    number = Window.partitionBy("file_path").orderBy("ord")
    ours = found.join(fair, "file_path").withColumn("_n", F.row_number().over(number)).join(parents, ["up", "_n"], "left")
    same = F.coalesce((usage == F.col("theirs")) & (F.col("their_ms") <= F.col("forked_ms")), F.lit(False))
    replay = ours.withColumn("_replay", F.min(same.cast("int")).over(number.rowsBetween(Window.unboundedPreceding, 0))).where("_replay = 1").select("file_path", "ord")
    return found.join(replay, ["file_path", "ord"], "left_anti").select(*found.columns)


def pi(spark: SparkSession, paths: Place, agent: str = "pi") -> DataFrame:
    """SRC-19, SRC-20, DED-06, DED-16: entries of pi stores; a named store gives its own agent. Artifacts of subagents are left out, and what a forked session repeats of its parent."""
    lines = read_lines(spark, paths).where(~F.contains("file_path", F.lit("/subagent-artifacts/"))).withColumn("r", F.from_json("value", _PI))
    name = stem(F.col("file_path"))
    found = _pi_like(lines, agent, F.col("r.message.model"), F.regexp_replace(name, "^[^_]*_", ""), F.regexp_extract("file_path", r"sessions/([^/]+)/", 1))
    forked = lines.where("r.type = 'session' and r.parentSession is not null")
    return _first_copy(found if forked.isEmpty() else without_pi_replay(found, lines)).drop("r")


def openclaw(spark: SparkSession, paths: Place) -> DataFrame:
    """SRC-22, STATE-03: entries of OpenClaw logs; a line without a model has the last one said before it in the file."""
    lines = read_lines(spark, paths).withColumn("r", F.from_json("value", _PI))
    says = F.when((F.col("r.type") == "model_change") | (F.col("r.customType") == "model-snapshot"), F.coalesce("r.modelId", "r.data.modelId"))
    upto = Window.partitionBy("file_path").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("said", F.last(says, True).over(upto))
    model = F.concat(F.lit("[openclaw] "), F.coalesce("r.message.modelId", "r.message.model", "said"))
    return _first_copy(_pi_like(lines, "openclaw", model, stem(F.col("file_path")), F.lit("OpenClaw"))).drop("r")


# Attributes that name a session, the best first.
SESSION_NAMES = ["gen_ai.conversation.id", "copilot_chat.session_id", "copilot_chat.chat_session_id", "session.id", "github.copilot.interaction_id", "gen_ai.response.id"]
SPAN_NAMES = [
    "gen_ai.operation.name", "event.name", "gen_ai.response.model", "gen_ai.request.model", "gen_ai.usage.input_tokens", "gen_ai.usage.output_tokens", "gen_ai.usage.cache_read.input_tokens", "gen_ai.usage.cache_write.input_tokens", "gen_ai.usage.cache_creation.input_tokens",
    "gen_ai.usage.total_tokens", "gen_ai.usage.total.token_count",
]
_OTEL = "struct<type:string,traceId:string,spanId:string,name:string,body:string,endTime:string>"


def attribute(attributes: Column, name: str) -> Column:
    """Text of an attribute of a variant, written dotted or nested, plain or within intValue or stringValue; null if empty."""
    dotted, nested = f"$['{name}']", "$" + "".join(f"['{part}']" for part in name.split("."))
    found = [F.try_variant_get(attributes, f"{p}{wrapped}", "string") for p in dict.fromkeys((dotted, nested)) for wrapped in ("['intValue']", "['stringValue']", "")]
    return text(F.coalesce(*found))


def copilot_spans(spans: DataFrame) -> DataFrame:
    """SRC-24, JOIN-12, DED-11: entries of spans and logs; of one trace or response only the best kind with tokens counts.

    spans: file_path, type, traceId, name, ts_ms, attributes (a variant) and, if there is one, ord. Missing
    models and sessions are taken from the trace, else are unknown or the trace's id.
    """
    # A generator of one row, so that each attribute is looked up once.
    names = {n: f"_a{k}" for k, n in enumerate([*SESSION_NAMES, *SPAN_NAMES])}
    looked_up = F.inline(F.array(F.struct(*[attribute(F.col("attributes"), n).alias(c) for n, c in names.items()])))
    spans = spans.where("attributes is not null").select("*", looked_up)
    a = {n: F.col(c) for n, c in names.items()}
    number = lambda *names: counter(F.coalesce(*[a[n].try_cast("double").cast("long") for n in names], F.lit(0).cast("long")))
    span = F.coalesce(F.col("type") == "span", F.lit(False))
    op, event, name = a["gen_ai.operation.name"], a["event.name"], F.coalesce("name", F.lit(""))
    source = (
        F.when(span & (F.coalesce(op == "chat", F.lit(False)) | name.startswith("chat ")), 0).when(~span & ((event == "gen_ai.client.inference.operation.details") | name.startswith("GenAI inference:")), 1).when(~span & ((event == "copilot_chat.agent.turn") | name.startswith("copilot_chat.agent.turn")), 2)
        .when(span & (F.coalesce(op == "invoke_agent", F.lit(False)) | name.startswith("invoke_agent ")), 3)
    )
    model = F.regexp_replace(F.coalesce(a["gen_ai.response.model"], a["gen_ai.request.model"]), r"-1m(-internal)?$", "")
    priority = {n: 2 if "interaction" in n else 3 if "response" in n else 1 for n in SESSION_NAMES}
    session = F.coalesce(*[F.when(a[n].isNotNull(), F.struct(F.lit(p).alias("p"), F.lit(k).alias("k"), a[n].alias("s"))) for k, (n, p) in enumerate(priority.items())])
    rows = spans.withColumns({"source": source, "own": model, "_session": session, "response": a["gen_ai.response.id"], "order": F.col("ord") if "ord" in spans.columns else F.lit("")})
    into, cached = number("gen_ai.usage.input_tokens"), number("gen_ai.usage.cache_read.input_tokens")
    columns = {"input_tokens": into - F.least(into, cached), "output_tokens": number("gen_ai.usage.output_tokens"), "cache_creation_tokens": number("gen_ai.usage.cache_write.input_tokens", "gen_ai.usage.cache_creation.input_tokens"), "cache_read_tokens": cached}
    counts = with_total(number("gen_ai.usage.total_tokens", "gen_ai.usage.total.token_count"), columns)
    trace = rows.where("traceId is not null").groupBy("file_path", "traceId").agg(F.min(F.when(F.col("own").isNotNull(), F.struct("order", "own")))["own"].alias("_m"), F.min(F.when(F.col("_session").isNotNull(), F.struct("_session.p", "order", "_session.k", "_session.s")))["s"].alias("_s"))
    rows = rows.where("source is not null").withColumns({f"_{k}": v for k, v in counts.items()}).where(" + ".join(f"_{k}" for k in counts) + " > 0").join(trace, ["file_path", "traceId"], "left")
    rows = rows.withColumns({"own": F.coalesce("own", "_m", F.lit("unknown")), "session": F.coalesce("_session.s", "_s", "traceId", F.lit("unknown-session"))})
    rows = persisted(rows.select("file_path", "source", "traceId", "response", "session", "own", "ts_ms", *[f"_{k}" for k in counts]), "copilot-spans")  # four kinds are read from it in turn
    kept = by_precedence([rows.where(F.col("source") == k) for k in range(4)], [["file_path", "traceId"], ["file_path", "response"]])
    return used(entries(kept, "copilot", ts_ms=F.col("ts_ms"), session_id=F.col("session"), project_path=F.lit("GitHub Copilot CLI"), message_id=F.col("response"), model=F.col("own"), message_count=F.lit(1), **{k: F.col(f"_{k}") for k in counts}))


def _span_ms(variant: Column, modified: Column) -> Column:
    """The first time of a record: pairs of seconds and nanoseconds, or plain numbers by their size, else the file's."""
    pairs = [F.try_variant_get(variant, f"$.{n}", "array<bigint>") for n in ("endTime", "startTime", "hrTime", "_hrTime", "time")]
    plain = [F.try_variant_get(variant, f"$.{n}", "string") for n in ("timestamp", "observedTimestamp", "timeUnixNano", "endTime")]
    by_size = lambda x: F.when(x >= 10**17, F.floor(x / 1_000_000)).when(x >= 10**14, F.floor(x / 1000)).when(x >= 10**11, x).otherwise(x * 1000)
    numbers = [by_size(x.try_cast("long")) for x in plain]
    return F.coalesce(*[F.when(F.size(x) >= 2, x[0] * 1000 + F.floor(x[1] / 1_000_000)) for x in pairs], *numbers, *[iso_ms(x) for x in plain], modified)


def copilot(spark: SparkSession, paths: Place) -> DataFrame:
    """SRC-24: entries of telemetry logs."""
    lines = read_lines(spark, paths, any_of=['"attributes"']).withColumns({"v": F.try_parse_json("value"), "r": F.from_json("value", _OTEL)})
    return copilot_spans(lines.select("file_path", "ord", "r.type", F.coalesce("r.traceId", F.try_variant_get("v", "$.spanContext.traceId", "string")).alias("traceId"), F.coalesce("r.name", "r.body", F.lit("")).alias("name"), _span_ms(F.col("v"), F.lit(None).cast("long")).alias("ts_ms"), F.try_variant_get("v", "$.attributes", "variant").alias("attributes")))


def copilot_reconciled(spans: DataFrame, shutdowns: DataFrame) -> DataFrame:
    """DED-12: entries of shutdowns, and those of telemetry after the last shutdown of their session and model."""
    return shutdowns.unionByName(after_last(spans, shutdowns, ["session_id", "model"], "ts_ms").select(*shutdowns.columns))


_SHUTDOWN = "struct<type:string,id:string,timestamp:string,data:struct<modelMetrics:map<string,struct<usage:struct<inputTokens:bigint,outputTokens:bigint,cacheReadTokens:bigint,cacheWriteTokens:bigint,reasoningTokens:bigint>,requests:struct<count:bigint>>>>>"


def copilot_sessions(spark: SparkSession, paths: Place) -> DataFrame:
    """SRC-25, WIN-07: entries of cumulative shutdown metrics, as differences by session and model."""
    lines = read_lines(spark, paths, any_of=["session.shutdown"]).withColumn("r", F.from_json("value", _SHUTDOWN)).where("r.type = 'session.shutdown'")
    rows = lines.select("file_path", "ord", iso_ms(F.col("r.timestamp")).alias("ts_ms"), F.explode("r.data.modelMetrics").alias("name", "m")).where("ts_ms is not null")
    rows = rows.withColumns({"session": parent_name(F.col("file_path")), "model": F.regexp_replace(F.trim("name"), r"-1m(-internal)?$", "")})
    rows = keep_best(rows, [F.col("session"), F.col("model"), F.col("ts_ms")], [F.col("ord")])
    w = Window.partitionBy("session", "model").orderBy("ts_ms", "ord")
    grown = lambda c: F.greatest(counter(c) - F.coalesce(F.lag(counter(c)).over(w), F.lit(0)), F.lit(0))
    u = F.col("m.usage")
    fresh = F.greatest(counter(u["inputTokens"]) - counter(u["cacheReadTokens"]) - counter(u["cacheWriteTokens"]), F.lit(0))
    rows = rows.withColumn("fresh", fresh)
    deltas = rows.withColumns({"i": grown(F.col("fresh")), "o": grown(u["outputTokens"]), "w": grown(u["cacheWriteTokens"]), "c": grown(u["cacheReadTokens"]), "n": grown(F.col("m.requests.count"))})
    return used(entries(deltas, "copilot", ts_ms=F.col("ts_ms"), session_id=F.col("session"), project_path=F.lit("GitHub Copilot CLI"), model=F.col("model"), input_tokens=F.col("i"), output_tokens=F.col("o"), cache_creation_tokens=F.col("w"), cache_read_tokens=F.col("c"), message_count=F.col("n")))


def kimi(spark: SparkSession, paths: Place, models: DataFrame | None = None, default_model: str = "kimi-for-coding") -> DataFrame:
    """SRC-29, DED-06: entries of Kimi wire logs, old status updates and new usage records of turns; models: dir and model of config files."""
    counts = "input_other:bigint,output:bigint,input_cache_creation:bigint,input_cache_read:bigint,total:bigint"
    schema = f"struct<type:string,timestamp:double,message:struct<type:string,payload:struct<message_id:string,token_usage:struct<{counts}>>>,model:string,usage:struct<inputOther:bigint,output:bigint,inputCacheCreation:bigint,inputCacheRead:bigint>,usageScope:string,time:bigint>"
    lines = read_lines(spark, paths, any_of=["StatusUpdate", "usage.record"]).withColumn("r", F.from_json("value", schema)).withColumn("dir", parent_name(F.col("file_path")))
    lines = lines.join(models, "dir", "left") if models is not None else lines.withColumn("config_model", F.lit(None).cast("string"))
    old, new = F.col("r.message.payload.token_usage"), F.col("r.usage")
    is_new = (F.col("r.type") == "usage.record") & (F.col("r.usageScope") == "turn")
    lines = lines.where(is_new | (F.col("r.message.type") == "StatusUpdate"))
    pick = lambda a, b: F.when(is_new, a).otherwise(b)
    cols = {"input_tokens": pick(new["inputOther"], old["input_other"]), "output_tokens": pick(new["output"], old["output"]), "cache_creation_tokens": pick(new["inputCacheCreation"], old["input_cache_creation"]), "cache_read_tokens": pick(new["inputCacheRead"], old["input_cache_read"])}
    found = used(entries(lines, "kimi", keep=["ord"], ts_ms=pick(F.col("r.time"), (F.col("r.timestamp") * 1000).cast("long")), session_id=F.col("dir"), project_path=F.lit("Kimi"), message_id=F.col("r.message.payload.message_id"), model=F.coalesce(pick(F.col("r.model"), F.lit(None)), "config_model", F.lit(default_model)), **with_total(pick(F.lit(None).cast("long"), old["total"]), cols)))
    return keep_best(found, [_content_id("session_id", "message_id", "ts_ms", "model", "input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens", "extra_tokens")], [F.col("file_path"), F.col("ord")])


def qwen(spark: SparkSession, paths: Place) -> DataFrame:
    """SRC-30, DED-06: entries of Qwen chats."""
    schema = "struct<type:string,sessionId:string,timestamp:string,model:string,uuid:string,usageMetadata:struct<promptTokenCount:bigint,candidatesTokenCount:bigint,thoughtsTokenCount:bigint,cachedContentTokenCount:bigint,totalTokenCount:bigint>>"
    lines = read_lines(spark, paths, any_of=["usageMetadata"]).withColumn("r", F.from_json("value", schema)).where("r.type = 'assistant'")
    u, project = F.col("r.usageMetadata"), F.regexp_extract("file_path", r"projects/([^/]+)/", 1)
    fresh, cached = split_cached(u["promptTokenCount"], u["cachedContentTokenCount"])
    cols = {"input_tokens": fresh, "output_tokens": u["candidatesTokenCount"], "cache_read_tokens": cached}
    found = used(entries(lines, "qwen", keep=["ord"], ts_ms=iso_ms(F.col("r.timestamp")), session_id=F.coalesce(text(F.col("r.sessionId")), F.concat(project, F.lit("-"), stem(F.col("file_path")))), project=project, project_path=project, message_id=F.col("r.uuid"), model=text(F.col("r.model")), **with_total(u["totalTokenCount"], cols, u["thoughtsTokenCount"])))
    return keep_best(found, [_content_id("session_id", "ts_ms", "model", "input_tokens", "output_tokens", "cache_read_tokens", "extra_tokens")], [F.col("file_path"), F.col("ord")])


def grok(spark: SparkSession, paths: Place, summaries: DataFrame | None = None, default_model: str = "grok-code-fast-1") -> DataFrame:
    """SRC-31, DED-14: entries of completed turns by model, or of the whole turn; summaries: dir, id, cwd, model of summary files."""
    counts = "inputTokens:bigint,outputTokens:bigint,cachedReadTokens:bigint,cacheCreationTokens:bigint,reasoningTokens:bigint,costUsdTicks:bigint"
    schema = f"struct<timestamp:double,params:struct<sessionId:string,_meta:struct<eventId:string,agentTimestampMs:bigint>,update:struct<sessionUpdate:string,usage:struct<{counts},modelUsage:map<string,struct<{counts}>>>>>>"
    lines = read_lines(spark, paths, any_of=["turn_completed"]).withColumn("r", F.from_json("value", schema)).where("r.params.update.sessionUpdate = 'turn_completed' and r.params.update.usage is not null").withColumn("dir", parent_name(F.col("file_path")))
    lines = lines.join(summaries, "dir", "left") if summaries is not None else lines.withColumns({c: F.lit(None).cast("string") for c in ("id", "cwd", "summary_model")})
    u = F.col("r.params.update.usage")
    fields = [c.split(":")[0] for c in counts.split(",")]
    whole = F.array(F.struct(F.coalesce("summary_model", F.lit(default_model)).alias("key"), F.struct(*[u[f].alias(f) for f in fields]).alias("value")))
    rows = lines.withColumn("e", F.explode(F.when(F.size(u["modelUsage"]) > 0, F.array_sort(F.map_entries(u["modelUsage"]))).otherwise(whole)))
    v, event = F.col("e.value"), F.col("r.params._meta.eventId")
    fresh, cached = split_cached(v["inputTokens"], v["cachedReadTokens"], v["cacheCreationTokens"])
    ts = F.coalesce("r.params._meta.agentTimestampMs", (F.col("r.timestamp") * 1000).cast("long"))
    found = used(entries(rows, "grok", keep=["ord"], ts_ms=ts, session_id=F.coalesce("r.params.sessionId", "id", "dir"), project_path=F.coalesce("cwd", F.lit("Grok")), message_id=event, model=text(F.col("e.key")), stored_cost=v["costUsdTicks"] / 1e10, input_tokens=fresh, output_tokens=v["outputTokens"], cache_creation_tokens=v["cacheCreationTokens"], cache_read_tokens=cached))
    key = F.coalesce(F.concat("message_id", F.lit("\1"), "model"), _content_id("file_path", "ts_ms", "model", "input_tokens", "output_tokens"))
    return keep_best(found, [key], [F.col("file_path"), F.col("ord")])


READERS = {"claude": claude, "codex": codex, "pi": pi, "openclaw": openclaw, "copilot": copilot, "kimi": kimi, "qwen": qwen, "grok": grok}


_HOOK = "struct<session_id:string,transcript_path:string,model:struct<id:string,display_name:string>,cost:struct<total_cost_usd:double>,context_window:struct<total_input_tokens:bigint,context_window_size:bigint>,effort:struct<level:string>>"


def hooks(df: DataFrame, payload: str, keep: list[str]) -> DataFrame:
    """SRC-35: status-line hook objects as columns; an unreadable one gives nulls."""
    return df.select(*keep, F.from_json(payload, _HOOK).alias("h")).select(*keep, "h.session_id", "h.transcript_path", F.coalesce("h.model.display_name", "h.model.id").alias("model"), F.col("h.cost.total_cost_usd").alias("cost"), F.col("h.context_window.total_input_tokens").alias("context"), F.col("h.context_window.context_window_size").alias("size"), F.col("h.effort.level").alias("effort"))


def last_context(spark: SparkSession, path: Place) -> DataFrame:
    """SRC-36: per transcript the input tokens, cached ones included, of its last line with usage."""
    lines = read_lines(spark, path, any_of=['"usage":{']).withColumn("r", F.from_json("value", _CLAUDE)).where("r.message.usage.input_tokens is not null")
    u = F.col("r.message.usage")
    return lines.groupBy("file_path").agg(F.max_by(counter(u["input_tokens"]) + counter(u["cache_creation_input_tokens"]) + counter(u["cache_read_input_tokens"]), "ord").alias("context"))

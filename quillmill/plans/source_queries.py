"""Queries of the readers: each agent's logs, written from the domain tables in its format, go through its reader; SQL works on the tables alone.

Line and document formats reach the readers as rows of content, SQLite stores as blobs; the plain line reader
and discovery go through files in the shared folder.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.functions.usage import ntz_ms, rfc3339
from quillmill.operators import sync
from quillmill.operators.dedupe import keep_best
from quillmill.runtime import new_path, prepare, table, temporary
from quillmill.sources import catalogue, document_agents, jsonl_agents, registry, sqlite_agents
from quillmill.sources.text import read_lines

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
#: Columns of entries that are compared.
SHOWN = ["session_id", "message_id", "ts_ms", "model", "input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens", "extra_tokens"]
#: Rows of a written document or store.
CHUNK = 500

USAGE = f"""u as (select row_id, machine_id as m, coalesce(session_id, 'none') as s, id, model_id as model, greatest(coalesce(input_tokens, 0), 0) as i, greatest(coalesce(output_tokens, 0), 0) as o, greatest(coalesce(cache_creation_input_tokens, 0), 0) as w,
 greatest(coalesce(cache_read_input_tokens, 0), 0) as c, greatest(coalesce(computed_total_tokens, 0), 0) as t, epoch_us(received_at) // 1000 as ms, row_id // {CHUNK} as chunk, status from model_usage)"""


def query(name: str, sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return register


def usage(spark: SparkSession, d: str) -> DataFrame:
    n = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0).cast("long")), F.lit(0).cast("long"))
    rows = table(spark, d, "model_usage").withColumn("ms", ntz_ms(F.col("received_at")))
    return rows.select(
        "row_id", F.col("machine_id").alias("m"), F.coalesce("session_id", F.lit("none")).alias("s"), "id", F.col("model_id").alias("model"), n("input_tokens").alias("i"), n("output_tokens").alias("o"), n("cache_creation_input_tokens").alias("w"), n("cache_read_input_tokens").alias("c"),
        n("computed_total_tokens").alias("t"), "ms", rfc3339(F.col("ms")).alias("iso"), F.floor(F.col("row_id") / CHUNK).alias("chunk"), "status",
    )


def entry_sql(source: str = "u", ctes: str = "", session: str = "s", message: str = "id", ts: str = "ms", model: str = "model", i: str = "i", o: str = "o", w: str = "w", c: str = "c", extra: str = "0", t: str = "t", key: str = "", order: str = "row_id", where: str = "true") -> str:
    """Entries of a source by SQL, with the tokens that only the total knows; key: of rows alike in it the first counts."""
    first = f"qualify row_number() over (partition by {key} order by {order}) = 1" if key else ""
    return f"""with {USAGE}{ctes}, k as (select *, greatest({t} - ({i} + {o} + {w} + {c} + {extra}), 0) as miss from {source} where {where}),
 e as (select *, {session} as session_id, {message} as message_id, {ts} as ts_ms, nullif(trim({model}), '') as label, {i} as input_tokens, case when {o} = 0 then miss else {o} end as output_tokens, {w} as cache_creation_tokens, {c} as cache_read_tokens, {extra} + case when {o} = 0 then 0 else miss end as extra_tokens from k)
 select cast(session_id as varchar) as session_id, cast(message_id as varchar) as message_id, ts_ms, label as model, input_tokens, output_tokens, cache_creation_tokens, cache_read_tokens, extra_tokens from (select * from e where label is not null and input_tokens + output_tokens + cache_creation_tokens + cache_read_tokens + extra_tokens > 0 {first})"""


ALL = "session_id, message_id, ts_ms, label, input_tokens, output_tokens, cache_creation_tokens, cache_read_tokens"


def s(**members) -> Column:
    """A struct of the given columns; texts are literals."""
    return F.struct(*[(F.lit(v) if isinstance(v, str) else v).alias(k) for k, v in members.items()])


C = F.col


def lines(rows: DataFrame, path: Column, value: Column, order: Column | None = None) -> DataFrame:
    return rows.select(F.to_json(value).alias("value"), path.alias("file_path"), (C("row_id") if order is None else order).alias("ord"))


def documents(rows: DataFrame, path: Column, value: Column) -> DataFrame:
    return rows.select(F.to_json(value).alias("value"), path.alias("file_path"), F.lit(0).alias("ord"))


def gathered(rows: DataFrame, keys: list[str], item: Column) -> DataFrame:
    """Rows of one key and chunk as one array in order: at most CHUNK items."""
    listed = F.array_sort(F.collect_list(F.struct(C("row_id").alias("_n"), item.alias("v"))))
    return rows.groupBy(*keys, "chunk").agg(F.transform(listed, lambda x: x["v"]).alias("items"))


def blobs(rows: DataFrame, path: Column, tables: dict[str, tuple[str, list[str]]], which: Column) -> DataFrame:
    """SQLite stores of the rows of one path: file_path, content. tables: name to columns as SQL and the row's columns; which: the table of a row."""
    names = [c for c in dict.fromkeys(c for _, columns in tables.values() for c in columns) if c != "row_id"]
    held = rows.select(path.alias("file_path"), F.struct("row_id", which.alias("_t"), *names).alias("r")).groupBy("file_path").agg(F.array_sort(F.collect_list("r")).alias("rows"))  # at most CHUNK

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, made = batch.column(0).to_pylist(), []
            for listed in batch.column(1).to_pylist():
                with sqlite3.connect(":memory:") as connection:
                    for name, (columns, fields) in tables.items():
                        connection.execute(f"create table {name}({columns})")
                        connection.executemany(f"insert into {name} values ({','.join('?' * len(fields))})", [tuple(r[f] for f in fields) for r in listed if r["_t"] == name])
                    connection.commit()
                    made.append(connection.serialize())
            yield pa.record_batch([pa.array(paths), pa.array(made, pa.binary())], names=["file_path", "content"])

    return held.mapInArrow(build, "file_path string, content binary")


# --- lines ------------------------------------------------------------------------------------------------


@query("SRC_01_lines_of_files", "select machine_id, count(*) as n, cast(sum(length(r)) as bigint) as chars, max(case when row_id >= 0 then cast(row_id as varchar) end) as top from (select machine_id, row_id, machine_id || '|' || row_id || '|' || coalesce(requestId, '') as r from chat) group by 1")
def src_01(spark, d):
    """SRC-01, SRC-04, SRC-07: a folder for each machine, walked and read line by line."""
    chat = table(spark, d, "chat").select(F.concat_ws("|", "machine_id", C("row_id").cast("string"), F.coalesce("requestId", F.lit(""))).alias("value"), C("machine_id").alias("folder"))
    path = new_path(spark, "src-lines")
    chat.repartition("folder").write.partitionBy("folder").text(path)
    found = read_lines(spark, temporary(spark, path), "part-*")
    return found.groupBy(F.regexp_extract("file_path", "folder=([^/]+)/", 1).alias("machine_id")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("value")).alias("chars"), F.max(F.split("value", r"\|")[1]).alias("top"))


_LOG = r"""lg as (select file_id, machine_id || '/' || path as path, string_split(content, chr(10)) as ls from log_files), ln as (select file_id, path, unnest(ls) as line, generate_subscripts(ls, 1) as n from lg)"""


def log_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the stored log files, as the line reader splits them."""
    files = table(spark, d, "log_files")
    return files.select("file_id", F.concat_ws("/", "machine_id", "path").alias("file_path"), F.posexplode(F.split("content", "\n", -1)).alias("ord", "value"))


@query("SRC_05_prefiltered_lines", f"with {_LOG} select file_id, count(*) as n from ln where contains(line, 'turn_context') or contains(line, '\"usage\":{{') group by 1")
def src_05(spark, d):
    rows = read_lines(spark, log_lines(spark, d), any_of=["turn_context", '"usage":{']).join(table(spark, d, "log_files").select("file_id", F.concat_ws("/", "machine_id", "path").alias("file_path")).distinct(), "file_path")
    return rows.groupBy("file_path").agg(F.count(F.lit(1)).alias("n"), F.collect_set("file_id").alias("ids")).select(F.explode("ids").alias("file_id"), (C("n") / F.size("ids") / F.size("ids")).cast("long").alias("n"))


@query("SRC_06_typed_records", f"with {_LOG} select count(*) as n, count(case when json_valid(line) then json_extract_string(line, '$.timestamp') end) as timed, count(case when json_valid(line) then json_extract_string(line, '$.sessionId') end) as owned from ln where contains(line, '\"timestamp\"')")
def src_06(spark, d):
    rows = read_lines(spark, log_lines(spark, d), any_of=['"timestamp"']).select(F.from_json("value", "struct<timestamp:string,sessionId:string>").alias("r"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count("r.timestamp").alias("timed"), F.count("r.sessionId").alias("owned"))


_ISO = r"'\d{4}-\d\d-\d\dT\d\d:\d\d:[0-5]\d(\.\d{3})?(Z|[+-]\d\d:\d\d)'"
_CLAUDE = f"""with {_LOG}, r as (select *, regexp_extract(path, '(?:^|/)projects/([^/]+)/', 1) as project, string_split(regexp_extract(path, '(?:^|/)projects/[^/]+/(.*)$', 1), '/') as parts from ln where contains(line, '"usage":{{') and json_valid(line) and path like '%.jsonl'),
 e as (select coalesce(nullif(trim(project), ''), 'unknown') as project, case when coalesce(list_position(parts, 'subagents'), 0) > 1 then parts[list_position(parts, 'subagents') - 1] when len(parts) > 1 then parts[len(parts) - 1] else regexp_replace(parts[len(parts)], '\\.jsonl$', '') end as session_id, json_extract_string(line, '$.timestamp') as ts, json_extract_string(line, '$.message.model') as model, json_extract(line, '$.message.usage') as u, json_extract_string(line, '$.sessionId') as own from r),
 f as (select *, try_cast(json_extract_string(u, '$.input_tokens') as bigint) as i, try_cast(json_extract_string(u, '$.output_tokens') as bigint) as o from e)
 select project, session_id, count(*) as n, cast(sum(i) as bigint) as input_tokens, cast(sum(o) as bigint) as output_tokens, count(distinct model) as models from f where i >= 0 and o >= 0 and own is distinct from '' and model is distinct from '' and regexp_full_match(ts, {_ISO}) group by 1, 2"""


def _claude(spark: SparkSession, d: str, daily: bool) -> DataFrame:
    found = jsonl_agents.claude(spark, log_lines(spark, d), daily)
    return found.groupBy("project", "session_id").agg(F.count(F.lit(1)).alias("n"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.count_distinct("model").alias("models"))


@query("SRC_08_entries_of_logs", _CLAUDE)
def src_08(spark, d):
    return _claude(spark, d, False)


@query("SRC_09_daily_entries_of_logs", _CLAUDE)
def src_09(spark, d):
    return _claude(spark, d, True)


_CODEX = rf"""with {_LOG}, a as (select *, regexp_extract(path, '^(.*?)(?:archived_)?sessions/(.*?)(?:\.jsonl)?$', 1) as home, regexp_extract(path, '^(.*?)(?:archived_)?sessions/(.*?)(?:\.jsonl)?$', 2) as rel, path like '%archived_sessions/%' as late from ln where path like '%.jsonl' and (contains(line, 'turn_context') or contains(line, 'event_msg') or contains(line, 'session_meta') or contains(line, '"usage"'))),
 b as (select * from a qualify path = first_value(path) over (partition by home, rel order by late, path)), j as (select *, case when json_valid(line) then line end as v from b),
 k as (select path, rel, n, json_extract_string(v, '$.type') as kind, json_extract_string(v, '$.payload.type') as sub, json_extract_string(v, '$.timestamp') as ts, nullif(trim(coalesce(json_extract_string(v, '$.payload.model'), json_extract_string(v, '$.payload.model_name'))), '') as named, json_extract(v, '$.payload.info.last_token_usage') as u from j),
 l as (select *, last_value(case when kind = 'turn_context' then named end ignore nulls) over (partition by path order by n rows unbounded preceding) as said from k),
 g as (select distinct ts, coalesce(named, said, 'gpt-5') as model, cast(json_extract_string(u, '$.input_tokens') as bigint) as i, cast(json_extract_string(u, '$.output_tokens') as bigint) as o, cast(json_extract_string(u, '$.total_tokens') as bigint) as t from l where kind = 'event_msg' and sub = 'token_count' and u is not null and regexp_full_match(ts, {_ISO}))
 select model, count(*) as n, cast(sum(i) as bigint) as input_tokens, cast(sum(o) as bigint) as output_tokens from g where i + o > 0 group by 1"""


@query("SRC_10_codex_logs", _CODEX)
def src_10(spark, d):
    """SRC-10 to SRC-12, DED-04: sessions with the model carried from line to line, archived copies left out."""
    found = jsonl_agents.codex(spark, log_lines(spark, d).where(F.contains("file_path", F.lit("sessions/"))))
    return found.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


@query("SRC_36_last_context", "select 'h/' || coalesce(sessionId, 'none') || '.jsonl' as file_path, arg_max(message.usage.input_tokens + greatest(coalesce(message.usage.cache_creation_input_tokens, 0), 0) + greatest(coalesce(message.usage.cache_read_input_tokens, 0), 0), row_id) as context from chat where message.usage.input_tokens is not null group by 1")
def src_36(spark, d):
    chat = table(spark, d, "chat")
    return jsonl_agents.last_context(spark, lines(chat, F.concat(F.lit("h/"), F.coalesce("sessionId", F.lit("none")), F.lit(".jsonl")), s(message=C("message"))))


def _pi_lines(spark: SparkSession, d: str) -> DataFrame:
    u = usage(spark, d)
    message = s(role="assistant", model=C("model"), usage=s(input=C("i"), output=C("o"), cacheRead=C("c"), cacheWrite=C("w"), totalTokens=C("t")))
    return lines(u, F.concat(F.lit("p/sessions/"), "m", F.lit("/x_"), "s", F.lit(".jsonl")), s(type="message", timestamp=C("iso"), id=C("id"), message=message))


_PI = entry_sql(key=ALL, order="'p/sessions/' || m || '/x_' || s || '.jsonl', row_id")


@query("SRC_19_pi", _PI)
def src_19(spark, d):
    return jsonl_agents.pi(spark, _pi_lines(spark, d)).select(*SHOWN)


@query("SRC_20_named_store", _PI.replace("select cast(session_id", "select 'mine' as agent, cast(session_id"))
def src_20(spark, d):
    return registry.load(spark, {"mine": _pi_lines(spark, d)})[0].select("agent", *SHOWN)


_OPEN = ", v as (select *, 'p/' || m || '/' || s || '.jsonl' as path, last_value(case when row_id % 3 = 0 then model end ignore nulls) over (partition by m, s order by row_id rows unbounded preceding) as said from u)"


@query("SRC_22_openclaw", entry_sql("v", _OPEN, model="'[openclaw] ' || coalesce(case when row_id % 3 <> 0 then model end, said)", key=ALL, order="path, row_id"))
def src_22(spark, d):
    """SRC-22, STATE-03: every third message has no model but that of the line before it."""
    u, bare = usage(spark, d), C("row_id") % 3 == 0
    path = F.concat(F.lit("p/"), "m", F.lit("/"), "s", F.lit(".jsonl"))
    message = s(role="assistant", model=F.when(~bare, C("model")), usage=s(input=C("i"), output=C("o"), cacheRead=C("c"), cacheWrite=C("w"), totalTokens=C("t")))
    said = lines(u.where(bare), path, s(type="model_change", modelId=C("model")), C("row_id") * 2)
    return jsonl_agents.openclaw(spark, said.unionByName(lines(u, path, s(type="message", timestamp=C("iso"), id=C("id"), message=message), C("row_id") * 2 + 1))).select(*SHOWN)


_SHUT = """, v as (select *, row_number() over (partition by s, model, ms order by row_id) as k, sum(i) over x as ci, sum(o) over x as co, sum(w) over x as cw, sum(c) over x as cc from u where model is not null and trim(model) <> '' window x as (partition by s, model order by ms, row_id rows unbounded preceding)),
 y as (select * from v where k = 1), z as (select s, null as id, ms, model, row_id, 0 as t, cast(ci - coalesce(lag(ci) over q, 0) as bigint) as i, cast(co - coalesce(lag(co) over q, 0) as bigint) as o, cast(cw - coalesce(lag(cw) over q, 0) as bigint) as w, cast(cc - coalesce(lag(cc) over q, 0) as bigint) as c from y window q as (partition by s, model order by ms, row_id))"""


@query("SRC_25_shutdowns", entry_sql("z", _SHUT))
def src_25(spark, d):
    """SRC-25, WIN-07: running sums of a session and model as cumulative metrics."""
    so_far = Window.partitionBy("s", "model").orderBy("ms", "row_id").rowsBetween(Window.unboundedPreceding, 0)
    u = usage(spark, d).where("trim(model) <> ''").withColumns({f"c{k}": F.sum(k).over(so_far) for k in "iowc"})
    metric = s(usage=s(inputTokens=C("ci") + C("cc") + C("cw"), outputTokens=C("co"), cacheReadTokens=C("cc"), cacheWriteTokens=C("cw")), requests=s(count=F.lit(1)))
    return jsonl_agents.copilot_sessions(spark, lines(u, F.concat(F.lit("state/"), "s", F.lit("/events.jsonl")), s(type="session.shutdown", id=C("id"), timestamp=C("iso"), data=s(modelMetrics=F.create_map(C("model"), metric))))).select(*SHOWN)


@query("SRC_29_kimi", entry_sql(message="case when row_id % 2 = 0 then id end", ts="case when row_id % 2 = 0 then ms // 1000 * 1000 else ms end", model="coalesce(case when row_id % 2 = 1 then model end, 'kimi-for-coding')", t="case when row_id % 2 = 0 then t else 0 end", key=ALL + ", extra_tokens", order="'k/' || s, row_id"))
def src_29(spark, d):
    """Old status updates and new usage records in turn."""
    u, even = usage(spark, d), C("row_id") % 2 == 0
    old = s(message_id=C("id"), token_usage=s(input_other=C("i"), output=C("o"), input_cache_creation=C("w"), input_cache_read=C("c"), total=C("t")))
    value = F.when(even, F.to_json(s(timestamp=F.floor(C("ms") / 1000).cast("double"), message=s(type="StatusUpdate", payload=old)))).otherwise(F.to_json(s(type="usage.record", usageScope="turn", model=C("model"), time=C("ms"), usage=s(inputOther=C("i"), output=C("o"), inputCacheCreation=C("w"), inputCacheRead=C("c")))))
    rows = u.select(value.alias("value"), F.concat(F.lit("k/"), "s", F.lit("/wire.jsonl")).alias("file_path"), C("row_id").alias("ord"))
    return jsonl_agents.kimi(spark, rows).select(*SHOWN)


@query("SRC_30_qwen", entry_sql(w="0", extra="w", key="session_id, ts_ms, label, input_tokens, output_tokens, cache_read_tokens, extra_tokens", order="'q/projects/' || m || '/chats/' || s || '.jsonl', row_id"))
def src_30(spark, d):
    usage_of = s(promptTokenCount=C("i") + C("c"), candidatesTokenCount=C("o"), thoughtsTokenCount=C("w"), cachedContentTokenCount=C("c"), totalTokenCount=C("t"))
    return jsonl_agents.qwen(spark, lines(usage(spark, d), F.concat(F.lit("q/projects/"), "m", F.lit("/chats/"), "s", F.lit(".jsonl")), s(type="assistant", sessionId=C("s"), timestamp=C("iso"), model=C("model"), uuid=C("id"), usageMetadata=usage_of))).select(*SHOWN)


@query("SRC_31_grok", entry_sql(model="case when row_id % 2 = 0 then model else 'grok-code-fast-1' end", t="0", key="message_id, label", order="'g/' || s || '/updates.jsonl', row_id"))
def src_31(spark, d):
    """Turns with usage by model and as a whole in turn."""
    u, even = usage(spark, d), C("row_id") % 2 == 0
    counts = {"inputTokens": C("i") + C("c") + C("w"), "outputTokens": C("o"), "cachedReadTokens": C("c"), "cacheCreationTokens": C("w")}
    update = s(sessionUpdate="turn_completed", usage=s(**{k: F.when(~even, v) for k, v in counts.items()}, modelUsage=F.when(even & C("model").isNotNull(), F.create_map(F.coalesce("model", F.lit("-")), s(**counts)))))
    return jsonl_agents.grok(spark, lines(u, F.concat(F.lit("g/"), "s", F.lit("/updates.jsonl")), s(params=s(sessionId=C("s"), _meta=s(eventId=C("id"), agentTimestampMs=C("ms")), update=update)))).select(*SHOWN)


def _attr(name: str) -> str:
    """Text of a span's attribute by SQL."""
    nested = "$" + "".join(f'."{p}"' for p in name.split("."))
    return "nullif(trim(coalesce(" + ", ".join(f"json_extract_string(attributes, '{p}{q}')" for p in (f'$."{name}"', nested) for q in (".intValue", ".stringValue", "")) + ")), '')"


def _count(*names: str) -> str:
    return "greatest(coalesce(" + ", ".join(f"cast(trunc(try_cast({_attr(n)} as double)) as bigint)" for n in names) + ", 0), 0)"


_SPAN_SESSION = "coalesce(" + ", ".join(_attr(n) for n in jsonl_agents.SESSION_NAMES) + ")"
_SPANS = f"""with a as (select row_id, machine_id as m, traceId, type is not distinct from 'span' as span, coalesce(name, '') as name, epoch_us(received_at) // 1000 as ms, {_attr("gen_ai.operation.name")} as op, {_attr("event.name")} as event, regexp_replace(coalesce({_attr("gen_ai.response.model")}, {_attr("gen_ai.request.model")}), '-1m(-internal)?$', '') as own,
  {_SPAN_SESSION} as sess, case when {_SPAN_SESSION} is null then null when coalesce({", ".join(_attr(n) for n in jsonl_agents.SESSION_NAMES[:4])}) is not null then 1 when {_attr(jsonl_agents.SESSION_NAMES[4])} is not null then 2 else 3 end as p, {_attr("gen_ai.response.id")} as response, {_count("gen_ai.usage.input_tokens")} as ii, {_count("gen_ai.usage.output_tokens")} as o, {_count("gen_ai.usage.cache_write.input_tokens", "gen_ai.usage.cache_creation.input_tokens")} as w, {_count("gen_ai.usage.cache_read.input_tokens")} as c, {_count("gen_ai.usage.total_tokens", "gen_ai.usage.total.token_count")} as t from trace where attributes is not null),
 b as (select *, ii - least(ii, c) as i, case when span and (op = 'chat' or starts_with(name, 'chat ')) then 0 when not span and (event = 'gen_ai.client.inference.operation.details' or starts_with(name, 'GenAI inference:')) then 1 when not span and (event = 'copilot_chat.agent.turn' or starts_with(name, 'copilot_chat.agent.turn')) then 2 when span and (op = 'invoke_agent' or starts_with(name, 'invoke_agent ')) then 3 end as source from a),
 g as (select m, traceId, arg_min(own, row_id) as _m, arg_min(sess, p * 1000000000000 + row_id) filter (where sess is not null) as _s from b where traceId is not null group by 1, 2),
 k as (select b.*, greatest(t - (i + o + w + c), 0) as miss from b where source is not null), f as (select *, case when o = 0 then miss else o end as output_tokens, case when o = 0 then 0 else miss end as extra_tokens from k where i + o + w + c + miss > 0),
 h as (select * from f where source = 0 or not exists (select 1 from f x where x.m = f.m and x.source < f.source and x.traceId = f.traceId) and not exists (select 1 from f x where x.m = f.m and x.source < f.source and x.response = f.response))
 select coalesce(sess, _s, h.traceId, 'unknown-session') as session_id, response as message_id, ms as ts_ms, coalesce(own, _m, 'unknown') as model, i as input_tokens, output_tokens, w as cache_creation_tokens, c as cache_read_tokens, extra_tokens from h left join g on h.m = g.m and h.traceId = g.traceId"""


@query("SRC_24_spans", _SPANS)
def src_24(spark, d):
    """SRC-24, JOIN-12, DED-11: spans and logs with dotted and nested attributes, an export of a machine being a file."""
    rows = table(spark, d, "trace").withColumn("ts_ms", ntz_ms(C("received_at")))
    spans = rows.select(C("machine_id").alias("file_path"), F.lpad(C("row_id").cast("string"), 20, "0").alias("ord"), "type", "traceId", "name", "ts_ms", F.try_parse_json("attributes").alias("attributes"))
    return jsonl_agents.copilot_spans(spans).select(*SHOWN)


# --- documents --------------------------------------------------------------------------------------------


@query("SRC_15_amp", entry_sql(session="s || '-' || chunk", message="case when chunk % 2 = 0 then id else cast(row_id as varchar) end"))
def src_15(spark, d):
    """SRC-15, JOIN-10: threads with a ledger, whose events take cached tokens from the message, and without one."""
    u = usage(spark, d)
    both = s(message=s(role="assistant", messageId=C("row_id"), model=C("model"), timestamp=C("iso"), usage=s(inputTokens=C("i"), outputTokens=C("o"), cacheCreationInputTokens=C("w"), cacheReadInputTokens=C("c"), totalTokens=C("t"))), event=s(id=C("id"), timestamp=C("iso"), model=C("model"), tokens=s(input=C("i"), output=C("o"), total=C("t")), toMessageId=C("row_id")))
    threads = gathered(u, ["s"], both)
    name = F.concat_ws("-", "s", C("chunk").cast("string"))
    return document_agents.amp(spark, documents(threads, F.concat(F.lit("a/"), name, F.lit(".json")), s(id=name, messages=F.transform("items", lambda x: x["message"]), usageLedger=F.when(C("chunk") % 2 == 0, s(events=F.transform("items", lambda x: x["event"])))))).select(*SHOWN)


@query("SRC_16_droid", entry_sql(message="null", model="coalesce(nullif(trim(model), ''), 'unknown')", key="session_id", order="ts_ms desc, 'd/' || m || '/' || lpad(cast(row_id as varchar), 12, '0') desc"))
def src_16(spark, d):
    """SRC-16, DED-08: snapshots of sessions, of which the latest counts."""
    path = F.concat(F.lit("d/"), "m", F.lit("/"), F.lpad(C("row_id").cast("string"), 12, "0"), F.lit("/"), "s", F.lit(".settings.json"))
    counts = s(inputTokens=C("i"), outputTokens=C("o"), cacheCreationTokens=C("w"), cacheReadTokens=C("c"), totalTokens=C("t"))
    return document_agents.droid(spark, documents(usage(spark, d), path, s(tokenUsage=counts, model=C("model"), providerLockTimestamp=C("iso")))).select(*SHOWN)


@query("SRC_17_codebuff", entry_sql(session="m || '/projects/' || s || '/chats/' || chunk", key="session_id, message_id", order="row_id desc"))
def src_17(spark, d):
    """SRC-17, DED-07: chats with usage in one of two places; the last copy of a message counts."""
    u, even = usage(spark, d), C("row_id") % 2 == 0
    one, other = s(promptTokens=C("i"), output_tokens=C("o"), total=C("t")), s(cacheReadInputTokens=C("c"), cached_tokens_created=C("w"))
    message = s(variant="ai", id=C("id"), timestamp=C("iso"), metadata=s(model=C("model"), usage=F.when(even, one), codebuff=s(usage=s(**{k: F.when(~even, one[k]) for k in ("promptTokens", "output_tokens", "total")}, **{k: other[k] for k in ("cacheReadInputTokens", "cached_tokens_created")}))))
    chats = gathered(u, ["m", "s"], message)
    return document_agents.codebuff(spark, documents(chats, F.concat(F.lit("c/"), "m", F.lit("/projects/"), "s", F.lit("/chats/"), C("chunk").cast("string"), F.lit("/chat-messages.json")), C("items"))).select(*SHOWN)


def _gemini_tokens() -> Column:
    return s(input=C("i") + C("c"), output=C("o"), cached=C("c"), thoughts=C("w"), tool=F.lit(0), total=C("i") + C("c") + C("o") + C("w"))


@query("SRC_26_gemini_documents", entry_sql(w="0", extra="w", t="0"))
def src_26(spark, d):
    sessions = gathered(usage(spark, d), ["s"], s(type="gemini", id=C("id"), timestamp=C("iso"), model=C("model"), tokens=_gemini_tokens()))
    return document_agents.gemini(spark, documents(sessions, F.concat(F.lit("g/"), "s", F.lit("-"), C("chunk").cast("string"), F.lit(".json")), s(sessionId=C("s"), messages=C("items")))).select(*SHOWN)


@query("SRC_27_gemini_lines", entry_sql(w="0", extra="w", t="0", key="m, session_id, message_id", order="row_id desc"))
def src_27(spark, d):
    """The later record of an id replaces the earlier in its file."""
    rows = lines(usage(spark, d), F.concat(F.lit("g/"), "m", F.lit("/"), "s", F.lit(".jsonl")), s(sessionId=C("s"), type="gemini", id=C("id"), timestamp=C("iso"), model=C("model"), tokens=_gemini_tokens()))
    return document_agents.gemini(spark, rows).select(*SHOWN)


_PARTS = f"select p_brand || '-' || p_partkey as model, p_size / 1e6 as input, p_partkey % 100 / 1e6 as output, p_size as context, p_partkey // {CHUNK} as chunk, p_type as provider from part"


@query("SRC_33_flat_catalogue", f"select model, input, output, context from ({_PARTS})")
def src_33(spark, d):
    parts = table(spark, d, "part").select(C("p_partkey").alias("row_id"), F.concat_ws("-", "p_brand", C("p_partkey").cast("string")).alias("model"), s(input_cost_per_token=C("p_size") / 1e6, output_cost_per_token=C("p_partkey") % 100 / 1e6, max_input_tokens=C("p_size")).alias("v"), F.floor(C("p_partkey") / CHUNK).alias("chunk"))
    docs = gathered(parts, [], s(k=C("model"), v=C("v")))
    return catalogue.flat_catalogue(spark, documents(docs, F.concat(C("chunk").cast("string"), F.lit(".json")), F.map_from_entries("items"))).select("model", "input", "output", "context")


@query("SRC_34_provider_catalogue", f"select provider, model, input, output, context from ({_PARTS})")
def src_34(spark, d):
    parts = table(spark, d, "part").select(C("p_partkey").alias("row_id"), C("p_type").alias("provider"), s(id=F.concat_ws("-", "p_brand", C("p_partkey").cast("string")), cost=s(input=C("p_size"), output=C("p_partkey") % 100), limit=s(context=C("p_size"))).alias("v"), F.floor(C("p_partkey") / CHUNK).alias("chunk"))
    docs = gathered(parts, ["provider"], s(k=C("row_id").cast("string"), v=C("v")))
    return catalogue.provider_catalogue(spark, documents(docs, F.concat("provider", C("chunk").cast("string"), F.lit(".json")), F.create_map("provider", s(models=F.map_from_entries("items"))))).select("provider", "model", "input", "output", "context")


@query("SRC_37_shards", f"with {USAGE} select m as machine, strftime(epoch_ms(ms), '%Y-%m-%d') as utc_date, status as agent, count(*) as cells, cast(sum(i) as bigint) as input_tokens, true as readable from u group by 1, 2, 3 union all select 'lost', '2026-01-02', 'x', null, null, false")
def src_37(spark, d):
    """SRC-37, SRC-38: shard documents by machine, agent and day; one that can't be read stays as a row."""
    u = usage(spark, d).withColumn("day", F.date_format(F.timestamp_millis("ms"), "yyyy/MM/dd"))
    shards = u.groupBy("m", "status", "day").agg(F.count(F.lit(1)).alias("n"), F.sum("i").alias("i"))
    docs = documents(shards, F.concat_ws("/", F.lit("b"), "m", F.lit("shards"), "status", F.concat("day", F.lit(".json"))), s(cells=C("n"), input_tokens=C("i")))
    docs = docs.unionByName(prepare(spark).createDataFrame([("{broken", "b/lost/shards/x/2026/01/02.json", 0), ("{}", "b/other.json", 0)], "value string, file_path string, ord int"))
    return sync.read_shards(spark, docs, "struct<cells:bigint,input_tokens:bigint>").select("machine", "utc_date", "agent", "shard.cells", "shard.input_tokens", "readable")


# --- stores -----------------------------------------------------------------------------------------------


def _once(u: DataFrame, keys: list[str]) -> DataFrame:
    """One row an id within a written file, so that the order within it can't matter."""
    return keep_best(u, [C(k) for k in keys], [C("row_id")])


_ONE = ", v as (select * from u qualify row_number() over (partition by {} order by row_id) = 1)"


def _message_json(role: Column | str = "assistant", **more) -> Column:
    return F.to_json(s(id=C("id"), sessionID=C("s"), role=role, modelID=C("model"), time=s(created=C("ms").cast("double")), tokens=s(input=C("i"), output=C("o"), total=C("t"), cache=s(read=C("c"), write=C("w")))) if not more else s(**more))


@query("SRC_13_opencode", entry_sql("v", _ONE.format("id, chunk, row_id % 3"), key="message_id", order="row_id % 3, case when row_id % 3 = 2 then 'o/storage/message/' || s || '/' || id || '.json' else 'o/' || lpad(cast(chunk as varchar), 9, '0') end, row_id"))
def src_13(spark, d):
    """SRC-13, SRC-14, DED-06, DED-09: both message tables, then files, by precedence; the second table names its model in an object."""
    u = _once(usage(spark, d).withColumn("rank", C("row_id") % 3), ["id", "chunk", "rank"])
    second = s(sessionID=C("s"), model=s(id=C("model")), tokens=s(input=C("i"), output=C("o"), total=C("t"), cache=s(read=C("c"), write=C("w"))))
    data = F.when(C("rank") == 1, F.to_json(second)).otherwise(_message_json())
    u = u.withColumns({"data": data, "table": F.when(C("rank") == 0, "message").otherwise("session_message")})
    stores = blobs(u.where("rank < 2"), F.concat(F.lit("o/"), F.lpad(C("chunk").cast("string"), 9, "0"), F.lit(".db")), {t: ("id, session_id, time_created, data", ["id", "s", "ms", "data"]) for t in ("message", "session_message")}, C("table"))
    files = u.where("rank = 2").select(F.concat(F.lit("o/storage/message/"), "s", F.lit("/"), "id", F.lit(".json")).alias("file_path"), C("data").alias("value"))
    return sqlite_agents.opencode(spark, stores.unionByName(files, allowMissingColumns=True)).select(*SHOWN)


@query("SRC_23_kilo", entry_sql("v", _ONE.format("id, chunk"), key="message_id", order="chunk", where="row_id % 5 <> 0"))
def src_23(spark, d):
    """SRC-23, DED-06: every fifth message is the user's."""
    u = _once(usage(spark, d), ["id", "chunk"]).withColumn("data", _message_json(F.when(C("row_id") % 5 == 0, "user").otherwise("assistant")))
    return sqlite_agents.kilo(spark, blobs(u, F.concat(F.lit("k/"), F.lpad(C("chunk").cast("string"), 9, "0"), F.lit(".db")), {"message": ("id, session_id, data", ["id", "s", "data"])}, F.lit("message"))).select(*SHOWN)


@query("SRC_21_goose", entry_sql(session="id", w="0", c="0", t="0", extra="case when t > 0 then greatest(t - i - o, 0) else 0 end"))
def src_21(spark, d):
    """Accumulated counts in every other row; times as text, seconds and milliseconds."""
    even = C("row_id") % 2 == 0
    u = usage(spark, d).withColumns({"config": F.to_json(s(model_name=C("model"))), "at": F.when(C("row_id") % 3 == 0, C("iso")).when(C("row_id") % 3 == 1, C("ms").cast("string")).otherwise(F.format_string("%d.%03d", F.floor(C("ms") / 1000), C("ms") % 1000)), "total": F.when(C("t") > 0, C("t"))})
    u = u.withColumns({f"{a}{k}": F.when(even if a == "x" else ~even, C(c)) for a in "xy" for k, c in (("t", "total"), ("i", "i"), ("o", "o"))})
    columns = "id, model_config_json, provider_name, created_at, total_tokens, input_tokens, output_tokens, accumulated_total_tokens, accumulated_input_tokens, accumulated_output_tokens"
    return sqlite_agents.goose(spark, blobs(u, F.concat(F.lit("g/"), C("chunk").cast("string"), F.lit(".db")), {"sessions": (columns, ["id", "config", "m", "at", "xt", "xi", "xo", "yt", "yi", "yo"])}, F.lit("sessions"))).select(*SHOWN)


@query("SRC_18_hermes_stores", f"""with h as (select *, epoch_us(received_at) // 1000 as ms, {', '.join(f"greatest(coalesce({c}, 0), 0) as {k}" for k, c in (("i", "input_tokens"), ("o", "output_tokens"), ("w", "cache_write_tokens"), ("c", "cache_read_tokens"), ("x", "reasoning_tokens")))} from sessions)
 select id as session_id, id as message_id, ms as ts_ms, nullif(trim(model), '') as model, i as input_tokens, o as output_tokens, w as cache_creation_tokens, c as cache_read_tokens, x as extra_tokens, coalesce(actual_cost_usd, estimated_cost_usd) as stored_cost from h where nullif(trim(model), '') is not null and i + o + w + c + x > 0""")
def src_18(spark, d):
    fields = ["id", "source", "model", "started", "message_count", "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "reasoning_tokens", "billing_provider", "estimated_cost_usd", "actual_cost_usd"]
    rows = table(spark, d, "sessions").withColumn("started", ntz_ms(C("received_at")))
    return sqlite_agents.hermes(spark, blobs(rows, F.concat(F.lit("h/"), F.floor(C("row_id") / CHUNK).cast("string"), F.lit(".db")), {"sessions": (", ".join(fields).replace("started", "started_at"), fields)}, F.lit("sessions"))).select(*SHOWN, "stored_cost")


@query("SRC_32_zcode_stores", entry_sql("v", _ONE.format("id, chunk"), key="message_id", order="chunk, ms", i="greatest(i - c - w, 0)", where="status = 'completed'").replace("select cast(session_id", "select 'dir of ' || s as project_path, cast(session_id"))
def src_32(spark, d):
    """SRC-32, JOIN-11: usage with the folder of its session."""
    u = _once(usage(spark, d), ["id", "chunk"]).withColumn("table", F.lit("model_usage"))
    sessions = u.groupBy("chunk", "s").agg(F.min("row_id").alias("row_id")).withColumns({"table": F.lit("session"), "folder": F.concat(F.lit("dir of "), "s")})
    columns = "id, session_id, started_at, model_id, status, input_tokens, output_tokens, cache_creation_input_tokens, cache_read_input_tokens, computed_total_tokens"
    both = u.unionByName(sessions, allowMissingColumns=True)
    stores = blobs(both, F.concat(F.lit("z/"), F.lpad(C("chunk").cast("string"), 9, "0"), F.lit(".db")), {"model_usage": (columns, ["id", "s", "ms", "model", "status", "i", "o", "w", "c", "t"]), "session": ("id, directory, version", ["s", "folder", "m"])}, C("table"))
    return sqlite_agents.zcode(spark, stores).select("project_path", *SHOWN)


@query("SRC_22_openclaw_stores", entry_sql(model="'[openclaw] ' || model"))
def src_22_store(spark, d):
    message = s(role="assistant", model=C("model"), usage=s(input=C("i"), output=C("o"), cacheRead=C("c"), cacheWrite=C("w"), totalTokens=C("t")))
    u = usage(spark, d).withColumn("json", F.to_json(s(id=C("id"), timestamp=C("iso"), message=message)))
    return sqlite_agents.openclaw_store(spark, blobs(u, F.concat(F.lit("x/"), C("chunk").cast("string"), F.lit(".db")), {"transcript_events": ("session_id, seq, event_json, created_at", ["s", "row_id", "json", "ms"])}, F.lit("transcript_events"))).select(*SHOWN)


def _varint(n: int) -> bytes:
    out = b""
    while True:
        n, low = n >> 7, n & 127
        out += bytes([low | (128 if n else 0)])
        if not n:
            return out


def _field(number: int, value: int | bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(value)) + value if isinstance(value, bytes) else _varint(number << 3) + _varint(value)


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step records in protobuf; the id of a row is the identity of its usage."""
    for batch in batches:
        rows = batch.to_pylist()
        blobs_ = [_field(8, _field(1, r["ms"] // 1000) + _field(2, r["ms"] % 1000 * 1_000_000)) + (_field(24, _field(12, r["model"].encode())) if r["model"] else b"") + _field(9, b"".join(_field(k, r[n]) for k, n in ((2, "i"), (3, "o"), (4, "w"), (5, "c"))) + (_field(11, r["id"].encode()) if r["id"] else b"")) for r in rows]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(blobs_, pa.binary())], names=["row_id", "chunk", "data"])


@query("SRC_28_antigravity", f"""with {USAGE}, g as (select coalesce(id, 'row ' || row_id) as k, max(ms) as ts_ms, arg_max(model, {{'a': ms, 'b': model}}) filter (where model is not null) as model, max(i) as input_tokens, max(o) as output_tokens, max(w) as cache_creation_tokens, max(c) as cache_read_tokens from u group by 1)
 select ts_ms, model, input_tokens, output_tokens, cache_creation_tokens, cache_read_tokens from g where nullif(trim(model), '') is not null and input_tokens + output_tokens + cache_creation_tokens + cache_read_tokens > 0""")
def src_28(spark, d):
    """SRC-28, DED-13: steps in protobuf; events of one identity are one, with the greatest counts."""
    u = usage(spark, d).select("row_id", "chunk", "ms", "model", "i", "o", "w", "c", "id").mapInArrow(_steps, "row_id bigint, chunk bigint, data binary")
    stores = blobs(u, F.concat(F.lit("v/"), C("chunk").cast("string"), F.lit(".db")), {"steps": ("idx, metadata", ["row_id", "data"])}, F.lit("steps"))
    return sqlite_agents.antigravity(spark, stores).select("ts_ms", "model", "input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens")


@query("SRC_39_all_agents", f"select 'mine' as agent, count(*) as n, cast(sum(input_tokens) as bigint) as input_tokens from ({_PI}) union all select 'pi', count(*), cast(sum(input_tokens) as bigint) from ({_PI})")
def src_39(spark, d):
    """SRC-39: several stores, one of which can't be read and doesn't fail the others."""
    found, failed = registry.load(spark, {"mine": _pi_lines(spark, d), "pi": _pi_lines(spark, d), "codex": "/no such folder"})
    assert list(failed) == ["codex"]
    return found.groupBy("agent").agg(F.count(F.lit(1)).alias("n"), F.sum("input_tokens").alias("input_tokens"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)

"""The core's queries of the training-data problems, p1 to p7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.operators import compaction, drift, inlining, instants, pauses, recovery, redelivery
from quillmill.runtime import table

#: The time column of each table of problem 2.
TIMES = {"chat": "timestamp", "trace": "endTime", "sessions": "started_at", "model_usage": "started_at"}


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return instants.odd_instants({t: (table(spark, d, t), c) for t, c in TIMES.items()}, instants.machine_settings(table(spark, d, "commands")))


def _message_key():
    return [redelivery.bare(F.col(c)) for c in ("message_id", "requestId", "sessionId")]


def _messages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chat").select("row_id", F.col("message.id").alias("message_id"), "requestId", "sessionId")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return redelivery.repetitions(_messages(spark, d), "row_id", _message_key(), F.col("message_id").isNotNull()).select("row_id")


#: Deliveries up to this number count as stored, later ones as new.
STORED = 83_000


def _flat_chat(rows: DataFrame) -> DataFrame:
    """Chat rows with the struct's plain members as columns."""
    u = "message.usage"
    return rows.select(*[c for c in rows.columns if c != "message"], F.col("message.id").alias("message_id"), F.col("message.model").alias("model"), *[F.col(f"{u}.{c}").alias(c) for c in ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens", "speed")], F.size(f"{u}.iterations").alias("n_iterations"))


def _batches(spark: SparkSession, d: str) -> list[DataFrame]:
    chat = table(spark, d, "chat")
    return [chat.where(F.col("batch_no") <= STORED), chat.where((F.col("batch_no") > STORED) | F.col("batch_no").isNull())]


_ROW_KEY = ["message.id", "requestId", "sessionId"]


def p6_kept(spark: SparkSession, d: str) -> DataFrame:
    """Whole rows of stored and new deliveries, each message once."""
    return _flat_chat(redelivery.exactly_once(_batches(spark, d), "row_id", [redelivery.bare(F.col(c)) for c in _ROW_KEY], F.col("message.id").isNotNull()))


def p6_appended(spark: SparkSession, d: str) -> DataFrame:
    """Whole rows of the new deliveries that the stored table doesn't have yet."""
    return _flat_chat(redelivery.to_append(*_batches(spark, d), "row_id", [redelivery.bare(F.col(c)) for c in _ROW_KEY], F.col("message.id").isNotNull()))


def chat_sessions(spark: SparkSession, d: str) -> DataFrame:
    settings = instants.machine_settings(table(spark, d, "commands"))
    chat = table(spark, d, "chat").select("machine_id", "timestamp", "received_at").join(settings, F.col("machine_id") == F.col("_machine"), "left")
    timed = chat.select("machine_id", instants.utc_millis(F.col("timestamp"), F.col("_zone"), F.col("received_at")).alias("utc_ms"), pauses.gap_of_hours(F.col("_hours")).alias("gap"))
    return pauses.sweep_sessions(timed, "machine_id", "utc_ms", F.col("gap"))


def p7_sessions(spark: SparkSession, d: str) -> DataFrame:
    return chat_sessions(spark, d)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return chat_sessions(spark, d).select("machine_id", "start_ms", "end_ms")

#: Whole-number text of a count.
WHOLE = "^[0-9]+$"


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    done = compaction.compact(table(spark, d, "log_files"))
    return spark.read.parquet(done.path).select("file_id", "line_no")


def _counted(tables: dict[str, DataFrame], tab: str, member: str, names: list[str]) -> list[DataFrame]:
    parts = []
    for name in names:
        if name in tables and member in tables[name].columns:
            t = tables[name]
            values = [F.col(f"`{c}`").cast("string") for c in (f"{member}.intValue", member) if c in t.columns]
            parts.append(t.where((F.size("path") <= 2) & F.coalesce(*values).rlike(WHOLE)).select(F.lit(tab).alias("tab"), F.col("key").alias("row_id"), F.col("path")[0].alias("pos"), F.coalesce(F.get("path", F.lit(1)), F.lit(-1)).alias("sub_pos")))
    return parts


def _chat_tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The chat records by the graph of their type; Catalyst reads only the members that are asked for."""
    usage = F.struct(F.col("message.usage.iterations").alias("iterations"))
    return inlining.inline_column(table(spark, d, "chat").select("row_id", usage.alias("usage")), "row_id", "usage")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    trace = inlining.inline_json(table(spark, d, "trace"), "row_id", "attributes")
    steps = [n for n in trace if n.rpartition("/")[0] == "" and (n == "steps" or n.endswith(".steps"))]
    calls = [n for n in trace if n.rpartition("/")[0] in steps and (n.rpartition("/")[2] == "calls" or n.endswith(".calls"))]
    status = inlining.inline_json(table(spark, d, "statusline"), "row_id", "payload")
    parts = _counted(_chat_tables(spark, d), "chat", "cache_creation_input_tokens", ["iterations"])
    parts += _counted(trace, "trace", "gen_ai.usage.input_tokens", steps + calls) + _counted(status, "statusline", "context_window.total_input_tokens", ["subagents"])
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def p3_linked(spark: SparkSession, d: str) -> DataFrame:
    """Inner subagents with what their links lead to: the name of the outer one and the model of the record."""
    tables = inlining.inline_json(table(spark, d, "statusline"), "row_id", "payload")
    agents, root = tables["subagents"], tables[""].select("key", F.col("`model.id`").alias("model_id"))
    outer = agents.select("key", F.col("path").alias("parent_path"), F.col("name").alias("outer_name"))
    linked = agents.where("level = 2").join(outer, ["key", "parent_path"], "left").join(root, "key", "left")
    return linked.select(F.col("key").alias("row_id"), F.col("path")[0].alias("pos"), F.col("path")[1].alias("sub_pos"), "name", "outer_name", "model_id")


def p3_records(spark: SparkSession, d: str) -> DataFrame:
    """The root table of statusline: the members of the records themselves."""
    root = inlining.inline_json(table(spark, d, "statusline"), "row_id", "payload")[""]
    return root.select(F.col("key").alias("row_id"), "session_id", F.col("`model.id`").alias("model_id"), F.col("`context_window.total_input_tokens`").alias("context"), F.col("`effort.level`").alias("effort"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return recovery.refused(table(spark, d, "chat_lines")).select("line_id", "reason")


def p4_loaded(spark: SparkSession, d: str) -> DataFrame:
    return recovery.load_lines(table(spark, d, "chat_lines")).where("reason is null").drop("reason", "at", "detail")


def p4_recovered(spark: SparkSession, d: str) -> DataFrame:
    return recovery.recovered(table(spark, d, "chat_lines"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(table(spark, d, "store_rows"))[0]


def p5_unified(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "store_rows")
    return drift.unified(rows, *drift.changes(rows))


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p2_found, p3_found, p3_linked, p3_records, p4_found, p4_loaded, p4_recovered, p5_found, p5_unified, p6_found, p6_kept, p6_appended, p7_found, p7_sessions)}


_COPIES = f"""with c as (select row_id, message.id as message_id, requestId, sessionId, row_number() over (partition by trim(message.id, '{redelivery.SPACES}'), trim(requestId, '{redelivery.SPACES}'), trim(sessionId, '{redelivery.SPACES}') order by row_id) as copy from chat) """


_FLAT = "f as (select * exclude (message), message.id as message_id, message.model as model, message.usage.input_tokens as input_tokens, message.usage.output_tokens as output_tokens, message.usage.cache_creation_input_tokens as cache_creation_input_tokens, message.usage.cache_read_input_tokens as cache_read_input_tokens, message.usage.speed as speed, cast(len(message.usage.iterations) as integer) as n_iterations from chat)"


def _elements(name: str, source: str, within: str) -> str:
    """CTEs of an array's elements and those within them, with both positions."""
    lists = f"{name}0 as (select row_id, json_extract({source}, '$[*]') as l from {name}), {name}1 as (select row_id, unnest(l) as e, generate_subscripts(l, 1) - 1 as pos from {name}0), {name}2 as (select row_id, pos, json_extract(e, '$.{within}[*]') as l from {name}1)"
    return f"{lists}, {name}3 as (select row_id, pos, unnest(l) as e, generate_subscripts(l, 1) - 1 as sub_pos from {name}2), {name}4 as (select row_id, pos, -1 as sub_pos, e from {name}1 union all select row_id, pos, sub_pos, e from {name}3)"


_TOKENS = ", ".join(f"json_extract_string(e, '{p}')" for p in ('$."gen_ai.usage.input_tokens".intValue', "$.gen_ai.usage.input_tokens.intValue", '$."gen_ai.usage.input_tokens"', "$.gen_ai.usage.input_tokens"))
_NESTED = f"""with t as (select row_id, coalesce(json_extract(attributes, '$."gen_ai.steps"'), json_extract(attributes, '$.gen_ai.steps')) as steps from trace), {_elements("t", "steps", "calls")}, u as (select row_id, json_extract(payload, '$.subagents') as agents from statusline), {_elements("u", "agents", "subagents")},
 c as (select row_id, unnest(message.usage.iterations) as e, generate_subscripts(message.usage.iterations, 1) - 1 as pos from chat)
 select 'chat' as tab, row_id, cast(pos as integer) as pos, -1 as sub_pos from c where e.cache_creation_input_tokens >= 0
 union all select 'trace', row_id, cast(pos as integer), cast(sub_pos as integer) from t4 where regexp_full_match(coalesce({_TOKENS}), '[0-9]+')
 union all select 'statusline', row_id, cast(pos as integer), cast(sub_pos as integer) from u4 where regexp_full_match(json_extract_string(e, '$.context_window.total_input_tokens'), '[0-9]+')"""


_F = r'("([^"]|"")*"|[^",\r\n]*)'
_REASONS = rf"""with q as (select line_id, case when regexp_full_match(line, '{_F}(,{_F})*(\r?\n)?') then regexp_extract_all(regexp_replace(line, '\r?\n$', '') || ',', '("(?:[^"]|"")*"|[^",\r\n]*),', 1) end as f from chat_lines where fmt = 'csv' and line is not null), c as (select line_id, list_transform(f, lambda x: case when starts_with(x, '"') then replace(substr(x, 2, length(x) - 2), '""', '"') else x end) as f from q),
 j as (select line_id, case when json_valid(line) and json_type(line) = 'OBJECT' and not regexp_matches(regexp_replace(line, '"(\\.|[^"\\])*"', '""', 'g'), ',\s*[}}\]]') then line end as v from chat_lines where fmt = 'jsonl' and line is not null),
 n as (select line_id, v, json_extract(v, '$.message.usage.input_tokens') as a, json_extract(v, '$.message.usage.output_tokens') as b, json_extract(v, '$.costUSD') as cost from j),
 r as (select line_id, case when f is null then 'syntax' when len(f) <> 9 then 'shape' when not (regexp_full_match(f[7], '[0-9]+') and regexp_full_match(f[8], '[0-9]+') and coalesce(try_cast(f[7] as hugeint), 9223372036854775808) < 9223372036854775808 and coalesce(try_cast(f[8] as hugeint), 9223372036854775808) < 9223372036854775808) or not regexp_full_match(f[9], '|([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') then 'value' end as reason from c
  union all select line_id, case when v is null then 'syntax' when not (json_exists(v, '$.timestamp') and json_exists(v, '$.sessionId') and json_exists(v, '$.message.usage.input_tokens') and json_exists(v, '$.message.usage.output_tokens')) then 'shape'
   when not (regexp_full_match(cast(a as varchar), '[0-9]+') and regexp_full_match(cast(b as varchar), '[0-9]+') and coalesce(try_cast(cast(a as varchar) as hugeint), 9223372036854775808) < 9223372036854775808 and coalesce(try_cast(cast(b as varchar) as hugeint), 9223372036854775808) < 9223372036854775808) or not (cost is null or json_type(cost) = 'NULL' or (json_type(cost) in ('DOUBLE', 'UBIGINT', 'BIGINT') and not starts_with(cast(cost as varchar), '-'))) then 'value' end from n
  union all select line_id, 'syntax' from chat_lines where line is null or fmt is null or fmt not in ('csv', 'jsonl'))
 select line_id, reason from r where reason is not null"""

_CHANGES = """with recursive w(row_id, stream_id, file_no, path, v) as (select row_id, stream_id, file_no, '', cast(payload as json) from store_rows where json_valid(payload) and json_type(payload) = 'OBJECT' and stream_id is not null and file_no is not null
   union all select row_id, stream_id, file_no, path || key || '.', json_extract(v, '$."' || key || '"') from (select *, unnest(json_keys(v)) as key from w where json_type(v) = 'OBJECT')),
 l as (select row_id, stream_id as s, file_no as f, rtrim(path, '.') as name, case json_type(v) when 'NULL' then null when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'ARRAY' then 'array' else 'number' end as kind, case when json_type(v) in ('DOUBLE', 'UBIGINT', 'BIGINT') then cast(cast(v as double) as varchar) else cast(v as varchar) end as val from w where path <> '' and json_type(v) <> 'OBJECT'),
 i as (select row_id, s, f, val as id from l where name = 'id' and kind in ('string', 'number', 'boolean')), p as (select s, f, name, list_sort(list(distinct kind) filter (where kind is not null)) as kinds from l group by 1, 2, 3),
 fs as (select distinct s, f from p), q as (select a.s, a.f + 1 as f from fs a join fs b on a.s = b.s and b.f = a.f + 1),
 gone as (select q.s, q.f, p.name from q join p on p.s = q.s and p.f = q.f - 1 where not exists (select 1 from p n where n.s = q.s and n.f = q.f and n.name = p.name)), new as (select q.s, q.f, p.name from q join p on p.s = q.s and p.f = q.f where not exists (select 1 from p o where o.s = q.s and o.f = q.f - 1 and o.name = p.name)),
 og as (select g.s, g.f, g.name, i.id, l.kind, l.val from gone g join l on l.s = g.s and l.f = g.f - 1 and l.name = g.name and l.kind is not null join i on i.row_id = l.row_id), nw as (select n.s, n.f, n.name, i.id, l.kind, l.val from new n join l on l.s = n.s and l.f = n.f and l.name = n.name and l.kind is not null join i on i.row_id = l.row_id),
 r as (select a.s, a.f, a.name as o, b.name as n from og a join nw b on a.s = b.s and a.f = b.f and a.id = b.id group by all having bool_and(a.kind = b.kind and a.val = b.val))
 select s as stream_id, f as file_no, o as old_name, n as new_name from r union all select s, f, name, '' from gone where not exists (select 1 from r where r.s = gone.s and r.f = gone.f and r.o = gone.name) union all select s, f, '', name from new where not exists (select 1 from r where r.s = new.s and r.f = new.f and r.n = new.name)
 union all select b.s, b.f, b.name, b.name from p a join p b on a.s = b.s and b.f = a.f + 1 and a.name = b.name where coalesce(len(a.kinds), 0) > 0 and coalesce(len(b.kinds), 0) > 0 and a.kinds <> b.kinds"""


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": _REASONS,
        "p5_found": _CHANGES,
        "p3_found": _NESTED,
        "p3_linked": f"""with u as (select row_id, payload as p, json_extract(payload, '$.subagents') as agents from statusline), {_elements("u", "agents", "subagents")}
            select x.row_id, cast(x.pos as integer) as pos, cast(x.sub_pos as integer) as sub_pos, json_extract_string(x.e, '$.name') as name, json_extract_string(y.e, '$.name') as outer_name, json_extract_string(u.p, '$.model.id') as model_id
            from u4 x join u4 y on x.row_id = y.row_id and x.pos = y.pos and y.sub_pos = -1 join u on u.row_id = x.row_id where x.sub_pos >= 0""",
        "p3_records": "select row_id, json_extract_string(payload, '$.session_id') as session_id, json_extract_string(payload, '$.model.id') as model_id, json_extract_string(payload, '$.context_window.total_input_tokens') as context, json_extract_string(payload, '$.effort.level') as effort from statusline",
        "p1_found": r"""with f as (select *, regexp_replace(path, '^archived_', '') as p from log_files), k as (select file_id, string_split_regex(regexp_replace(content, '^\x{feff}', ''), '\r?\n') as lines from f
            qualify machine_id is null or path is null or row_number() over (partition by machine_id, p order by case when path like 'archived\_%' escape '\' then 1 else 0 end, file_id) = 1), l as (select file_id, unnest(lines) as line, generate_subscripts(lines, 1) as n from k)
            select file_id, cast(n as integer) as line_no from l where regexp_matches(line, '\S')""",
        "p6_found": _COPIES + "select row_id from c where copy > 1 and message_id is not null",
        "p6_kept": f"{_COPIES}, {_FLAT} select f.* from f join c using (row_id) where c.copy = 1 or c.message_id is null",
        "p6_appended": f"""{_COPIES}, {_FLAT}, n as (select *, trim(message_id, '{redelivery.SPACES}') as a, trim(requestId, '{redelivery.SPACES}') as b, trim(sessionId, '{redelivery.SPACES}') as c from f)
            select * exclude (a, b, c) from (select * from n where batch_no > {STORED} or batch_no is null qualify message_id is null or row_number() over (partition by a, b, c order by row_id) = 1) x
            where message_id is null or not exists (select 1 from n y where y.batch_no <= {STORED} and y.message_id is not null and x.a = y.a and x.b is not distinct from y.b and x.c is not distinct from y.c)""",
    }

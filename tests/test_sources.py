"""Readers over small stores written here from the formats' shapes."""

import json
import os
import sqlite3

import pytest
from pyspark.sql import functions as F

from quillmill.options import Options
from quillmill.plans import reports
from quillmill.sources import catalogue, document_agents, jsonl_agents, registry, sqlite_agents
from quillmill.sources.sqlite import read_table
from quillmill.sources.text import eligible_files, project_paths, read_lines, roots


def put(base, path, *records):
    file = base / path
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_text("\n".join(r if isinstance(r, str) else json.dumps(r, separators=(",", ":")) for r in records) + "\n")
    return file


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def claude_line(ts, session="s", id="m", request="r", model="model-a", into=1, out=2, cost=None, **more):
    usage = {"input_tokens": into, "output_tokens": out, "cache_creation_input_tokens": 3, "cache_read_input_tokens": 4} | more.pop("usage", {})
    record = {"timestamp": ts, "sessionId": session, "version": "1.2.3", "requestId": request, "message": {"id": id, "model": model, "usage": usage}} | more
    return {k: v for k, v in (record | ({} if cost is None else {"costUSD": cost})).items() if v != "absent"}


def test_lines_keep_their_order_and_paths(spark, tmp_path):
    put(tmp_path, "a b/x.jsonl", *[f"line {k}" for k in range(50)])
    put(tmp_path, "y.txt", "no")
    df = read_lines(spark, str(tmp_path))
    got = [r["value"] for r in df.orderBy("file_path", "ord").collect()]
    assert got == [f"line {k}" for k in range(50)] and "a b/x.jsonl" in df.first()["file_path"]
    assert read_lines(spark, str(tmp_path), any_of=["7"]).count() == 5


def test_roots(tmp_path):
    (tmp_path / "one/projects").mkdir(parents=True)
    assert roots(f"{tmp_path}/one,{tmp_path}/none", [], "projects") == [f"{tmp_path}/one/projects"]
    assert roots(f"{tmp_path}/one/projects", [], "projects") == [f"{tmp_path}/one/projects"]
    assert roots(None, ["/nowhere"], "projects") == []
    with pytest.raises(ValueError):
        roots(f"{tmp_path}/none", [], "projects")
    (tmp_path / "one/projects/p").mkdir()
    assert project_paths(f"{tmp_path}/one/projects", "p") == [f"{tmp_path}/one/projects/p"]
    assert project_paths(f"{tmp_path}/one/projects", "../p") == [f"{tmp_path}/one/projects"]


def test_claude(spark, tmp_path):
    advisor = {"iterations": [{"type": "message", "model": None, "input_tokens": 1, "output_tokens": 1}, {"type": "advisor_message", "model": "adv", "input_tokens": 7, "output_tokens": 8}]}
    put(
        tmp_path,
        "projects/p/s1/chat.jsonl",
        claude_line("2026-01-09T10:00:00.000Z", into=100, out=50, cost=0.12, id="a"),
        claude_line("2026-01-09T12:30:00Z", into=200, out=75, cost=0.34, id="b", usage={"speed": "fast"}),
        claude_line("2026-01-09T12:31:00Z", id="c", usage=advisor),
        claude_line("2026-01-09T12:32:00Z", id="d", usage={"cache_creation": {"ephemeral_5m_input_tokens": 10, "ephemeral_1h_input_tokens": 20}}),
        claude_line("2026-01-09T12:33:00Z", id="e", model=None),  # forbidden null
        claude_line("2026-01-09T12:33:00Z", id="f", request=""),
        claude_line("2026-01-09T12:33:00Z", id="g", version="abc"),
        claude_line("2026-01-09", id="h"),
        claude_line("2026-01-09T12:33:00Z", id="i", into=1.5),
        '{"timestamp":"2026-01-09T12:33:00Z","timestamp":"2026-01-09T12:33:00Z","message":{"id":"j","usage":{"input_tokens":1,"output_tokens":1}}}',
        "not json",
    )
    put(tmp_path, "projects/p/s1/subagents/x.jsonl", claude_line("2026-01-09T13:00:00Z", session="absent", id="k", model="<synthetic>"))
    put(tmp_path, "projects/q/flat.jsonl", {"sessionId": "z", "data": {"message": {"timestamp": "2026-01-10T00:00:00Z", "message": {"id": "n", "model": "m", "usage": {"input_tokens": 5, "output_tokens": 6}}}}})
    df = jsonl_agents.claude(spark, str(tmp_path))
    assert rows(df, "message_id", "input_tokens", "output_tokens", "cache_creation_tokens", "model", "session_id", "project") == [
        ("a", 100, 50, 3, "model-a", "s1", "p"), ("b", 200, 75, 3, "model-a-fast", "s1", "p"), ("c", 1, 2, 3, "model-a", "s1", "p"), ("c:advisor:0", 7, 8, 0, "adv", "s1", "p"), ("d", 1, 2, 30, "model-a", "s1", "p"), ("k", 1, 2, 3, None, "s1", "p"),
    ]
    daily = jsonl_agents.claude(spark, str(tmp_path), daily=True)
    assert daily.count() == 7 and daily.where("message_id = 'n'").first()["input_tokens"] == 5


def test_claude_report(spark, tmp_path):
    put(tmp_path, "projects/alpha/s/chat.jsonl", claude_line("2026-01-09T10:00:00Z", into=100, out=50, cost=0.12, id="a", usage={"cache_creation_input_tokens": 25, "cache_read_input_tokens": 10}), claude_line("2026-01-09T12:30:00Z", into=200, out=75, cost=0.34, id="b", usage={"cache_creation_input_tokens": 50, "cache_read_input_tokens": 20}), claude_line("2026-01-10T09:15:00Z", into=300, out=125, cost=0.56, id="c", usage={"cache_creation_input_tokens": 0, "cache_read_input_tokens": 40}))
    put(tmp_path, "projects/beta/t/chat.jsonl", claude_line("2026-02-03T08:00:00Z", into=50, out=25, cost=0.03, id="d", usage={"cache_creation_input_tokens": 5, "cache_read_input_tokens": 15}), claude_line("2026-02-03T11:45:00Z", into=80, out=35, cost=0.04, id="e", usage={"cache_creation_input_tokens": 10, "cache_read_input_tokens": 25}))
    entries = jsonl_agents.claude(spark, str(tmp_path))
    assert rows(reports.periods(entries, "daily"), "period", "input_tokens", "total_tokens", F.round("cost", 2)) == [("2026-01-09", 300, 530, 0.46), ("2026-01-10", 300, 465, 0.56), ("2026-02-03", 130, 245, 0.07)]
    assert rows(reports.periods(entries, "weekly"), "period", "input_tokens") == [("2026-01-04", 600), ("2026-02-01", 130)]
    assert rows(reports.periods(entries, "monthly", Options(since="20260201")), "period", "input_tokens") == [("2026-02", 130)]
    found = reports.block_report(entries, Options(now_ms=1_770_119_000_000))
    assert [(r["start_ms"], r["active"], r["entries"]) for r in found.collect()] == [(1767952800000, False, 2), (1768035600000, False, 1), (1770105600000, True, 2)]
    assert found.where("active").first()["minutes_left"] == 77
    assert [r["session_id"] for r in reports.sessions(entries, keys=("project_path",)).withColumn("session_id", F.col("project_path")).collect()] == ["alpha", "beta"]
    status = reports.status(entries, "s", Options(now_ms=1_770_119_000_000))
    assert round(status["session"], 2) == 1.02 and round(status["today"], 2) == 0.07 and round(status["block"], 2) == 0.07
    both = reports.unified(entries, "monthly").collect()
    assert [(r["period"], r["agents"][0]["agent"]) for r in both] == [("2026-01", "claude"), ("2026-02", "claude")]
    assert list(reports.sections(entries, ["monthly", "daily"], "session")) == ["session", "daily", "monthly"]


def event(ts, kind, **payload):
    return {"timestamp": ts, "type": "event_msg", "payload": {"type": kind} | payload}


def count(ts, total=None, last=None, **more):
    info = {k: {"input_tokens": v[0], "cached_input_tokens": v[1], "output_tokens": v[2], "total_tokens": v[0] + v[2]} for k, v in (("total_token_usage", total), ("last_token_usage", last)) if v}
    return event(ts, "token_count", info=info | more)


def test_codex(spark, tmp_path):
    put(
        tmp_path,
        "sessions/2026/01/a.jsonl",
        {"timestamp": "2026-01-01T00:00:00Z", "type": "turn_context", "payload": {"model": "gpt-x"}},
        count("2026-01-01T00:00:01Z", (100, 40, 10), (100, 40, 10)),
        event("2026-01-01T00:00:02Z", "thread_settings_applied", thread_settings={"service_tier": "fast"}),
        count("2026-01-01T00:00:03Z", (100, 40, 10), (100, 40, 10)),  # the total didn't advance
        count("2026-01-01T00:00:04Z", (150, 50, 30)),
        event("2026-01-01T00:00:05Z", "thread_settings_applied", thread_settings={}),
        count("2026-01-01T00:00:06Z", (160, 50, 31), (10, 0, 1), model="gpt-y"),
        event("2026-01-01T00:00:07Z", "thread_settings_applied", thread_settings={"service_tier": "odd"}),
        count("2026-01-01T00:00:08Z", (170, 50, 32), (10, 0, 1)),
    )
    put(tmp_path, "archived_sessions/2026/01/a.jsonl", count("2026-01-01T00:00:01Z", (9, 9, 9), (9, 9, 9)))
    df = jsonl_agents.codex(spark, str(tmp_path))
    assert rows(df, "ts_ms", "model", "speed", "input_tokens", "cache_read_tokens", "output_tokens") == [
        (1767225601000, "gpt-x", None, 60, 40, 10), (1767225604000, "gpt-x", "fast", 40, 10, 20), (1767225606000, "gpt-y", "fast", 10, 0, 1), (1767225608000, "gpt-y", None, 10, 0, 1),
    ]


def test_codex_fork_drops_replay(spark, tmp_path):
    meta = lambda i, parent=None: {"timestamp": "2026-01-01T00:02:00Z", "type": "session_meta", "payload": {"id": i} | ({"forked_from_id": parent} if parent else {})}
    first, second = count("2026-01-01T00:00:01Z", (10, 0, 1), (10, 0, 1)), count("2026-01-01T00:01:01Z", (20, 0, 2), (10, 0, 1))
    put(tmp_path, "sessions/p.jsonl", meta("P"), first, second)
    put(tmp_path, "sessions/c.jsonl", meta("C", "P"), first, second, count("2026-01-01T01:00:00Z", (99, 0, 9), (79, 0, 7)))
    put(tmp_path, "sessions/u.jsonl", meta("U", "gone"), first, count("2026-01-01T00:00:01.500Z", (20, 0, 2), (10, 0, 1)), count("2026-01-01T00:09:00Z", (25, 0, 3), (5, 0, 1)))
    late = count("2026-01-01T00:03:00Z", (30, 0, 3), (10, 0, 1))  # of the parent, after the fork
    put(tmp_path, "sessions/p.jsonl", meta("P"), first, second, late)
    put(tmp_path, "sessions/d.jsonl", meta("D", "P"), first, second, count("2026-01-01T00:04:00Z", (30, 0, 3), (10, 0, 1)))
    df = jsonl_agents.codex(spark, str(tmp_path))
    assert rows(df, "session_id", "input_tokens") == [("c", 79), ("d", 10), ("p", 10), ("p", 10), ("p", 10), ("u", 5)]


def test_codex_runs_without_a_session(spark, tmp_path):
    use = {"input_tokens": 9, "cached_input_tokens": 4, "output_tokens": 2}
    put(tmp_path, "sessions/h.jsonl", {"type": "turn.completed", "timestamp": "2026-01-01T00:00:01Z", "model": "hm", "usage": use}, {"result": {"usage": use, "created_at": "2026-01-01T00:00:02Z"}}, {"type": "x", "usage": {"input_tokens": 0}})
    assert rows(jsonl_agents.codex(spark, str(tmp_path)), "ts_ms", "model", "input_tokens", "cache_read_tokens") == [(1767225601000, "hm", 5, 4), (1767225602000, "hm", 5, 4)]


def test_a_record_in_two_files_counts_once(spark, tmp_path):
    for path in ("c/projects/p/s/a.jsonl", "c/projects/p/s/b.jsonl"):
        put(tmp_path, path, claude_line("2026-01-09T10:00:00Z", into=10, out=0, cost=1.0, id="one", usage={"cache_creation_input_tokens": 0, "cache_read_input_tokens": 0}))
    for path in ("x/sessions/a.jsonl", "x/sessions/b.jsonl"):
        put(tmp_path, path, count("2026-01-01T00:00:01Z", (10, 0, 1), (10, 0, 1)))
    found, failed = registry.load(spark, {"claude": str(tmp_path / "c"), "codex": str(tmp_path / "x")})
    assert not failed and rows(found, "agent", "input_tokens") == [("claude", 10), ("codex", 10)]
    total = reports.unified(found.where("agent = 'claude'"), "daily").first()
    assert (total["input_tokens"], total["cost"]) == (10, 1.0)
    assert jsonl_agents.codex(spark, str(tmp_path / "x"), by_session=True).count() == 2


def test_stores_of_one_agent_are_reconciled(spark, tmp_path):
    span = {"type": "span", "traceId": "t", "name": "chat m", "attributes": {"gen_ai": {"usage": {"input_tokens": {"intValue": "7"}}, "request": {"model": "m"}, "conversation": {"id": "sess"}}}}
    put(tmp_path, "otel/x.jsonl", span | {"endTime": [1_767_225_500, 0]}, span | {"traceId": "u", "endTime": [1_767_225_700, 0]})
    put(tmp_path, "state/sess/events.jsonl", {"type": "session.shutdown", "id": "1", "timestamp": "2026-01-01T00:00:00Z", "data": {"modelMetrics": {"m": {"usage": {"inputTokens": 5, "outputTokens": 1}}}}})
    found, failed = registry.load(spark, {"copilot": str(tmp_path / "otel"), "copilot_sessions": str(tmp_path / "state")})
    assert not failed and rows(found, "session_id", "ts_ms", "input_tokens") == [("sess", 1767225600000, 5), ("sess", 1767225700000, 7)]


def test_spans_without_counts_suppress_nothing(spark, tmp_path):
    span = lambda name, **a: {"type": "span", "traceId": "t", "name": name, "endTime": [1, 0], "attributes": a}
    put(tmp_path, "x.jsonl", span("chat m"), span("invoke_agent a", **{"gen_ai.usage.total_tokens": 9}))
    assert rows(jsonl_agents.copilot(spark, str(tmp_path)), "model", "session_id", "output_tokens") == [("unknown", "t", 9)]


def test_pi_forks_follow_the_active_path(spark, tmp_path):
    head = lambda t, parent=None: {"type": "session", "timestamp": t} | ({"parentSession": parent} if parent else {})
    use = lambda i, up, n: {"type": "message", "timestamp": f"2026-01-01T00:00:{n:02}Z", "id": i, "parentId": up, "message": {"role": "assistant", "model": "m", "usage": {"input": n, "output": 1}}}
    at = tmp_path / "sessions/p"
    # The second record is a branch that was left, so the fork repeats the first and the third.
    put(at, "x_a.jsonl", head("2026-01-01T00:00:00Z"), use("1", None, 1), use("2", "1", 2), use("3", "1", 3))
    put(at, "x_b.jsonl", head("2026-01-01T00:00:10Z", "x_a.jsonl"), use("1", None, 1), use("3", "1", 3), use("9", "3", 20))
    put(at, "x_c.jsonl", head("2026-01-01T00:00:10Z", "x_d.jsonl"), use("1", None, 1))  # a circle of parents stays whole
    put(at, "x_d.jsonl", head("2026-01-01T00:00:10Z", "x_c.jsonl"), use("1", None, 1))
    put(at, "x_e.jsonl", head("2026-01-01T00:00:10Z", "x_f.jsonl"), use("5", "6", 1))  # links in a circle
    put(at, "x_f.jsonl", head("2026-01-01T00:00:00Z"), use("5", "6", 1), use("6", "5", 2))
    put(at, "x_g.jsonl", head("2026-01-01T00:00:02Z", "x_a.jsonl"), use("1", None, 1), use("3", "1", 3))  # forked before the third
    assert rows(jsonl_agents.pi(spark, str(tmp_path)), "session_id", "input_tokens") == [("a", 1), ("a", 2), ("a", 3), ("b", 20), ("c", 1), ("d", 1), ("e", 1), ("f", 1), ("f", 2), ("g", 3)]


def test_limit_reset_is_after_the_first_bar(spark):
    from quillmill.functions.usage import limit_reset

    texts = [("Claude AI usage limit reached|17000", True), ("x Claude AI usage limit reached, see | 5|6", True), ("Claude AI usage limit reached at noon|1700000000", True), ("Claude AI usage limit reached|17000000001234", True), ("Claude AI usage limit reached|1", False), ("|5", True), ("Claude AI usage limit reached|" + "9" * 30, True)]
    df = spark.createDataFrame(texts, "t string, e boolean")
    assert [r[0] for r in df.select(limit_reset(F.col("t"), F.col("e"))).collect()] == [17000000, None, 1700000000000, 17000000001234000, None, None, None]


def test_pi_and_openclaw(spark, tmp_path):
    use = lambda n, **m: {"type": "message", "timestamp": f"2026-01-01T00:00:0{n}Z", "id": f"i{n}", "message": {"role": "assistant", "model": "pm", "usage": {"input": n, "output": 2, "cacheRead": 3, "cacheWrite": 4, "totalTokens": n + 10, "cost": {"total": 0.5}}} | m}
    put(tmp_path, "pi/sessions/proj/x_abc.jsonl", use(1), use(1), use(2))
    put(tmp_path, "pi/sessions/proj/subagent-artifacts/y.jsonl", use(3))
    df = jsonl_agents.pi(spark, str(tmp_path / "pi"))
    assert rows(df, "session_id", "project", "input_tokens", "extra_tokens", "stored_cost") == [("abc", "proj", 1, 1, 0.5), ("abc", "proj", 2, 1, 0.5)]
    put(tmp_path, "oc/s1.jsonl", {"type": "model_change", "modelId": "om"}, use(1, model=None))
    lines = jsonl_agents.openclaw(spark, str(tmp_path / "oc"))
    assert rows(lines, "model", "session_id") == [("[openclaw] om", "s1")]
    with sqlite3.connect(tmp_path / "oc.db") as c:
        c.execute("create table transcript_events(session_id, seq, event_json, created_at)")
        c.execute("insert into transcript_events values ('s1', 1, ?, 5)", (json.dumps(use(1, model="om")),))
    store = sqlite_agents.openclaw_store(spark, str(tmp_path / "oc.db"))
    assert rows(sqlite_agents.openclaw_merged(lines, store), "session_id", "message_id") == [("s1", "i1")]


def test_copilot(spark, tmp_path):
    span = lambda n, trace, op, t=100, **a: {"type": "span", "traceId": trace, "spanId": str(n), "name": op, "endTime": [t, 5_000_000], "attributes": {"gen_ai.operation.name": op, "gen_ai.usage.input_tokens": 100, "gen_ai.usage.cache_read.input_tokens": 30, "gen_ai.usage.output_tokens": n} | a}
    put(tmp_path, "otel/x.jsonl", span(1, "t1", "chat", **{"gen_ai.request.model": "cm-1m"}), span(2, "t1", "invoke_agent"), span(3, "t2", "invoke_agent", **{"gen_ai.request.model": "cm2", "gen_ai.conversation.id": "conv"}))
    assert rows(jsonl_agents.copilot(spark, str(tmp_path / "otel")), "ts_ms", "model", "input_tokens", "output_tokens", "session_id") == [(100005, "cm", 70, 1, "t1"), (100005, "cm2", 70, 3, "conv")]
    down = lambda t, i, o: {"type": "session.shutdown", "id": t, "timestamp": f"2026-01-0{t}T00:00:00Z", "data": {"modelMetrics": {"m": {"usage": {"inputTokens": i, "outputTokens": o, "cacheReadTokens": 10, "cacheWriteTokens": 20}, "requests": {"count": int(t)}}}}}
    put(tmp_path, "state/sess/events.jsonl", down("1", 100, 50), down("2", 200, 80))
    assert rows(jsonl_agents.copilot_sessions(spark, str(tmp_path / "state")), "session_id", "input_tokens", "output_tokens", "cache_creation_tokens", "message_count") == [("sess", 100, 30, 0, 1), ("sess", 70, 50, 20, 1)]


def test_kimi_qwen_grok(spark, tmp_path):
    put(tmp_path, "k/sess/wire.jsonl", {"timestamp": 100.5, "message": {"type": "StatusUpdate", "payload": {"message_id": "a", "token_usage": {"input_other": 1, "output": 2, "input_cache_creation": 3, "input_cache_read": 4}}}}, {"type": "usage.record", "usageScope": "turn", "time": 7000, "model": "km", "usage": {"inputOther": 5, "output": 6}}, {"type": "usage.record", "usageScope": "session", "time": 7000, "usage": {"inputOther": 5}})
    assert rows(jsonl_agents.kimi(spark, str(tmp_path / "k")), "ts_ms", "model", "input_tokens", "cache_read_tokens") == [(100500, "kimi-for-coding", 1, 4), (7000, "km", 5, 0)]
    q = {"type": "assistant", "sessionId": "", "timestamp": "2026-01-01T00:00:00Z", "model": "qm", "usageMetadata": {"promptTokenCount": 10, "candidatesTokenCount": 2, "thoughtsTokenCount": 1, "cachedContentTokenCount": 4, "totalTokenCount": 13}}
    put(tmp_path, "q/projects/pp/chats/c1.jsonl", q, q)
    assert rows(jsonl_agents.qwen(spark, str(tmp_path / "q")), "session_id", "input_tokens", "cache_read_tokens", "output_tokens", "extra_tokens") == [("pp-c1", 6, 4, 2, 1)]
    turn = lambda e, **u: {"timestamp": 1.0, "params": {"sessionId": "gs", "_meta": {"eventId": e, "agentTimestampMs": 9}, "update": {"sessionUpdate": "turn_completed", "usage": {"inputTokens": 10, "outputTokens": 3, "cachedReadTokens": 4, "costUsdTicks": 20_000_000_000} | u}}}
    put(tmp_path, "g/d/updates.jsonl", turn("e1"), turn("e1"), turn("e2", modelUsage={"gm": {"inputTokens": 1, "outputTokens": 1}, "ga": {"inputTokens": 2, "outputTokens": 1}}))
    assert rows(jsonl_agents.grok(spark, str(tmp_path / "g")), "model", "input_tokens", "stored_cost") == [("ga", 2, None), ("gm", 1, None), ("grok-code-fast-1", 6, 2.0)]


def test_documents(spark, tmp_path):
    amp = {"id": "T", "messages": [{"role": "assistant", "messageId": 5, "model": "am", "timestamp": "2026-01-01T00:00:00Z", "usage": {"inputTokens": 1, "outputTokens": 2, "cacheCreationInputTokens": 7, "cacheReadInputTokens": 8}}]}
    put(tmp_path, "a/t1.json", json.dumps(amp | {"usageLedger": {"events": [{"id": "e", "timestamp": "2026-01-01T00:00:00Z", "model": "am", "tokens": {"input": 3, "output": 4}, "toMessageId": 5, "credits": 1.5}]}}))
    put(tmp_path, "a/t2.json", json.dumps(amp | {"id": ""}))
    assert rows(document_agents.amp(spark, str(tmp_path / "a")), "session_id", "input_tokens", "cache_creation_tokens", "credits") == [("T", 3, 7, 1.5), ("t2", 1, 7, None)]
    put(tmp_path, "d/s9.settings.json", {"tokenUsage": {"inputTokens": 5, "outputTokens": 6, "thinkingTokens": 2}, "providerLockTimestamp": "2026-01-01T00:00:00Z"})
    put(tmp_path, "d/s9.jsonl", {"type": "x", "model": "old"}, {"model": "dm"})
    assert rows(document_agents.droid(spark, str(tmp_path / "d")), "session_id", "model", "extra_tokens") == [("s9", "dm", 2)]
    chat = [{"variant": "ai", "id": "c1", "timestamp": "2026-01-01T00:00:00Z", "credits": 2, "metadata": {"model": "cb", "usage": {"promptTokens": 4}, "codebuff": {"usage": {"output_tokens": 5}}}}, {"variant": "ai", "id": "c2", "metadata": {"runState": {"sessionState": {"mainAgentState": {"messageHistory": [{"role": "assistant", "providerOptions": {"codebuff": {"model": "hist", "usage": {"input_tokens": 9}}}}, {"role": "user"}]}}}}}, {"variant": "user", "id": "u"}]
    put(tmp_path, "c/ch/projects/pr/chats/2026-01-02T03-04-05.000Z/chat-messages.json", json.dumps(chat))
    assert rows(document_agents.codebuff(spark, str(tmp_path / "c")), "message_id", "model", "input_tokens", "output_tokens", "session_id", "ts_ms") == [("c1", "cb", 4, 5, "ch/projects/pr/chats/2026-01-02T03-04-05.000Z", 1767225600000), ("c2", "hist", 9, 0, "ch/projects/pr/chats/2026-01-02T03-04-05.000Z", 1767323045000)]
    t = {"input": 10, "output": 2, "cached": 4, "thoughts": 1, "tool": 0, "total": 13}
    put(tmp_path, "g/one.json", json.dumps({"sessionId": "G", "startTime": "2026-01-01T00:00:00Z", "messages": [{"type": "gemini", "id": "1", "model": "gm", "tokens": t}, {"type": "user"}]}))
    put(tmp_path, "g/two.json", json.dumps({"stats": {"models": {"gs": {"tokens": t | {"total": 17}}}}}))
    put(tmp_path, "g/three.jsonl", {"sessionId": "L", "model": "lm"}, {"id": "x", "timestamp": "2026-01-01T00:00:00Z", "tokens": t}, {"id": "x", "timestamp": "2026-01-01T00:00:00Z", "tokens": t | {"output": 3, "total": 14}})
    assert rows(document_agents.gemini(spark, str(tmp_path / "g")), "session_id", "model", "input_tokens", "cache_read_tokens", "output_tokens", "extra_tokens") == [("G", "gm", 6, 4, 2, 1), ("L", "lm", 6, 4, 3, 1), ("two", "gs", 10, 4, 2, 1)]


def store(path, table, columns, *data):
    with sqlite3.connect(path) as c:
        c.execute(f"create table {table}({columns})")
        c.executemany(f"insert into {table} values ({','.join('?' * len(data[0]))})", data)


def test_sqlite_source(spark, tmp_path):
    store(tmp_path / "a.db", "t", "id text, n integer", ("x", 1), ("y", "text"), ("z", None), ("w", 50))
    store(tmp_path / "b.db", "t", "id text", ("q",))
    store(tmp_path / "c.db", "other", "id text", ("q",))
    df = read_table(spark, str(tmp_path), "t", "id string, n bigint")
    assert rows(df, "id", "n") == [("q", None), ("w", 50), ("x", 1), ("y", None), ("z", None)]
    assert rows(df.where("n > 10"), "id") == [("w",)]


def test_sqlite_agents(spark, tmp_path):
    msg = lambda i, role="assistant", **m: json.dumps({"id": i, "sessionID": "S", "role": role, "modelID": "om", "cost": 0.5, "time": {"created": 1_767_225_600_000}, "tokens": {"input": 1, "output": 2, "reasoning": 3, "cache": {"read": 4, "write": 5}}} | m)
    (tmp_path / "o").mkdir()
    store(tmp_path / "o/o.db", "message", "id, session_id, time_created, data", ("m1", "S", 1, msg("m1")))
    with sqlite3.connect(tmp_path / "o/o.db") as c:
        c.execute("create table session(id, time_created, cost, tokens_input, tokens_output, tokens_cache_read, tokens_cache_write, tokens_reasoning, model)")
        c.executemany("insert into session values (?, 1767225600000, 1.0, 7, 8, 0, 0, 0, 'sm')", [("S",), ("S2",)])
    put(tmp_path, "o/storage/message/S/m1.json", msg("m1", cost=9))
    put(tmp_path, "o/storage/message/S/m2.json", msg("m2"))
    assert rows(sqlite_agents.opencode(spark, str(tmp_path / "o")), "session_id", "message_id", "model", "stored_cost", "extra_tokens") == [("S", "m1", "om", 0.5, 3), ("S", "m2", "om", 0.5, 3), ("S2", None, "sm", 1.0, 0)]
    store(tmp_path / "k.db", "message", "id, session_id, data", ("r1", "S", msg("m1")), ("r2", "S", msg("m1")), ("r3", "S", msg("m3", role="user")))
    assert rows(sqlite_agents.kilo(spark, str(tmp_path / "k.db")), "message_id", "input_tokens") == [("m1", 1)]
    store(tmp_path / "g.db", "sessions", "id, model_config_json, provider_name, created_at, total_tokens, input_tokens, output_tokens, accumulated_total_tokens, accumulated_input_tokens, accumulated_output_tokens", ("g1", '{"model_name":"gm"}', "p", "2026-01-01 00:00:00", 1, 1, 1, 20, 10, 5), ("g2", '{"model_name":"gm"}', "p", 1_767_225_600, 3, 1, 1, None, None, None))
    assert rows(sqlite_agents.goose(spark, str(tmp_path / "g.db")), "session_id", "ts_ms", "input_tokens", "extra_tokens") == [("g1", 1767225600000, 10, 5), ("g2", 1767225600000, 1, 1)]
    store(tmp_path / "h.db", "sessions", "id, model, started_at, input_tokens, output_tokens, estimated_cost_usd, actual_cost_usd", ("h1", "hm", 1_767_225_600.5, 1, 2, 0.3, None), ("h2", None, 1.0, 1, 2, 0.3, None))
    assert rows(sqlite_agents.hermes(spark, str(tmp_path / "h.db")), "session_id", "ts_ms", "stored_cost") == [("h1", 1767225600500, 0.3)]
    store(tmp_path / "z.db", "model_usage", "id, session_id, started_at, model_id, status, input_tokens, output_tokens, cache_read_input_tokens", ("u1", "zs", 1_767_225_600_000, "zm", "completed", 10, 2, 4), ("u2", "zs", 1, "zm", "failed", 1, 1, 0))
    with sqlite3.connect(tmp_path / "z.db") as c:
        c.execute("create table session(id, directory)")
        c.execute("insert into session values ('zs', '/home/x')")
    assert rows(sqlite_agents.zcode(spark, str(tmp_path / "z.db")), "message_id", "project_path", "input_tokens", "cache_read_tokens") == [("u1", "/home/x", 6, 4)]


def number(n):
    out = b""
    while True:
        n, low = n >> 7, n & 127
        out += bytes([low | (128 if n else 0)])
        if not n:
            return out


def field(k, value):
    return number(k << 3 | 2) + number(len(value)) + value if isinstance(value, bytes) else number(k << 3) + number(value)


def test_protobuf_store(spark, tmp_path):
    usage = lambda o, resp: field(2, 10) + field(3, o) + field(5, 300) + field(11, resp)
    step = lambda o, resp, t: field(8, field(1, t)) + field(24, field(12, b"agm")) + field(9, usage(o, resp))
    store(tmp_path / "conv.db", "steps", "idx, metadata", (1, step(5, b"r1", 100)), (2, step(9, b"r1", 200)), (3, step(1, b"r2", 300)), (4, None))
    assert rows(sqlite_agents.antigravity(spark, str(tmp_path / "conv.db")), "ts_ms", "model", "input_tokens", "output_tokens", "cache_read_tokens", "session_id") == [(200000, "agm", 10, 9, 300, "conv"), (300000, "agm", 10, 1, 300, "conv")]
    with pytest.raises(ValueError):
        sqlite_agents.wire(b"\x0a\x05ab")


def test_registry_and_catalogues(spark, tmp_path):
    put(tmp_path, "pi/sessions/p/x.jsonl", {"type": "message", "timestamp": "2026-01-01T00:00:00Z", "message": {"role": "assistant", "model": "m", "usage": {"input": 1, "output": 1}}})
    found, failed = registry.load(spark, {"mystore": str(tmp_path / "pi"), "claude": str(tmp_path / "none")})
    assert rows(found, "agent", "input_tokens") == [("mystore", 1)] and list(failed) == ["claude"]
    put(tmp_path, "c1/a.json", json.dumps({"m1": {"input_cost_per_token": 1e-6, "max_input_tokens": 5}, "m2": {"i": 2e-6, "o": 3e-6}, "sample": {}}))
    assert rows(catalogue.flat_catalogue(spark, str(tmp_path / "c1")), "model", "input", "context") == [("m1", 1e-6, 5), ("m2", 2e-6, None)]
    put(tmp_path, "c2/b.json", json.dumps({"prov": {"models": {"k": {"id": "pm", "cost": {"input": 2.0}, "limit": {"context": 9}}}}}))
    assert rows(catalogue.provider_catalogue(spark, str(tmp_path / "c2")), "provider", "model", "input", "context") == [("prov", "pm", 2e-6, 9)]


def test_hooks_and_last_context(spark, tmp_path):
    put(tmp_path, "t.jsonl", claude_line("2026-01-01T00:00:00Z", into=1), claude_line("2026-01-01T00:00:01Z", into=50), {"type": "user"})
    assert rows(jsonl_agents.last_context(spark, str(tmp_path)), "context") == [(57,)]
    df = spark.createDataFrame([(1, '{"session_id":"s","model":{"id":"m"},"cost":{"total_cost_usd":1.5},"context_window":null}'), (2, "broken"), (3, None)], "k int, p string")
    assert rows(jsonl_agents.hooks(df, "p", ["k"]), "k", "session_id", "model", "cost", "context") == [(1, "s", "m", 1.5, None), (2, None, None, None, None), (3, None, None, None, None)]


def test_files_of_a_window(tmp_path):
    old, new, far = (put(tmp_path, f"2026/{m}/01/a.jsonl", {}) for m in ("01", "02", "09"))
    os.utime(old, (0, 0))
    assert eligible_files(str(tmp_path), "*.jsonl", "2026-01-15", "2026-03-01") == [str(new)]
    assert eligible_files(str(tmp_path), "*.jsonl", None, None) == [str(old), str(new), str(far)]

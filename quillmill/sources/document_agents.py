"""Readers of logs with one JSON document a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.functions.usage import counter, iso_ms, split_cached
from quillmill.operators.dedupe import keep_last
from quillmill.sources.entries import entries, used, with_total
from quillmill.sources.text import Place, parent_name, read_documents, read_lines, stem, text


def amp(spark: SparkSession, paths: Place) -> DataFrame:
    """SRC-15, JOIN-10: entries of Amp threads: ledger events with the cache counts of the message they point to, else messages."""
    usage = "struct<model:string,timestamp:string,inputTokens:bigint,outputTokens:bigint,cacheCreationInputTokens:bigint,cacheReadInputTokens:bigint,totalTokens:bigint>"
    schema = f"struct<id:string,messages:array<struct<role:string,messageId:bigint,model:string,timestamp:string,usage:{usage}>>,usageLedger:struct<events:array<struct<id:string,timestamp:string,model:string,tokens:struct<input:bigint,output:bigint,total:bigint>,toMessageId:bigint,credits:double>>>>"
    docs = read_documents(spark, paths).withColumn("r", F.from_json("value", schema)).withColumn("thread", F.coalesce(text(F.col("r.id")), stem(F.col("file_path"))))
    ledger = F.size(F.coalesce("r.usageLedger.events", F.array())) > 0
    events = docs.where(ledger).select("file_path", "thread", "r.messages", F.explode("r.usageLedger.events").alias("e"))
    target = F.get(F.filter("messages", lambda m: m["messageId"] == F.col("e.toMessageId")), F.lit(0))["usage"]
    cols = {"input_tokens": F.col("e.tokens.input"), "output_tokens": F.col("e.tokens.output"), "cache_creation_tokens": target["cacheCreationInputTokens"], "cache_read_tokens": target["cacheReadInputTokens"]}
    a = entries(events, "amp", ts_ms=iso_ms(F.col("e.timestamp")), session_id=F.col("thread"), project=F.lit("amp"), project_path=F.lit("Amp"), message_id=F.col("e.id"), model=text(F.col("e.model")), credits=F.col("e.credits"), **with_total(F.col("e.tokens.total"), cols))
    messages = docs.where(~ledger).select("file_path", "thread", F.explode("r.messages").alias("m")).where("m.usage is not null and m.role = 'assistant'")
    u = F.col("m.usage")
    cols = {"input_tokens": u["inputTokens"], "output_tokens": u["outputTokens"], "cache_creation_tokens": u["cacheCreationInputTokens"], "cache_read_tokens": u["cacheReadInputTokens"]}
    b = entries(messages, "amp", ts_ms=iso_ms(F.coalesce(u["timestamp"], "m.timestamp")), session_id=F.col("thread"), project=F.lit("amp"), project_path=F.lit("Amp"), message_id=F.col("m.messageId"), model=text(F.coalesce(u["model"], "m.model")), **with_total(u["totalTokens"], cols))
    return used(a.unionByName(b))


def droid(spark: SparkSession, paths: Place, default_model: str = "unknown") -> DataFrame:
    """SRC-16, DED-08: one entry a session's settings file; the model may stand in the log beside it; the latest snapshot of a session counts."""
    schema = "struct<tokenUsage:struct<inputTokens:bigint,outputTokens:bigint,cacheCreationTokens:bigint,cacheReadTokens:bigint,thinkingTokens:bigint,totalTokens:bigint>,model:string,providerLock:string,providerLockTimestamp:string>"
    docs = read_documents(spark, paths, "*.settings.json").withColumn("r", F.from_json("value", schema)).where("r.tokenUsage is not null").withColumn("session", F.regexp_extract("file_path", r"([^/]+)\.settings\.json$", 1))
    logs = read_lines(spark, paths, any_of=['"model"']).select(stem(F.col("file_path")).alias("session"), "ord", F.get_json_object("value", "$.model").alias("m")).where("m is not null")
    said = logs.groupBy("session").agg(F.max_by("m", "ord").alias("logged"))
    u = F.col("r.tokenUsage")
    cols = {"input_tokens": u["inputTokens"], "output_tokens": u["outputTokens"], "cache_creation_tokens": u["cacheCreationTokens"], "cache_read_tokens": u["cacheReadTokens"]}
    rows = entries(docs.join(said, "session", "left"), "droid", ts_ms=F.coalesce(iso_ms(F.col("r.providerLockTimestamp")), "modified_ms"), session_id=F.col("session"), project_path=F.lit("Droid"), model=F.coalesce(text(F.col("r.model")), "logged", "r.providerLock", F.lit(default_model)), **with_total(u["totalTokens"], cols, u["thinkingTokens"]))
    return keep_last(used(rows), [F.col("session_id")], [F.col("ts_ms"), F.col("file_path")])


def _aliases(u: str, names: list[str]) -> Column:
    return F.coalesce(*[F.nullif(F.try_variant_get(F.col(u), f"$.{n}", "bigint"), F.lit(0)) for n in names])


def codebuff(spark: SparkSession, paths: Place) -> DataFrame:
    """SRC-17, DED-07: entries of chat messages, usage from the first of three places that has each count; the last copy of a message counts."""
    docs = read_documents(spark, paths, "chat-messages.json").withColumn("v", F.try_parse_json("value"))
    rows = docs.select("file_path", "modified_ms", F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("pos", "m"))
    role = F.coalesce(F.try_variant_get("m", "$.variant", "string"), F.try_variant_get("m", "$.role", "string"))
    history = F.try_variant_get("m", "$.metadata.runState.sessionState.mainAgentState.messageHistory", "array<variant>")
    newest = F.get(F.reverse(F.filter(history, lambda h: F.try_variant_get(h, "$.role", "string") == "assistant")), F.lit(0))
    rows = rows.where(role.isin("ai", "agent", "assistant")).withColumns({"a": F.try_variant_get("m", "$.metadata.usage", "variant"), "b": F.try_variant_get("m", "$.metadata.codebuff.usage", "variant"), "h": newest}).withColumns({"c": F.coalesce(F.try_variant_get("h", "$.providerOptions.usage", "variant"), F.try_variant_get("h", "$.providerOptions.codebuff.usage", "variant"))})
    # Names a count goes by.
    names = {
        "input_tokens": ["inputTokens", "input_tokens", "promptTokens", "prompt_tokens"],
        "output_tokens": ["outputTokens", "output_tokens", "completionTokens", "completion_tokens"],
        "cache_read_tokens": ["cacheReadInputTokens", "cache_read_input_tokens", "promptTokensDetails.cachedTokens", "prompt_tokens_details.cached_tokens"],
        "cache_creation_tokens": ["cacheCreationInputTokens", "cache_creation_input_tokens", "cacheCreationTokens", "cache_creation_tokens", "cachedTokensCreated", "cached_tokens_created"],
        "total": ["totalTokens", "total_tokens", "total"],
    }
    cols = {k: F.coalesce(*[_aliases(place, n) for place in "abc"]) for k, n in names.items()}
    total = cols.pop("total")
    model = F.coalesce(F.try_variant_get("m", "$.metadata.model", "string"), F.try_variant_get("h", "$.providerOptions.codebuff.model", "string"))
    ident, credit = F.try_variant_get("m", "$.id", "string"), F.try_variant_get("m", "$.credits", "double")
    session = F.regexp_extract("file_path", r"([^/]+/projects/[^/]+/chats/[^/]+)/[^/]+$", 1)
    ts = F.coalesce(iso_ms(F.try_variant_get("m", "$.timestamp", "string")), iso_ms(F.regexp_replace(F.regexp_extract("file_path", r"chats/([^/]+)/", 1), r"T(\d\d)-(\d\d)-(\d\d)", "T$1:$2:$3")), F.col("modified_ms"))
    found = used(entries(rows, "codebuff", keep=["pos"], ts_ms=ts, session_id=F.coalesce(text(session), parent_name(F.col("file_path"))), project_path=F.lit("Codebuff"), message_id=ident, model=text(model), credits=credit, **with_total(total, cols)))
    key = F.coalesce(F.concat("session_id", F.lit("\1"), "message_id"), F.concat("file_path", F.lit("\2"), F.col("pos").cast("string")))
    return keep_last(found, [key], [F.col("file_path"), F.col("pos")])


_TOKENS = "tokens:struct<input:bigint,output:bigint,cached:bigint,thoughts:bigint,tool:bigint,total:bigint>"


def _gemini_split(t: Column) -> tuple[Column, Column]:
    """Input without cached tokens where the total shows that it includes them."""
    into, cached = counter(t["input"]), counter(t["cached"])
    inclusive = into + counter(t["output"]) + counter(t["thoughts"]) + counter(t["tool"])
    fresh, used_up = split_cached(into, cached)
    overlap = (cached > 0) & (t["total"] == inclusive) & (t["total"] != inclusive + cached)
    return F.when(overlap, fresh).otherwise(into), F.when(overlap, F.greatest(cached, used_up)).otherwise(cached)


def _gemini(rows: DataFrame, m: Column, session: Column, fallback: Column) -> DataFrame:
    t = m["tokens"]
    fresh, cached = _gemini_split(t)
    cols = {"input_tokens": fresh, "output_tokens": t["output"], "cache_read_tokens": cached}
    return used(entries(rows, "gemini", ts_ms=F.coalesce(iso_ms(m["timestamp"]), fallback), session_id=session, project=F.lit("gemini"), project_path=F.lit("Gemini"), message_id=m["id"], model=text(m["model"]), **with_total(t["total"], cols, counter(t["thoughts"]) + counter(t["tool"]))))


def gemini(spark: SparkSession, paths: Place) -> DataFrame:
    """SRC-26, SRC-27: entries of Gemini files: messages, one direct record, or totals by model; and of JSON lines, where a later record of an id replaces the earlier in its place."""
    message = f"struct<type:string,id:string,timestamp:string,model:string,{_TOKENS}>"
    schema = f"struct<sessionId:string,startTime:string,lastUpdated:string,timestamp:string,type:string,id:string,model:string,{_TOKENS},messages:array<{message}>,stats:struct<models:map<string,struct<{_TOKENS}>>>>"
    docs = read_documents(spark, paths).withColumn("r", F.from_json("value", schema)).withColumn("session", F.coalesce(text(F.col("r.sessionId")), stem(F.col("file_path"))))
    started = F.coalesce(iso_ms(F.col("r.startTime")), iso_ms(F.col("r.lastUpdated")), F.col("modified_ms"))
    many = docs.where("r.messages is not null").withColumn("at", started).select("file_path", "session", "at", F.explode("r.messages").alias("m")).where("m.type = 'gemini'")
    one = docs.where("r.messages is null and r.type = 'gemini'").select("file_path", "session", F.col("modified_ms").alias("at"), F.struct(*[F.col(f"r.{c}") for c in ("type", "id", "timestamp", "model", "tokens")]).alias("m"))
    stats = docs.where("r.messages is null and coalesce(r.type, '') <> 'gemini' and r.stats is not null").select("file_path", "session", F.coalesce(iso_ms(F.col("r.timestamp")), F.col("modified_ms")).alias("at"), F.explode("r.stats.models").alias("name", "s"))
    stats = stats.select("file_path", "session", "at", F.struct(F.lit("gemini").alias("type"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("timestamp"), F.col("name").alias("model"), F.col("s.tokens").alias("tokens")).alias("m"))
    lines = read_lines(spark, paths).withColumn("r", F.from_json("value", schema))
    upto = Window.partitionBy("file_path").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumns({"session": F.coalesce(F.last(text(F.col("r.sessionId")), True).over(upto), stem(F.col("file_path"))), "model": F.last(text(F.col("r.model")), True).over(upto)}).where("r.tokens is not null")
    m = F.struct(F.col("r.type"), F.col("r.id"), F.col("r.timestamp"), F.coalesce("r.model", "model").alias("model"), F.col("r.tokens"))
    last = keep_last(lines.select("file_path", "session", "ord", m.alias("m")), [F.col("file_path"), F.coalesce("m.id", F.concat(F.lit("\1"), F.col("ord").cast("string")))], [F.col("ord")])
    parts = many.unionByName(one).unionByName(stats).unionByName(last.select("file_path", "session", F.lit(None).cast("long").alias("at"), "m"))
    return _gemini(parts, F.col("m"), F.col("session"), F.col("at"))


READERS = {"amp": amp, "droid": droid, "codebuff": codebuff, "gemini": gemini}

"""De-duplication of usage records: keys with preference orders, precedence of sources, replays, identities."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.runtime import persisted


def keep_best(df: DataFrame, key: list[Column], order: list[Column], keep: list[str] | None = None) -> DataFrame:
    """DED-06 to DED-08: the row of each key that comes first in the order; null keys agree with each other.

    A partially aggregated minimum of a struct, not a window: each task keeps one row a key before the
    shuffle, so a key that holds a third of all rows costs no more than any other. order must be total for
    a defined result; keep: columns of the result (all by default).
    """
    keep = keep or df.columns
    names = [f"_o{i}" for i in range(len(order))]
    row = F.struct(*[o.alias(n) for o, n in zip(order, names, strict=True)], F.struct(*keep).alias("_row"))
    return df.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(key)]).agg(F.min(row).alias("_best")).select("_best._row.*")


def keep_last(df: DataFrame, key: list[Column], order: list[Column], keep: list[str] | None = None) -> DataFrame:
    """DED-07, DED-08: the row of each key that comes last in the order."""
    keep = keep or df.columns
    row = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], F.struct(*keep).alias("_row"))
    return df.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(key)]).agg(F.max(row).alias("_best")).select("_best._row.*")


def greedy_entries(df: DataFrame, daily: bool = False) -> DataFrame:
    """DED-01 to DED-03: usage entries merged in order of their ordinal, with sidechain replays.

    df: ord (unique, sortable), message_id, request_id, session, ts (text or number), is_sidechain, tokens,
    speed and cost. Rows without message_id pass. A row merges with an earlier one of the same message,
    session and request; else, when either is a sidechain, of the same message and session (and, but for
    daily, the same time). Daily adds the time to the first key where request_id is null. The better of the
    two stays, in the place of the first: no sidechain, then more tokens, then (daily) more cost, then
    having a speed, then the first.

    Groups without any sidechain row, nearly all, are settled by an aggregation. Only those with one are
    folded in order, a group being the copies of one message in one session: rows that are equal in all that
    the merge looks at are first reduced to one by aggregation, so that repeated delivery can't grow them.
    """
    columns = df.columns
    side = F.coalesce(F.col("is_sidechain"), F.lit(False))
    rank = [side.cast("int"), -F.coalesce(F.col("tokens"), F.lit(0)), *([-F.coalesce(F.col("cost"), F.lit(0.0)).cast("double")] if daily else []), F.col("speed").isNull().cast("int"), F.col("ord")]
    known = df.where("message_id is not null")
    sided = known.where(side).select("message_id", "session").distinct().withColumnsRenamed({"message_id": "_m", "session": "_s"})
    on = (F.col("message_id") == F.col("_m")) & F.col("session").eqNullSafe(F.col("_s"))
    time_key = F.when(F.col("request_id").isNull(), F.col("ts")) if daily else F.lit(None).cast("string")
    plain = known.join(sided, on, "left_anti")
    first = F.min("ord").alias("place")
    row = F.min(F.struct(*[r.alias(f"_{i}") for i, r in enumerate(rank)], F.struct(*columns).alias("_row"))).alias("_best")
    settled = plain.groupBy("message_id", "session", "request_id", time_key.alias("_t")).agg(row, first).select("_best._row.*", "place")
    reduced = known.join(sided, on, "left_semi").groupBy("message_id", "session", "request_id", "ts", *[r.alias(f"_r{i}") for i, r in enumerate(rank[:-1])]).agg(row, first).select("_best._row.*", "place")
    schema = T.StructType([*df.schema.fields, T.StructField("place", df.schema["ord"].dataType)])

    def better(new: dict, old: dict) -> bool:
        def value(r: dict) -> tuple:
            cost = (float(r["cost"] or 0),) if daily else ()
            return (not r["_side"], r["_tokens"], *cost, r["speed"] is not None)

        return value(new) > value(old)

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        kept: list[dict] = []
        for r in part.astype(object).where(part.notna(), None).sort_values("place").to_dict("records"):
            r["_side"], r["_tokens"] = bool(r["is_sidechain"]), int(r["tokens"] or 0)
            for k, old in enumerate(kept):
                same = old["request_id"] == r["request_id"] and (not daily or r["request_id"] is not None or old["ts"] == r["ts"])
                if same or ((old["_side"] or r["_side"]) and (daily or old["ts"] == r["ts"])):
                    if better(r, old):
                        kept[k] = {**r, "place": old["place"]}
                    break
            else:
                kept.append(r)
        return pd.DataFrame(kept, columns=schema.names)

    # The count uses the shuffle of the fold; what stands alone needs none.
    counted = reduced.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("message_id", "session")))
    folded = counted.where("_n > 1").drop("_n").groupBy("message_id", "session").applyInPandas(fold, schema)
    return df.where("message_id is null").withColumn("place", F.col("ord")).unionByName(settled).unionByName(counted.where("_n = 1").drop("_n")).unionByName(folded)


def merged_tiers(events: DataFrame, key: list[str], tier: str) -> DataFrame:
    """DED-04, DED-05: one row a key; of recorded service tiers standard wins over fast, fast over none."""
    rank = F.when(F.col(tier) == "standard", 0).when(F.col(tier) == "fast", 1).otherwise(2)
    return events.groupBy(*key).agg(F.min(F.struct(rank.alias("r"), F.col(tier).alias("t")))["t"].alias(tier), F.count(F.lit(1)).alias("copies"))


def without(rows: DataFrame, others: DataFrame, on: list[str]) -> DataFrame:
    """DED-09, DED-11, JOIN-15 to JOIN-17: rows whose key isn't among the others; null keys match nothing."""
    return rows.join(others.select(*on).distinct(), on, "left_anti")


def by_precedence(ranked: list[DataFrame], keys: list[list[str]]) -> DataFrame:
    """DED-11: sources in falling priority; a row is suppressed by an earlier source that shares any of the keys."""
    result, seen = ranked[0], ranked[0]
    for rows in ranked[1:]:
        for key in keys:
            rows = without(rows, seen.where(" and ".join(f"{k} is not null" for k in key)), key)
        result, seen = result.unionByName(rows), seen.unionByName(rows)
    return result


def after_last(rows: DataFrame, marks: DataFrame, key: list[str], at: str) -> DataFrame:
    """DED-12: rows later than the last mark of their key; rows of keys without a mark stay."""
    last = marks.groupBy(*key).agg(F.max(at).alias("_mark"))
    return rows.join(last, key, "left").where(F.col("_mark").isNull() | (F.col(at) > F.col("_mark"))).drop("_mark")


def migrated(old: DataFrame, new: DataFrame) -> DataFrame:
    """DED-10: rows of the new store, and those of the old without a match there: same session and message, else same content where the message is unknown."""
    kept = without(without(old, new.where("message_id is not null"), ["session", "message_id"]), new.where("message_id is null"), ["session", "content_id"])
    return new.unionByName(kept)


def connected(edges: DataFrame) -> DataFrame:
    """DED-13: (id, component), the least id each is linked to, over edges (id, key): ids that share any key are one.

    Labels of keys and ids are lowered in turn by partially aggregated minima, with pointer jumping, so the
    rounds grow with the logarithm of the longest chain; each round's labels go to a table in the shared
    folder. Neither pairs nor groups are formed, and nothing but a flag reaches the driver.
    """
    links = persisted(edges.where("id is not null and key is not null").select("id", "key").distinct(), "ded13-links")
    labels = persisted(links.groupBy("id").agg(F.min("id").alias("label")), "ded13-labels")
    while True:
        of_key = links.join(labels, "id").groupBy("key").agg(F.min("label").alias("low"))
        lowered = links.join(of_key, "key").groupBy("id").agg(F.min("low").alias("low"))
        jump = lowered.join(labels.select(F.col("id").alias("low"), F.col("label").alias("jumped")), "low", "left").select("id", F.least("low", "jumped").alias("new"))
        after = persisted(labels.join(jump, "id").select("id", F.col("new").alias("label"), (F.col("new") != F.col("label")).alias("moved")), "ded13-labels")
        labels = after.select("id", "label")
        if after.where("moved").isEmpty():
            return labels.withColumnRenamed("label", "component")


def merged_identities(rows: DataFrame, keys: list[str], maxima: list[str]) -> DataFrame:
    """DED-13: rows that share any of the identity keys become one: greatest of each counter, latest time and its labels."""
    edges = None
    for k in keys:
        part = rows.where(F.col(k).isNotNull()).select("id", F.concat(F.lit(f"{k}:"), F.col(k)).alias("key"))
        edges = part if edges is None else edges.unionByName(part)
    components = rows.join(connected(edges), "id", "left").withColumn("component", F.coalesce("component", "id"))
    return components.groupBy("component").agg(*[F.max(c).alias(c) for c in maxima], F.max("ts").alias("ts"), F.max(F.when(F.col("model").isNotNull(), F.struct("ts", "model")))["model"].alias("model"), F.count(F.lit(1)).alias("merged"))


def without_replay(child: DataFrame, parent: DataFrame, session: str, parent_of: str, order: list[str], same: list[str], forked: str | None = None, at: str | None = None) -> DataFrame:
    """DED-15, DED-16: a child session without the leading events that repeat its parent's in order.

    Both sides are numbered in their session; the n-th event of the child is a replay if it and all before
    it equal the parent's events of the same numbers. forked: the child's column of the time of its fork,
    after which nothing of the parent (at) was repeated. Sessions whose parent is unknown stay whole.
    """
    number = Window.partitionBy(session).orderBy(*order)
    ours = child.withColumn("_n", F.row_number().over(number))
    theirs = parent.select(F.col(session).alias(parent_of), F.row_number().over(number).alias("_n"), F.struct(*same).alias("_theirs"), *([F.max(at).over(number.rowsBetween(Window.unboundedPreceding, 0)).alias("_at")] if forked else []))
    matched = ours.join(theirs, [parent_of, "_n"], "left")
    agrees = F.struct(*same) == F.col("_theirs")
    if forked:
        agrees &= F.col(forked).isNull() | (F.col("_at") <= F.col(forked))
    matched = matched.withColumn("_same", F.coalesce(agrees, F.lit(False)))
    prefix = F.min(F.col("_same").cast("int")).over(number.rowsBetween(Window.unboundedPreceding, 0))
    return matched.withColumn("_replay", prefix == 1).where("not _replay").drop("_n", "_theirs", "_same", "_replay", "_at")


def without_burst(events: DataFrame, session: str, at_ms: str, pause_ms: int = 1000) -> DataFrame:
    """DED-15: without the dense leading burst of a replay: events up to the first pause over pause_ms, where there are at least two."""
    order = Window.partitionBy(session).orderBy(at_ms)
    step = F.col(at_ms) - F.lag(at_ms).over(order)
    calm = F.max((F.coalesce(step, F.lit(0)) > pause_ms).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = events.withColumn("_calm", calm)
    burst = marked.groupBy(session).agg(F.sum(1 - F.col("_calm")).alias("_lead"))
    return marked.join(burst, session).where((F.col("_calm") == 1) | (F.col("_lead") < 2)).drop("_calm", "_lead")


def claimed_cells(keys: DataFrame) -> DataFrame:
    """DED-18: verdict for each cell of overlapping machines.

    keys: date, agent, bucket, model, salt, machine, key. In the order of the machines a key belongs to the
    first that has it. A cell whose keys are all claimed already is suppressed; one with some is suspected.
    The claim is a partially aggregated minimum by key, joined back: a key is foreign if a lower machine has it.
    """
    cell = ["date", "agent", "bucket", "model", "salt"]
    distinct = keys.distinct()
    owner = distinct.groupBy(*cell, "key").agg(F.min("machine").alias("_owner"))
    share = distinct.join(owner, [*cell, "key"]).groupBy(*cell, "machine").agg(F.count(F.lit(1)).alias("keys"), F.sum((F.col("machine") > F.col("_owner")).cast("long")).alias("claimed"))
    return share.withColumn("verdict", F.when(F.col("claimed") == F.col("keys"), "suppressed").when(F.col("claimed") > 0, F.concat(F.lit("duplicateSuspected:"), F.floor(F.col("claimed") * 100 / F.col("keys")).cast("string"), F.lit("%"))).otherwise("kept"))

"""Lookups in small dimension tables: as-of, longest pattern, bounded containment, first candidate, claims, overrides.

Distinct names are resolved first, never each row: a fuzzy match runs over (distinct names x patterns),
both small, and rows then join on equality.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType


def as_of(rows: DataFrame, table: DataFrame, key: str, at: str, since: str, values: list[str]) -> DataFrame:
    """JOIN-05, STATE-02: for each row the values of its key's latest entry at or before its time, else null.

    Each entry gets the time its successor starts; the join is on the key with a range, which yields at
    most one entry a row, so no rows multiply and none are aggregated again.
    """
    names = {c: f"_{c}" for c in [key, since, *values]}
    marked = table.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(since, *values))).alias("_list"))
    pairs = F.transform("_list", lambda e, i: F.struct(e.alias("e"), F.get(F.col("_list"), (i + 1).cast("int")).getField(since).alias("until")))
    spans = marked.select(F.col(key).alias(names[key]), F.explode(pairs).alias("_s")).select(names[key], F.col(f"_s.e.{since}").alias(names[since]), F.col("_s.until").alias("_until"), *[F.col(f"_s.e.{v}").alias(names[v]) for v in values])
    on = (F.col(key) == F.col(names[key])) & (F.col(at) >= F.col(names[since])) & (F.col("_until").isNull() | (F.col(at) < F.col("_until")))
    return rows.join(spans, on, "left").select(*rows.columns, *[F.col(names[v]).alias(v) for v in values])


def resolved(rows: DataFrame, name: str, matches: DataFrame) -> DataFrame:
    """JOIN-01: rows with the match of their name; matches: name and its columns, one row a name."""
    return rows.join(matches, name, "left")


def longest_pattern(names: DataFrame, name: str, patterns: DataFrame) -> DataFrame:
    """JOIN-14: for each distinct name the pattern it contains that is longest; of equal lengths the last by ordinal.

    patterns: pattern, ordinal and values. The parts of each distinct name are listed and joined on
    equality, so no name is compared with every pattern.
    """
    distinct = names.select(name).where(F.col(name).isNotNull()).distinct().withColumn("_n", F.lower(name))
    starts = F.sequence(F.lit(1), F.greatest(F.length("_n"), F.lit(1)))
    parts = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.length("_n") - i + 1), lambda n: F.substring(F.col("_n"), i, n))))
    hit = distinct.select(name, F.explode(F.array_distinct(parts)).alias("_p")).join(patterns.withColumn("_p", F.lower("pattern")), "_p")
    best = hit.groupBy(name).agg(F.max(F.struct(F.length("pattern").alias("l"), "ordinal", *[c for c in patterns.columns if c != "ordinal"])).alias("_b"))
    return best.select(name, *[F.col(f"_b.{c}").alias(c) for c in patterns.columns if c != "ordinal"])


def normal(name: Column) -> Column:
    """FN-S1: lower case with . and @ as -."""
    return F.translate(F.lower(name), ".@", "--")


_PIECE = re.compile(r"[a-z0-9]+")


def bounded_parts(text: str | None) -> list[str]:
    """Parts of a normal name that begin and end at characters that aren't letters or digits, and that no version number follows but a date of eight digits."""
    words = list(_PIECE.finditer(text or ""))
    found = []
    for i, first in enumerate(words):
        for j in range(i, len(words)):
            after = words[j + 1][0] if j + 1 < len(words) else ""
            if not after.isdigit() or len(after) == 8:
                found.append(text[first.start() : words[j].end()])
    return found


@pandas_udf(ArrayType(StringType()))
def _parts(texts: pd.Series) -> pd.Series:
    return texts.map(bounded_parts)


def fuzzy(names: DataFrame, name: str, keys: DataFrame, key: str) -> DataFrame:
    """JOIN-02 to JOIN-04: (name, key) by equal text, else by containment at boundaries either way: the longest key, ties by the least.

    keys: key and exact (only equal text may match). Names are distinct first; the bounded parts of each
    side are joined on equality with the other.
    """
    distinct = names.select(F.col(name).alias("name")).where("name is not null").distinct().withColumn("_n", normal(F.col("name")))
    table = keys.select(F.col(key).alias("key"), F.coalesce("exact", F.lit(False)).alias("exact"), normal(F.col(key)).alias("_k"))
    same = distinct.join(table, F.col("_n") == F.col("_k")).select("name", "key", F.when(F.col("name") == F.col("key"), 0).otherwise(1).alias("_by"))
    open_keys = table.where("not exact")
    within = distinct.withColumn("_k", F.explode(_parts("_n"))).join(open_keys, "_k").select("name", "key", F.lit(2).alias("_by"))
    around = open_keys.withColumn("_n", F.explode(_parts("_k"))).join(distinct, "_n").select("name", "key", F.lit(2).alias("_by"))
    order = F.struct("_by", (-F.length("key")).alias("l"), "key")
    return same.unionByName(within).unionByName(around).groupBy("name").agg(F.min(order)["key"].alias("key"))


def first_candidate(rows: DataFrame, row_key: list[str], candidates: Column, table: DataFrame, key: str, values: list[str], positive: str | None = None) -> DataFrame:
    """JOIN-06: for each distinct row key the first of its candidate names that the table has (with a positive value, if asked)."""
    listed = rows.select(*row_key, candidates.alias("_c")).distinct().select(*row_key, F.posexplode("_c").alias("_pos", key))
    hits = listed.join(table if positive is None else table.where(F.col(positive) > 0), key)
    return hits.groupBy(*row_key).agg(F.min(F.struct("_pos", key, *values)).alias("_b")).select(*row_key, F.col(f"_b.{key}").alias(key), *[F.col(f"_b.{v}").alias(v) for v in values])


def strongest_claim(claims: DataFrame, name: str, strength: list[Column]) -> DataFrame:
    """JOIN-07: of several claims to one normal name the strongest, by falling columns; a partially aggregated maximum."""
    row = F.struct(*[s.alias(f"_{i}") for i, s in enumerate(strength)], F.struct(*claims.columns).alias("_row"))
    return claims.groupBy(F.col(name).alias("_name")).agg(F.max(row).alias("_b")).select("_b._row.*")


def grafted(primary: DataFrame, other: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """JOIN-08: rows that have none of the fields take all of them from the other table's row of the same key."""
    empty = F.lit(True)
    for f in fields:
        empty &= F.col(f).isNull()
    joined = primary.join(other.select(key, *[F.col(f).alias(f"_{f}") for f in fields]), key, "left")
    return joined.withColumns({f: F.when(empty, F.col(f"_{f}")).otherwise(F.col(f)) for f in fields}).select(*primary.columns)


def overridden(rows: DataFrame, overrides: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """JOIN-09: field by field the override's value where it has one."""
    joined = rows.join(overrides.select(key, *[F.col(f).alias(f"_{f}") for f in fields]), key, "left")
    return joined.withColumns({f: F.coalesce(F.col(f"_{f}"), F.col(f)) for f in fields}).select(*rows.columns)


def trace_context(spans: DataFrame, trace: str, value: str, priority: str, order: str) -> DataFrame:
    """JOIN-12: rows without a value take their trace's value of the best priority, the first in order."""
    best = spans.where(F.col(value).isNotNull() & F.col(trace).isNotNull()).groupBy(trace).agg(F.min(F.struct(priority, order, value))[value].alias("_v"))
    return spans.join(best, trace, "left").withColumn(value, F.coalesce(value, "_v")).drop("_v")

"""Schemas that drift between files: one table, and a report of each change (problem 5).

Every file's fields are profiled. Of two files in turn, the fields that are gone and those that are new get
value sketches over the records that both files hold; sketches, types and names give the weights of a
bipartite graph, from which plausible renames come. A plausible rename must stand the test of its values;
among those that do, the matching of greatest weight is taken.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from decimal import Decimal
from difflib import SequenceMatcher
from functools import lru_cache
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.operators.inlining import unique_names
from quillmill.runtime import persisted

_KEY = [T.StructField("stream_id", T.LongType()), T.StructField("file_no", T.IntegerType())]
SEEN = T.StructType([*_KEY, T.StructField("row_id", T.LongType()), T.StructField("id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("fraction", T.BooleanType())])
CELLS = T.StructType([T.StructField("row_id", T.LongType()), *_KEY, *[T.StructField(n, T.StringType()) for n in ("id", "name", "kind", "value")]])
EDGES = T.StructType([*_KEY, T.StructField("old_name", T.StringType()), T.StructField("new_name", T.StringType())])
WEIGHED = T.StructType([*EDGES.fields, T.StructField("weight", T.DoubleType())])
#: Classes of value hashes in a field's sketch, each of which keeps its least.
SKETCH = 16

def _kind_and_text(value: Any) -> tuple[str | None, str | None]:
    """JSON type and text of a member, null for null; equal numbers have equal texts."""
    if value is None:
        return None, None
    if isinstance(value, bool):
        return "boolean", str(value).lower()
    if isinstance(value, str):
        return "string", value
    if isinstance(value, (int, float, Decimal)):
        number = Decimal(value)
        if not number.is_finite():
            return "number", str(number)
        return "number", str(value) if isinstance(value, int) else str(number.normalize() + 0)
    return "array", json.dumps(value, sort_keys=True, default=str)


def _kind(value: Any) -> str | None:
    return None if value is None else "boolean" if isinstance(value, bool) else "string" if isinstance(value, str) else "number" if isinstance(value, (int, float, Decimal)) else "array"


def _leaves(members: dict) -> Iterator[tuple[str, Any]]:
    stack = [("", members)]
    while stack:
        prefix, held = stack.pop()
        for name, value in held.items():
            if isinstance(value, dict):
                stack.append((f"{prefix}{name}.", value))
            else:
                yield prefix + name, value


def _safe(text: str | None) -> str | None:
    return text if text is None or text.isascii() else text.encode("utf-8", "replace").decode()


def _record(payload: str | None) -> tuple[dict | None, str | None]:
    """(members, text of the id), or nothing for payloads that are null, unreadable or no object."""
    try:
        record = json.loads(payload, parse_float=Decimal)
    except (TypeError, ValueError, RecursionError):
        return None, None
    if not isinstance(record, dict):
        return None, None
    key = record.get("id")
    return record, None if key is None or isinstance(key, (dict, list)) else _safe(str(key))


def _placed(rows: DataFrame) -> DataFrame:
    return rows.select("row_id", F.col("stream_id").cast("long").alias("stream_id"), F.col("file_no").cast("int").alias("file_no"), "payload").where("payload is not null and stream_id is not null and file_no is not null")


def seen(rows: DataFrame) -> DataFrame:
    """What the payloads hold: a row for each record with its id, and one for each field and type of a file (some more than once).

    One pass; fields are reduced within each task, so that only ids, 20 bytes a record, are written in full.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields: dict[tuple, bool] = {}

        def flush() -> pa.RecordBatch:
            keys = list(fields)
            columns = [[k[j] for k in keys] for j in (0, 1)] + [[None] * len(keys)] * 2 + [[k[j] for k in keys] for j in (2, 3)] + [list(fields.values())]
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=SEEN.names)

        types = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_()]
        for batch in batches:
            streams, files, rows_, ids = [], [], [], []
            for row, stream, file, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                record, key = _record(payload)
                if record is None:
                    continue
                streams.append(stream)
                files.append(file)
                rows_.append(row)
                ids.append(key)
                for name, value in _leaves(record):
                    kind = _kind(value)
                    at = (stream, file, name if name.isascii() else _safe(name), kind)
                    fields[at] = fields.get(at, False) or isinstance(value, Decimal)
            none = [None] * len(ids)
            yield pa.record_batch([pa.array(c, t) for c, t in zip((streams, files, rows_, ids, none, none, none), types, strict=True)], names=SEEN.names)
            if len(fields) > 100_000:
                yield flush()
                fields.clear()
        yield flush()

    return _placed(rows).mapInArrow(scan, SEEN)


def cells(rows: DataFrame) -> DataFrame:
    """One row for each member that isn't an object: row, stream, file, the record's id, dotted path, type, text.

    Payloads that are null, unreadable or no object have no members; of repeated members the last counts.
    """

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row, stream, file, payload in zip(batch["row_id"], batch["stream_id"], batch["file_no"], batch["payload"], strict=True):
                record, key = _record(payload)
                if record is not None:
                    out += [(row, stream, file, key, _safe(name), kind, _safe(text)) for name, value in _leaves(record) for kind, text in (_kind_and_text(value),)]
            yield pd.DataFrame(out, columns=CELLS.names)

    return _placed(rows).mapInPandas(load, CELLS)


def profiles(held: DataFrame) -> DataFrame:
    """Types of each field of each file (of four at most), and whether its numbers have fractions."""
    return held.where("name is not null").groupBy("stream_id", "file_no", "name").agg(F.array_sort(F.collect_set("kind")).alias("kinds"), F.max("fraction").alias("fraction"))


def compared(profile: DataFrame) -> DataFrame:
    """Fields that differ from one file to the next, by the number of the later file: stream_id, file_no, name, role (gone, new or retyped), kinds."""
    key = ["stream_id", "file_no"]
    before = profile.select("stream_id", (F.col("file_no") + 1).alias("file_no"), "name", F.col("kinds").alias("old_kinds"))
    pairs = profile.select(*key).distinct().join(before.select(*key).distinct(), key)
    both = before.join(profile, [*key, "name"], "full_outer")
    retyped = (F.size("kinds") > 0) & (F.size("old_kinds") > 0) & (F.col("kinds") != F.col("old_kinds"))
    role = F.when(F.col("kinds").isNull(), "gone").when(F.col("old_kinds").isNull(), "new").when(retyped, "retyped")
    return both.select(*key, "name", role.alias("role"), F.coalesce("kinds", "old_kinds").alias("kinds")).where("role is not null").join(pairs, key, "left_semi")


def assign(weights: dict[tuple[str, str], float]) -> list[tuple[str, str]]:
    """The matching of old to new names of the greatest total weight (all over 0), by augmenting paths."""
    olds, news = sorted({a for a, _ in weights}), sorted({b for _, b in weights})
    held: dict[str, str] = {}
    for _ in olds:
        # Bellman-Ford from all free old names over edges of gain and, backwards, of loss.
        taken = {b: a for a, b in held.items()}
        best = {a: (0.0, [a]) for a in olds if a not in held}
        reach: dict[str, tuple[float, list[str]]] = {}
        for _ in range(len(olds) + 1):
            moved = False
            for (a, b), w in sorted(weights.items()):
                if a in best and held.get(a) != b and (b not in reach or best[a][0] + w > reach[b][0] + 1e-12):
                    reach[b] = (best[a][0] + w, [*best[a][1], b])
                    moved = True
                    if b in taken:
                        back = reach[b][0] - weights[taken[b], b]
                        if taken[b] not in best or back > best[taken[b]][0] + 1e-12:
                            best[taken[b]] = (back, [*reach[b][1], taken[b]])
            if not moved:
                break
        free = [(v, path) for b, (v, path) in reach.items() if b in news and b not in taken]
        if not free or max(free)[0] <= 0:
            break
        path = max(free)[1]
        for k in range(0, len(path) - 1, 2):
            held[path[k]] = path[k + 1]
    return sorted(held.items())


def touched(rows: DataFrame, held: DataFrame, differing: DataFrame) -> DataFrame:
    """stream_id, file_no (of the later file), role, name, kinds, id, low, high: filled values of gone and new fields in the records that both files hold.

    Ids of both files are joined first; only the payloads of their records are parsed again. Of records with
    one id in a file the least and the greatest (type, value) are kept, so one row an id and field remains.
    """
    key = ["stream_id", "file_no"]
    both = differing.where("role <> 'retyped'").groupBy(*key).agg(F.count_distinct("role").alias("n")).where("n = 2").select(*key)
    listed = held.where("id is not null").select(*key, "row_id", "id")
    older = listed.select("stream_id", (F.col("file_no") + 1).alias("file_no"), "row_id", "id").join(both, key, "left_semi")
    newer = listed.join(both, key, "left_semi")
    shared = older.join(newer, [*key, "id"], "left_semi").select("row_id", "file_no", F.lit("gone").alias("role")).unionByName(newer.join(older, [*key, "id"], "left_semi").select("row_id", "file_no", F.lit("new").alias("role")))
    shared = persisted(shared.withColumnRenamed("file_no", "later"), "p5-shared")
    again = cells(rows.join(shared.select("row_id").distinct(), "row_id", "left_semi")).where("kind is not null and id is not null")
    value = F.struct("kind", "value")
    placed = again.drop("file_no").join(shared, "row_id").withColumnRenamed("later", "file_no").join(differing.where("role <> 'retyped'"), [*key, "role", "name"])
    return placed.groupBy(*key, "role", "name", "kinds", "id").agg(F.min(value).alias("low"), F.max(value).alias("high"))


def sketches(values: DataFrame) -> DataFrame:
    """A sketch of each field: of a hash of (id, type, value), the least in each of 16 classes, and the number of values.

    Two fields with the same values on shared records agree in it; one of as many hashes as values is complete.
    """
    mark = F.xxhash64("id", "low.kind", "low.value")
    return values.groupBy("stream_id", "file_no", "role", "name", "kinds").agg(F.array_compact(F.array(*[F.min(F.when(F.pmod(mark, F.lit(SKETCH)) == k, mark)) for k in range(SKETCH)])).alias("sketch"), F.count(F.lit(1)).alias("n"))


@lru_cache(100_000)
def likeness(a: str, b: str) -> float:
    """Likeness of two names from 0 to 1, whatever their capitals and underscores."""
    return SequenceMatcher(None, a.lower().replace("_", ""), b.lower().replace("_", "")).ratio()


def plausible(sketch: DataFrame) -> DataFrame:
    """Edges with weights: gone and new fields of a file pair that may be one, by their profiles.

    The weight adds the share of common values in both sketches, equality of types and likeness of names. Two
    complete sketches without a common hash, or fields without a common type, have no agreeing values, so
    leaving them out loses nothing. A group has a row for each field that changed in one file, not for each
    record.
    """

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in WEIGHED]
            for stream, file, fields in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                gone, new = ([(f["name"], set(f["kinds"]), set(f["sketch"]), f["n"]) for f in fields if f["role"] == r] for r in ("gone", "new"))
                for a, kinds, first, m in gone:
                    for b, others, second, n in new:
                        common = len(first & second)
                        if kinds & others and (common or len(first) < m or len(second) < n):
                            weight = 1 + common / max(1, len(first | second)) + 0.5 * (kinds == others) + likeness(a, b)
                            for column, x in zip(out, (stream, file, a, b, weight), strict=True):
                                column.append(x)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.float64()), strict=True)], names=WEIGHED.names)

    fields = F.collect_list(F.struct("role", "name", "kinds", "sketch", "n"))
    return sketch.groupBy("stream_id", "file_no").agg(fields).mapInArrow(weigh, WEIGHED)


def agreeing(edges: DataFrame, values: DataFrame) -> DataFrame:
    """The test: edges of which all pairs of filled values in records of both files agree in type and value, with at least one pair."""
    key = ["stream_id", "file_no"]
    old, now = (values.where(F.col("role") == r).select(*key, "id", F.col("name").alias(f"{n}_name"), F.col("low").alias(f"{n}_low"), F.col("high").alias(f"{n}_high")) for r, n in (("gone", "old"), ("new", "new")))
    pairs = edges.join(old, [*key, "old_name"]).join(now, [*key, "new_name", "id"])
    same = (F.col("old_low") == F.col("new_low")) & (F.col("old_high") == F.col("new_low")) & (F.col("new_high") == F.col("new_low"))
    return pairs.groupBy(*edges.columns).agg(F.min(same).alias("_same")).where("_same").drop("_same")


def renames(values: DataFrame) -> DataFrame:
    """One-to-one renames: in each file pair the bipartite matching of greatest weight among the plausible edges that stand the test."""
    edges = persisted(plausible(sketches(values)), "p5-edges")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in EDGES]
            for stream, file, held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for a, b in assign({(e["old_name"], e["new_name"]): e["weight"] for e in held}):
                    for column, x in zip(out, (stream, file, a, b), strict=True):
                        column.append(x)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.string(), pa.string()), strict=True)], names=EDGES.names)

    return agreeing(edges, values).groupBy("stream_id", "file_no").agg(F.collect_list(F.struct("old_name", "new_name", "weight"))).mapInArrow(solve, EDGES)


def changes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stream_id, file_no, old_name, new_name of every change from the file before; the profiles of all files).

    Renamed: both names differ; removed: new_name is empty; added: old_name is empty; another set of types:
    the names are equal. Defined results: the first file of a stream, and one whose predecessor is missing,
    have no changes; a file without readable payloads has no fields and counts as missing; ids that are
    null, arrays or objects pair no records.
    """
    held = persisted(seen(rows), "p5-seen")
    profile = persisted(profiles(held), "p5-profiles")
    differing = persisted(compared(profile), "p5-differing")
    renamed = persisted(renames(persisted(touched(rows, held, differing), "p5-touched")), "p5-renames")
    key = ["stream_id", "file_no"]
    by_role = {r: differing.where(F.col("role") == r).select(*key, "name") for r in ("gone", "new", "retyped")}
    removed = by_role["gone"].join(renamed.withColumnRenamed("old_name", "name"), [*key, "name"], "left_anti").select(*key, F.col("name").alias("old_name"), F.lit("").alias("new_name"))
    added = by_role["new"].join(renamed.withColumnRenamed("new_name", "name"), [*key, "name"], "left_anti").select(*key, F.lit("").alias("old_name"), F.col("name").alias("new_name"))
    retyped = by_role["retyped"].select(*key, F.col("name").alias("old_name"), F.col("name").alias("new_name"))
    return renamed.unionByName(removed).unionByName(added).unionByName(retyped), profile


def lineage(change: DataFrame) -> DataFrame:
    """stream_id, name, since, until, first_name: the files in which a field that was renamed bears a name, and the first name it had.

    Each rename points to the one that gave its old name, if that is how the old name last came in; pointers
    are doubled until all chains have their first name, each round in a table, so no stream's changes meet
    in one task.
    """
    change = change.where("old_name <> new_name")
    renamed = change.where("old_name <> '' and new_name <> ''")
    event = lambda df, name, kind, after: df.select("stream_id", F.col(name).alias("name"), "file_no", F.lit(kind).alias("event"), F.lit(after).alias("_after"))
    events = event(renamed, "new_name", "in", 1).unionByName(event(change.where("old_name = ''"), "new_name", "add", 1)).unionByName(event(change.where("old_name <> ''"), "old_name", "out", 0))
    order = Window.partitionBy("stream_id", "name").orderBy("file_no", "_after")
    came = F.last(F.when(F.col("event") != "out", F.struct("event", "file_no")), True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    left = F.first(F.when(F.col("event") == "out", F.col("file_no")), True).over(order.rowsBetween(1, Window.unboundedFollowing))
    told = events.withColumns({"_came": came, "until": F.coalesce(left - 1, F.lit(2**31 - 1))})
    source = told.where("event = 'out'").select("stream_id", "file_no", F.col("name").alias("old_name"), F.when(F.col("_came.event") == "in", F.col("_came.file_no")).alias("up_file"))
    ends = told.where("event = 'in'").select("stream_id", "file_no", F.col("name").alias("new_name"), "until")
    links = renamed.join(source, ["stream_id", "file_no", "old_name"]).join(ends, ["stream_id", "file_no", "new_name"])
    links = persisted(links.select("stream_id", F.col("new_name").alias("name"), F.col("file_no").alias("since"), "until", F.col("old_name").alias("first_name"), F.when(F.col("up_file").isNotNull(), F.col("old_name")).alias("up_name"), "up_file"), "p5-lineage")
    while not links.where("up_file is not null").isEmpty():
        above = links.select("stream_id", F.col("name").alias("up_name"), F.col("since").alias("up_file"), F.col("first_name").alias("_first"), F.col("up_name").alias("_name"), F.col("up_file").alias("_file"))
        joined = links.join(above, ["stream_id", "up_name", "up_file"], "left")
        links = persisted(joined.select("stream_id", "name", "since", "until", F.coalesce("_first", "first_name").alias("first_name"), F.col("_name").alias("up_name"), F.col("_file").alias("up_file")), "p5-lineage")
    return links.select("stream_id", "name", "since", "until", "first_name")


def unified(rows: DataFrame, change: DataFrame, profile: DataFrame) -> DataFrame:
    """One consistent table: row_id, stream_id, file_no, a typed column for each field by its first name, and `others`.

    A column is bigint or double where all its values are numbers (whole or not), boolean where all are,
    else text, arrays as JSON. Where a name is added again while the renamed field lives on, the later one
    is kept as text in `others`, a map by its own name, as are whole numbers beyond bigint. Names that differ
    in capitals only, or clash with the keys, get a number. Payloads without members give no row.
    """
    key = ["stream_id", "file_no"]
    spans = lineage(change)
    named = profile.alias("p").join(spans.alias("s"), F.expr("p.stream_id = s.stream_id and p.name = s.name and p.file_no between s.since and s.until")).select("p.stream_id", "p.file_no", "p.name", "s.first_name")
    renamed = persisted(named, "p5-names")
    full = profile.join(renamed, [*key, "name"], "left").withColumn("column", F.coalesce("first_name", "name"))
    kinds = full.select("column", F.explode_outer("kinds").alias("kind"), "fraction").groupBy("column").agg(F.collect_set("kind").alias("kinds"), F.max("fraction").alias("fraction")).collect()  # a row a field of the table that is made
    types = {r["column"]: "string" if len(r["kinds"]) != 1 or r["kinds"][0] in ("string", "array") else "boolean" if r["kinds"][0] == "boolean" else "double" if r["fraction"] else "bigint" for r in sorted(kinds, key=lambda r: r["column"])}
    fixed = ["row_id", "stream_id", "file_no", "others"]
    columns = unique_names(list(types), fixed)
    schema = T.StructType([T.StructField("row_id", T.LongType()), *_KEY, *[T.StructField(columns[c], {"string": T.StringType(), "boolean": T.BooleanType(), "double": T.DoubleType(), "bigint": T.LongType()}[t]) for c, t in types.items()], T.StructField("others", T.MapType(T.StringType(), T.StringType()))])
    arrow = [pa.int64(), pa.int64(), pa.int32(), *[{"string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "bigint": pa.int64()}[t] for t in types.values()], pa.map_(pa.string(), pa.string())]
    maps = renamed.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("name", "first_name"))).alias("names"))  # the renamed fields of one file
    place = {c: k for k, c in enumerate(types)}

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, values, others = [[], [], []], [[] for _ in types], []
            for row, stream, file, payload, names in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                record, _ = _record(payload)
                if record is None:
                    continue
                names, held, rest = dict(names or ()), {}, {}
                # Renamed fields go first, so that a name added again is the one that yields.
                for name, value in sorted(_leaves(record), key=lambda m: _safe(m[0]) not in names):
                    name = _safe(name)
                    column = names.get(name, name)
                    kind, text = _kind_and_text(value)
                    typed = types[column]
                    out = _safe(text) if typed == "string" or text is None else value if typed == "boolean" else float(value) if typed == "double" else value
                    if column in held or (typed == "bigint" and out is not None and not -(2**63) <= out < 2**63):
                        rest[name] = _safe(text)
                    else:
                        held[column] = out
                for target, x in zip(heads, (row, stream, file), strict=True):
                    target.append(x)
                for column, k in place.items():
                    values[k].append(held.get(column))
                others.append(list(rest.items()))
            yield pa.record_batch([pa.array(v, t) for v, t in zip([*heads, *values, others], arrow, strict=True)], schema=pa.schema(list(zip(schema.names, arrow, strict=True))))

    return _placed(rows).join(maps, key, "left").select("row_id", *key, "payload", "names").mapInArrow(load, schema)

"""Nested records into flat tables with links to their parents (problem 3): shared inlining.

The schema graph is taken from the data (for JSON text, aggregated over all rows) or from the column's
type. Members that occur once are inlined into the row of their element, those of the record itself into
the root table; every array, and every object of so many member names that they must be data, becomes a
table of its own. Elements of one name that are reached by several ways, such as dotted and nested
writings of the same name or an element within itself, share one table. The primary key of a row is (key,
path), where path holds the position in each array from the outside in, none for the root; the foreign key
of its parent is the same without the last position.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.runtime import prepare

#: Member names of one object beyond which it is a map from names to values, a repeated element.
WIDEST = 1000


@dataclass
class Node:
    """What is found at one place: a plain value's type, members, items; open: several kinds that aren't told apart yet."""

    scalar: str | None = None
    members: dict[str, Node] = field(default_factory=dict)
    items: Node | None = None
    open: bool = False

    def add(self, kind) -> Node:
        """Take in a type as parse_variant_type gives it."""
        if isinstance(kind, tuple) and kind[0] == "object":
            for name, inner in kind[1].items():
                self.members.setdefault(name, Node()).add(inner)
        elif isinstance(kind, tuple):
            self.items = (self.items or Node()).add(kind[1])
        elif kind == "VARIANT":
            self.open = True
        elif kind != "VOID":
            self.scalar = kind if self.scalar in (None, kind) else "STRING"
        return self

    def merge(self, other: Node) -> Node:
        if other.scalar:
            self.add(other.scalar)
        for name, inner in other.members.items():
            self.members.setdefault(name, Node()).merge(inner)
        if other.items:
            self.items = (self.items or Node()).merge(other.items)
        return self


@dataclass
class Element:
    """A repeated element: where it stands in the parent, its inlined members with their types, the elements in it."""

    name: str
    places: list[list[str]] = field(default_factory=list)
    members: dict[str, list[list[str]]] = field(default_factory=dict)
    types: dict[str, str] = field(default_factory=dict)
    children: dict[str, Element] = field(default_factory=dict)
    named: bool = False


_TOKEN = re.compile(r"`(?:[^`]|``)*`|[A-Za-z0-9_$.\-]+(?:\(\d+(?:,\d+)?\))?|[<>:,]")


def parse_variant_type(text: str):
    """Nested tuples of a type as schema_of_variant_agg writes it: ('object', {...}), ('array', t) or a name."""
    tokens = _TOKEN.findall(text)
    open_: list[list] = []  # [members or None for an array, member name]
    at = 0
    while True:
        word = tokens[at]
        at += 1
        if at < len(tokens) and tokens[at] == "<" and word in ("OBJECT", "ARRAY"):
            at += 1
            if word == "ARRAY":
                open_.append([None, None])
                continue
            if tokens[at] != ">":
                open_.append([{}, tokens[at]])
                at += 2
                continue
            at += 1
            value = ("object", {})
        else:
            value = word
        while True:
            if not open_:
                return value
            members, name = open_[-1]
            if members is not None:
                members[name[1:-1].replace("``", "`") if name[0] == "`" else name] = value
                if tokens[at] == ",":
                    open_[-1][1] = tokens[at + 1]
                    at += 3
                    break
            at += 1
            value = ("array", value) if members is None else ("object", members)
            open_.pop()


def node_of_type(kind: T.DataType) -> Node:
    """The schema graph of a column's type; maps have no member names of their own."""
    if isinstance(kind, T.StructType):
        return Node(members={f.name: node_of_type(f.dataType) for f in kind.fields})
    if isinstance(kind, T.ArrayType):
        return Node(items=node_of_type(kind.elementType))
    return Node(scalar=kind.simpleString())


def _get(variant: Column, steps: list[str], kind: str) -> Column:
    """The value below the members named, in a type, or null."""
    path = "$"
    for k, name in enumerate(steps):
        if "'" in name and '"' in name:  # no path can name it
            inner = F.try_variant_get(variant, path, "map<string,variant>")[name]
            return _get(inner, steps[k + 1 :], kind)
        path += f"['{name}']" if "'" not in name else f'["{name}"]'
    return F.try_variant_get(variant, path, kind)


def _first(variant: Column, places: list[list[str]], kind: str) -> Column:
    found = [_get(variant, p, kind) for p in places]
    return F.coalesce(*found) if len(found) > 1 else found[0]


def _open_places(node: Node, steps: tuple = ()) -> list[tuple[Node, tuple]]:
    found = [(node, steps)] if node.open else []
    for name, inner in node.members.items():
        found += _open_places(inner, (*steps, name))
    return found + (_open_places(node.items, (*steps, None)) if node.items else [])


def _member(name: str):
    return lambda x: _get(x, [name], "variant")


def _values(variant: Column, steps: tuple) -> Column:
    """All values at a place, arrays on the way (None) taken apart."""
    values = F.array(variant)
    for step in steps:
        if step is None:
            values = F.flatten(F.filter(F.transform(values, lambda x: F.try_variant_get(x, "$", "array<variant>")), lambda x: x.isNotNull()))
        else:
            values = F.transform(values, _member(step))
    return values


def _placed(k: int):
    return lambda x: F.struct(F.lit(k).alias("place"), x.alias("value"))


def discover(df: DataFrame, variant: str) -> Node:
    """The schema graph of a variant column, merged over all rows by distributed aggregates.

    Where rows hold values of several kinds in one place, its objects, arrays and plain values are then
    aggregated apart, so that no odd row hides the members or items of the others. Each such pass settles
    one more level; without such places there is one pass. What reaches the driver is the schema itself.
    """
    row = df.agg(F.schema_of_variant_agg(F.col(variant))).first()
    root = Node().add(parse_variant_type(row[0]) if row and row[0] else "VOID")
    while places := _open_places(root):
        each = [F.transform(_values(F.col(variant), steps), _placed(k)) for k, (_, steps) in enumerate(places)]
        kinds = df.select(F.explode(F.flatten(F.array(*each))).alias("_x")).select("_x.*").where("value is not null").groupBy("place", F.substring_index(F.schema_of_variant("value"), "<", 1).alias("kind"))
        for node, _ in places:
            node.open = False
        for place, _, kind in kinds.agg(F.schema_of_variant_agg("value")).collect():  # a few kinds a place
            places[place][0].add(parse_variant_type(kind))
    return root


def graph_of(node: Node, name: str = "") -> Element:
    """The elements below one node, with names joined by dots."""
    element = Element(name)
    repeated: dict[str, tuple[Node, bool]] = {}

    def child(full: str, steps: list[str], inner: Node, named: bool) -> None:
        known = element.children.setdefault(full, Element(full))
        known.places.append(steps)
        repeated[full] = (repeated[full][0] if full in repeated else Node()).merge(inner), named

    def walk(at: Node, steps: list[str], full: str) -> None:
        if at.scalar or not (at.members or at.items):
            element.members.setdefault(full or "value", []).append(steps)
            element.types[full or "value"] = at.scalar or "STRING" if element.types.get(full or "value") in (None, at.scalar) else "STRING"
        if at.items:
            child(full or "items", steps, at.items, False)
        if len(at.members) > WIDEST:
            values = Node()
            for inner in at.members.values():
                values.merge(inner)
            child(full or "items", steps, values, True)
        else:
            for key, inner in at.members.items():
                walk(inner, [*steps, key], f"{full}.{key}" if full else key)

    walk(node, [], "")
    for full, (inner, named) in repeated.items():
        below = graph_of(inner, full)
        below.places, below.named = element.children[full].places, named
        element.children[full] = below
    return element


#: Columns of every table before its members.
LINKS = ["key", "path", "parent_path", "level"]


def unique_names(names: list[str], taken: list[str]) -> dict[str, str]:
    """Column names for members: their own, or with a number where another is the same but for capitals."""
    used, result = {t.lower() for t in taken}, {}
    for name in names:
        column, k = name, 2
        while column.lower() in used:
            column, k = f"{name}#{k}", k + 1
        used.add(column.lower())
        result[name] = column
    return result


def inline(rows: DataFrame, root: Element, typed: bool = False) -> dict[str, DataFrame]:
    """Tables by name, the root's being ''; rows: key and _v, a variant."""
    found: dict[str, list[tuple[DataFrame, Element, int]]] = {"": [(rows.select("key", F.array().cast("array<int>").alias("path"), F.lit(None).cast("array<int>").alias("parent_path"), "_v"), root, 0)]}

    def add(parent: DataFrame, element: Element, name: str, level: int) -> None:
        if element.named:
            held = parent.withColumn("_v", _first(F.col("_v"), element.places, "map<string,variant>"))
            exploded = held.select("key", F.col("path").alias("parent_path"), F.posexplode(F.transform(F.array_sort(F.map_keys("_v")), lambda k: F.struct(k.alias("name"), F.col("_v")[k].alias("v")))).alias("_pos", "_e")).select("key", "parent_path", "_pos", F.col("_e.name").alias("_name"), F.col("_e.v").alias("_v"))
        else:
            exploded = parent.select("key", F.col("path").alias("parent_path"), F.posexplode(_first(F.col("_v"), element.places, "array<variant>")).alias("_pos", "_v"))
        here = exploded.withColumn("path", F.concat("parent_path", F.array("_pos")))
        found.setdefault(name, []).append((here, element, level))
        for child_name, child in element.children.items():
            add(here, child, name if child_name == element.name else f"{name}/{child_name}", level + 1)

    for name, element in root.children.items():
        add(found[""][0][0], element, name, 1)
    tables = {}
    for name, levels in found.items():
        links = [*LINKS, *(["name"] if any(e.named for _, e, _ in levels) else [])]
        columns = unique_names([m for m in dict.fromkeys(m for _, e, _ in levels for m in e.members)], links)
        kinds = {m: {e.types[m] for _, e, _ in levels if m in e.types} for m in columns}
        table = None
        for df, element, level in levels:
            flat = [F.col("key"), F.col("path"), F.col("parent_path"), F.lit(level).alias("level"), *([F.col("_name").alias("name")] if element.named else [])]
            for member, column in columns.items():
                kind = next(iter(kinds[member])).lower() if typed and len(kinds[member]) == 1 else "string"
                flat.append((_first(F.col("_v"), element.members[member], kind) if member in element.members else F.lit(None).cast(kind)).alias(column))
            part = df.select(*flat)
            table = part if table is None else table.unionByName(part, allowMissingColumns=True)
        tables[name] = table
    return tables


def inline_json(df: DataFrame, key: str, text: str) -> dict[str, DataFrame]:
    """Tables of a JSON text column by element name, '' for the records themselves: key, path, parent_path, level and the inlined members as text.

    Defined results: null and empty texts, and those that rejected lists, give no rows; of a repeated member
    the last counts; null elements keep their position and have null members; an array that is absent, null
    or no array has no rows; an object where others have a plain value of that name shows as JSON text beside its own members; members whose names
    differ in capitals only, or clash with the links, get a number. An element within itself shares the
    table of the outer one, at a deeper level.
    """
    prepare(df.sparkSession)
    rows = df.select(F.col(key).alias("key"), F.try_parse_json(text).alias("_v")).where("_v is not null")
    return inline(rows, graph_of(discover(rows, "_v")))


def rejected(df: DataFrame, key: str, text: str) -> DataFrame:
    """key and text of the records that inline_json can't read: filled texts that are no JSON value."""
    prepare(df.sparkSession)
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.try_parse_json("text").isNull() & (F.trim("text") != ""))


def inline_column(df: DataFrame, key: str, column: str) -> dict[str, DataFrame]:
    """The same of a nested column, with the graph of its type, so without a pass over the data; members keep their types.

    Null, empty and absent arrays give no rows; null elements keep their position.
    """
    rows = df.select(F.col(key).alias("key"), F.to_variant_object(column).alias("_v")).where("_v is not null")
    return inline(rows, graph_of(node_of_type(df.select(column).schema[0].dataType)), typed=True)

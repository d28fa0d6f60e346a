"""Every registered query on the smallest tables, against its SQL where it has one."""

import ast
import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import ROOT, SMALL

QUERIES, SQL = entry.queries(), entry.oracle_sql()


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    return (None if math.isnan(v) else float(f"{v:.10g}")) if isinstance(v, float) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=str)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in Path(SMALL).glob("*.parquet"):
        c.execute(f"create view {f.stem} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    data = df.collect()
    assert len(set(df.columns)) == len(df.columns)
    if name in SQL:
        cursor = duck.execute(SQL[name])
        columns = [d[0] for d in cursor.description]
        assert sorted(columns) == sorted(df.columns)
        assert rows(df.columns, data) == rows(columns, cursor.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_streamed_blocks_are_those_of_the_batch(spark):
    batch = {(r["key"], r["start_ms"], r["from_ms"], r["to_ms"]) for r in QUERIES["WIN_01_blocks"](spark, SMALL).collect()}
    stream = {(r["key"], r["start_ms"], r["from_ms"], r["to_ms"]) for r in QUERIES["STR_04_blocks"](spark, SMALL).collect()}
    assert stream == batch


def test_nothing_imports_the_text_operators():
    for file in (ROOT / "quillmill").rglob("*.py"):
        if "llm" in file.parts:
            continue
        for node in ast.walk(ast.parse(file.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), file

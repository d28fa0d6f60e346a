"""Shared inlining where records are odd."""

from pyspark.sql import functions as F

from quillmill.operators import inlining


def as_dicts(df):
    return sorted(({k: v for k, v in r.asDict().items() if v is not None} for r in df.collect()), key=str)


def test_root_table_and_links(spark):
    df = spark.createDataFrame([(1, '{"cost": 2, "sub": [{"n": "a", "sub": [{"n": "b"}]}, null]}'), (2, '{"cost": 3}'), (3, None), (4, ""), (5, "{bad")], "row_id int, t string")
    tables = inlining.inline_json(df, "row_id", "t")
    assert sorted(tables) == ["", "sub"]
    assert as_dicts(tables[""]) == [{"key": 1, "path": [], "level": 0, "cost": "2"}, {"key": 2, "path": [], "level": 0, "cost": "3"}]
    child = tables["sub"]
    assert sorted((r["key"], r["path"], r["parent_path"], r["level"], r["n"]) for r in child.collect()) == [(1, [0], [], 1, "a"), (1, [0, 0], [0], 2, "b"), (1, [1], [], 1, None)]
    parents = tables[""].unionByName(child, allowMissingColumns=True).select("key", F.col("path").alias("parent_path"))
    assert child.join(parents, ["key", "parent_path"], "left_anti").count() == 0
    assert [r["key"] for r in inlining.rejected(df, "row_id", "t").collect()] == [5]


def test_repeated_members_keep_the_record(spark):
    df = spark.createDataFrame([(1, '{"sub": [1], "sub": [{"n": 1}, {"n": 2, "n": 3}]}'), (2, '{"sub": [{"n": 4}]}')], "row_id int, t string")
    assert sorted((r["key"], r["path"], r["n"]) for r in inlining.inline_json(df, "row_id", "t")["sub"].collect()) == [(1, [0], "1"), (1, [1], "3"), (2, [0], "4")]


def test_odd_rows_hide_nothing(spark):
    odd = ['{"steps": "x"}', '{"steps": [7, {"calls": 1}]}', '{"g": {"a": 1}}', '{"g": "x"}', '{"steps": [{"calls": [{"n": 5}, "y", [1]]}]}']
    df = spark.createDataFrame(list(enumerate(odd)), "row_id int, t string")
    tables = inlining.inline_json(df, "row_id", "t")
    assert sorted((r["key"], r["path"], r["n"]) for r in tables["steps/calls"].where("n is not null").collect()) == [(4, [0, 0], "5")]
    assert sorted((r["key"], r["path"], r["value"]) for r in tables["steps"].where("value is not null").collect())[0] == (1, [0], "7")
    root = {r["key"]: r for r in tables[""].collect()}
    assert root[0]["steps"] == "x" and root[2]["g.a"] == "1" and root[3]["g"] == "x"


def test_names_that_clash_or_are_data(spark):
    wide = "{" + ",".join(f'"id{k}": {{"n": {k}}}' for k in range(inlining.WIDEST + 5)) + "}"
    df = spark.createDataFrame([(1, '{"path": 1, "Key": 2, "a": 3, "A": 4, "q\'\\"": 5}'), (2, f'{{"by": {wide}}}')], "row_id int, t string")
    tables = inlining.inline_json(df, "row_id", "t")
    one = tables[""].where("key = 1").first().asDict()
    assert one["path"] == [] and sorted(v for k, v in one.items() if isinstance(v, str)) == ["1", "2", "3", "4", "5"]
    assert tables["by"].count() == inlining.WIDEST + 5 and tables["by"].where("name = 'id7'").first()["n"] == "7"


def test_columns_go_through_the_same_graph(spark):
    df = spark.sql("select 1 as id, named_struct('m', 'x', 'u', named_struct('it', array(named_struct('n', 5L, 'deep', array(1, 2)), null))) as c union all select 2, null")
    tables = inlining.inline_column(df, "id", "c")
    assert sorted(tables) == ["", "u.it", "u.it/deep"] and dict(tables["u.it"].dtypes)["n"] == "bigint"
    assert sorted((r["path"], r["n"]) for r in tables["u.it"].collect()) == [([0], 5), ([1], None)]
    assert sorted((r["path"], r["value"]) for r in tables["u.it/deep"].collect()) == [([0, 0], 1), ([0, 1], 2)]


def test_empty(spark):
    df = spark.createDataFrame([], "row_id int, t string")
    assert inlining.inline_json(df, "row_id", "t")[""].count() == 0

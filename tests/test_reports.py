"""Tables and reports of small entry tables."""

import json

import pytest
from pyspark.sql import functions as F

from quillmill import sinks
from quillmill.operators import blocks, redelivery, sync
from quillmill.options import Options
from quillmill.plans import reports
from quillmill.sources.entries import entries

DAY = 86_400_000


@pytest.fixture(scope="module")
def rows(spark):
    data = [("claude", "s1", DAY, "m1", 10, 5, 1.5), ("claude", "s1", DAY + 1000, "m2", 20, 6, 0.25), ("codex", "2026/a", 3 * DAY, "m1", 100, 0, None)]
    df = spark.createDataFrame(data, "agent string, s string, ts long, m string, i long, o long, cost double")
    return entries(df, "x", ts_ms=F.col("ts"), session_id=F.col("s"), project_path=F.col("s"), model=F.col("m"), input_tokens=F.col("i"), output_tokens=F.col("o"), stored_cost=F.col("cost")).withColumn("agent", F.when(F.col("session_id") == "s1", "claude").otherwise("codex"))


def test_tables_of_each_report(rows):
    text = sinks.report_table("agent", reports.periods(rows, "daily").collect(), "Daily")
    assert text.startswith("Daily") and "1970-01-02" in text and "- m1" in text and "- m2" in text and "Total" in text and "$1.75" in text and "141" in text
    text = sinks.report_table("unified", reports.unified(rows, "daily").collect(), cost=False)
    assert "claude" in text and "codex" in text and "$" not in text
    found = blocks.blocks(rows.withColumn("cost", F.coalesce("stored_cost", F.lit(0.0))), "ts_ms")
    text = sinks.report_table("blocks", found.collect(), gaps=blocks.gaps(found).collect())
    assert text.index("1970-01-02 00:00") < text.index("gap") < text.index("1970-01-04 00:00")
    text = sinks.report_table("session", reports.sessions(rows).collect())
    assert "s1" in text and "1970-01-02 00:00" in text
    assert "m1" in sinks.report_table("codex", reports.codex(rows, "monthly").collect())
    assert "| Total  *|" not in sinks.report_table("agent", []) and sinks.report_table("agent", []).count("\n") == 2


def test_codex_sessions_name_file_and_folder(rows):
    found = reports.codex(rows.where("agent = 'codex'"), "session").first()
    assert (found["session_file"], found["directory"], found["models"]["m1"]["input_tokens"]) == ("a", "2026", 100)


def test_blocks_against_a_limit(rows):
    found = reports.block_report(rows, Options(token_limit="max", now_ms=3 * DAY + 1000)).collect()
    assert [(r["token_limit"], r["limit_status"], r["active"]) for r in found] == [(41, "warning", False), (41, "exceeds", True)]
    assert [r["limit_status"] for r in reports.block_report(rows, Options(token_limit=1000, now_ms=3 * DAY, recent=True)).collect()] == ["ok", "ok"]
    assert reports.block_report(rows, Options(recent=True, now_ms=9 * DAY)).count() == 0
    with pytest.raises(ValueError):
        Options(token_limit=0)


def test_json_rows(spark):
    df = spark.createDataFrame([(1, 2.0, 'q"', None), (2, 2.5, None, [1])], "a int, b double, c string, d array<int>")
    assert sorted(r["value"] for r in sinks.json_rows(df).collect()) == sorted(['{"a":1,"b":2,"c":"q\\""}', '{"a":2,"b":2.5,"d":[1]}'])
    assert all(json.loads(r["value"]) for r in sinks.json_rows(df).collect())


def test_content_hash_ignores_order_but_no_cell(spark):
    cells = [("m", "a", "2026-01-01", b, "x", b, 1, 0.5, 1, ["k"]) for b in range(50)]
    schema = "machine string, agent string, utc_date string, bucket int, model string, input_tokens long, output_tokens long, cost double, messages long, keys array<string>"
    hashed = lambda rows: sync.content_hash(spark.createDataFrame(rows, schema).repartition(3)).first()["hash"]
    assert hashed(cells) == hashed(cells[::-1]) and len({hashed(cells), hashed(cells[1:]), hashed([*cells, cells[0]])}) == 3


def test_stored_and_new_messages(spark):
    key, known = [redelivery.bare(F.col("m")), F.col("q")], F.col("m").isNotNull()
    stored = spark.createDataFrame([(1, "a", "x", 9), (2, "b", None, 9), (3, None, "x", 9)], "row_id long, m string, q string, extra int")
    new = spark.createDataFrame([(4, " a", "x"), (5, "c", "x"), (6, "c ", "x"), (7, "b", None), (8, None, "x"), (9, "a", None)], "row_id long, m string, q string")
    assert sorted(r["row_id"] for r in redelivery.exactly_once([stored, new], "row_id", key, known).collect()) == [1, 2, 3, 5, 8, 9]
    assert sorted(r["row_id"] for r in redelivery.to_append(stored.drop("extra"), new, "row_id", key, known).collect()) == [5, 8, 9]
    assert redelivery.to_append(stored.limit(0), new.limit(0), "row_id", key, known).count() == 0

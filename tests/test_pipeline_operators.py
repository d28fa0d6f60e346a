"""The operators of p1 to p7 against row-at-a-time versions, and their edge cases."""

import json
import random
import re
import time
from datetime import datetime

import brute
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import SMALL
from quillmill.functions import grammar
from quillmill.functions.hilbert import hilbert_codes
from quillmill.functions.instants import convert
from quillmill.operators import compaction, drift, inlining, instants, pauses, recovery, redelivery
from quillmill.plans import pipeline_queries as P
from quillmill.runtime import table


def got(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


# --- p2 -------------------------------------------------------------------------------------------------------


def one(value, zone="UTC", received="2026-10-25 12:00:00"):
    us = int(pd.Timestamp(received).value // 1000) if received else None
    r = convert(pd.Series([value]), pd.Series([zone]), pd.Series([us], dtype="Int64"))[0]
    return None if pd.isna(r) else int(r)


@pytest.mark.parametrize(
    ("value", "zone", "expected"),
    [
        ("2026-10-02T16:54:52.360", "Asia/Tokyo", "2026-10-02T07:54:52.360"),
        ("2026-10-02T17:03:52.807+10:00", None, "2026-10-02T07:03:52.807"),
        ("2026-10-02T16:01:36-0330", None, "2026-10-02T19:31:36"),
        ("Fri, 02 Oct 2026 16:57:15 +1000", None, "2026-10-02T06:57:15"),
        ("2 Oct 2026 16:27:54 +00:00", None, "2026-10-02T16:27:54"),
        ("20261002T112420Z", None, "2026-10-02T11:24:20"),
        ("2026-10-02T12:24:31,015Z", None, "2026-10-02T12:24:31.015"),
        ("2026-10-02 22:58:46 EDT", "UTC", "2026-10-03T02:58:46"),
        ("2026-10-02 14:14:23.283 Europe/Berlin", "UTC", "2026-10-02T12:14:23.283"),
        ("10/02/2026 12:49:02 AM", "UTC", "2026-10-02T00:49:02"),
        ("10/02/2026 12:49:02 PM", "UTC", "2026-10-02T12:49:02"),
        ("02.10.2026 14:22", "Europe/Berlin", "2026-10-02T12:22:00"),
        ("2026-10-15T12:48+00:00", None, "2026-10-15T12:48:00"),
        ("1790936711529", None, "2026-10-02T10:25:11.529"),
        ("1790936711", None, "2026-10-02T10:25:11"),
        ("1790936711529123", None, "2026-10-02T10:25:11.529123"),
        ("1790936711529123456", None, "2026-10-02T10:25:11.529123"),
        ("1790936711.5291", None, "2026-10-02T10:25:11.5291"),
        ("[1790936711, 5000000]", None, "2026-10-02T10:25:11.005"),
        ('{"seconds":1790936711,"nanos":529000000}', None, "2026-10-02T10:25:11.529"),
        ("  2026-10-02T16:54:52Z  ", None, "2026-10-02T16:54:52"),
    ],
)
def test_writings(value, zone, expected):
    assert one(value, zone) == int(pd.Timestamp(expected).value // 1000)


@pytest.mark.parametrize("value", [None, "", " ", "-", "NaN", "null", "unknown", "Invalid Date", "0000-00-00 00:00:00", "2026-02-30T00:00:00Z", "2026-13-01T00:00:00Z", "2026-01-01T25:00:00Z", "2026-01-01T00:00:60Z", "2026-01-01", "13/13/2026 01:00:00 AM", "10/02/2026 13:00:00 PM", "123", "99999999999999999999", "2026-10-02 10:00:00 XYZ", "2026-10-02 10:00:00 Mars/Base", "x" * 5000, '{"minutes":1790936711,"nanos":5}', "２０２６-01-01T00:00:00Z"])
def test_no_instant(value):
    assert one(value) is None


def test_clock_changes():
    twice = "2026-10-25 02:30:00"
    assert one(twice, "Europe/Berlin", "2026-10-25 00:30:10") == int(pd.Timestamp("2026-10-25 00:30:00").value // 1000)
    assert one(twice, "Europe/Berlin", "2026-10-25 01:30:10") == int(pd.Timestamp("2026-10-25 01:30:00").value // 1000)
    assert one(twice, "Europe/Berlin", None) == int(pd.Timestamp("2026-10-25 00:30:00").value // 1000)
    assert one("2026-03-29 02:30:00", "Europe/Berlin") is None
    assert one("2026-10-02 10:00:00", None) is None and one("2026-10-02 10:00:00", "No/Where") is None


@settings(max_examples=60, deadline=None)
@given(st.datetimes(datetime(2021, 1, 1), datetime(2029, 12, 31)), st.sampled_from(["Europe/Berlin", "America/New_York", "Australia/Sydney", "Asia/Kathmandu", "America/Sao_Paulo"]))
def test_local_times_agree_with_brute_force(at, zone):
    text = at.strftime("%Y-%m-%d %H:%M:%S")
    r = one(text, zone, "2030-01-01")
    assert (None if r is None else r // 1000) == brute.instant(text, zone, datetime(2030, 1, 1))


def test_p2_against_brute_force(spark):
    zones = {r["machine_id"]: r["timezone"] for r in table(spark, SMALL, "commands").collect()}
    expected = set()
    for t, c in P.TIMES.items():
        for r in table(spark, SMALL, t).select("row_id", "machine_id", c, "received_at").collect():
            x = brute.instant(r[2], zones.get(r[1]), r[3])
            if x is not None and not re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{3}Z", r[2]):
                expected.add((t, r[0], x))
    assert set(map(tuple, P.p2_found(spark, SMALL).collect())) == expected


@pytest.mark.parametrize(
    ("local", "zone", "utc"),
    [("2045-07-01 12:00:00", "Europe/Berlin", "2045-07-01T10:00:00"), ("9998-01-01 12:00:00", "Europe/Berlin", "9998-01-01T11:00:00"), ("2600-07-01 12:00:00", "America/New_York", "2600-07-01T16:00:00"), ("1944-07-01 12:00:00", "Europe/Berlin", "1944-07-01T10:00:00"), ("1850-07-01 12:00:00", "Europe/Berlin", "1850-07-01T11:06:32")],
)
def test_years_without_bounds(local, zone, utc):
    found = convert(pd.Series([local, local + " " * 500]), pd.Series([zone] * 2), pd.Series([None] * 2, dtype="float"))
    assert found.tolist() == [int(datetime.fromisoformat(utc + "+00:00").timestamp()) * 1_000_000] * 2


def test_other_zone_data_is_an_error():
    with pytest.raises(RuntimeError):
        convert(pd.Series(["2025-07-01 12:00:00"]), pd.Series(["Europe/Berlin"]), pd.Series([None], dtype="float"), "1999a")


def test_instants_keep_rows_and_clashing_columns(spark):
    df = spark.sql("select * from values ('a', '2026-10-02 10:00:00', timestamp'2026-10-02 12:00:00', 1, 2), (null, '2026-10-02T10:00:00.000Z', null, 1, 2), ('z', null, null, 1, 2) t(machine_id, at, received_at, _zone2, utc)")
    commands = spark.sql("select 'a' as machine_id, 'Asia/Tokyo' as timezone, named_struct('sessionLength', 2.0D) as blocks")
    out = instants.with_instants(df, instants.machine_settings(commands), "at")
    assert out.columns == ["machine_id", "at", "received_at", "_zone2", "utc", "utc_ms"]
    assert got(out, "machine_id", "utc_ms") == [("a", 1790902800000), ("z", None), (None, 1790935200000)]
    assert instants.with_instants(df.limit(0), instants.machine_settings(commands.limit(0)), "at").count() == 0


# --- p7 -------------------------------------------------------------------------------------------------------


def test_sessions_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.choice("abc"), rng.randrange(0, 40) * rng.choice([1, 7, 50])) for _ in range(600)] + [("d", 5)] * 3
    gaps = {"a": 0, "b": 7, "c": 60, "d": 1000}
    df = spark.createDataFrame([(k, t, gaps[k]) for k, t in rows], "k string, t long, g long")
    assert set(got(pauses.sweep_sessions(df, "k", "t", F.col("g")), "k", "start_ms", "end_ms", "n_rows")) == brute.sessions(rows, gaps)


def test_sessions_edges(spark):
    df = spark.createDataFrame([("a", 0, 10), ("a", 10, 10), ("a", 21, 10), ("b", None, 10), (None, 5, None), ("c", -25, -3), ("c", -25, -3), ("c", -24, -3)], "k string, t long, g long")
    assert got(pauses.sweep_sessions(df, "k", "t", F.col("g")), "k", "start_ms", "end_ms", "duration_ms", "n_rows") == [("a", 0, 10, 10, 2), ("a", 21, 21, 0, 1), ("c", -24, -24, 0, 1), ("c", -25, -25, 0, 2), (None, 5, 5, 0, 1)]
    assert pauses.sweep_sessions(df.limit(0), "k", "t", F.col("g")).count() == 0
    assert df.select(pauses.gap_of_hours(F.lit(None).cast("double"))).first()[0] == 18_000_000


def test_hot_key_shrinks_before_the_shuffle(spark):
    hot = spark.range(200_000).select(F.lit("hot").alias("k"), (F.col("id") * 10).alias("t"))
    found = pauses.sweep_sessions(hot, "k", "t", F.lit(3_600_000)).collect()
    assert [(r["start_ms"], r["end_ms"], r["n_rows"]) for r in found] == [(0, 1_999_990, 200_000)]


# --- p6 -------------------------------------------------------------------------------------------------------


def test_redelivery(spark):
    rows = [(1, "a", "r", "s"), (2, " a\t", "r", "s"), (3, "a", None, "s"), (4, "a", None, "s "), (5, None, "r", "s"), (6, None, "r", "s"), (7, "a", "r", None), (8, "", "r", "s"), (9, "  ", "r", "s"), (10, "b", "r", "s")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "row_id long, i string, r string, s string, _keep2 string")
    key = [redelivery.bare(F.col(c)) for c in "irs"]
    again = redelivery.repetitions(df, "row_id", key, F.col("i").isNotNull())
    assert got(again, "row_id") == [(2,), (4,), (9,)] and again.columns == df.columns
    assert sorted(r["row_id"] for r in redelivery.exactly_once(df, "row_id", key, F.col("i").isNotNull()).collect()) == [1, 3, 5, 6, 7, 8, 10]
    empty = df.limit(0)
    assert redelivery.exactly_once(empty, "row_id", key, F.col("i").isNotNull()).count() == 0


def test_redelivery_covers_the_table(spark):
    rows = table(spark, SMALL, "chat").count()
    found, kept = P.p6_found(spark, SMALL), P.p6_kept(spark, SMALL)
    assert found.count() + kept.count() == rows and found.join(kept, "row_id").count() == 0
    hot = spark.range(50_000).select(F.col("id").alias("row_id"), F.lit("m").alias("i"))
    assert redelivery.repetitions(hot, "row_id", [F.col("i")], F.lit(True)).count() == 49_999


# --- p1 -------------------------------------------------------------------------------------------------------


def test_hilbert_is_a_walk():
    side = 16
    x, y = (k.ravel() for k in np.meshgrid(np.arange(side), np.arange(side)))
    order = np.argsort(hilbert_codes(x, y, 4))
    walk = list(zip(x[order].tolist(), y[order].tolist(), strict=True))
    assert sorted(hilbert_codes(x, y, 4)) == list(range(side * side))
    assert all(abs(a[0] - b[0]) + abs(a[1] - b[1]) == 1 for a, b in zip(walk, walk[1:], strict=False))


def files(spark, *rows):
    return spark.createDataFrame([(i, m, p, c) for i, m, p, c in rows], "file_id long, machine_id string, path string, content string")


def test_records_and_current_files(spark):
    df = files(
        spark,
        (1, "m", "archived_sessions/a", "x\n"), (2, "m", "sessions/a", "﻿one\r\n\r\n  \ntwo three\n"), (3, "m", "sessions/a", "y"), (4, "n", "sessions/a", "z"), (5, "m", "p", None), (6, "m", "q", ""), (7, "m", "r", "﻿   "), (8, None, "sessions/a", "k"), (9, None, "sessions/a", "k"),
    )
    current = compaction.current_files(df)
    assert sorted(r["file_id"] for r in current.collect()) == [2, 4, 5, 6, 7, 8, 9]
    assert got(compaction.records_of(current), "file_id", "line_no", "record") == [(2, 1, "one"), (2, 4, "two three"), (4, 1, "z"), (8, 1, "k"), (9, 1, "k")]


def test_compaction_balances_hot_sessions(spark):
    rows = [(k, "m", f"projects/p/{k}.jsonl", "\n".join(json.dumps({"sessionId": "hot" if k % 3 else f"s{k}", "n": j, "t": "x" * 50}) for j in range(30))) for k in range(90)]
    done = compaction.compact(files(spark, *rows), target_bytes=20_000)
    sizes = [r["b"] for r in spark.read.parquet(done.path).groupBy(F.input_file_name()).agg(F.sum(F.octet_length("record")).alias("b")).collect()]
    assert done.records == 2700 and len(sizes) == done.files and max(sizes) < 1.4 * sum(sizes) / len(sizes)
    assert compaction.compact(files(spark, *rows).limit(0)).records == 0


@pytest.mark.parametrize("target", [20_000, 200_000])
def test_compaction_keeps_sessions_together(spark, target):
    """A session lies in as few files as the cuts allow, and a file in one range of the curve."""
    df = table(spark, SMALL.replace("0.001", "0.01"), "log_files")
    done = compaction.compact(df, target)
    written = spark.read.parquet(done.path)
    pairs = written.select("session", F.input_file_name().alias("f")).distinct()
    sessions, files_ = pairs.select("session").distinct().count(), pairs.select("f").distinct().count()
    assert files_ > 1 and pairs.count() <= sessions + files_ - 1
    sizes = [r["b"] for r in written.groupBy(F.input_file_name()).agg(F.sum(F.octet_length("record") + 1).alias("b")).collect()]
    whole = max(r[0] for r in df.select(F.octet_length("content")).where("content is not null").collect())
    assert max(sizes) <= sum(sizes) / done.files + whole


def test_p1_keeps_every_record_once(spark):
    expected = set()
    best = {}
    rows = table(spark, SMALL, "log_files").collect()
    for r in rows:
        late = r["path"].startswith("archived_")
        k = (r["machine_id"], r["path"].removeprefix("archived_"))
        best[k] = min(best.get(k, (True, 10**9)), (late, r["file_id"]))
    for r in rows:
        if r["file_id"] in {x for _, x in best.values()}:
            expected |= {(r["file_id"], n) for n, line in enumerate(re.split("\r?\n", (r["content"] or "").removeprefix("﻿")), 1) if line.strip()}
    found = [tuple(r) for r in P.p1_found(spark, SMALL).collect()]
    assert len(found) == len(set(found)) and set(found) == expected


# --- p3 -------------------------------------------------------------------------------------------------------


def test_graph_shares_elements():
    tree = inlining.parse_variant_type("OBJECT<a: OBJECT<steps: ARRAY<OBJECT<n: BIGINT, calls: ARRAY<OBJECT<k: STRING>>>>>, `a.steps`: ARRAY<OBJECT<n: VARIANT, m: DECIMAL(3,1)>>, s: STRING>")
    root = inlining.graph_of(inlining.Node().add(tree))
    assert list(root.members) == ["s"] and list(root.children) == ["a.steps"]
    steps = root.children["a.steps"]
    assert steps.places == [["a", "steps"], ["a.steps"]] and steps.types["m"] == "DECIMAL(3,1)" and set(steps.members) == {"n", "m"} and list(steps.children) == ["calls"]


def test_inlining(spark):
    texts = ['{"u":[{"w":{"t":1}},null,{"w":null,"u":[{"w":{"t":"7"}},{"x":1}]}]}', '{"u":[]}', '{"u":null}', "{}", "broken", None, '{"u":[{"w":{"t":{"intValue":"3"}}}],"u2":1}', '{"a":1,"a":2}']
    df = spark.createDataFrame(list(enumerate(texts)), "row_id int, j string")
    tables = inlining.inline_json(df, "row_id", "j")
    assert list(tables) == ["", "u"]
    assert got(tables[""], "key", "u2", "a") == [(0, None, None), (1, None, None), (2, None, None), (3, None, None), (6, "1", None), (7, None, "2")]
    assert got(tables["u"], "key", "path", "parent_path", "level", "`w.t`", "`w.t.intValue`") == [
        (0, [0], [], 1, "1", None), (0, [1], [], 1, None, None), (0, [2, 0], [2], 2, "7", None), (0, [2, 1], [2], 2, None, None), (0, [2], [], 1, None, None), (6, [0], [], 1, '{"intValue":"3"}', "3"),
    ]
    assert [t.count() for t in inlining.inline_json(df.limit(0), "row_id", "j").values()] == [0]


def test_p3_has_no_repeated_rows(spark):
    found = got(P.p3_found(spark, SMALL))
    assert len(found) == len(set(found)) and {r[0] for r in found} == {"chat", "trace", "statusline"}


# --- p4 -------------------------------------------------------------------------------------------------------

GOOD = "976571bd-b2a9-4007-ac57-c7009a2bdb17,2026-10-01T04:55:59.170Z,r,m,model,proj,1,2,0.5"


@pytest.mark.parametrize(
    ("fmt", "line", "reason"),
    [
        ("csv", GOOD, None), ("csv", GOOD.replace("0.5", ""), None), ("csv", GOOD.replace("0.5", "4.2e-05"), None), ("csv", GOOD.replace("proj", '"a, ""b""\nc"'), None), ("csv", GOOD.replace("proj", '"open'), "syntax"), ("csv", GOOD.replace("proj", 'a "b" c'), "syntax"),
        ("csv", GOOD.replace("proj", '"a"b'), "syntax"), ("csv", GOOD + ",x", "shape"), ("csv", "", "shape"), ("csv", GOOD.replace(",1,", ",-1,"), "value"), ("csv", GOOD.replace(",1,", ",１,"), "value"), ("csv", GOOD.replace(",1,", ",9223372036854775808,"), "value"), ("csv", GOOD.replace(",1,", ",9223372036854775807,"), None),
        ("csv", GOOD.replace("0.5", "inf"), "value"), ("csv", GOOD.replace("0.5", "-0.5"), "value"), ("csv", GOOD + "\n" + GOOD, "syntax"), ("csv", None, "syntax"), ("xml", GOOD, "syntax"),
        ("jsonl", '{"timestamp":"t","sessionId":"s","message":{"usage":{"input_tokens":1,"output_tokens":2}}}', None), ("jsonl", '{"timestamp":"t","sessionId":"s","costUSD":null,"message":{"usage":{"input_tokens":1,"output_tokens":2}}} ', None),
        ("jsonl", '{"timestamp":"t","message":{"usage":{"input_tokens":1,"output_tokens":2}}}', "shape"), ("jsonl", '{"timestamp":"t","sessionId":"s","message":null}', "shape"), ("jsonl", '{"timestamp":"t","sessionId":"s","message":{"usage":{"input_tokens":1.0,"output_tokens":2}}}', "value"),
        ("jsonl", '{"timestamp":"t","sessionId":"s","costUSD":"0.1","message":{"usage":{"input_tokens":1,"output_tokens":2}}}', "value"), ("jsonl", '{"timestamp":"t","sessionId":"s","message":{"usage":{"input_tokens":null,"output_tokens":2}}}', "value"), ("jsonl", "[1]", "syntax"), ("jsonl", "", "syntax"), ("jsonl", "{} {}", "syntax"), ("jsonl", '{"a":1,}', "syntax"), ("jsonl", "{'a':1}", "syntax"), ("jsonl", '{"a":01}', "syntax"), ("jsonl", '{"a":NaN}', "syntax"), ("jsonl", '{"a":"\t"}', "syntax"), ("jsonl", "[" * 100_000, "syntax"),
    ],
)
def test_reasons(fmt, line, reason):
    assert recovery.load_record(line, fmt)[0][0] == reason


def test_any_depth_and_any_number_of_digits():
    good = '{"timestamp":"t","sessionId":"s","message":{"usage":{"input_tokens":%s,"output_tokens":2}}%s}'
    for depth in (401, 100_000):
        assert recovery.load_record(good % (1, ',"x":' + "[" * depth + "]" * depth), "jsonl")[0][0] is None
    assert recovery.load_record(good % ("9" * 5000, ""), "jsonl")[0][0] == "value"
    assert recovery.load_record(GOOD.replace(",1,", "," + "0" * 5000 + "7,"), "csv")[0][9:11] == [7, 2]


def test_records_within_a_broken_line_are_recovered(spark):
    good = '{"timestamp":"t","sessionId":"s","message":{"usage":{"input_tokens":1,"output_tokens":2}}}'
    lines = [("csv", GOOD.replace("proj", '"broken') + "\n" + GOOD), ("jsonl", '{"a":[\n' + good + "\n" + good + "\n]"), ("csv", GOOD), ("jsonl", good + "\n" + good), ("jsonl", "{")]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(lines)], "line_id long, fmt string, line string")
    assert got(recovery.recovered(df), "line_id", "part", "at") == [(0, 2, lines[0][1].index("\n") + 1), (1, 2, 7), (1, 3, 8 + len(good)), (3, 1, 0), (3, 2, len(good) + 1)]
    assert got(recovery.refused(df), "line_id", "reason") == [(0, "syntax"), (1, "syntax"), (3, "syntax"), (4, "syntax")]


@pytest.mark.parametrize("text", ['{"a":\n' * 50_000, "[1,\n" * 50_000, '{"a":1}\n{' * 20_000])
def test_the_search_for_anchors_is_linear(text):
    start = time.perf_counter()
    assert recovery.load_record(text, "jsonl")[0][0] == "syntax"
    recovery.load_record('"x\n' + (GOOD[:37] + '"\n') * 20_000, "csv")
    assert time.perf_counter() - start < 20


def test_recovery_resumes_at_the_next_record():
    text = "\n".join([GOOD, GOOD.replace("proj", '"broken'), GOOD, "a,b", GOOD.replace("proj", '"two\nlines"'), GOOD])
    out = list(recovery.load_text(text, "csv"))
    assert [r[0] for r in out] == [None, "syntax", None, "shape", None, None] and out[1][1:3] == [text.index('"two') + 1, "text after a closing quote"]
    lone = "\n".join([GOOD, GOOD.replace("proj", '"broken'), GOOD])
    assert [r[:3] for r in recovery.load_text(lone, "csv")][1] == ["syntax", lone.index('"broken'), "quote not closed"]
    good = '{"timestamp":"t","sessionId":"s","message":{"usage":{"input_tokens":1,"output_tokens":2}}}'
    assert [r[0] for r in recovery.load_text("\n".join([good, '{"a":"open', good]), "jsonl")] == [None, "syntax", None]


json_values = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda c: st.lists(c, max_size=4) | st.dictionaries(st.text(), c, max_size=4), max_leaves=12)


def plain(v):
    if isinstance(v, grammar.Number):
        return float(v)
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    return [plain(x) for x in v] if isinstance(v, list) else v


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.text(), json_values, max_size=4), st.integers(0, 200))
def test_grammar_agrees_with_json(value, cut):
    text = json.dumps(value, ensure_ascii=cut % 2 == 0)
    assert plain(grammar.json_record(text, 0)[0]) == plain(json.loads(text, parse_int=grammar.Number, parse_float=grammar.Number))
    part = text[:cut]
    try:
        known = isinstance(json.loads(part), dict)
    except ValueError:
        known = False
    try:
        grammar.json_record(part, 0)
        assert known
    except grammar.Broken:
        assert not known


def test_p4_rows_are_split_without_loss(spark):
    lines = table(spark, SMALL, "chat_lines").count()
    assert P.p4_found(spark, SMALL).count() + P.p4_loaded(spark, SMALL).count() == lines
    assert recovery.load_lines(table(spark, SMALL, "chat_lines").limit(0)).count() == 0


# --- p5 -------------------------------------------------------------------------------------------------------


def store(spark, *rows):
    return spark.createDataFrame([(k, s, f, p if p is None or isinstance(p, str) else json.dumps(p)) for k, (s, f, p) in enumerate(rows)], "row_id long, stream_id long, file_no int, payload string")


def test_changes(spark):
    df = store(
        spark,
        (1, 1, {"id": "a", "x": 1, "t": {"i": 5}, "gone": 1, "k": 2}), (1, 1, {"id": "b", "x": 2, "t": {"i": 6}, "k": 3}), (1, 2, {"id": "b", "y": 2, "t": {"o": "6"}, "k": "3", "n": None}), (1, 2, {"id": "c", "y": 9, "k": "4"}),
        (1, 4, {"id": "z"}), (2, 1, {"id": "a", "p": 1, "q": 1}), (2, 2, {"id": "a", "r": 1, "s": 2}), (3, 1, "broken"), (3, 2, None), (3, 3, "[1]"), (None, 1, {"id": "q"}),
    )
    change, _ = drift.changes(df)
    assert got(change, "stream_id", "file_no", "old_name", "new_name") == [
        (1, 2, "", "n"), (1, 2, "", "t.o"), (1, 2, "gone", ""), (1, 2, "k", "k"), (1, 2, "t.i", ""), (1, 2, "x", "y"), (2, 2, "", "s"), (2, 2, "p", "r"), (2, 2, "q", ""),
    ]
    assert drift.changes(df.limit(0))[0].count() == 0


def test_matching_is_the_best():
    rng = random.Random(1)
    for _ in range(300):
        olds, news = [f"o{k}" for k in range(rng.randint(1, 4))], [f"n{k}" for k in range(rng.randint(1, 4))]
        weights = {(a, b): rng.randint(1, 9) for a in olds for b in news if rng.random() < 0.7}

        def best(rest, used):
            return 0 if not rest else max([best(rest[1:], used), *(weights[rest[0], b] + best(rest[1:], used | {b}) for b in news if (rest[0], b) in weights and b not in used)])  # noqa: B023

        found = drift.assign(weights)
        assert len({a for a, _ in found}) == len({b for _, b in found}) == len(found)
        assert sum(weights[p] for p in found) == best(olds, frozenset())


def test_contested_fields_go_by_sketch_type_and_name(spark):
    """Fields whose shared values all agree with several others: the matching decides, and no partner is lost."""
    df = store(
        spark,
        (1, 1, {"id": "a", "in_tokens": 5, "out_tokens": 5, "flag": True}), (1, 1, {"id": "b", "in_tokens": None, "out_tokens": 7, "flag": None}),
        (1, 2, {"id": "a", "outTokens": 5, "inTokens": 5, "flag2": True, "one": 5}), (1, 2, {"id": "b", "outTokens": 7, "inTokens": None, "one": 8}),
    )
    change, _ = drift.changes(df)
    assert got(change, "old_name", "new_name") == [("", "one"), ("flag", "flag2"), ("in_tokens", "inTokens"), ("out_tokens", "outTokens")]


def test_matching_sees_every_file_pair(spark, monkeypatch):
    solved = []
    monkeypatch.setattr(drift, "agreeing", lambda edges, values, test=drift.agreeing: solved.append(edges.count()) or test(edges, values))
    df = store(spark, *[(s, f, {"id": f"r{s}", f"name{f}": s, "k": 1}) for s in range(20) for f in (1, 2, 3)])
    assert drift.changes(df)[0].count() == 40 and solved == [40]


def test_large_sketches_lose_no_rename(spark):
    df = store(spark, *[(1, f, {"id": f"r{k}", f"n{f}": None if k % 3 == f else k}) for k in range(300) for f in (1, 2)], *[(2, f, {"id": f"r{k}", f"n{f}": k if k < 299 else f}) for k in range(300) for f in (1, 2)])
    assert got(drift.changes(df)[0], "stream_id", "old_name", "new_name") == [(1, "n1", "n2"), (2, "", "n2"), (2, "n1", "")]


def test_unified_table_is_typed_and_follows_renames(spark):
    df = store(spark, (1, 1, {"id": "a", "x": 1, "b": True}), (1, 2, {"id": "a", "y": 1, "f": 1.5, "b": False}), (1, 3, {"id": "a", "z": 1, "x": 7, "f": 2, "l": [1]}), (2, 1, {"id": 5, "X": "t"}), (2, 2, None))
    out = drift.unified(df, *drift.changes(df))
    assert dict(out.dtypes) == {"row_id": "bigint", "stream_id": "bigint", "file_no": "int", "X": "string", "b": "boolean", "f": "double", "id": "string", "l": "string", "x#2": "bigint", "others": "map<string,string>"}
    assert got(out, "stream_id", "file_no", "id", "X", "`x#2`", "f", "b", "l") == [(1, 1, "a", None, 1, None, True, None), (1, 2, "a", None, 1, 1.5, False, None), (1, 3, "a", None, 1, 2.0, None, "[1]"), (2, 1, "5", "t", None, None, None, None)]
    assert [r["others"] for r in out.where("file_no = 3").collect()] == [{"x": "7"}]
    assert drift.unified(df.limit(0), *drift.changes(df.limit(0))).count() == 0


def test_long_chains_of_renames(spark):
    df = store(spark, *[(1, f, {"id": "a", f"n{f}": 1}) for f in range(1, 12)])
    assert got(drift.lineage(drift.changes(df)[0]), "name", "since", "until", "first_name") == sorted([(f"n{f}", f, f if f < 11 else 2**31 - 1, "n1") for f in range(2, 12)], key=str)



"""De-duplication, blocks, lookups, sync, options and sinks against plain versions and on edge cases."""

import json
import random
import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from quillmill import sinks
from quillmill.functions import usage as U
from quillmill.operators import blocks, compare, dedupe, deltas, lookups, summarize, sync
from quillmill.options import Options, bound, last_periods


def got(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


# --- de-duplication -------------------------------------------------------------------------------------------

ENTRY = "ord long, message_id string, request_id string, session string, ts string, is_sidechain boolean, tokens long, speed string, cost double"


def greedy(rows, daily):
    """The merge in order, row by row."""
    kept = []
    for r in sorted(rows):
        o, m, q, s, t, side, tokens, speed, cost = r
        if m is None:
            kept.append((o, r))
            continue
        for k, (place, old) in enumerate(kept):
            if old[1] != m or old[3] != s:
                continue
            same = old[2] == q and (not daily or q is not None or old[4] == t)
            if same or ((old[5] or side) and (daily or old[4] == t)):
                def value(x):
                    return (not x[5], x[6], *((x[8],) if daily else ()), x[7] is not None)

                if value(r) > value(old):
                    kept[k] = (place, r)
                break
        else:
            kept.append((o, r))
    return sorted((r[0], place) for place, r in kept)


@pytest.mark.parametrize("daily", [False, True])
def test_greedy_merge(spark, daily):
    rng = random.Random(5)
    for n, sides in ((30, [None, False]), (40, [None, False, True])):
        rows = [(k, rng.choice(["a", "b", None]), rng.choice(["r", "q", None]), rng.choice(["s", "t"]), rng.choice("123"), rng.choice(sides), rng.randrange(4), rng.choice([None, "fast"]), float(rng.randrange(3))) for k in range(n)]
        df = spark.createDataFrame(rows, ENTRY)
        assert got(dedupe.greedy_entries(df, daily), "ord", "place") == sorted(greedy(rows, daily), key=str)


def test_greedy_examples(spark):
    rows = [(1, "m", "r", "s", "1", False, 5, None, 0.0), (2, "m", "r", "s", "2", False, 9, None, 0.0), (3, "m", "x", "s", "1", True, 99, None, 0.0), (4, "m", "x", "s", "7", True, 1, None, 0.0), (5, None, "r", "s", "1", False, 5, None, 0.0), (6, None, "r", "s", "1", False, 5, None, 0.0), (7, "m", None, "z", "1", None, 1, None, 0.0), (8, "m", None, "z", "1", None, 1, "fast", 0.0)]
    df = spark.createDataFrame(rows, ENTRY)
    assert got(dedupe.greedy_entries(df), "ord", "place") == [(2, 1), (3, 3), (5, 5), (6, 6), (8, 7)]
    assert got(dedupe.greedy_entries(df, daily=True), "ord", "place") == [(2, 1), (5, 5), (6, 6), (8, 7)]
    assert dedupe.greedy_entries(df.limit(0)).count() == 0


def test_first_and_last(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 3, "z"), (None, 1, "w"), ("a", 1, "y")], "k string, o int, v string")
    assert got(dedupe.keep_best(df, [F.col("k")], [F.col("o"), F.col("v")])) == [("a", 1, "y"), (None, 1, "w")]
    assert got(dedupe.keep_last(df, [F.col("k")], [F.col("o"), F.col("v")])) == [("a", 2, "x"), (None, 3, "z")]


def test_components(spark):
    rng = random.Random(2)
    edges = [(f"i{a:03d}", f"k{rng.randrange(90)}") for a in range(100) for _ in range(rng.randrange(1, 3))] + [(f"c{n:03d}", f"p{n}") for n in range(60)] + [(f"c{n + 1:03d}", f"p{n}") for n in range(60)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, k in edges:
        parent[find("K" + k)] = find(a)
    least = {}
    for a, _ in edges:
        least[find(a)] = min(least.get(find(a), a), a)
    found = dict(got(dedupe.connected(spark.createDataFrame(edges, "id string, key string"))))
    assert found == {a: least[find(a)] for a, _ in edges}


def test_claims_in_machine_order(spark):
    rows = [("d", "a", 1, "m", "s", mach, key) for mach, keys in (("A", "xy"), ("B", "yz"), ("C", "xz"), ("D", "q")) for key in keys] + [("d", "a", 1, "m", "other", "B", "x")]
    df = spark.createDataFrame(rows, "date string, agent string, bucket int, model string, salt string, machine string, key string")
    assert got(dedupe.claimed_cells(df), "salt", "machine", "verdict") == [("other", "B", "kept"), ("s", "A", "kept"), ("s", "B", "duplicateSuspected:50%"), ("s", "C", "suppressed"), ("s", "D", "kept")]


def test_burst_and_replay(spark):
    df = spark.createDataFrame([("s", 0), ("s", 20), ("s", 40), ("s", 5000), ("s", 5010), ("t", 0), ("t", 9000)], "s string, at long")
    assert got(dedupe.without_burst(df, "s", "at")) == [("s", 5000), ("s", 5010), ("t", 0), ("t", 9000)]
    parent = spark.createDataFrame([("p", 1, "a"), ("p", 2, "b"), ("p", 3, "c")], "s string, n int, v string")
    child = spark.createDataFrame([("c", "p", 1, "a"), ("c", "p", 2, "b"), ("c", "p", 3, "x"), ("c", "p", 4, "c"), ("o", "gone", 1, "a")], "s string, of string, n int, v string")
    assert got(dedupe.without_replay(child, parent, "s", "of", ["n"], ["v"]), "s", "n") == [("c", 3), ("c", 4), ("o", 1)]


def test_migration_and_precedence(spark):
    schema = "id int, session string, message_id string, content_id string"
    old = spark.createDataFrame([(1, "s", "m", "c"), (2, "s", "n", "d"), (3, "s", None, "e"), (4, "t", "m", "c")], schema)
    new = spark.createDataFrame([(9, "s", "m", "q"), (8, "s", None, "d")], schema)
    assert got(dedupe.migrated(old, new), "id") == [(3,), (4,), (8,), (9,)]


# --- blocks ---------------------------------------------------------------------------------------------------


def cut(times, length):
    out, start, last = [], None, None
    for t in sorted(times):
        if start is None or (t != last and (t - start > length or t - last > length)):
            start = t - t % 3_600_000
            out.append([start, t, t, 0])
        out[-1][2], out[-1][3], last = t, out[-1][3] + 1, t
    return [tuple(b) for b in out]


@pytest.mark.parametrize("hours", [5.0, 1.0, 0.01, 0.0123456])
def test_blocks_against_brute_force(spark, hours):
    rng = random.Random(7)
    times = [rng.randrange(0, 200_000_000) for _ in range(300)] + [3_600_000 * k for k in range(0, 40, 3)] + [18_000_000, 18_000_000, 18_000_001] + [-5, -3_600_001]
    rows = [(t, 1, 0, 0, 0, 1.0, "m") for t in times] + [(None, 1, 0, 0, 0, 1.0, "m")]
    df = spark.createDataFrame(rows, "at long, input_tokens long, output_tokens long, cache_creation_tokens long, cache_read_tokens long, cost double, model string")
    found = blocks.blocks(df, "at", hours)
    assert [tuple(r) for r in found.orderBy("start_ms", "from_ms").select("start_ms", "from_ms", "to_ms", "entries").collect()] == cut(times, int(hours * 3_600_000))
    assert blocks.blocks(df.limit(0), "at").count() == 0


def test_gaps_rates_and_status(spark):
    df = spark.createDataFrame([(0, 100), (600_000, 200), (90_000_000, 5)], "at long, input_tokens long").selectExpr("at", "input_tokens", "0L as output_tokens", "0L as cache_creation_tokens", "0L as cache_read_tokens", "cast(input_tokens as double) as cost", "'m' as model")
    found = blocks.blocks(df, "at", now_ms=90_000_500)
    assert got(blocks.gaps(found), "start_ms", "end_ms") == [(18_600_000, 90_000_000)]
    rated = blocks.burn_rate(found)
    assert got(rated, "start_ms", "tokens_per_minute", "cost_per_hour") == [(0, 30.0, 1800.0), (90_000_000, None, None)]
    assert found.where("active").count() == 1 and blocks.largest_completed(found).first()[0] == 300
    assert got(blocks.projection(rated, 300_000).where("start_ms = 0"), "projected_tokens", "minutes_left") == [(9150, 295)]
    assert [spark.range(1).select(blocks.limit_status(F.lit(t), F.lit(100))).first()[0] for t in (80, 81, 100, 101)] == ["ok", "warning", "warning", "exceeds"]


# --- lookups --------------------------------------------------------------------------------------------------


def plain_fuzzy(names, keys):
    norm = lambda x: x.lower().replace(".", "-").replace("@", "-")

    def within(a, b):
        for m in re.finditer(rf"(?<![a-z0-9])(?={re.escape(b)}(?![a-z0-9]))", a):
            after = re.match(r"[^a-z0-9]+([a-z0-9]+)", a[m.start() + len(b) :])
            if not after or not after[1].isdigit() or len(after[1]) == 8:
                return True
        return False

    out = {}
    for n in names:
        best = []
        for k, exact in keys:
            if n == k or norm(n) == norm(k):
                best.append((0 if n == k else 1, -len(k), k))
            elif not exact and (within(norm(n), norm(k)) or within(norm(k), norm(n))):
                best.append((2, -len(k), k))
        if best:
            out[n] = min(best)[2]
    return out


def test_fuzzy_match(spark):
    names = ["vel-3", "vel-3-mini", "vendor/vel-3.1", "vel-3-20260101", "VEL@3", "xvel-3", "tess-70-fast", "nothing", "quill-4-think"]
    keys = [("vel-3", False), ("vel-3-mini", False), ("vel-3-1", True), ("tess-70", False), ("a/quill-4-think", False), ("quill-4", True), ("vel", False)]
    found = dict(got(lookups.fuzzy(spark.createDataFrame([(n,) for n in names + [None]], "n string"), "n", spark.createDataFrame(keys, "k string, exact boolean"), "k")))
    assert found == plain_fuzzy(names, keys) and found["vel-3-20260101"] == "vel-3" and "xvel-3" not in found


def test_as_of_and_candidates(spark):
    rows = spark.createDataFrame([("a", 5), ("a", 10), ("a", 99), ("b", 5), (None, 5)], "k string, at int")
    entries = spark.createDataFrame([("a", 10, 1.0), ("a", 50, 2.0), ("b", 6, 3.0)], "k string, since int, v double")
    assert got(lookups.as_of(rows, entries, "k", "at", "since", ["v"])) == [("a", 10, 1.0), ("a", 5, None), ("a", 99, 2.0), ("b", 5, None), (None, 5, None)]
    rates = spark.createDataFrame([("x", 0.0), ("y", 2.0)], "name string, rate double")
    one = spark.createDataFrame([("m",)], "m string")
    assert got(lookups.first_candidate(one, ["m"], F.array(F.lit("x"), F.lit("y")), rates, "name", ["rate"])) == [("m", "x", 0.0)]
    assert got(lookups.first_candidate(one, ["m"], F.array(F.lit("x"), F.lit("y")), rates, "name", ["rate"], "rate")) == [("m", "y", 2.0)]


def test_longest_pattern_takes_the_last_of_equals(spark):
    patterns = spark.createDataFrame([("ab", 1, "one"), ("bc", 2, "two"), ("c", 3, "three")], "pattern string, ordinal int, tier string")
    names = spark.createDataFrame([("xABCx",), ("c",), ("zzz",), (None,), ("",)], "n string")
    assert got(lookups.longest_pattern(names, "n", patterns), "n", "tier") == [("c", "three"), ("xABCx", "two")]


def test_counterfactual(spark):
    usage = spark.createDataFrame([("a", 10, 5.0), ("b", 20, 1.0)], "model string, tokens long, cost double")
    mapping = spark.createDataFrame([("a", "p", "pa"), ("a", "q", "qa"), ("b", "q", "qb"), ("a", "z", "za")], "model string, provider string, target string")
    rates = spark.createDataFrame([("pa", 0.1), ("qa", 0.2), ("qb", 0.3)], "target string, rate double")
    assert [(r["provider"], r["actual"], r["other"], r["excluded"]) for r in compare.counterfactual(usage, mapping, rates).collect()] == [("p", 5.0, 1.0, 1), ("q", 6.0, 8.0, 0), ("z", None, None, 2)]


# --- summaries and functions ----------------------------------------------------------------------------------


def test_summary_order_and_ties(spark):
    rows = [("k", 3, "b", 1.0), ("k", 1, "a", 1.0), ("k", 2, "c", 5.0), ("k", 9, None, 7.0), (None, 1, "a", 1.0)]
    df = spark.createDataFrame(rows, "k string, o int, model string, cost double").selectExpr("*", *[f"1L as {c}" for c in summarize.COUNTERS])
    out = {r["k"]: r for r in summarize.summarize(df, ["k"], F.col("o")).collect()}
    assert out["k"]["models"] == ["a", "c", "b"] and [b["model"] for b in out["k"]["breakdown"]] == ["c", "a", "b"] and out["k"]["cost"] == 14.0 and out[None]["total_tokens"] == 4
    assert summarize.totals(df.limit(0)).first()["input_tokens"] == 0


def test_tiers_at_the_boundary(spark):
    df = spark.createDataFrame([(199_999,), (200_000,), (200_001,)], "t long")
    assert [r[0] for r in df.select(U.marginal(F.col("t"), F.lit(1), F.lit(2))).collect()] == [199_999, 200_000, 200_002]
    assert [r[0] for r in df.select(U.whole_request(F.lit(10), F.col("t"), F.lit(1), F.lit(2), F.lit(200_000))).collect()] == [10, 10, 20]
    big = spark.createDataFrame([(2**63 - 1,), (5,)], "t long")
    assert big.agg(U.capped_sum(F.col("t"))).first()[0] == 2**63 - 1


def test_calendar(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(U.iso_week(F.lit("2027-01-01").cast("date"))) == "2026-W53"
    assert str(one(U.week_start(F.lit("2026-01-09").cast("date"), 0))) == "2026-01-04" and str(one(U.week_start(F.lit("2026-01-09").cast("date"), 1))) == "2026-01-05"
    assert one(U.floor_hour(F.lit(-1))) == -3_600_000 and one(U.quarter(F.lit(86_400_000 + 900_000))) == 1
    assert one(U.peak(F.lit(1767231000000))) is True and one(U.peak(F.lit(1767232800000 + 7_200_000))) is False
    assert one(U.finalised(F.lit("2026-01-01").cast("date"), F.lit(1767312000000 + 48 * 3_600_000))) is False and one(U.finalised(F.lit("2026-01-01").cast("date"), F.lit(1767312000001 + 48 * 3_600_000))) is True
    assert one(U.iso_ms(F.lit("2026-01-01"))) is None and one(U.iso_ms(F.lit("2026-01-01T00:00:00.123+01:00"))) == 1767222000123
    assert one(U.salted_key("s", F.lit(None).cast("string"))) != one(U.salted_key("s", F.lit("")))
    assert one(U.limit_reset(F.lit("Claude AI usage limit reached|1767222000"), F.lit(True))) == 1767222000000 and one(U.limit_reset(F.lit("none"), F.lit(True))) is None
    assert one(U.project_name(F.lit("-Users-me-code-app"))) == "code-app" and one(U.model_lines(F.array(F.lit("b"), F.lit("a"), F.lit("b")))) == "- a\n- b"


def test_carried_state_clears(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 2, None), ("k", 3, "\0"), ("k", 4, None), ("k", 5, "b")], "k string, o int, v string")
    assert [r["state_v"] for r in deltas.carried(df, ["k"], ["o"], {"state_v": F.col("v")}).orderBy("o").collect()] == ["a", "a", None, None, "b"]


# --- sync -----------------------------------------------------------------------------------------------------


def entries(spark, machine="A", extra=()):
    rows = [(machine, "ag", 1000 * k, k, "m", f"id{k % 3}", None, "s", 1, 2, 0.5) for k in range(5)] + list(extra)
    return sync.folded(spark.createDataFrame(rows, "machine string, agent string, at long, ord long, model string, message_id string, request_id string, session string, input_tokens long, output_tokens long, cost double"), "salt")


def test_shards_are_replaced_as_a_whole(spark, tmp_path):
    cell, path = sync.cells(entries(spark)), str(tmp_path / "cells")
    assert cell.first()["messages"] == 3
    sync.apply_shards(cell, path)
    sync.apply_shards(sync.cells(entries(spark, "B")), path)
    sync.apply_shards(cell, path)
    assert got(spark.read.parquet(path), "machine", "messages") == [("A", 3), ("B", 3)]
    a, b = sync.content_hash(cell).first()["hash"], sync.content_hash(sync.cells(entries(spark, extra=[("A", "ag", 9000, 9, "m", "new", None, "s", 1, 2, 0.5)]))).first()["hash"]
    assert a != b and a == sync.content_hash(cell.orderBy(F.desc("bucket"))).first()["hash"]
    index = sync.content_hash(cell).withColumn("late_edits", F.lit(2))
    assert sync.repaired(cell, index).first()["late_edits"] == 2 and sync.repaired(cell, index.withColumn("hash", F.lit("x"))).first()["late_edits"] == 0
    assert sync.changed(index, index).count() == 0
    assert got(sync.moved(index, "A", "Z"), "machine") == [("Z",)] and sync.clashes(index.unionByName(sync.moved(index, "A", "B")), "A", "B").count() == 1
    assert sync.pruned(index, F.lit("1970-02-01").cast("date"), 30).count() == 0 and sync.pruned(index, F.lit("1970-01-31").cast("date"), 30).count() == 1
    both = sync.refreshed(cell, sync.cells(entries(spark, "B")), sync.content_hash(cell).unionByName(sync.moved(index, "A", "B").select("machine", "agent", "utc_date", "hash")))
    assert got(both, "machine", "verdict") == [("A", "kept"), ("B", "suppressed")]


def test_rollups_are_written_whole(spark, tmp_path):
    cell = sync.cells(entries(spark))
    for _ in range(2):
        sync.write_rollups(cell, str(tmp_path))
    assert got(spark.read.parquet(f"{tmp_path}/models")) == [("m", 9, 1.5)]
    assert got(spark.read.parquet(f"{tmp_path}/weekly"), "period", "agent", "machine", "model", "tokens") == [("1970-W01", "ag", None, None, 9), ("1970-W01", None, "A", None, 9), ("1970-W01", None, None, "m", 9), ("1970-W01", None, None, None, 9)]


def test_shard_documents(spark, tmp_path):
    good, bad = tmp_path / "m1/shards/ag/2026/01/02.json", tmp_path / "m1/shards/ag/2026/01/03.json"
    good.parent.mkdir(parents=True)
    good.write_text(json.dumps({"schema": 1, "machineId": "m1"}))
    bad.write_text("{broken")
    assert got(sync.read_shards(spark, str(tmp_path), "struct<schema:int,machineId:string>"), "machine", "agent", "utc_date", "readable") == [("m1", "ag", "2026-01-02", True), ("m1", "ag", "2026-01-03", False)]


# --- options and sinks ----------------------------------------------------------------------------------------


def test_options():
    assert bound("20260131") == "2026-01-31" and bound("2026-01-31") == "2026-01-31" and bound(None) is None
    for wrong in ("2026-02-30", "2026", "2026-0131", "x"):
        with pytest.raises(ValueError):
            bound(wrong)
    day = date(2026, 1, 9)  # a Friday
    assert [last_periods(2, u, day) for u in ("day", "week", "month")] == ["2026-01-08", "2025-12-28", "2025-12-01"] and last_periods(1, "week", day, 1) == "2026-01-05"
    for wrong in ({"order": "up"}, {"length_hours": 0}, {"zone": "No/Where"}):
        with pytest.raises(Exception):
            Options(**wrong)


def test_sinks(spark):
    df = spark.createDataFrame([("2026-01-01", 1200, 3.0, ["b", "a"]), ("2026-01-02", 5, float("nan"), [])], "day string, tokens long, cost double, models array<string>")
    report = json.loads(sinks.to_json(df, "daily", df.agg(F.sum("tokens").alias("tokens"))))
    assert report == {"daily": [{"day": "2026-01-01", "tokens": 1200, "cost": 3, "models": ["b", "a"]}, {"day": "2026-01-02", "tokens": 5, "cost": None, "models": []}], "totals": {"tokens": 1205}}
    assert "cost" not in sinks.to_json(df, "daily", cost=False)
    text = sinks.table(df.limit(1).collect(), ["day", "tokens", "cost", "models"], title="Usage")
    assert "| 2026-01-01 | 1,200  | $3.00 | - a    |" in text and text.startswith("Usage\n+--")
    assert max(map(sinks.width, sinks.table([{"a": "日本" * 30, "b": "x" * 90}], ["a", "b"], 60).split("\n"))) <= 60
    assert sinks.status_line("M", 1.5, None, 2.0, 61, 50, 200) == "M | $1.50 session / N/A today / $2.00 block (1h 1m left) | 50 (25%)"
    assert sinks.cell("a\x1b[0m") == "a\\x1b[0m"

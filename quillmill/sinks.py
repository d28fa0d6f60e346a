"""Reports as JSON and text tables. Tables and whole JSON documents are for reports that a person reads; json_rows is for any size."""

from __future__ import annotations

import json
import math
import re
import unicodedata
from collections.abc import Iterable
from datetime import UTC, datetime
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_COSTS = {"total_cost", "cost_usd", "cost", "totalCost", "costUSD"}


def plain(value: Any) -> Any:
    """SNK-07: rows and lists as JSON values; whole floats as whole numbers, others that JSON can't hold as null."""
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if not math.isfinite(value) else int(value) if value.is_integer() and abs(value) < 2**53 else value
    if hasattr(value, "asDict"):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value if value is None or isinstance(value, (bool, int, str)) else str(value)


def without_cost(value: Any) -> Any:
    """SNK-06: all cost members dropped, at any depth."""
    if isinstance(value, dict):
        return {k: without_cost(v) for k, v in value.items() if k not in _COSTS}
    return [without_cost(v) for v in value] if isinstance(value, list) else value


def json_rows(rows: DataFrame) -> DataFrame:
    """SNK-01 for reports of any size: each row as JSON text (SNK-07: whole floats as whole numbers), made and written by the tasks."""
    def shown(name: str, kind: str) -> Column:
        value = F.col(f"`{name}`")
        if kind not in ("double", "float") and not kind.startswith("decimal"):
            return F.to_json(F.struct(value.alias(name)))
        whole = (value == F.floor(value)) & (F.abs(value) < 2**53)
        return F.when(whole, F.to_json(F.struct(value.cast("long").alias(name)))).otherwise(F.to_json(F.struct(value.cast("double").alias(name))))

    parts = [F.regexp_extract(shown(n, k), r"(?s)^\{(.*)\}$", 1) for n, k in rows.dtypes]
    return rows.select(F.concat(F.lit("{"), F.array_join(F.filter(F.array(*parts), lambda p: p != ""), ","), F.lit("}")).alias("value"))


def to_json(rows: DataFrame, name: str, totals: DataFrame | None = None, cost: bool = True) -> str:
    """SNK-01: {name: [...], totals: {...}}, for reports by period, which have a row a day at most; json_rows has no such bound."""
    report: dict[str, Any] = {name: [plain(r) for r in rows.toLocalIterator()]}
    if totals is not None:
        report["totals"] = plain(totals.first())
    return json.dumps(report if cost else without_cost(report), indent=2, ensure_ascii=False)


def width(text: str) -> int:
    """Columns that a text takes on a terminal."""
    text = re.sub(r"\x1b\[[0-9;]*m", "", text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def clipped(text: str, most: int) -> str:
    """A text of at most so many columns, with a mark where it is cut."""
    if width(text) <= most:
        return text
    out = ""
    for c in text:
        if width(out + c) > most - 1:
            break
        out += c
    return out + "…"


def escaped(text: str) -> str:
    """Control characters made visible."""
    return "".join(c if c >= " " and c != "\x7f" else f"\\x{ord(c):02x}" for c in text)


def cell(value: Any) -> str:
    """FN-S2: thousands separated, costs with two places, lists in lines."""
    if value is None:
        return "-"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, int):
        return f"{value:,}"
    if isinstance(value, (float, Decimal)):
        return f"${value:,.2f}"
    if isinstance(value, (list, tuple)):
        return "\n".join(f"- {escaped(str(v))}" for v in sorted(set(map(str, value))))
    return escaped(str(value))


def table(rows: Iterable[Any], columns: list[str], most: int = 120, title: str | None = None) -> str:
    """SNK-03 to SNK-05: a text table; the widest columns are narrowed until it fits."""
    lines = [[cell(r[c]).split("\n") for c in columns] for r in rows]
    widths = [max([width(c), *(width(x) for line in lines for x in line[k])]) for k, c in enumerate(columns)]
    while sum(widths) + 3 * len(widths) + 1 > most and max(widths) > 8:
        widths[widths.index(max(widths))] -= 1
    bar = "+" + "+".join("-" * (w + 2) for w in widths) + "+"

    def row(cells: list[str]) -> str:
        shown = [clipped(c, w) for c, w in zip(cells, widths, strict=True)]
        return "| " + " | ".join(c + " " * (w - width(c)) for c, w in zip(shown, widths, strict=True)) + " |"

    out = ([title] if title else []) + [bar, row(columns), bar]
    for line in lines:
        for k in range(max(len(c) for c in line)):
            out.append(row([c[k] if k < len(c) else "" for c in line]))
        out.append(bar)
    return "\n".join(out)


def status_line(model: str, session_cost: float | None, today: float | None, block: float | None, minutes_left: int | None, context: int | None, size: int | None) -> str:
    """SNK-08: one line of model, costs and the share of the context in use."""
    money = lambda x: "N/A" if x is None else f"${x:.2f}"
    left = "" if minutes_left is None else f" ({minutes_left // 60}h {minutes_left % 60}m left)"
    share = "N/A" if not context or not size else f"{context:,} ({round(context * 100 / size)}%)"
    return f"{model} | {money(session_cost)} session / {money(today)} today / {money(block)} block{left} | {share}"


_COUNTS = [("Input", "input_tokens"), ("Output", "output_tokens"), ("Cache Create", "cache_creation_tokens"), ("Cache Read", "cache_read_tokens")]
#: SNK-04: heads and columns of each report's table.
LAYOUTS: dict[str, list[tuple[str, str]]] = {
    "agent": [("Period", "period"), ("Models", "models"), *_COUNTS, ("Total Tokens", "total_tokens"), ("Cost (USD)", "cost")],
    "session": [("Session", "session_id"), ("Models", "models"), *_COUNTS, ("Total Tokens", "total_tokens"), ("Cost (USD)", "cost"), ("Last Activity", "last_ms")],
    "unified": [("Period", "period"), ("Agent", "agent"), ("Models", "models"), *_COUNTS, ("Total Tokens", "total_tokens"), ("Cost (USD)", "cost")],
    "blocks": [("Block Start", "start_ms"), ("Duration", "duration"), ("Models", "models"), ("Tokens", "total_tokens"), ("%", "limit_percent"), ("Cost", "cost"), ("Status", "status")],
    "codex": [("Period", "period"), ("Models", "models"), *_COUNTS, ("Total Tokens", "total_tokens"), ("Cost (USD)", "cost")],
}


def _moment(ms: int | None) -> str | None:
    return None if ms is None else datetime.fromtimestamp(ms / 1000, UTC).strftime("%Y-%m-%d %H:%M")


def laid_out(kind: str, row: dict[str, Any]) -> dict[str, Any]:
    """The values of one report row under the heads of its table."""
    row = dict(row)
    counts = [row.get(c) or 0 for _, c in _COUNTS]
    row.setdefault("total_tokens", sum(counts))
    if isinstance(row.get("models"), dict):
        row["models"] = sorted(row["models"])
    if kind == "blocks":
        minutes = (row["to_ms"] - row["from_ms"]) // 60_000
        row |= {"duration": f"{minutes // 60}h {minutes % 60}m", "status": row.get("limit_status") or ("ACTIVE" if row["active"] else ""), "start_ms": _moment(row["start_ms"])}
        share = row.get("limit_percent")
        row["limit_percent"] = None if share is None else f"{share:.1f}%"
    if row.get("last_ms") is not None:
        row["last_ms"] = _moment(row["last_ms"])
    return {head: row.get(column) for head, column in LAYOUTS[kind]}


def report_table(kind: str, rows: Iterable[Any], title: str | None = None, most: int = 160, cost: bool = True, gaps: Iterable[Any] = ()) -> str:
    """SNK-04: the table of a report: its rows, nested agents below their period, gaps between blocks, and a row of totals."""
    shown: list[tuple[Any, dict]] = []
    totals: dict[str, float] = {}
    for r in rows:
        row = r.asDict(recursive=True)
        line = laid_out(kind, row | ({"agent": "all"} if kind == "unified" else {}))
        for head, column in LAYOUTS[kind]:
            if column in ("total_tokens", "cost") or (head, column) in _COUNTS:
                totals[head] = totals.get(head, 0) + (line[head] or 0)
        shown.append((row.get("start_ms"), line))
        shown += [(None, laid_out(kind, agent) | {"Period": ""}) for agent in row.get("agents") or []]
    if kind == "blocks":
        for g in gaps:
            hours = (g["end_ms"] - g["start_ms"]) // 3_600_000
            shown.append((g["start_ms"], {h: None for h, _ in LAYOUTS[kind]} | {"Block Start": _moment(g["start_ms"]), "Duration": f"{hours}h gap", "Status": "inactive"}))
        shown.sort(key=lambda x: x[0])
    heads = [h for h, _ in LAYOUTS[kind] if cost or not h.startswith("Cost")]
    lines = [line for _, line in shown]
    if lines:
        lines.append({h: None for h in heads} | totals | {heads[0]: "Total"})
    return table(lines, heads, most, title)

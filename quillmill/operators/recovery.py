"""Records that fail to parse, with the reason, and all others as typed rows (problem 4)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.functions.grammar import Fault, Number, records

FIELDS = ["sessionId", "timestamp", "requestId", "messageId", "model", "project", "input_tokens", "output_tokens", "costUSD"]
SCHEMA = T.StructType(
    [T.StructField("line_id", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("reason", T.StringType()), T.StructField("at", T.IntegerType()), T.StructField("detail", T.StringType())]
    + [T.StructField(f, T.StringType()) for f in FIELDS[:6]]
    + [T.StructField(f, T.LongType()) for f in FIELDS[6:8]]
    + [T.StructField("costUSD", T.DoubleType())]
)
_WHOLE = re.compile(r"[0-9]+")
_DECIMAL = re.compile(r"(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")
_SESSION = re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F-]{27}")
_LARGEST = 2**63 - 1


class Refused(ValueError):
    def __init__(self, reason: str, detail: str):
        super().__init__(detail)
        self.reason = reason


def _count(raw: Any, name: str, number: type) -> int:
    if not isinstance(raw, number) or not _WHOLE.fullmatch(raw) or len(digits := raw.lstrip("0") or "0") > 19 or int(digits) > _LARGEST:
        raise Refused("value", name)
    return int(digits)


def _cost(raw: Any, number: type) -> float | None:
    if raw is None or (number is str and raw == ""):
        return None
    if not isinstance(raw, number) or not _DECIMAL.fullmatch(raw):
        raise Refused("value", "costUSD")
    return float(raw)


def _text(value: Any) -> str | None:
    return str(value) if isinstance(value, str) else None


def typed(value: Any, fmt: str) -> list:
    """The nine typed fields of a parsed record, or Refused."""
    if fmt == "csv":
        if len(value) != len(FIELDS):
            raise Refused("shape", f"{len(value)} fields")
        counts, number, cost, head = value[6:8], str, value[8], [v or None for v in value[:6]]
    else:
        message = value.get("message")
        usage = message.get("usage") if isinstance(message, dict) else None
        for holder, name in ((value, "timestamp"), (value, "sessionId"), (usage, "input_tokens"), (usage, "output_tokens")):
            if not isinstance(holder, dict) or name not in holder:
                raise Refused("shape", f"no {name}")
        counts, number, cost = [usage["input_tokens"], usage["output_tokens"]], Number, value.get("costUSD")
        head = [_text(x) for x in (value["sessionId"], value["timestamp"], value.get("requestId"), message.get("id"), message.get("model"), value.get("project"))]
    return [*head, *(_count(c, n, number) for c, n in zip(counts, FIELDS[6:8], strict=True)), _cost(cost, number)]


def _anchor(fmt: str):
    """Whether a record may start where parsing resumes: it has its typed shape."""

    def valid(value: Any) -> bool:
        try:
            head = typed(value, fmt)
        except Refused:
            return False
        return fmt != "csv" or bool(_SESSION.fullmatch(head[0] or ""))

    return valid


def load_text(text: str | None, fmt: str | None) -> Iterator[list]:
    """reason, position, detail and the nine fields of each record of a text, in order."""
    none = [None] * len(FIELDS)
    if text is None or fmt not in ("csv", "jsonl"):
        yield ["syntax", 0, "no text or unknown format", *none]
        return
    for item in records(text, fmt, _anchor(fmt), len(FIELDS)):
        if isinstance(item, Fault):
            yield ["syntax", item.at, item.what, *none]
            continue
        try:
            yield [None, item.start, None, *typed(item.value, fmt)]
        except Refused as error:
            yield [error.reason, item.start, str(error), *none]


def load_record(text: str | None, fmt: str | None) -> list[list]:
    """The verdict on a text that must be one record, then, if it is more, what it consists of.

    More than one record is a syntax error where the second starts. Of a text that isn't one record, all
    records that can be read, resumed at after its faults, and all errors follow the verdict in order.
    """
    items = list(load_text(text, fmt))
    if len(items) == 1:
        return items
    first = items[0] if items[0][0] == "syntax" else ["syntax", items[1][1], "more than one record", *[None] * len(FIELDS)]
    return [first, *items]


def parsed(lines: DataFrame) -> DataFrame:
    """line_id, part, reason, position and detail of the error, and the typed fields.

    lines: line_id, fmt (csv or jsonl) and line, one record each, in which a quoted field may break lines.
    Part 0 is the verdict on the line: reason is null for one that loads, else the first that holds of
    syntax, shape and value. Lines that aren't one record have further parts, the records recovered from
    them and the errors between those. Defined results: a null line or an unknown format is a syntax error,
    an empty csv line has one field (shape), an empty jsonl line is a syntax error; JSON may be nested to
    any depth, of repeated members the last counts.
    """

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [[i, part, *item] for i, fmt, line in zip(batch["line_id"], batch["fmt"], batch["line"], strict=True) for part, item in enumerate(load_record(line, fmt))]
            frame = pd.DataFrame(rows, columns=SCHEMA.names, dtype=object)
            for name in ("input_tokens", "output_tokens"):
                frame[name] = frame[name].astype("Int64")
            yield frame

    return lines.select("line_id", "fmt", "line").mapInPandas(load, SCHEMA)


def load_lines(lines: DataFrame) -> DataFrame:
    """One row a line, loaded or with its reason."""
    return parsed(lines).where("part = 0").drop("part")


def refused(lines: DataFrame) -> DataFrame:
    return load_lines(lines).where(F.col("reason").isNotNull()).select("line_id", "reason", "at", "detail")


def recovered(lines: DataFrame) -> DataFrame:
    """The records that could be read within refused lines, with their positions."""
    return parsed(lines).where("part > 0 and reason is null").drop("reason", "detail")

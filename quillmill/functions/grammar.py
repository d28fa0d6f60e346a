"""Recursive-descent grammars of csv and JSON-lines text that recover from errors.

A text is a sequence of records. Where a record breaks, its error is kept with its position, and parsing
resumes at the next record-start anchor: a line start whose text parses as a whole record and passes the
caller's check. Without such an anchor the error reaches to the end of the text. What one attempt has read
settles all anchors within it, so the search is linear in the text however it is broken. Values may be
nested to any depth: the descent keeps its own stack.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

class Number(str):
    """A JSON number as it was written."""

    __slots__ = ()


@dataclass(slots=True)
class Record:
    start: int
    end: int
    value: Any


@dataclass(slots=True)
class Fault:
    start: int
    end: int
    at: int
    what: str


class Broken(ValueError):
    def __init__(self, at: int, what: str):
        super().__init__(what)
        self.at = at


_QUOTED = re.compile(r'"([^"]*(?:""[^"]*)*)"')
_PLAIN = re.compile(r'[^",\r\n]*')
_END = re.compile(r"\r?\n|\Z")
_STRING = r'"[^"\\\x00-\x1f]*(?:\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4})[^"\\\x00-\x1f]*)*"'
_TOKEN = re.compile(rf"[ \t\n\r]*(?:([{{}}\[\]:,])|({_STRING})|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)|(true|false|null))")
_SPACE = re.compile(r"[ \t\r\n]*")
_INDENT = re.compile(r"[ \t\r]*")
_LINE_SPACE = re.compile(r"[ \t\r]*(?:\n|\Z)")
_WORDS = {"true": True, "false": False, "null": None}


def _closing_quotes(text: str) -> dict[int, int]:
    """Position of each quote to that of the quote that would close a field it opens; -1 for none."""
    at = [m.start() for m in re.finditer('"', text)]
    closes = [-1] * (len(at) + 2)
    for k in range(len(at) - 1, -1, -1):
        closes[k] = closes[k + 2] if k + 1 < len(at) and at[k + 1] == at[k] + 1 else at[k]
    return {p: closes[k + 1] for k, p in enumerate(at)}


def csv_record(text: str, at: int, closing: dict[int, int] | None = None, most: int | None = None) -> tuple[list[str], int]:
    """record := field ("," field)* ; field := quoted | plain. Fields and the position of the record's end.

    closing: closing quotes worked out before; most: a record of more fields is broken off.
    """
    fields = []
    while True:
        if text.startswith('"', at):
            if closing is None:
                end = m.end() - 1 if (m := _QUOTED.match(text, at)) else -1
            else:
                end = closing[at]
            if end < 0:
                raise Broken(at, "quote not closed")
            fields.append(text[at + 1 : end].replace('""', '"'))
            at, quoted = end + 1, True
        else:
            m = _PLAIN.match(text, at)
            fields.append(m[0])
            at, quoted = m.end(), False
            if text.startswith('"', at):
                raise Broken(at, "quote within a plain field")
        if text.startswith(",", at):
            at += 1
            if most is not None and len(fields) >= most:
                raise Broken(at, "too many fields")
            continue
        if not _END.match(text, at):
            raise Broken(at, "text after a closing quote" if quoted else "line break outside quotes")
        return fields, at


def _string(token: str) -> str:
    if "\\" not in token:
        return token[1:-1]
    value = json.loads(token)
    return value.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _member_name(text: str, at: int) -> tuple[str, int]:
    """name := string ":" """
    m = _TOKEN.match(text, at)
    if not m or m[2] is None:
        raise Broken(_SPACE.match(text, at).end(), "no member name")
    colon = _TOKEN.match(text, m.end())
    if not colon or colon[1] != ":":
        raise Broken(_SPACE.match(text, m.end()).end(), "no colon")
    return _string(m[2]), colon.end()


def json_value(text: str, at: int, objects: dict[int, tuple[dict, int]] | None = None) -> tuple[Any, int]:
    """value := object | array | string | number | word. The value and its end.

    objects: takes the objects read on the way, by their start, with their end.
    """
    open_: list[tuple[Any, str | None, int]] = []  # containers around the value, with the member's name in objects
    while True:
        m = _TOKEN.match(text, at)
        if not m:
            raise Broken(_SPACE.match(text, at).end(), "no value")
        mark, string, number, word = m.groups()
        start, at = m.start(m.lastindex), m.end()
        if string is not None:
            value: Any = _string(string)
        elif number is not None:
            value = Number(number)
        elif word is not None:
            value = _WORDS[word]
        elif mark in "{[":
            value = {} if mark == "{" else []
            m = _TOKEN.match(text, at)
            if m and m[1] == ("}" if mark == "{" else "]"):
                at = m.end()
            else:
                name, at = _member_name(text, at) if mark == "{" else (None, at)
                open_.append((value, name, start))
                continue
        else:
            raise Broken(start, "no value")
        while True:
            if not open_:
                return value, at
            holder, name, start = open_[-1]
            if name is None:
                holder.append(value)
            else:
                holder[name] = value
            m, last = _TOKEN.match(text, at), "]" if name is None else "}"
            if not m or m[1] not in (",", last):
                raise Broken(_SPACE.match(text, at).end(), f"no comma or end of {'array' if name is None else 'object'}")
            at = m.end()
            if m[1] == ",":
                if name is not None:
                    name, at = _member_name(text, at)
                    open_[-1] = (holder, name, start)
                break
            open_.pop()
            value = holder
            if objects is not None and name is not None:
                objects[start] = (value, at)


def _line_end(text: str, at: int) -> int | None:
    """Where the line of a value that ends here is over, or None if more stands in it."""
    m = _LINE_SPACE.match(text, at)
    return m and m.end() - (m[0][-1:] == "\n")


def json_record(text: str, at: int, objects: dict[int, tuple[dict, int]] | None = None) -> tuple[dict, int]:
    """record := object, alone on its lines."""
    value, end = json_value(text, at, objects)
    if not isinstance(value, dict):
        raise Broken(at, "no object")
    if (line := _line_end(text, end)) is None:
        raise Broken(end, "text after the object")
    return value, line


def _csv_anchor(text: str, at: int, closing: dict[int, int], valid: Callable[[Any], bool], most: int | None) -> int:
    """The next line start after a position at which a valid record parses, or 0."""
    while (at := text.find("\n", at) + 1) > 0:
        try:
            if at < len(text) and valid(csv_record(text, at, closing, most)[0]):
                return at
        except Broken:
            continue
    return 0


def _json_anchor(text: str, at: int, settled: int, objects: dict[int, tuple[dict, int]], valid: Callable[[Any], bool]) -> int:
    """The same of JSON; up to settled the objects that parse are known."""
    while (at := text.find("\n", at) + 1) > 0:
        start = _INDENT.match(text, at).end()
        if start >= settled and text.startswith("{", start):
            objects = {}
            try:
                settled = json_value(text, start, objects)[1]
            except Broken as error:
                settled = max(error.at, start + 1)
        if start in objects and _line_end(text, objects[start][1]) is not None and valid(objects[start][0]):
            return at
    return 0


def records(text: str, fmt: str, valid: Callable[[Any], bool], most: int | None = None) -> Iterator[Record | Fault]:
    """All records and faults of a text in order; valid: whether an anchor's record may be resumed at; most: fields of a csv record."""
    closing: dict[int, int] | None = None
    at = 0
    while at < len(text) or at == 0:
        objects: dict[int, tuple[dict, int]] = {}
        try:
            value, end = csv_record(text, at, closing) if fmt == "csv" else json_record(text, at, objects)
            yield Record(at, end, value)
            after = _END.match(text, end)
            at = max(after.end(), at + 1)
        except Broken as error:
            if fmt == "csv":
                closing = _closing_quotes(text) if closing is None else closing
                anchor = _csv_anchor(text, at, closing, valid, most)
            else:
                anchor = _json_anchor(text, at, error.at, objects, valid)
            end = anchor or len(text)
            yield Fault(at, end, error.at, str(error))
            at = max(end, at + 1)

"""Plain row-at-a-time versions that the operators are tested against."""

from __future__ import annotations

import json
import re
from datetime import UTC, datetime, timedelta
from decimal import Decimal
from zoneinfo import ZoneInfo

OFFSETS = {"UTC": 0, "CET": 1, "CEST": 2, "EST": -5, "EDT": -4, "PST": -8, "PDT": -7}
EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


def _ms(x: datetime) -> int:
    return (x - EPOCH) // timedelta(milliseconds=1)


def _local(x: datetime, zone: str, received: datetime) -> int | None:
    found = set()
    for fold in (0, 1):
        u = x.replace(tzinfo=ZoneInfo(zone), fold=fold).astimezone(UTC)
        if u.astimezone(ZoneInfo(zone)).replace(tzinfo=None) == x:
            found.add(u)
    if not found:
        return None
    known = [u for u in found if u <= received.replace(tzinfo=UTC)]
    return _ms(max(known) if known else min(found))


def instant(value: str | None, zone: str | None, received: datetime) -> int | None:
    if value is None:
        return None
    if re.fullmatch(r"\d+(\.\d+)?", value):
        for unit in (1, 10**3, 10**6, 10**9):
            if 1577836800 <= Decimal(value) / unit < 1893456000:
                return int(Decimal(value) * 1000 / unit)
        return None
    if value[0] in "[{" if value else False:
        o = json.loads(value)
        s, n = o if isinstance(o, list) else (o["seconds"], o["nanos"])
        return s * 1000 + n // 10**6
    if m := re.fullmatch(r"(.*?)(?: (Europe|America|Asia|Australia)(/\w+))", value):
        value, zone = m[1], m[2] + m[3]
    offset = None
    if m := re.fullmatch(r"(.*\d) ([A-Z]{3,4})", value):
        if m[2] not in OFFSETS:
            return None
        value, offset = m[1], OFFSETS[m[2]] * 60
    elif m := re.fullmatch(r"(.*:\d\d.*?) ?([+-])(\d\d):?(\d\d)", value):
        value, offset = m[1], (int(m[3]) * 60 + int(m[4])) * (1 if m[2] == "+" else -1)
    elif value.endswith("Z"):
        value, offset = value[:-1], 0
    value = value.replace(",", ".", 1) if re.search(r"\d,\d", value) else value
    if m := re.fullmatch(r"(.*\.\d{6})\d+", value):
        value = m[1]
    for form in ("%Y-%m-%dT%H:%M:%S.%f", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M", "%Y%m%dT%H%M%S", "%m/%d/%Y %I:%M:%S %p", "%d.%m.%Y %H:%M", "%a, %d %b %Y %H:%M:%S", "%d %b %Y %H:%M:%S"):
        try:
            x = datetime.strptime(value, form)  # noqa: DTZ007
        except ValueError:
            continue
        if offset is not None:
            return _ms(x.replace(tzinfo=UTC) - timedelta(minutes=offset))
        return _local(x, zone, received) if zone else None
    return None


def sessions(rows: list[tuple], gap: dict) -> set[tuple]:
    """(key, first, last, n) of sessions of (key, ms) rows."""
    by: dict = {}
    for k, t in rows:
        if t is not None:
            by.setdefault(k, []).append(t)
    out = set()
    for k, ts in by.items():
        ts.sort()
        first = last = ts[0]
        n = 0
        for t in ts:
            if t - last > gap[k]:
                out.add((k, first, last, n))
                first, n = t, 0
            last = t
            n += 1
        out.add((k, first, last, n))
    return out

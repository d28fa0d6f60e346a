"""Instants from mixed writings, by the shape of each writing.

A value is reduced to a mask in which every digit is 9, every capital A and every small letter a. Each
distinct mask is compiled once in a worker to the positions of its fields; all values of a mask, having
the same length, are then converted together as a matrix of characters. Local times go through tables of
zone transitions of one version of the zone data, the driver's: a worker with other data fails. Years are
not bounded: after the listed transitions the rules in force repeat with the calendar.

Defined results: null, empty, unreadable and impossible values (month 13, local times skipped by a clock
change, unknown zones, local times of a machine without zone, dates without a time) give null. A local
time that occurs twice gives the later instant that is not after the time of receipt, else the earlier;
with no time of receipt the earlier.
"""

from __future__ import annotations

import re
import zoneinfo
from datetime import UTC, datetime
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

CANONICAL = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{3}Z$"

# Offsets of zone abbreviations, in minutes.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "IST": 330, "NPT": 345, "JST": 540, "KST": 540, "AWST": 480, "ACST": 570, "AEST": 600, "ACDT": 630, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "BRT": -180, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

#: Seconds since 1970 between which plain numbers lie, 2020 up to 2030.
NUMBER_FROM, NUMBER_TO = 1_577_836_800, 1_893_456_000
#: Seconds between which a zone's transitions are listed at first, 1970 up to 2040, and those of the whole table, 1800 up to 2500.
NEAR, WHOLE = (0, 2_208_988_800), (-5_364_662_400, 16_725_225_600)
#: Seconds of the 400 years after which the calendar, and so the rules in force since 2100, repeat.
CYCLE = 146_097 * 86_400

_SHAPE = str.maketrans("0123456789" + "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "abcdefghijklmnopqrstuvwxyz", "9" * 10 + "A" * 26 + "a" * 26)
_TIME = r"(?P<h>9{1,2}):(?P<m>99)(?::(?P<s>99)(?:[.,](?P<f>9{1,9}))?)?(?P<tail>.*)"
_GRAMMAR = [
    ("number", re.compile(r"(?P<a>9{9,19})(?:\.(?P<f>9{1,9}))?")),
    ("pair", re.compile(r"\[ ?(?P<a>9{1,11}), ?(?P<b>9{1,9}) ?\]")),
    ("object", re.compile(r'\{ ?"aaaaaaa" ?: ?(?P<a>9{1,11}), ?"a{5}(?:a{6})?" ?: ?(?P<b>9{1,9}) ?\}')),
    ("local", re.compile(r"(?P<Y>9999)(?P<p>[-/])(?P<M>99)(?P=p)(?P<D>99)(?P<sep>[A ]) ?" + _TIME)),
    ("local", re.compile(r"(?P<Y>9999)-?(?P<M>99)-?(?P<D>99)(?P<sep>A)(?P<h>99)(?P<m>99)(?P<s>99)(?:[.,](?P<f>9{1,9}))?(?P<tail>.*)")),
    ("local", re.compile(r"(?P<M>9{1,2})/(?P<D>9{1,2})/(?P<Y>9999),? " + _TIME)),
    ("local", re.compile(r"(?P<D>9{1,2})\.(?P<M>9{1,2})\.(?P<Y>9999),? " + _TIME)),
    ("local", re.compile(r"(?:Aaa, ?)?(?P<D>9{1,2})[ -](?P<mon>Aaa)[ -](?P<Y>9999),? " + _TIME)),
    ("local", re.compile(r"(?:Aaa,? )?(?P<mon>Aaa) (?P<D>9{1,2}),? (?P<Y>9999),? " + _TIME)),
]
_TAIL = re.compile(r" ?(?P<half>[AaPp][Mm])?(?: ?(?:(?P<sign>[+-])(?P<oh>\d\d)(?::?(?P<om>\d\d))?|(?P<abbr>[A-Z]{1,5})|\[?(?P<zone>[A-Z][A-Za-z_]+(?:/[A-Za-z0-9_+-]+)+)\]?))?")


@lru_cache(4096)
def plan_of(mask: str):
    """Kind of writing and the span of each of its fields, or None; worked out once for each mask."""
    for kind, grammar in _GRAMMAR:
        if m := grammar.fullmatch(mask):
            return kind, {k: m.span(k) for k in m.groupdict() if m.span(k) != (-1, -1) and k != "p"}
    return None


@lru_cache(1)
def zone_version() -> str:
    """Version of the zone data that this machine's transition tables are made from."""
    for folder in zoneinfo.TZPATH:
        for name, pattern in (("tzdata.zi", r"# version (\S+)"), ("+VERSION", r"(\S+)")):
            try:
                with open(f"{folder}/{name}", encoding="utf-8") as file:
                    if m := re.match(pattern, file.readline()):
                        return m[1]
            except OSError:
                continue
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        return "unknown"


@lru_cache(1024)
def zone_table(name: str, version: str, bounds: tuple[int, int] = NEAR):
    """(instants of change, offsets from each on) in seconds within bounds, or None for an unknown zone.

    version: that of the zone data the caller works with; a machine with other data is an error, as its
    tables would give other instants.
    """
    if version != zone_version():
        raise RuntimeError(f"zone data of version {zone_version()}, not {version}")
    try:
        zone = zoneinfo.ZoneInfo(name)
    except (zoneinfo.ZoneInfoNotFoundError, ValueError, OSError):
        return None

    def offset(t: int) -> int:
        return int(datetime.fromtimestamp(t, UTC).astimezone(zone).utcoffset().total_seconds())

    at, step, end = bounds[0], 7 * 86_400, bounds[1]
    times, offsets = [-(2**40)], [offset(at)]
    while at < end:
        if (later := offset(at + step)) != offsets[-1]:
            low, high = at, at + step
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (middle, high) if offset(middle) == offsets[-1] else (low, middle)
            times.append(high)
            offsets.append(later)
        at += step
    return np.array(times), np.array(offsets)


def _offset_at(table, seconds):
    return table[1][np.searchsorted(table[0], seconds, side="right") - 1]


def from_local(local, fraction, received, table):
    """Seconds UTC of local seconds, with a mask of those that exist; received in microseconds."""
    before, after = local - _offset_at(table, local - 86_400), local - _offset_at(table, local + 86_400)
    ok_before, ok_after = (local - u == _offset_at(table, u) for u in (before, after))
    early, late = np.minimum(before, after), np.maximum(before, after)
    both = ok_before & ok_after
    chosen = np.where(both, np.where(late * 1_000_000 + fraction <= received, late, early), np.where(ok_before, before, after))
    return chosen, ok_before | ok_after


def from_zone(local, fraction, received, name, version):
    """from_local by the zone's tables of any year, or None for an unknown zone.

    Values within NEAR take its short table. Others take the whole one, years from 2500 on by the year as
    many times 400 years earlier that lies in it, as rules repeat with the calendar.
    """
    if (table := zone_table(name, version)) is None:
        return None
    far = (local < NEAR[0] + 86_400 * 2) | (local >= NEAR[1] - 86_400 * 2)
    if not far.any():
        return from_local(local, fraction, received, table)
    seconds, there = np.zeros(len(local), np.int64), np.zeros(len(local), bool)
    for part, known in ((~far, table), (far, zone_table(name, version, WHOLE))):
        back = np.maximum(0, -((WHOLE[1] - 86_400 * 400 - local[part]) // CYCLE)) * CYCLE if known is not table else 0
        # The time of receipt only matters near it, so a shift of both by the same span changes nothing.
        at, ok = from_local(local[part] - back, fraction[part], received[part] - back * 1_000_000, known)
        seconds[part], there[part] = at + back, ok
    return seconds, there


@lru_cache(4096)
def _tail_of(tail: str):
    """(half of the day, offset in seconds or None, zone name or None), or None for another text."""
    m = _TAIL.fullmatch(tail)
    if not m:
        return None
    half, sign, abbr, zone = m["half"], m["sign"], m["abbr"], m["zone"]
    offset = None
    if sign:
        hours, minutes = int(m["oh"]), int(m["om"] or 0)
        if hours > 18 or minutes > 59:
            return None
        offset = (hours * 3600 + minutes * 60) * (-1 if sign == "-" else 1)
    elif abbr:
        if abbr not in ABBREVIATIONS:
            return None
        offset = ABBREVIATIONS[abbr] * 60
    return (half or "").lower(), offset, zone


def _digits(chars, span):
    value = np.zeros(len(chars), np.int64)
    for k in range(*span):
        value = value * 10 + (chars[:, k].astype(np.int64) - 48)
    return value


def _scaled(chars, span, places):
    """Digits of a fraction, cut to so many places."""
    if span is None:
        return np.zeros(len(chars), np.int64)
    a, b = span
    value = _digits(chars, (a, min(b, a + places)))
    return value * 10 ** max(0, places - (b - a))


def _days(y, m, d):
    """Days since 1970 and whether the date exists."""
    ok = (m >= 1) & (m <= 12) & (y >= 1)
    month = ((np.where(ok, y, 1970) - 1970) * 12 + np.where(ok, m, 1) - 1).astype("datetime64[M]")
    first, following = month.astype("datetime64[D]").astype(np.int64), (month + 1).astype("datetime64[D]").astype(np.int64)
    return first + d - 1, ok & (d >= 1) & (d <= following - first)


def _convert_shape(kind, spans, texts, zones, received, version):
    """Microseconds UTC of texts of one mask, and a mask of the good ones."""
    # Fields stand before the tail, which may be of any length.
    fields = spans["tail"][0] if "tail" in spans else len(texts[0])
    chars = np.array([t[:fields] for t in texts], dtype=f"U{fields}").view(np.uint32).reshape(len(texts), -1)
    good = np.ones(len(texts), bool)
    if kind == "number":
        a, (start, end) = np.zeros(len(texts), np.uint64), spans["a"]
        for k in range(start, end):
            a = a * np.uint64(10) + (chars[:, k].astype(np.uint64) - np.uint64(48))
        result, good = np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
        for unit, places in ((1, 6), (1_000, 3), (1_000_000, 0), (1_000_000_000, -3)):
            here = (a >= np.uint64(NUMBER_FROM * unit)) & (a < np.uint64(NUMBER_TO * unit))
            value = np.where(here, a, np.uint64(0)).astype(np.int64)
            value = value * 10**places + _scaled(chars, spans.get("f"), places) if places > 0 else value // 10**-places
            result, good = np.where(here, value, result), good | here
        return result, good
    if kind in ("pair", "object"):
        if kind == "object":
            good = np.array([re.match(r'\{ ?"seconds".*"nano(?:s|seconds)"', t) is not None for t in texts])
        return _digits(chars, spans["a"]) * 1_000_000 + _digits(chars, spans["b"]) // 1000, good
    if "mon" in spans:
        a, b = spans["mon"]
        month = np.array([MONTHS.index(t[a:b].lower()) + 1 if t[a:b].lower() in MONTHS else 0 for t in texts])
    else:
        month = _digits(chars, spans["M"])
    if "sep" in spans:
        good &= np.isin(chars[:, spans["sep"][0]], [ord("T"), ord(" ")])
    days, exists = _days(_digits(chars, spans["Y"]), month, _digits(chars, spans["D"]))
    hour, minute = _digits(chars, spans["h"]), _digits(chars, spans["m"])
    second = _digits(chars, spans["s"]) if "s" in spans else np.zeros(len(texts), np.int64)
    good &= exists & (minute < 60) & (second < 60)
    fraction = _scaled(chars, spans.get("f"), 6)
    result = np.zeros(len(texts), np.int64)
    tails = np.array([t[spans["tail"][0] :] for t in texts], object)
    codes, distinct = pd.factorize(tails)
    for k, tail in enumerate(distinct):
        at = np.flatnonzero(codes == k)
        known = _tail_of(tail)
        if known is None:
            good[at] = False
            continue
        half, offset, name = known
        h = hour[at]
        if half:
            good[at] &= (h >= 1) & (h <= 12)
            h = h % 12 + (12 if half == "pm" else 0)
        else:
            good[at] &= h < 24
        local = days[at] * 86_400 + h * 3600 + minute[at] * 60 + second[at]
        if offset is not None:
            result[at] = local - offset
            continue
        names = np.full(len(at), name, object) if name else zones[at]
        zone_codes, zone_names = pd.factorize(names)
        good[at[zone_codes < 0]] = False
        for j, zone in enumerate(zone_names):
            part = zone_codes == j
            here = at[part]
            if (found := from_zone(local[part], fraction[here], received[here], zone, version)) is None:
                good[here] = False
                continue
            result[here] = found[0]
            good[here] &= found[1]
    return result * 1_000_000 + fraction, good


def convert(values: pd.Series, zones: pd.Series, received: pd.Series, version: str | None = None) -> pd.Series:
    """Microseconds UTC of each value, or null; version: of the zone data, this machine's if not given."""
    version = version or zone_version()
    result = np.zeros(len(values), np.int64)
    good = np.zeros(len(values), bool)
    texts = [v.strip() if isinstance(v, str) else None for v in values]
    masks = np.array([t.translate(_SHAPE) if t and t.isascii() else None for t in texts] or [None], object)[: len(texts)]
    codes, distinct = pd.factorize(masks)
    order = np.argsort(codes, kind="stable")
    starts = np.searchsorted(codes[order], np.arange(len(distinct) + 1))
    texts = np.array(texts + [None], object)[:-1]
    zones = zones.astype(object).where(zones.notna(), None).to_numpy()
    received = received.fillna(-(2**62)).astype(np.int64).to_numpy()
    for k, mask in enumerate(distinct):
        plan = plan_of(mask)
        if plan:
            at = order[starts[k] : starts[k + 1]]
            result[at], good[at] = _convert_shape(*plan, list(texts[at]), zones[at], received[at], version)
    return pd.Series(pd.array(result, dtype="Int64")).where(pd.Series(good), pd.NA)


def _utc_millis(version: str):
    """A UDF that works by the zone data of this version, that of the driver, on all workers."""

    @pandas_udf(LongType())
    def utc(values: pd.Series, zones: pd.Series, received: pd.Series) -> pd.Series:
        return convert(values, zones, received, version) // 1000

    return utc


def utc_millis(value: Column, zone: Column, received: Column) -> Column:
    """Milliseconds UTC (cut) of a text column; zone: IANA name of the machine, received: timestamp.

    Values in canonical form are read by the JVM and never reach Python.
    """
    plain = value.rlike(CANONICAL)
    other = _utc_millis(zone_version())(F.when(~plain, value), F.when(~plain, zone), F.when(~plain, F.unix_micros(received.cast("timestamp"))))
    return F.when(plain, F.unix_millis(F.try_to_timestamp(value))).otherwise(other)


def odd_utc_millis(value: Column, zone: Column, received: Column) -> Column:
    """utc_millis for values that are known not to be in canonical form."""
    return _utc_millis(zone_version())(value, zone, F.unix_micros(received.cast("timestamp")))

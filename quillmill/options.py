"""Options that all reports share, with their checks."""

from __future__ import annotations

import re
import zoneinfo
from dataclasses import dataclass
from datetime import date, timedelta


def bound(text: str | None) -> str | None:
    """FIL-03: YYYY-MM-DD or YYYYMMDD of a real day, as YYYY-MM-DD; else an error."""
    if text is None:
        return None
    m = re.fullmatch(r"(\d{4})-?(\d{2})-?(\d{2})", text)
    if not m or ("-" in text) != (text.count("-") == 2):
        raise ValueError(f"not a day: {text}")
    return date(*map(int, m.groups())).isoformat()


def last_periods(n: int, unit: str, today: date, first_day: int = 0) -> str:
    """FIL-04: first day of the n-th most recent day, week (from first_day, 0 Sunday) or month, the current one included."""
    if n < 1:
        raise ValueError("at least one period")
    if unit == "day":
        return (today - timedelta(days=n - 1)).isoformat()
    if unit == "week":
        start = today - timedelta(days=((today.isoweekday() % 7) - first_day) % 7)
        return (start - timedelta(weeks=n - 1)).isoformat()
    months = today.year * 12 + today.month - n
    return date(months // 12, months % 12 + 1, 1).isoformat()


@dataclass(frozen=True)
class Options:
    """RPT-11. order: asc or desc by period; first_day: 0 Sunday to 6 Saturday; cost: whether costs are shown."""

    since: str | None = None
    until: str | None = None
    zone: str = "UTC"
    order: str = "asc"
    first_day: int = 0
    breakdown: bool = False
    cost: bool = True
    project: str | None = None
    length_hours: float = 5.0
    now_ms: int | None = None
    recent: bool = False
    token_limit: int | str | None = None

    def __post_init__(self):
        object.__setattr__(self, "since", bound(self.since))
        object.__setattr__(self, "until", bound(self.until))
        if self.order not in ("asc", "desc"):
            raise ValueError("order is asc or desc")
        if self.token_limit not in (None, "max") and int(self.token_limit) <= 0:
            raise ValueError("a token limit is a positive number or max")
        if self.length_hours <= 0:
            raise ValueError("a block has a positive length")
        zoneinfo.ZoneInfo(self.zone)

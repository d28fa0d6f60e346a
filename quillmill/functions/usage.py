"""Scalar functions on usage records, all as column expressions inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS, HOUR_MS, QUARTER_MS = 86_400_000, 3_600_000, 900_000
#: Counters are capped here instead of wrapping.
LARGEST = 2**63 - 1

ISO = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-5][0-9](\.[0-9]{3})?(Z|[+-][0-9]{2}:[0-9]{2})$"


# --- time -------------------------------------------------------------------------------------------------


def iso_ms(text: Column) -> Column:
    """FN-D1: strict ISO text of seconds or milliseconds with a zone to epoch milliseconds; others null."""
    return F.when(text.rlike(ISO), F.unix_millis(F.try_to_timestamp(text)))


def ntz_ms(ts: Column) -> Column:
    """Epoch milliseconds of a zoneless UTC timestamp (session zone UTC)."""
    return F.unix_millis(ts.cast("timestamp"))


def local_date(ms: Column, zone: str = "UTC") -> Column:
    """FN-D2: date text of an instant in a zone."""
    return F.date_format(F.from_utc_timestamp(F.timestamp_millis(ms), zone), "yyyy-MM-dd")


def rfc3339(ms: Column) -> Column:
    """FN-D3: text with milliseconds and Z."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def floor_hour(ms: Column) -> Column:
    """FN-D4: start of the UTC hour, also before 1970."""
    return ms - F.pmod(ms, F.lit(HOUR_MS))


def week_start(date: Column, first: int = 0) -> Column:
    """FN-D5: first day of the week of a date; first: 0 Sunday to 6 Saturday."""
    return F.date_sub(date, F.pmod(F.dayofweek(date) - 1 - first, F.lit(7)))


def iso_week(date: Column) -> Column:
    """FN-D6: YYYY-Www with the week's own year."""
    return F.format_string("%04d-W%02d", F.extract(F.lit("YEAROFWEEK"), date), F.weekofyear(date))


def quarter(ms: Column) -> Column:
    """FN-D7: index 0 to 95 of the quarter hour in the UTC day."""
    return F.floor(F.pmod(ms, F.lit(DAY_MS)) / QUARTER_MS).cast("int")


def finalised(date: Column, now_ms: Column, hours: int = 48) -> Column:
    """FN-D8: whether more than so many hours have passed since the end of a UTC day."""
    return now_ms - (F.unix_date(date).cast("long") + 1) * DAY_MS > hours * HOUR_MS


def peak(ms: Column, hours: tuple[tuple[int, int], ...] = ((1, 4), (6, 10))) -> Column:
    """FN-D9: whether an instant lies in the half-open UTC hours of a weekday."""
    at = F.timestamp_millis(ms)
    inside = F.lit(False)
    for a, b in hours:
        inside |= (F.hour(at) >= a) & (F.hour(at) < b)
    return F.dayofweek(at).between(2, 6) & inside


def day_bounds(since: str | None, until: str | None, zone: str) -> tuple[Column | None, Column | None]:
    """FIL-02: [start of since, start of the day after until) as milliseconds, for pre-filters only."""
    start = None if since is None else F.unix_millis(F.to_utc_timestamp(F.lit(since).cast("timestamp"), zone))
    end = None if until is None else F.unix_millis(F.to_utc_timestamp(F.date_add(F.lit(until).cast("date"), 1).cast("timestamp"), zone))
    return start, end


def in_window(date_text: Column, since: str | None, until: str | None) -> Column:
    """FIL-01: dates within both bounds, compared as compact text, so that YYYY and YYYYMM bounds work."""
    compact, keep = F.replace(date_text, F.lit("-"), F.lit("")), F.lit(True)
    if since:
        keep &= compact >= since.replace("-", "")
    if until:
        keep &= compact <= until.replace("-", "")
    return keep


# --- numbers ----------------------------------------------------------------------------------------------


def counter(x: Column) -> Column:
    """A lenient counter: null and negative count as 0."""
    return F.greatest(F.coalesce(x.cast("long"), F.lit(0).cast("long")), F.lit(0).cast("long"))


def capped_sum(x: Column) -> Column:
    """Sum of counters that stops at the largest bigint instead of failing."""
    return F.least(F.sum(x.cast("decimal(38,0)")), F.lit(str(LARGEST)).cast("decimal(38,0)")).cast("long")


def half_away(x: Column, digits: int = 0) -> Column:
    """FN-M1: rounding half away from zero."""
    return F.round(x, digits)


def total_fallback(total: Column, known: Column, output: Column) -> tuple[Column, Column]:
    """PRJ-07: tokens missing from the parts go to the output if that is 0, else to the extra tokens."""
    missing = F.greatest(counter(total) - known, F.lit(0))
    return F.when(output == 0, missing).otherwise(output), F.when(output == 0, F.lit(0)).otherwise(missing)


def split_cached(inclusive: Column, cached: Column, created: Column | None = None) -> tuple[Column, Column]:
    """PRJ-08: (fresh input, cached) of an input count that includes cached tokens; cached is at most the input."""
    used = F.least(counter(cached), counter(inclusive))
    fresh = counter(inclusive) - used
    return (fresh if created is None else F.greatest(fresh - counter(created), F.lit(0))), used


def cache_creation(flat: Column, five: Column, hour: Column, present: Column) -> Column:
    """Tokens written to the cache: the sum of the split where there is one, else the flat count."""
    return F.when(present, counter(five) + counter(hour)).otherwise(counter(flat))


def marginal(tokens: Column, base: Column, above: Column | None, boundary: int = 200_000) -> Column:
    """PRC-02: tokens up to the boundary at one rate, those beyond it at another."""
    high = base if above is None else F.coalesce(above, base)
    return F.least(tokens, F.lit(boundary)) * base + F.greatest(tokens - boundary, F.lit(0)) * high


def whole_request(tokens: Column, context: Column, base: Column, above: Column, threshold: Column) -> Column:
    """PRC-03: all tokens at the other rate once the context is over the threshold."""
    return tokens * F.when(context > threshold, F.coalesce(above, base)).otherwise(base)


# --- text -------------------------------------------------------------------------------------------------


def project_of(path: Column) -> Column:
    """PRJ-01: the folder below projects, or unknown."""
    return F.coalesce(F.nullif(F.trim(F.regexp_extract(path, r"(?:^|/)projects/([^/]+)/", 1)), F.lit("")), F.lit("unknown"))


def session_of(path: Column) -> Column:
    """PRJ-02: the owning session of a file: the folder above subagents, else the folder of a nested file, else its stem."""
    parts = F.split(F.regexp_extract(path, r"(?:^|/)projects/[^/]+/(.*)$", 1), "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.jsonl$", "")
    above = F.get(parts, F.array_position(parts, "subagents").cast("int") - 2)
    nested = F.get(parts, F.size(parts) - 2)
    return F.when((F.array_position(parts, "subagents") > 1), above).when(F.size(parts) > 1, nested).otherwise(stem)


def model_label(model: Column, speed: Column) -> Column:
    """PRJ-03: no label for placeholders in angle brackets, a suffix for fast requests."""
    return F.when(model.isNull() | model.rlike("^<.*>$"), F.lit(None).cast("string")).when(speed == "fast", F.concat(model, F.lit("-fast"))).otherwise(model)


def aliased(model: Column, aliases: dict[str, str]) -> Column:
    """PRJ-04: names by a small configured map; a -fast suffix stays."""
    if not aliases:
        return model
    known = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    base = F.regexp_replace(model, "-fast$", "")
    return F.coalesce(known[model], F.when(model.endswith("-fast"), F.concat(known[base], F.lit("-fast"))), model)


def short_model(model: Column) -> Column:
    """PRJ-06: without a vendor's prefix and a date of eight digits."""
    return F.regexp_replace(F.regexp_replace(model, r"^[a-z]+/", ""), r"-[0-9]{8}$", "")


def project_name(project: Column, aliases: dict[str, str] | None = None) -> Column:
    """PRJ-05: a readable project name: alias, else the last parts of an encoded path without ids."""
    plain = F.regexp_replace(F.regexp_replace(project, r"-[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$", ""), r"^-(?:Users|home)-[^-]+-", "")
    return F.coalesce(aliased(project, aliases) if aliases else F.lit(None), F.nullif(plain, F.lit("")), F.lit("unknown")) if not aliases else F.when(aliased(project, aliases) != project, aliased(project, aliases)).otherwise(F.coalesce(F.nullif(plain, F.lit("")), F.lit("unknown")))


def limit_reset(text: Column, is_error: Column) -> Column:
    """PRJ-10: milliseconds of the seconds after the first bar that follows the limit message, on error rows only; null if they don't fit."""
    digits = F.regexp_extract(text, r"(?s)Claude AI usage limit reached[^|]*\|([0-9]+)", 1)
    seconds = F.nullif(digits, F.lit("")).try_cast("long")
    return F.when(is_error & (seconds > 0) & (seconds <= LARGEST // 1000), seconds * 1000)


def valid_version(version: Column) -> Column:
    """FIL-08: absent, or three numbers with dots at the start."""
    return version.isNull() | version.rlike(r"^[0-9]+\.[0-9]+\.[0-9]")


def not_empty(*columns: Column) -> Column:
    """FIL-08: none of the texts is present and empty."""
    keep = F.lit(True)
    for c in columns:
        keep &= F.coalesce(c, F.lit("?")) != ""
    return keep


# --- hashes -----------------------------------------------------------------------------------------------


def _framed(parts: list[Column]) -> Column:
    """Parts with their lengths before them, so that no two lists of parts look alike; null differs from empty."""
    framed = [F.when(p.isNull(), F.lit("-;")).otherwise(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p, F.lit(";"))) for p in parts]
    return F.concat(*framed)


def salted_key(salt: str, *parts: Column) -> Column:
    """FN-H1: 16 hex digits of a salted hash of the parts."""
    return F.substring(F.sha2(_framed([F.lit(salt), *[p.cast("string") for p in parts]]), 256), 1, 16)


def project_hash(salt: str, project: Column) -> Column:
    """FN-H2: sha256: and 32 hex digits."""
    return F.concat(F.lit("sha256:"), F.substring(F.sha2(_framed([F.lit(salt), project]), 256), 1, 32))


# --- display ----------------------------------------------------------------------------------------------


def thousands(x: Column) -> Column:
    return F.format_number(x, 0)


def money(x: Column) -> Column:
    return F.format_string("$%.2f", x.cast("double"))


def model_lines(models: Column) -> Column:
    """FN-S2: sorted distinct names, one a line with a dash."""
    return F.array_join(F.transform(F.array_sort(F.array_distinct(models)), lambda m: F.concat(F.lit("- "), m)), "\n")

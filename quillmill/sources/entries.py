"""The common table of usage entries that all readers give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions.usage import counter, total_fallback

#: Columns of usage entries with types and the value of those a reader doesn't have.
COLUMNS: dict[str, tuple[str, object]] = {
    "agent": ("string", None), "file_path": ("string", None), "ts_ms": ("bigint", None), "session_id": ("string", None), "project": ("string", None), "project_path": ("string", None),
    "message_id": ("string", None), "request_id": ("string", None), "version": ("string", None), "model": ("string", None), "speed": ("string", None), "is_sidechain": ("boolean", False),
    "input_tokens": ("bigint", 0), "output_tokens": ("bigint", 0), "cache_creation_tokens": ("bigint", 0), "cache_read_tokens": ("bigint", 0), "extra_tokens": ("bigint", 0),
    "stored_cost": ("double", None), "credits": ("double", None), "message_count": ("bigint", None), "limit_reset_ms": ("bigint", None),
}
_COUNTS = ["input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens", "extra_tokens"]


def entries(df: DataFrame, agent: str, keep: list[str] | None = None, **columns: Column) -> DataFrame:
    """A frame as usage entries: given columns, defaults for the others; keep: columns to carry along."""
    chosen = []
    for name, (kind, default) in COLUMNS.items():
        value = F.lit(agent) if name == "agent" else columns.get(name, F.col("file_path") if name == "file_path" and "file_path" in df.columns else F.lit(default))
        chosen.append((counter(value) if name in _COUNTS else value.cast(kind)).alias(name))
    return df.select(*(keep or []), *chosen)


def used(df: DataFrame) -> DataFrame:
    """Entries with a time, a model and any token."""
    return df.where(F.col("ts_ms").isNotNull() & F.col("model").isNotNull() & (sum((F.col(c) for c in _COUNTS[1:]), F.col(_COUNTS[0])) > 0))


def with_total(total: Column, columns: dict[str, Column], extra: Column | None = None) -> dict[str, Column]:
    """Columns with the tokens that only the total knows (PRJ-07)."""
    known = counter(extra) if extra is not None else F.lit(0)
    for c in _COUNTS[:4]:
        known = known + counter(columns.get(c, F.lit(0)))
    output, missing = total_fallback(total, known, counter(columns.get("output_tokens", F.lit(0))))
    return columns | {"output_tokens": output, "extra_tokens": (counter(extra) if extra is not None else F.lit(0)) + missing}

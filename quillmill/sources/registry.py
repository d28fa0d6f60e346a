"""All readers by agent, in the order their entries are put together (SET-01, SRC-39)."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from quillmill.sources import document_agents, jsonl_agents, sqlite_agents
from quillmill.sources.entries import COLUMNS

READERS = jsonl_agents.READERS | document_agents.READERS | sqlite_agents.READERS | {"copilot_sessions": jsonl_agents.copilot_sessions, "openclaw_store": sqlite_agents.openclaw_store}


#: Agents with two kinds of stores, whose entries are put together by a rule of their own.
TOGETHER = {"copilot_sessions": ("copilot", jsonl_agents.copilot_reconciled), "openclaw_store": ("openclaw", sqlite_agents.openclaw_merged)}


def load(spark: SparkSession, stores: dict[str, str | list[str]]) -> tuple[DataFrame | None, dict[str, str]]:
    """Entries of all configured stores, and the error of each that can't be read; names of other stores are read as pi's.

    Each reader counts a record once, whatever number of files has it; stores of one agent are reconciled.
    """
    read, failed = {}, {}
    for name, paths in stores.items():
        try:
            rows = READERS[name](spark, paths) if name in READERS else jsonl_agents.pi(spark, paths, name)
            read[name] = rows.select(*COLUMNS)
        except (PySparkException, OSError, ValueError) as error:
            failed[name] = str(error)
    for name, (first, rule) in TOGETHER.items():
        if name in read and first in read:
            read[first] = rule(read[first], read.pop(name)).select(*COLUMNS)
    found = None
    for rows in read.values():
        found = rows if found is None else found.unionByName(rows)
    return found, failed

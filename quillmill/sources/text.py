"""Files as lines or whole documents, with the path and the order of lines; discovery of log folders."""

from __future__ import annotations

import fnmatch
import json
import os
import re
from datetime import UTC, date, datetime, timedelta
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType


#: Where a reader reads: paths of files or folders, or rows that were read elsewhere, as of stored contents.
Place = str | list[str] | DataFrame


def _named(rows: DataFrame, glob: str) -> DataFrame:
    """Rows of files whose name fits the pattern."""
    return rows.where(F.regexp_extract("file_path", r"([^/]+)$", 1).rlike(fnmatch.translate(glob)))


def read_lines(spark: SparkSession, paths: Place, glob: str = "*.jsonl", any_of: list[str] | None = None) -> DataFrame:
    """SRC-01, SRC-04 to SRC-07: value, file_path, ord of each line below the paths.

    Files stay splittable; ord, a text of block and number, sorts the lines of a file without reading it in
    one task. any_of: lines with none of these markers are dropped before any JSON is parsed. Rows given
    instead of paths have value, file_path and ord.
    """
    if isinstance(paths, DataFrame):
        lines = _named(paths, glob).select("value", "file_path", F.lpad(F.col("ord").cast("string"), 20, "0").alias("ord"))
    else:
        raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(paths)
        lines = raw.select("value", F.url_decode("_metadata.file_path").alias("file_path"), F.format_string("%019d %019d", F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("ord"))
    if any_of:
        keep = F.lit(False)
        for marker in any_of:
            keep |= F.contains("value", F.lit(marker))
        lines = lines.where(keep)
    return lines


def read_documents(spark: SparkSession, paths: Place, glob: str = "*.json") -> DataFrame:
    """value, file_path, modified_ms of each whole file, for formats of one document a file; or of rows given instead."""
    if isinstance(paths, DataFrame):
        return _named(paths, glob).select("value", "file_path", "modified_ms" if "modified_ms" in paths.columns else F.lit(None).cast("long").alias("modified_ms"))
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(paths)
    return raw.select("value", F.url_decode("_metadata.file_path").alias("file_path"), F.unix_millis("_metadata.file_modification_time").alias("modified_ms"))


def roots(configured: str | None, defaults: list[str], below: str) -> list[str]:
    """SRC-02: existing folders of a comma-separated setting, or of the defaults; the folder below itself is accepted. None is an error if set."""
    found = []
    for part in configured.split(",") if configured else defaults:
        path = Path(os.path.expanduser(part.strip()))
        path = path if path.name == below else path / below
        if part.strip() and path.is_dir() and str(path) not in found:
            found.append(str(path))
    if configured and not found:
        raise ValueError(f"none of these folders has {below}: {configured}")
    return found


def project_paths(root: str, project: str | None) -> list[str]:
    """SRC-03: the folder of one project where its name is a single safe part of a path, else the root."""
    if project and project not in (".", "..") and "/" not in project and "\\" not in project and Path(root, project).is_dir():
        return [str(Path(root, project))]
    return [root]


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]+)*$", 1)


def parent_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)


def text(column: Column) -> Column:
    """Trimmed text, null if empty."""
    return F.nullif(F.trim(column), F.lit(""))


def eligible_files(root: str, pattern: str, since: str | None, until: str | None) -> list[str]:
    """SRC-12: files below a folder that can hold lines of a window of days, sorted by path.

    A file is left out only if it was last changed before the window, a day of grace given, or if the date
    in its path lies after it by more than a day; lines are filtered again, so the window is never exact.
    """
    first = date.fromisoformat(since) - timedelta(days=1) if since else date.min
    last = date.fromisoformat(until) + timedelta(days=1) if until else date.max
    found = []
    for path in sorted(Path(root).rglob(pattern)):
        named = re.search(r"/(\d{4})/(\d{2})/(\d{2})/[^/]*$", str(path))
        try:
            begun = date(*map(int, named.groups())) if named else date.min
        except ValueError:
            begun = date.min
        if path.is_file() and not path.is_symlink() and begun <= last and datetime.fromtimestamp(path.stat().st_mtime, UTC).date() >= first:
            found.append(str(path))
    return found


def _pairs(pairs: list[tuple[str, object]]) -> dict:
    members = dict(pairs)
    if len(members) < len(pairs):
        raise ValueError("a member is repeated")
    return members


@pandas_udf(BooleanType())
def _strict(texts: pd.Series) -> pd.Series:
    def one(value: str | None) -> bool:
        try:
            return value is None or json.loads(value, object_pairs_hook=_pairs) is not None
        except (ValueError, RecursionError):
            return False

    return texts.map(one)


def strict_json(df: DataFrame, column: str) -> DataFrame:
    """Rows whose text is JSON in which no object has a member twice.

    Only texts in which a name stands twice at all, be it in different objects, are parsed in Python.
    """
    names = F.regexp_extract_all(column, F.lit(r'"((?:[^"\\]|\\.)*)"\s*:'), 1)
    again = F.size(names) > F.size(F.array_distinct(names))
    return df.where(F.try_parse_json(column).isNotNull()).where(_strict(F.when(again, F.col(column))))

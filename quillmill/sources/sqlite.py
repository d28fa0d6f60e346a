"""Tables of many SQLite files, read as blobs by Spark and opened in memory by the tasks."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from quillmill.sources.text import Place, _named

_ARROW = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
#: Rows in a batch.
ROWS = 10_000


def _typed(value: object, kind: str) -> object:
    """A loose SQLite value in the asked type, or null."""
    if value is None:
        return None
    try:
        if kind == "bigint":
            number = int(value) if not isinstance(value, str) or value.strip().lstrip("-").isdigit() else None
            return number if number is None or -(2**63) <= number < 2**63 else None
        if kind == "double":
            return float(value)
        if kind == "binary":
            return bytes(value) if isinstance(value, (bytes, bytearray)) else None
        return value if isinstance(value, str) else str(value) if not isinstance(value, (bytes, bytearray)) else value.decode("utf-8", "replace")
    except (TypeError, ValueError, OverflowError):
        return None


def stores(spark: SparkSession, paths: Place, pattern: str = "*.db") -> DataFrame:
    """file_path and content of SQLite files below a path of any file system Spark reads, or of such rows given instead."""
    if isinstance(paths, DataFrame):
        return _named(paths, pattern).select("file_path", "content")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(paths)
    return raw.select(F.url_decode(F.replace("path", F.lit("%"), F.lit("%25"))).alias("file_path"), "content")


def read_table(spark: SparkSession, paths: Place, name: str, columns: str, pattern: str = "*.db") -> DataFrame:
    """file_path and the columns asked for of a table in all SQLite files below a path; columns: their names and types.

    Columns a file lacks are null, a file without the table gives no rows, an empty file neither. A file is
    opened in the memory of one task, so it must fit there (Spark reads no file over 2 GB); its rows are
    passed on in batches.
    """
    asked = _parse_datatype_string(columns)
    schema = StructType([*_parse_datatype_string("file_path string").fields, *asked.fields])
    kinds = [f.dataType.simpleString() for f in asked.fields]

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                content = bytearray(blob.as_py() or b"")
                if len(content) < 100:
                    continue
                content[18:20] = b"\x01\x01"  # a file in write-ahead mode can't be opened in memory; its log isn't here
                connection = sqlite3.connect(":memory:")
                try:
                    connection.deserialize(bytes(content))
                    have = {row[1] for row in connection.execute(f'pragma table_info("{name}")')}
                    if not have:
                        continue
                    listed = ", ".join(f'"{f.name}"' if f.name in have else "null" for f in asked.fields)
                    found = connection.execute(f'select {listed} from "{name}"')
                    while rows := found.fetchmany(ROWS):
                        values = [pa.array([_typed(v, k) for v in column], _ARROW[k]) for column, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                        yield pa.record_batch([pa.array([path] * len(rows)), *values], names=schema.names)
                finally:
                    connection.close()

    return stores(spark, paths, pattern).mapInArrow(load, schema)

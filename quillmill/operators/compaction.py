"""Many tiny log files into a few large ones, clustered on a Hilbert curve (problem 1)."""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from quillmill.functions.hilbert import hilbert_codes
from quillmill.runtime import discard, new_path, persisted, temporary

#: Bits of each of the two coordinates: at most 2^16 cells.
BITS = 8
#: Bytes of records in a written file.
TARGET_BYTES = 128 << 20

_KEYS = "struct<sessionId:string,payload:struct<model:string>,message:struct<model:string>>"


@dataclass(frozen=True)
class Compacted:
    path: str
    files: int
    records: int
    digest: tuple


def current_files(files: DataFrame) -> DataFrame:
    """The files that count: of those with one machine and path (but for a leading archived_), those not
    archived go first, then the lowest file_id. Files without machine or path have no copies.

    The ids of the files that lose, which are few, are found from ids and paths alone and go to a table, so
    that Spark knows its size: below its broadcast threshold contents stay where they are.
    """
    names = files.select("file_id", "machine_id", F.regexp_replace("path", "^archived_", "").alias("_path"), F.struct(F.col("path").startswith("archived_").alias("late"), F.col("file_id").alias("id")).alias("_rank"))
    best = names.groupBy("machine_id", "_path").agg(F.min("_rank").alias("_best"), F.count(F.lit(1)).alias("_copies")).where("_copies > 1")
    losers = names.join(best, ["machine_id", "_path"]).where("file_id <> _best.id").select("file_id")
    return files.join(persisted(losers, "p1-losers"), "file_id", "left_anti")


def records_of(files: DataFrame) -> DataFrame:
    """file_id, line_no, record: the lines that aren't blank, without a byte-order mark before the first.

    Lines end with LF or CRLF and count from 1 with blank ones; other line separators of Unicode belong to
    a record. Null and empty files have none. A file is read by one task, as it is one row.
    """
    # What holds for a whole file is worked out before its lines are listed, once a file.
    whole = files.select("file_id", "path", F.regexp_extract("content", r'"model(?:_name)?"\s*:\s*"([^"\\]*)"', 1).alias("_model"), F.split(F.regexp_replace("content", "^﻿", ""), "\r?\n", -1).alias("_lines"))
    lines = whole.select("file_id", "path", "_model", F.posexplode("_lines").alias("_pos", "record"))
    return lines.where(F.col("record").rlike(r"(?U)\S")).select("file_id", (F.col("_pos") + 1).cast("int").alias("line_no"), "record", "path", "_model")


def running(df: DataFrame, order: list[str], value: str, label: str) -> DataFrame:
    """df with _before, the sum of a column over all rows earlier in the order, as a table.

    Rows are split by range, so that no key gathers in one task; each part is summed by itself, and the
    sums of the parts, one number a task, give its offset.
    """
    spread = persisted(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), label)
    offsets = spread.groupBy("_part").agg(F.sum(value).alias("_sum")).select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    within = F.coalesce(F.sum(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = spread.withColumn("_within", within).join(F.broadcast(offsets), "_part")  # a row a task
    return placed.withColumn("_before", F.col("_within") + F.col("_offset")).drop("_within", "_offset", "_part")


def ranks(entries: DataFrame, columns: list[str], size: int, bits: int = BITS) -> dict[str, list[bytes]]:
    """For each text column the values at which a new rank begins: cells of equal bytes in the order of its values, less than 2^bits.

    The exact histogram of each column's values is cut where the cumulated bytes pass a cell; only the values
    that start a cell reach the driver. A value's rank is the number of starts that aren't beyond it.
    """
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("_which"), F.col(c).alias("_value")) for k, c in enumerate(columns)]))
    histogram = entries.select(each.alias("_e"), "bytes").groupBy("_e._which", "_e._value").agg(F.sum("bytes").alias("bytes"))
    cell = F.floor((F.col("_before") - F.col("_which") * size) * (1 << bits) / max(1, size))
    starts: dict[int, list[bytes]] = {k: [] for k in range(len(columns))}
    for which, _, value in running(histogram, ["_which", "_value"], "bytes", "p1-values").groupBy("_which", cell.alias("_cell")).agg(F.min("_value")).collect():
        starts[which].append(value.encode())
    # The first cell's start is left out, so that ranks begin at 0.
    return {c: sorted(starts[k])[1:] for k, c in enumerate(columns)}


def _ranked(values: pd.Series, starts: list[bytes]) -> np.ndarray:
    """Ranks of texts; each distinct one is looked up once a batch."""
    codes, distinct = pd.factorize(values)
    return np.array([bisect_right(starts, v.encode()) for v in distinct] or [0], np.int64)[codes]


def _code_udf(starts: dict[str, list[bytes]]):
    """Code of a session and a model on the curve."""

    @pandas_udf(LongType())
    def code(session: pd.Series, lead: pd.Series) -> pd.Series:
        return pd.Series(hilbert_codes(_ranked(session, starts["session"]), _ranked(lead, starts["_lead"]), BITS))

    return code


def _place_udf(starts: dict[str, list[bytes]], cuts):
    """File and code of a record as one number, file * 4^BITS + code; cuts: broadcast first entries of all files."""

    @pandas_udf(LongType())
    def place(session: pd.Series, lead: pd.Series, mark: pd.Series, file_id: pd.Series) -> pd.Series:
        first = cuts.value
        code = hilbert_codes(_ranked(session, starts["session"]), _ranked(lead, starts["_lead"]), BITS)
        here = np.empty(len(code), first.dtype)
        here["code"], here["hash"], here["file_id"] = code, mark, file_id
        # The records of one source file and session have one place.
        _, at, back = np.unique(here, return_index=True, return_inverse=True)
        return pd.Series((np.searchsorted(first, here[at], side="right") - 1)[back] * (1 << 2 * BITS) + code)

    return place


def compact(files: DataFrame, target_bytes: int = TARGET_BYTES, path: str | None = None) -> Compacted:
    """Write every record of the current files once, into files of about target_bytes each, below a path (in the shared folder if not given).

    Coordinates of a record are the ranks of its session and of its file's first model, which keep the order
    of the texts. A first pass adds up bytes and digests by session, model and source file: the exact
    histogram, from which come the ranks, and, cumulated along (code, session, source file), the first entry
    of each written file. So a cell is cut along the curve: sessions stay together, and a cell, session or
    model that holds a third of all rows spreads over as many files as its bytes need. A second pass finds
    each record's file by binary search among these entries (24 bytes a file are broadcast, and less than 2^8
    texts a coordinate), moves it there once, and writes the files sorted. The written rows are read again and must
    have the source's count and digests, else an error is raised.
    """
    spark = files.sparkSession
    # A generator of one row, so that the parsed keys aren't worked out again for each use of them.
    keys = F.inline(F.array(F.struct(F.from_json("record", _KEYS).alias("_keys"))))
    rows = (
        records_of(current_files(files))
        .select("*", keys)
        .select("file_id", "line_no", F.coalesce("_keys.sessionId", "path", F.lit("")).alias("session"), F.coalesce("_keys.payload.model", "_keys.message.model", "_model").alias("model"), "record", F.coalesce("_model", F.lit("")).alias("_lead"))
    )
    size = F.octet_length("record") + 1
    mark = F.xxhash64("file_id", "line_no", "record")
    digests = [F.count(F.lit(1)), F.coalesce(F.sum(mark.cast("decimal(38,0)")), F.lit(0)), F.coalesce(F.bit_xor(mark), F.lit(0))]
    entries = persisted(rows.groupBy("session", "_lead", "file_id").agg(F.sum(size).alias("bytes"), *[d.alias(n) for d, n in zip(digests, ("n", "sum", "xor"), strict=True)]), "p1-histogram")
    size_all, *source = entries.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("sum"), F.lit(0)), F.coalesce(F.bit_xor("xor"), F.lit(0))).first()
    count = max(1, -(-size_all // target_bytes))
    starts = ranks(entries, ["session", "_lead"], size_all)
    coded = entries.select(_code_udf(starts)("session", "_lead").alias("code"), F.xxhash64("session").alias("_hash"), "file_id", "bytes")
    along = running(coded, ["code", "_hash", "file_id"], "bytes", "p1-along")
    number = F.floor(F.col("_before") * count / max(1, size_all)).cast("int")
    first = along.groupBy(number.alias("_file")).agg(F.min(F.struct("code", "_hash", "file_id")).alias("c")).select("c.*").collect()  # a row a file
    cuts = spark.sparkContext.broadcast(np.sort(np.array([tuple(r) for r in first], [("code", "<i8"), ("hash", "<i8"), ("file_id", "<i8")])))
    path = path or new_path(spark, "p1-records")
    placed = rows.withColumn("_place", _place_udf(starts, cuts)("session", "_lead", F.xxhash64("session"), "file_id")).withColumns({"_file": F.floor(F.col("_place") / (1 << 2 * BITS)).cast("int"), "code": F.pmod("_place", F.lit(1 << 2 * BITS))})
    placed.repartitionById(count, F.col("_file")).sortWithinPartitions("code", "session", "file_id", "line_no").select("file_id", "line_no", "session", "model", "record").write.parquet(path)
    temporary(spark, path)
    written = spark.read.parquet(path).agg(*digests).first()
    discard(entries)
    if tuple(written) != tuple(source):
        raise RuntimeError(f"written records differ from the source: {tuple(written)} and {tuple(source)}")
    return Compacted(path, count, source[0], tuple(source[1:]))

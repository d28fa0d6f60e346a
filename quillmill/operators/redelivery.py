"""Messages delivered more than once (problem 6), split by the frequency of their identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.runtime import persisted

#: Words of 64 bits in the bitmap of hashes, which bound its broadcast.
FILTER_WORDS = 1 << 20

# Code points with the Unicode property White_Space, and U+001C to U+001F.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　"


def bare(column: Column) -> Column:
    """Text without white space around it."""
    return F.trim(column, F.lit(SPACES))


def _hashed(df: DataFrame, key: list[Column], known: Column) -> DataFrame:
    """Rows with their identifier's parts, _known and _hash; the position of nulls goes into the hash, as xxhash64 skips them."""
    parts = {f"_k{i}": k for i, k in enumerate(key)}
    rows = df.withColumns({**parts, "_known": F.coalesce(known, F.lit(False))})
    return rows.withColumn("_hash", F.xxhash64(*[F.col(p) for p in parts], *[F.col(p).isNull() for p in parts]))


def _filter(hashes: DataFrame) -> DataFrame:
    """A bitmap of hashes as words of 64 bits: at most 2^20 rows of 16 bytes, whatever the number of hashes."""
    word = F.pmod(F.shiftright("_hash", 6), F.lit(FILTER_WORDS).cast("long"))
    return hashes.groupBy(word.alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(_hash, 64) as int))")).alias("_bits"))


def _suspects(rows: DataFrame, words: DataFrame) -> DataFrame:
    """Rows with _suspect: false proves that the hash isn't in the bitmap. No row moves, as the bitmap is broadcast."""
    word = F.pmod(F.shiftright("_hash", 6), F.lit(FILTER_WORDS).cast("long"))
    bit = F.expr("shiftright(_bits, cast(pmod(_hash, 64) as int)) & 1L") == 1
    joined = rows.withColumn("_word", word).join(F.broadcast(words), "_word", "left")  # at most 2^20 rows: a proven bound of 16 MB
    return joined.withColumn("_suspect", F.coalesce(F.col("_known") & bit, F.lit(False))).drop("_word", "_bits")


def split_by_frequency(df: DataFrame, row_id: str, key: list[Column], known: Column) -> tuple[DataFrame, DataFrame]:
    """(rows passed as singletons, rows of repeated groups with _keep, the smallest row id of their group).

    key: the parts of the identifier, null agreeing with null; known: whether a row can be a copy at all.

    Frequencies are aggregated on a 64-bit hash of the identifier, 16 bytes a distinct hash after partial
    aggregation; those that occur more than once go to a table. A broadcast bitmap of them, of bounded
    size, lets nearly all other rows pass where they are. Only rows it can't clear are joined with the table
    (so whole rows move only if repeated, as long as repeated hashes are fewer than the bitmap's 2^26 bits,
    and correctly beyond). Repeated groups are then ranked by their real identifiers with a partially
    aggregated minimum and joined back; no group is ever gathered in one task, and AQE splits a hot group.

    Defined results: rows that aren't known pass as singletons, also when equal; ties of row ids (which
    should be unique) keep all rows with that id; an empty table gives empty results.
    """
    parts = [f"_k{i}" for i in range(len(key))]
    helpers = ["_hash", "_known", "_suspect", *parts]
    hashed = _hashed(df, key, known)
    repeated_hash = persisted(hashed.where("_known").groupBy("_hash").agg(F.count(F.lit(1)).alias("_times")).where("_times > 1").select("_hash"), "p6-repeated")
    marked = _suspects(hashed, persisted(_filter(repeated_hash), "p6-bitmap"))
    suspects = marked.where("_suspect")
    single = marked.where("not _suspect").drop(*helpers).unionByName(suspects.join(repeated_hash, "_hash", "left_anti").drop(*helpers))
    repeated = suspects.join(repeated_hash, "_hash", "left_semi")
    smallest = repeated.groupBy("_hash", *parts).agg(F.min(row_id).alias("_keep"))
    same = F.col("r._hash") == F.col("s._hash")
    for p in parts:
        same &= F.col(f"r.{p}").eqNullSafe(F.col(f"s.{p}"))
    ranked = repeated.alias("r").join(smallest.alias("s"), same).select("r.*", "s._keep").drop(*helpers)
    return single, ranked


def exactly_once(df: DataFrame | list[DataFrame], row_id: str, key: list[Column], known: Column) -> DataFrame:
    """All rows but the repetitions: singletons passed directly, and the first of each repeated group.

    df: a table, or several, as of stored and new messages, that are taken as one; columns that one lacks are null.
    """
    single, ranked = split_by_frequency(_one(df), row_id, key, known)
    return single.unionByName(ranked.where(F.col(row_id) == F.col("_keep")).drop("_keep"))


def repetitions(df: DataFrame | list[DataFrame], row_id: str, key: list[Column], known: Column) -> DataFrame:
    """The rows that exactly_once leaves out."""
    return split_by_frequency(_one(df), row_id, key, known)[1].where(F.col(row_id) != F.col("_keep")).drop("_keep")


def _one(df: DataFrame | list[DataFrame]) -> DataFrame:
    tables = df if isinstance(df, list) else [df]
    rows = tables[0]
    for more in tables[1:]:
        rows = rows.unionByName(more, allowMissingColumns=True)
    return rows


def to_append(stored: DataFrame, new: DataFrame, row_id: str, key: list[Column], known: Column) -> DataFrame:
    """New rows to append to a stored table: of each message that isn't stored the one with the smallest row id.

    Stored rows are read for their identifiers alone and never move but for the hashes that new rows share:
    a bitmap of the new rows' hashes clears the others. Rows that aren't known are all appended.
    """
    parts = [f"_k{i}" for i in range(len(key))]
    fresh = _hashed(exactly_once(new, row_id, key, known), key, known)
    words = persisted(_filter(fresh.where("_known").select("_hash").distinct()), "p6-bitmap")
    held = _suspects(_hashed(stored, key, known), words).where("_suspect").select("_hash", *parts).distinct()
    same = F.col("n._hash") == F.col("h._hash")
    for p in parts:
        same &= F.col(f"n.{p}").eqNullSafe(F.col(f"h.{p}"))
    unknown, candidates = fresh.where("not _known"), fresh.where("_known")
    return unknown.unionByName(candidates.alias("n").join(held.alias("h"), same, "left_anti")).drop("_hash", "_known", *parts)

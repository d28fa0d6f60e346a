"""Filling containers of fixed capacity with items that stay whole (problem 9).

The instance is the histogram of sizes, at most as many numbers as the capacity, whatever the number of
items. It is reduced by the dominance criterion of Martello and Toth: a container is fixed for good where
one of its feasible sets dominates all others; here sets of one and two items, tested exactly against all
pairs and triples. The rest is packed best-fit by descending size. Both steps work on classes of equal
items and equal containers with a multiplicity, so their cost doesn't grow with the number of items.
Items are then given their places by their rank among those of their size.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.runtime import persisted

#: A pattern: times it is used, and (size, items of that size in one container).
Pattern = tuple[int, list[tuple[int, int]]]


def _best_pair(sizes: list[int], counts: dict[int, int], room: int) -> int:
    """Greatest sum of two other items that fit into room, or 0."""
    best, high = 0, bisect_right(sizes, room) - 1
    low = 0
    while low <= high:
        total = sizes[low] + sizes[high]
        if total > room or (low == high and counts[sizes[low]] < 2):
            high -= 1
        else:
            best = max(best, total)
            if best == room:
                break
            low += 1
    return best


def _least(sizes: list[int], counts: dict[int, int], n: int) -> int | None:
    """Sum of the n smallest items, or None if there are fewer."""
    total = 0
    for s in sizes:
        take = min(n, counts[s])
        total, n = total + take * s, n - take
        if not n:
            return total
    return None


def reduce(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Patterns that dominate all alternatives, and the items left.

    For the largest item j with room r beside it: alone if nothing fits; with the largest fitting i if that
    fills the room, or if no two others fit, or if i is at least the best pair and no three others fit.
    """
    counts = {s: n for s, n in counts.items() if n > 0}
    fixed: list[Pattern] = []
    sizes = sorted(counts)
    changed = True
    while changed and sizes:
        changed = False
        for j in reversed(sizes[:]):
            while counts.get(j):
                room = capacity - j
                counts[j] -= 1  # one j is in the container; what remains is beside it
                if not counts[j]:
                    sizes.remove(j)
                    del counts[j]
                k = bisect_right(sizes, room) - 1
                i = sizes[k] if k >= 0 else None
                if i is None:
                    times, items = 1 + counts.get(j, 0), [(j, 1)]
                    if j in counts and 2 * j <= capacity:
                        times = 1
                    used = {j: times - 1}
                else:
                    two, three = _least(sizes, counts, 2), _least(sizes, counts, 3)
                    good = i == room or two is None or two > room or ((three is None or three > room) and _best_pair(sizes, counts, room) <= i)
                    if not good:
                        counts[j] = counts.get(j, 0) + 1
                        if counts[j] == 1:
                            insort(sizes, j)
                        break
                    # The same choice holds while both sizes last: fewer others can only dominate less.
                    if i == j:
                        times, items = 1 + (counts[j] - 1) // 2, [(j, 2)]
                        used = {j: 2 * times - 1}
                    else:
                        times, items = 1 + min(counts.get(j, 0), counts[i] - 1), [(j, 1), (i, 1)]
                        used = {j: times - 1, i: times}
                for s, n in used.items():
                    if n:
                        counts[s] -= n
                        if not counts[s]:
                            del counts[s]
                            sizes.remove(s)
                fixed.append((times, items))
                changed = True
    return fixed, counts


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit by descending size, on classes of containers with equal contents."""
    open_at: dict[int, list[list]] = {}  # room: classes [times, items]
    rooms: list[int] = []

    def put(room: int, times: int, items: list) -> None:
        if times:
            if room not in open_at:
                open_at[room] = []
                insort(rooms, room)
            open_at[room].append([times, items])

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            k = bisect_left(rooms, size)
            if k == len(rooms):
                each = min(capacity // size, left)
                times, rest = divmod(left, each)
                put(capacity - each * size, times, [(size, each)])
                if rest:
                    put(capacity - rest * size, 1, [(size, rest)])
                break
            room = rooms[k]
            times, items = open_at[room].pop()
            if not open_at[room]:
                del open_at[room]
                del rooms[k]
            each = min(room // size, left)
            full = min(times, left // each)
            put(room, times - full, items)
            put(room - each * size, full, [*items, (size, each)])
            left -= full * each
    return [(times, items) for classes in open_at.values() for times, items in classes]


def solve(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns that hold every item; sizes from 1 to the capacity."""
    fixed, rest = reduce(counts, capacity)
    return fixed + best_fit(rest, capacity)


def _places(patterns: list[Pattern], capacity: int) -> tuple[np.ndarray, ...]:
    """Arrays (start, container, each) by size and rank: items of a size from a rank on fill containers from a number on, so many in each."""
    next_rank: dict[int, int] = {}
    rows, container = [], 0
    for times, items in patterns:
        for size, each in items:
            rank = next_rank.get(size, 0)
            rows.append((size, rank, container, each))
            next_rank[size] = rank + times * each
        container += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    # size and rank in one sortable number; ranks stay below 2^50
    return (table[:, 0] << 50) + table[:, 1], table[:, 2], table[:, 3]


def pack(sizes: DataFrame, capacity: int = 2048, share: int = 500_000) -> DataFrame:
    """doc_id, piece, start, n_tokens, container: each document's place.

    sizes: doc_id (unique) and n_tokens. A document over the capacity, and only such a one, is cut into
    full pieces and a rest. Defined results: documents of null or no tokens take no space and get no
    container (null); an empty table gives no rows.

    Only the histogram reaches the driver (at most capacity numbers), and only the patterns are broadcast,
    of which there are a few for each size. Ranks within a size are counted in salted parts, one for each
    share of the documents, so that no task ranks many more than share items whatever their sizes.
    """
    salts = 1 + sizes.count() // share
    n = F.coalesce("n_tokens", F.lit(0)).cast("long")
    starts = F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1, F.lit(capacity).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    pieces = persisted(
        sizes.select("doc_id", n.alias("_n"), F.posexplode(starts).alias("piece", "start")).select(
            "doc_id", "piece", "start", F.least(F.col("_n") - F.col("start"), F.lit(capacity)).alias("n_tokens"), F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int").alias("_salt")
        ),
        "p9-pieces",
    )
    parts = persisted(pieces.where("n_tokens > 0").groupBy("n_tokens", "_salt").agg(F.count(F.lit(1)).alias("_count")), "p9-parts")
    histogram = {r[0]: r[1] for r in parts.groupBy("n_tokens").agg(F.sum("_count")).collect()}  # at most capacity rows
    start, container, each = _places(solve(histogram, capacity), capacity)
    before = Window.partitionBy("n_tokens").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)  # at most salts rows each
    offsets = parts.select("n_tokens", "_salt", F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_offset"))
    ranked = (
        pieces.where("n_tokens > 0")
        .withColumn("_rank", F.row_number().over(Window.partitionBy("n_tokens", "_salt").orderBy("doc_id", "piece")) - 1)
        .join(offsets, ["n_tokens", "_salt"])
        .select("doc_id", "piece", "start", "n_tokens", (F.col("_rank") + F.col("_offset")).alias("_rank"))
    )
    table = sizes.sparkSession.sparkContext.broadcast((start, container, each))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("container", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin, first, many = table.value
        for b in batches:
            size, rank = (b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (3, 4))
            key = (size << 50) + rank
            k = np.searchsorted(begin, key, side="right") - 1
            yield pa.record_batch([*b.columns[:4], pa.array(first[k] + (key - begin[k]) // many[k])], names=schema.names)

    placed = ranked.mapInArrow(place, schema)
    return placed.unionByName(pieces.where("n_tokens <= 0").select("doc_id", "piece", "start", "n_tokens", F.lit(None).cast("long").alias("container")))

"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``PLACES`` places. Every shard has virtual nodes at hashed places, and a row goes to
the first virtual node clockwise from the place of its key's hash. A shard takes no more rows than
its bound; rows beyond it continue clockwise to the next node whose shard has room. The bounds add up to the
number of rows, so counts differ by one at most.

Only counts per place meet on the driver, ``PLACES`` numbers whatever the data; they give the rows
of each place, by rank, to shards. Ranks come from counts per (place, part) and a
window within each part, so rows of one place or one repeated key are ranked by many tasks.

Defined cases: a null key counts as the empty text; repeated rows and equal keys are spread over
parts and each has its own slot; an empty table gives no rows; columns with the names of the outputs are replaced.
"""

from __future__ import annotations

import bisect
import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyfield.session import written

PLACES = 4096
NODES = 64
PARTS = 16


def place_of(key: Column, places: int = PLACES) -> Column:
    """The place of a key: the first 32 bits of its md5, modulo the number of places."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % places).cast("int")


def ring(shards: int, nodes: int = NODES, places: int = PLACES) -> list[tuple[int, int]]:
    """(place, shard) of all virtual nodes, clockwise; each node depends on its own shard and number only."""
    return sorted(
        (int(hashlib.md5(f"{s}:{v}".encode()).hexdigest()[:8], 16) % places, s)
        for s in range(shards)
        for v in range(nodes)
    )


def spread(counts: dict[int, int], shards: int, nodes: int = NODES, places: int = PLACES):
    """Give the rows of each place to shards; (place, first rank, last rank + 1, shard, first slot).

    First each node takes what falls to it, up to its shard's bound. What is left walks on
    clockwise from where it was refused, place after place, until all of it is taken.
    """
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    at = ring(shards, nodes, places)
    starts = [p for p, _ in at]
    out, refused = [], []

    def take(shard: int, place: int, first: int, last: int) -> int:
        n = min(last - first, room[shard] - used[shard])
        if n:
            out.append((place, first, first + n, shard, used[shard]))
            used[shard] += n
        return first + n

    for place, count in sorted(counts.items()):
        node = bisect.bisect_left(starts, place) % len(at)
        left = take(at[node][1], place, 0, count)
        if left < count:
            refused.append((node, place, left, count))
    for node, place, first, last in refused:
        while first < last:
            node = (node + 1) % len(at)
            first = take(at[node][1], place, first, last)
    return out


def assign_shards(
    df: DataFrame, key: str = "doc_id", shards: int = 16, nodes: int = NODES, parts: int = PARTS
) -> DataFrame:
    """Add ``shard`` and ``slot``, the row's number within its shard, gapless from 0.

    ``df`` is written once with its places; give it the columns that are wanted and no more.
    """
    spark = df.sparkSession
    df = df.drop("shard", "slot")
    placed = written(
        df.withColumn("_place", place_of(F.col(key)))
        .withColumn("_row", F.monotonically_increasing_id())
        .withColumn("_part", F.pmod(F.xxhash64("_row"), F.lit(parts)).cast("int")),
        "shard-places",
    )
    sizes = placed.groupBy("_place", "_part").agg(F.count(F.lit(1)).alias("_n"))
    counts = {r._place: r.n for r in sizes.groupBy("_place").agg(F.sum("_n").alias("n")).collect()}
    by_place: dict[int, list] = {}
    for place, first, last, shard, slot in spread(counts, shards, nodes):
        by_place.setdefault(place, []).append({"a": first, "b": last, "s": shard, "t": slot})
    kind = "array<struct<p:int,g:array<struct<a:bigint,b:bigint,s:int,t:bigint>>>>"
    given = json.dumps([{"p": p, "g": g} for p, g in by_place.items()])
    table = spark.range(1).select(F.inline(F.from_json(F.lit(given), kind))).toDF("_place", "_given")
    before = Window.partitionBy("_place").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_place", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_place", "_part").orderBy("_row")
    ranked = (
        placed.withColumn("_nth", F.row_number().over(within))
        .join(F.broadcast(offsets), ["_place", "_part"])  # at most PLACES * parts rows
        .withColumn("_rank", F.col("_before") + F.col("_nth") - 1)
    )
    rank = F.col("_rank")
    mine = F.filter("_given", lambda g: (g["a"] <= rank) & (rank < g["b"]))[0]
    return (
        ranked.join(F.broadcast(table), "_place")  # at most PLACES rows
        .withColumn("_mine", mine)
        .withColumn("shard", F.col("_mine.s"))
        .withColumn("slot", (F.col("_mine.t") + rank - F.col("_mine.a")).cast("long"))
        .select(*df.columns, "shard", "slot")
    )

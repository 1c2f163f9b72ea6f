"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points of a ring of 2**31 places.  A row is hashed
to a place and goes to the shard that owns the next point clockwise.  Shards
have capacities, as equal as whole numbers allow, so rows that find a shard
full continue clockwise to the next one that has room: the counts differ by one
at most, and only rows of overfull arcs move.

The rows of an arc are ranked by place, id and content.  The driver sees the
number of rows of each arc (shards * vnodes numbers) and decides for whole
ranges of ranks; rows then find their range by their rank.

Defined results: a null text has no bytes and the checksum of an empty one;
repeated rows are rows of their own and fill neighbouring slots; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import materialize

RING = 1 << 31


def ring_points(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(place, shard), by place.  A shard's points don't depend on the number of shards."""
    return sorted({zlib.crc32(f"shard {s} point {v}".encode()) * 2654435761 % RING: s for s in range(shards) for v in range(vnodes)}.items())


def capacities(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def fill(arcs: list[tuple[int, int]], rows: list[int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end, shard, first slot): who takes which rows of each arc.

    Each shard first takes the rows of its own arcs, in ring order; what it has no
    room for moves on clockwise, past points of full shards.
    """
    room, used, out, over = list(room), [0] * len(room), [], []
    for arc, (_, shard) in enumerate(arcs):
        take = min(rows[arc], room[shard])
        if take:
            out.append((arc, 0, take, shard, used[shard]))
            used[shard] += take
            room[shard] -= take
        if take < rows[arc]:
            over.append((arc, take))
    for arc, first in over:
        step = 1
        while first < rows[arc]:
            shard = arcs[(arc + step) % len(arcs)][1]
            take = min(rows[arc] - first, room[shard])
            if take:
                out.append((arc, first, first + take, shard, used[shard]))
                used[shard] += take
                room[shard] -= take
                first += take
            step += 1
    return sorted(out)


def assign(docs: DataFrame, shards: int = 16, vnodes: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, place, shard and slot of every row."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    points = ring_points(shards, vnodes)
    # Rows of one id and text may be a large part of all: their places differ by row.
    place = F.pmod(F.xxhash64("doc_id"), F.lit(RING))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = slim.withColumn("place", place)
    sorted_rows = placed.repartitionByRange(parts, "place", "doc_id", "text_crc32", "size", F.rand(17)).withColumn("part", F.spark_partition_id())
    tabled = materialize(sorted_rows.withColumn("arc", _arc_of(F.col("place"), points)), "shard-places")
    # Rank within (partition, arc), then the number of rows of the arc in earlier partitions.
    local = F.row_number().over(Window.partitionBy("part", "arc").orderBy("place", "doc_id", "text_crc32", "size")) - 1
    counts = tabled.groupBy("part", "arc").count().collect()  # partitions are ranges, so arcs + partitions rows
    per_arc, before = [0] * len(points), []
    for part, arc, n in sorted(tuple(r) for r in counts):
        before.append((part, arc, per_arc[arc]))
        per_arc[arc] += n
    ranges = fill(points, per_arc, capacities(sum(per_arc), shards))
    base = spark.createDataFrame(before, "part int, arc int, earlier long")
    by_arc: dict[int, list] = {}
    for arc, first, end, shard, slot in ranges:
        by_arc.setdefault(arc, []).append((first, end, shard, slot))
    takers = spark.createDataFrame(sorted(by_arc.items()), "arc int, takers array<struct<first: long, end: long, shard: int, slot: long>>")
    ranked = tabled.withColumn("local", local).join(F.broadcast(base), ["part", "arc"]).withColumn("rank", F.col("local") + F.col("earlier"))
    taken = ranked.join(F.broadcast(takers), "arc").withColumn("taker", F.expr("filter(takers, t -> rank >= t.first and rank < t.end)[0]"))
    return taken.select("doc_id", "size", "text_crc32", "place", F.col("taker.shard").alias("shard"), F.expr("taker.slot + rank - taker.first").alias("slot"))


def _arc_of(place, points: list[tuple[int, int]]):
    """Index of the first point at or after ``place``, around the ring.

    The ring is cut into equal sectors: an array names the points of each and how many lie before it.
    """
    sectors = 1 << max(1, len(points) - 1).bit_length()
    width = -(-RING // sectors)
    inside: list[list[int]] = [[] for _ in range(sectors)]
    for p, _ in points:
        inside[p // width].append(p)
    before, n = [], 0
    for ps in inside:
        before.append(n)
        n += len(ps)
    points_of = F.expr("array(" + ",".join("array(" + ",".join(f"{p}L" for p in ps) + ")" if ps else "cast(array() as array<bigint>)" for ps in inside) + ")")
    before_of = F.expr("array(" + ",".join(map(str, before)) + ")")
    sector = F.floor(place / width).cast("int")
    index = F.get(before_of, sector) + F.size(F.filter(F.get(points_of, sector), lambda p: p < place))
    return F.pmod(index, F.lit(len(points))).cast("int")


def shard_of(place: int, points: list[tuple[int, int]]) -> int:
    """The owner of a place when no shard is full; for tests and single look-ups."""
    return points[bisect.bisect_left([p for p, _ in points], place) % len(points)][1]


def report(docs: DataFrame, shards: int = 16) -> DataFrame:
    """The law kept is ``rows``: counts at most one apart."""
    found = assign(docs, shards)
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

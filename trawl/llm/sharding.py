"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns `virtual_nodes` points of a 64-bit ring; a row belongs to the
arc its key's hash falls into, that is to the next point clockwise.  A shard
takes no more than its capacity: rows that find it full continue clockwise to
the next point whose shard has room.  With the tightest capacities (shares of
the row count that differ by one at most) every shard ends exactly full, so row
counts are at most one apart whatever the keys; rows move only where a shard
overflows.

The rows never meet in one place.  They are counted per arc; the walk along the
ring then runs over the arc counts, whose number is fixed by the ring and not by
the data, and yields rank intervals per arc; each row finds its interval by its
rank within its arc.  The main path is DataFrame code only.

Defined results: null text counts as no bytes and crc 0; texts of any length
count in full; null keys hash like any other value; rows of an arc are ranked by
hash, key, crc and size, equal rows in any order; repeated rows are placed one by
one; an empty table gives no rows; extra columns are dropped, whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import group_ranks, part, small, table, written

BUCKET_BITS = 12


def ring(spark, shards: int, virtual_nodes: int) -> list[tuple[int, int]]:
    """(position, shard) in ring order.  Its size is a parameter, not a property of the data."""
    node = spark.range(shards * virtual_nodes).select((F.col("id") % shards).alias("shard"), F.floor(F.col("id") / shards).alias("node"))
    rows = node.select("shard", F.xxhash64(F.lit("ring"), "shard", "node").alias("at")).collect()
    return sorted((r["at"], r["shard"]) for r in rows)


def segments(points: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """(bucket, lowest hash, highest hash, arc): the arcs, cut at the borders of equal buckets of the hash space."""
    low, high, width = -(2**63), 2**63 - 1, 2 ** (64 - BUCKET_BITS)
    ends = [(low, points[0][0], 0)]
    ends += [(a[0] + 1, b[0], i + 1) for i, (a, b) in enumerate(zip(points, points[1:], strict=False)) if a[0] < b[0]]
    ends.append((points[-1][0] + 1, high, 0))
    found = []
    for start, stop, arc in ends:
        while start <= stop:
            bucket = start // width
            last = min(stop, (bucket + 1) * width - 1)
            found.append((bucket, start, last, arc))
            start = last + 1
    return found


def walk(counts: dict[int, int], owners: list[int], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, last rank, shard, first slot): where the rows of each arc end up, going clockwise from full shards."""
    room, filled, found = list(capacity), [0] * len(capacity), []
    waiting = {arc: [(arc, 0, n)] for arc, n in sorted(counts.items()) if n}
    while waiting:
        moved: dict[int, list] = {}
        for at in sorted(waiting):
            shard = owners[at]
            for arc, first, n in waiting[at]:
                take = min(n, room[shard])
                if take:
                    found.append((arc, first, first + take - 1, shard, filled[shard]))
                    filled[shard] += take
                    room[shard] -= take
                if n > take:
                    to = (at + 1) % len(owners)
                    while not room[owners[to]]:
                        to = (to + 1) % len(owners)
                    moved.setdefault(to, []).append((arc, first + take, n - take))
        waiting = moved
    return found


def shard_rows(docs: DataFrame, shards: int = 24, virtual_nodes: int = 64, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Place every row: key, size, text_crc32, arc, home_shard (before overflow), shard, slot (gapless from 0 in its shard)."""
    spark = docs.sparkSession
    points = ring(spark, shards, virtual_nodes)
    owners = [s for _, s in points]
    cuts = segments(points)
    body = F.coalesce(F.col(text), F.lit(""))
    slim = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body).cast("long") + 8).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.lit("row"), F.col(key)).alias("h"),
        part().cast("long").alias("part"),
    ).withColumn("bucket", F.shiftright("h", 64 - BUCKET_BITS))
    arcs = small(table(spark, cuts, "bucket long,low long,high long,arc int"), len(cuts)).withColumnRenamed("bucket", "b")
    slim = slim.join(arcs, (F.col("bucket") == F.col("b")) & F.col("h").between(F.col("low"), F.col("high"))).drop("bucket", "b", "low", "high")
    slim = written(slim, "shard-rows")
    total = slim.count()
    ranked, counts = group_ranks(slim, "arc", "part", ["h", "doc_id", "text_crc32", "size"], total, "rank")
    found = {r["arc"]: r["n"] for r in counts.collect()}  # one number per arc of the ring
    capacity = [total // shards + (s < total % shards) for s in range(shards)]
    runs = [(a, f, last, s, slot, owners[a]) for a, f, last, s, slot in walk(found, owners, capacity)]
    plan = small(table(spark, runs, "to_arc int,first long,last long,shard int,slot0 long,home_shard int"), len(runs))
    return ranked.join(plan, (F.col("arc") == F.col("to_arc")) & F.col("rank").between(F.col("first"), F.col("last"))).select(
        "doc_id", "size", "text_crc32", "arc", "home_shard", "shard", (F.col("slot0") + F.col("rank") - F.col("first")).alias("slot")
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard_rows(docs, shards=24).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home_shard"
    )

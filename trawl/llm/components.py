"""Connected components by alternating large-star and small-star, on DataFrames.

Links are contracted first: every task replaces the links it holds, at most
`CHUNK` at a time, by stars around their least nodes, which connect the same
nodes.  Then the half steps give every node's neighbours the least node in
sight, until only stars are left that share no node.  Least neighbours are found
by an aggregation, which combines before its shuffle, and joined back; a node
with very many links is joined by a broadcast of bounded size, so it is never
gathered in one task.  Every round is written to the shared folder, and its
predecessor is deleted.  The driver sees counts only.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, measured, released

#: Keys with more rows than others that are broadcast, at most; rows from which a key can be one.
HUBS, HUB_ROWS = BROADCAST_ROWS, 1000
#: Links that a task contracts at a time.
CHUNK = 500_000


def forest(a: pa.Array, b: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Stars (least node, other node) of the components of a few links."""
    both = pa.concat_arrays([a, b])
    nodes = both.unique()
    nodes = nodes.take(pc.sort_indices(nodes))
    at = pc.index_in(both, nodes).to_numpy(zero_copy_only=False)
    one, two = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(one):
        low, high = np.minimum(root[one], root[two]), np.maximum(root[one], root[two])
        apart = low < high
        one, two = one[apart], two[apart]
        np.minimum.at(root, high[apart], low[apart])  # a root moves below a lesser root only, so there is no cycle
        while not np.array_equal(up := root[root], root):
            root = up
    leaf = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes.take(pa.array(root[leaf])), nodes.take(pa.array(leaf))


def contracted(links: DataFrame, count: int) -> DataFrame:
    """Fewer links (a, b) that connect the same nodes."""
    kind = links.schema["a"].dataType.simpleString()

    def run(batches):
        held, rows = [], 0

        def out() -> pa.RecordBatch:
            found = forest(*(pa.concat_arrays([h.column(i) for h in held]) for i in (0, 1)))
            return pa.RecordBatch.from_arrays(list(found), ["a", "b"])

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= CHUNK:
                yield out()
                held, rows = [], 0
        if held:
            yield out()

    return links.select("a", "b").coalesce(max(1, math.ceil(count / CHUNK))).mapInArrow(run, f"a {kind}, b {kind}")


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _with_least(rows: DataFrame, key: str, least: DataFrame, edges: int) -> DataFrame:
    """rows, each with the least `m` of its key; least: (u, m, n), n rows of a key.

    A key with very many rows (a hub) would land in one task of a join.  There
    can be no more than HUBS keys with over 2 * edges / HUBS rows, so hubs are
    broadcast, and the other keys are joined by a shuffle.
    """
    most = max(HUB_ROWS, 2 * edges // HUBS)
    hubs = F.broadcast(least.where(F.col("n") > most))
    others = least.where(F.col("n") <= most)
    same = F.col(key) == F.col("u")
    return rows.join(hubs, same).unionByName(rows.join(hubs, same, "left_anti").join(others, same)).drop("u", "n")


def large_star(edges: DataFrame, count: int) -> DataFrame:
    """Each node's larger neighbours are linked to the least of the node and its neighbours."""
    near = _both(edges)
    least = near.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"), "n")
    return _with_least(near.where("b > a"), "a", least, count).select(F.col("m").alias("a"), "b").where("a < b").distinct()


def small_star(edges: DataFrame, count: int) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of these."""
    down = edges.select(F.col("b").alias("node"), F.col("a").alias("v"))
    least = down.groupBy("node").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).withColumnRenamed("node", "u")
    moved = _with_least(down, "node", least, count).select(F.col("m").alias("a"), F.col("v").alias("b"))
    return moved.union(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).where("a < b").distinct()


def settled(edges: DataFrame) -> bool:
    """Whether every node is either the centre of one star or a leaf of one."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(0).alias("leaf")), F.struct(F.col("b").alias("node"), F.lit(1).alias("leaf")))).alias("x"))
    times = ends.groupBy("x.node").agg(F.sum("x.leaf").alias("leaf"), F.count(F.lit(1)).alias("n"))
    return times.where("leaf > 1 or (leaf = 1 and n > 1)").isEmpty()


def components(links: DataFrame, count: int, label: str = "component") -> DataFrame:
    """(node, label) for every node of links (a, b), of which there are `count`, about; label is the least node that it can reach."""
    edges, seen = measured(contracted(links.where("a <> b"), count), "edges")
    while seen["n"] and not settled(edges):
        before = edges
        edges, seen = measured(small_star(large_star(before, seen["n"]), seen["n"]), "edges")
        released(before)
    roots = edges.select(F.col("a").alias("node")).distinct().withColumn(label, F.col("node"))
    return edges.select(F.col("b").alias("node"), F.col("a").alias(label)).union(roots)

"""Exact nearest vectors without a scan of all: clusters with radii, and the triangle inequality.

Every vector stands in a cluster and keeps its distance to the cluster's centre.
A look-up reads the clusters around the query until k vectors are found; the
k-th distance t then rules out whole clusters (centre further away than t and the
radius) and, in the others, all vectors whose distance to the centre differs from
the query's by more than t.  Both tests are filters on stored columns in whose
order the table is written, so what is ruled out is not read.  How much that is
lies in the data: where vectors lie in groups it is nearly all, where they are
spread evenly over a sphere of many dimensions it is nothing, and the result is
the same.

Vectors are of unit length, so the most similar are the nearest.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors as V

#: Vectors that the centres are learnt from, about; centres at most; rounds of learning; what rounding may add to a distance.
SAMPLE, MOST, ROUNDS, MARGIN = 20_000, 1024, 8, 1e-4


@dataclass(frozen=True)
class Cluster:
    number: int
    n: int
    centre: np.ndarray
    radius: float


def centres(vectors: DataFrame, key: str, total: int) -> np.ndarray:
    """Centres from a sample by hash: about as many as the square root of the vectors, MOST at most."""
    share = math.ceil(min(1.0, SAMPLE / max(total, 1)) * (1 << 20))
    rows = vectors.where(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < share).orderBy(F.xxhash64(key), key).select("embedding").limit(2 * SAMPLE).collect()
    x = np.array([r["embedding"] for r in rows], np.float64)
    k = min(MOST, len(x), max(1, math.isqrt(total)))
    if not k:
        return np.empty((0, 0))
    found = x[:1]
    far = ((x - found[0]) ** 2).sum(1)
    for _ in range(k - 1):  # each the furthest from those before
        found = np.vstack([found, x[far.argmax()]])
        far = np.minimum(far, ((x - found[-1]) ** 2).sum(1))
    for _ in range(ROUNDS):
        own = (x @ found.T - (found**2).sum(1) / 2).argmax(1)
        for c in np.unique(own):
            found[c] = x[own == c].mean(0)
    return found


def clustered(vectors: DataFrame, key: str = "chunk_id") -> tuple[DataFrame, DataFrame]:
    """(vectors with `cluster` and `gap`, in the order to be written; (cluster, n, radius, centre))."""
    middle = centres(vectors, key, vectors.count())
    names = vectors.columns

    def run(batches):
        for b in batches:
            x = np.array(b.column("embedding").to_pylist(), np.float64).reshape(b.num_rows, -1)
            own = (x @ middle.T - (middle**2).sum(1) / 2).argmax(1) if b.num_rows else np.empty(0, np.int64)
            gap = np.sqrt(((x - middle[own]) ** 2).sum(1)) if b.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own, pa.int32()), pa.array(gap, pa.float64())], [*names, "cluster", "gap"])

    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema), "cluster int", "gap double"])
    rows = vectors.mapInArrow(run, kinds)
    sizes = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("radius"))
    told = vectors.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(middle)], "c int, centre array<double>")
    return rows.repartitionByRange("cluster", "gap").sortWithinPartitions("cluster", "gap"), sizes.join(F.broadcast(told), F.col("cluster") == F.col("c")).drop("c")


def held(table: DataFrame) -> list[Cluster]:
    return [Cluster(r["cluster"], r["n"], np.array(r["centre"]), r["radius"]) for r in table.collect()]  # MOST at most


def nearest(vectors: DataFrame, known: list[Cluster], vector: list[float], most: int, key: str = "chunk_id", *more: str) -> DataFrame:
    """As `vectors.nearest`, reading only what can be among the most similar."""
    q = np.array(vector, np.float64)
    away = {c.number: float(np.sqrt(((c.centre - q) ** 2).sum())) for c in known}
    first, so_far = [], 0
    for c in sorted(known, key=lambda c: (away[c.number], c.number)):
        if so_far >= most:
            break
        first.append(c.number)
        so_far += c.n
    told = vectors.select(key, *more, "cluster", "gap", V.dot(F.col("embedding"), vector).alias("similarity"))
    near = told.where(F.col("cluster").isin(first)) if first else told.limit(0)
    best = near.orderBy(F.desc("similarity"), key).limit(most).collect()
    if so_far >= most and best:
        t = math.sqrt(max(2 - 2 * best[-1]["similarity"], 0)) + MARGIN
        rest = [c for c in known if c.number not in first and away[c.number] - c.radius <= t]
        possible = F.lit(False)
        for c in rest:
            possible = possible | ((F.col("cluster") == c.number) & F.col("gap").between(away[c.number] - t, away[c.number] + t))
        found = vectors.sparkSession.createDataFrame(best, told.schema) if not rest else vectors.sparkSession.createDataFrame(best, told.schema).union(told.where(possible))
    else:
        found = near
    top = found.orderBy(F.desc("similarity"), key).limit(most).select(key, *more, "similarity")
    return V.with_rank(top, [F.desc("similarity"), F.col(key)])

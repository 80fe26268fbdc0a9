"""Orders by time over ranked turns, and limits per group."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .scoring import rank_order

TEMPORAL = ("earliest", "latest", "longitudinal")
#: Rows that one task places at a time, about, and score ranges at most.
PLACE_ROWS, MOST_RANGES = 5000, 1024


def relevance_floor(best: Column, longitudinal: bool) -> Column:
    return F.greatest(F.lit(0.25), best * (0.40 if longitudinal else 0.55))


def qualified(rows: DataFrame, longitudinal: bool) -> DataFrame:
    """Dated rows that are not far below the best one."""
    best = rows.agg(F.max("score").alias("best_score"))
    return rows.join(F.broadcast(best)).where((F.col("score") >= relevance_floor(F.col("best_score"), longitudinal)) & F.col("create_time").isNotNull()).drop("best_score")


def by_time(rows: DataFrame, mode: str) -> list[Column]:
    time = F.col("create_time")
    return [time.asc() if mode == "earliest" else time.desc(), F.desc("score"), F.col("conversation_id").asc(), F.col("turn_index").asc()]


def temporal_order(rows: DataFrame, mode: str) -> DataFrame:
    """rows with `place` from 1 in the order of the mode.  rows: bounded by a limit."""
    if mode not in TEMPORAL:
        return rows.withColumn("place", F.row_number().over(Window.orderBy(*rank_order("matched_role", "first_chunk"))))
    best = F.max("score").over(Window.partitionBy(F.lit(0)))
    floor = rows.withColumn("best_score", best).where((F.col("score") >= relevance_floor(F.col("best_score"), mode == "longitudinal")) & F.col("create_time").isNotNull())
    kept = floor.drop("best_score")
    if mode != "longitudinal":
        return kept.withColumn("place", F.row_number().over(Window.orderBy(*by_time(kept, mode))))
    order = rank_order("matched_role", "first_chunk")
    kept = representatives_first(kept, X.quarter(F.col("create_time")), order)
    return kept.withColumn("place", F.row_number().over(Window.orderBy("backfill", "period", *order))).drop("backfill", "period")


def representatives_first(rows: DataFrame, period: Column, order: list[Column]) -> DataFrame:
    """backfill: false for the first of each period; period: null where backfill, so the rest keep their rank order."""
    first = F.row_number().over(Window.partitionBy(period).orderBy(*order)) == 1
    return rows.withColumn("backfill", ~first).withColumn("period", F.when(~F.col("backfill"), period))


def score_range(rows: DataFrame, key: str) -> tuple[Column, int]:
    """(range of a row from 0, number of ranges) by quantiles of a column that isn't null; equal values share a range."""
    n, m = rows.count(), 1
    while m < MOST_RANGES and m * PLACE_ROWS < n:
        m *= 2
    found = rows.agg(F.percentile_approx(key, [i / m for i in range(1, m)] or [0.5], 10 * m).alias("cuts")).first()["cuts"] if m > 1 else None
    # cuts from 1; the range of a value is the number of cuts that are not above it
    cuts = F.array(*(F.lit(float(c)) for c in [-math.inf, *(found or [])]))
    halves = [m >> i for i in range(1, m.bit_length())]
    at = F.aggregate(F.array(*map(F.lit, halves)), F.lit(0), lambda p, h: F.when(F.get(cuts, p + h) <= F.col(key), p + h).otherwise(p)) if halves else F.lit(0)
    return at, m


def places_by_range(rows: DataFrame, order: list) -> DataFrame:
    """rows with `place` from 1 in the order of `range`, then `order`: ranks within ranges, plus sums of the ranges before."""
    before = F.sum("n").over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1))  # one row a range
    sums = rows.groupBy(F.col("range").alias("r")).agg(F.count(F.lit(1)).alias("n")).select("r", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return rows.withColumn("own", own).join(F.broadcast(sums), F.col("range") == F.col("r")).withColumn("place", (F.col("before") + F.col("own"))).drop("range", "r", "before", "own")


def places(rows: DataFrame, key: str, order: list) -> DataFrame:
    """rows with `place` from 1 in `order`, whose first key is `key` from the greatest down; for tables of any size."""
    at, m = score_range(rows, key)
    return places_by_range(rows.withColumn("range", F.lit(m) - at), order)


def longitudinal_places(rows: DataFrame, period: Column, order: list[Column]) -> DataFrame:
    """rows with `place` from 1: the first of each period in the order of periods, then the rest in rank order, for tables of any size.

    Rows are dealt to ranges of `score`, the first key of `order`, and ranked within; sums of the ranges before give the
    place.  Rows of equal score are ranked in one task.  (conversation_id, turn_index) names a row; score is not null.
    """
    at, m = score_range(rows, "score")
    dated = rows.withColumn("period", period)
    names = ["period", "conversation_id", "turn_index"]
    # a rank that is only asked for its first row keeps one row a period in each task
    firsts = dated.withColumn("n", F.row_number().over(Window.partitionBy("period").orderBy(*order))).where("n = 1").select(F.struct(*names).alias("first"))
    same = [F.col(x).eqNullSafe(F.col(f"first.{x}")) for x in names]
    marked = dated.join(F.broadcast(firsts), same[0] & same[1] & same[2], "left")
    marked = marked.withColumn("backfill", F.col("first").isNull()).drop("first").withColumn("period", F.when(~F.col("backfill"), F.col("period")))
    return places_by_range(marked.withColumn("range", F.when(F.col("backfill"), F.lit(m) - at).otherwise(0)), ["period", *order])


def cap_with_backfill(rows: DataFrame, group: str, rank: str, cap: int, most: int) -> DataFrame:
    """At most `cap` of a group, in rank order; if that is too few, those over the cap follow; `place` from 1."""
    over = F.row_number().over(Window.partitionBy(group).orderBy(rank)) > cap
    chosen = rows.withColumn("over_cap", over).orderBy("over_cap", rank).limit(most)
    return chosen.withColumn("place", F.row_number().over(Window.orderBy("over_cap", rank)))

"""Reciprocal rank fusion, and hits to turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60.0


def role_weight(role: Column, user: float, other: float) -> Column:
    return F.when(role == "user", user).otherwise(other)


def reciprocal(weight: Column, rank: Column) -> Column:
    return weight / (F.lit(RRF_K) + rank)


def fuse_searches(ranked: DataFrame, weights: list[float]) -> DataFrame:
    """(chunk_id, score, lexical_rank) from (search, chunk_id, role, rank): searches by number, with their weights."""
    each = F.element_at(F.array(*map(F.lit, weights or [0.0])), F.col("search") + 1)
    part = reciprocal(each * role_weight(F.col("role"), 1.35, 0.45), F.col("rank"))
    return ranked.groupBy("chunk_id").agg(F.round(F.sum(part), 12).alias("score"), F.min("rank").alias("lexical_rank"))


def fuse_lists(lexical: DataFrame, semantic: DataFrame, lexical_weight: float = 1.0, semantic_weight: float = 1.0) -> DataFrame:
    """(chunk_id, score, lexical_rank, semantic_rank) from two lists of (chunk_id, role, rank)."""
    both = lexical.select("chunk_id", "role", "rank", F.lit("lexical").alias("list")).unionByName(semantic.select("chunk_id", "role", "rank", F.lit("semantic").alias("list")))
    weight = F.when(F.col("list") == "lexical", lexical_weight).otherwise(semantic_weight)
    part = reciprocal(weight * role_weight(F.col("role"), 1.15, 0.70), F.col("rank"))
    rank_in = lambda name: F.min(F.when(F.col("list") == name, F.col("rank"))).alias(f"{name}_rank")
    return both.groupBy("chunk_id").agg(F.round(F.sum(part), 12).alias("score"), rank_in("lexical"), rank_in("semantic"))


def hits_to_turns(hits: DataFrame) -> DataFrame:
    """The best hit of each turn, its score raised by a fifth of the others'."""
    first = F.struct((-F.col("score")).alias("s"), "chunk_id", "role", "message_id", "title", "create_time", "text")
    rows = hits.groupBy("conversation_id", "turn_index").agg(F.min(first).alias("h"), F.sum("score").alias("total"), F.max("score").alias("best"))
    score = F.round(F.col("best") + 0.2 * (F.col("total") - F.col("best")), 12)
    return rows.select("conversation_id", "turn_index", F.col("h.chunk_id").alias("chunk_id"), "h.role", "h.message_id", "h.title", "h.create_time", "h.text", score.alias("score"))


def round_robin(rows: DataFrame, bucket: Column, order: list[Column], most: int) -> DataFrame:
    """The first of every bucket, then the second of every bucket, and so on, up to `most`."""
    turn = F.row_number().over(Window.partitionBy(bucket).orderBy(*order))
    return rows.withColumn("bucket", bucket).withColumn("turn", turn).where(F.col("turn") <= most).orderBy("turn", "bucket").limit(most)

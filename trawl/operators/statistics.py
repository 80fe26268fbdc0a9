"""Counts over an archive's tables, one pass per table."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def archive_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """One row of counts, the span of times, turns by acceptance, chunks by role, and vectors if there are any."""
    messages = tables["messages"].agg(
        F.count(F.lit(1)).alias("messages"),
        F.count_if(F.col("is_active")).alias("active_messages"),
        F.count_if(F.col("role") == "user").alias("user_messages"),
        F.count_if(F.col("role") == "assistant").alias("assistant_messages"),
        F.min("create_time").alias("first_time"),
        F.max("create_time").alias("last_time"),
    )
    turns = tables["turns"].agg(
        F.count(F.lit(1)).alias("turns"), F.count_if(F.col("acceptance") == "accepted").alias("accepted_turns"), F.count_if(F.col("acceptance") == "rejected").alias("rejected_turns")
    )
    conversations = tables["conversations"].agg(F.count(F.lit(1)).alias("conversations"))
    said = lambda role: F.count_if(F.col("role") == role)
    chunks = tables["chunks"].agg(F.count(F.lit(1)).alias("chunks"), said("user").alias("user_chunks"), said("assistant").alias("assistant_chunks"))
    out = conversations
    for other in (messages, turns, chunks):  # one row each
        out = out.join(F.broadcast(other))
    return out


def role_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy("role").agg(F.count(F.lit(1)).alias("n"))


def build_counters(messages: DataFrame, read: DataFrame | None = None) -> DataFrame:
    """(counter, n): messages by role and by content type, active ones; with `read`, the entries of the sources, those that were skipped."""
    kinds = F.array(
        F.concat(F.lit("role_"), "role"), F.concat(F.lit("content_"), F.coalesce("content_type", F.lit("unknown"))), F.when(F.col("is_active"), F.lit("active_messages")), F.lit("messages"),
    )
    found = messages.select(F.explode(F.array_compact(kinds)).alias("counter")).groupBy("counter").agg(F.count(F.lit(1)).alias("n"))
    if read is None:
        return found
    ids = read.select(F.coalesce(F.nullif("conversation_id", F.lit("")), F.nullif("id", F.lit(""))).alias("cid"))
    skipped = ids.agg(F.count_if(F.col("cid").isNull()).alias("n")).select(F.lit("skipped_without_id").alias("counter"), "n")
    return found.union(skipped)


def file_stats(conversations: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Conversations and messages of each source file, with its bytes where (name, bytes) are given."""
    found = conversations.groupBy("source_file").agg(F.count(F.lit(1)).alias("conversations"), F.sum("total_message_count").alias("messages"))
    if files is None:
        return found
    sizes = files.select(F.col("name").alias("source_file"), F.col("bytes"))
    return sizes.join(found, "source_file", "left").na.fill(0, ["conversations", "messages"])


#: Ranges that a step counts, and values that are left to be put in order.
RANGES, FEW = 1024, 10_000


def nearest_rank(values: DataFrame, column: str, share: float) -> DataFrame:
    """(value): the least value that this share of values does not exceed, exactly.  Nulls do not count; NaN is above all.

    Values are counted by ranges; only the range that holds the rank is looked at again, until few
    values or one are left.  Values are never gathered: a step brings one count for each range.
    """
    kind = values.schema[column].dataType
    rows = values.select(F.col(column).alias("value")).where("value is not null")
    found = _selected(rows, share, kind.simpleString() in ("double", "float"))
    return values.sparkSession.createDataFrame([(found,)], T.StructType([T.StructField("value", kind)]))


def _selected(rows: DataFrame, share: float, floats: bool):
    nan = F.isnan("value") if floats else F.lit(False)
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(nan).alias("nan")).first()
    if not counts["n"]:
        return None
    rank = max(math.ceil(share * counts["n"]), 1)
    if rank > counts["n"] - counts["nan"]:
        return float("nan")
    rows, n = rows.where(~nan), counts["n"] - counts["nan"]
    while n > FEW:
        cuts = rows.agg(F.percentile_approx("value", [i / RANGES for i in range(1, RANGES)], 10 * RANGES).alias("c")).first()["c"]
        cuts = sorted(set(cuts))
        # values below the first cut, then of each cut those equal to it and those between it and the next
        at = F.lit(0)
        halves = [1 << i for i in range(len(cuts).bit_length() - 1, -1, -1)]
        known = F.array(*map(F.lit, cuts))
        at = F.aggregate(F.array(*map(F.lit, halves)), F.lit(0), lambda p, h: F.when((p + h <= len(cuts)) & (F.get(known, p + h - 1) <= F.col("value")), p + h).otherwise(p))
        ranged = rows.withColumn("range", at)
        place = F.when((F.col("range") > 0) & (F.get(known, F.col("range") - 1) == F.col("value")), F.lit(0)).otherwise(1)
        sums = ranged.groupBy("range", place.alias("after")).agg(F.count(F.lit(1)).alias("n")).collect()  # at most two for each range
        below = 0
        for r in sorted(sums, key=lambda r: (r["range"], r["after"])):
            if below + r["n"] >= rank:
                break
            below += r["n"]
        if not r["after"]:
            return cuts[r["range"] - 1]
        if r["range"]:
            rows = rows.where(F.col("value") > cuts[r["range"] - 1])
        if r["range"] < len(cuts):
            rows = rows.where(F.col("value") < cuts[r["range"]])
        rank, n = rank - below, r["n"]
    return sorted(r["value"] for r in rows.collect())[rank - 1]  # FEW at most

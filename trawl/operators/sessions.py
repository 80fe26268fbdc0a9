"""Messages to turns, turns to chunks, and what stands around a turn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as X
from ..functions.pytext import split_pieces
from ..scratch import written


#: Messages or turns of a conversation that one task puts in order; longer conversations are done in blocks.
BLOCK = 4096


def in_turns(messages: DataFrame) -> DataFrame:
    """Active user and assistant messages with their turn: each user message opens one; what comes before the first is left out.

    User messages are counted within blocks of positions, blocks before are added up: a conversation of any length is in no task as a whole.
    """
    spoken = messages.where("is_active and role in ('user', 'assistant')").withColumn("block", F.floor(F.col("active_position") / BLOCK))
    opens = (F.col("role") == "user").cast("int")
    own = F.sum(opens).over(Window.partitionBy("conversation_id", "block").orderBy("active_position").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # one row for each block
    sums = spoken.groupBy(F.col("conversation_id").alias("bc"), F.col("block").alias("bb")).agg(F.sum(opens).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("bc").orderBy("bb").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    later = sums.withColumn("before", before).where("bb > 0")
    counted = spoken.withColumn("own", own).join(later, (F.col("conversation_id") == F.col("bc")) & (F.col("block") == F.col("bb")), "left")
    return counted.withColumn("turn_index", (F.col("own") + F.coalesce("before", F.lit(0)) - 1).cast("int")).where("turn_index >= 0").drop("block", "own", "bc", "bb", "n", "before")


def turns(messages: DataFrame, accept: str = L.ACCEPT, reject: str = L.REJECT) -> DataFrame:
    """One row per turn with its texts, how the next user message takes its answer, and how it took the one before.

    A user message goes to its own turn, and what it says about the answer before it to the turn before: one grouping by turn gives all.
    """
    role = F.col("role")
    taken = X.acceptance(F.col("text"), accept, reject)
    own = F.struct("turn_index", F.col("role").alias("part"), "create_time", "text", "message_id", "active_position", F.when(role == "user", taken).alias("taken"))
    nothing = (F.lit(None).cast(kind) for kind in ("double", "string", "string", "int"))
    names = ("create_time", "text", "message_id", "active_position")
    before = F.struct((F.col("turn_index") - 1).alias("turn_index"), F.lit("following").alias("part"), *(c.alias(n) for c, n in zip(nothing, names, strict=True)), taken.alias("taken"))
    rows = in_turns(messages).select("conversation_id", F.explode(F.array_compact(F.array(own, F.when((role == "user") & (F.col("turn_index") > 0), before)))).alias("m")).select("conversation_id", "m.*")
    part = F.col("part")
    told = F.filter(F.array_sort(F.collect_list(F.when(part == "assistant", F.struct("active_position", "text", "message_id")))), lambda m: m.isNotNull())
    grouped = rows.groupBy("conversation_id", "turn_index").agg(
        F.max(F.when(part == "user", F.col("create_time"))).alias("create_time"),
        F.array_compact(F.collect_list(F.when(part == "user", F.col("message_id")))).alias("user_message_ids"),
        F.max(F.when(part == "user", F.col("text"))).alias("user_text"),
        told.alias("told"),
        F.max(F.when(part == "following", F.col("taken"))).alias("following"),
        F.max(F.when(part == "user", F.col("taken"))).alias("taken"),
    )
    texts = F.transform(F.filter("told", lambda m: m["text"] != ""), lambda m: m["text"])
    return grouped.select(
        "conversation_id", "turn_index", "create_time", "user_message_ids", F.transform("told", lambda m: m["message_id"]).alias("assistant_message_ids"),
        "user_text", X.clean_text(F.array_join(texts, "\n\n")).alias("assistant_text"), F.coalesce("following", F.lit("unknown")).alias("acceptance"),
        F.when(F.col("turn_index") > 0, F.coalesce("taken", F.lit("unknown"))).otherwise("unknown").alias("previous_acceptance"),
    )


def chunks(conversations: DataFrame, messages: DataFrame, most: int = L.CHUNK_CHARS, overlap: int = L.CHUNK_OVERLAP) -> DataFrame:
    """Message texts in overlapping pieces, with dense ids in the order of files, conversations, turns, speakers and pieces."""
    spoken = in_turns(messages).where("text <> ''")
    opened = F.first(F.when(F.col("role") == "user", F.col("create_time")), True).over(Window.partitionBy("conversation_id", "turn_index"))
    timed = spoken.withColumn("turn_time", opened).withColumn("own_time", F.coalesce(F.nullif("create_time", F.lit(0.0)), "turn_time"))
    head = conversations.select(F.col("conversation_id").alias("c"), "title", F.col("source_file").alias("f"), "position")
    spread = timed.select("conversation_id", "turn_index", "message_id", "role", F.col("own_time").alias("create_time"), "active_position", F.col("text").alias("body"))
    # a text of one piece needs no Python
    short = F.char_length("body") <= most
    whole = spread.where(short).withColumn("chunk_index", F.lit(0)).withColumn("text", X.clean_text(F.col("body"))).where("text <> ''")
    rows = whole.union(spread.where(~short).lateralJoin(split_pieces(F.col("body").outer(), most, overlap))).drop("body")
    rows = rows.join(head, F.col("conversation_id") == F.col("c"))
    order = ["f", "position", "conversation_id", "turn_index", F.desc("role"), "active_position", "chunk_index"]
    numbered = dense_ids(rows, order)
    return numbered.select("chunk_id", "conversation_id", "turn_index", "message_id", "chunk_index", "role", "create_time", "title", "text", X.content_hash(F.col("text")).alias("content_hash"))


def dense_ids(rows: DataFrame, order: list) -> DataFrame:
    """chunk_id from 1 in a total order: ranks within blocks of a conversation's turns, plus the blocks before.

    Ranked rows are written once, so that texts are cut once only.  Blocks (a slim row each) are dealt to ranges of
    (file, position, conversation, block) and written once, so that a range stays what it is; sums of ranges are
    few.  Chunks never meet in one task, whatever ids look like.
    """
    cut = rows.withColumn("block", F.floor(F.col("turn_index") / BLOCK))
    cut = written(cut.withColumn("own", F.row_number().over(Window.partitionBy("conversation_id", "block").orderBy(*order[3:]))), "pieces")
    key = ["f", "position", "conversation_id", "block"]
    sizes = cut.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).select(F.col("f").alias("bf"), F.col("position").alias("bp"), F.col("conversation_id").alias("bc"), F.col("block").alias("bb"), "n")
    ranged = written(sizes.repartitionByRange("bf", "bp", "bc", "bb").withColumn("range", F.spark_partition_id()), "id-blocks")
    so_far = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = ranged.groupBy(F.col("range").alias("r")).agg(F.sum("n").alias("n")).select("r", so_far(Window.orderBy("r")).alias("before"))  # a row for each range
    starts = ranged.withColumn("start", so_far(Window.partitionBy("range").orderBy("bf", "bp", "bc", "bb"))).join(F.broadcast(sums), F.col("range") == F.col("r"))
    starts = starts.select("bc", "bb", (F.col("start") + F.col("before")).alias("start"))
    numbered = cut.join(starts, (F.col("conversation_id") == F.col("bc")) & (F.col("block") == F.col("bb")))
    return numbered.withColumn("chunk_id", F.col("start") + F.col("own")).drop("start", "own", "bc", "bb", "block")


def turn_window(all_turns: DataFrame, seeds: DataFrame, before: int = 1, after: int = 1) -> DataFrame:
    """Turns around each seed (conversation_id, turn_index), as an equi-join on the turn numbers wanted; seed is its number."""
    wanted = seeds.select(F.col("conversation_id").alias("c"), F.col("turn_index").alias("seed"), F.explode(F.sequence(F.greatest(F.col("turn_index") - before, F.lit(0)), F.col("turn_index") + after)).alias("t"))
    return all_turns.join(wanted, (F.col("conversation_id") == F.col("c")) & (F.col("turn_index") == F.col("t"))).drop("c", "t")


def neighbours(all_turns: DataFrame) -> DataFrame:
    """Each turn with the one before and the one after as structs: turn numbers are dense, so these are equi-joins, and long conversations spread over tasks."""
    around = all_turns.select(F.col("conversation_id").alias("nc"), F.struct("turn_index", "user_text", "assistant_text", "acceptance").alias("there"))
    out = all_turns
    for name, step in (("previous", -1), ("following", 1)):
        same = (F.col("conversation_id") == F.col("nc")) & (F.col("turn_index") + step == F.col("there.turn_index"))
        out = out.join(around, same, "left").withColumnRenamed("there", name).drop("nc")
    return out


def dated_inclusive(seconds: Column, first: float | None, last: float | None) -> Column:
    """Between two moments, both included; the end of a day is its last full second."""
    out = F.lit(True)
    if first is not None:
        out = out & (seconds >= first)
    if last is not None:
        out = out & (seconds <= last)
    return out


def dated_half_open(seconds: Column, first: float | None, end: float | None) -> Column:
    """From a moment up to but not including another."""
    out = F.lit(True)
    if first is not None:
        out = out & (seconds >= first)
    if end is not None:
        out = out & (seconds < end)
    return out

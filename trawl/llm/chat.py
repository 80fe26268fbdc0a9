"""Preference formatting of chat conversations, in DataFrame code.

A pair is a chosen and a rejected conversation.  Its prompt is their longest
common prefix of turns (role and text equal), rendered once; what follows in
either is its completion, rendered with a mask that tells which turns a model
is to learn: those of the assistant.

Texts are shuffled once, to blocks of turns of their conversation.  Hashes of the
turns of the two sides meet position by position, the prefix ends at the least
position where they differ, and what has been found of a conversation goes to its
blocks, where every turn renders its rows (`spans`, one row for each rendered
turn).  Nothing is gathered by conversation, so conversations may be of any
length.  `assembled` joins spans into one row a pair, for conversations that are
known to fit one.  Turns are told apart by 64-bit hashes within a pair, openings
by 128-bit ones.

`paired_by_opening` makes pairs of conversations that open with the same turn:
each one is chosen against the next by id, however far apart their ids are.
Where openings do not recur this makes no pair.  `reply_spans` makes a pair of
every conversation with a reply: its prompt is all turns before its last
assistant turn, chosen is that turn, and rejected is the reply of another
conversation, the next of the table's distinct last replies in the order of
their SHA-256, the first after the last.  Turns after the last reply are in no
pair; a conversation without a reply has no rows; rejected is absent only if
all last replies of the table are the same; rows without a conversation id are
dropped; null texts are empty replies.

Defined results: null roles and texts render as empty and equal each other, but
not empty ones; repeated turn numbers are ordered by role and text, null first,
and repeated rows stay; texts of any length are rendered in full; rows without a
conversation id are in no pair and have no rows; a pair with a missing
conversation has an empty completion on that side; a pair without any turn, or
an empty table, has no rows; extra columns are dropped, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import RANK_ROWS, written

#: Turns of a conversation that one task numbers at a time.
TURN_BLOCK = 4096


def rendered(role: Column, text: Column) -> Column:
    """One turn as text: its role's mark, its words, an end mark."""
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("\n<|end|>\n"))


def blocks(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns as (conv, block, own, role, text), own: place in the block; and (conv, block, start), start: position of the block's first turn."""
    base = turns.where("conv_id is not null").select(F.col("conv_id").alias("conv"), F.coalesce(F.col("turn").cast("long"), F.lit(-1).cast("long")).alias("turn"), "role", "text")
    base = base.withColumn("block", F.floor(F.col("turn") / TURN_BLOCK))
    sizes = base.groupBy("conv", "block").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    own = F.row_number().over(Window.partitionBy("conv", "block").orderBy("turn", "role", "text")) - 1
    return base.select("conv", "block", own.alias("own"), "role", "text"), sizes.select("conv", "block", F.coalesce(before, F.lit(0)).alias("start"))


def placed(said: DataFrame, starts: DataFrame) -> DataFrame:
    """said with `pos` and the other columns of starts, which has any number of rows for a block; the texts stay where they are."""
    found = starts.withColumnsRenamed({"conv": "c", "block": "k"})
    return said.join(found, (F.col("conv") == F.col("c")) & (F.col("block") == F.col("k"))).withColumn("pos", F.col("start") + F.col("own")).drop("c", "k", "own", "start")


def with_next(slim: DataFrame, group: str, key: str) -> DataFrame:
    """slim with `next`: the key that follows in its group, or null.  Rows are cut into sorted ranges, so a group of any size is spread; one row a range finds the range after it."""
    slim = written(slim, "unordered")
    parts = max(1, math.ceil(slim.count() / RANK_ROWS))
    # written, as the cuts are from a sample and both uses must see the same
    dealt = written(slim.repartitionByRange(parts, group, key).withColumn("range", F.spark_partition_id()), "ranges")
    heads = dealt.groupBy("range").agg(F.min(F.struct(group, key)).alias("head"))
    heads = heads.select(F.col("range").alias("r"), F.lead("head").over(Window.orderBy("range")).alias("head"))
    own = F.lead(F.struct(group, key)).over(Window.partitionBy("range").orderBy(group, key))
    found = dealt.withColumn("own", own).join(F.broadcast(heads), F.col("range") == F.col("r"))
    after = F.coalesce("own", "head")
    return found.select(*slim.columns, F.when(after[group] == F.col(group), after[key]).alias("next"))


def paired_by_opening(turns: DataFrame) -> DataFrame:
    """(pair_id, chosen, rejected): each conversation and the next by id with the same first turn; rejected may be null."""
    least = turns.where("conv_id is not null").groupBy("conv_id").agg(F.min(F.struct(F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"), "role", "text")).alias("f"))
    role, text = F.col("f.role"), F.col("f.text")
    marks = F.concat_ws(":", F.coalesce(F.octet_length(role), F.lit(-1)), F.coalesce(F.octet_length(text), F.lit(-1)), role, text)
    opened = with_next(least.select("conv_id", F.md5(marks).alias("opening")), "opening", "conv_id")
    return opened.select(F.col("conv_id").alias("pair_id"), F.col("conv_id").alias("chosen"), F.col("next").alias("rejected"))


def spans(turns: DataFrame, pairs: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(pair_id, part, pos, role, text, mask): rendered turns; part is prompt, chosen or rejected; mask: to be learnt."""
    said, starts = blocks(turns)
    sides = pairs.select("pair_id", F.explode(F.array(*(F.struct(F.col(side).alias("of"), F.lit(k).alias("side")) for k, side in enumerate(("chosen", "rejected"))))).alias("x"))
    sides = sides.select("pair_id", "x.*").where("of is not null")
    # the texts' shuffle serves this branch as well
    hashed = placed(said, starts).select("conv", "pos", F.xxhash64(F.col("role").isNull(), "role", F.col("text").isNull(), "text").alias("turn"))
    both = sides.join(hashed, F.col("of") == F.col("conv")).groupBy("pair_id", "pos")
    met = both.agg(F.min("turn").alias("low"), F.max("turn").alias("high"), F.count(F.lit(1)).alias("n"))
    prefix = met.where("low <> high or n < 2").groupBy("pair_id").agg(F.min("pos").alias("differs")).withColumnRenamed("pair_id", "p")
    known = sides.join(prefix, F.col("pair_id") == F.col("p"), "left").select("pair_id", "side", "of", F.coalesce("differs", F.lit(2**62)).alias("differs"))
    known = starts.join(known, F.col("conv") == F.col("of")).drop("of")
    # the common prefix comes from the chosen side
    out = placed(said, known).where("side = 0 or pos >= differs")
    part = F.when(F.col("pos") < F.col("differs"), "prompt").when(F.col("side") == 0, "chosen").otherwise("rejected")
    mask = (F.col("pos") >= F.col("differs")) & F.coalesce(F.col("role").isin(*learn), F.lit(False))
    return out.select("pair_id", part.alias("part"), "pos", "role", rendered(F.col("role"), F.col("text")).alias("text"), mask.alias("mask"))


def reply_spans(turns: DataFrame) -> DataFrame:
    """(pair_id, part, pos, role, text, mask): rendered turns, as of `spans`, of each conversation up to its last reply, that reply, and another conversation's."""
    said, starts = blocks(turns)
    body = F.coalesce("text", F.lit(""))
    last = placed(said, starts).where("role = 'assistant'").groupBy("conv").agg(F.max("pos").alias("last")).withColumnRenamed("conv", "of")
    shown = placed(said, starts.join(last, F.col("conv") == F.col("of")).drop("of")).where("pos <= last")
    replies = shown.where("pos = last").select(F.col("conv").alias("pair_id"), "pos", body.alias("body"), F.sha2(body, 256).alias("digest"))
    distinct = replies.groupBy("digest").agg(F.max("body").alias("body"))
    order = with_next(distinct.select(F.lit(0).alias("all"), "digest"), "all", "digest")
    first = order.agg(F.min("digest").alias("first"))
    order = order.join(F.broadcast(first)).select(F.col("digest").alias("of"), F.coalesce("next", "first").alias("other")).where("of <> other")
    others = order.join(distinct.withColumnRenamed("digest", "d"), F.col("other") == F.col("d")).select("of", F.col("body").alias("other_body"))
    rejected = replies.select("pair_id", "pos", "digest").join(others, F.col("digest") == F.col("of"))
    role = F.lit("assistant")
    own = shown.select(
        F.col("conv").alias("pair_id"), F.when(F.col("pos") < F.col("last"), "prompt").otherwise("chosen").alias("part"), "pos", "role", rendered(F.col("role"), F.col("text")).alias("text"), (F.col("pos") == F.col("last")).alias("mask")
    )
    return own.union(rejected.select("pair_id", F.lit("rejected").alias("part"), "pos", role.alias("role"), rendered(role, F.col("other_body")).alias("text"), F.lit(True).alias("mask")))


def assembled(found: DataFrame) -> DataFrame:
    """(pair_id, prompt, chosen, rejected, chosen_mask, rejected_mask): spans joined; masks as [length in characters, learnt] of each turn."""

    def turns(part: str) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col("part") == part, F.struct("pos", "text", "mask"))))

    rows = found.groupBy("pair_id").agg(*(turns(p).alias(p) for p in ("prompt", "chosen", "rejected")))

    def masks(p: str) -> Column:
        return F.transform(p, lambda t: F.struct(F.char_length(t["text"]).alias("chars"), t["mask"].alias("learnt"))).alias(f"{p}_mask")

    return rows.select("pair_id", *(F.array_join(F.col(f"{p}.text"), "").alias(p) for p in ("prompt", "chosen", "rejected")), masks("chosen"), masks("rejected"))


def query(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return spans(turns, paired_by_opening(turns))


def query_replies(spark, sf_dir: str) -> DataFrame:
    return reply_spans(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: The same result in SQL.
SQL = """
WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS pos FROM conversations),
opening AS (SELECT conv_id, concat(role, chr(1), text) AS opening FROM t WHERE pos = 0),
pairs AS (SELECT conv_id AS pair_id, lead(conv_id) OVER (PARTITION BY opening ORDER BY conv_id) AS rejected FROM opening),
c AS (SELECT p.pair_id, t.pos, t.role, t.text FROM pairs p JOIN t ON t.conv_id = p.pair_id),
r AS (SELECT p.pair_id, t.pos, t.role, t.text FROM pairs p JOIN t ON t.conv_id = p.rejected),
j AS (SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, coalesce(c.pos, r.pos) AS pos, c.role AS c_role, c.text AS c_text, r.role AS r_role, r.text AS r_text,
  c.pair_id IS NOT NULL AS in_c, r.pair_id IS NOT NULL AS in_r, coalesce(c.role = r.role AND c.text = r.text, false) AS same
  FROM c FULL OUTER JOIN r ON c.pair_id = r.pair_id AND c.pos = r.pos),
d AS (SELECT pair_id, min(pos) FILTER (WHERE NOT same) AS differs FROM j GROUP BY pair_id),
k AS (SELECT j.*, pos < coalesce(differs, 1000000000) AS common FROM j JOIN d USING (pair_id)),
u AS (
  SELECT pair_id, 'prompt' AS part, pos, c_role AS role, c_text AS body FROM k WHERE common
  UNION ALL SELECT pair_id, 'chosen', pos, c_role, c_text FROM k WHERE NOT common AND in_c
  UNION ALL SELECT pair_id, 'rejected', pos, r_role, r_text FROM k WHERE NOT common AND in_r)
SELECT pair_id, part, pos, role, concat('<|', role, '|>', chr(10), body, chr(10), '<|end|>', chr(10)) AS text, part <> 'prompt' AND role = 'assistant' AS mask FROM u
"""

#: The same result as query_replies in SQL.
REPLIES_SQL = """
WITH t AS (SELECT conv_id, role, coalesce(text, '') AS body, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, max(pos) AS last FROM t WHERE role = 'assistant' GROUP BY conv_id),
p AS (SELECT t.*, last FROM t JOIN l USING (conv_id) WHERE pos <= last),
d AS (SELECT DISTINCT body, sha256(body) AS digest FROM p WHERE pos = last),
n AS (SELECT body, coalesce(lead(body) OVER (ORDER BY digest), first_value(body) OVER (ORDER BY digest)) AS other FROM d),
u AS (
  SELECT conv_id AS pair_id, CASE WHEN pos < last THEN 'prompt' ELSE 'chosen' END AS part, pos, role, body FROM p
  UNION ALL SELECT conv_id, 'rejected', pos, role, other FROM p JOIN n USING (body) WHERE pos = last AND other <> body)
SELECT pair_id, part, pos, role, concat('<|', role, '|>', chr(10), body, chr(10), '<|end|>', chr(10)) AS text, part <> 'prompt' AS mask FROM u
"""

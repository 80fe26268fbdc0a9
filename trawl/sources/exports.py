"""Exported chat archives: JSON lists of conversations, each a tree of messages with branches.

A file is a list of objects; its conversations hold nodes in a mapping whose
order matters.  A conversation has to fit a task's memory, a file has not (see
`jsonlist`).  The branch in use is followed from the current node to the root;
without a valid current node, from the leaf with the latest message.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions.pytext import content_text_udf
from . import jsonlist

FILE_PATTERN = "conversations-*.json"
CONVERSATION = "conversation_id string, id string, title string, create_time string, update_time string, current_node string, default_model_slug string, is_archived string, is_starred string, mapping map<string,string>"


def read_exports(spark: SparkSession, folder: str) -> DataFrame:
    """One row per conversation, in file order; raises where a file is not a list or there is none.  Files of any size are read by many tasks."""
    items = jsonlist.read_items(spark, folder, FILE_PATTERN).where(F.ltrim("item").startswith("{"))
    whole = F.when(F.get_json_object("item", "$").isNull(), F.raise_error(F.concat(F.lit("expected a JSON list in "), "source_file"))).otherwise(F.col("item"))
    return items.select("source_file", "position", F.from_json(whole, CONVERSATION).alias("c")).select("source_file", "position", "c.*")


def path_to(nodes: list[dict], current: str | None) -> list[str]:
    """Ids from the root to the current node; without a valid one, to the latest of the leaves (of all nodes, if none is a leaf).  One look-up a step."""
    parents = {}
    for n in nodes:
        parents.setdefault(n["k"], n["par"])
    if not parents:
        return []
    if current not in parents:
        inner = set(parents.values())
        leaves = [n for n in nodes if n["k"] not in inner] or nodes
        current = max(leaves, key=lambda n: n["t"] or -1.0)["k"]  # the first of equally late ones
    path: dict[str, None] = {}
    while current and current in parents and current not in path:
        path[current] = None
        current = parents[current]
    return list(path)[::-1]


def active_path(nodes: Column, current: Column) -> Column:
    """path_to of nodes, an array of (k, par, t) in source order, by Arrow batches."""

    def run(trees: pa.Array, at: pa.Array) -> pa.Array:
        return pa.array([path_to(n or [], c) for n, c in zip(trees.to_pylist(), at.to_pylist(), strict=True)], pa.list_(pa.string()))

    return F.arrow_udf(run, T.ArrayType(T.StringType()))(nodes, current)


def _truth(c: Column) -> Column:
    return F.coalesce(~F.lower(c).isin("", "false", "0", "null", "[]", "{}"), F.lit(False))


def conversations_and_messages(raw: DataFrame, on_duplicate: str = "error") -> tuple[DataFrame, DataFrame]:
    """Tables of conversations and messages.  on_duplicate: "error" for repeated conversation ids, or "latest" to keep the last."""
    cid = F.coalesce(F.nullif("conversation_id", F.lit("")), F.nullif("id", F.lit("")))
    raw = raw.withColumn("cid", cid).where("cid is not null")
    if on_duplicate == "error":
        again = raw.groupBy("cid").count().where("count > 1").limit(1).collect()
        if again:
            raise ValueError(f"conversation id occurs more than once: {again[0]['cid']}")
    else:
        last = Window.partitionBy("cid").orderBy(F.desc("source_file"), F.desc("position"))
        raw = raw.withColumn("rn", F.row_number().over(last)).where("rn = 1").drop("rn")
    node = lambda v: F.get_json_object(v, "$.parent")
    entries = F.map_entries(F.coalesce("mapping", F.create_map().cast("map<string,string>")))
    nodes = F.transform(
        entries,
        lambda e: F.struct(e["key"].alias("k"), node(e["value"]).alias("par"), X.safe_double(F.get_json_object(e["value"], "$.message.create_time")).alias("t"), e["value"].alias("v")),
    )
    walked = raw.withColumn("nodes", nodes).withColumn("path", active_path(F.col("nodes"), F.col("current_node")))
    spread = walked.select("cid", "source_file", "path", F.posexplode("nodes").alias("at", "n")).where(F.ltrim(F.get_json_object("n.v", "$.message")).startswith("{"))
    value = lambda path: F.get_json_object("n.v", path)
    place = F.array_position("path", F.col("n.k"))
    text = F.coalesce(content_text_udf(value("$.message.content")), F.lit(""))
    metadata = value("$.message.metadata")
    messages = spread.select(
        F.col("cid").alias("conversation_id"),
        F.coalesce(F.nullif(value("$.message.id"), F.lit("")), F.col("n.k")).alias("message_id"),
        F.col("n.k").alias("node_id"),
        F.col("n.par").alias("parent_id"),
        F.when(place > 0, place - 1).cast("int").alias("active_position"),
        (place > 0).alias("is_active"),
        F.coalesce(F.nullif(F.lower(X.clean_text(value("$.message.author.role"))), F.lit("")), F.lit("unknown")).alias("role"),
        F.nullif(X.clean_text(value("$.message.author.name")), F.lit("")).alias("author_name"),
        F.col("n.t").alias("create_time"),
        value("$.message.content.content_type").alias("content_type"),
        text.alias("text"),
        "source_file",
        F.when(metadata.isin("{}", "[]", "", "null"), None).otherwise(F.substring(metadata, 1, 65535)).alias("metadata_json"),
        "at",
    )
    counts = messages.groupBy("conversation_id").agg(F.sum(F.col("is_active").cast("int")).alias("active"), F.count(F.lit(1)).alias("total"))
    conversations = walked.join(counts.withColumnRenamed("conversation_id", "c"), F.col("cid") == F.col("c"), "left").select(
        F.col("cid").alias("conversation_id"),
        F.coalesce(F.nullif(X.clean_text(F.nullif("title", F.lit(""))), F.lit("")), F.lit("Untitled conversation")).alias("title"),
        X.safe_double(F.col("create_time")).alias("create_time"),
        X.safe_double(F.col("update_time")).alias("update_time"),
        "current_node",
        "default_model_slug",
        _truth(F.col("is_archived")).alias("is_archived"),
        _truth(F.col("is_starred")).alias("is_starred"),
        "source_file",
        "position",
        F.coalesce("active", F.lit(0)).cast("int").alias("active_message_count"),
        F.coalesce("total", F.lit(0)).cast("int").alias("total_message_count"),
    )
    last = Window.partitionBy("conversation_id", "message_id").orderBy(F.desc("at"))
    messages = messages.withColumn("rn", F.row_number().over(last)).where("rn = 1").drop("rn", "at").withColumn("content_hash", X.content_hash(F.col("text")))
    return conversations, messages


def from_flat(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same tables from rows of (conv_id, turn, role, text): one branch, times and titles made from the ids."""
    messages = turns.select(
        F.col("conv_id").cast("string").alias("conversation_id"),
        F.concat(F.col("conv_id"), F.lit(":"), F.col("turn")).alias("message_id"),
        F.col("turn").cast("int").alias("active_position"),
        F.lit(True).alias("is_active"),
        "role",
        (F.lit(1704067200) + F.col("conv_id") * 432000 + F.col("turn") * 60).cast("double").alias("create_time"),
        X.clean_text(F.coalesce("text", F.lit(""))).alias("text"),
        F.lit("flat").alias("source_file"),
    )
    conversations = messages.groupBy("conversation_id", "source_file").agg(
        F.min("create_time").alias("create_time"), F.count(F.lit(1)).cast("int").alias("active_message_count"), F.count(F.lit(1)).cast("int").alias("total_message_count")
    )
    conversations = conversations.withColumn("title", F.concat(F.lit("Conversation "), "conversation_id")).withColumn("position", F.lit(0))
    return conversations, messages.withColumn("content_hash", X.content_hash(F.col("text")))

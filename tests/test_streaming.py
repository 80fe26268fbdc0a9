"""Streams over files: exactly-once appends over restarts, windows that close behind the watermark."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from trawl.operators import sessions
from trawl.streaming import ingest


def write(spark, folder, name, rows):
    spark.createDataFrame(rows, ingest.FLAT).coalesce(1).write.parquet(f"{folder}/{name}")


def test_messages_are_appended_once(spark, tmp_path):
    source, table, checkpoint = (f"{tmp_path}/{n}" for n in ("in", "out", "state"))
    write(spark, source, "part=1", [(1, 0, "user", " a\r\nb "), (1, 1, "assistant", None)])
    for more in ([], [(2, 0, "user", "late file")], []):
        if more:
            write(spark, source, "part=2", more)
        ingest.append_messages(ingest.read_flat_stream(spark, f"{source}/*"), table, checkpoint).awaitTermination()
    rows = {(r.message_id, r.role, r.text) for r in spark.read.parquet(table).collect()}
    assert rows == {("1:0", "user", "a\nb"), ("1:1", "assistant", ""), ("2:0", "user", "late file")} and spark.read.parquet(table).count() == 3


def test_windows_close_behind_the_watermark(spark, tmp_path):
    source, table, checkpoint = (f"{tmp_path}/{n}" for n in ("in", "out", "state"))

    def run():
        counts = ingest.messages_by_window(ingest.read_flat_stream(spark, f"{source}/*"))
        counts.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", table).trigger(availableNow=True).start().awaitTermination()

    # conversations are five days apart, so six of them make a window of thirty days
    write(spark, source, "part=1", [(c, 0, "user", "x") for c in range(12)])
    run()
    write(spark, source, "part=2", [(0, 1, "assistant", "late but in time"), (60, 0, "user", "closes the first windows")])
    run()
    write(spark, source, "part=3", [(1, 1, "user", "too late"), (61, 0, "user", "x")])
    run()
    found = spark.read.parquet(table).groupBy("role").agg(F.sum("n").alias("n")).collect()
    assert {r.role: r.n for r in found} == {"user": 12, "assistant": 1}


def test_turns_of_a_stream_are_those_of_the_table(spark, tmp_path):
    rng = random.Random(4)
    start = datetime(2024, 1, 1)
    rows = []
    for c in range(5):
        for p in range(rng.randint(3, 14)):
            said = rng.choice(["nah", "exactly", "", f"text {p}", "more\n\n\n\n\nlines"])
            rows.append((f"c{c}", p, "user" if p and rng.random() < 0.5 else rng.choice(["user", "assistant", "system"]), said, start + timedelta(minutes=c + p)))
    rng.shuffle(rows)
    end = [("end", 0, "user", "closes all", start + timedelta(days=2)), ("end", 1, "user", "again", start + timedelta(days=4))]
    schema = "conversation_id string, active_position int, role string, text string, create_ts timestamp"
    source, out, checkpoint = (f"{tmp_path}/{n}" for n in ("in", "out", "state"))
    # messages come out of order, in two batches; the last ones move the watermark past all timers
    for n, part in enumerate((rows[::2], rows[1::2], end[:1], end[1:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{source}/part={n}")
        stream = spark.readStream.schema(schema).parquet(f"{source}/*")
        found = ingest.turns_as_stream(stream, "1 day", 60)
        found.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    table = spark.createDataFrame(rows, schema).select("*", F.lit(True).alias("is_active"), F.concat("conversation_id", "active_position").alias("message_id"), F.unix_timestamp("create_ts").cast("double").alias("create_time"))
    columns = ["conversation_id", "turn_index", "user_text", "assistant_text", "acceptance", "previous_acceptance"]
    want = sorted(tuple(r) for r in sessions.turns(table).select(columns).collect())
    got = sorted(tuple(r) for r in spark.read.parquet(out).where("conversation_id <> 'end'").select(columns).collect())
    assert got == want and len(want) > 5


def test_messages_that_never_come_are_passed_over(spark, tmp_path):
    start = datetime(2024, 1, 1)
    schema = "conversation_id string, active_position int, role string, text string, create_ts timestamp"
    parts = [[("a", 0, "user", "one", start), ("a", 2, "assistant", "held", start), ("a", 3, "user", "nope", start)], [("end", 0, "user", "x", start + timedelta(days=3))], [("end", 1, "user", "y", start + timedelta(days=6))]]
    source, out, checkpoint = (f"{tmp_path}/{n}" for n in ("in", "out", "state"))
    for n, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{source}/part={n}")
        found = ingest.turns_as_stream(spark.readStream.schema(schema).parquet(f"{source}/*"), "1 hour", 60)
        found.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.turn_index, r.user_text, r.assistant_text, r.acceptance) for r in spark.read.parquet(out).where("conversation_id = 'a'").collect())
    assert got == [(0, "one", "held", "rejected"), (1, "nope", "", "unknown")]

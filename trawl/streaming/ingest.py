"""Conversations as a stream: turns as they come, and counts by quarter with late messages."""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import UTC

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions import lexicon as L
from ..functions import text as X
from ..functions.pytext import clean

FLAT = "conv_id long, turn long, role string, text string"


def read_flat_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of (conv_id, turn, role, text) from Parquet files as they arrive, with their times."""
    rows = spark.readStream.schema(FLAT).parquet(folder)
    return rows.withColumn("create_ts", F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 432000 + F.col("turn") * 60))


def messages_by_window(messages: DataFrame, width: str = "30 days", late: str = "60 days") -> DataFrame:
    """Messages by role in windows of time; a window closes when messages later by `late` have come."""
    return messages.withWatermark("create_ts", late).groupBy(F.window("create_ts", width), "role").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "role", "n")


def append_messages(messages: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Clean new messages and add them to a Parquet table, each exactly once."""
    clean = messages.select(F.col("conv_id").cast("string").alias("conversation_id"), F.concat("conv_id", F.lit(":"), "turn").alias("message_id"), F.col("turn").cast("int").alias("active_position"), "role", X.clean_text(F.coalesce("text", F.lit(""))).alias("text"), "create_ts")
    return clean.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", table).trigger(availableNow=True).start()


TURN = "conversation_id string, turn_index int, user_text string, assistant_text string, acceptance string, previous_acceptance string"
#: The state store that turns as a stream need.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Turns(StatefulProcessor):
    """One conversation's turns, each told when the next user message has come, or when none has for `idle`.

    Messages that come before one with a lesser position are held until it comes; if it has not by the time
    the timer ends, it is passed over.  What is kept of a conversation that has been told to its end is
    its counters, so it may go on; the turn told last then stays as it was told.
    """

    def __init__(self, idle_ms: int, accept: str = L.ACCEPT, reject: str = L.REJECT):
        self.idle_ms, self.accept, self.reject = idle_ms, accept, reject

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "next int, turn int, user_text string, assistant_text string, previous string, told boolean, last_ms long")
        self.held = handle.getMapState("held", "position int", "role string, text string")

    def taken(self, text: str) -> str:
        sample = clean(text)[:1000]
        if not sample:
            return "unknown"
        return "rejected" if re.search(self.reject, sample, re.I) else "accepted" if re.search(self.accept, sample, re.I) else "unknown"

    def _state(self) -> dict:
        if not self.now.exists():
            return {"next": 0, "turn": -1, "user_text": "", "assistant_text": "", "previous": "unknown", "told": True, "last_ms": 0}
        return dict(zip(("next", "turn", "user_text", "assistant_text", "previous", "told", "last_ms"), self.now.get(), strict=True))

    def _tell(self, key: str, s: dict, acceptance: str) -> Row:
        s["told"] = True
        out = Row(conversation_id=key, turn_index=s["turn"], user_text=s["user_text"], assistant_text=clean(s["assistant_text"]), acceptance=acceptance, previous_acceptance=s["previous"])
        s["previous"] = acceptance
        return out

    def _say(self, key: str, s: dict, role: str, text: str) -> Iterator[Row]:
        if role == "user":
            if not s["told"]:
                yield self._tell(key, s, self.taken(text))
            s.update(turn=s["turn"] + 1, user_text=text, assistant_text="", told=False)
        elif role == "assistant" and text and not s["told"]:
            s["assistant_text"] = f"{s['assistant_text']}\n\n{text}" if s["assistant_text"] else text

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        (name,), s = key, self._state()
        new = {}
        for r in rows:
            if r["active_position"] >= s["next"]:
                new[r["active_position"]] = (r["role"], r["text"] or "")
            s["last_ms"] = max(s["last_ms"], int(r["create_ts"].replace(tzinfo=r["create_ts"].tzinfo or UTC).timestamp() * 1000))
        while True:
            if s["next"] in new:
                said = new.pop(s["next"])
            elif self.held.containsKey((s["next"],)):
                said = tuple(self.held.getValue((s["next"],)))
                self.held.removeKey((s["next"],))
            else:
                break
            s["next"] += 1
            yield from self._say(name, s, *said)
        for position, said in new.items():
            self.held.updateValue((position,), said)
        self._keep(s)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(s["last_ms"] + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        (name,), s = key, self._state()
        for (position,), said in sorted((tuple(k), tuple(v)) for k, v in self.held.iterator()):
            s["next"] = position + 1
            yield from self._say(name, s, *said)
        self.held.clear()
        if not s["told"]:
            yield self._tell(name, s, "unknown")
        s.update(user_text="", assistant_text="")
        self._keep(s)

    def _keep(self, s: dict) -> None:
        self.now.update(tuple(s[k] for k in ("next", "turn", "user_text", "assistant_text", "previous", "told", "last_ms")))

    def close(self) -> None:
        pass


def turns_as_stream(messages: DataFrame, late: str = "10 minutes", idle_minutes: int = 60, accept: str = L.ACCEPT, reject: str = L.REJECT) -> DataFrame:
    """TURN rows from a stream of messages (conversation_id, active_position, role, text, create_ts), as `sessions.turns` has them for a table."""
    spark = messages.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != STATE_STORE:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    timed = messages.select("conversation_id", "active_position", "role", "text", "create_ts").withWatermark("create_ts", late)
    return timed.groupBy("conversation_id").transformWithState(Turns(idle_minutes * 60_000, accept, reject), TURN, "Append", "EventTime")

"""Event operators as Structured Streaming: topics, routing, broadcasts, thread states, windows.

Nothing is dropped when a reader is slow; the checkpoint of a query keeps its place.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EVENT = "topic string, payload string, ts timestamp"


def subscribe(events: DataFrame, topic: str, payload_schema: str) -> DataFrame:
    """A topic's events with their payload's fields; batch and streaming alike."""
    return events.where(F.col("topic") == topic).select("ts", F.from_json("payload", payload_schema).alias("p")).select("ts", "p.*")


def latest_clients(clients: DataFrame) -> DataFrame:
    """The last connection of each user (user_id, client_id, connected_at)."""
    return clients.groupBy("user_id").agg(F.max_by("client_id", F.struct("connected_at", "client_id")).alias("client_id"))


def route(notifications: DataFrame, clients: DataFrame) -> DataFrame:
    """Notifications (recipient_id, ...) with the client of their user; those of users not connected go. ``clients`` is static."""
    held = latest_clients(clients)
    return notifications.join(held, notifications.recipient_id == held.user_id).drop("user_id")


def broadcast_to(messages: DataFrame, clients: DataFrame) -> DataFrame:
    """A message to each connected user of its list (recipient_ids)."""
    return route(messages.withColumn("recipient_id", F.explode("recipient_ids")).drop("recipient_ids"), clients)


def thread_state(messages: DataFrame, thread: str = "thread_id", order: str = "turn") -> DataFrame:
    """Batch: each thread's messages in order, and their number."""
    listed = F.array_sort(F.collect_list(F.struct(order, "role", "text")))
    return messages.groupBy(thread).agg(listed.alias("messages"), F.count("*").alias("n"))


def _append(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    count, last = state.get if state.exists else (0, -1)
    for b in batches:
        count += len(b)
        last = max(last, int(b["turn"].max()))
    state.update((count, last))
    yield pd.DataFrame({"thread_id": [key[0]], "n": [count], "last_turn": [last]})


def thread_counts_stream(messages: DataFrame) -> DataFrame:
    """Streaming: the number of messages of a thread and its last turn so far, whenever new ones come. The state is two numbers a thread."""
    return messages.groupBy("thread_id").applyInPandasWithState(_append, "thread_id long, n long, last_turn long", "n long, last_turn long", "update", "NoTimeout")


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "1 hour", by: str = "topic") -> DataFrame:
    """Events by window and topic; later ones than the watermark are left out when streaming."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", size), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def run_available(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Run a stream over what is there now into a table in memory (for tests and small jobs)."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def latest_per_key(table: DataFrame, key: str, order: str) -> DataFrame:
    return table.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("__n = 1").drop("__n")

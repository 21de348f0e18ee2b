"""Stateful streams by ``transformWithState``: messages of threads, keys that expire, notifications to the client connected at their time.

Time is event time: what expires, or waits for its turn, does so when the watermark passes it, so a restart from the checkpoint and any cut into
micro-batches give the same rows. Each has a batch twin over the whole table. The session needs the RocksDB state store, see :func:`use_rocksdb`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MESSAGE = "thread_id {key}, messages array<struct<turn:long,role:string,text:string>>, n long, expired boolean"
KEY = "key string, value string, expires_at timestamp, live boolean"
SENT = "user_id {key}, ts timestamp, seq long, client_id string, payload string"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _ms(c: str = "ts") -> Column:
    return F.unix_millis(F.col(c).cast("timestamp"))


class _Timed(StatefulProcessor):
    """A processor with one timer for each key at most."""

    handle: StatefulProcessorHandle

    def set_timer(self, at: int | None) -> None:
        """Move the key's timer; None takes it away."""
        for old in list(self.handle.listTimers()):
            if old != at:
                self.handle.deleteTimer(old)
        if at is not None:
            self.handle.registerTimer(at)

    def close(self) -> None:
        pass


class _Threads(_Timed):
    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.messages = handle.getMapState("messages", "id string", "turn long, role string, text string, seq long")
        self.last = handle.getValueState("last", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else 0
        for batch in rows:
            for r in batch.itertuples(index=False):
                last = max(last, r.ms)
                own = (r.message_id,)
                if self.messages.containsKey(own) and self.messages.getValue(own)[3] > r.seq:
                    continue  # an older version of the message that comes late
                self.messages.updateValue(own, (int(r.turn), None if r.removed else r.role, None if r.removed else r.text, int(r.seq)))
        self.last.update((int(last),))
        self.set_timer(int(last) + self.idle_ms)
        # A message that was removed is held without a role, so that its older versions stay out too.
        found = sorted((v[0], k[0], v[1], v[2]) for k, v in self.messages.iterator() if v[1] is not None)
        listed = [{"turn": t, "role": role, "text": text} for t, _, role, text in found]
        yield pd.DataFrame({"thread_id": [key[0]], "messages": [listed], "n": [len(listed)], "expired": [False]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.messages.clear()
        self.last.clear()
        yield pd.DataFrame({"thread_id": [key[0]], "messages": [[]], "n": [0], "expired": [True]})


def thread_messages(messages: DataFrame, late: str = "1 hour", idle_seconds: int = 30 * 86400) -> DataFrame:
    """Streaming: a thread's messages in order of turn, whenever new ones come: thread_id, messages, n, expired.

    ``messages``: thread_id, message_id, turn, role, text, removed, seq, ts. A message whose id is there replaces it, unless its ``seq`` is less; one that is
    ``removed`` goes. A thread without messages for ``idle_seconds`` is forgotten, with a row that says so. Use output mode ``update``.
    """
    rows = messages.withWatermark("ts", late).withColumn("ms", _ms()).withColumn("removed", F.coalesce("removed", F.lit(False)))
    return rows.groupBy("thread_id").transformWithStateInPandas(_Threads(idle_seconds * 1000), MESSAGE.format(key=dict(messages.dtypes)["thread_id"]), "update", "EventTime")


def thread_messages_at_once(messages: DataFrame) -> DataFrame:
    """The batch twin: (thread_id, messages, n) of all messages, by the last version of each id."""
    last = messages.groupBy("thread_id", "message_id").agg(F.max_by(F.struct("turn", "role", "text", F.coalesce("removed", F.lit(False)).alias("removed")), "seq").alias("m"))
    kept = F.filter(F.array_sort(F.collect_list(F.struct("m.turn", "message_id", "m.role", "m.text", "m.removed"))), lambda m: ~m["removed"])
    listed = last.groupBy("thread_id").agg(F.transform(kept, lambda m: F.struct(m["turn"].alias("turn"), m["role"].alias("role"), m["text"].alias("text"))).alias("messages"))
    return listed.withColumn("n", F.size("messages").cast("long"))


class _Keys(_Timed):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "value string, set_ms long, seq long, expires long")

    def _row(self, key, value, expires: int, live: bool) -> pd.DataFrame:
        return pd.DataFrame({"key": [key[0]], "value": [value], "expires_at": [pd.Timestamp(expires, unit="ms")], "live": [live]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.held.get() if self.held.exists() else None
        newest = held
        for batch in rows:
            for r in batch.itertuples(index=False):
                if newest is None or (r.ms, r.seq) > (newest[1], newest[2]):
                    value = None if r.value is None or r.value != r.value else r.value
                    newest = (value, int(r.ms), int(r.seq), int(r.ms) + 1000 * int(r.ttl_seconds) if value is not None else int(r.ms))
        if newest is held:
            return
        self.held.update(newest)
        # A tombstone has no time left; it stays until the watermark passes it, as rows from before it may still come.
        self.set_timer(max(newest[3], newest[1]))
        yield self._row(key, newest[0], newest[3], newest[0] is not None and newest[3] > timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        value, _, _, expires = self.held.get()
        self.held.clear()
        if value is not None:
            yield self._row(key, value, expires, False)


def expiring_keys(rows: DataFrame, late: str = "0 seconds") -> DataFrame:
    """Streaming: what becomes of each key (key, value, set_at, ttl_seconds, seq) as it is set, removed by a null value, and expires.

    Columns: key, value, expires_at, live. The last row of each key tells whether it is live at the watermark, as :func:`docloom.operators.store.live_keys` does
    for that time; a row that is set before the one held is ignored. Use output mode ``update``.
    """
    timed = rows.withWatermark("set_at", late).withColumn("ms", _ms("set_at"))
    return timed.groupBy("key").transformWithStateInPandas(_Keys(), KEY, "update", "EventTime")


class _Clients(_Timed):
    def __init__(self, any_client: bool):
        self.any_client = any_client

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.client = handle.getValueState("client", "client_id string")
        self.waiting = handle.getListState("waiting", "ms long, seq long, kind string, client_id string, payload string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(r.ms), int(r.seq), r.kind, r.client_id, r.payload) for batch in rows for r in batch.itertuples(index=False)]
        self.waiting.appendList(new)
        known = list(self.handle.listTimers())
        self.set_timer(min([r[0] for r in new] + known))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(self.waiting.get(), key=lambda r: (r[0], r[1]))
        due, rest = [r for r in waiting if r[0] <= now], [r for r in waiting if r[0] > now]
        client = self.client.get()[0] if self.client.exists() else None
        sent = []
        for ms, seq, kind, which, payload in due:
            if kind == "connect":
                client = which
            elif kind == "disconnect":
                client = None if self.any_client or which == client else client
            elif client is not None:
                sent.append((ms, seq, client, payload))
        if client is None:
            self.client.clear()
        else:
            self.client.update((client,))
        self.waiting.clear()
        if rest:
            self.waiting.put([tuple(r) for r in rest])
            self.handle.registerTimer(rest[0][0])
        if sent:
            yield pd.DataFrame({"user_id": key[0], "ts": [pd.Timestamp(ms, unit="ms") for ms, *_ in sent], "seq": [r[1] for r in sent], "client_id": [r[2] for r in sent], "payload": [r[3] for r in sent]})


def route_stream(events: DataFrame, late: str = "10 minutes", any_client: bool = True) -> DataFrame:
    """Streaming: notifications with the client that their user had at their time: user_id, ts, seq, client_id, payload.

    ``events``: user_id, ts, seq, kind (connect, disconnect, or a notification), client_id, payload. Events wait until the watermark passes them and are then taken
    in order of (ts, seq), so late connects and disconnects count where they belong. A disconnect ends the user's connection, whichever client it names; with
    ``any_client`` false only if it names the one connected last. Notifications of users not connected go. Use output mode ``append`` or ``update``.
    """
    rows = events.withWatermark("ts", late).withColumn("ms", _ms())
    return rows.groupBy("user_id").transformWithStateInPandas(_Clients(any_client), SENT.format(key=dict(events.dtypes)["user_id"]), "append", "EventTime")


def route_at_once(events: DataFrame, bucket_seconds: int = 86400) -> DataFrame:
    """The batch twin of :func:`route_stream` for ``any_client``.

    Windows are over a user's bucket of time, and a bucket's first notifications take what the user's last bucket with a connect or disconnect left, so a user with
    very many events is spread over tasks.
    """
    change = F.when(F.col("kind").isin("connect", "disconnect"), F.struct(F.when(F.col("kind") == "connect", F.col("client_id")).alias("client")))
    rows = events.withColumn("bucket", F.floor(_ms() / (1000 * bucket_seconds))).withColumn("change", change)
    order = F.struct("ts", "seq")
    lasts = rows.where("change is not null").groupBy("user_id", "bucket").agg(F.max_by("change", order).alias("left"))
    spans = rows.select("user_id", "bucket").distinct().join(lasts, ["user_id", "bucket"], "left")
    before = Window.partitionBy("user_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select("user_id", "bucket", F.last("left", ignorenulls=True).over(before).alias("carried"))
    within = Window.partitionBy("user_id", "bucket").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    held = rows.withColumn("own", F.last("change", ignorenulls=True).over(within)).join(carried, ["user_id", "bucket"])
    sent = held.where(~F.col("kind").isin("connect", "disconnect")).withColumn("now", F.coalesce("own", "carried"))
    return sent.where(F.col("now.client").isNotNull()).select("user_id", "ts", "seq", F.col("now.client").alias("client_id"), "payload")

"""Stateful streams against their batch twins, over several micro-batches and restarts from the checkpoint."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from docloom.operators import store
from docloom.streaming import stateful

START = datetime(2024, 3, 1, tzinfo=timezone.utc)


def at(seconds):
    return START + timedelta(seconds=seconds)


class Feed:
    """Files put into a folder one by one, each a micro-batch of the stream over it."""

    def __init__(self, spark, folder, schema, stream, mode):
        self.spark, self.folder, self.schema, self.stream, self.mode = spark, str(folder), schema, stream, mode
        stateful.use_rocksdb(spark)

    def add(self, *files):
        for rows in files:
            self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")

    def run(self):
        """Process what is there, from the checkpoint on; all rows so far, numbered by run."""
        source = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/in")
        sink = lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{self.folder}/out")
        query = self.stream(source).writeStream.foreachBatch(sink).outputMode(self.mode).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        return self.spark.read.parquet(f"{self.folder}/out")

    def all(self):
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/in")


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_threads_hold_their_messages_in_order(spark, tmp_path):
    schema = "thread_id long, message_id string, turn long, role string, text string, removed boolean, seq long, ts timestamp"
    row = lambda t, m, turn, text, seq, s, gone=False: (t, m, turn, "user", text, gone, seq, at(s))
    feed = Feed(spark, tmp_path, schema, lambda s: stateful.thread_messages(s, "10 minutes", 3600), "update")
    feed.add([row(1, "b", 2, "two", 1, 10), row(2, "x", 1, "hi", 2, 12)], [row(1, "a", 1, "one", 3, 15)])
    feed.run()
    feed.add([row(1, "b", 2, "two, mended", 5, 30), row(1, "c", 3, "three", 6, 31), row(1, "c", 3, "gone", 7, 32, True)], [row(1, "b", 2, "old two", 4, 33), row(1, "c", 3, "older", 2, 34)])
    out = feed.run()  # a second run, from the checkpoint
    last = lambda t: max((r for r in out.collect() if r.thread_id == t), key=lambda r: r.batch)
    for r in stateful.thread_messages_at_once(feed.all()).collect():
        assert (r.messages, r.n) == (last(r.thread_id).messages, last(r.thread_id).n)
    assert [m.text for m in last(1).messages] == ["one", "two, mended"]
    feed.add([row(3, "y", 1, "much later", 8, 9000)], [row(3, "z", 2, "and again", 9, 9001)])
    out = feed.run()
    assert {r.thread_id for r in out.where("expired").collect()} == {1, 2} and last(3).n == 2


def test_keys_expire_like_the_batch_says(spark, tmp_path):
    schema = "key string, value string, set_at timestamp, ttl_seconds long, seq long"
    rng = random.Random(5)
    feed = Feed(spark, tmp_path, schema, lambda s: stateful.expiring_keys(s, "60 seconds"), "update")
    seq, clock = 0, 0
    for _ in range(3):
        for _ in range(2):
            rows = []
            for _ in range(12):
                seq, clock = seq + 1, clock + rng.randint(0, 20)
                rows.append((f"k{rng.randint(0, 7)}", None if rng.random() < 0.2 else f"v{seq}", at(clock - rng.randint(0, 40)), rng.choice([15, 60, 200, 5000]), seq))
            feed.add(rows)
        out = feed.run()
        now = feed.all().agg(F.max("set_at").alias("m")).first().m - timedelta(seconds=60)  # the watermark
        last = out.groupBy("key").agg(F.max_by(F.struct("value", "live"), F.struct("batch", ~F.col("live"))).alias("r")).where("r.live")
        batch = store.live_keys(feed.all(), F.lit(now))
        assert sorted((r.key, r.r.value) for r in last.collect()) == sorted((r.key, r.value) for r in batch.collect())


def plain_route(rows, any_client):
    client, out = {}, []
    for user, ts, seq, kind, which, payload in sorted(rows, key=lambda r: (r[1], r[2])):
        if kind == "connect":
            client[user] = which
        elif kind == "disconnect":
            if any_client or client.get(user) == which:
                client.pop(user, None)
        elif user in client:
            out.append((user, seq, client[user], payload))
    return sorted(out)


@pytest.mark.parametrize("any_client", [True, False])
def test_notifications_go_to_the_client_of_their_time(spark, tmp_path, any_client):
    schema = "user_id long, ts timestamp, seq long, kind string, client_id string, payload string"
    rng = random.Random(9)
    rows = []
    for seq in range(90):
        kind = rng.choice(["connect", "disconnect", "note", "note", "note"])
        rows.append((rng.choice([1, 1, 1, 2, 3]), at(seq * 7), seq, kind, f"c{rng.randint(0, 2)}" if kind != "note" else None, f"p{seq}" if kind == "note" else None))
    late = sorted(rows, key=lambda r: r[2] + rng.randint(0, 12))  # each comes up to 84 seconds late
    feed = Feed(spark, tmp_path, schema, lambda s: stateful.route_stream(s, "2 minutes", any_client), "append")
    feed.add(late[:20], late[20:40])
    feed.run()
    feed.add(late[40:65], late[65:], [(9, at(5000), 999, "note", None, "end")])
    out = feed.run()
    got = sorted((r.user_id, r.seq, r.client_id, r.payload) for r in out.collect())
    assert got == plain_route(rows, any_client)
    if any_client:
        twin = stateful.route_at_once(spark.createDataFrame(rows, schema), 60)
        assert sorted((r.user_id, r.seq, r.client_id, r.payload) for r in twin.collect()) == got

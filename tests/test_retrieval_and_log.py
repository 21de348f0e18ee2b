"""Retrieval algebra, stage log, store, evaluation and streaming on small fixtures."""

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from docloom.functions.fixed_values import STAGES
from docloom.operators import evalset, retrieval, stage_log, store, vector_index
from docloom.streaming import events


def test_rerank_keeps_the_best_if_none_passes(spark):
    rows = spark.createDataFrame([(1, "a", "q", "x", 1), (1, "b", "q", "y", 2), (2, "a", "q z", "q", 1)], "qid int, chunk_id string, query string, text string, position int")
    got = retrieval.rerank(rows, 0.1, lambda q, t: F.when(t == "x", 0.05).when(t == "y", 0.02).otherwise(0.5)).collect()
    assert sorted((r.qid, r.chunk_id, r.score) for r in got) == [(1, "a", 0.05), (2, "a", 0.5)]


def test_delivery_filter(spark):
    rows = [(1, "từ xa?", "Đào tạo Từ xa"), (1, "từ xa?", "khác"), (2, "từ xa", "khác"), (3, "hệ chính quy", "từ xa"), (3, "hệ chính quy", None), (4, "x", "từ xa")]
    got = retrieval.delivery_filter(spark.createDataFrame(rows, "qid int, query string, title string")).collect()
    assert sorted((r.qid, str(r.title)) for r in got) == [(1, "Đào tạo Từ xa"), (2, "khác"), (3, "None"), (4, "từ xa")]


def test_results_and_distilling(spark):
    rows = spark.createDataFrame([(1, k, f"One q word. Other {k} sentence here is long enough.", "q", None) for k in (1, 2, 3)], "qid int, rank int, text string, query string, file_name string")
    r = retrieval.distil(rows).first()
    assert r.distilled and r.context == "One q word.\nOne q word.\nOne q word."
    assert retrieval.raw_context(rows.where("rank < 3")).first().context == "[Nguồn 1: Unknown]\nOne q word. Other 1 sentence here is long enough.\n\n---\n\n[Nguồn 2: Unknown]\nOne q word. Other 2 sentence here is long enough."
    assert not retrieval.distil(rows.where("rank < 3")).first().distilled


def test_skip_decisions(spark):
    rows = [("completed", False, True, False, "skip_unchanged"), ("completed", False, False, False, "run_input_changed"), ("completed", True, False, False, "skip_locked_manual_edit"), ("completed", True, True, True, "run_forced"), (None, None, None, False, "run_not_completed")]
    df = spark.createDataFrame(rows, "status string, locked boolean, same boolean, force boolean, want string")
    assert all(r.got == r.want for r in df.withColumn("got", stage_log.skip_decision(*map(F.col, ("status", "locked", "same", "force")))).collect())
    assert stage_log.stage_range("clean", "filter") == STAGES[1:4]


def test_stage_log_round(spark):
    docs = spark.createDataFrame([("a", "text"), ("b", "")], "document_id string, text string")
    log = spark.createDataFrame([], "document_id string, stage string, status string, ts timestamp, cost double, input_hash string, output string, manually_edited boolean, seq long")
    now = F.lit("2024-01-01").cast("timestamp")
    ran = stage_log.run_stage(stage_log.plan_stage(docs, stage_log.current_state(log), "clean"), F.upper("text"), "clean", 0.5, now)
    assert sorted((r.document_id, r.status, r.cost) for r in ran.collect()) == [("a", "completed", 0.5), ("b", "failed", 0.0)]
    log = ran.select("document_id", "stage", "status", "ts", "cost", "input_hash", "output", F.lit(False).alias("manually_edited"), F.lit(1).cast("long").alias("seq"))
    again = stage_log.plan_stage(docs, stage_log.current_state(log), "clean")
    assert sorted((r.document_id, r.decision) for r in again.collect()) == [("a", "skip_unchanged"), ("b", "run_not_completed")]


def test_store_outcomes(spark):
    secs = spark.createDataFrame([(None,), (5,), (3599,), (86399,), (172800,)], "s int").select(store.elapsed(F.col("s")).alias("e"))
    assert [r.e for r in secs.collect()] == ["Never", "Just now", "59m ago", "23h ago", "2d ago"]
    notes = spark.createDataFrame([(1, 7, None), (2, 7, True), (3, 8, None)], "id int, recipient_id int, is_read boolean")
    assert {(r.recipient_id, r.unread) for r in store.unread_counts(notes).collect()} == {(7, 1), (8, 1)}
    assert store.mark_read(notes, 7).where("modified").count() == 1 and store.mark_read(notes, 7, 2).where("modified").count() == 0
    pages = spark.range(7)
    assert [r.id for r in store.page(pages, 2, 3, 100, F.col("id").desc()).collect()] == [3, 2, 1]
    sessions = spark.createDataFrame([(1, "u", None), (2, "v", None)], "id int, user_id string, deleted_at timestamp")
    gone = store.soft_delete(sessions, [1], F.lit("2024-01-01").cast("timestamp"))
    assert [r.id for r in store.live(gone).collect()] == [2] and store.owned_by(gone, "u").count() == 0


def test_evaluation(spark):
    df = spark.createDataFrame([(i, f"s{i % 3}") for i in range(60)], "id int, s string")
    picked = evalset.stratified_sample(df, "s", "id", 12, 5)
    assert picked.count() == 12 and {r.n for r in picked.groupBy("s").agg(F.count("*").alias("n")).collect()} == {4}
    assert evalset.stratified_sample(df, "s", "id", 100, 5).count() == 60
    means = evalset.metric_means(spark.createDataFrame([(1.0, None), (0.0, 0.5)], "a double, b double"), ["a", "b"])
    assert {r.metric: r.mean for r in means.collect()} == {"a": 0.5, "b": 0.25}
    assert '"test_set_size":60' in evalset.evaluation_json(df, means, "t", "e").first().value
    both = evalset.union_files({"b": df, "a": df.limit(1)})
    assert both.count() == 61 and {r.file for r in both.select("file").distinct().collect()} == {"a", "b"}


def test_streams_match_batches(spark, tmp_path):
    rows = [(t, "click" if k % 2 else "view", k) for t in (1, 2) for k in range(6)]
    for n, part in enumerate((rows[:5], rows[5:])):
        spark.createDataFrame(part, "thread_id long, topic string, turn long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        assert n < 2
    source = spark.readStream.schema("thread_id long, topic string, turn long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    events.run_available(events.thread_counts_stream(source.select("thread_id", "turn")), "threads", "update", f"{tmp_path}/c1")
    last = events.latest_per_key(spark.table("threads"), "thread_id", "n")
    assert sorted(tuple(r) for r in last.select("thread_id", "n", "last_turn").collect()) == [(1, 6, 5), (2, 6, 5)]
    timed = source.withColumn("ts", F.timestamp_seconds(F.col("turn") * 1800))
    counted = events.run_available(events.windowed_counts(timed, "1 hour", "10 hours"), "windows", "complete", f"{tmp_path}/c2")
    batch = events.windowed_counts(spark.read.parquet(f"{tmp_path}/in").withColumn("ts", F.timestamp_seconds(F.col("turn") * 1800)))
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, batch.collect()))
    clients = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "user_id long, client_id long, connected_at long")
    sent = events.route(source.withColumnRenamed("thread_id", "recipient_id"), clients)
    assert events.run_available(sent, "routed", "append", f"{tmp_path}/c3").select("client_id").distinct().collect()[0][0] == 11


def all_pairs(asked, rows, k, least, metric):
    """The best k of every query over all rows, by plain Python."""
    out = []
    for qid, q in asked:
        scored = []
        for chunk, x in rows:
            if x is None or None in x or not all(map(math.isfinite, x)) or (metric == "cosine" and not any(x)):
                continue
            if metric == "cosine":
                s = sum(a * b for a, b in zip(q, x)) / math.sqrt(sum(a * a for a in q)) / math.sqrt(sum(b * b for b in x))
            else:
                s = math.exp(-sum((a - b) ** 2 for a, b in zip(q, x)))
            scored.append((-math.floor(s * 1e6 + 0.5), chunk))
        out += [(qid, chunk, -s, n) for n, (s, chunk) in enumerate(sorted(scored)[:k], 1) if -s >= least * 1e6]
    return sorted(out)


@pytest.mark.parametrize("metric", ["cosine", "l2_exp"])
@pytest.mark.parametrize("part, block", [(4096, 4096), (7, 3)])
def test_index_finds_what_all_pairs_find(spark, monkeypatch, metric, part, block):
    monkeypatch.setattr(vector_index, "PART_ROWS", part)
    monkeypatch.setattr(vector_index, "BLOCK_QUERIES", block)
    rng = random.Random(7)
    centres = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(12)]
    rows = [(i, [c + rng.gauss(0, 0.05) for c in centres[i % 12]]) for i in range(600)]
    rows += [(1000 + i, rows[0][1]) for i in range(300)]  # a third are copies
    rows += [(2000, None), (2001, [None] * 5), (2002, [float("nan")] * 5), (2003, [0.0] * 5)]
    asked = [(i, x) for i, x in rows[:600:40]]
    vectors, queries = spark.createDataFrame(rows, "chunk_id long, embedding array<double>"), spark.createDataFrame([*asked, (-1, None)], "qid long, query_vector array<double>")
    found, pairs = vector_index.search(vector_index.build_index(vectors, metric), queries, 6, 0.2)
    got = sorted((r.qid, r.chunk_id, round(r.score * 1e6), r["rank"]) for r in found.collect())
    assert got == all_pairs(asked, rows, 6, 0.2, metric)
    scored = sum(r.pairs for r in pairs.collect())
    assert scored < 0.5 * len(asked) * 900  # few cells are read


def test_index_of_nothing(spark):
    none = spark.createDataFrame([(1, None)], "chunk_id long, embedding array<float>")
    asked = spark.createDataFrame([(1, [1.0])], "qid long, query_vector array<float>")
    assert retrieval.dense_top_k(asked, none).count() == 0
    one = spark.createDataFrame([(1, [2.0])], "chunk_id long, embedding array<float>")
    assert [tuple(r) for r in retrieval.dense_top_k(asked, one).collect()] == [(1, 1, 1.0, 1)]
    assert retrieval.dense_top_k(asked.limit(0), one).count() == 0


def test_hashed_vectors(spark):
    texts = spark.createDataFrame([(1, "b a b"), (2, ""), (3, None), (4, "...")], "id int, t string")
    got = {r.id: r.embedding for r in retrieval.hashing_embeddings(texts, "id", "t", 8).collect()}
    place = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 8
    counts = [0.0] * 8
    for w in ("b", "a", "b"):
        counts[place(w)] += 1
    norm = math.sqrt(sum(c * c for c in counts))
    assert got[1] == pytest.approx([c / norm for c in counts]) and got[2] == got[3] == got[4] == [0.0] * 8


def test_bm25_tasks_follow_the_rows_summed(spark, monkeypatch):
    """Larger corpora are summed by more tasks, whatever the bytes that are read; the rows are the same."""
    words = "alpha beta gamma delta".split()
    corpus = spark.createDataFrame([(i, " ".join(words[i % 4 :] + [f"w{i}"] * (i % 5))) for i in range(200)] + [(200, None), (201, "")], "chunk_id long, text string")
    queries = spark.createDataFrame([(1, "alpha beta"), (2, "gamma delta w7"), (3, "absent")], "qid long, query string")
    want = sorted(retrieval.bm25(queries, corpus).collect())
    monkeypatch.setattr(retrieval, "TASK_ROWS", 20, raising=False)
    cut = retrieval.bm25(queries, corpus)
    dealt = re.search(r"hashpartitioning\(chunk_id#\d+L, (\d+)\), REPARTITION_BY_NUM", cut._jdf.queryExecution().executedPlan().toString())
    assert dealt and int(dealt[1]) == 21  # 404 scores at most
    assert sorted(cut.collect()) == want and len(want) == 20
    assert retrieval.bm25(queries, corpus.limit(0)).count() == 0

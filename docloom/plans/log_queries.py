"""Queries of the stage log: events stand for it (document: user, stage: event type, cost: value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import stage_log
from docloom.plans.query import Query, read

TYPES = ["view", "click", "signup", "purchase", "error"]


def _log(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    status = F.when(F.col("value") < 5, "failed").when(F.col("value") < 8, "skipped").when(F.col("value") < 10, "in_progress").otherwise("completed")
    return e.select(
        F.col("user_id").alias("document_id"), F.concat(F.lit("c"), (F.col("user_id") % 4).cast("string")).alias("category"), F.col("event_type").alias("stage"), status.alias("status"), "ts", F.round(F.col("value") * 100).cast("long").alias("cost"),
        F.concat(F.lit("h"), (F.col("event_id") % 7).cast("string")).alias("input_hash"), F.when(F.col("value") >= 10, F.concat(F.lit("o"), F.col("event_id").cast("string"))).otherwise("").alias("output"), (F.col("event_id") % 11 == 0).alias("manually_edited"), F.col("event_id").alias("seq"),
    )


LOG = """log AS (SELECT user_id AS document_id, 'c' || (user_id % 4) AS category, event_type AS stage, CASE WHEN value < 5 THEN 'failed' WHEN value < 8 THEN 'skipped' WHEN value < 10 THEN 'in_progress' ELSE 'completed' END AS status, ts,
CAST(round(value * 100) AS BIGINT) AS cost, 'h' || (event_id % 7) AS input_hash, CASE WHEN value >= 10 THEN 'o' || event_id ELSE '' END AS output, event_id % 11 = 0 AS manually_edited, event_id AS seq FROM events),
state AS (SELECT document_id, stage, arg_max(status, (ts, seq)) AS status, max(ts) AS ts, arg_max(cost, (ts, seq)) AS cost, arg_max(input_hash, (ts, seq)) AS input_hash, arg_max(output, (ts, seq)) FILTER (output <> '') AS output, arg_max(manually_edited, (ts, seq)) AS manually_edited FROM log GROUP BY ALL)"""


def stage_state_upsert(spark: SparkSession, d: str) -> DataFrame:
    """States with their merged metadata as ``name=value`` in order of name."""
    n = F.col("seq").cast("string")
    meta = F.when(F.col("seq") % 4 != 0, F.create_map(F.lit("last"), n, F.concat(F.lit("k"), (F.col("seq") % 5).cast("string")), F.concat(F.lit("v"), n)))
    state = stage_log.current_state(_log(spark, d).withColumn("metadata", meta))
    return state.withColumn("metadata", F.array_join(F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","))


UPSERT = f"""WITH {LOG}, e AS (SELECT document_id, stage, ts, seq, 'last' AS name, CAST(seq AS VARCHAR) AS v FROM log WHERE seq % 4 <> 0 UNION ALL SELECT document_id, stage, ts, seq, 'k' || seq % 5, 'v' || seq FROM log WHERE seq % 4 <> 0),
m AS (SELECT document_id, stage, string_agg(name || '=' || v, ',' ORDER BY name) AS metadata FROM (SELECT document_id, stage, name, arg_max(v, (ts, seq)) AS v FROM e GROUP BY ALL) GROUP BY ALL)
SELECT state.*, metadata FROM state LEFT JOIN m USING (document_id, stage)"""


def document_state(spark: SparkSession, d: str) -> DataFrame:
    return stage_log.document_state(_log(spark, d))


DOCUMENT_STATE = f"""WITH {LOG} SELECT document_id, arg_max(stage, (ts, seq)) FILTER (status = 'completed') AS current_stage, arg_max(output, (ts, seq)) FILTER (status = 'completed' AND output <> '') AS final_output FROM log GROUP BY 1"""


def stage_skip_decision(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "text")
    state = stage_log.current_state(_log(spark, d))
    # Hashes of the log are no hashes of texts: those of even documents are taken to be.
    held = state.join(docs.select("document_id", F.substring(F.sha2("text", 256), 1, 16).alias("h")), "document_id", "left")
    state = held.withColumn("input_hash", F.when(F.col("document_id") % 2 == 0, F.col("h")).otherwise(F.col("input_hash"))).drop("h")
    return stage_log.plan_stage(docs, state, "click").select("document_id", "decision")


SKIP = f"""WITH {LOG} SELECT doc_id AS document_id, CASE WHEN coalesce(status, 'pending') <> 'completed' THEN 'run_not_completed' WHEN manually_edited THEN 'skip_locked_manual_edit' WHEN doc_id % 2 = 0 THEN 'skip_unchanged' ELSE 'run_input_changed' END AS decision
FROM documents LEFT JOIN (SELECT * FROM state WHERE stage = 'click') s ON s.document_id = doc_id"""


def stage_status_line(spark: SparkSession, d: str) -> DataFrame:
    return stage_log.status_line(stage_log.current_state(_log(spark, d)), TYPES)


STATUS = f"""WITH {LOG} SELECT document_id, CAST(sum(cost) AS BIGINT) AS total_cost, {" || ' -> ' || ".join(f"CASE WHEN bool_or(stage = '{t}' AND status = 'completed') THEN '[x] ' ELSE '[ ] ' END || '{t}'" for t in TYPES)} AS status_line FROM state GROUP BY 1"""


def stage_input(spark: SparkSession, d: str) -> DataFrame:
    return stage_log.stage_input(stage_log.current_state(_log(spark, d)), "purchase", TYPES)


INPUT = f"""WITH {LOG}, o AS (SELECT *, CASE stage WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END AS k FROM state)
SELECT document_id, arg_max(output, k) AS input, arg_max(stage, k) AS input_stage FROM o WHERE status = 'completed' AND k < 3 GROUP BY 1"""


def final_output(spark: SparkSession, d: str) -> DataFrame:
    state = stage_log.current_state(_log(spark, d))
    renamed = state.withColumn("stage", F.when(F.col("stage") == "purchase", "flatten-table").when(F.col("stage") == "signup", "fix-markdown").otherwise(F.col("stage")))
    return stage_log.final_output(renamed)


FINAL = f"WITH {LOG} SELECT document_id, coalesce(max(CASE WHEN stage = 'purchase' THEN output END), max(CASE WHEN stage = 'signup' THEN output END)) AS final_output FROM state GROUP BY 1"


def first_of_category(spark: SparkSession, d: str) -> DataFrame:
    docs = _log(spark, d).select("document_id", "category").distinct()
    return stage_log.first_of_each(docs, 5).select("category", "document_id", "n")


FIRST = f"WITH {LOG} SELECT category, document_id, CAST(n AS INT) AS n FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY document_id) AS n FROM (SELECT DISTINCT document_id, category FROM log)) WHERE n <= 5"


def dashboard_metrics(spark: SparkSession, d: str) -> DataFrame:
    docs = _log(spark, d).groupBy("document_id", "category").agg(F.sum("cost").alias("cost"), F.count("*").alias("chunks"))
    return stage_log.dashboard(docs)


DASHBOARD = f"WITH {LOG}, d AS (SELECT document_id, category, sum(cost) AS cost, count(*) AS chunks FROM log GROUP BY ALL) SELECT count(*) AS documents, CAST(sum(cost) AS BIGINT) AS cost, CAST(sum(chunks) AS BIGINT) AS chunks, count(DISTINCT category) AS categories FROM d"


def batch_tally(spark: SparkSession, d: str) -> DataFrame:
    return stage_log.tally(_log(spark, d), "category")


TALLY = f"WITH {LOG} SELECT category, status, count(*) AS n FROM log GROUP BY ALL"


def _built(spark: SparkSession, d: str) -> DataFrame:
    state = stage_log.current_state(_log(spark, d)).where("stage = 'view'")
    return state.withColumn("category", F.concat(F.lit("c"), (F.col("document_id") % 4).cast("string"))).withColumn("error", F.concat(F.lit("cost "), F.col("cost")))


def build_tally(spark: SparkSession, d: str) -> DataFrame:
    return stage_log.build_tally(_built(spark, d))


BUILD = f"""WITH {LOG} SELECT 'c' || (document_id % 4) AS category, count(*) FILTER (status IN ('completed', 'skipped')) AS indexed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'failed') = 0 AS success
FROM state WHERE stage = 'view' GROUP BY 1"""


def build_failures(spark: SparkSession, d: str) -> DataFrame:
    return stage_log.build_failures(_built(spark, d))


FAILURES = f"WITH {LOG} SELECT 'c' || (document_id % 4) AS category, document_id, 'cost ' || cost AS error FROM state WHERE stage = 'view' AND status = 'failed'"


def stage_run(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "text")
    planned = stage_log.plan_stage(docs, stage_log.current_state(_log(spark, d)), "view")
    ran = stage_log.run_stage(planned, F.when(F.length("text") > 300, F.concat(F.lit("ran "), F.col("text"))), "view", 0.05, F.lit("2024-02-01").cast("timestamp_ntz"))
    return ran.select("document_id", "stage", "status", "input_hash", F.md5(F.coalesce("output", F.lit(""))).alias("output_md5"), F.round(F.col("cost") * 100).cast("long").alias("cost"), "error")


RUN = f"""WITH {LOG} SELECT doc_id AS document_id, 'view' AS stage, CASE WHEN length(text) > 300 THEN 'completed' ELSE 'failed' END AS status, sha256(text)[1:16] AS input_hash, md5(CASE WHEN length(text) > 300 THEN 'ran ' || text ELSE '' END) AS output_md5,
CAST(CASE WHEN length(text) > 300 THEN 5 ELSE 0 END AS BIGINT) AS cost, CASE WHEN length(text) > 300 THEN NULL ELSE 'empty result' END AS error FROM documents LEFT JOIN (SELECT * FROM state WHERE stage = 'view') s ON s.document_id = doc_id
WHERE NOT (coalesce(status, 'pending') = 'completed' AND manually_edited)"""


def reindex_upsert(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "text")
    low = read(spark, d, "labels").where("quality = 0").select(F.col("doc_id").alias("document_id"))
    new = docs.join(low, "document_id", "left_semi").withColumn("text", F.concat(F.lit("new "), F.col("text")))
    return stage_log.replace_documents(docs, new).select("document_id", F.md5("text").alias("text_md5"))


REINDEX = "SELECT doc_id AS document_id, md5(CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) THEN 'new ' || text ELSE text END) AS text_md5 FROM documents"


def migrate_layout(spark: SparkSession, d: str) -> DataFrame:
    flat = read(spark, d, "documents").select(F.col("doc_id").alias("document_id"))
    existing = read(spark, d, "labels").select(F.col("doc_id").alias("document_id"))
    return stage_log.migrate(flat, existing, ["parse", "clean"], F.lit("2024-02-01").cast("timestamp_ntz")).select("document_id", "stage", "status")


MIGRATE = "SELECT doc_id AS document_id, unnest(['parse', 'clean']) AS stage, 'completed' AS status FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"

QUERIES = {
    "stage_state_upsert": Query(stage_state_upsert, UPSERT),
    "document_state": Query(document_state, DOCUMENT_STATE),
    "stage_skip_decision": Query(stage_skip_decision, SKIP),
    "stage_status_line": Query(stage_status_line, STATUS),
    "stage_input": Query(stage_input, INPUT),
    "final_output": Query(final_output, FINAL),
    "first_of_category": Query(first_of_category, FIRST),
    "dashboard_metrics": Query(dashboard_metrics, DASHBOARD),
    "batch_tally": Query(batch_tally, TALLY),
    "build_tally": Query(build_tally, BUILD),
    "build_failures": Query(build_failures, FAILURES),
    "stage_run": Query(stage_run, RUN),
    "reindex_upsert": Query(reindex_upsert, REINDEX),
    "migrate_layout": Query(migrate_layout, MIGRATE),
}

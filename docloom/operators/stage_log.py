"""The stage log: what ran on which document, and everything that follows from it.

The log is a table (document_id, category, stage, status, ts, cost, input_hash, output, manually_edited, seq); states are aggregates over it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.fixed_values import STAGES
from docloom.functions.text import short_hash


def stage_order(stage: Column, stages: list[str] = STAGES) -> Column:
    """Place of a stage from 0; null for an unknown one."""
    out = F.lit(None).cast("int")
    for k, name in enumerate(stages):
        out = F.when(stage == name, k).otherwise(out)
    return out


def merged_maps(rows: DataFrame, by: list[str], column: str, order: list[str]) -> DataFrame:
    """(by, column): the maps of a group merged in order, so that each name has its last value; groups without entries have none.

    Entries are aggregated by name, partly before the shuffle, so a group with very many rows costs by its different names.
    """
    entries = rows.select(*by, *order, F.explode(column).alias("name", "value"))
    last = entries.groupBy(*by, "name").agg(F.max_by(F.struct("value"), F.struct(*order)).alias("v"))
    return last.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", F.col("v.value").alias("value"))))).alias(column))


def current_state(log: DataFrame, key: str = "document_id") -> DataFrame:
    """The state of each document and stage: last status, time and cost; last output and hash that aren't empty; where the log has maps ``metadata``, these merged."""
    given = lambda c: F.max_by(c, F.when((F.col(c).isNotNull()) & (F.col(c) != ""), F.struct("ts", "seq")))
    last = lambda c: F.max_by(c, F.struct("ts", "seq"))
    state = log.groupBy(key, "stage").agg(last("status").alias("status"), F.max("ts").alias("ts"), last("cost").alias("cost"), given("input_hash").alias("input_hash"), given("output").alias("output"), last("manually_edited").alias("manually_edited"))
    if "metadata" not in log.columns:
        return state
    merged = merged_maps(log, [key, "stage"], "metadata", ["ts", "seq"])
    same = (F.col(f"s.{key}").eqNullSafe(F.col(f"m.{key}"))) & (F.col("s.stage").eqNullSafe(F.col("m.stage")))
    return state.alias("s").join(merged.alias("m"), same, "left").select("s.*", "m.metadata")


def document_state(log: DataFrame, key: str = "document_id") -> DataFrame:
    """(key, current_stage, final_output): the stage that was completed last, and the last output that a completed stage gave."""
    done = F.col("status") == "completed"
    order = F.struct("ts", "seq")
    out = F.max_by("output", F.when(done & (F.coalesce("output", F.lit("")) != ""), order))
    return log.groupBy(key).agg(F.max_by("stage", F.when(done, order)).alias("current_stage"), out.alias("final_output"))


def skip_decision(status: Column, locked: Column, same_input: Column, force: Column) -> Column:
    """``run_*`` or ``skip_*`` with its reason."""
    return (
        F.when(force, "run_forced")
        .when(F.coalesce(status, F.lit("pending")) != "completed", "run_not_completed")
        .when(F.coalesce(locked, F.lit(False)), "skip_locked_manual_edit")
        .when(~F.coalesce(same_input, F.lit(False)), "run_input_changed")
        .otherwise("skip_unchanged")
    )


def plan_stage(docs: DataFrame, state: DataFrame, stage: str, force: bool = False, key: str = "document_id", text: str = "text") -> DataFrame:
    """Documents with the decision for a stage, from their text's hash and the state of the stage."""
    own = state.where(F.col("stage") == stage).select(F.col(key).alias("__k"), "status", "manually_edited", F.col("input_hash").alias("__old"))
    hashed = docs.withColumn("input_hash", short_hash(F.col(text)))
    joined = hashed.join(own, hashed[key] == own["__k"], "left")
    return joined.withColumn("decision", skip_decision(F.col("status"), F.col("manually_edited"), F.col("input_hash") == F.col("__old"), F.lit(force))).drop("__k", "__old")


def run_stage(planned: DataFrame, result: Column, stage: str, cost: float, now: Column, key: str = "document_id") -> DataFrame:
    """Log rows of a stage that ran on what was planned to run: failed where the result is null or empty, else completed."""
    ok = F.coalesce(result, F.lit("")) != ""
    return planned.where(F.startswith("decision", F.lit("run_"))).select(
        key, F.lit(stage).alias("stage"), F.when(ok, "completed").otherwise("failed").alias("status"), now.alias("ts"), F.when(ok, F.lit(cost)).otherwise(F.lit(0.0)).alias("cost"), "input_hash", result.alias("output"),
        F.when(~ok, "empty result").alias("error"),
    )


def stage_input(state: DataFrame, stage: str, stages: list[str] = STAGES, key: str = "document_id") -> DataFrame:
    """For each document the output of the last completed stage before ``stage``."""
    at = stages.index(stage)
    order = stage_order(F.col("stage"), stages)
    return state.where((F.col("status") == "completed") & (order < at)).groupBy(key).agg(F.max_by("output", order).alias("input"), F.max_by("stage", order).alias("input_stage"))


def stage_range(first: str, last: str, stages: list[str] = STAGES) -> list[str]:
    """Stages from ``first`` to ``last``, both included."""
    a, b = stages.index(first), stages.index(last)
    if a > b:
        raise ValueError(f"{first} comes after {last}")
    return stages[a : b + 1]


def status_line(state: DataFrame, stages: list[str], key: str = "document_id") -> DataFrame:
    """One row for each document: total cost and ``[x] parse -> [ ] clean ...``."""
    done = [F.max(F.when((F.col("stage") == s) & (F.col("status") == "completed"), 1).otherwise(0)) for s in stages]
    marks = [F.concat(F.when(d == 1, "[x] ").otherwise("[ ] "), F.lit(s)) for d, s in zip(done, stages)]
    return state.groupBy(key).agg(F.sum("cost").alias("total_cost"), F.concat_ws(" -> ", *marks).alias("status_line"))


def final_output(state: DataFrame, key: str = "document_id") -> DataFrame:
    """The flattened text if there is one, else the fixed one."""
    of = lambda s: F.max(F.when(F.col("stage") == s, F.col("output")))
    return state.groupBy(key).agg(F.coalesce(of("flatten-table"), of("fix-markdown")).alias("final_output"))


def first_of_each(docs: DataFrame, n: int = 5, group: str = "category", key: str = "document_id") -> DataFrame:
    return docs.withColumn("n", F.row_number().over(Window.partitionBy(group).orderBy(key))).where(F.col("n") <= n)


def dashboard(docs: DataFrame) -> DataFrame:
    """One row: documents, their cost and chunks, and categories."""
    return docs.agg(F.count("*").alias("documents"), F.sum("cost").alias("cost"), F.sum("chunks").alias("chunks"), F.count_distinct("category").alias("categories"))


def tally(results: DataFrame, *by: str) -> DataFrame:
    return results.groupBy(*by, "status").agg(F.count("*").alias("n"))


def build_tally(results: DataFrame, group: str = "category") -> DataFrame:
    """By category: indexed (skipped count too), failed, and whether all went well."""
    failed = F.col("status") == "failed"
    return results.groupBy(group).agg(F.count_if(F.col("status").isin("completed", "skipped")).alias("indexed"), F.count_if(failed).alias("failed"), (F.count_if(failed) == 0).alias("success"))


def build_failures(results: DataFrame, group: str = "category") -> DataFrame:
    """A row for each document that failed, with its error."""
    return results.where(F.col("status") == "failed").select(group, "document_id", "error")


def replace_documents(index: DataFrame, new: DataFrame, key: str = "document_id") -> DataFrame:
    """The index with all rows of the new documents replaced."""
    return index.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def migrate(flat: DataFrame, existing: DataFrame, stages: list[str], now: Column, key: str = "document_id") -> DataFrame:
    """Log rows that give documents of the old layout a completed history; those that already have one are left out."""
    fresh = flat.join(existing.select(key).distinct(), key, "left_anti")
    return fresh.select(key, F.explode(F.array(*map(F.lit, stages))).alias("stage"), F.lit("completed").alias("status"), now.alias("ts"), F.lit(0.0).alias("cost"))

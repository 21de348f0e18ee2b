"""Evaluation sets: filters, counts, stratified samples, unions, mean scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def whitelist(df: DataFrame, column: str, values: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose value is listed; and one row of kept and dropped counts."""
    hit = F.coalesce(F.col(column).isin(values), F.lit(False))
    return df.where(hit), df.agg(F.count_if(hit).alias("kept"), F.count_if(~hit).alias("dropped"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Values by how often they occur, most first; equal counts by value."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(column))


def as_items(df: DataFrame, index: Column, question: str, answer: str, yes_no: str, extractive: str, article: str, document: str) -> DataFrame:
    """Test items of sheet rows: id from the row's index, question, ground truth, metadata."""
    kind = F.when(F.col(yes_no).isNotNull(), "yes_no").otherwise("open")
    meta = F.struct(F.col(article).alias("article"), F.col(document).alias("document"), kind.alias("question_type"), F.col(extractive).alias("extractive_answer"))
    return df.select(F.format_string("reg_%04d", index.cast("int")).alias("id"), F.col(question).alias("question"), F.col(answer).alias("ground_truth"), meta.alias("metadata"))


def draw(key: Column, seed: int) -> Column:
    """A fixed pseudo-random order of keys that any engine can repeat."""
    return F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed))))


def stratified_sample(df: DataFrame, stratum: str, key: str, n: int = 200, most: int = 5, seed: int = 42) -> DataFrame:
    """n rows: up to min(most, n / strata) of each stratum, then others at random; fewer strata rows if those are too many.

    The quotas need the number of strata only. Picks of a stratum are ranked within it, so no stratum is gathered on the driver; the last cut is a
    top-n, which Spark does by partial tops.
    """
    strata = df.select(stratum).distinct().agg(F.count("*").alias("strata"))
    ranked = df.withColumn("__draw", draw(F.col(key), seed)).withColumn("__n", F.row_number().over(Window.partitionBy(stratum).orderBy("__draw", key)))
    quota = F.least(F.lit(most), F.greatest(F.lit(1), F.floor(F.lit(n) / F.col("strata"))))
    picked = ranked.crossJoin(F.broadcast(strata)).withColumn("__first", (F.col("__n") > quota).cast("int"))
    return picked.orderBy("__first", "__draw", key).limit(n).drop("__draw", "__n", "__first", "strata")


def union_files(parts: dict[str, DataFrame]) -> DataFrame:
    """Item files by name in one table, with their file."""
    return reduce(DataFrame.unionByName, [df.withColumn("file", F.lit(name)) for name, df in sorted(parts.items())])


def join_answers(items: DataFrame, answers: DataFrame, index: str = "index") -> DataFrame:
    """Items with answers by index; a missing answer is empty."""
    return items.join(answers, index, "left").withColumn("answer", F.coalesce("answer", F.lit("")))


def metric_means(scores: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, mean) over items; missing scores count as 0, and so does the mean of no items."""
    pairs = ", ".join(f"'{m}', coalesce(cast({m} as double), 0.0)" for m in metrics)
    long = scores.selectExpr(f"stack({len(metrics)}, {pairs}) as (metric, score)")
    names = scores.sparkSession.createDataFrame([(m,) for m in metrics], "metric string")
    return names.join(long.groupBy("metric").agg(F.avg("score").alias("mean")), "metric", "left").select("metric", F.coalesce("mean", F.lit(0.0)).alias("mean"))


def token_f1(answer: Column, truth: Column) -> Column:
    """Offline proxy for answer correctness: F1 of the different words of both."""
    a, t = (F.array_distinct(F.filter(F.split(F.lower(x), r"(?U)[^\p{L}\p{N}]+"), lambda w: w != "")) for x in (answer, truth))
    both = F.size(F.array_intersect(a, t))
    return F.when(F.size(a) + F.size(t) > 0, 2.0 * both / (F.size(a) + F.size(t))).otherwise(0.0)


def evaluation_json(scores: DataFrame, means: DataFrame, timestamp: str, endpoint: str) -> DataFrame:
    """The result document as one JSON value: metadata, average scores; items stay a table of their own."""
    averages = means.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "mean")))).alias("average_scores"))
    size = scores.agg(F.count("*").alias("test_set_size"))
    meta = F.struct(F.lit(timestamp).alias("timestamp"), "test_set_size", F.lit(endpoint).alias("api_endpoint"))
    return averages.crossJoin(size).select(F.to_json(F.struct(meta.alias("metadata"), "average_scores")).alias("value"))

"""Sinks: stage artifacts, chunk files, rejected documents, idempotent indexes, crawled pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.quality import rejection, stats
from docloom.functions.urls import folder_name


def write_artifact(df: DataFrame, path: str, *partition: str) -> None:
    """Overwrite the partitions that ``df`` has, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)


def write_chunks(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def split_rejected(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Accepted rows; and rejected ones with their reason and figures."""
    judged = docs.withColumn("rejection_reason", rejection(F.col(text)))
    rejected = judged.where(F.col("rejection_reason").isNotNull())
    return judged.where(F.col("rejection_reason").isNull()).drop("rejection_reason"), rejected.withColumn("stats", stats(F.col(text))).select("*", "stats.*").drop("stats", "is_useful")


def upsert_index(new: DataFrame, path: str, key: str = "document_id") -> None:
    """Replace all rows of the new documents in a Parquet index, by partitions of the key's hash.

    Only the partitions that the new documents fall into are read and written again.
    """
    spark: SparkSession = new.sparkSession
    keyed = new.withColumn("part", F.pmod(F.xxhash64(key), F.lit(64)).cast("int"))
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        from docloom.plans.stored import stored

        touched = keyed.select("part").distinct()
        old = spark.read.parquet(path).join(F.broadcast(touched), "part", "left_semi").join(new.select(key).distinct(), key, "left_anti")
        keyed = stored(old.unionByName(keyed), "index")  # the files read are those to be replaced
    write_artifact(keyed, path, "part")


def insert_many(table: DataFrame, rows: DataFrame, now: Column) -> DataFrame:
    """Rows added with one time of creation; no rows, no change."""
    return table.unionByName(rows.withColumn("created_at", now))


def crawled_pages(pages: DataFrame, now: Column) -> DataFrame:
    """Pages with their folder and the metadata that is saved with them."""
    return pages.select(folder_name(F.col("url")).alias("folder"), "text", F.struct(F.col("url").alias("original_url"), "title", now.alias("crawled_at")).alias("metadata"))


def clear(df: DataFrame) -> DataFrame:
    return df.limit(0)


def flat_metadata(df: DataFrame, nested: str = "json") -> DataFrame:
    """Columns as an index takes them: texts, numbers and booleans stay, arrays are joined by commas, others are as they print.

    Structs and maps become JSON; ``nested="drop"`` leaves them out.
    """
    out = []
    for field in df.schema:
        kind, c = field.dataType, F.col(f"`{field.name}`")
        if isinstance(kind, (T.StringType, T.NumericType, T.BooleanType)):
            out.append(c)
        elif isinstance(kind, T.ArrayType):
            out.append(F.array_join(F.transform(c, lambda x: x.cast("string")), ", ").alias(field.name))
        elif not isinstance(kind, (T.StructType, T.MapType)):
            out.append(c.cast("string").alias(field.name))
        elif nested == "json":
            out.append(F.to_json(c).alias(field.name))
    return df.select(*out)

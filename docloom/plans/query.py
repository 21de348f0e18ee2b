"""What a query of the catalogue is."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


#: Tables of long texts, whose few rows cost most.
WIDE = ("documents", "pages")


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores if its files have fewer parts than there are cores, as one small file would keep all but one idle.

    What is dealt is bounded by the cores times the size of a file part; tables of more parts are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Rows of an Arrow batch, so that a Python worker holds few texts whatever the table's size.
BATCH_ROWS = 512


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; the session's Arrow batches are bounded once a table of long texts is read, and stay so."""
    if name in WIDE:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in WIDE else df

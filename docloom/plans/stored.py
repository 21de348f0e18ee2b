"""Tables written to the cluster's shared folder, used to cut lineage."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_local_default: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Only a ``local`` master, whose one machine is the driver's, may leave it unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    if not _local_default:
        _local_default.append(tempfile.mkdtemp(prefix="docloom-"))
    return "file://" + _local_default[0]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/docloom/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return a DataFrame that reads it back.

    Later stages then restart from the written files when an executor is lost.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(*tables: DataFrame) -> None:
    """Delete the files of tables made by :func:`stored` once nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        jvm = spark.sparkContext._jvm
        for folder in folders:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Have Spark's cleaner delete the shuffle files of finished writes, which it does when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Estimated bytes of a table that may be broadcast.
BROADCAST_BYTES = 4 << 20
_WIDTHS = {T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8, T.FloatType: 4, T.DoubleType: 8, T.BooleanType: 1, T.DateType: 4, T.TimestampType: 8}


def small(df: DataFrame) -> bool:
    """Whether a table is small enough to be broadcast: its rows times their width, other columns than numbers taken as 64 bytes, and 8 a row.

    The table is counted, so it should be a stored one, whose count is read from the files' footers.
    """
    width = 8 + sum(_WIDTHS.get(type(f.dataType), 64) for f in df.schema)
    return df.count() * width <= BROADCAST_BYTES


def sized(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if it is :func:`small`; beyond that Spark joins it by a shuffle."""
    return F.broadcast(df) if small(df) else df

"""Bounded samples for training, the same however a table is partitioned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 1 << 30


def least_hashes(df: DataFrame, most: int, order: Column, key: str) -> DataFrame:
    """The ``most`` rows whose ``order`` (a hash) is least.

    Hashes far beyond the bound are filtered out first by their share of all rows, so what tasks send on for the last sort doesn't grow with
    their number.
    """
    total = df.count()
    if total > 4 * most:
        df = df.where(F.pmod(order, F.lit(SCALE)) < int(2 * most / total * SCALE) + 1)
    return df.orderBy(F.pmod(order, F.lit(SCALE)), key).limit(most)

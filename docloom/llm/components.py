"""Connected components of links in a table, by alternating star operations.

Each round points every node's larger neighbours, then its smaller ones, at the smallest of its neighbourhood. Nodes
and links stay in tables; a node's smallest neighbour is an aggregate, so a node with very many links is
pre-aggregated, and its links are joined to it by a skew join that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.plans.stored import drop_stored, stored


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _star(pairs: DataFrame, larger: bool) -> DataFrame:
    """``pairs`` (u, v): u's neighbours v. Links from those larger (or smaller) than u, and u, to the least of them all."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("of"), F.least("u", "m").alias("m"))
    joined = pairs.join(least, pairs.u == least.of)
    if larger:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("of").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: long); the root is the smallest node reachable.

    Links may repeat, point either way or join a node to itself; a node whose links are all to itself is not
    returned. Nulls are ignored.
    """
    now = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    state = _state(now)
    for _ in range(max_rounds):
        if not state[0]:
            break
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _star(both, True)
        small = _star(large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), False)
        new = stored(small, "links")
        drop_stored(now)
        now, before, state = new, state, _state(new)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    root = now.groupBy("b").agg(F.count("*").alias("n")).select(F.col("b").alias("node"), F.col("b").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(root)

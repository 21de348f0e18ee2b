"""Best-first crawling over a table of links: a frontier table from which the best pages are taken in batches, under a page budget."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.urls import netloc
from docloom.plans.stored import drop_stored, new_path, sized, stored

VISITED = "url string, depth int, priority double, seq int, fetched boolean"


def in_domains(*domains: str) -> Callable[[Column], Column]:
    """Whether a URL's host is one of ``domains`` or under one."""

    def test(url: Column) -> Column:
        host = F.lower(F.regexp_replace(netloc(url), r":\d+$", ""))
        return host.isin(*domains) | F.coalesce(F.array_max(F.array(*[F.endswith(host, F.lit("." + d)) for d in domains])), F.lit(False))

    return test


def crawl_best_first(
    seeds: DataFrame, links: DataFrame, score: Callable[[Column], Column], depth: int = 3, most: int = 100, batch: int = 10, allowed: Callable[[Column], Column] | None = None, keep: Callable[[Column], Column] | None = None, pages: DataFrame | None = None
) -> DataFrame:
    """Pages taken from ``seeds`` (url) on, in their order: url, depth, priority, seq, fetched, kept.

    Each step takes the ``batch`` best of the frontier (by ``score``, then less depth, then the URL), and puts the links of those under
    ``depth`` (url, href) that are ``allowed`` and weren't taken before into it. It ends after ``most`` fetched pages, or with the frontier. Where ``pages`` (url)
    are given, a URL that isn't one of them is taken, but not fetched: it doesn't count and has no links. ``kept`` says which fetched pages pass ``keep``.
    Null URLs are left out. The driver holds one batch; frontier and visited pages are tables, and a step's links are read by value from a table in order of URL.
    """
    spark = seeds.sparkSession
    allowed, keep = allowed or (lambda _: F.lit(True)), keep or (lambda _: F.lit(True))
    rated = lambda df: df.withColumn("priority", score(F.col("url")).cast("double"))
    known = links.select("url", F.col("href").alias("to")).where(F.col("url").isNotNull() & F.col("to").isNotNull() & allowed(F.col("to"))).distinct()
    known = stored(known.repartitionByRange("url").sortWithinPartitions("url"), "links")
    frontier = stored(rated(seeds.select("url").where("url is not null").distinct().withColumn("depth", F.lit(0))), "frontier")
    path = new_path(spark, "visited")
    spark.createDataFrame([], VISITED).write.parquet(path)
    visited = lambda: spark.read.schema(VISITED).parquet(path)
    taken = fetched = 0
    while fetched < most:
        popped = frontier.orderBy(F.desc("priority"), "depth", "url").limit(min(batch, most - fetched)).collect()
        if not popped:
            break
        urls = [r.url for r in popped]
        there = set(urls) if pages is None else {r.url for r in pages.where(F.col("url").isin(urls)).select("url").distinct().collect()}
        rows = [(r.url, r.depth, r.priority, taken + k, r.url in there) for k, r in enumerate(popped)]
        spark.createDataFrame(rows, VISITED).coalesce(1).write.mode("append").parquet(path)
        taken, fetched = taken + len(rows), fetched + len(there)
        parents = [(r.url, r.depth + 1) for r in popped if r.url in there and r.depth < depth]
        rest = frontier.where(~F.col("url").isin(urls)).select("url", "depth")
        if parents:
            of = spark.createDataFrame(parents, "url string, depth int")
            found = known.where(F.col("url").isin([u for u, _ in parents])).join(F.broadcast(of), "url").select(F.col("to").alias("url"), "depth")  # a batch at most
            rest = rest.unionAll(found.join(sized(visited().select("url")), "url", "left_anti")).groupBy("url").agg(F.min("depth").alias("depth"))
        frontier, before = stored(rated(rest), "frontier"), frontier
        drop_stored(before)
    drop_stored(frontier, known)
    return visited().withColumn("kept", F.col("fetched") & F.coalesce(keep(F.col("url")), F.lit(False)))

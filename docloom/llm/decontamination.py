"""Benchmark decontamination: a prefix-filtered set join of item windows with document words.

Each window of an item's words is known by its rarest shingle: as containment has to be whole, this one shingle is
its necessary prefix. Shingles are ordered by their counts over all documents. A document's shingle that meets a
prefix gives a candidate, which the positional and length bounds and then the words themselves must bear out.
DataFrame operations only; documents are scanned, never shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.plans.stored import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHINGLE = 3
#: An index part of at most so many windows is broadcast (some 400 bytes each); a larger index takes more scans.
PART_WINDOWS = 100_000


def words(text: Column) -> Column:
    """Lower-cased (A-Z) words of a text; none for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS), "")


def _shingle(array: str, at: Column, size: int) -> Column:
    return F.xxhash64(F.lit(size), *[F.get(array, at + k) for k in range(size)])


def item_windows(items: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (window_id, words, size), and which items have them (window_id, item_id)."""
    listed = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    size = F.least(F.lit(window), F.size("w"))
    cut = listed.select("item_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda k: F.slice("w", k, size))).alias("words"))
    named = cut.select("item_id", F.md5(F.array_join("words", " ")).alias("window_id"), "words", F.size("words").alias("size"))
    return named.select("window_id", "words", "size").distinct(), named.select("window_id", "item_id").distinct()


def _at_shingles(docs: DataFrame, size: int, *keep: str) -> DataFrame:
    """A row for each shingle of each document's words: its place and hash."""
    return docs.select(*keep, "w", F.posexplode("w").alias("pos", "word")).select(*keep, "w", "pos", _shingle("w", F.col("pos"), size).alias("token"))


def contaminated_words(
    docs: DataFrame, items: DataFrame, window: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", part_windows: int = PART_WINDOWS
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, version, n_words, n_hit, n_items, items (sorted ids as strings, comma-joined).

    ``version`` is the hash that tells texts of one doc_id apart. ``n_hit`` counts the words that lie in an occurrence of an item window: ``window`` words in a row, or all words
    of a shorter item. Null and empty texts have no words and no hits; an item without words has no windows. Equal
    items all count. Repeated rows each get a row with the same figures. Null ids are kept. With no items nothing
    is hit. Columns of other names are not read.
    """
    bench = items.select(F.col(item_id).cast("string").alias("item_id"), F.col(item_text).alias("text"))
    windows, owners = (stored(x, "windows") for x in item_windows(bench, window))
    whole = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    read = whole.select("doc_id", F.xxhash64("text").alias("version"), words(F.col("text")).alias("w"))

    total = windows.count()
    parts = max(1, -(-total // part_windows))
    sizes = [r.size for r in windows.select(F.least("size", F.lit(SHINGLE)).alias("size")).distinct().collect()]  # SHINGLE values at most
    found = []
    for part in range(parts):
        own = windows.where(F.pmod(F.xxhash64("window_id"), F.lit(parts)) == part)
        for size in sizes:
            mine = own.where(F.least("size", F.lit(SHINGLE)) == size)
            places = mine.select("window_id", "words", "size", F.explode(F.sequence(F.lit(0), F.col("size") - size)).alias("off")).withColumn("token", _shingle("words", F.col("off"), size))
            # Rarity over all documents of the shingles that any window has. The broadcast side is bounded by part_windows.
            known = places.select("token").distinct()
            counts = _at_shingles(read, size).select("token").join(F.broadcast(known), "token").groupBy("token").agg(F.count("*").alias("often"))
            rarest = Window.partitionBy("window_id").orderBy(F.coalesce("often", F.lit(0)), "token", "off")
            prefix = places.join(counts, "token", "left").withColumn("rank", F.row_number().over(rarest)).where("rank = 1").select("token", "window_id", "words", "size", "off")
            start = F.col("pos") - F.col("off")
            found.append(
                _at_shingles(read, size, "doc_id", "version")
                .join(F.broadcast(prefix), "token")
                .where((start >= 0) & (start + F.col("size") <= F.size("w")))
                .where(F.slice("w", start + 1, F.col("size")) == F.col("words"))
                .select("doc_id", "version", start.alias("start"), (start + F.col("size")).alias("end"), "window_id")
            )
    figures = read.select("doc_id", "version", F.size("w").cast("long").alias("n_words"))
    if not found:
        return figures.select("doc_id", "version", "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.lit("").alias("items"))
    hits = stored(reduce(DataFrame.unionAll, found).distinct(), "hits")

    # Places come in order of their start: each adds what lies beyond the furthest end so far.
    spans = F.array_sort(F.collect_set(F.struct("start", "end")))
    merged = F.aggregate(
        spans,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to")),
        lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["to"]))).cast("long").alias("n"), F.greatest(a["to"], s["end"]).alias("to")),
        lambda a: a["n"],
    )
    n_hit = hits.groupBy("doc_id", "version").agg(merged.alias("n_hit"))
    ids = F.array_sort(F.collect_set("item_id"))
    owned = hits.select("doc_id", "version", "window_id").distinct().join(owners, "window_id").groupBy("doc_id", "version").agg(F.size(ids).cast("long").alias("n_items"), F.array_join(ids, ",").alias("items"))
    out = figures.alias("f")
    for name, side in (("h", n_hit.alias("h")), ("o", owned.alias("o"))):
        out = out.join(side, F.col("f.doc_id").eqNullSafe(F.col(f"{name}.doc_id")) & (F.col("f.version") == F.col(f"{name}.version")), "left")
    return out.select(
        "f.doc_id", "f.version", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items", F.lit("")).alias("items")
    )

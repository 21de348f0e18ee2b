"""Best-fit packing of documents into as few token sequences as can be found, by a grouping genetic algorithm on islands.

Only documents longer than the capacity are cut. What has to be packed is the histogram of the lengths under the capacity, of at most ``capacity``
rows whatever the corpus holds. Islands are groups of a Spark table of solutions: each round evolves every island in a task of its own, writes the
solutions, and sends each island's best to the next one. Bins of the best solution are then joined back to the pieces by rank.
"""

from __future__ import annotations

import json
import random
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm import grouping
from docloom.llm.grouping import Groups, Setting
from docloom.plans.stored import drop_stored, sized, stored

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
SOLUTIONS = "island int, bins long, spread double, groups string"
SLOTS = "length long, first long, number long, packs long, base long, at long"


def _pieces(tokenizer: str, capacity: int, end: int):
    mark = end.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from docloom.llm.bpe import encoder

        ids_of = encoder(tokenizer).ids
        for b in batches:
            rows: list[list[int]] = [[], [], [], [], []]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = ids_of(text.as_py() or "") + mark
                total = len(ids) // 4
                cuts = [0, *range(total % capacity or capacity, total, capacity), total]
                for k, (start, stop) in enumerate(zip(cuts, cuts[1:])):
                    for column, value in zip(rows, (doc, k, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop]))):
                        column.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array(x, t) for x, t in zip(rows, kinds)], names=[x.split()[0] for x in PIECES.split(", ")])

    return run


def _written(groups: Groups) -> str:
    return json.dumps([[kind, bins] for kind, bins in sorted(groups.items())])


def _read(groups: str) -> Groups:
    return {tuple(map(tuple, kind)): bins for kind, bins in json.loads(groups)}


def _island(histogram: dict[int, int], capacity: int, setting: Setting, step: int):
    def run(key: tuple, members: pd.DataFrame) -> pd.DataFrame:
        rng = random.Random(1_000_003 * step + int(key[0]))
        known = sorted({g for g in members["groups"] if g})  # the order of rows in a group isn't fixed
        found = grouping.evolve(histogram, [_read(g) for g in known], capacity, setting, rng)
        rated = [grouping.fitness(g, capacity) for g in found]
        return pd.DataFrame({"island": key[0], "bins": [b for b, _ in rated], "spread": [s for _, s in rated], "groups": [_written(g) for g in found]})

    return run


def pack_on_islands(spark: SparkSession, histogram: dict[int, int], capacity: int, setting: Setting = Setting()) -> Groups:
    """The best solution of all islands after the last round, or after the first that has the least bins possible.

    Between rounds the best of each island also goes to the next island. The random choices hang on island and round only.
    """
    if not histogram:
        return {}
    islands = spark.range(setting.islands, numPartitions=setting.islands).selectExpr("cast(id as int) island", "0L bins", "0D spread", "'' groups")
    least, held = grouping.least_bins(histogram, capacity), []
    for step in range(setting.rounds):
        # By ranges each island gets a task, which Spark doesn't put together with others however small they are.
        evolved = islands.repartitionByRange(setting.islands, "island").groupBy("island").applyInPandas(_island(histogram, capacity, setting, step), SOLUTIONS)
        islands = stored(evolved, "islands")
        drop_stored(*held)
        held = [islands]
        ranked = islands.withColumn("place", F.row_number().over(Window.partitionBy("island").orderBy("bins", "spread", "groups")))
        best = ranked.where("place = 1").orderBy("bins", "spread", "groups").first()
        if best.bins <= least:
            break
        elite = ranked.where("place = 1").drop("place").withColumn("island", ((F.col("island") + 1) % setting.islands).cast("int"))
        islands = islands.unionByName(elite)
    drop_stored(*held)
    return _read(best.groups)


def _slots(groups: Groups) -> list[tuple[int, int, int, int, int, int]]:
    """A row for each run of a kind: its length, first rank, number of pieces, bins, first bin, offset of its first copy."""
    rank: dict[int, int] = {}
    rows, base = [], 0
    for kind, bins in sorted(groups.items()):
        at = 0
        for length, copies in kind:
            first = rank.get(length, 0)
            rows.append((length, first, copies * bins, bins, base, at))
            rank[length] = first + copies * bins
            at += copies * length
        base += bins
    return rows


def pack_best_fit(docs: DataFrame, tokenizer: str, capacity: int = 1024, end: int = 2, setting: Setting = Setting(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Each document is its ids and then ``end``, so a null or empty text makes one piece of one token. A document over the capacity is cut into
    pieces of the capacity, the first of which may be shorter. Repeated rows are packed as often as they occur; null ids pass through. Sequences with a
    whole piece of the capacity have negative numbers, all others go from 0 without gaps. An empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    cut = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_pieces(tokenizer, capacity, end), PIECES)
    # A number for each piece, written down with it: its high bits name the task that wrote it.
    pieces = stored(cut.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    short = pieces.where(F.col("length") < capacity)
    histogram = {r.length: r.n for r in short.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    slots = spark.createDataFrame(_slots(pack_on_islands(spark, histogram, capacity, setting)), SLOTS)
    # Pieces of a length are ranked within the task that wrote them, and shifted by the counts of the tasks before.
    salted = short.withColumn("salt", F.shiftright("uid", 33))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shift = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    own = Window.partitionBy("length", "salt").orderBy("uid")
    ranked = salted.withColumn("row", F.row_number().over(own) - 1).join(shift, ["length", "salt"]).withColumn("rank", F.col("row") + F.col("shift"))
    # A row of the slots for each run of each kind of bin: bounded by the capacity and the generations, not by the corpus.
    here = (F.col("p.length") == F.col("s.length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("number"))
    nth = F.col("rank") - F.col("first")
    columns = ["doc_id", "piece", "start", F.col("p.length").alias("length"), "ids_crc32"]
    placed = ranked.alias("p").join(sized(slots).alias("s"), here).select(
        *columns, (F.col("base") + nth % F.col("packs")).alias("sequence_id"), (F.col("at") + F.floor(nth / F.col("packs")) * F.col("p.length")).cast("long").alias("offset")
    )
    whole = pieces.alias("p").where(F.col("length") == capacity).select(*columns, (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionAll(whole)

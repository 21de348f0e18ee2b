"""Packing of documents into fixed-length token sequences: shortest-pack-first over the length histogram.

Documents are cut at multiples of the capacity. The pieces' lengths make a histogram of at most ``capacity`` rows,
whatever the corpus holds; only that goes to the driver. Lengths are placed longest first, each on the open
packing pattern with most room, and patterns carry counts instead of members. A piece then finds its pattern by
its rank among pieces of its length.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.plans.stored import stored

#: Parts in which pieces of one length are ranked; a constant, so that sequence ids are the same on any cluster.
SALTS = 1024
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
SLOTS = "length int, first long, packs long, base long, at int"


def _pieces(tokenizer: str, capacity: int):
    end = (0).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from docloom.llm.bpe import encoder

        ids_of = encoder(tokenizer).ids
        for b in batches:
            rows: list[list[int]] = [[], [], [], [], []]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = ids_of(text.as_py() or "") + end
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    piece = ids[4 * start : 4 * (start + capacity)]
                    for column, value in zip(rows, (doc, start, len(piece) // 4, zlib.crc32(piece), total)):
                        column.append(value)
            names = [x.split()[0] for x in PIECES.split(", ")]
            yield pa.record_batch([pa.array(x, pa.int64()) for x in rows], names=names)

    return run


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns of (length, copies) runs with the number of packs that follow each.

    Lengths go longest first. A length is put on the open pattern with the most room, on as many of its packs as
    it has pieces left; the rest of these packs stays open. Where none has room, new packs take as many copies of
    the length as fit.
    """
    open_: list[tuple[int, int, list[tuple[int, int]], int]] = []  # (-room, order, runs, packs)
    done: list[tuple[list[tuple[int, int]], int]] = []
    order = 0

    def keep(runs: list[tuple[int, int]], packs: int) -> None:
        nonlocal order
        room = capacity - sum(n * k for n, k in runs)
        if room:
            order += 1
            heapq.heappush(open_, (-room, order, runs, packs))
        else:
            done.append((runs, packs))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if open_ and -open_[0][0] >= length:
                room, _, runs, packs = heapq.heappop(open_)
                fit = -room // length
                if left >= packs:
                    copies = min(fit, left // packs)
                    keep([*runs, (length, copies)], packs)
                    left -= copies * packs
                else:
                    keep([*runs, (length, 1)], left)
                    keep(runs, packs - left)
                    left = 0
            else:
                fit = capacity // length
                if left >= fit:
                    keep([(length, fit)], left // fit)
                    left %= fit
                else:
                    keep([(length, left)], 1)
                    left = 0
    return done + [(runs, packs) for _, _, runs, packs in open_]


def _slots(patterns: list[tuple[list[tuple[int, int]], int]]) -> list[tuple[int, int, int, int, int]]:
    """A row for each run of a pattern: its length, its first rank, its packs, its first sequence, its offset."""
    rank: dict[int, int] = {}
    rows, base = [], 0
    for runs, packs in patterns:
        at = 0
        for length, copies in runs:
            for k in range(copies):
                first = rank.get(length, 0)
                rows.append((length, first, packs, base, at + k * length))
                rank[length] = first + packs
            at += copies * length
        base += packs
    return rows


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each document is its ids and then id 0, so a null or empty text makes one piece of one token. Repeated rows
    are packed as often as they occur. An empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    cut = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_pieces(tokenizer, capacity), PIECES)
    pieces = stored(cut, "pieces")
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    slots = spark.createDataFrame(_slots(pack_histogram(histogram, capacity)), SLOTS)

    # Ranks among pieces of a length: a length that many pieces share is spread over salts, which are ranked
    # by themselves and shifted by the counts of the salts before.
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(SALTS)).cast("int"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shift = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = salted.withColumn("row", F.row_number().over(own) - 1).join(shift, ["length", "salt"]).withColumn("rank", F.col("row") + F.col("shift"))
    # The slots' number is bounded by the capacity (lengths times runs), not by the corpus.
    placed = ranked.alias("p").join(
        F.broadcast(slots).alias("s"),
        (F.col("p.length") == F.col("s.length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("packs")),
    )
    return placed.select(
        "doc_id", "start", "p.length", "ids_crc32", "doc_tokens",
        (F.col("base") + F.col("rank") - F.col("first")).alias("sequence_id"),
        F.col("at").cast("long").alias("offset"),
    )

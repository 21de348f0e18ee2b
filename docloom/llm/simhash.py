"""SimHash near-duplicates: every link of fingerprints at three or fewer differing bits.

Fingerprints are computed per document; equal ones are one node from then on. Two fingerprints that differ in at
most three of five parts' bits agree in two whole parts, so ten keys of two parts bring all linked pairs together.
Within a key distances come from bit planes (:mod:`docloom.llm.bitslice`) and links only as spanning trees. A key that many
fingerprints share is cut into chunks, and pairs of chunks are compared in tasks of bounded size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.bitslice import lanes_within_three, spanning_links
from docloom.llm.components import connected_components
from docloom.plans.stored import stored

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+").findall
SHINGLE, SEED = 3, 42
#: Five parts of the 64 bits: (first bit, bits).
PARTS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]
#: Fingerprints of one key and chunk; a task compares two chunks at most.
CHUNK = 2048
#: Groups up to this size are compared pair by pair, over the lanes of many groups at once.
SMALL = 6


def fingerprint(text: str) -> int:
    """Majority bits of the XXH64 of all word shingles, repeats included. No words: zero."""
    import xxhash

    words = _WORDS(text.encode("utf-8", "surrogatepass").translate(_LOWER))
    if not words:
        return 0
    if len(words) <= SHINGLE:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        digest = xxhash.xxh64_intdigest
        hashes = [digest(b"%b %b %b" % x, SEED) for x in zip(words, words[1:], words[2:])]
    rows = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    votes = np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes), bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints = np.array([fingerprint(t.as_py() or "") for t in b.column(1)], np.uint64).view(np.int64)
        yield pa.record_batch([b.column(0), pa.array(prints, pa.int64())], names=["doc_id", "print"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within lists of fingerprints."""
    for b in batches:
        lists = b.column(0)
        flat = np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False)).view(np.uint64)
        sizes = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, int)
        ends = np.cumsum(sizes)
        a: list[np.ndarray] = []
        c: list[np.ndarray] = []
        small = np.repeat(sizes <= SMALL, sizes)
        group = np.repeat(np.arange(len(sizes)), sizes)
        for d in range(1, SMALL):
            lanes = np.flatnonzero((group[:-d] == group[d:]) & small[:-d]) if len(flat) > d else np.zeros(0, int)
            if len(lanes):
                near = lanes[lanes_within_three(flat[lanes] ^ flat[lanes + d])]
                a.append(flat[near])
                c.append(flat[near + d])
        for k in np.flatnonzero(sizes > SMALL):
            if links := spanning_links(flat[ends[k] - sizes[k] : ends[k]]):
                pairs = np.array(links, np.uint64)
                a.append(pairs[:, 0])
                c.append(pairs[:, 1])
        both = [np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64) for x in (a, c)]
        yield pa.record_batch([pa.array(x, pa.int64()) for x in both], names=["a", "b"])


def near_links(prints: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) among distinct fingerprints (print: long) that connect all those within three bits."""
    keys = []
    for t, (i, k) in enumerate(combinations(PARTS, 2)):
        part = [F.shiftrightunsigned("print", first).bitwiseAND(F.lit((1 << bits) - 1)) for first, bits in (i, k)]
        keys.append(F.shiftleft(part[0], k[1]).bitwiseOR(part[1]).bitwiseOR(F.lit(t << 40)))
    keyed = prints.select("print", F.explode(F.array(*keys)).alias("key"))
    crowded = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > chunk).select("key", F.ceil(F.col("n") / chunk).cast("int").alias("chunks"))
    own = F.pmod(F.xxhash64("print"), F.col("chunks").cast("long")).cast("int")
    # A member of chunk k goes to the pairs (k, 0) to (k, last), each named smaller first.
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("k")))
    cut = keyed.join(crowded, "key", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("own", own)
    dealt = cut.select("print", "key", F.explode(pairs).alias("pair"))
    lists = dealt.groupBy("key", "pair").agg(F.collect_list("print").alias("prints")).where(F.size("prints") > 1)
    return lists.select("prints").mapInArrow(_compare, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    ``component_id`` is the smallest doc_id reachable over links. Null and empty texts have fingerprint zero and are linked
    like any other. Repeated rows and equal texts share a component. A null doc_id is kept; a component of null ids only has
    a null component_id. An empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    prints = stored(rows.mapInArrow(_fingerprints, "doc_id long, print long"), "fingerprints")
    nodes = stored(prints.groupBy("print").agg(F.min("doc_id").alias("first")), "nodes")
    roots = stored(connected_components(near_links(nodes.select("print"))), "components")
    placed = nodes.join(roots, nodes.print == roots.node, "left").select("print", "first", F.coalesce("root", "print").alias("root"))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = placed.join(least, "root").select("print", "component_id")
    return prints.join(named, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")

"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

A SimHash radius that reaches this similarity (some 17 of 64 bits) can't be searched by parts of the fingerprint, so candidates
come from MinHash bands: two texts at 0.8 share one of the 40 keys of five minima but for 1.3 cases in ten million, more similar
ones more surely. A link counts only if the sets of shingle hashes bear it out.

Texts with equal sets are one node. In a key the nodes are first compared with one of them, the one that shares most keys, so a large
group of near copies takes as many comparisons as it has members. Keys that still join different components are compared whole, in
chunks of nodes, by the bits of their sets; only links that join components leave such a task, never all pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.components import connected_components
from docloom.plans.stored import drop_stored, free_shuffles, sized, stored

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+").findall
SHINGLE, SEED = 5, 42
BANDS, ROWS = 40, 5
#: Nodes of one key that are compared in a task at most twice; bytes of a task's matrix of sets.
CHUNK, MATRIX_BYTES = 256, 1 << 26
#: Shingles whose minima are taken at once.
BLOCK = 2048

_RANDOM = np.random.default_rng(SEED)
_FLIP = _RANDOM.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64, endpoint=False)
_TIMES = _RANDOM.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64, endpoint=False) | np.uint64(1)
_PLACE = _RANDOM.integers(0, 1 << 64, SHINGLE, np.uint64, endpoint=False) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; a shorter text is one shingle, one without words has none."""
    import xxhash

    words = _WORDS(text.encode("utf-8", "surrogatepass").translate(_LOWER))
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    hashes = np.array([digest(w, SEED) for w in words], np.uint64)
    n = len(hashes) - SHINGLE + 1
    total = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        total = _mix(total + hashes[k : k + n] * _PLACE[k])
    return np.unique(total)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key for each band; texts without words have none."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), BLOCK):
        least = np.minimum(least, ((hashes[at : at + BLOCK] ^ _FLIP) * _TIMES).min(axis=1))
    keys = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        keys = _mix(keys * np.uint64(0x9E3779B97F4A7C15) + row)
    return keys


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for b in batches:
        sets = [shingles(t.as_py() or "") for t in b.column(2)]
        nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
        keys = pa.array([band_keys(s).view(np.int64) for s in sets], pa.list_(pa.int64()))
        yield pa.record_batch([b.column(0), b.column(1), pa.array(nodes, pa.int64()), pa.array(map(len, sets), pa.int32()), keys], names=["doc_id", "version", "node", "n", "keys"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.record_batch([b.column(0), pa.array([shingles(t.as_py() or "").view(np.int64) for t in b.column(1)], pa.list_(pa.int64()))], names=["node", "s"])


_SAME = "d.version = o.version and d.doc_id <=> o.doc_id"


def _sets_of(wanted: DataFrame, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, s): the shingle hashes of the nodes of ``wanted``, made anew from one text of each."""
    named = stored(wanted.distinct().join(nodes, "node").select("node", "one.*"), "wanted")
    texts = rows.alias("d").join(sized(named).alias("o"), F.expr(_SAME)).select("node", "text").dropDuplicates(["node"])
    sets = stored(texts.mapInArrow(_sets, "node long, s array<long>"), "sets")
    drop_stored(named)
    return sets


def _alike(pairs: DataFrame, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar enough: 0.8 of the union is 4/9 of both sizes."""
    sets = _sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")), rows, nodes)
    first = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a")
    both = first.join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    links = stored(both.where(9 * F.size(F.array_intersect("sa", "sb")) >= 4 * (F.size("sa") + F.size("sb"))).select("a", "b"), "links")
    drop_stored(sets)
    return links


def _in_common(sets: list[np.ndarray], size: np.ndarray):
    """A function of i and several j to the number of elements that set i has in common with each."""
    values, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = times > 1  # others are in one set only
    column = np.cumsum(several) - 1
    width = int(several.sum())
    if len(sets) * width > 8 * MATRIX_BYTES:
        return lambda i, others: np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in others])
    marks = np.zeros((len(sets), -(-max(1, width) // 64) * 64), bool)
    row = np.repeat(np.arange(len(sets)), size)
    marks[row[several[place]], column[place[several[place]]]] = True
    bits = np.packbits(marks, axis=1).view(np.uint64)
    return lambda i, others: np.bitwise_count(bits[others] & bits[i]).sum(axis=1, dtype=np.int64)


def spanning_links(nodes: np.ndarray, roots: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join the nodes as all pairs of similar sets and the ``roots`` would, none within what is joined already."""
    size = np.array([len(x) for x in sets])
    common = _in_common(sets, size)
    label = np.unique(roots, return_inverse=True)[1]
    links = []
    for i in range(len(nodes) - 1):
        others = np.arange(i + 1, len(nodes))
        n = size[others]
        others = others[(label[others] != label[i]) & (5 * np.minimum(n, size[i]) >= 4 * np.maximum(n, size[i]))]
        if not len(others):
            continue
        for j in others[9 * common(i, others) >= 4 * (size[others] + size[i])].tolist():
            if label[j] != label[i]:
                links.append((int(nodes[i]), int(nodes[j])))
                label[label == label[j]] = label[i]
    return links


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within lists of (node, root, s)."""
    for b in batches:
        links = []
        for listed in b.column(0):
            flat = listed.values
            sets = flat.field(2)
            values, ends = sets.values.to_numpy(zero_copy_only=False), sets.offsets.to_numpy()
            links += spanning_links(flat.field(0).to_numpy(), flat.field(1).to_numpy(), [values[x:y] for x, y in zip(ends[:-1], ends[1:])])
        yield pa.record_batch([pa.array([x[k] for x in links], pa.int64()) for k in range(2)], names=["a", "b"])


def _dealt(shared: DataFrame, chunk: int) -> DataFrame:
    """(key, pair, node, root): a key of many nodes is cut into chunks, whose pairs are compared apart."""
    crowded = shared.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > chunk).select("key", F.ceil(F.col("n") / chunk).cast("int").alias("chunks"))
    own = F.pmod(F.xxhash64("node", F.lit(SEED)), F.col("chunks").cast("long")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("k")))
    cut = shared.join(crowded, "key", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("own", own)
    return cut.select("key", F.explode(pairs).alias("pair"), "node", "root")


def _comparable(n: Column, m: Column) -> Column:
    return 5 * F.least(n, m) >= 4 * F.greatest(n, m)


def near_links(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """(node, root) for the nodes of ``marks`` (doc_id, version, node, n, keys; equal nodes repeat) that are linked to others.

    ``rows`` (doc_id, version, text) has the texts.
    """
    spark = rows.sparkSession
    nodes = stored(marks.groupBy("node").agg(F.min(F.struct("doc_id", "version")).alias("one"), F.first("n").alias("n"), F.first("keys").alias("keys")), "nodes")
    keyed = nodes.select("node", "n", F.explode("keys").alias("key"))
    often = keyed.groupBy("key").agg(F.count("*").alias("nodes")).where("nodes > 1")
    shared = stored(keyed.join(often, "key"), "shared")
    free_shuffles(spark)
    # Most copies are closest to what they are copies of, which shares the most keys: it comes first.
    weight = shared.groupBy("node").agg(F.sum("nodes").alias("weight"))
    shared = stored(shared.drop("nodes").join(weight, "node"), "shared")
    hub = F.min(F.struct(-F.col("weight"), F.xxhash64("node"), "node", "n").alias("o"))
    first = shared.groupBy("key").agg(hub.alias("f")).select("key", F.col("f.node").alias("hub"), F.col("f.n").alias("hub_n"))
    pairs = shared.join(first, "key").where((F.col("node") != F.col("hub")) & _comparable(F.col("n"), F.col("hub_n")))
    pairs = stored(pairs.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct(), "pairs")
    links = _alike(pairs, rows, nodes)
    roots = stored(connected_components(links), "roots")
    drop_stored(pairs)
    free_shuffles(spark)

    now = shared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    keys = now.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("nodes")).where("low <> high and nodes > 2").select("key")
    before, shared = shared, stored(now.join(keys, "key").select("key", "node", "root"), "mixed")
    drop_stored(before)
    if shared.isEmpty():
        return roots
    sets = _sets_of(shared.select("node"), rows, nodes)
    lists = _dealt(shared, CHUNK).join(sets, "node").groupBy("key", "pair").agg(F.collect_list(F.struct("node", "root", "s")).alias("listed"))
    found = stored(lists.where(F.size("listed") > 1).select("listed").mapInArrow(_compare, "a long, b long"), "links")
    drop_stored(shared, sets)
    return stored(connected_components(links.unionAll(found)), "roots")


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, version, component.

    ``version`` is the hash that tells texts of one doc_id apart, ``component`` a number that rows have in common if links join
    them. Null and empty texts and those of white space are equal. Null ids are kept; an empty table gives an empty result.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("version"), F.col(text).cast("string").alias("text"))
    marks = stored(rows.mapInArrow(_marks, f"doc_id {kind}, version long, node long, n int, keys array<long>"), "marks")
    roots = near_links(rows, marks)
    placed = marks.select("doc_id", "version", "node").join(roots, "node", "left")
    return placed.select("doc_id", "version", F.coalesce("root", "node").alias("component"))

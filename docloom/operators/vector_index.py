"""An inverted file of vectors: cells around centroids, of which a search reads those that can hold one of its best rows.

Every vector belongs to the cell of its nearest centroid and keeps its distance from it; a cell knows the greatest of them, its radius.
By the triangle inequality a cell whose centroid is further from a query than the radius and the distance of the k-th best row found so far holds
none that is better, so results are exact: they are those of scoring all pairs. Centroids are fitted on a bounded sample, all vectors are indexed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.plans.stored import stored

#: Vectors that centroids are fitted on, at most; cells, at most.
FIT_ROWS, MOST_CELLS = 16_384, 1_024
#: Rows of a cell, and queries, that meet in one task; larger cells are cut, more queries come in blocks.
PART_ROWS, BLOCK_QUERIES = 4_096, 4_096
#: Scores are rounded to six places; so far below a bound rows may still round to it. Distances are trusted to that share.
MARGIN = 1e-6

PROBE = "cell int, away double, reach double"
HITS = "qid {qid}, chunk_id {chunk_id}, score_e6 long, scored long"


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _points(m: np.ndarray, metric: str) -> np.ndarray:
    """Where vectors lie so that a better score is a shorter distance: on the unit sphere for the cosine."""
    return m / np.linalg.norm(m, axis=1, keepdims=True) if metric == "cosine" else m


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0))


def _scores(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """As whole millionths, so that equal rounded scores are equal."""
    qq, xx = (q * q).sum(1)[:, None], (x * x).sum(1)
    s = q @ x.T / (np.sqrt(qq) * np.sqrt(xx)) if metric == "cosine" else np.exp(-(qq + xx - 2 * q @ x.T))
    return np.floor(s * 1e6 + 0.5).astype(np.int64)


def reach_of(score: float, metric: str) -> float:
    """The distance beyond which no row rounds to ``score`` or more."""
    least = score - MARGIN
    if metric == "cosine":
        return math.sqrt(max(0.0, 2 * (1 - least)))
    return math.sqrt(max(0.0, -math.log(least))) if least > 0 else math.inf


def usable(vectors: DataFrame, vector: str, metric: str) -> DataFrame:
    """Rows whose vector is there, without null, NaN or infinite entries, and not zero if its direction is what counts."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    kept = vectors.where(F.forall(vector, finite) & (F.size(vector) > 0))
    return kept.where(F.exists(vector, lambda x: x != 0)) if metric == "cosine" else kept


def fit_centroids(sample: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Centroids by Lloyd's rounds from evenly spread rows of the sample; empty ones stay where they were."""
    centroids = sample[np.linspace(0, len(sample) - 1, cells).astype(int)]
    for _ in range(rounds):
        own = _distances(sample, centroids).argmin(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        counts = np.bincount(own, minlength=len(centroids))
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
    return centroids


@dataclass(frozen=True)
class VectorIndex:
    """``rows`` (cell, part, chunk_id, embedding, away) stored by cell; the other fields are bounded by the cells."""

    rows: DataFrame
    centroids: np.ndarray
    radius: np.ndarray
    counts: np.ndarray
    metric: str


def _assign(centroids: np.ndarray, metric: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = _distances(_points(_matrix(b.column(1)), metric), centroids)
                cell = d.argmin(1)
                yield pa.record_batch([pa.array(cell, pa.int32()), b.column(0), b.column(1), pa.array(d[np.arange(len(d)), cell])], names=["cell", "chunk_id", "embedding", "away"])

    return run


def build_index(vectors: DataFrame, metric: str = "cosine", cells: int | None = None) -> VectorIndex:
    """Index all usable ``vectors`` (chunk_id, embedding), which have one length; about the root of their number of cells unless told otherwise.

    Cells of more than PART_ROWS rows, be they copies of one vector, are cut into parts by the hash of the id. Rows that :func:`usable` refuses have no score and
    are not indexed.
    """
    if metric not in ("cosine", "l2_exp"):
        raise ValueError(f"unknown metric {metric}")
    kept = usable(vectors.select("chunk_id", "embedding"), "embedding", metric)
    total = kept.count()
    cells = max(1, min(cells or math.isqrt(total), MOST_CELLS))
    least = F.pmod(F.xxhash64("chunk_id"), F.lit(1 << 30))
    few = kept.where(least < int(min(1.0, 2 * FIT_ROWS / max(total, 1)) * (1 << 30)) + 1).orderBy(least, "chunk_id").limit(FIT_ROWS).select("embedding").toArrow()
    sample = _points(_matrix(few.column(0)), metric) if few.num_rows else np.zeros((0, 1))
    centroids = fit_centroids(sample, min(cells, len(sample))) if len(sample) else np.zeros((0, 1))
    types = dict(kept.dtypes)
    found = kept.mapInArrow(_assign(centroids, metric), f"cell int, chunk_id {types['chunk_id']}, embedding {types['embedding']}, away double")
    placed = stored(found, "index-rows")
    stats = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()  # at most MOST_CELLS rows
    counts, radius = np.zeros(len(centroids), np.int64), np.zeros(len(centroids))
    for r in stats:
        counts[r.cell], radius[r.cell] = r.n, r.radius
    parts = F.element_at(F.array(*[F.lit(max(1, -(-int(n) // PART_ROWS))) for n in counts] or [F.lit(1)]), F.col("cell") + 1)
    rows = placed.withColumn("part", F.pmod(F.xxhash64("chunk_id"), parts).cast("int")).repartitionByRange("cell", "part").sortWithinPartitions("cell", "part")
    return VectorIndex(stored(rows, "index-cells"), centroids, radius, counts, metric)


def _first_cells(distances: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """The nearest cells that hold k rows together."""
    order = np.argsort(distances, kind="stable")
    order = order[counts[order] > 0]
    return order[: int(np.searchsorted(np.cumsum(counts[order]), k)) + 1]


def _probes(centroids: np.ndarray, radius: np.ndarray, counts: np.ndarray, metric: str, k: int, floor: float | None):
    """Cells to search for each query (qid, query_vector, and, in the second round, the k-th best score so far)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            at, cells, away, reach = [], [], [], []
            points = _points(_matrix(b.column(1)), metric)
            every = _distances(points, centroids)
            kth = b.column(2).to_pylist() if floor is not None else [None] * b.num_rows
            for i, d in enumerate(every):
                first = _first_cells(d, counts, k)
                if floor is None:
                    chosen, far = first, math.inf
                else:
                    far = reach_of(max(floor, -math.inf if kth[i] is None else kth[i] / 1e6), metric)
                    far += MARGIN * (1 + float(np.linalg.norm(points[i])) + float(radius.max(initial=0)))
                    near = np.flatnonzero((d - radius <= far) & (counts > 0))
                    chosen = np.setdiff1d(near, first)
                at += [i] * len(chosen)
                cells.append(chosen)
                away.append(d[chosen])
                reach += [far] * len(chosen)
            if at:
                took = pa.array(at)
                yield pa.record_batch(
                    [b.column(0).take(took), b.column(1).take(took), pa.array(np.concatenate(cells), pa.int32()), pa.array(np.concatenate(away)), pa.array(reach, pa.float64())], names=["qid", "query_vector", "cell", "away", "reach"]
                )

    return run


def _score_group(k: int, metric: str, names: list[str]):
    def run(probes: pa.Table, rows: pa.Table) -> pa.Table:
        qid, chunk, score, scored = [], [], [], []
        if probes.num_rows and rows.num_rows:
            q, x = _matrix(probes.column("query_vector")), _matrix(rows.column("embedding"))
            ids, queries = rows.column("chunk_id").to_pylist(), probes.column("qid").to_pylist()
            rank = np.empty(len(ids), np.int64)
            rank[sorted(range(len(ids)), key=ids.__getitem__)] = np.arange(len(ids))
            beside = rows.column("away").to_numpy()
            away, reach = probes.column("away").to_numpy(), probes.column("reach").to_numpy()
            for at in range(0, len(q), 256):
                s = _scores(q[at : at + 256], x, metric)
                # Rows too near to the centroid, or too far from it, to be within reach of the query don't count as scored.
                near = np.abs(away[at : at + 256, None] - beside) <= reach[at : at + 256, None]
                for i in range(len(s)):
                    own = np.flatnonzero(near[i])
                    best = own[np.lexsort((rank[own], -s[i, own]))[:k]]
                    qid += [queries[at + i]] * (len(best) + 1)
                    chunk += [ids[j] for j in best] + [None]
                    score += s[i, best].tolist() + [None]
                    scored += [None] * len(best) + [len(own)]
        return pa.table({"qid": pa.array(qid, probes.schema.field("qid").type), "chunk_id": pa.array(chunk, rows.schema.field("chunk_id").type), "score_e6": pa.array(score, pa.int64()), "scored": pa.array(scored, pa.int64())}).select(names)

    return run


def _scored(index: VectorIndex, probes: DataFrame, k: int) -> DataFrame:
    """(qid, chunk_id, score_e6, scored): for each probe and part the k best rows, and a row without chunk that says how many were scored."""
    sizes = [max(1, -(-int(n) // PART_ROWS)) for n in index.counts]
    parts = F.element_at(F.array(*map(F.lit, sizes)), F.col("cell") + 1)
    often = probes.groupBy("cell").agg(F.count("*").alias("asked"))  # at most MOST_CELLS rows
    blocks = often.select("cell", F.ceil(F.col("asked") / BLOCK_QUERIES).cast("int").alias("blocks"))
    dealt = probes.join(F.broadcast(blocks), "cell").withColumn("block", F.pmod(F.xxhash64("qid"), F.col("blocks")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    met = index.rows.join(F.broadcast(blocks), "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keys = ["cell", "part", "block"]
    schema = HITS.format(qid=dict(probes.dtypes)["qid"], chunk_id=dict(index.rows.dtypes)["chunk_id"])
    names = ["qid", "chunk_id", "score_e6", "scored"]
    grouped = dealt.select(*keys, "qid", "query_vector", "away", "reach").groupBy(*keys).cogroup(met.select(*keys, "chunk_id", "embedding", "away").groupBy(*keys))
    return grouped.applyInArrow(_score_group(k, index.metric, names), schema)


def search(index: VectorIndex, queries: DataFrame, k: int = 10, min_score: float = 0.15) -> tuple[DataFrame, DataFrame]:
    """The best ``k`` rows of each query (qid, chunk_id, score, rank), and what it took (qid, pairs).

    A first round scores the nearest cells that hold k rows; the k-th best score of those bounds the second, which scores what is within
    reach of it. Equal rounded scores go by chunk_id. Rows under ``min_score`` are left out, and cells without better ones aren't read. Queries with unusable
    vectors, or over an empty index, have no rows.
    """
    spark = queries.sparkSession
    types = dict(queries.dtypes)
    asked = stored(usable(queries.select("qid", "query_vector"), "query_vector", index.metric), "queries")
    if not index.counts.sum():
        return spark.createDataFrame([], f"qid {types['qid']}, chunk_id {dict(index.rows.dtypes)['chunk_id']}, score double, rank int"), spark.createDataFrame([], f"qid {types['qid']}, pairs long")
    shape = f"qid {types['qid']}, query_vector {types['query_vector']}, {PROBE}"
    plan = (index.centroids, index.radius, index.counts, index.metric, k)
    first = stored(_scored(index, asked.mapInArrow(_probes(*plan, None), shape), k), "hits")
    own = Window.partitionBy("qid").orderBy(F.desc("score_e6"), F.asc("chunk_id"))
    kth = first.where("chunk_id is not null").withColumn("rank", F.row_number().over(own)).where(F.col("rank") == k).select("qid", "score_e6")
    bounded = asked.join(kth, "qid", "left").select("qid", "query_vector", "score_e6")
    probes = stored(bounded.mapInArrow(_probes(*plan, min_score), shape), "probes")
    hits = first.unionAll(stored(_scored(index, probes, k), "hits"))
    best = hits.where("chunk_id is not null").withColumn("rank", F.row_number().over(own)).where((F.col("rank") <= k) & (F.col("score_e6") >= round(min_score * 1e6)))
    pairs = hits.where("chunk_id is null").groupBy("qid").agg(F.sum("scored").alias("pairs"))
    return best.select("qid", "chunk_id", (F.col("score_e6") / 1e6).alias("score"), "rank"), pairs

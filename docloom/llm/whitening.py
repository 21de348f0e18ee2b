"""Whitening of embeddings by the principal components of an exactly computed covariance.

Entries become whole numbers, a shift is subtracted, and sums and cross-products are accumulated without rounding: tasks split the
numbers into limbs of 20 bits, whose products are exact in a double, and put the limbs' products together as Python's
integers. Spark adds the tasks' totals as columns of 32-bit limbs. From them the driver forms n*X'X - SS' exactly; only then it goes to
floating point and ``eigh``. The driver holds the square of the dimension, whatever the table holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.plans.stored import drop_stored, stored

SCALE, SHIFT = 64, 1_000_000
LIMB = 20
#: Rows in a product of limbs: 2^38 * 2^13 is exact in a double.
BLOCK = 1 << 13
WORDS = 6
#: Numbers beyond this are held at it, so that a shifted one is still a long.
MOST = 1 << 62
TOTALS = "i int, j int, " + ", ".join(f"w{k} long" for k in range(WORDS))


def _whole(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows that count, and their entries as floor(SCALE * entry), that is as x less the shift."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null entries are NaN
    starts = np.cumsum(sizes) - sizes
    rows = np.flatnonzero(sizes == dim)
    found = flat[starts[rows][:, None] + np.arange(dim)]
    finite = np.isfinite(found).all(axis=1)
    with np.errstate(over="ignore"):
        z = np.clip(np.floor(SCALE * found[finite]), -float(MOST), float(MOST)).astype(np.int64)
    return rows[finite], z


def _packed(z: np.ndarray) -> list[bytes]:
    """Each row as bytes, in the least width that holds it, so that equal rows are equal bytes."""
    width = np.ones(len(z), int)
    for wide in (1, 2, 4):
        width[((z < -(1 << 8 * wide - 1)) | (z >= 1 << 8 * wide - 1)).any(axis=1)] = 2 * wide
    return [bytes([w]) + r.astype(f"<i{w}").tobytes() for w, r in zip(width.tolist(), z)]


def _unpacked(column: pa.Array, dim: int) -> np.ndarray:
    z = np.empty((len(column), dim), np.int64)
    for i, v in enumerate(column.to_pylist()):
        z[i] = np.frombuffer(v, f"<i{v[0]}", offset=1)
    return z


def _to_whole(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, z = _whole(b.column(0), dim)
            yield pa.record_batch([pa.array(_packed(z), pa.binary())], names=["z"])

    return run


def cross_products(blocks: Iterator[np.ndarray], dim: int) -> np.ndarray:
    """A'A of all rows as Python integers, A being a column of ones beside the rows' entries."""
    total = np.zeros((dim + 1, dim + 1), object)
    for z in blocks:
        limbs, rest = [], z
        while True:  # signed limbs: each is within 2^19 of zero
            low = ((rest + (1 << LIMB - 1)) & ((1 << LIMB) - 1)) - (1 << LIMB - 1)
            limbs.append(np.hstack([np.full((len(z), 1), float(not limbs)), low.astype(np.float64)]))
            rest = (rest - low) >> LIMB
            if not rest.any():
                break
        for p, a in enumerate(limbs):
            for q, b in enumerate(limbs):
                total += (a.T @ b).astype(np.int64).astype(object) << LIMB * (p + q)
    return total


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[np.ndarray]:
    held, rows = [], 0
    for b in batches:
        for at in range(0, b.num_rows, BLOCK):
            part = _unpacked(b.column(0).slice(at, BLOCK), dim)
            if rows + len(part) > BLOCK:
                yield np.vstack(held)
                held, rows = [], 0
            held.append(part)
            rows += len(part)
    if held:
        yield np.vstack(held)


def _scatter(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = cross_products(_blocks(batches, dim), dim)
        if not total[0, 0]:
            return
        i, j = np.triu_indices(dim + 1)
        values = total[i, j]
        mask = (1 << 32) - 1
        words = [[v >> 32 * k & mask for v in values] for k in range(WORDS - 1)] + [[v >> 32 * (WORDS - 1) for v in values]]
        yield pa.record_batch([pa.array(i, pa.int32()), pa.array(j, pa.int32()), *[pa.array(w, pa.int64()) for w in words]], names=["i", "j", *[f"w{k}" for k in range(WORDS)]])

    return run


@dataclass(frozen=True)
class Whitening:
    """Components of a fit list of ``n`` different vectors: ``sums`` of the shifted entries, ``project`` (dimension x components) with each component over the root of its variance."""

    n: int
    sums: list[int]
    project: np.ndarray
    explained: np.ndarray


def components(total: np.ndarray, most: int) -> Whitening:
    """From A'A (see :func:`cross_products`). Components whose variance can't be told from zero in double precision are left out; each has its largest entry positive."""
    n, sums = total[0, 0], total[0, 1:].tolist()
    s = np.array(sums, object)
    scatter = n * total[1:, 1:] - np.outer(s, s)
    square = n * n
    v = np.array([[x / square for x in row] for row in scatter.tolist()], np.float64)  # whole numbers divide to the nearest double
    trace = sum(scatter.diagonal().tolist()) / square
    e, q = np.linalg.eigh(v)
    order = np.argsort(-e, kind="stable")[:most]
    order = order[e[order] > max(e[-1], 0) * len(e) * np.finfo(float).eps]
    e, q = e[order], q[:, order]
    q = q * np.sign(q[np.abs(q).argmax(axis=0), np.arange(len(order))])
    return Whitening(int(n), sums, q / np.sqrt(e), e / trace if len(e) else e)


def _centred(z: np.ndarray, fit: Whitening) -> np.ndarray:
    """n*z - S exactly, as longs, or as Python's integers where those don't hold it."""
    widest = int(np.abs(z).max(initial=0)) * fit.n + max(map(abs, fit.sums))
    if widest < MOST:
        return fit.n * z - np.array(fit.sums, np.int64)
    return fit.n * z.astype(object) - np.array(fit.sums, object)


def _whitened(t: np.ndarray, fit: Whitening) -> np.ndarray:
    return (t / fit.n).astype(np.float64) @ fit.project


def _deviations(t: np.ndarray) -> list[int]:
    """The sum of squares of each row, exactly."""
    half = 26
    if t.dtype == object or t.shape[1] > 1024 or np.abs(t).max(initial=0) >= 1 << 2 * half:
        wide = t.astype(object)
        return (wide * wide).sum(axis=1).tolist()
    high, low = t >> half, t & ((1 << half) - 1)
    parts = zip((high * high).sum(axis=1).tolist(), (high * low).sum(axis=1).tolist(), (low * low).sum(axis=1).tolist())
    return [(hh << 2 * half) + (hl << half + 1) + ll for hh, hl, ll in parts]


def _moments(fit: Whitening, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = fit.project.shape[1] + 1
        total = np.zeros((k, k))
        for z in _blocks(batches, dim):
            w = np.hstack([np.ones((len(z), 1)), _whitened(_centred(z, fit), fit)])
            total += w.T @ w
        i, j = np.triu_indices(k)
        yield pa.record_batch([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "s"])

    return run


def identity_error(fitted: DataFrame, fit: Whitening, dim: int) -> float:
    """The largest absolute entry of the covariance of the whitened fit list, less the identity, from a pass over that list."""
    k = fit.project.shape[1]
    found = fitted.mapInArrow(_moments(fit, dim), "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()  # by the components' number
    total = np.zeros((k + 1, k + 1))
    for r in found:
        total[r.i, r.j] = total[r.j, r.i] = r.s
    means = total[0, 1:] / fit.n
    return float(np.abs(total[1:, 1:] / fit.n - np.outer(means, means) - np.eye(k)).max(initial=0))


def _project(fit: Whitening, dim: int, error: float):
    k = fit.project.shape[1]
    most = 10**38

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, z = _whole(b.column(1), dim)
            t = _centred(z, fit)
            deviation = pa.array([Decimal(d) if d < most else None for d in _deviations(t)], pa.decimal128(38, 0))
            each, count = np.repeat(np.arange(len(rows)), k), len(rows) * k
            columns = [
                b.column(0).take(pa.array(rows[each])), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))), pa.array(np.full(count, fit.n)), deviation.take(pa.array(each)),
                pa.array(_whitened(t, fit).ravel()), pa.array(np.tile(fit.explained, len(rows))), pa.array(np.full(count, error)),
            ]
            yield pa.record_batch(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def dimension(vectors: DataFrame, embedding: str = "embedding") -> int:
    """The most frequent length of the vectors without null or non-finite entries, the greatest of several; 0 if there is none."""
    finite: Callable = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))
    sizes = vectors.where(F.forall(embedding, finite)).groupBy(F.size(embedding).alias("size")).agg(F.count("*").alias("rows"))
    top = sizes.where("size > 0").orderBy(F.desc("rows"), F.desc("size")).first()
    return top["size"] if top else 0


def whiten(vectors: DataFrame, most: int = 16, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each row and component.

    Rows whose vector is null, or holds null, NaN or infinite entries, are left out; so are those of another length than most of the
    vectors have, as no covariance spans several lengths, and empty vectors. An entry c becomes floor(64 * c) + 1000000, that floor
    being held within 2^62. Equal vectors count once in the fit, but every row is returned, also with a null id and where ids repeat. There are ``most`` components,
    the vectors' length or as many as have variance, whichever is least; with one different vector there is none, so no row. ``deviation`` is a
    decimal of 38 digits, null beyond. An empty table gives an empty result. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    schema = f"vec_id {dict(rows.dtypes)['vec_id']}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    dim = dimension(rows)
    if not dim:
        return spark.createDataFrame([], schema)
    fitted = stored(rows.select("embedding").mapInArrow(_to_whole(dim), "z binary").distinct(), "fit-list")
    words = fitted.mapInArrow(_scatter(dim), TOTALS).groupBy("i", "j").agg(*[F.sum(f"w{k}").alias(f"w{k}") for k in range(WORDS)]).collect()  # by the square of the dimension
    total = np.zeros((dim + 1, dim + 1), object)
    for r in words:
        total[r.i, r.j] = total[r.j, r.i] = sum(r[f"w{k}"] << 32 * k for k in range(WORDS))
    fit = components(total, most)
    error = identity_error(fitted, fit, dim)
    drop_stored(fitted)
    return rows.mapInArrow(_project(fit, dim, error), schema)

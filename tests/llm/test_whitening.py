import math
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>"


def whole(v, dim):
    if v is None or len(v) != dim or not dim or any(c is None or not math.isfinite(c) for c in v):
        return None
    return tuple(math.floor(Fraction(float(np.float32(c))) * 64) + 1_000_000 for c in v)


def plain(rows, dim, most=16):
    """n, deviation and centred vector of each row, and the covariance, by fractions."""
    kept = [(i, x) for i, v in rows if (x := whole(v, dim)) is not None]
    fit = sorted({x for _, x in kept})
    n = len(fit)
    s = [sum(x[d] for x in fit) for d in range(dim)]
    v = [[Fraction(sum((n * x[a] - s[a]) * (n * x[b] - s[b]) for x in fit), n**3) for b in range(dim)] for a in range(dim)]
    deviations = [(i, x, sum((n * x[d] - s[d]) ** 2 for d in range(dim))) for i, x in kept]
    return n, s, np.array(v, float).reshape(dim, dim), deviations


def held(spark, rows, dim, components, schema=SCHEMA):
    df = spark.createDataFrame(rows, schema)
    got = whitening.whiten(df).collect()
    n, s, v, kept = plain(rows, dim)
    assert len(got) == len(kept) * components
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q[:, ::-1]
    by_id = {}
    for r in got:
        by_id.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    signs = {}
    for i, x, deviation in kept:
        centred = np.array([float(Fraction(n * a - b, n)) for a, b in zip(x, s)])
        for c in range(1, components + 1):
            r = by_id[i][c][0]
            assert r.n == n and r.deviation == Decimal(deviation) if deviation < 10**38 else r.deviation is None
            assert r.explained == pytest.approx(e[c - 1] / np.trace(v), rel=1e-9)
            assert r.identity_error < 1e-9
            expected = centred @ q[:, c - 1] / math.sqrt(e[c - 1])
            if abs(expected) > 1e-6:
                assert signs.setdefault(c, math.copysign(1, expected * r.whitened)) == math.copysign(1, expected * r.whitened)
            assert abs(r.whitened) == pytest.approx(abs(expected), rel=1e-6, abs=1e-7)
    return got


def test_against_fractions(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=6) * [4, 2, 1, 0.5, 3, 6]).tolist()) for i in range(120)]
    rows += [(200 + i, rows[3][1]) for i in range(60)]  # copies count once
    held(spark, rows, 6, 6)


def test_at_most_sixteen(spark):
    rng = np.random.default_rng(2)
    held(spark, [(i, (rng.normal(size=20) * np.arange(1, 21)).tolist()) for i in range(80)], 20, 16)


def test_nulls_and_odd_vectors_are_left_out(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=3) * [9, 3, 1]).tolist()) for i in range(40)]
    rows += [(50, None), (51, [1.0, None, 2.0]), (52, [1.0, float("nan"), 2.0]), (53, [float("inf"), 0.0, 0.0]), (54, []), (55, [1.0, 2.0]), (None, [0.5, -0.5, 0.25]), (7, rows[7][1])]
    got = held(spark, rows, 3, 3)
    assert not {50, 51, 52, 53, 54, 55} & {r.vec_id for r in got}
    assert sum(r.vec_id == 7 for r in got) == 6 and sum(r.vec_id is None for r in got) == 3


def test_large_entries_are_summed_exactly(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(a)) for a in rng.normal(size=3) * [1e15, 3e14, 7e13]]) for i in range(30)]
    n, s, v, kept = plain(rows, 3)
    got = held(spark, rows, 3, 3)
    assert {r.vec_id: r.deviation for r in got} == {i: Decimal(d) if d < 10**38 else None for i, _, d in kept}
    assert whitening.whiten(spark.createDataFrame([(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 2.0])], SCHEMA)).count() in (3, 6)


def test_cross_products_of_any_width():
    rng = np.random.default_rng(5)
    for bits in (3, 19, 20, 40, 61):
        z = rng.integers(-(1 << bits), 1 << bits, size=(300, 4))
        a = np.hstack([np.ones((300, 1), object), z.astype(object)])
        assert (whitening.cross_products(iter([z[:100], z[100:]]), 4) == a.T @ a).all()


def test_ranks_below_the_length(spark):
    held(spark, [(i, [float(i), 2.0 * i, 5.0]) for i in range(10)], 3, 1)  # one direction has variance
    assert whitening.whiten(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(4)], SCHEMA)).count() == 0


def test_empty_and_null_tables(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], SCHEMA)).count() == 0


def test_columns_that_clash_are_not_read(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, rng.normal(size=3).tolist()) for i in range(20)], SCHEMA)
    plain_rows = sorted(map(str, whitening.whiten(df).drop("identity_error").collect()))
    for name in ("component", "n", "z", "size", "rows", "whitened", "i", "j"):
        df = df.withColumn(name, F.lit("clash"))
    assert sorted(map(str, whitening.whiten(df).drop("identity_error").collect())) == plain_rows

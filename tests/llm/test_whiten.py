import math
import random
from fractions import Fraction

import numpy as np
import pytest

from scriptorium.llm import whiten

SCHEMA = "vec_id long, embedding array<double>"


def exact(rows, components=16):
    """The covariance of the distinct integer vectors by fractions, and what follows from it."""
    kept = [(k, tuple(math.floor(64 * c) + 1_000_000 for c in v)) for k, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({x for _, x in kept})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[i] for x in fit) for i in range(d)]
    v = [[sum((Fraction(x[i]) - Fraction(sums[i], n)) * (Fraction(x[j]) - Fraction(sums[j], n)) for x in fit) / n for j in range(d)] for i in range(d)]
    values, vectors = np.linalg.eigh(np.array([[float(c) for c in row] for row in v]))
    order = np.argsort(values)[::-1][:components]
    deviation = {k: sum((n * x[i] - sums[i]) ** 2 for i in range(d)) for k, x in kept}
    white = {k: np.array([float(Fraction(x[i]) - Fraction(sums[i], n)) for i in range(d)]) @ vectors[:, order] / np.sqrt(values[order]) for k, x in kept}
    return n, deviation, white, values[order] / values.sum()


def check(found, rows, components=16):
    n, deviation, white, explained = exact(rows, components)
    by = {}
    for r in found:
        by.setdefault(r.vec_id, {})[r.component] = r
    assert set(by) == set(deviation)
    signs = None
    for k, own in by.items():
        assert sorted(own) == list(range(1, len(explained) + 1))
        z = np.array([own[c].whitened for c in sorted(own)])
        assert {r.n for r in own.values()} == {n} and {r.deviation for r in own.values()} == {deviation[k]}
        assert np.allclose([own[c].explained for c in sorted(own)], explained, rtol=1e-9)
        if signs is None and (np.abs(white[k]) > 1e-3).all():
            signs = np.sign(z * white[k])
        assert np.allclose(np.abs(z), np.abs(white[k]), atol=1e-6)
        if signs is not None:
            assert np.allclose(z, signs * white[k], atol=1e-6)
    assert all(r.identity_error < 1e-6 for r in found)


def sample(n, d, seed=1, scale=1.0):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, scale * (1 + j)) for j in range(d)]) for i in range(n)]
    return rows + [(n + i, rows[3][1]) for i in range(n // 2)]  # copies weigh as one


def test_equals_fractions(spark):
    rows = sample(120, 5)
    check(whiten.whiten(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect(), rows)
    rows = sample(60, 20, 2)
    check(whiten.whiten(spark.createDataFrame(rows, SCHEMA)).collect(), rows)
    check(whiten.whiten(spark.createDataFrame(rows, SCHEMA), components=4).collect(), rows, 4)


def test_products_are_exact():
    rng = random.Random(4)
    for bits in (10, 37, 60, 75, 130):
        y = np.array([[rng.randrange(-(1 << bits) + 1, 1 << bits) for _ in range(3)] for _ in range(500)], dtype=np.int64 if bits < 62 else object)
        planes = np.zeros((2 * -(-(bits + 1) // whiten.LIMB_BITS) + 4, 3, 3), np.int64)
        whiten.products(y, bits, planes)
        total = sum(planes[s].astype(object) << (whiten.LIMB_BITS * s) for s in range(len(planes)))
        exact_y = y.astype(object)
        assert (total == exact_y.T.dot(exact_y)).all()


@pytest.mark.parametrize("scale", [1e12, 1e17])
def test_large_entries_take_the_exact_way(spark, scale):
    rows = sample(40, 3, 5, scale)
    rows = [(k, [max(-6e16, min(6e16, c)) for c in v]) for k, v in rows]
    n, deviation, white, explained = exact(rows)
    found = whiten.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r.deviation == (deviation[r.vec_id] if deviation[r.vec_id] < 1 << 63 else None) for r in found)
    assert all(abs(abs(r.whitened) - abs(white[r.vec_id][r.component - 1])) < 1e-6 and abs(r.explained - explained[r.component - 1]) < 1e-9 for r in found)


def test_odd_rows(spark):
    good = sample(30, 3)
    odd = [(900, None), (901, [1.0, None, 2.0]), (902, [float("nan"), 1.0, 1.0]), (903, [float("inf"), 0.0, 0.0]), (904, []), (None, [0.5, 0.25, 0.125])]
    found = whiten.whiten(spark.createDataFrame(good + odd, SCHEMA)).collect()
    check(found, good + [(None, [0.5, 0.25, 0.125])])
    assert not whiten.whiten(spark.createDataFrame([], SCHEMA)).collect()
    assert not whiten.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], SCHEMA)).collect()
    huge = whiten.whiten(spark.createDataFrame([(i, [1e300 * (i - 1), 1.0 * i]) for i in range(4)], SCHEMA)).collect()
    assert {r.vec_id for r in huge} == {0, 1, 2, 3}


def test_lengths_are_spaces_of_their_own(spark):
    a, b = sample(30, 3), [(1000 + k, v) for k, v in sample(40, 2, 9)]
    found = whiten.whiten(spark.createDataFrame(a + b, SCHEMA)).collect()
    check([r for r in found if r.vec_id < 1000], a)
    check([r for r in found if r.vec_id >= 1000], b)


def test_flat_dimensions_are_left_out(spark):
    rows = [(k, [*v, 7.0]) for k, v in sample(30, 2)]
    found = whiten.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.component for r in found} == {1, 2}


def test_other_columns(spark):
    df = spark.createDataFrame([(i, [float(i), float(i * i)], "x", 1) for i in range(9)], SCHEMA + ", x string, component int")
    assert len(whiten.whiten(df).collect()) == 18


def test_query(spark):
    found = whiten.op12_digit_slice_whitening(spark, "/root/testdata/sf0.001").collect()
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").collect()]
    n, deviation, white, explained = exact(rows)
    assert len(found) == 16 * len(rows)
    assert all(r.n == n and r.deviation == deviation[r.vec_id] and abs(abs(r.whitened) - abs(white[r.vec_id][r.component - 1])) < 1e-6 and r.identity_error < 1e-9 for r in found)

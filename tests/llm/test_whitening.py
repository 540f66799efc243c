import math

import numpy as np
import pytest

from factlake.llm import whitening as W

KIND = "vec_id long, embedding array<float>, n int, x string, whitened double"


def _frame(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], i, "x", 0.0) for i, v in enumerate(vectors)], KIND)


def _whole(vectors):
    ok = [(i, v) for i, v in enumerate(vectors) if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    return [i for i, _ in ok], np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in ok], object)


def _check(spark, vectors, rank, tol=1e-9):
    """Against singular values of the exactly centred matrix."""
    ids, x = _whole(vectors)
    n, sums = len(x), x.sum(0)
    y = np.array((n * x - sums) / n, float)
    _, sigma, vt = np.linalg.svd(y, full_matrices=False)
    got = {r.vec_id: r for r in W.whitened(_frame(spark, vectors)).collect()}
    assert sorted(got) == ids
    k = min(32, rank)
    for i, row in zip(ids, x):
        r = got[i]
        assert len(r.whitened) == len(r.explained) == k and r.n == n
        assert int(r.deviation) == sum((n * a - s) ** 2 for a, s in zip(row, sums))
        assert r.identity_error <= 1e-10 + 4e-16 * sigma[0] / sigma[k - 1] * 40
    white = np.array([got[i].whitened for i in ids])
    want = y @ vt[:k].T / (sigma[:k] / math.sqrt(n))
    assert np.allclose(got[ids[0]].explained, sigma[:k] ** 2 / (sigma ** 2).sum(), rtol=1e-9)
    turn = np.sign((white * want).sum(0))
    assert np.abs(white - want * turn).max() < tol


def test_equals_singular_vectors(spark):
    rng = np.random.default_rng(3)
    v = (rng.normal(size=(400, 40)) * np.linspace(0.3, 5, 40) @ np.linalg.qr(rng.normal(size=(40, 40)))[0]).astype(np.float32).tolist()
    v += [None, [None] * 40, [math.nan] * 40, [math.inf] + [0.0] * 39, [-math.inf] + [0.0] * 39, v[0], v[0]]
    _check(spark, v, 40)


def test_one_direction_far_longer_than_the_others(spark):
    """Condition 10**9: the Gram matrix in doubles is singular, the shift carries it."""
    rng = np.random.default_rng(4)
    v = rng.integers(-3, 4, size=(300, 6)).astype(float) / 64
    v[:, 5] = np.round(rng.normal(size=300) * 2**23) * 4  # float32 holds these
    _check(spark, v.tolist(), 6, tol=1e-6)


@pytest.mark.parametrize("kind", ["constant", "repeated", "few", "copies"])
def test_directions_without_variance_have_no_component(spark, kind):
    rng = np.random.default_rng(5)
    v = rng.integers(-200, 200, size=(200, 12)) / 64
    rank = 12
    if kind == "constant":
        v[:, 3], rank = 1.5, 11
    elif kind == "repeated":
        v[:, 7], rank = 2 * v[:, 2], 11
    elif kind == "few":
        v, rank = v[:5], 4
    else:
        v, rank = np.repeat(v[:3], 40, 0), 2
    _check(spark, v.tolist(), rank)


def test_defined_cases(spark):
    none = _frame(spark, [None, [math.nan, 1.0]])
    assert W.whitened(none).collect() == []
    assert W.whitened(_frame(spark, [])).collect() == []
    assert W.whitened(_frame(spark, [[], []])).collect() == []
    assert W.whitened(_frame(spark, [[1.0, 2.0]] * 5)).collect() == []
    mixed = W.whitened(_frame(spark, [[1.0, 2.0], [3.0, 1.0], [0.0], [5.0, 5.0]])).collect()
    assert sorted(r.vec_id for r in mixed) == [0, 1, 3] and mixed[0].n == 3
    far = W.whitened(_frame(spark, [[3e38, 0.0], [-3e38, 1.0], [0.0, 2.0]])).collect()
    assert len(far) == 3 and all(r.deviation is None or r.deviation > 0 for r in far)
    same = W.whitened(spark.createDataFrame([(None, [1.0, 0.0]), (None, [1.0, 0.0]), (7, [0.0, 3.0])], "vec_id long, embedding array<double>")).collect()
    assert len(same) == 3 and same[0].whitened is not None


def test_matrices_are_added_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(W, "TASKS", 2)
    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([(rng.integers(-9, 9, 5).tolist(),) for _ in range(90)], "x array<long>").repartition(7)
    x = np.array([r.x for r in rows.collect()], float)
    assert np.array_equal(W.gram(rows, lambda m: m.astype(float), 5), x.T @ x)

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.llm.whitening import components_of, leading_values, op11_whitening, sturm_counts, tridiagonal, whitened


def _brute(vectors):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    e, q = np.linalg.eigh(np.cov((fit - s / n).T, bias=True).reshape(x.shape[1], -1))
    e, q = e[::-1], q[:, ::-1]
    return x, n, s, e, q, ((n * x - s) ** 2).sum(1)


def _check(got, vectors, most=16):
    x, n, s, e, q, deviation = _brute(vectors)
    k = min(most, (e > 1e-9 * e[0]).sum())
    table = {}
    for r in got:
        table.setdefault(r.vec_id, {})[r.component] = r
    for i in range(len(x)):
        row = table[i]
        assert sorted(row) == list(range(1, k + 1))
        assert all(r.n == n and r.deviation == deviation[i] and r.identity_error <= 1e-9 for r in row.values())
    for c in range(k):
        want = (x - s / n) @ q[:, c] / np.sqrt(e[c])
        have = np.array([table[i][c + 1].whitened for i in range(len(x))])
        assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-7
        assert table[0][c + 1].explained == pytest.approx(e[c] / e.sum(), rel=1e-9)


@pytest.mark.parametrize("seed", range(6))
def test_eigenproblem(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 40))
    a = rng.standard_normal((n, n))
    v = a @ a.T
    d, e, q = tridiagonal(v)
    t = np.diag(d) + np.diag(e, 1) + np.diag(e, -1)
    assert np.allclose(q @ t @ q.T, v) and np.allclose(q @ q.T, np.eye(n))
    want = np.linalg.eigvalsh(v)[::-1]
    assert np.allclose(leading_values(d, e, n), want)
    assert list(sturm_counts(d, e, np.array([want.min() - 1, want.max() + 1]))) == [0, n]
    values, found = components_of(v, n)
    assert np.allclose(found @ found.T, np.eye(len(found)), atol=1e-12) and np.allclose(found @ v, values[:, None] * found, atol=1e-9 * want[0])


def test_equal_eigenvalues():
    """A cluster of equal values still gives orthogonal components; directions without variance give none."""
    q, _ = np.linalg.qr(np.random.default_rng(5).standard_normal((12, 12)))
    v = q @ np.diag([5, 5, 5, 5, 2, 2, 1, 1e-9 + 1, 0.5, 0.5, 0, 0]) @ q.T
    values, found = components_of(v, 16)
    assert len(values) == 10 and np.allclose(values[:4], 5)
    assert np.allclose(found @ found.T, np.eye(10), atol=1e-12) and np.allclose(found @ v, values[:, None] * found, atol=1e-9)
    assert [len(x) for x in components_of(np.zeros((3, 3)))] == [0, 0]
    assert np.allclose(components_of(np.eye(4))[1] @ components_of(np.eye(4))[1].T, np.eye(4))


def test_against_numpy(spark):
    sf = "/root/testdata/sf0.001"
    vectors = [r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()]
    _check(op11_whitening(spark, sf).collect(), vectors)


def test_repeated_null_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    good = (rng.standard_normal((40, 5)) * [1, 2, 3, 0.5, 0.1]).tolist()
    good += [good[0]] * 30  # copies count once
    rows = [(i, v, 7) for i, v in enumerate(good)] + [(900, None, 7), (901, [1.0, None, 1.0, 1.0, 1.0], 7), (902, [1.0, 2.0, float("nan"), 0.0, 0.0], 7),
                                                       (903, [float("-inf")] * 5, 7), (904, [], 7), (905, [1.0, 2.0], 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, Vec_ID int")
    got = whitened(df).collect()
    assert {r.vec_id for r in got} == set(range(len(good)))
    _check(got, good)


def test_empty_single_and_constant(spark):
    schema = "vec_id long, embedding array<float>"
    empty = whitened(spark.createDataFrame([], schema))
    assert empty.count() == 0 and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitened(spark.createDataFrame([(1, [0.5, 0.25])] * 3, schema)).count() == 0  # no variance, no component
    line = whitened(spark.createDataFrame([(None, [0.0, 0.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0])], schema)).orderBy(F.col("vec_id")).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation) for r in line] == [(None, 1, 2, 2 * 64**2), (1, 1, 2, 2 * 64**2), (1, 1, 2, 2 * 64**2)]
    assert abs(line[0].whitened) == pytest.approx(1) and line[0].explained == pytest.approx(1)

"""Whitening of embeddings by principal components.

Vectors become exact integers x = floor(64 * c) + 1000000. The fit list holds each distinct x once and is written. One pass
over it sums x exactly, a second one sums the products of the centred vectors, each partition its own matrix, added up by
Spark entry by entry. The small matrix (dimensions squared) is brought to tridiagonal form by Householder reflections; its
leading eigenvalues come from bisection on Sturm counts, its components from inverse iteration, where those of close
eigenvalues are made orthogonal to each other again. The components go with the closure of the job that projects all rows.
A last pass over the fit list measures how far the covariance of the whitened vectors is from the identity.

Defined cases: null vectors and such with null or non-finite entries are dropped; so are empty vectors and those of another
length than the commonest (the longest of equally common ones), for which no covariance is defined; an empty table gives no
rows; repeated rows each get their rows, but count once in the fit; a null id stays null; directions without variance (an
eigenvalue of at most dimensions * 2e-16 of the largest diagonal entry) have no component, so there may be fewer than asked for. An x that
does not fit into a long, or a deviation that does not, is an error."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import mapped, out, pick, table
from touchline.session import written

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Eigenvalues nearer than this share of the matrix norm are one cluster.
CLOSE = 1e-3


# --- the symmetric eigenproblem ----------------------------------------------


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and Q with v = Q T Q', by Householder reflections."""
    a, n = np.array(v, float), len(v)
    q = np.eye(n)
    for k in range(n - 2):
        u = a[k + 1 :, k].copy()
        if not np.any(u[1:]):
            continue
        size = np.copysign(np.linalg.norm(u), u[0])
        u[0] += size
        u /= np.linalg.norm(u)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ u
        w = 2 * (p - (u @ p) * u)
        rest -= np.outer(u, w) + np.outer(w, u)
        a[k + 1 :, k] = a[k, k + 1 :] = 0
        a[k + 1, k] = a[k, k + 1] = -size
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ u, u)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def sturm_counts(d: np.ndarray, e: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues are below each value in ``at``: the negative pivots of T - at."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    count, pivot = np.zeros(len(at), int), np.ones(len(at))
    for k in range(len(d)):
        pivot = d[k] - at - (e[k - 1] ** 2 / pivot if k else 0.0)
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        count += pivot < 0
    return count


def leading_values(d: np.ndarray, e: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` largest eigenvalues, falling, by bisection until no double lies between the bounds."""
    n = len(d)
    reach = np.abs(np.append(e, 0)) + np.abs(np.append(0, e))
    wanted = n - 1 - np.arange(min(most, n))
    low, high = np.full(len(wanted), (d - reach).min()), np.full(len(wanted), (d + reach).max())
    low, high = low - np.abs(low) * 1e-15 - 1e-300, high + np.abs(high) * 1e-15 + 1e-300
    while True:
        mid = low + (high - low) / 2
        if np.all((mid <= low) | (mid >= high)):
            return mid
        below = sturm_counts(d, e, mid) > wanted
        high, low = np.where(below, mid, high), np.where(below, low, mid)


def _solved(d: np.ndarray, e: np.ndarray, at: float, b: np.ndarray, small: float) -> np.ndarray:
    """x with (T - at) x = b, by elimination with row exchanges; pivots of zero become ``small``."""
    n = len(d)
    diag, up, up2, x = d - at, np.append(e, 0.0), np.zeros(n), b.copy()
    for k in range(n - 1):
        below, right = e[k], diag[k + 1]
        if abs(below) > abs(diag[k]):
            f = diag[k] / below
            diag[k], up_k, up2[k] = below, right, up[k + 1]
            diag[k + 1], up[k + 1] = up[k] - f * right, -f * up2[k]
            up[k] = up_k
            x[k], x[k + 1] = x[k + 1], x[k] - f * x[k + 1]
        else:
            if abs(diag[k]) < small:
                diag[k] = small
            f = below / diag[k]
            diag[k + 1] = right - f * up[k]
            x[k + 1] -= f * x[k]
    for k in range(n - 1, -1, -1):
        if abs(diag[k]) < small:
            diag[k] = np.copysign(small, diag[k])
        x[k] = (x[k] - (up[k] * x[k + 1] if k + 1 < n else 0) - (up2[k] * x[k + 2] if k + 2 < n else 0)) / diag[k]
    return x


def components_of(v: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The leading eigenvalues, falling, and a row of unit length for each; directions without variance are left out."""
    n = len(v)
    v = (v + v.T) / 2
    scale = np.abs(v).max() if n else 0.0
    if not scale > 0:
        return np.zeros(0), np.zeros((0, n))
    d, e, q = tridiagonal(v / scale)
    norm = max(np.abs(d).max(), np.abs(e).max(initial=0))
    eps = np.finfo(float).eps
    values = leading_values(d, e, most)
    values = values[values > n * eps * np.abs(d).max()]
    found, start, random = np.zeros((len(values), n)), 0, np.random.default_rng(1)
    for k, value in enumerate(values):
        if k and values[k - 1] - value > CLOSE * norm:
            start = k
        near = found[start:k]
        # equal values get shifts of their own, so that each solve sees another direction first
        shift, x = value - 2 * eps * norm * (k - start), random.standard_normal(n)
        for _ in range(5):
            x = _solved(d, e, shift, x, eps * norm)
            for _ in range(2):
                x -= near.T @ (near @ x)
            x /= np.linalg.norm(x)
        found[k] = x
    return values * scale, found @ q.T


# --- the jobs ----------------------------------------------------------------


def integer_vectors(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x array<long>) of the rows whose vector is whole."""
    v = F.col("v")
    got = pick(rows, vec_id=id_col, v=vector_col).withColumn("v", v.cast("array<double>")).where(F.size(v) > 0)
    whole = got.where(~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    # exact in doubles below 2^53; ANSI arithmetic fails beyond a long
    return whole.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda c: F.floor(c * SCALE) + OFFSET).alias("x"))


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return np.asarray(batch.column(batch.schema.get_field_index("x")).flatten(), np.int64).reshape(-1, dims)


_SUM = pa.schema([("i", pa.int32()), ("s", pa.int64()), ("n", pa.int64())])


def _summed(dims: int):
    """A batch's sum of x and number of rows for each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield out(_SUM, np.arange(dims, dtype=np.int32), _matrix(batch, dims).sum(0), np.full(dims, batch.num_rows))

    return run


_ENTRY = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("v", pa.float64())])


def summed_products(rows: DataFrame, dims: int, seen) -> np.ndarray:
    """The sum of y'y over all rows, y = seen(x): a matrix for each partition, added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            if batch.num_rows:
                y = seen(_matrix(batch, dims))
                total = total + y.T @ y
        if not np.isscalar(total):
            i, j = np.triu_indices(len(total))
            yield out(_ENTRY, i.astype(np.int32), j.astype(np.int32), total[i, j])

    got = mapped(rows.select("x"), run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    size = int(got["j"].max()) + 1 if len(got) else 0
    m = np.zeros((size, size))
    m[got["i"], got["j"]] = m[got["j"], got["i"]] = got["v"]
    return m


@dataclass
class Whitening:
    n: int
    sums: np.ndarray
    values: np.ndarray
    components: np.ndarray
    trace: float
    error: float

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates of rows of x, one column a component."""
        return _centred(x, self.n, self.sums) @ (self.components / np.sqrt(self.values)[:, None]).T

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """Sum over dimensions of (n x - sums)^2 in exact integers."""
        lows, highs = x.min(0, initial=0).tolist(), x.max(0, initial=0).tolist()
        reach = sum(max(abs(self.n * a - s), abs(self.n * b - s)) ** 2 for a, b, s in zip(lows, highs, self.sums.tolist()))
        if reach < 2**63:
            return ((self.n * x - self.sums) ** 2).sum(1)
        exact = [sum((self.n * a - s) ** 2 for a, s in zip(row, self.sums.tolist())) for row in x.tolist()]
        return np.array(pa.array(exact, pa.int64()))  # fails if one does not fit


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - sums / n: whole part and remainder apart, so that nothing is lost by the offset."""
    return (x - sums // n) - (sums % n) / n


def fit(rows: DataFrame, most: int = COMPONENTS) -> tuple[Whitening | None, int]:
    """The whitening of (vec_id, x) and the length of its vectors; None without rows."""
    lengths = rows.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if lengths is None:
        return None, 0
    dims = lengths["dims"]
    distinct = written(rows.where(F.size("x") == dims).select("x").distinct(), "whitening-fit")
    sums = mapped(distinct, _summed(dims), "i int, s long, n long").groupBy("i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).orderBy("i").collect()
    n, s = sums[0]["n"], np.array([r["s"] for r in sums], np.int64)
    v = summed_products(distinct, dims, lambda x: _centred(x, n, s)) / n
    values, components = components_of(v, most)
    model = Whitening(n, s, values, components, float(np.trace(v)), 0.0)
    if len(values):
        model.error = float(np.abs(summed_products(distinct, dims, model.project) / n - np.eye(len(values))).max())
    return model, dims


_PROJECTED = pa.schema([("vec_id", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.list_(pa.float64()))])


def whitened(rows: DataFrame, most: int = COMPONENTS, **columns: str) -> DataFrame:
    """A row (vec_id, component, n, deviation, whitened, explained, identity_error) for each row and component."""
    rows = integer_vectors(rows, **columns)
    model, dims = fit(rows, most)
    if model is None:
        model = Whitening(0, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, 0)), 0.0, 0.0)
    k = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch, dims)
                flat = pa.array(model.project(x).ravel())
                yield out(_PROJECTED, batch.column(0), model.deviation(x), pa.ListArray.from_arrays(pa.array(np.arange(0, k * len(x) + 1, max(k, 1), dtype=np.int32)[: len(x) + 1]), flat))

    got = mapped(rows.where((F.size("x") == dims) & F.lit(k > 0)), run, "vec_id long, deviation long, whitened array<double>")
    explained = F.array(*[F.lit(float(e / model.trace)) for e in model.values]) if k else F.array().cast("array<double>")
    return got.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        explained[F.col("at")].alias("explained"), F.lit(model.error).alias("identity_error"))


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))

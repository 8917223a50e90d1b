"""PCA whitening of embeddings by the exact characteristic polynomial of their integer scatter.

Entries become whole numbers x, and equal vectors count once (the fit list, n vectors with sums S). M = n * sum(x x') - S S' is
then a matrix of whole numbers, M / n^2 the covariance. Its characteristic polynomial is computed modulo primes below 2^31, each by
reduction to Hessenberg form, and put together by Chinese remaindering; as M has no negative eigenvalue, the k-th coefficient
is at most C(d, k) (trace / d)^k, which tells how many primes are enough. All roots are real, so the signs' variations of the
polynomial moved by a (Descartes) count exactly the roots above a, copies included: bisection with that count isolates each
of the largest roots, and a lone root is then halved by the polynomial's sign. A component is the null space of M minus its root,
found by inverse iteration in decimal arithmetic with as many digits as the root's distance needs.

Scale: the fit list is one grouped table; sums of products leave each task as d * (d + 3) / 2 numbers and are summed
by Spark as decimals, so they are exact; the primes are rows that Spark deals to its tasks. The driver holds matrices and polynomials of
the vectors' dimension d, whatever the number of rows. Projection and check are one scan each.

Defined results: rows whose vector is null or holds a null or a number that isn't finite are left out; a shorter vector is filled with
zeros; equal vectors, with one vec_id or several, are one of the fit list and a row each of the result; a null vec_id stays null; only components
with an eigenvalue above zero are returned, so one distinct vector, vectors without entries or an empty table give no row; equal
eigenvalues give an orthonormal basis of their space; extra columns are ignored; a deviation beyond 64 bits is null.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator
from math import comb, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedspark.llm import common as C
from feedspark.llm.vectors import grids, whole_numbers

#: Bits by which a root is known beyond the size of the mean eigenvalue.
BITS = 160
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _moments(d: int):
    """Rows (i, j, value): number of vectors at (-1, -1), sums at (-1, j), sums of products at (i, j) for i <= j."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(d, object), np.zeros((d, d), object)
        for _, x in grids(batches):
            n += len(x)
            sums += x.sum(axis=0, dtype=object) if np.abs(x).max() > 1 << 40 else x.sum(axis=0).astype(object)
            if int(np.abs(x).max()) ** 2 * len(x) < 1 << 53:
                y = x.astype(np.float64)
                products += (y.T @ y).astype(np.int64).astype(object)
            else:
                y = x.astype(object)
                products += y.T @ y
        if n:
            i, j = np.triu_indices(d)
            values = [n, *sums, *products[i, j]]
            own = [np.r_[-1, np.full(d, -1), i].astype(np.int32), np.r_[-1, np.arange(d), j].astype(np.int32)]
            with decimal.localcontext(prec=60):
                exact = pa.array([decimal.Decimal(int(v)) for v in values], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([*map(pa.array, own), exact], ["i", "j", "value"])

    return run


def scatter(fit: DataFrame, d: int) -> tuple[int, list[int], list[list[int]]]:
    """n, S and M = n * sum(x x') - S S' of the vectors of fit, exact."""
    parts = C.mapped(fit.select("x"), _moments(d), "i int, j int, value decimal(38,0)")
    cells = {(r.i, r.j): int(r.value) for r in parts.groupBy("i", "j").agg(F.sum("value").alias("value")).collect()}
    n, s = cells.get((-1, -1), 0), [cells.get((-1, j), 0) for j in range(d)]
    return n, s, [[n * cells.get((min(i, j), max(i, j)), 0) - s[i] * s[j] for j in range(d)] for i in range(d)]


def _is_prime(m: int) -> bool:
    return all(m % q for q in range(3, isqrt(m) + 1, 2)) if m < 1 << 20 else all(_passes(m, a) for a in (2, 3, 5, 7))


def _passes(m: int, a: int) -> bool:
    """The strong test of m to base a; the four bases decide below 2^31."""
    odd, twos = m - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    x = pow(a, odd, m)
    return x in (1, m - 1) or any((x := x * x % m) == m - 1 for _ in range(twos - 1))


def primes(above: int) -> list[int]:
    """Primes downwards from 2^31 whose product is larger than `above`."""
    found, product, m = [], 1, (1 << 31) - 1
    while product <= above:
        if _is_prime(m):
            found.append(m)
            product *= m
        m -= 2
    return found


def characteristic_modulo(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(X - matrix) modulo the prime p < 2^31, from the constant one upwards."""
    h, d = matrix.astype(np.int64) % p, len(matrix)
    for k in range(d - 2):
        below = np.flatnonzero(h[k + 1 :, k])
        if not len(below):
            continue
        at = k + 1 + int(below[0])
        h[[k + 1, at]] = h[[at, k + 1]]
        h[:, [k + 1, at]] = h[:, [at, k + 1]]
        u = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - u[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * u % p).sum(axis=1)) % p
    polys = np.zeros((d + 1, d + 1), np.int64)  # row k: that of the leading k by k part
    polys[0, 0] = 1
    for k in range(1, d + 1):
        own = np.zeros(d + 1, np.int64)
        own[1:] = polys[k - 1, :-1]
        factor = 1
        for i in range(k - 1, -1, -1):
            own = (own - polys[i] * (int(h[i, k - 1]) * factor % p)) % p
            factor = factor * int(h[i, i - 1]) % p if i else 0
        polys[k] = own
    return polys[d]


def _residues(matrix: list[list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            moduli = batch.column("p").to_pylist()
            rests = [characteristic_modulo(np.array([[v % p for v in row] for row in matrix], np.int64), p).tolist() for p in moduli]
            yield pa.RecordBatch.from_arrays([pa.array(moduli, pa.int64()), pa.array(rests, pa.list_(pa.int64()))], ["p", "c"])

    return run


def characteristic(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Coefficients of det(X - matrix), from the constant one upwards; matrix: whole numbers, symmetric, no negative eigenvalue."""
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    moduli = primes(2 * max(comb(d, k) * trace**k // d**k + 1 for k in range(d + 1)))
    rows = spark.createDataFrame([(p,) for p in moduli], "p long").repartition(max(1, min(len(moduli) // 8, 4 * spark.sparkContext.defaultParallelism)))
    rests = {r.p: r.c for r in C.mapped(rows, _residues(matrix), "p long, c array<long>").collect()}
    product = 1
    for p in moduli:
        product *= p
    parts = {p: product // p * pow(product // p, -1, p) for p in moduli}
    whole = [sum(rests[p][k] * parts[p] for p in moduli) % product for k in range(d + 1)]
    return [v - product if 2 * v > product else v for v in whole]


def roots_above(poly: list[int], a: int) -> int:
    """How many roots of a polynomial with real roots only lie above a, copies included."""
    c = list(poly)
    for i in range(len(c) - 1):  # the polynomial moved by a
        for j in range(len(c) - 2, i - 1, -1):
            c[j] += a * c[j + 1]
    signs = [v > 0 for v in c if v]
    return sum(x != y for x, y in zip(signs, signs[1:], strict=False))


def _positive(poly: list[int], a: int) -> bool:
    value = 0
    for v in reversed(poly):
        value = value * a + v
    return value > 0


def largest_roots(poly: list[int], most: int, shift: int) -> list[int]:
    """Up to `most` largest positive roots times 2^shift, each rounded up to a whole number, falling, copies included. poly: real,
    non-negative roots only."""
    d = len(poly) - 1
    while poly[0] == 0:  # roots at zero
        poly = poly[1:]
    scaled = [v << (shift * (len(poly) - 1 - k)) for k, v in enumerate(poly)]
    top = (-poly[-2] << shift) + 1 if len(poly) > 1 else 0  # above the sum of all
    known: dict[int, int] = {0: len(poly) - 1, top: 0}
    found = []
    for k in range(1, min(most, d, len(poly) - 1) + 1):
        low, high = max(a for a, m in known.items() if m >= k), min(a for a, m in known.items() if m < k)
        while high - low > 1 and known[low] - known[high] > 1:
            mid = (low + high) // 2
            known[mid] = roots_above(scaled, mid)
            low, high = (mid, high) if known[mid] >= k else (low, mid)
        if high - low > 1:  # one root: the sign right of it is that above all roots, turned once for each root above
            right = known[high] % 2 == 0
            while high - low > 1:
                mid = (low + high) // 2
                above = _positive(scaled, mid) == right
                low, high = (low, mid) if above else (mid, high)
        found.append(high)
    return found


def null_vectors(matrix: list[list[int]], roots: list[int], shift: int) -> np.ndarray:
    """Unit eigenvectors, one a row, of the matrix for roots times 2^shift: inverse iteration, each orthogonal to those before."""
    d, out = len(matrix), []
    digits = 60 + int((max(r.bit_length() for r in roots) + shift) * 0.302) if roots else 60
    random = np.random.default_rng(20240311)
    with decimal.localcontext(prec=digits):
        for root in roots:
            a = np.array([[decimal.Decimal((v << shift) - (root if i == j else 0)) for j, v in enumerate(row)] for i, row in enumerate(matrix)], object)
            order = np.arange(d)
            for k in range(d):
                at = k + int(np.argmax(np.abs(a[k:, k])))
                a[[k, at]], order[[k, at]] = a[[at, k]], order[[at, k]]
                if a[k, k] == 0:
                    a[k, k] = decimal.Decimal(1)  # the least step of a root
                a[k + 1 :, k] /= a[k, k]
                a[k + 1 :, k + 1 :] -= a[k + 1 :, k][:, None] * a[k, k + 1 :]
            u = np.array([decimal.Decimal(float(v)) for v in random.standard_normal(d)], object)
            for _ in range(3):
                u = u[order]
                for k in range(d):
                    u[k + 1 :] -= a[k + 1 :, k] * u[k]
                for k in range(d - 1, -1, -1):
                    u[k] /= a[k, k]
                    u[:k] -= a[:k, k] * u[k]
                u /= np.abs(u).max()
                for v in out:
                    u -= v * (v * u).sum()
                u /= (u * u).sum().sqrt()
            out.append(u)
    return np.array([[float(v) for v in u] for u in out]).reshape(len(roots), d)


def components(spark: SparkSession, matrix: list[list[int]], most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Up to `most` components (rows), the eigenvalues of the matrix, and its trace."""
    d = len(matrix)
    trace = sum(matrix[i][i] for i in range(d))
    if trace == 0:
        return np.zeros((0, d)), np.zeros(0), 0.0
    shift = max(0, BITS - (trace // d + 1).bit_length())
    roots = largest_roots(characteristic(spark, matrix), most, shift)
    return null_vectors(matrix, roots, shift), np.array([r / (1 << shift) for r in roots]), float(trace)


class Whitener:
    """n, sums, components and eigenvalues of a fit; project and deviation of integer vectors."""

    def __init__(self, n: int, sums: list[int], axes: np.ndarray, values: np.ndarray, trace: float):
        self.n, self.sums, self.axes, self.values = n, np.array(sums, object), axes, values
        self.explained = (values / trace).tolist() if trace else []

    def _centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, in int64 if sums of its squares fit there, else as Python's whole numbers."""
        most = max([int(np.abs(x).max(initial=0)) * self.n * 2 + 1, *(2 * abs(v) + 1 for v in self.sums)])
        if most * most * max(1, x.shape[1]) < 1 << 63:
            return x * self.n - self.sums.astype(np.int64)
        return x.astype(object) * self.n - self.sums

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """whitened (a column for each component) and deviation."""
        y = self._centred(x)
        return y.astype(np.float64) @ (self.axes / np.sqrt(self.values)[:, None]).T, (y * y).sum(axis=1)


def _products(whiten: Whitener):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(whiten.values)
        one, two = np.zeros(k), np.zeros((k, k))
        for _, x in grids(batches):
            w, _ = whiten(x)
            one += w.sum(axis=0)
            two += w.T @ w
        i, j = np.triu_indices(k)
        columns = [np.r_[np.full(k, -1), i].astype(np.int32), np.r_[np.arange(k), j].astype(np.int32), np.r_[one, two[i, j]]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["i", "j", "value"])

    return run


def identity_error(fit: DataFrame, whiten: Whitener) -> float:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity."""
    parts = C.mapped(fit.select("x"), _products(whiten), "i int, j int, value double")
    cells = {(r.i, r.j): r.value for r in parts.groupBy("i", "j").agg(F.sum("value").alias("value")).collect()}
    mean = [cells[-1, j] / whiten.n for j in range(len(whiten.values))]
    return max(abs(v / whiten.n - mean[i] * mean[j] - (i == j)) for (i, j), v in cells.items() if i >= 0)


def _rows(whiten: Whitener, error: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(whiten.values)
        for batch, x in grids(batches):
            w, deviation = whiten(x)
            ids, m = batch.column("vec_id"), len(x)
            spread = [int(v) if v < 1 << 63 else None for v in deviation]
            columns = [
                ids.take(pa.array(np.repeat(np.arange(m), k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, whiten.n)),
                pa.array(spread, pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                pa.array(w.ravel()),
                pa.array(np.tile(whiten.explained, m)),
                pa.array(np.full(m * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in OUT.split(", ")])

    return run


def whitened(embeddings: DataFrame, most: int = 4) -> DataFrame:
    """One row per usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = embeddings.sparkSession
    rows = whole_numbers(embeddings, F.col("vec_id").cast("long").alias("vec_id"))
    fit = C.checkpointed(rows.select("x").distinct())
    d = fit.agg(F.max(F.size("x"))).first()[0] or 0
    n, sums, matrix = scatter(fit, d)
    axes, values, trace = components(spark, matrix, most)
    if not len(values):
        return spark.createDataFrame([], OUT)
    whiten = Whitener(n, sums, axes, values, trace)
    return C.mapped(rows, _rows(whiten, identity_error(fit, whiten)), OUT)


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

"""Embedding whitening from the exact characteristic polynomial of the integer scatter.

Components become whole numbers, so the scatter n * sum(x x') - S S' (n squared times the covariance, centred without any
rounding) is a matrix of whole numbers that Spark adds up exactly. Its characteristic polynomial is computed modulo many
primes, each by a Hessenberg reduction of its own (one prime is one row of a Spark job), and put together by Chinese
remaindering. All its roots are real and none is negative, so the sign changes of the polynomial shifted by ``a`` count the
roots above ``a`` exactly, with their multiplicity: bisection isolates each root to any precision. The components span the
null space of (scatter - root) and come from inverse iteration in long decimals; a root of multiplicity m, or m roots
equal in 120 bits, give m orthonormal vectors.
"""

from __future__ import annotations

import decimal
import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motorspark.llm.exact import DOUBLE, LIMBS, added, decimals, integers, largest, limb_batch
from motorspark.llm.vectors import finite, matrix

#: A cell's number is row * WIDE + column; the last column holds sums, and the last cell the number of rows.
WIDE = 1 << 24
#: A root is narrowed to this many bits; roots that are still together after the second number count as equal.
ROOT_BITS, EQUAL_BITS = 64, 120
DIGITS = 60


@dataclass(frozen=True)
class Whitening:
    """Number of rows, sums per dimension, unit components (one per row), their eigenvalues and shares of the trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray

    @property
    def weights(self) -> np.ndarray:
        return (self.components / np.sqrt(self.eigenvalues)[:, None]).T


# --- exact sums ---


def products(x: np.ndarray) -> np.ndarray:
    """x'x without rounding: by doubles in runs of rows whose sums stay exact, else by whole numbers of any size."""
    top = max(1, largest(x))
    rows = DOUBLE // (top * top)
    if x.dtype == object or rows < 64:
        x = x.astype(object)
        return x.T.dot(x)
    total = np.zeros((x.shape[1], x.shape[1]), object)
    for at in range(0, len(x), rows):
        run = x[at : at + rows].astype(np.float64)
        total = total + (run.T @ run).astype(np.int64)
    return total


def scatter_sums(rows: DataFrame, scale: int) -> tuple[int, list[int], list[list[int]]]:
    """Rows, sums per dimension and sums of products of floor(scale * x) over all ``vec``, exactly, in one pass."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, int] = {WIDE * WIDE: 0}
        for batch in batches:
            vec = batch.column("vec")
            dims = int(np.asarray(vec.value_lengths()).max(initial=0))
            x = integers(matrix(vec, dims), scale)
            totals[WIDE * WIDE] += len(x)
            for i, line in enumerate(products(x).tolist()):
                for j in range(i, dims):
                    totals[i * WIDE + j] = totals.get(i * WIDE + j, 0) + line[j]
            for i, s in enumerate(x.astype(object).sum(0).tolist() if dims else []):
                totals[i * WIDE + WIDE - 1] = totals.get(i * WIDE + WIDE - 1, 0) + s
        yield limb_batch(totals.items())

    found = added(rows.select("vec").mapInArrow(scan, LIMBS))
    dims = max((cell // WIDE + 1 for cell in found if cell < WIDE * WIDE), default=0)
    cells = [[found.get(min(i, j) * WIDE + max(i, j), 0) for j in range(dims)] for i in range(dims)]
    return found.get(WIDE * WIDE, 0), [found.get(i * WIDE + WIDE - 1, 0) for i in range(dims)], cells


# --- the characteristic polynomial ---


def is_prime(p: int) -> bool:
    """Miller and Rabin's test; these bases are proven for all numbers below 2^31."""
    if p < 2 or p % 2 == 0:
        return p == 2
    odd, twos = p - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, p)
        if base % p and x not in (1, p - 1) and not any((x := x * x % p) == p - 1 for _ in range(twos - 1)):
            return False
    return True


def primes(least: int) -> list[int]:
    """Primes below 2^31, the largest first, until their product is above ``least``."""
    out, product, p = [], 1, (1 << 31) + 1
    while product <= least:
        p -= 2
        if is_prime(p):
            out.append(p)
            product *= p
    return out


def polynomial_modulo(cells: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(x - cells) modulo p, the constant one first, by reduction to Hessenberg form."""
    h, d = cells.copy(), len(cells)
    for k in range(d - 2):
        found = np.flatnonzero(h[k + 1 :, k])
        if not len(found):
            continue
        pivot = k + 1 + int(found[0])
        if pivot != k + 1:
            h[[k + 1, pivot]] = h[[pivot, k + 1]]
            h[:, [k + 1, pivot]] = h[:, [pivot, k + 1]]
        factors = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - factors[:, None] * h[k + 1][None, :] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * factors[None, :] % p).sum(1)) % p
    known = np.zeros((d + 1, d + 1), np.int64)
    known[0, 0] = 1
    for k in range(1, d + 1):
        known[k, 1:] = known[k - 1, :-1]
        known[k] = (known[k] - h[k - 1, k - 1] * known[k - 1]) % p
        weights, chain = np.zeros(k - 1, np.int64), 1
        for i in range(k - 2, -1, -1):
            chain = chain * int(h[i + 1, i]) % p
            weights[i] = chain * int(h[i, k - 1]) % p
        if k > 1:
            known[k] = (known[k] - (weights[:, None] * known[: k - 1] % p).sum(0)) % p
    return known[d]


def characteristic_polynomial(spark: SparkSession, cells: list[list[int]]) -> list[int]:
    """Coefficients, the constant one first, of a symmetric matrix of whole numbers without negative eigenvalues."""
    d, trace = len(cells), sum(cells[i][i] for i in range(len(cells)))
    # no coefficient exceeds that of equal roots with the same trace
    bound = max(math.comb(d, k) * trace**k // d**k + 1 for k in range(d + 1))
    chosen = primes(4 * bound)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column("prime").to_pylist():
                found = polynomial_modulo(np.array([[c % p for c in line] for line in cells], np.int64), p)
                yield pa.record_batch([pa.array([p]), pa.array([found.tolist()], pa.list_(pa.int64()))], names=["prime", "found"])

    tasks = min(len(chosen), max(1, spark.sparkContext.defaultParallelism))
    table = spark.createDataFrame([(p,) for p in chosen], "prime long").repartition(tasks, "prime")
    modulus, out = math.prod(chosen), [0] * (d + 1)
    for row in table.mapInArrow(reduce, "prime long, found array<long>").collect():
        rest = modulus // row.prime
        share = rest * pow(rest, -1, row.prime)
        out = [(total + share * c) % modulus for total, c in zip(out, row.found, strict=True)]
    return [c - modulus if c > modulus // 2 else c for c in out]


# --- roots and components ---


def roots_above(polynomial: list[int], place: int, bits: int) -> int:
    """Roots above place / 2^bits, each as often as it counts: the sign changes after moving that point to zero.

    Descartes' rule gives the very number, as all roots are real.
    """
    d = len(polynomial) - 1
    shifted = [c << (bits * (d - k)) for k, c in enumerate(polynomial)]
    for i in range(d):
        for k in range(d - 1, i - 1, -1):
            shifted[k] += place * shifted[k + 1]
    signs = [c > 0 for c in shifted if c]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def isolated(polynomial: list[int], k: int) -> tuple[Fraction, int, int]:
    """The k-th largest root, how many are above its interval, and how many share it."""
    low, high, bits = 0, abs(polynomial[-2]) + 1, 0
    above, upto = 0, roots_above(polynomial, 0, 0)
    wanted = ROOT_BITS
    while True:
        if high - low > 1:
            middle = (low + high) // 2
            count = roots_above(polynomial, middle, bits)
            if count >= k:
                low, upto = middle, count
            else:
                high, above = middle, count
        else:
            # an interval whose width is the root's size over 2^wanted is narrow enough
            if low >> wanted:
                if upto - above == 1 or wanted >= EQUAL_BITS:
                    return Fraction(2 * low + 1, 2 << bits), above, upto - above
                wanted = min(EQUAL_BITS, wanted + 8)
            else:
                low, high, bits = low << 8, high << 8, bits + 8


def null_space(cells: list[list[int]], root: Fraction, size: int) -> np.ndarray:
    """``size`` orthonormal rows that (cells - root) all but annuls, by inverse iteration in long decimals."""
    d = len(cells)
    with decimal.localcontext(decimal.Context(prec=DIGITS, Emin=-(10**6), Emax=10**6)):
        number = decimal.Decimal(root.numerator) / decimal.Decimal(root.denominator)
        a = np.array([[decimal.Decimal(c) for c in line] for line in cells], object)
        a[np.arange(d), np.arange(d)] -= number
        least = max((abs(x) for x in a.ravel()), default=decimal.Decimal(1)).scaleb(-DIGITS) or decimal.Decimal(1)
        order = list(range(d))
        for k in range(d):
            pivot = max(range(k, d), key=lambda i: abs(a[i, k]))
            a[[k, pivot]] = a[[pivot, k]]
            order[k], order[pivot] = order[pivot], order[k]
            if abs(a[k, k]) < least:
                a[k, k] = least
            if k + 1 < d:
                a[k + 1 :, k] = a[k + 1 :, k] / a[k, k]
                a[k + 1 :, k + 1 :] -= np.outer(a[k + 1 :, k], a[k, k + 1 :])
        random = np.random.default_rng(11)
        found = [np.array([decimal.Decimal(int(x)) for x in random.integers(-1000, 1001, d)], object) for _ in range(size)]
        before: list = []
        for _ in range(60):
            for at, vector in enumerate(found):
                y = vector[order]
                for k in range(1, d):
                    y[k] -= a[k, :k].dot(y[:k])
                for k in range(d - 1, -1, -1):
                    y[k] = (y[k] - a[k, k + 1 :].dot(y[k + 1 :])) / a[k, k] if k + 1 < d else y[k] / a[k, k]
                y = y / max(abs(x) for x in y)
                for other in found[:at]:
                    y = y - other * other.dot(y)
                found[at] = y / y.dot(y).sqrt()
            # done once each vector lies in the span of the round before
            if before and all(1 - sum(v.dot(w) ** 2 for w in before) < decimal.Decimal(10) ** -40 for v in found):
                break
            before = [v.copy() for v in found]
        return np.array([[float(x) for x in v] for v in found])


def fit(vectors: DataFrame, scale: int = 64, components: int = 32, vec_col: str = "embedding") -> Whitening | None:
    """The whitening of all usable vectors, or None where no direction varies.

    Vectors that are null or hold null or non-finite entries take no part, shorter ones count as padded with zeros. Every
    entry x counts as floor(scale * x). Components are numbered by falling eigenvalue, at most ``components`` of them and only
    those with a positive one: a direction without variance cannot be whitened. A whole number added to every entry, as some
    callers do to keep them positive, changes no covariance and no deviation.
    """
    spark = vectors.sparkSession
    n, sums, second = scatter_sums(vectors.filter(finite(F.col(vec_col))).select(F.col(vec_col).alias("vec")), scale)
    scatter = [[n * c - sums[i] * sums[j] for j, c in enumerate(line)] for i, line in enumerate(second)]
    common = math.gcd(*(c for line in scatter for c in line)) if scatter else 0
    if not common:
        return None
    cells = [[c // common for c in line] for line in scatter]
    polynomial = characteristic_polynomial(spark, cells)
    positive = len(cells) - next(k for k, c in enumerate(polynomial) if c)
    count = min(components, positive)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column("k").to_pylist():
                root, above, size = isolated(polynomial, k)
                vector = null_space(cells, root, size)[k - above - 1]
                yield pa.record_batch([pa.array([k]), pa.array([f"{root}"]), pa.array([vector.tolist()], pa.list_(pa.float64()))], names=["k", "root", "vector"])

    tasks = min(count, max(1, spark.sparkContext.defaultParallelism))
    numbers = spark.createDataFrame([(k,) for k in range(1, count + 1)], "k long").repartition(tasks, "k")
    solved = sorted(numbers.mapInArrow(solve, "k long, root string, vector array<double>").collect(), key=lambda r: r.k)
    roots = [Fraction(r.root) for r in solved]
    trace = sum(cells[i][i] for i in range(len(cells)))
    return Whitening(
        n, sums, np.array([r.vector for r in solved]), np.array([float(r * common / (n * n)) for r in roots]), np.array([float(r / trace) for r in roots])
    )


def project(x: np.ndarray, model: Whitening) -> tuple[np.ndarray, np.ndarray]:
    """Deviations and whitened values of rows of whole numbers; the mean is taken off before anything is multiplied."""
    bound = model.n * largest(x) + max(map(abs, model.sums), default=0)
    if x.dtype != object and bound * bound * max(1, x.shape[1]) < 1 << 62:
        centred = model.n * x - np.array(model.sums, np.int64)
    else:
        centred = model.n * x.astype(object) - np.array(model.sums, object)
    return (centred * centred).sum(1), (centred.astype(np.float64) / model.n) @ model.weights


def identity_error(vectors: DataFrame, model: Whitening, scale: int = 64, vec_col: str = "embedding") -> float:
    """Largest absolute entry of (covariance of the whitened rows - identity), over all usable rows."""
    dims, r = len(model.sums), len(model.components)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(r), np.zeros((r, r))
        for batch in batches:
            values = project(integers(matrix(batch.column("vec"), dims), scale), model)[1]
            first += values.sum(0)
            second += values.T @ values
        cells = np.concatenate([second, first[:, None]], axis=1).ravel()
        yield pa.record_batch([pa.array(np.arange(len(cells))), pa.array(cells)], names=["cell", "value"])

    usable = vectors.filter(finite(F.col(vec_col))).select(F.col(vec_col).alias("vec"))
    sums = usable.mapInArrow(moments, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    table = np.zeros(r * (r + 1))
    for row in sums.collect():
        table[row.cell] = row.value / model.n
    table = table.reshape(r, r + 1)
    mean = table[:, -1]
    return float(np.abs(table[:, :-1] - np.outer(mean, mean) - np.eye(r)).max())


def whitened(vectors: DataFrame, model: Whitening | None, keep: tuple[str, ...], scale: int = 64, vec_col: str = "embedding") -> DataFrame:
    """One row per usable vector: ``row`` with the columns in ``keep``, ``deviation``, the array ``whitened``.

    ``deviation`` is sum((n * x - S)^2), exact as decimal(38, 0), null beyond 38 digits. Rows are as many as there are usable
    vectors, repeated and equal ones each with their own, null ids included. Other columns are not read. Without a model
    (an empty table, or one in which nothing varies) there are no components and so no rows.
    """
    usable = vectors.filter(finite(F.col(vec_col)) if model else F.lit(False)).select(F.struct(*keep).alias("row"), F.col(vec_col).alias("vec"))
    dims = len(model.sums) if model else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            deviation, values = project(integers(matrix(batch.column("vec"), dims), scale), model)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), values.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("row"), decimals(deviation), lists], names=["row", "deviation", "whitened"])

    schema = T.StructType().add(usable.schema["row"]).add("deviation", T.DecimalType(38, 0)).add("whitened", T.ArrayType(T.DoubleType()))
    return usable.mapInArrow(run, schema)

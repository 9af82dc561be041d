"""Whitening of integer vectors through the exact characteristic polynomial.

Entries become integers, floor(scale * c) + offset.  The fit list holds each distinct
vector once: n vectors with sums S.  Their scatter n * sum(x x') - S S' is an integer
matrix, n^2 times the covariance, and does not change with the offset, so it is summed
over x - offset, exactly: tasks sum products of batches whose sums are exact in double
or 64-bit arithmetic (Python integers beyond), and pass them on in limbs of 40 bits that
Spark adds up.

1. The characteristic polynomial of the scatter is computed modulo primes below 2^31, one
   row a prime in Spark: reduction to Hessenberg form by similarity, then the recurrence
   of its leading minors.  Chinese remaindering joins the residues; there are as many
   primes as Maclaurin's bound on the coefficients (from the trace) asks for, so the
   polynomial is exact.
2. A symmetric matrix has real roots only, and then Descartes' rule is exact: the number
   of roots above a is the number of sign changes of the coefficients of p(x + a).  The
   greatest roots are isolated by bisection with that count, multiplicities included, and
   each simple root is narrowed by the exact sign of p to ``BITS`` bits.
3. Components span the null space of scatter - root * I: inverse iteration with
   ``DIGITS`` decimal digits, one Spark row a root; a root of multiplicity m gets m
   orthonormal vectors.  Signs are fixed (the largest entry, the first on ties, is
   positive).

Only matrices go through the driver: d(d + 3) / 2 sums, d + 1 residues a prime.

Defined results: rows whose vector is null, empty, or holds a null or non-finite entry or one
whose integer exceeds 64 bits take no part; the dimension is the most common length of the
distinct vectors (the longer on ties), other lengths take no part; rows with a null id
and rows that repeat an id or a vector each get results; only roots above zero have
components, so fewer than two distinct vectors (or an empty table) give no rows; equal roots:
any orthonormal basis, the same for all rows; ``deviation`` is null where it exceeds 64
bits; other columns are not read.
"""

from __future__ import annotations

import decimal
import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import shared_table

#: Relative bits of a root, below which roots count as one, and digits of the iteration.
BITS, DIGITS = 160, 90
LIMB = 40
WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def integers(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """``vec_id, y``: floor(scale * c) of the rows that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("c"))
    held = F.forall("c", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * F.lit(float(scale))) < F.lit(9.2e18)))
    return rows.where((F.size("c") > 0) & held).select("vec_id", F.transform("c", lambda v: F.floor(v * F.lit(float(scale)))).alias("y"))


def _rows(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, dim)


def products(y: np.ndarray) -> np.ndarray:
    """y' y, exactly, as Python integers."""
    most = max(abs(int(y.max(initial=0))), abs(int(y.min(initial=0))))
    if most * most * len(y) < 1 << 53:
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    if most * most * len(y) < 1 << 63:
        return (y.T @ y).astype(object)
    big = y.astype(object)
    return big.T @ big


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    k = 0
    while not -(1 << LIMB) <= value < 1 << LIMB:
        yield k, value & ((1 << LIMB) - 1)
        value >>= LIMB
        k += 1
    yield k, value


def _partial(dim: int):
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, square = 0, np.zeros(dim, object), np.zeros((dim, dim), object)
        for b in batches:
            y = _rows(b.column("y"), dim)
            n += len(y)
            square = square + products(y)
            total = total + y.astype(object).sum(axis=0) if len(y) else total
        if n:
            cells = [(-1, -1, n)] + [(i, -1, int(total[i])) for i in range(dim)]
            cells += [(i, j, int(square[i, j])) for i in range(dim) for j in range(i, dim)]
            out = [(i, j, k, v) for i, j, value in cells for k, v in _limbs(value)]
            yield pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["i", "j", "k", "v"])

    return partial


def scatter_of(fit: DataFrame, dim: int) -> tuple[int, list[int], np.ndarray]:
    """n, the sums and the integer scatter of the vectors of ``fit``."""
    sums = fit.mapInArrow(_partial(dim), "i int, j int, k int, v long").groupBy("i", "j", "k").agg(F.sum("v").alias("v")).toArrow()
    n, total, square = 0, [0] * dim, np.zeros((dim, dim), object)
    for i, j, k, v in zip(*(sums.column(c).to_pylist() for c in ("i", "j", "k", "v"))):
        part = v << (LIMB * k)
        if i < 0:
            n += part
        elif j < 0:
            total[i] += part
        else:
            square[i, j] += part
    s = np.array(total, object)
    square = np.triu(square) + np.triu(square, 1).T
    return n, total, n * square - np.outer(s, s)


# characteristic polynomial ----------------------------------------------------


def is_prime(n: int) -> bool:
    """Miller-Rabin, certain below 3.2e9 with these bases."""
    if n % 2 == 0:
        return n == 2
    d, s = n - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    for a in (2, 3, 5, 7):
        if a % n == 0:
            continue
        x = pow(a, d, n)
        if x in (1, n - 1):
            continue
        for _ in range(s - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return n > 1


def primes_for(bound: int) -> list[int]:
    """Greatest primes below 2^31 whose product exceeds ``bound``."""
    out, product, p = [], 1, (1 << 31) - 1
    while product <= bound:
        if is_prime(p):
            out.append(p)
            product *= p
        p -= 2
    return out


def hessenberg_mod(m: np.ndarray, p: int) -> np.ndarray:
    """A Hessenberg matrix similar to m modulo p."""
    h = m.copy()
    d = len(h)
    for c in range(d - 2):
        below = np.flatnonzero(h[c + 1 :, c])
        if not len(below):
            continue
        pivot = c + 1 + int(below[0])
        if pivot != c + 1:
            h[[c + 1, pivot]] = h[[pivot, c + 1]]
            h[:, [c + 1, pivot]] = h[:, [pivot, c + 1]]
        u = h[c + 2 :, c] * pow(int(h[c + 1, c]), -1, p) % p
        h[c + 2 :] = (h[c + 2 :] - u[:, None] * h[c + 1] % p) % p
        h[:, c + 1] = (h[:, c + 1] + (h[:, c + 2 :] * u % p).sum(axis=1)) % p
    return h


def polynomial_mod(m: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(xI - m) modulo p, lowest power first."""
    h = hessenberg_mod(m, p)
    d = len(h)
    minors = np.zeros((d + 1, d + 1), np.int64)
    minors[0, 0] = 1
    for k in range(1, d + 1):
        row = np.zeros(d + 1, np.int64)
        row[1:] = minors[k - 1, :-1]
        below, factors = 1, np.zeros(k, np.int64)
        for i in range(k - 1, -1, -1):
            factors[i] = int(h[i, k - 1]) * below % p
            below = below * int(h[i, i - 1]) % p if i else 0
        minors[k] = (row - (factors[:, None] * minors[:k] % p).sum(axis=0)) % p
    return minors[d]


def characteristic_polynomial(spark: SparkSession, m: np.ndarray) -> list[int]:
    """Exact det(xI - m), lowest power first, of an integer positive semidefinite matrix."""
    d, trace = len(m), int(np.trace(m))
    bound = max(math.comb(d, k) * trace**k // d**k + 1 for k in range(d + 1))
    primes = primes_for(bound)
    held = spark.sparkContext.broadcast([[int(v) for v in row] for row in m])

    def residues(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.array(held.value, object)
        for b in batches:
            for p in b.column(0).to_pylist():
                got = polynomial_mod((whole % p).astype(np.int64), p)
                yield pa.record_batch([pa.array([p]), pa.array([got.tolist()], pa.list_(pa.int64()))], names=["p", "r"])

    parts = min(len(primes), max(1, spark.sparkContext.defaultParallelism))
    rows = spark.createDataFrame([(p,) for p in primes], "p long").repartition(parts).mapInArrow(residues, "p long, r array<long>")
    found = {r["p"]: r["r"] for r in rows.collect()}
    modulus = math.prod(primes)
    out = [0] * (d + 1)
    for p, r in found.items():
        others = modulus // p
        unit = others * pow(others, -1, p)
        out = [(a + unit * c) % modulus for a, c in zip(out, r)]
    # coefficient of x^(d - k) is (-1)^k times a non-negative symmetric function of the roots
    return [-((modulus - a) % modulus) if (d - i) % 2 else a for i, a in enumerate(out)]


# roots ------------------------------------------------------------------------


def roots_above(poly: list[int], num: int, bits: int) -> int:
    """Number of roots above num / 2^bits, with multiplicity, of a polynomial with real roots only."""
    d = len(poly) - 1
    c = [a << bits * (d - i) for i, a in enumerate(poly)]
    for i in range(d):
        for j in range(d - 1, i - 1, -1):
            c[j] += num * c[j + 1]
    signs = [a > 0 for a in c if a]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def sign_at(poly: list[int], num: int, bits: int) -> int:
    value, shift = 0, 0
    for a in reversed(poly):
        value = value * num + (a << shift)
        shift += bits
    return (value > 0) - (value < 0)


@dataclass
class Root:
    """num / 2^bits, with its multiplicity."""

    num: int
    bits: int
    times: int

    def decimal(self) -> Decimal:
        return Decimal(self.num) / Decimal(1 << self.bits)


def greatest_roots(poly: list[int], trace: int, most: int) -> list[Root]:
    """The ``most`` greatest positive roots (with multiplicity), greatest first."""
    zeros = next(i for i, a in enumerate(poly) if a)
    poly = poly[zeros:]  # roots at zero have no component
    width = (trace + 1).bit_length()
    out: list[Root] = []
    # intervals (num, num + 1] * 2^(width - depth) with their numbers of roots above both ends
    stack = [(0, 0, roots_above(poly, 0, 0), 0)] if len(poly) > 1 else []
    while stack and sum(r.times for r in out) < most:
        num, depth, above_low, above_high = stack.pop()
        count = above_low - above_high
        bits = depth - width
        if count == 1:
            out.append(narrowed(poly, num, bits, above_high))
            continue
        if num.bit_length() > BITS:
            out.append(Root(*_whole(2 * num + 1, bits + 1), count))
            continue
        middle = 2 * num + 1
        above = roots_above(poly, *_whole(middle, bits + 1))
        for low, a, b in ((2 * num, above_low, above), (middle, above, above_high)):
            if a > b:
                stack.append((low, depth + 1, a, b))
    return out


def _whole(num: int, bits: int) -> tuple[int, int]:
    """num / 2^bits with bits not negative."""
    return (num << -bits, 0) if bits < 0 else (num, bits)


def narrowed(poly: list[int], num: int, bits: int, above: int) -> Root:
    """The only root in (num, num + 1] / 2^bits, to BITS bits, by the sign of the polynomial."""
    side = -1 if above % 2 else 1
    while num.bit_length() <= BITS:
        num, bits = 2 * num, bits + 1
        sign = sign_at(poly, *_whole(num + 1, bits))
        if sign == 0:
            return Root(*_whole(num + 1, bits), 1)
        if sign != side:
            num += 1
    return Root(*_whole(2 * num + 1, bits + 1), 1)


# components -------------------------------------------------------------------


def null_vectors(m: list[list[int]], root: Root) -> list[list[float]]:
    """Orthonormal vectors of the null space of m - root * I, by inverse iteration."""
    with decimal.localcontext() as ctx:
        ctx.prec = DIGITS
        ctx.Emax, ctx.Emin = decimal.MAX_EMAX, decimal.MIN_EMIN
        d, shift = len(m), root.decimal()
        a = [[Decimal(v) for v in row] for row in m]
        for i in range(d):
            a[i][i] -= shift
        tiny = shift.scaleb(-DIGITS)
        order = list(range(d))
        for c in range(d):
            best = max(range(c, d), key=lambda r: abs(a[r][c]))
            a[c], a[best], order[c], order[best] = a[best], a[c], order[best], order[c]
            if not a[c][c]:
                a[c][c] = tiny
            pivot = a[c]
            for r in range(c + 1, d):
                row = a[r]
                f = row[c] = row[c] / pivot[c]
                if f:
                    row[c + 1 :] = [x - f * y for x, y in zip(row[c + 1 :], pivot[c + 1 :])]

        def solved(b: list[Decimal]) -> list[Decimal]:
            z = [b[i] for i in order]
            for i in range(d):
                z[i] -= sum((x * y for x, y in zip(a[i][:i], z)), Decimal(0))
            for i in range(d - 1, -1, -1):
                z[i] = (z[i] - sum((x * y for x, y in zip(a[i][i + 1 :], z[i + 1 :])), Decimal(0))) / a[i][i]
            return z

        def orthonormal(vs: list[list[Decimal]]) -> list[list[Decimal]]:
            out: list[list[Decimal]] = []
            for v in vs:
                for _ in range(2):
                    size = sum(x * x for x in v).sqrt()
                    v = [x / size for x in v]
                    for w in out:
                        dot = sum(x * y for x, y in zip(v, w))
                        v = [x - dot * y for x, y in zip(v, w)]
                size = sum(x * x for x in v).sqrt()
                out.append([x / size for x in v])
            return out

        # fixed starting vectors without pattern
        vs = [[Decimal((i + 1) * (t * 7919 + 104729) % 1009 - 504) + Decimal("0.5") for i in range(d)] for t in range(root.times)]
        for _ in range(3):
            vs = orthonormal([solved(v) for v in vs])
        out = []
        for v in vs:
            head = max(v, key=abs)
            out.append([float(x) if head > 0 else -float(x) for x in v])
        return out


def components_of(spark: SparkSession, m: np.ndarray, roots: list[Root]) -> np.ndarray:
    """Unit vectors of the roots, one a row, in the order of the roots."""
    held = spark.sparkContext.broadcast([[int(v) for v in row] for row in m])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in b.column(0).to_pylist():
                got = null_vectors(held.value, roots[at])
                yield pa.record_batch([pa.array([at] * len(got)), pa.array(range(len(got)), pa.int64()), pa.array(got, pa.list_(pa.float64()))], names=["at", "t", "v"])

    rows = spark.range(len(roots), numPartitions=len(roots)).mapInArrow(vectors, "at long, t long, v array<double>").collect()
    return np.array([r["v"] for r in sorted(rows, key=lambda r: (r["at"], r["t"]))])


# whitening --------------------------------------------------------------------


@dataclass
class Whitening:
    """Fitted state: n, sums (without the offset), unit vectors and eigenvalues."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    roots: np.ndarray
    explained: np.ndarray

    def centred(self, y: np.ndarray) -> np.ndarray:
        """n * y - sums, exactly."""
        most = max(abs(int(y.max(initial=0))), abs(int(y.min(initial=0))))
        big = most * self.n + max(map(abs, self.sums)) >= 1 << 62
        kind = object if big else np.int64
        return y.astype(kind) * self.n - np.array(self.sums, kind)

    def whiten(self, y: np.ndarray) -> np.ndarray:
        # einsum sums each row in the same order, so equal vectors have equal results
        return np.einsum("ij,kj->ik", self.centred(y).astype(np.float64) / self.n, self.vectors) / np.sqrt(self.roots)

    def deviations(self, y: np.ndarray) -> list[int | None]:
        """Squared length of n * y - sums."""
        c = self.centred(y)
        if c.dtype != object and max(abs(int(c.max(initial=0))), abs(int(c.min(initial=0)))) ** 2 * c.shape[1] < 1 << 63:
            return (c * c).sum(axis=1).tolist()
        sums = ((c.astype(object)) ** 2).sum(axis=1)
        return [v if v < 1 << 63 else None for v in sums]


def fit_list(rows: DataFrame) -> tuple[DataFrame, int]:
    """The distinct vectors (written once) and their dimension."""
    fit = shared_table(rows.select("y").distinct(), "fit")
    sizes = fit.groupBy(F.size("y").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    dim = sizes["d"] if sizes else 0
    return fit.where(F.size("y") == dim), dim


def fit_whitening(fit: DataFrame, dim: int, most: int) -> Whitening | None:
    """Whitening by the ``most`` greatest components; None without a root above zero."""
    if not dim:
        return None
    spark = fit.sparkSession
    n, sums, scatter = scatter_of(fit, dim)
    unit = math.gcd(*(int(v) for v in scatter.ravel()))
    if not unit:
        return None
    m = scatter // unit
    trace = int(np.trace(m))
    roots = greatest_roots(characteristic_polynomial(spark, m), trace, most)
    vectors = components_of(spark, m, roots)[:most]
    each = [r for r in roots for _ in range(r.times)][:most]
    with decimal.localcontext() as ctx:
        ctx.prec = DIGITS
        eig = np.array([float(r.decimal() * unit / n / n) for r in each])
        share = np.array([float(r.decimal() / trace) for r in each])
    return Whitening(n, sums, vectors, eig, share)


def identity_error(fit: DataFrame, dim: int, model: Whitening) -> float:
    """Largest entry of the covariance of the whitened fit list minus the identity."""
    k = len(model.roots)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, square = np.zeros(k), np.zeros((k, k))
        for b in batches:
            w = model.whiten(_rows(b.column("y"), dim))
            total += w.sum(axis=0)
            square += w.T @ w
        at = [(i, -1, total[i]) for i in range(k)] + [(i, j, square[i, j]) for i in range(k) for j in range(i, k)]
        i, j, v = zip(*at)
        yield pa.record_batch([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(v, pa.float64())], names=["i", "j", "v"])

    # the projections are centred already; what their sums still hold is taken off
    sums = fit.mapInArrow(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    got = {(r["i"], r["j"]): r["v"] / model.n for r in sums}
    return max(abs(v - got[i, -1] * got[j, -1] - (i == j)) for (i, j), v in got.items() if j >= 0)


def whitened(vectors: DataFrame, *, scale: int = 64, most: int = 16, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per vector that takes part and component, greatest eigenvalue first.

    The results do not change with an offset added to every integer entry."""
    spark = vectors.sparkSession
    rows = integers(vectors, id_col, vec_col, scale)
    fit, dim = fit_list(rows)
    model = fit_whitening(fit, dim, most)
    if model is None:
        return spark.createDataFrame([], WHITENED)
    error, k = identity_error(fit, dim, model), len(model.roots)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y, n = _rows(b.column("y"), dim), b.num_rows
            ids = b.column("vec_id").take(pa.array(np.repeat(np.arange(n), k)))
            far = pa.array(model.deviations(y), pa.int64()).take(pa.array(np.repeat(np.arange(n), k)))
            cols = [
                ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, model.n)), far,
                pa.array(model.whiten(y).ravel()), pa.array(np.tile(model.explained, n)), pa.array(np.full(n * k, error)),
            ]
            yield pa.record_batch(cols, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.where(F.size("y") == dim).mapInArrow(projected, WHITENED)

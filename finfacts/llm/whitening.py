"""Whitening of embeddings with components from the exact characteristic polynomial of their integer scatter matrix.

Entries become whole numbers x, so n * sum(x x') - S S' (n times n the covariance) is a matrix of whole numbers, summed
exactly. Its characteristic polynomial is found modulo many primes (Hessenberg form), one Spark row per prime, and put
together by Chinese remaindering. All its roots are real, so the sign changes of its coefficients after a shift by ``a``
tell exactly how many roots lie above ``a``: roots are isolated by that count and refined by the polynomial's sign.
Components come from inverse iteration beside each root in decimal arithmetic, one Spark row per group of close roots.
"""

from __future__ import annotations

import decimal
import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from finfacts.llm.common import Scratch, batch_rows, ship

ROOT_BITS = 110          # relative precision of the roots
_DIGITS = 90             # of the arithmetic of inverse iteration
_CLOSE = Fraction(1, 10 ** 12)   # roots this near, relatively, are one group


def usable(vector: Column) -> Column:
    """Whether a vector and all its entries are there and finite."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < F.lit(math.inf)))


def whole_numbers(col: pa.Array, scale: float, dims: int) -> np.ndarray:
    """(rows, dims) longs floor(scale * c); missing trailing entries count as 0."""
    lengths = np.diff(np.asarray(col.offsets))
    flat = np.floor(np.asarray(col.flatten(), np.float64) * scale)
    if len(flat) and not np.abs(flat).max() < 2.0 ** 62:
        raise ValueError("an embedding's scaled entry does not fit 62 bits")
    if (lengths == dims).all():
        return flat.astype(np.int64).reshape(-1, dims)
    out = np.zeros((len(lengths), dims), np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _products(y: np.ndarray) -> np.ndarray:
    """Exact sum of y y' over the rows, as Python integers where float64 can't hold it."""
    top = int(np.abs(y).max(initial=0))
    if top * top * max(len(y), 1) < 1 << 53:
        return (y.T.astype(np.float64) @ y.astype(np.float64)).astype(np.int64).astype(object)
    # Limbs of 20 bits: exact products of small parts, put together as Python integers.
    limbs, rest = [], y
    while True:
        low = rest & ((1 << 20) - 1)
        limbs.append(low.astype(np.float64))
        rest = rest >> 20
        if not rest.any() or (rest == -1).all():
            break
        if len(limbs) == 3:
            break
    limbs.append(rest.astype(np.float64))
    out = np.zeros((y.shape[1], y.shape[1]), object)
    for s in range(0, len(y), 1 << 9):
        for i, a in enumerate(limbs):
            for j, b in enumerate(limbs):
                out = out + (a[s:s + 512].T @ b[s:s + 512]).astype(np.int64).astype(object) * (1 << 20 * (i + j))
    return out


def _scatter(scale: float, dims: int):
    """Per task: rows, sums and products of the whole numbers; exact."""
    def run(batches):
        n, s, p = 0, np.zeros(dims, object), np.zeros((dims, dims), object)
        for b in batch_rows(batches):
            y = whole_numbers(b.column(0), scale, dims)
            n, p = n + len(y), p + _products(y)
            s = s + np.array([int(v) for v in y.sum(axis=0)] if np.abs(y).max(initial=0) < 1 << 40 else
                             [sum(map(int, c)) for c in y.T], object)
        i, j = np.triu_indices(dims)
        values = [n, *s, *p[i, j]]
        yield pa.RecordBatch.from_arrays([
            pa.array([-1] + [-1] * dims + list(map(int, i)), pa.int32()), pa.array([-1] + list(range(dims)) + list(map(int, j)), pa.int32()),
            pa.array([decimal.Decimal(int(v)) for v in values], pa.decimal128(38, 0))], names=["i", "j", "v"])
    return run


def primes_below(limit: int):
    """Primes under ``limit`` (under 2**32), falling."""
    small = [q for q in range(2, 1 << 16) if all(q % r for r in range(2, math.isqrt(q) + 1))]
    for x in range(limit - 1, 2, -1):
        if x % 2 and all(x % q for q in small if q * q <= x):
            yield x


def charpoly_mod(rows: list[list[int]], p: int) -> list[int]:
    """Coefficients of det(x I - m) modulo the prime ``p`` < 2**31, constant term first."""
    h = np.array([[v % p for v in r] for r in rows], np.int64).reshape(len(rows), len(rows))
    d = len(h)
    for j in range(d - 2):                                   # Hessenberg form by similar matrices
        below = np.flatnonzero(h[j + 1:, j])
        if not len(below):
            continue
        i = j + 1 + below[0]
        if i != j + 1:
            h[[i, j + 1]] = h[[j + 1, i]]
            h[:, [i, j + 1]] = h[:, [j + 1, i]]
        u = h[j + 2:, j] * pow(int(h[j + 1, j]), -1, p) % p
        h[j + 2:] = (h[j + 2:] - u[:, None] * h[j + 1] % p) % p
        h[:, j + 1] = (h[:, j + 1] + (h[:, j + 2:] * u % p).sum(axis=1)) % p
    polys = np.zeros((d + 1, d + 1), np.int64)               # of the leading blocks
    polys[0, 0] = 1
    for k in range(1, d + 1):
        factor, t = np.zeros(k, np.int64), 1
        factor[k - 1] = h[k - 1, k - 1]
        for i in range(k - 2, -1, -1):
            t = t * int(h[i + 1, i]) % p
            if not t:
                break
            factor[i] = int(h[i, k - 1]) * t % p
        polys[k, 1:] = polys[k - 1, :-1]
        polys[k] = (polys[k] - (factor[:, None] * polys[:k] % p).sum(axis=0)) % p
    return [int(c) for c in polys[d]]


def elementary_sums(spark: SparkSession, m: list[list[int]]) -> list[int]:
    """e_0 .. e_d of the eigenvalues of a positive semi-definite integer matrix: det(x I - m) = sum (-1)^k e_k x^(d-k)."""
    d, trace = len(m), sum(m[i][i] for i in range(len(m)))
    # e_k is largest where all eigenvalues are equal (Maclaurin); never negative, so residues give it directly.
    bound = max(math.comb(d, k) * (-(-trace // d)) ** k for k in range(d + 1))
    primes, product = [], 1
    for p in primes_below(1 << 31):
        primes.append(p)
        product *= p
        if product > bound:
            break
    sent = spark.sparkContext.broadcast(m)

    def run(batches):
        for b in batches:
            ps = b.column(0).to_pylist()
            if ps:
                yield pa.RecordBatch.from_arrays([pa.array(ps, pa.int64()), pa.array([charpoly_mod(sent.value, p) for p in ps], pa.list_(pa.int64()))], names=["p", "c"])

    width = max(1, min(len(primes), spark.sparkContext.defaultParallelism))
    found = spark.createDataFrame([(p,) for p in primes], "p long").repartition(width).mapInArrow(run, "p long, c array<long>").collect()
    out = [0] * (d + 1)
    for r in found:
        rest = product // r["p"]
        weight = rest * pow(rest, -1, r["p"])
        for k in range(d + 1):
            out[k] += weight * ((-1) ** k * r["c"][d - k] % r["p"])
    return [v % product for v in out]


class RealRoots:
    """Roots of sum (-1)^k e_k x^(d-k), all real and none negative, on a grid of ``2**-shift``."""

    def __init__(self, e: list[int], shift: int):
        d = len(e) - 1
        self.coef = [(-1) ** k * e[k] << shift * k for k in range(d + 1)]     # highest power first, x counted in 2**-shift
        self.shift = shift

    def above(self, a: int) -> int:
        """How many roots, by multiplicity, are greater than ``a``: sign changes after the shift (exact, as all are real)."""
        c = list(self.coef)
        for end in range(len(c), 1, -1):
            for i in range(1, end):
                c[i] += a * c[i - 1]
        signs = [v > 0 for v in c if v]
        return sum(x != y for x, y in zip(signs, signs[1:]))

    def sign(self, a: int) -> int:
        v = 0
        for c in self.coef:
            v = v * a + c
        return (v > 0) - (v < 0)

    def largest(self, k: int, top: int) -> list[int]:
        """The ``k`` largest positive roots, falling, as grid points at or just above them; ``top`` is no less than any."""
        out, todo = [], [(0, top, self.above(0), 0)]
        while todo and len(out) < k:
            lo, hi, n_lo, n_hi = todo.pop()                  # n_lo - n_hi roots in (lo, hi]
            n = n_lo - n_hi
            if n == 0:
                continue
            if n == 1:
                at_hi = self.sign(hi)
                if at_hi:                                    # else hi is the root
                    while (hi - lo) << ROOT_BITS > hi and hi - lo > 1:
                        mid = (lo + hi) // 2
                        s = self.sign(mid)
                        if s == at_hi or s == 0:
                            hi = mid
                            if s == 0:
                                break
                        else:
                            lo = mid
                out.append(hi)
            elif hi - lo == 1 or (hi - lo) << ROOT_BITS <= hi:
                out.extend([hi] * n)
            else:
                mid = (lo + hi) // 2
                n_mid = self.above(mid)
                todo += [(lo, mid, n_lo, n_mid), (mid, hi, n_mid, n_hi)]
        return out[:k]


def largest_roots(e: list[int], k: int) -> list[Fraction]:
    """The ``k`` largest positive roots, or all positive ones, falling, to ``ROOT_BITS`` bits each."""
    positive = max(i for i, v in enumerate(e) if v)          # the rest are 0
    k, shift = min(k, positive), max(0, ROOT_BITS + 30 - e[1].bit_length())
    while k:
        roots = RealRoots(e, shift).largest(k, e[1] << shift)
        if roots[-1].bit_length() > ROOT_BITS:
            return [Fraction(r, 1 << shift) for r in roots]
        shift += ROOT_BITS + 30
    return []


def null_vectors(m: list[list[int]], roots: list[Fraction]) -> list[list[float]]:
    """Orthonormal eigenvectors of ``m`` for a group of close roots, by inverse iteration beside each root."""
    with decimal.localcontext() as ctx:
        ctx.prec, ctx.Emax, ctx.Emin = _DIGITS, decimal.MAX_EMAX, decimal.MIN_EMIN
        d, found = len(m), []
        dec = [[decimal.Decimal(v) for v in r] for r in m]
        for number, root in enumerate(roots):
            at = decimal.Decimal(root.numerator) / decimal.Decimal(root.denominator)
            at += at.scaleb(-32)                             # never the root itself: the matrix stays regular
            a = [[v - at if i == j else v for j, v in enumerate(r)] for i, r in enumerate(dec)]
            order, steps = list(range(d)), []
            for c in range(d):                               # elimination with row exchange
                best = max(range(c, d), key=lambda r: abs(a[r][c]))
                a[c], a[best] = a[best], a[c]
                order[c], order[best] = order[best], order[c]
                tail = a[c][c + 1:]
                for r in range(c + 1, d):
                    f = a[r][c] / a[c][c]
                    if f:
                        a[r][c + 1:] = [x - f * y for x, y in zip(a[r][c + 1:], tail)]
                    a[r][c] = f
            v = [decimal.Decimal(1 + (7919 * (i + 1) * (number + 1)) % 1009) / 1009 for i in range(d)]
            for _ in range(4):
                for w in found:
                    dot = sum(x * y for x, y in zip(v, w))
                    v = [x - dot * y for x, y in zip(v, w)]
                x = [v[i] for i in order]
                for i in range(d):
                    x[i] -= sum(a[i][j] * x[j] for j in range(i))
                for i in range(d - 1, -1, -1):
                    x[i] = (x[i] - sum(a[i][j] * x[j] for j in range(i + 1, d))) / a[i][i]
                size = sum(c * c for c in x).sqrt()
                v = [c / size for c in x]
            for w in found:
                dot = sum(x * y for x, y in zip(v, w))
                v = [x - dot * y for x, y in zip(v, w)]
            size = sum(c * c for c in v).sqrt()
            found.append([c / size for c in v])
        out = []
        for v in found:
            lead = max(v, key=abs)
            out.append([float(c if lead > 0 else -c) for c in v])
        return out


def components(spark: SparkSession, m: list[list[int]], k: int) -> tuple[list[Fraction], list[list[float]]]:
    """The ``k`` largest positive eigenvalues, falling, and their unit eigenvectors of a positive semi-definite integer matrix."""
    roots = largest_roots(elementary_sums(spark, m), k)
    groups: list[list[Fraction]] = []
    for r in roots:
        if groups and groups[-1][-1] - r <= r * _CLOSE:
            groups[-1].append(r)
        else:
            groups.append([r])
    sent = spark.sparkContext.broadcast(m)

    def run(batches):
        for b in batches:
            for g, rs in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                vs = null_vectors(sent.value, [Fraction(r) for r in rs])
                yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([vs], pa.list_(pa.list_(pa.float64())))], names=["g", "v"])

    if not groups:
        return [], []
    rows = spark.createDataFrame([(i, [str(r) for r in g]) for i, g in enumerate(groups)], "g int, roots array<string>")
    found = rows.repartition(len(groups), "g").mapInArrow(run, "g int, v array<array<double>>").collect()   # k vectors
    return roots, [list(v) for r in sorted(found, key=lambda r: r["g"]) for v in r["v"]]


def _project(scale: float, shift: int, n: int, sums: list[int], vectors: list[list[float]], roots: list[Fraction]):
    """Rows of (id, deviation, whitened values)."""
    dims = len(sums)
    s = np.array(sums, object)
    with decimal.localcontext() as ctx:
        ctx.prec = 50
        root = np.array([float((decimal.Decimal(r.numerator) / decimal.Decimal(r.denominator)).sqrt()) for r in roots])
    vec = np.array(vectors)
    small_sums = max(map(abs, sums)) < 1 << 61

    def run(batches):
        for b in batch_rows(batches):
            x = whole_numbers(b.column(1), scale, dims) + shift
            top = int(np.abs(x).max(initial=0))
            if small_sums and top * n < 1 << 61:
                dev = x * n - s.astype(np.int64)
                reach = int(np.abs(dev).max(initial=0))
                total = ((dev * dev).sum(axis=1).tolist() if reach * reach * dims < 1 << 63
                         else [sum(int(v) ** 2 for v in r) for r in dev])
            else:
                dev = x.astype(object) * n - s
                total = [sum(v * v for v in r) for r in dev]
            # The projection of n x - S over the root of n n e: sums are compensated, as the parts nearly cancel.
            out = dev.astype(np.float64) @ vec.T / root
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array([t if t < 1 << 63 else None for t in total], pa.int64()),
                pa.array(list(out), pa.list_(pa.float64()))], names=["id", "deviation", "w"])
    return run


def _moments(batches):
    """Per task: sums of whitened values and of their products."""
    s = p = None
    for b in batch_rows(batches):
        w = np.array(b.column(0).to_pylist())
        s, p = (w.sum(axis=0), w.T @ w) if s is None else (s + w.sum(axis=0), p + w.T @ w)
    if s is not None:
        k = len(s)
        i, j = np.triu_indices(k)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.full(k, -1), i]), pa.int32()), pa.array(np.concatenate([np.arange(k), j]), pa.int32()),
                                          pa.array(np.concatenate([s, p[i, j]]), pa.float64())], names=["i", "j", "v"])


def whiten(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = 8, scale: int = 1024, shift: int = 100000) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every usable vector.

    Entries c become x = floor(scale c) + shift. The covariance of all usable vectors' x (divisor n, centred) has its
    components numbered from 1 by falling eigenvalue, up to ``k`` and as far as eigenvalues are positive; a component's
    largest entry is positive. deviation: sum over dimensions of (n x - S)^2, exact (null where it passes 64 bits).
    explained: the eigenvalue's share of the trace. identity_error: largest entry, by size, of the covariance of the
    whitened values minus the identity, over all rows.

    Vectors that are null or hold null or non-finite entries are left out; shorter vectors count 0 in the missing
    entries. Repeated rows and null ids stay rows of their own; among equal eigenvalues any orthonormal components
    count. No usable vector, or no variance, gives no rows. Other columns are not read. What the driver handles is
    dims x dims numbers, whatever the rows.
    """
    spark = df.sparkSession
    ship(spark)
    scratch = Scratch(spark, "whiten")
    rows = df.select(F.col(f"`{vec_id}`").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v")).where(usable(F.col("v")))
    schema = f"vec_id {df.schema[vec_id].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    dims = rows.agg(F.max(F.size("v"))).first()[0] or 0
    if not dims:
        return spark.createDataFrame([], schema)
    sums = rows.select("v").mapInArrow(_scatter(float(scale), dims), "i int, j int, v decimal(38,0)").groupBy("i", "j").agg(F.sum("v").alias("v"))
    got = {(r["i"], r["j"]): int(r["v"]) for r in sums.collect()}          # dims x dims numbers
    n, s = got[(-1, -1)], [got[(-1, j)] for j in range(dims)]
    m = [[n * got[(min(i, j), max(i, j))] - s[i] * s[j] for j in range(dims)] for i in range(dims)]
    trace = sum(m[i][i] for i in range(dims))
    if trace == 0:
        return spark.createDataFrame([], schema)
    roots, vectors = components(spark, m, k)
    total = [v + n * shift for v in s]
    id_type = df.schema[vec_id].dataType.simpleString()
    white = scratch.write(rows.select("id", "v").mapInArrow(_project(float(scale), shift, n, total, vectors, roots),
                                                            f"id {id_type}, deviation long, w array<double>"), "whitened")
    mom = {(r["i"], r["j"]): r["v"] for r in white.select("w").mapInArrow(_moments, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()}
    error = max(abs(mom[(i, j)] / n - mom[(-1, i)] * mom[(-1, j)] / n / n - (i == j)) for i in range(len(roots)) for j in range(i, len(roots)))
    share = F.array(*[F.lit(float(r / trace)) for r in roots])
    return white.select("id", "deviation", F.posexplode("w").alias("c", "whitened")).select(
        F.col("id").alias("vec_id"), (F.col("c") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        "whitened", share[F.col("c")].alias("explained"), F.lit(float(error)).alias("identity_error"))

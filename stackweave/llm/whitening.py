"""Embedding whitening: principal components from the exact characteristic polynomial of the integer scatter.

1. Entries become integers x. Tasks sum the products of all dimensions exactly: x is cut into limbs of ``LIMB`` bits whose
   products numpy's matrix product holds exactly in a double for ``ROWS`` rows; Spark adds the tasks' sums as decimals. So
   the driver gets one number for each pair of dimensions and of limbs, whatever the rows.
2. M = n * sum(x x') - S S' is n * n times the covariance and has integer entries. Tasks reduce it to Hessenberg form modulo
   one prime each and read off the characteristic polynomial there; Chinese remainders give the exact polynomial, with
   enough primes for the largest coefficient that the trace allows.
3. Its roots are real. By the sign changes of the polynomial moved to a point (exact for real roots) the roots above that
   point are counted, and bisection in binary fractions pins down each of the largest ones to ``BITS`` bits.
4. Components come from inverse iteration on M minus the root, in fixed point of ``BITS`` bits, two steps from one start; a
   root that occurs several times gets an orthogonal set of them.
5. Rows are projected in one pass; the whitened columns' covariance is then measured over all rows, centred.

Defined results: rows whose vector is null or has null or non-finite entries go; so do vectors whose length is not the most
frequent one (of equally frequent lengths the longest counts), and vectors of length 0 have no components; entries whose
x would leave the range of a long are cut to it; of a component without variance whitened is null, and identity_error is taken over the
others (0 without any); explained is null where all variance is 0; deviation is null beyond the range of a long; repeated
rows count and come back each; a null vec_id is kept; an empty table gives no rows; other columns are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, slices

COMPONENTS = 8
SCALE, OFFSET = 1024, 100_000
LIMB = 20  # bits
ROWS = 1 << 12  # (2 ** LIMB) ** 2 * ROWS stays below 2 ** 53
FLUSH = 1 << 10  # products of so many blocks are added up in a long before they go out
BITS = 192
LONG = 1 << 63


def integers(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * c) + OFFSET; SCALE * c is cut to the range from which the offset doesn't leave a long."""
    top = float(LONG - (OFFSET // 1024 + 1) * 1024)
    return np.clip(np.floor(values.astype(np.float64) * SCALE), -float(LONG), top).astype(np.int64) + OFFSET


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """x as limbs of LIMB bits, lowest first and the last signed, as doubles; only as many as the values need."""
    out, rest = [], x
    while max(int(rest.max()), -1 - int(rest.min())) >> LIMB:
        out.append((rest & ((1 << LIMB) - 1)).astype(np.float64))
        rest = rest >> LIMB
    return [*out, rest.astype(np.float64)]


def matrix_of(column: pa.Array, dims: int) -> np.ndarray:
    return integers(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))


def usable(embeddings: DataFrame, vector_col: str) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return embeddings.filter(F.col(vector_col).isNotNull()).withColumn(vector_col, v).filter(~bad)


def scatter(rows: DataFrame, dims: int, vector_col: str) -> tuple[list[int], list[list[int]]]:
    """Exact sums of each dimension and of each product of two."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        blocks = 0

        def out() -> Iterator[pa.RecordBatch]:
            for (p, q), total in held.items():
                i, j = np.nonzero(total)
                parts = [pa.array(a.astype(np.int32)) for a in (i, j, np.full(len(i), p + q))]
                yield pa.RecordBatch.from_arrays([*parts, pa.array(total[i, j].astype(np.int64))], names=["i", "j", "p", "s"])
            held.clear()

        for whole in batches:
            for batch in slices(whole, ROWS):
                if not batch.num_rows:
                    continue
                x = matrix_of(batch.column(0), dims)
                parts = [np.hstack([np.full((len(x), 1), 1.0 if k == 0 else 0.0), part]) for k, part in enumerate(limbs(x))]  # the first column sums
                for p, a in enumerate(parts):
                    for q, b in enumerate(parts):
                        product = (a.T @ b).astype(np.int64)
                        held[p, q] = held[p, q] + product if (p, q) in held else product
                blocks += 1
                if blocks % FLUSH == 0:
                    yield from out()
        yield from out()

    got = rows.select(vector_col).mapInArrow(sums, "i int, j int, p int, s long").groupBy("i", "j", "p").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    total = [[0] * (dims + 1) for _ in range(dims + 1)]
    for r in got:  # (dims + 1) ** 2 rows for each power of the limbs
        total[r.i][r.j] += int(r.s) << (LIMB * r.p)
    return total[0][1:], [row[1:] for row in total[1:]]


def prime(n: int) -> bool:
    """For n below 3,215,031,751."""
    if n < 2 or any(n % p == 0 for p in (2, 3, 5, 7)):
        return n in (2, 3, 5, 7)
    d, s = n - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    for base in (2, 3, 5, 7):
        x = pow(base, d, n)
        if x in (1, n - 1):
            continue
        for _ in range(s - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes(bits: int) -> list[int]:
    """Primes below 2 ** 31 whose product has more than so many bits."""
    out, have, n = [], 0.0, (1 << 31) - 1
    while have <= bits:
        if prime(n):
            out.append(n)
            have += math.log2(n) - 1e-9
        n -= 2
    return out


def polynomial_modulo(matrix: np.ndarray, p: int) -> list[int]:
    """Coefficients of det(t - matrix) modulo p, lowest first: Hessenberg form by similar row and column steps, then the
    recurrence over its leading blocks. Entries stay below 2 ** 31, so products fit a long."""
    a = matrix % p
    n = len(a)
    for k in range(1, n - 1):
        below = np.nonzero(a[k:, k - 1])[0]
        if not len(below):
            continue
        r = k + int(below[0])
        if r != k:
            a[[k, r]] = a[[r, k]]
            a[:, [k, r]] = a[:, [r, k]]
        factor = a[k + 1 :, k - 1] * pow(int(a[k, k - 1]), -1, p) % p
        a[k + 1 :] = (a[k + 1 :] - factor[:, None] * a[k][None, :] % p) % p
        a[:, k] = (a[:, k] + (a[:, k + 1 :] * factor[None, :] % p).sum(axis=1)) % p
    polys = [np.array([1], np.int64)]
    for k in range(n):
        new = np.zeros(k + 2, np.int64)
        new[1:] = polys[k]
        new[:-1] = (new[:-1] - int(a[k, k]) * polys[k]) % p
        run = 1
        for i in range(k - 1, -1, -1):
            run = run * int(a[i + 1, i]) % p
            if not run:
                break
            new[: i + 1] = (new[: i + 1] - int(a[i, k]) * run % p * polys[i]) % p
        polys.append(new)
    return [int(c) for c in polys[n]]


def characteristic(spark: SparkSession, m: list[list[int]]) -> list[int]:
    """The exact characteristic polynomial of a positive semi-definite integer matrix, lowest coefficient first."""
    dims = len(m)
    trace = sum(m[i][i] for i in range(dims))
    # elementary symmetric functions of non-negative roots are at most C(d, k) * (trace / d) ** k
    most = max(math.comb(dims, k) * (-(-trace // dims)) ** k for k in range(dims + 1))
    moduli = primes(most.bit_length() + 2)
    sent = spark.sparkContext.broadcast(m)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column(0).to_pylist():
                reduced = np.array([[v % p for v in row] for row in sent.value], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([polynomial_modulo(reduced, p)], pa.list_(pa.int64()))], names=["p", "c"])

    asked = spark.createDataFrame(pa.table({"p": moduli})).repartition(min(len(moduli), 2 * spark.sparkContext.defaultParallelism))
    found = {r.p: r.c for r in asked.mapInArrow(reduce, "p long, c array<long>").collect()}  # dims + 1 numbers for each prime
    whole = math.prod(moduli)
    out = [0] * (dims + 1)
    for p in moduli:
        rest = whole // p
        unit = rest * pow(rest, -1, p)
        for k, c in enumerate(found[p]):
            out[k] += c * unit
    return [v - whole if (v := c % whole) > whole // 2 else v for c in out]


def above(poly: list[int], at: int, shift: int) -> int:
    """How many roots, counted as often as they occur, lie above at / 2 ** shift: sign changes of the polynomial moved there."""
    n = len(poly) - 1
    c = [v << (shift * (n - k)) for k, v in enumerate(poly)]  # roots times 2 ** shift
    for i in range(n):
        for k in range(n - 1, i - 1, -1):
            c[k] += at * c[k + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def value_sign(poly: list[int], at: int, shift: int) -> int:
    v, n = 0, len(poly) - 1
    for k in range(n, -1, -1):
        v = v * at + (poly[k] << (shift * (n - k)))
    return (v > 0) - (v < 0)


def largest_roots(poly: list[int], count: int) -> list[tuple[Fraction, int]]:
    """The largest positive roots, falling, each with the number of times that it occurs; all roots are real and not negative.
    Roots that share ``BITS`` leading bits count as one."""
    zeros = next(k for k, c in enumerate(poly) if c)
    poly = poly[zeros:]
    n = len(poly) - 1
    top = -poly[n - 1] + 1 if n else 0  # beyond the trace
    out: list[tuple[Fraction, int]] = []
    done = 0
    while done < min(count, n):
        lo, hi, shift = 0, top, 0  # over 2 ** shift; the root sought is in (lo, hi]
        beyond_lo, beyond_hi = n, 0
        sign = 0
        while hi - lo > 1 or hi.bit_length() < BITS:
            if beyond_lo - beyond_hi == 1 and not sign:  # simple: from here on signs suffice
                sign = value_sign(poly, hi, shift)
                if not sign:
                    break
            if hi - lo == 1:
                lo, hi, shift = 2 * lo, 2 * hi, shift + 1
            mid = (lo + hi) // 2
            if sign:
                s = value_sign(poly, mid, shift)
                if not s:
                    hi = mid
                    break
                lo, hi = (lo, mid) if s == sign else (mid, hi)
            else:
                k = above(poly, mid, shift)
                if k > done:
                    lo, beyond_lo = mid, k
                else:
                    hi, beyond_hi = mid, k
        out.append((Fraction(hi, 1 << shift), beyond_lo - done))
        done = beyond_lo
    return out


def null_vectors(m: list[list[int]], root: Fraction, many: int) -> list[list[int]]:
    """Orthogonal vectors in fixed point (BITS bits) near the null space of m - root, by inverse iteration."""
    n = len(m)
    one = 1 << BITS
    a = np.array([[v * one for v in row] for row in m], dtype=object)
    for i in range(n):
        a[i, i] -= int(root * one)
    order = list(range(n))
    for k in range(n):  # elimination with row pivots; factors are kept below the diagonal
        r = k + max(range(n - k), key=lambda i: abs(a[k + i, k]))
        if r != k:
            a[[k, r]] = a[[r, k]]
            order[k], order[r] = order[r], order[k]
        if not a[k, k]:
            a[k, k] = 1
        if k + 1 < n:
            factor = (a[k + 1 :, k] << BITS) // a[k, k]
            a[k + 1 :, k + 1 :] -= (factor[:, None] * a[k, k + 1 :][None, :]) >> BITS
            a[k + 1 :, k] = factor

    def solve(b: np.ndarray) -> np.ndarray:
        y = b[order].copy()
        for k in range(1, n):
            y[k] -= int(a[k, :k] @ y[:k]) >> BITS
        for k in range(n - 1, -1, -1):
            y[k] = ((y[k] - (int(a[k, k + 1 :] @ y[k + 1 :]) >> BITS)) << BITS) // a[k, k]
        return y

    def unit(v: np.ndarray, others: list[np.ndarray]) -> np.ndarray | None:
        big = max(abs(int(c)) for c in v).bit_length()
        v = np.array([int(c) << (2 * BITS - big) if big < 2 * BITS else int(c) >> (big - 2 * BITS) for c in v], dtype=object)
        length = math.isqrt(int(v @ v))
        v = (v << BITS) // length
        for _ in range(2):
            for o in others:
                v = v - ((o * (int(o @ v) >> BITS)) >> BITS)
        length = math.isqrt(int(v @ v))
        return (v << BITS) // length if length >> (BITS // 2) else None  # None: nothing beyond the others

    found: list[np.ndarray] = []
    seed = 0
    while len(found) < many:
        # starts with all entries different, so that none is orthogonal to what is sought but by accident
        v = unit(np.array([one + one // (2 + (i * 7 + seed * 13) % (2 * n + 3)) * (-1) ** ((i >> (seed % 6)) & 1) for i in range(n)], dtype=object), found)
        seed += 1
        for _ in range(3):
            v = v if v is None else unit(solve(v), found)
        if v is not None:
            found.append(v)
    return [[int(c) for c in v] for v in found]


def whiten(embeddings: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row for each vector and component."""
    spark = embeddings.sparkSession
    rows = usable(embeddings.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector")), "vector")
    by_length = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    shape = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    kind = embeddings.schema[id_col].dataType.simpleString()
    shape = shape.replace("vec_id long", f"vec_id {kind}")
    if not by_length or not by_length[0].d:
        return spark.createDataFrame([], shape)
    dims, n = by_length[0].d, by_length[0]["count"]
    rows = rows.filter(F.size("vector") == dims)
    sums, products = scatter(rows, dims, "vector")
    m = [[n * products[i][j] - sums[i] * sums[j] for j in range(dims)] for i in range(dims)]
    trace = sum(m[i][i] for i in range(dims))
    kept: list[tuple[Fraction, np.ndarray]] = []
    if trace:
        for root, many in largest_roots(characteristic(spark, m), components):
            for v in null_vectors(m, root, min(many, components - len(kept))):
                kept.append((root, np.array([c / (1 << BITS) for c in v])))
    kept += [(Fraction(0), np.zeros(dims))] * (min(components, dims) - len(kept))  # no variance is left: nothing to scale by
    axes = np.array([v for _, v in kept]).T
    # (n * x - S) is n times the centred vector, and roots are n * n times eigenvalues
    width = np.array([math.sqrt(r) if r else np.nan for r, _ in kept])
    explained = [float(r / trace) if trace else None for r, _ in kept]
    fits = n < 1 << 31 and max(map(abs, sums)) < 1 << 62

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.array(sums, dtype=np.int64) if fits else np.array(sums, dtype=object)
        for whole in batches:
            for batch in slices(whole, ROWS):
                if not batch.num_rows:
                    continue
                x = matrix_of(batch.column(1), dims)
                if fits and np.abs(x.astype(np.float64)).max() * n < 2.0**62:
                    off = x * n - total
                else:
                    off = x.astype(object) * n - np.array(sums, dtype=object)
                near = off.astype(np.float64)
                if (near * near).sum(axis=1).max() < 2.0**62 and off.dtype != object:
                    deviation = (off * off).sum(axis=1).tolist()
                else:
                    exact = [sum(int(c) ** 2 for c in row) for row in off]
                    deviation = [v if v < LONG else None for v in exact]
                w = near @ axes / width
                flat = pa.array(w.ravel(), mask=np.isnan(w.ravel()))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32)), flat)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviation, pa.int64()), lists], names=["vec_id", "deviation", "w"])

    wide = materialize(rows.mapInArrow(project, f"vec_id {kind}, deviation long, w array<double>"), "whitened")
    live = [k for k, (r, _) in enumerate(kept) if r]
    error = 0.0
    if live:
        pairs = [F.covar_pop(F.col("w")[i], F.col("w")[j]).alias(f"c{i}_{j}") for i in live for j in live if i <= j]
        got = wide.agg(*pairs).first()
        error = max(abs(got[f"c{i}_{j}"] - (i == j)) for i in live for j in live if i <= j)
    shares = F.array(*[F.lit(e).cast("double") for e in explained])
    out = wide.select("vec_id", "deviation", F.posexplode("w").alias("k", "whitened"))
    return out.select(
        "vec_id",
        (F.col("k") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        shares[F.col("k")].alias("explained"),
        F.lit(float(error)).alias("identity_error"),
    )

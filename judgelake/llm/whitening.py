"""Whitening of vectors by pivoted Cholesky and one-sided Jacobi (operator 11)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from judgelake.llm.common import cut, one_row, table, tree_merge

COMPONENTS = 8
SCALE, OFFSET = 1024, 100_000
#: Products of integers below this square stay inside 63 bits when a vector's are summed.
SAFE = 1 << 62


def _entries(col: pa.Array, dim: int) -> np.ndarray:
    """The vectors of a list column as rows of doubles."""
    flat = pc.list_flatten(col).to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), dim)


def quantised(values: np.ndarray) -> np.ndarray:
    """floor(1024 c) + 100000 as 64-bit integers."""
    return np.floor(values * SCALE).astype(np.int64) + OFFSET


def usable(vec_col: str):
    """Is a vector there, of finite entries whose integers 64 bits can hold?"""
    v = F.col(f"`{vec_col}`")
    return v.isNotNull() & (F.size(v) > 0) & F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) <= F.lit(2.0 ** 52)))


@dataclass(frozen=True)
class Moments:
    """n vectors and the exact sums of their integers."""
    n: int
    sums: tuple[int, ...]


def _sum_rows(x: np.ndarray) -> list[int]:
    """Exact column sums: 64 bits where they suffice, else in two halves."""
    if len(x) * float(np.abs(x).max()) < SAFE:
        return x.sum(axis=0).tolist()
    high, low = x >> 31, x & ((1 << 31) - 1)
    return [(h << 31) + l for h, l in zip(high.sum(axis=0).tolist(), low.sum(axis=0).tolist())]


def moments(vectors: DataFrame, dim: int) -> Moments:
    """Exact n and sums over all rows of ``vectors`` (v array<double>), a partial row from each task."""
    wide = 16  # bytes of one exact sum

    def pack(n: int, sums: list[int]) -> bytes:
        return n.to_bytes(8, "little") + b"".join(s.to_bytes(wide, "little", signed=True) for s in sums)

    def unpack(z: bytes) -> tuple[int, list[int]]:
        return int.from_bytes(z[:8], "little"), [int.from_bytes(z[k:k + wide], "little", signed=True) for k in range(8, len(z), wide)]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * dim
        for b in batches:
            if b.num_rows:
                n += b.num_rows
                sums = [s + t for s, t in zip(sums, _sum_rows(quantised(_entries(b.column(0), dim))))]
        yield one_row(pack(n, sums))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * dim
        for b in batches:
            for z in b.column(0).to_pylist():
                m, more = unpack(z)
                n, sums = n + m, [s + t for s, t in zip(sums, more)]
        yield one_row(pack(n, sums))

    n, sums = unpack(tree_merge(vectors.mapInArrow(part, "z binary"), merge))
    return Moments(n, tuple(sums))


def centred(x: np.ndarray, m: Moments) -> tuple[np.ndarray, np.ndarray]:
    """(x - S/n unrounded as doubles, exact sums of (n x - S)^2 as an object array of integers)."""
    top = m.n * int(np.abs(x).max(initial=0)) + max(map(abs, m.sums))
    if top < SAFE:
        y = m.n * x - np.array(m.sums, np.int64)
        largest = int(np.abs(y).max(initial=0))
        if largest ** 2 * x.shape[1] < SAFE:
            return y / m.n, (y * y).sum(axis=1).astype(object)
        if largest < SAFE:
            # the squares in limbs of 31 bits
            high, low = np.abs(y) >> 31, np.abs(y) & ((1 << 31) - 1)
            if x.shape[1] < 1 << 10 and int(high.max(initial=0)) < 1 << 26:
                squares = [(a * b).sum(axis=1).astype(object) for a, b in ((high, high), (high, low))]
                lows = low * low
                small = (lows >> 31).sum(axis=1).astype(object) * (1 << 31) + (lows & ((1 << 31) - 1)).sum(axis=1).astype(object)
                return y / m.n, squares[0] * (1 << 62) + squares[1] * (1 << 32) + small
    y = x.astype(object) * m.n - np.array(m.sums, object)
    return (y / m.n).astype(np.float64), (y * y).sum(axis=1)


def scatter(vectors: DataFrame, dim: int, m: Moments) -> np.ndarray:
    """Covariance, divisor n: every row is centred before it is multiplied; one matrix of the dimension's
    square leaves each task and a tree of tasks adds them."""
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for b in batches:
            if b.num_rows:
                z = centred(quantised(_entries(b.column(0), dim)), m)[0]
                total += z.T @ z
        yield one_row(total.tobytes())

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dim * dim)
        for b in batches:
            for z in b.column(0):
                total += np.frombuffer(z.as_buffer())
        yield one_row(total.tobytes())

    return np.frombuffer(tree_merge(vectors.mapInArrow(part, "z binary"), merge)).reshape(dim, dim) / m.n


def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, factor): a[order][:, order] = factor @ factor.T, factor lower trapezoidal with as many columns
    as the rank; the largest remaining diagonal entry is the next pivot."""
    a, d = np.array(a), len(a)
    order, factor = np.arange(d), np.zeros((d, d))
    left = a.diagonal().copy()
    stop = left.max(initial=0.0) * d * 8 * np.finfo(float).eps
    for k in range(d):
        j = k + int(left[k:].argmax())
        if left[j] <= stop:
            return order, factor[:, :k]
        if j != k:
            for x in (order, left, factor, a):
                x[[k, j]] = x[[j, k]]
            a[:, [k, j]] = a[:, [j, k]]
        root = np.sqrt(left[k])
        factor[k, k] = root
        factor[k + 1:, k] = (a[k + 1:, k] - factor[k + 1:, :k] @ factor[k, :k]) / root
        left[k + 1:] -= factor[k + 1:, k] ** 2
    return order, factor


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """Rotate pairs of columns until all are orthogonal. A round turns disjoint pairs together;
    the rounds of a tournament meet every pair once a sweep."""
    x = np.array(factor.T)  # columns as rows
    n = len(x)
    if n < 2:
        return x.T
    seats = list(range(n + n % 2))
    tolerance = 4 * np.finfo(float).eps
    for _ in range(sweeps):
        turned = False
        for _ in range(len(seats) - 1):
            half = len(seats) // 2
            pairs = np.array([(min(p, q), max(p, q)) for p, q in zip(seats[:half], seats[::-1]) if max(p, q) < n])
            seats = [seats[0], seats[-1], *seats[1:-1]]
            p, q = x[pairs[:, 0]], x[pairs[:, 1]]
            alpha, beta, gamma = (p * p).sum(1), (q * q).sum(1), (p * q).sum(1)
            due = np.abs(gamma) > tolerance * np.sqrt(alpha * beta)
            if not due.any():
                continue
            turned = True
            pairs, p, q = pairs[due], p[due], q[due]
            zeta = (beta[due] - alpha[due]) / (2 * gamma[due])
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = (1 / np.hypot(1.0, t))[:, None]
            s = c * t[:, None]
            x[pairs[:, 0]], x[pairs[:, 1]] = c * p - s * q, s * p + c * q
        if not turned:
            return x.T
    raise ArithmeticError("the rotations did not settle")


def principal(covariance: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit components as columns), ``count`` at most and never more than the rank.
    A component's largest entry is positive."""
    order, factor = pivoted_cholesky(covariance)
    turned = one_sided_jacobi(factor)
    norms = np.sqrt((turned ** 2).sum(axis=0))
    best = np.argsort(-norms, kind="stable")[:count]
    rows = np.zeros((len(covariance), len(best)))
    rows[order] = turned[:, best] / norms[best]
    flip = np.sign(rows[np.abs(rows).argmax(axis=0), np.arange(len(best))]) if len(best) else 1.0
    return norms[best] ** 2, rows * flip


def whiten(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", count: int = COMPONENTS) -> DataFrame:
    """vec_id, n, deviation string (exact, any number of digits), whitened array<double>, explained array<double>, identity_error: each
    usable vector on the leading components of all usable vectors.

    Three passes over the vector column: exact sums; the scatter of centred rows; the projections, which are
    written once. The error is measured on what was written. The driver sees one row and one matrix of the
    dimension's square. Defined cases: vectors that are null, empty, hold null or non-finite entries, or
    entries over 2**52 (their integers leave the exact range) are dropped; of different lengths the most frequent
    (of equals the greatest) counts and the others are dropped too; repeated rows and null ids count each;
    there are never more components than the rank, so equal vectors have none; other columns are left
    out whatever their names; an empty table gives no rows.
    """
    spark = rows.sparkSession
    src = rows.where(usable(vec_col)).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"),
                                             F.col(f"`{vec_col}`").cast("array<double>").alias("v"))
    schema = ("vec_id long, n long, deviation string, whitened array<double>, explained array<double>, "
              "identity_error double")
    sizes = src.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"))
    first = sizes.orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()  # one row
    if not first:
        return spark.createDataFrame([], schema)
    dim = first[0]["dim"]
    src = src.where(F.size("v") == dim)
    vectors = src.select("v")
    m = moments(vectors, dim)
    covariance = scatter(vectors, dim, m)
    values, components = principal(covariance, count)
    rank = len(values)
    if not rank:
        return spark.createDataFrame([], schema)
    turn = components / np.sqrt(values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z, deviation = centred(quantised(_entries(b.column(1), dim)), m)
            white = z @ turn
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(map(str, deviation.tolist()), pa.string()),
                 pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * rank, pa.int32()), pa.array(white.ravel()))],
                ["vec_id", "deviation", "whitened"])

    done = cut(src.mapInArrow(project, "vec_id long, deviation string, whitened array<double>"), "whitened")
    means = done.select(*[F.avg(F.col("whitened")[k]).alias(f"m{k}") for k in range(rank)]).first()
    away = [F.col("whitened")[k] - F.lit(means[k]) for k in range(rank)]
    pairs = [(i, j) for i in range(rank) for j in range(i, rank)]
    second = done.select(*[F.avg(away[i] * away[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    error = max(abs(c - (i == j)) for c, (i, j) in zip(second, pairs))
    share = (values / covariance.trace()).tolist()
    return done.select("vec_id", F.lit(m.n).cast("long").alias("n"), "deviation", "whitened", F.array(*map(F.lit, share)).alias("explained"), F.lit(float(error)).alias("identity_error"))


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    """One row per vector and component. A deviation beyond 64 bits is null as a long; deviation_exact always holds its digits."""
    return whiten(table(spark, sf_dir, "embeddings")).select(
        "*", F.posexplode("whitened").alias("_k", "_w")).select(
        "vec_id", (F.col("_k") + 1).alias("component"), "n", F.col("deviation").try_cast("bigint").alias("deviation"),
        F.col("_w").alias("whitened"), F.col("explained")[F.col("_k")].alias("explained"), "identity_error",
        F.col("deviation").alias("deviation_exact"))

"""Whitening of embeddings by the leading eigenvectors of their covariance, found by slicing.

The sums and the products of the centred vectors are added up by Spark, one small matrix for each
task's rows. What the driver works on is a matrix of the vectors' dimension, whatever the number of
rows. There the spectrum is sliced: an LDL' factorisation of the covariance less a shift has as many
positive pivots as there are eigenvalues above the shift, so halving an interval isolates the k-th
largest. Rayleigh quotient iteration then converges cubically from inside the interval, and two more
counts, just above and below the value, certify that it is the k-th. Eigenvalues that agree to
rounding are taken together; their vectors are made orthogonal to those found before.

Rows: a vector that is missing or empty, holds missing or non-finite entries, or entries whose
whole number does not fit 2 ** 53, is dropped. The remaining vectors must have one length; where
they do not, the length that most of them have (the greater of equally frequent ones) is taken and
the others are dropped. Components whose eigenvalue is zero to rounding are left out, so equal
vectors, or one vector, have no rows. Repeated rows are answered each. No rows give no rows. Only
``vec_id`` and ``embedding`` are read, whatever other columns there are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narracode.session import write_table

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
#: Entries beyond this have no exact whole number in a double.
EXACT = float(1 << 53)


# ------------------------------------------------ spectrum


def inertia(a: np.ndarray) -> int:
    """Number of positive eigenvalues of a symmetric matrix, by an LDL' factorisation with pivots
    of one or two rows (the partial pivoting of Bunch and Kaufman). A pivot of zero to rounding
    counts as not positive."""
    a = np.array(a, float)
    n, k, positive = len(a), 0, 0
    alpha = (1 + 17**0.5) / 8
    while k < n:
        col = np.abs(a[k + 1 :, k])
        most = col.max(initial=0.0)
        if most == 0:
            positive += a[k, k] > 0
            k += 1
            continue
        size, swap = 1, k
        if abs(a[k, k]) < alpha * most:
            r = k + 1 + int(col.argmax())
            row = np.abs(a[r, k:])
            row[r - k] = 0
            if abs(a[k, k]) * row.max() >= alpha * most**2:
                pass
            elif abs(a[r, r]) >= alpha * row.max():
                swap = r
            else:
                size, swap = 2, r
        at = k + size - 1
        if swap != at:
            a[[at, swap]] = a[[swap, at]]
            a[:, [at, swap]] = a[:, [swap, at]]
        d, low = a[k : k + size, k : k + size], a[k + size :, k : k + size]
        if size == 1:
            positive += d[0, 0] > 0
            a[k + 1 :, k + 1 :] -= np.outer(low[:, 0] / d[0, 0], low[:, 0])
        else:
            positive += 1  # such a block has a negative determinant
            a[k + 2 :, k + 2 :] -= low @ np.linalg.solve(d, low.T)
        k += size
    return int(positive)


def above(v: np.ndarray, shift: float) -> int:
    """Number of eigenvalues of ``v`` above ``shift``."""
    return inertia(v - shift * np.eye(len(v)))


def slice_spectrum(v: np.ndarray, count: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues of a positive semi-definite matrix, those that are zero to
    rounding left out, and their unit eigenvectors as columns."""
    n, scale = len(v), float(np.trace(v))
    if not scale > 0:
        return np.zeros(0), np.zeros((n, 0))
    v = v / scale
    rounding = 8 * n * np.finfo(float).eps
    values, vectors = np.zeros(0), np.zeros((n, 0))
    top = float(np.abs(v).sum(axis=1).max(initial=0.0)) + rounding
    rng = np.random.default_rng(0)
    for k in range(min(count, n)):
        if above(v, rounding) <= k:
            break
        low, high = rounding, top if k == 0 else values[-1] + 2 * rounding
        while True:
            # more than k eigenvalues lie above low, and k at most above high
            while high - low > rounding and not (above(v, low) == k + 1 and above(v, high) == k):
                middle = (low + high) / 2
                low, high = (middle, high) if above(v, middle) > k else (low, middle)
            value, vector = _rayleigh(v, low, high, vectors, rng, rounding)
            if above(v, value - rounding) > k >= above(v, value + rounding):
                break  # the counts certify the number
            if high - low <= rounding:
                raise ArithmeticError("an eigenvalue could not be numbered")
            middle = (low + high) / 2
            low, high = (middle, high) if above(v, middle) > k else (low, middle)
        values, vectors = np.append(values, value), np.column_stack([vectors, vector])
    return values * scale, vectors


def _rayleigh(v: np.ndarray, low: float, high: float, found: np.ndarray, rng: np.random.Generator, rounding: float) -> tuple[float, np.ndarray]:
    """Rayleigh quotient iteration from a random start, orthogonal to the vectors found. While the
    quotient lies outside the interval the shift is its middle, which draws the iteration in."""
    n = len(v)
    middle = (low + high) / 2
    x = rng.normal(size=n)
    best = (np.inf, middle, x)
    for _ in range(200):
        for _ in range(2):
            x = x - found @ (found.T @ x)
        x = x / np.linalg.norm(x)
        value = float(x @ v @ x)
        residual = float(np.linalg.norm(v @ x - value * x))
        inside = low - rounding <= value <= high + rounding
        if inside and residual < best[0]:
            stalled = residual > best[0] / 2
            best = (residual, value, x)
        else:
            stalled = True
        if stalled and best[0] <= rounding:
            break
        shifted = v - (value if inside else middle) * np.eye(n)
        try:
            x = np.linalg.solve(shifted, x)
        except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last bit
            x = np.linalg.solve(shifted + rounding / n * np.eye(n), x)
        x = x / np.abs(x).max() if np.isfinite(x).all() else rng.normal(size=n)
    return best[1], best[2] / np.linalg.norm(best[2])


# ------------------------------------------------ vectors


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """``vec_id, _x``: the entries of the remaining vectors as whole numbers."""
    v = F.col("embedding").cast("array<double>")
    x = F.transform(v, lambda c: F.floor(c * SCALE) + SHIFT)
    usable = (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) * SCALE < EXACT))
    rows = vectors.select(F.col("vec_id"), F.when(F.coalesce(usable, F.lit(False)), x).alias("_x"))
    rows = write_table(rows.filter(F.col("_x").isNotNull()), "whole_numbers")
    lengths = rows.groupBy(F.size("_x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return rows.filter(F.size("_x") == lengths[0].d) if lengths else rows


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index("_x"))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def sums(rows: DataFrame) -> tuple[int, list[int]]:
    """The number of vectors and the exact sums of their entries."""
    exploded = rows.select(F.posexplode("_x").alias("i", "x"))
    found = exploded.groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()
    return (found[0].n if found else 0), [int(r.s) for r in found]


def centred(x: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    """``n x - S`` exactly: in 64 bits where they are enough, else in Python's integers."""
    most = int(np.abs(x).max(initial=0))
    if n * most + max(map(abs, s)) < 2**62:
        return n * x - np.array(s, np.int64)
    return n * x.astype(object) - np.array(s, object)


def _quotients(deviation: np.ndarray, n: int) -> np.ndarray:
    return (deviation / n).astype(float)


def covariance(rows: DataFrame, n: int, s: list[int]) -> np.ndarray:
    """The covariance with divisor ``n``. Every task centres its vectors before it multiplies them
    and hands on one matrix, as rows, however many vectors it has."""

    def products(batches):
        total = np.zeros((len(s), len(s)))
        for batch in batches:
            z = _quotients(centred(_matrix(batch), n, s), n)
            total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(range(len(s)), pa.int32()), pa.array(list(total))], names=["i", "p"])

    parts = rows.select("_x").mapInArrow(products, "i int, p array<double>").select("i", F.posexplode("p").alias("j", "p"))
    found = parts.groupBy("i", "j").agg(F.sum("p").alias("p")).toPandas()
    v = np.zeros((len(s), len(s)))
    v[found.i, found.j] = found.p / n
    return (v + v.T) / 2


def project(rows: DataFrame, n: int, s: list[int], values: np.ndarray, vectors: np.ndarray) -> DataFrame:
    """``vec_id, _d, _big, _y``: the exact sum of squared deviations, as a long where it fits and
    as text, and the whitened entries."""
    axes = vectors / np.sqrt(values)
    kind = rows.schema["vec_id"].dataType.simpleString()

    def whiten(batches):
        for batch in batches:
            deviation = centred(_matrix(batch), n, s)
            y = _quotients(deviation, n) @ axes
            if deviation.dtype != object and np.max(np.abs(deviation.astype(float)), initial=0.0) ** 2 * len(s) < 2.0**62:
                exact = (deviation * deviation).sum(axis=1).tolist()
            else:
                exact = [sum(int(c) ** 2 for c in row) for row in deviation]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([d if d < 2**63 else None for d in exact], pa.int64()),
                    pa.array([str(d) for d in exact], pa.string()),
                    pa.array(list(y), pa.list_(pa.float64())),
                ],
                names=["vec_id", "_d", "_big", "_y"],
            )

    return rows.mapInArrow(whiten, f"vec_id {kind}, _d long, _big string, _y array<double>")


def identity_error(white: DataFrame, n: int, k: int) -> float:
    """The largest entry of the covariance of the whitened rows less the identity; their means
    are taken off before they are multiplied."""
    means = white.agg(*[F.sum(F.get("_y", F.lit(i))).alias(f"m{i}") for i in range(k)]).first()
    of = [F.get("_y", F.lit(i)) - F.lit(float(means[i]) / n) for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    products = white.agg(*[F.sum(of[i] * of[j]).alias(f"p{i}_{j}") for i, j in pairs]).first()
    return max(abs(p / n - (i == j)) for (i, j), p in zip(pairs, products, strict=True))


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error, deviation_text`` of
    every remaining vector and component.

    ``whitened`` is the centred vector projected on the component over the root of its eigenvalue,
    ``explained`` the eigenvalue's share of the trace. ``deviation`` is missing where the exact sum
    does not fit a long; ``deviation_text`` always holds it.
    """
    rows = whole_numbers(vectors)
    n, s = sums(rows)
    v = covariance(rows, n, s) if n else np.zeros((0, 0))
    values, axes = slice_spectrum(v, components)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    if not len(values):
        empty = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_text string"
        return vectors.sparkSession.createDataFrame([], empty)
    white = write_table(project(rows, n, s, values, axes), "whitened")
    error = identity_error(white, n, len(values))
    shares = F.array(*[F.lit(float(e / np.trace(v))) for e in values])
    out = white.select("*", F.posexplode("_y").alias("_k", "whitened"))
    return out.select(
        "vec_id",
        (F.col("_k") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        F.col("_d").alias("deviation"),
        "whitened",
        F.get(shares, F.col("_k")).alias("explained"),
        F.lit(error).alias("identity_error"),
        F.col("_big").alias("deviation_text"),
    )

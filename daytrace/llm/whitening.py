"""Whitening of embeddings by spectral divide and conquer on their covariance."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch

EPS = np.finfo(float).eps
#: Integers up to here times a sum of as many dimensions as any embedding has fit 64 bits.
SMALL = 1 << 20


# spectral divide and conquer of one small symmetric matrix ------------------------------------------


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix: the matrix sign, by QDWH iterations.

    Dynamically weighted Halley steps in their inverse-free form; the lower bound ``low`` of the
    singular values is driven to 1, which takes about six steps for any conditioning.
    """
    m = len(a)
    x = a / np.linalg.norm(a)
    low = max(1.0 / np.linalg.norm(np.linalg.inv(x)), EPS) if _regular(x) else EPS
    for _ in range(30):
        d = (4 * (1 - low**2) / low**4) ** (1 / 3)
        root = math.sqrt(1 + d)
        wa = root + 0.5 * math.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - low**2) / (low**2 * root)))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([math.sqrt(wc) * x, np.eye(m)]))
        new = (wb / wc) * x + (wa - wb / wc) / math.sqrt(wc) * q[:m] @ q[m:].T
        new = (new + new.T) / 2
        low = min(1.0, low * (wa + wb * low**2) / (1 + wc * low**2))
        moved, x = np.linalg.norm(new - x), new
        if abs(1 - low) < 10 * EPS and moved < (5 * EPS) ** (1 / 3):
            break
    return x


def _regular(x: np.ndarray) -> bool:
    return 1 / np.linalg.cond(x, 1) > EPS


def _split(a: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant subspaces above and below a shift, or None if no shift
    separates them cleanly."""
    m, d = len(a), np.sort(np.diag(a))
    gaps = np.diff(d)
    middle = range(max(0, m // 4 - 1), max(1, 3 * m // 4))
    at = max(middle, key=lambda i: gaps[i])
    spread = np.linalg.norm(a - np.eye(m) * d.mean())
    # a shift strictly between two diagonal entries has eigenvalues on either side
    shifts = [(d[at] + d[at + 1]) / 2, float(np.median(d)), d.mean()]
    shifts += [d.mean() + f * spread for f in (0.01, -0.01, 0.1, -0.1, 0.3, -0.3)]
    best = None
    for shift in shifts:
        sign = polar(a - shift * np.eye(m))
        k = round((np.trace(sign) + m) / 2)
        if not 0 < k < m:
            continue
        projector = (sign + np.eye(m)) / 2
        # the columns of largest norm span the range; one more step makes the basis exact
        columns = np.argsort(-np.linalg.norm(projector, axis=0), kind="stable")
        q = _basis(projector, columns, k)
        if q is None:
            continue
        full, _ = np.linalg.qr(np.hstack([q, (np.eye(m) - projector)[:, columns[::-1]]]))
        upper, lower = full[:, :k], full[:, k:m]
        left = np.linalg.norm(lower.T @ a @ upper)
        if best is None or left < best[0]:
            best = left, upper, lower
        if left <= 16 * m * EPS * scale:
            break
    return None if best is None or best[0] > 1e-10 * scale else best[1:]


def _basis(projector: np.ndarray, columns: np.ndarray, k: int) -> np.ndarray | None:
    """k orthonormal columns that span the range of a projector: pivoted Gram-Schmidt on its columns,
    then one step of subspace iteration."""
    work, chosen = projector.copy(), []
    for _ in range(k):
        norms = np.linalg.norm(work, axis=0)
        j = columns[int(np.argmax(norms[columns]))]
        if norms[j] < 1e-8:
            return None
        v = work[:, j] / norms[j]
        chosen.append(v)
        work -= np.outer(v, v @ work)
    q, _ = np.linalg.qr(projector @ np.array(chosen).T)
    return q


def components(a: np.ndarray, wanted: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix.

    Polar factors of the shifted matrix give projectors on the eigenvectors above and below the shift;
    the matrix is restricted to both ranges and split again until a block is a single value or a
    multiple of the identity.  With ``wanted``, blocks that lie below that many components stay
    unsplit and are left out.  Each vector's largest entry (the first of equals) is positive.
    """
    a = (a + a.T) / 2
    scale = float(np.linalg.norm(a)) or 1.0
    wanted = len(a) if wanted is None else min(wanted, len(a))
    found: list[tuple[float, np.ndarray]] = []
    todo = [np.eye(len(a))]  # bases of disjoint subspaces, those of larger values last
    while todo and len(found) < wanted:
        v = todo.pop()
        b = v.T @ a @ v
        b = (b + b.T) / 2
        m = len(b)
        off = np.linalg.norm(b - np.diag(np.diag(b)))
        parts = None if m == 1 or off <= 4 * m * EPS * scale else _split(b, scale)
        if parts is None:
            # already diagonal, or values so close that any basis serves
            order = np.argsort(-np.diag(b), kind="stable")
            found += [(float(b[i, i]), v[:, i]) for i in order]
        else:
            todo += [v @ parts[1], v @ parts[0]]
    found = sorted(found, key=lambda p: -p[0])[:wanted]
    values = np.array([p[0] for p in found])
    vectors = np.array([p[1] / np.linalg.norm(p[1]) for p in found]).reshape(len(found), len(a)).T
    for j in range(vectors.shape[1]):
        if vectors[np.argmax(np.abs(vectors[:, j])), j] < 0:
            vectors[:, j] *= -1
    return values, vectors


# the corpus ------------------------------------------------------------------------------------------


def scaled(vector: str, scale: int = 256) -> Column:
    """floor(scale * entry) of every entry, as long; null if the vector or one of its entries is null
    or not finite."""
    v = F.col(vector)
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    return F.when(~bad, F.transform(v, lambda c: F.floor(c.cast("double") * float(scale))))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    x = batch.column("x")
    return np.asarray(x.flatten()).reshape(batch.num_rows, -1)


def _second_moments(frame: DataFrame, to_rows, d: int) -> np.ndarray:
    """Sum over all rows of the outer product of ``to_rows(x)`` with itself: one matrix per task, added
    up entry by entry; only the d x d totals come to the driver."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            if batch.num_rows:
                y = to_rows(_matrix(batch))
                total += y.T @ y
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(d * d)), pa.array(total.ravel())], names=["cell", "v"]
        )

    cells = frame.select("x").mapInArrow(partial, "cell long, v double")
    cells = cells.groupBy("cell").agg(F.sum("v").alias("v")).toPandas().sort_values("cell")
    return cells["v"].to_numpy().reshape(d, d) if len(cells) else np.zeros((d, d))


def whiten(
    vectors: DataFrame,
    scratch: Scratch,
    *,
    vector: str = "embedding",
    keep: tuple[str, ...] = ("vec_id",),
    k: int = 4,
    scale: int = 256,
) -> DataFrame:
    """Whitens vectors along their k leading components.

    Entries c become x = floor(scale * c).  The fit list is every distinct x vector once: n of them with
    sums S.  Its covariance (centred by S / n, divisor n) is decomposed on the driver, which sees d sums
    and d * d products, whatever the number of rows; mean and components then go to all rows with the
    tasks (d * (k + 1) numbers).

    Returns per row and component the columns of ``keep`` (those named as a result column are replaced),
    component (from 1), n, deviation (sum over dimensions of (n * x - S)^2, exact, as decimal), whitened,
    explained (the value's share of the trace) and identity_error (largest absolute entry of the whitened
    fit list's covariance minus the identity, over components whose value is not 0).

    Rows whose vector is null or holds null or not finite entries are left out, and so are vectors of
    another length than the most frequent one (of equals, the longest) and vectors without entries.
    Equal vectors count once in the fit list however often they come; each row is returned.  A component
    without variance has null ``whitened``; without any variance ``explained`` is null too.  An empty
    table gives an empty result.
    """
    made = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    kept = [c for c in keep if c not in made]
    names = {c: f"k{i}" for i, c in enumerate(kept)}
    rows = vectors.select(*[F.col(c).alias(a) for c, a in names.items()], scaled(vector, scale).alias("x"))
    rows = rows.where(F.size("x") > 0)
    schema = T.StructType(
        [T.StructField(c, rows.schema[a].dataType) for c, a in names.items()]
        + [T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType())]
        + [T.StructField("deviation", T.DecimalType(38, 0))]
        + [T.StructField(c, T.DoubleType()) for c in made[3:]]
    )
    distinct = scratch.put(rows.select("x").distinct())
    # one row per vector length
    sizes = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("rows"))
    top = sizes.orderBy(F.desc("rows"), F.desc("d")).take(1)
    if not top:
        return scratch.spark.createDataFrame([], schema)
    d = top[0]["d"]
    fit, rows = distinct.where(F.size("x") == d), rows.where(F.size("x") == d)
    place = fit.select(F.posexplode("x").alias("i", "v")).groupBy("i")
    sums = place.agg(F.sum("v").alias("s"), F.count("*").alias("n")).orderBy("i").collect()
    n, s = sums[0]["n"], [r["s"] for r in sums]
    mean = np.array([v / n for v in s])
    covariance = _second_moments(fit, lambda x: x - mean, d) / n
    values, basis = components(covariance, k)
    trace = float(np.trace(covariance))
    alive = values > d * EPS * max(trace, 0.0)
    weights = basis[:, alive] / np.sqrt(values[alive])
    live = int(alive.sum())
    projected = _second_moments(fit, lambda x: (x - mean) @ weights, live) / n if live else np.zeros((0, 0))
    error = float(np.abs(projected - np.eye(live)).max()) if live else None
    shares = [float(v) / trace if trace > 0 else None for v in values]
    return _apply(rows, schema, kept, names, n, s, mean, weights, alive, shares, error)


def _deviations(x: np.ndarray, n: int, s: list[int]) -> list[int]:
    """Sum over dimensions of (n * x - S)^2 for each row, exactly:
    n^2 sum x^2 - 2 n sum x S + sum S^2, with S in two halves so that sums fit 64 bits."""
    if len(x) and int(np.abs(x).max()) < SMALL and x.shape[1] <= SMALL and max(map(abs, s)) < 1 << 40:
        low = np.array([v & 0xFFFFF for v in s])
        high = np.array([v >> 20 for v in s])
        squares, dot_low, dot_high = (x * x).sum(1), x @ low, x @ high
        total = sum(v * v for v in s)
        return [
            n * n * q - 2 * n * (l + (h << 20)) + total
            for q, l, h in zip(squares.tolist(), dot_low.tolist(), dot_high.tolist())
        ]
    return [sum((n * v - t) ** 2 for v, t in zip(row, s)) for row in x.tolist()]


def _apply(rows, schema, kept, names, n, s, mean, weights, alive, shares, error) -> DataFrame:
    from decimal import Context, Decimal

    exact = Context(prec=60)
    many = len(shares)
    out_schema = schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch)
            deviation = [Decimal(v, exact) for v in _deviations(x, n, s)]
            white = np.full((len(x), many), np.nan)
            white[:, alive] = (x - mean) @ weights
            flat = white.ravel()
            take = pa.array(np.repeat(np.arange(len(x)), many))
            size = len(flat)
            cols = [batch.column(names[c]).take(take) for c in kept]
            cols += [
                pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), len(x))),
                pa.array(np.full(size, n)),
                pa.array(deviation, pa.decimal128(38, 0)).take(take),
                pa.array(flat, mask=np.isnan(flat)),
                pa.array(shares * len(x), pa.float64()),
                pa.array([error] * size, pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=out_schema.names)

    return rows.mapInArrow(run, schema)

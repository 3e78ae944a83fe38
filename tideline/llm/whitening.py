"""Operator 11: embedding whitening through a bidiagonal singular value solver.

Entries c become whole numbers x = floor(1024 c) + 100000, so that counts, sums
and centred rows n x - S are exact.  Blocks of centred rows are reduced to
triangles by QR inside each task, and the tasks' triangles (one small row each)
are stacked and reduced again in a tree, ``FAN`` at a time, until one triangle R
is left: its singular values are those of all centred rows.  R, whose size is
the dimension squared whatever the number of rows, is then solved once:
Householder reflections make it bidiagonal, the differential qd algorithm with
shifts finds the singular values to high relative accuracy, and twisted
factorisations give their right vectors, which are the components.

Rows take no part when the vector is null, holds a null or non-finite entry or
one of 2^30 or more in size, or has another length than the commonest one (ties:
the shorter).  Null and repeated ids are kept, each row counts.  Components
without variance are left out, so one row, or equal rows only, give an empty
result, as does an empty table.  A deviation beyond a long is null.  Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import delete, save, table

SCALE, SHIFT = 1024, 100_000
LARGEST = float(1 << 30)
COMPONENTS = 8
FAN = 32       # triangles that one task stacks
BLOCK = 2048   # rows reduced at once
_EPS = float(np.finfo(np.float64).eps)
_SMALL = (10 * _EPS) ** 2


# The solver, on one small triangle -----------------------------------------------------------------

def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, superdiagonal and right reflectors (of entries k + 1 on) of a square matrix."""
    a = r.astype(np.float64).copy()
    d = len(a)
    right: list[np.ndarray] = []

    def reflector(x: np.ndarray) -> np.ndarray:
        size = np.abs(x).max(initial=0.0)
        if size == 0:
            return np.zeros_like(x)
        v = x / size
        v[0] += np.copysign(np.sqrt(v @ v), v[0])
        return v / np.sqrt(v @ v)

    for k in range(d):
        u = reflector(a[k:, k])
        a[k:, k:] -= 2 * np.outer(u, u @ a[k:, k:])
        if k < d - 1:
            v = reflector(a[k, k + 1:])
            a[k:, k + 1:] -= 2 * np.outer(a[k:, k + 1:] @ v, v)
            right.append(v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def _qd_pass(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]] | None:
    """One differential qd transform; also its d values.  None if the shift was too large."""
    d = q[0] - shift
    new_q, new_e, ds = [], [], [d]
    for i, off in enumerate(e):
        if d < 0:
            return None
        top = d + off
        ratio = q[i + 1] / top
        new_q.append(top)
        new_e.append(off * ratio)
        d = d * ratio - shift
        ds.append(d)
    if d < 0:
        return None
    new_q.append(d)
    return new_q, new_e, ds


def singular_squares(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squared singular values of an upper bidiagonal matrix, falling, by dqds.

    Each step first transforms without a shift; the sum of 1/d is then the trace
    of the inverse, whose reciprocal never exceeds the smallest value and tends
    to it, and so is a safe shift.
    """
    size = max(np.abs(diagonal).max(initial=0.0), np.abs(above).max(initial=0.0))
    if size == 0:
        return np.zeros(len(diagonal))
    floor = 1e-200  # stands for a zero on the diagonal
    q = [max(x, floor) for x in ((diagonal / size) ** 2).tolist()]
    e = ((above / size) ** 2).tolist()
    out: list[float] = []
    blocks = [(q, e, 0.0)]
    while blocks:
        q, e, total = blocks.pop()
        while len(q) > 1:
            weak = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= _SMALL * (total + min(q[i], q[i + 1]))), None)
            if weak is not None:
                blocks.append((q[:weak + 1], e[:weak], total))
                q, e = q[weak + 1:], e[weak + 1:]
                continue
            q, e, ds = _qd_pass(q, e, 0.0)
            if min(ds) <= 0:
                q = [max(x, floor) for x in q]
                continue
            shift = (1 - 8 * _EPS) / sum(1 / x for x in ds)
            if shift > _EPS * total and (step := _qd_pass(q, e, shift)):
                (q, e, _), total = step, total + shift
        out.append(total + q[0])
    return np.sort(np.array(out))[::-1] * size * size


def twisted_vector(diagonal: np.ndarray, above: np.ndarray, value: float, others: list[np.ndarray]) -> np.ndarray:
    """Unit right singular vector of a bidiagonal matrix for the squared singular value ``value``.

    B'B - value is factorised from the top and from the bottom; where the two
    meet with the least pivot, the vector is read off both factors.  For values
    so close that a vector found before (``others``) comes out again, the next
    best meeting point is taken.
    """
    n = len(diagonal)
    a2, b2, ab = diagonal ** 2, above ** 2, diagonal[:-1] * above
    tiny = _EPS * max(value, _EPS)
    s, p = np.empty(n), np.empty(n)
    down, up = np.empty(max(n - 1, 0)), np.empty(max(n - 1, 0))
    s[0] = -value
    for i in range(n - 1):
        pivot = s[i] + a2[i] or tiny
        down[i] = ab[i] / pivot
        s[i + 1] = b2[i] / pivot * s[i] - value
    p[n - 1] = a2[n - 1] - value
    for i in range(n - 2, -1, -1):
        pivot = b2[i] + p[i + 1] or tiny
        up[i] = ab[i] / pivot
        p[i] = a2[i] * (p[i + 1] / pivot if b2[i] else 1.0) - value
    best, most = np.zeros(n), -1.0
    for at in np.argsort(np.abs(s + p + value), kind="stable"):
        z = np.zeros(n)
        z[at] = 1.0
        for i in range(at - 1, -1, -1):
            z[i] = -down[i] * z[i + 1]
        for i in range(at, n - 1):
            z[i + 1] = -up[i] * z[i]
        z /= np.abs(z).max()
        z /= np.sqrt(z @ z)
        for _ in range(2):
            for o in others:
                z -= (o @ z) * o
        left = np.sqrt(z @ z)
        if left > most:
            best, most = z / max(left, _EPS), left
        if left > 0.5:
            break
    return best


def components(r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest squared singular values of a triangle, those that are zero left out, and their right vectors as columns."""
    diagonal, above, right = bidiagonal(r)
    values = singular_squares(diagonal, above)
    values = values[:k][values[:k] > values[:1].max(initial=0.0) * (10 * len(r) * _EPS) ** 2]
    size = max(np.abs(diagonal).max(initial=0.0), np.abs(above).max(initial=0.0)) or 1.0
    found: list[np.ndarray] = []
    for v in values:
        found.append(twisted_vector(diagonal / size, above / size, v / size / size, found))
    out = np.array(found).T.reshape(len(r), len(values))
    for i in range(len(right) - 1, -1, -1):
        out[i + 1:] -= 2 * np.outer(right[i], right[i] @ out[i + 1:])
    return values, out


# The rows ------------------------------------------------------------------------------------------

def vectors(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and x (whole numbers) of the rows that take part."""
    c = F.col(vector).cast("array<double>")
    sound = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST))
    kept = rows.where(F.col(vector).isNotNull() & F.coalesce(sound, F.lit(False)))
    lengths = kept.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").first()
    kept = kept.where(F.size(vector) == (lengths["d"] if lengths else 0))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(c, lambda x: F.floor(x * SCALE) + SHIFT).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equally long lists as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def sums(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of rows and exact sum of each dimension: one partial row a task, added up by position."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = 0, None
        for b in batches:
            if len(b):
                x = _matrix(b.column("x")).sum(axis=0)
                n, s = n + len(b), x if s is None else s + x
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([s.tolist()], pa.list_(pa.int64()))], names=["n", "s"])

    parts = save(rows.select("x").mapInArrow(task, "n long, s array<long>"), "whitening-sums")
    n = parts.agg(F.sum("n")).first()[0] or 0
    at = parts.select(F.posexplode("s").alias("at", "s")).groupBy("at").agg(F.sum("s").alias("s")).orderBy("at").collect()
    delete(parts)
    return n, [r["s"] for r in at]


def spread_out(x: np.ndarray, n: int, s: np.ndarray) -> np.ndarray:
    """n x - S without rounding."""
    if n * (int(np.abs(x).max(initial=0)) + 1) < 1 << 62:
        return n * x - s
    return n * x.astype(object) - s.astype(object)


def squares(y: np.ndarray) -> list[int | None]:
    """Exact sum of squares of each row; None beyond a long."""
    if y.dtype != object and float(np.abs(y).max(initial=0)) ** 2 * max(1, y.shape[1]) < 2.0 ** 62:
        return (y * y).sum(axis=1).tolist()
    out = (y.astype(object) ** 2).sum(axis=1)
    return [int(v) if v < 1 << 63 else None for v in out]


def _stacked(parts: list[np.ndarray], d: int) -> np.ndarray:
    """The triangle of some rows."""
    r = np.linalg.qr(np.concatenate(parts), mode="r")
    return np.concatenate([r, np.zeros((d - len(r), d))]) if len(r) < d else r


def triangle(rows: DataFrame, n: int, s: list[int], fan: int = FAN) -> np.ndarray:
    """R of a QR factorisation of all centred rows."""
    d, total = len(s), np.array(s, dtype=np.int64)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for b in batches:
            x = _matrix(b.column("x")) if len(b) else np.empty((0, d), dtype=np.int64)
            for i in range(0, len(x), BLOCK):
                y = (spread_out(x[i:i + BLOCK], n, total) / n).astype(np.float64)
                r = _stacked([y] if r is None else [r, y], d)
        if r is not None:
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([r.tobytes()], pa.binary())], names=["part", "r"])

    def merge(parts: pd.DataFrame) -> pd.DataFrame:
        r = _stacked([np.frombuffer(x).reshape(d, d) for x in parts.sort_values("part")["r"]], d)
        return pd.DataFrame({"part": [parts["part"].min()], "r": [r.tobytes()]})

    schema = "part long, r binary"
    factors = save(rows.select("x").mapInArrow(task, schema), "whitening-factors")
    while (count := factors.count()) > 1:
        merged = factors.groupBy(F.col("part") % -(-count // fan)).applyInPandas(merge, schema)
        merged = save(merged, "whitening-factors")
        delete(factors)
        factors = merged
    r = np.frombuffer(factors.first()["r"]).reshape(d, d)
    delete(factors)
    return r


def whiten(rows: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """vec_id, n, deviation, whitened (array), explained (array) and identity_error of the rows of ``vectors``."""
    spark = rows.sparkSession
    n, s = sums(rows)
    values, axes = components(triangle(rows, n, s), k) if n and s else (np.empty(0), np.empty((0, 0)))
    schema = "vec_id long, deviation long, whitened array<double>"
    if not len(values):
        wide, trace, error = spark.createDataFrame([], schema), 1.0, 0.0
    else:
        wide, trace = _projected(rows, n, s, axes / np.sqrt(values / n), schema)
        error = identity_error(wide, len(values))
    explained = F.array(*[F.lit(float(v / n / trace)) for v in values])
    return wide.select("vec_id", F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                       explained.cast("array<double>").alias("explained"), F.lit(error).alias("identity_error"))


def _projected(rows: DataFrame, n: int, s: list[int], directions: np.ndarray, schema: str) -> tuple[DataFrame, float]:
    total = np.array(s, dtype=np.int64)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                y = spread_out(_matrix(b.column("x")), n, total)
                w = (y / n).astype(np.float64)
                yield pa.RecordBatch.from_arrays(
                    [b.column("vec_id"), pa.array(squares(y), pa.int64()), pa.array((w @ directions).tolist(), pa.list_(pa.float64())),
                     pa.array((w * w).sum(axis=1))], names=["vec_id", "deviation", "whitened", "far"])

    wide = save(rows.mapInArrow(task, schema + ", far double"), "whitened")
    return wide.drop("far"), wide.agg(F.avg("far")).first()[0]


def identity_error(wide: DataFrame, k: int) -> float:
    """Largest entry, without sign, of the whitened rows' covariance minus the identity."""
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = wide.agg(*[F.covar_pop(F.col("whitened")[i], F.col("whitened")[j]) for i, j in pairs]).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(row, pairs, strict=True))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = whiten(vectors(table(spark, sf_dir, "embeddings")))
    rows = wide.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "of"))
    return rows.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", F.col("of.whitened").alias("whitened"),
                       F.col("of.explained").alias("explained"), "identity_error")

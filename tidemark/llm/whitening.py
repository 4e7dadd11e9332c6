"""Whitening of embeddings: principal components of the whole table, scaled to unit variance.

Entries become whole numbers on a fixed grid far from zero, so a covariance of sums of squares would lose its digits.
Each partition's iterator keeps Welford's running mean and co-moments instead, by a rank-one update for each vector, and
the partitions' states are merged by the parallel update formula, some ``FAN_IN`` at a time, in as many rounds as it
takes until so few are left. The covariance of the last state goes through Householder's tridiagonal form and implicit
QR steps with Wilkinson's shift. States have d + d * d numbers for d dimensions, whatever the number of rows. A second
pass takes the covariance of the whitened vectors in the same way, for the error of the result; a third gives the rows.

Rows whose vector is null or holds null or non-finite entries are dropped. Of vectors of several lengths the most
frequent length (of ties the longest) is the table's, and the others are dropped as well; empty vectors are. Repeated rows count each and stay.
Null ids stay null. A component without variance whitens to null and is left out of the error. A deviation that no long
holds is null. Entries are below 2 ** 50 in magnitude; beyond, they count as that. Extra columns are not read, whatever
their names. An empty table, or one without a vector that counts, gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import release_memory, stash

#: The grid of entries.
SCALE, ORIGIN = 64, 1_000_000
#: States that one task merges, and that the driver merges last.
FAN_IN = 32
#: Rows of an output batch, over all components.
BATCH_ROWS = 1 << 15
LIMIT = float(1 << 50)
STATE = "part long, n long, sums array<decimal(38,0)>, mean array<double>, moments array<double>"


class Moments:
    """Running count, mean and co-moments of vectors."""

    def __init__(self, d: int):
        self.n, self.mean, self.m2 = 0, np.zeros(d), np.zeros((d, d))

    def add(self, x: np.ndarray) -> None:
        """Welford's update by one vector: the co-moments grow by a matrix of rank one."""
        self.n += 1
        delta = x - self.mean
        self.mean += delta / self.n
        self.m2 += ((self.n - 1) / self.n * delta)[:, None] * delta

    def merge(self, other: Moments) -> None:
        """The parallel update formula: as if the other's vectors had been added."""
        if not other.n:
            return
        n = self.n + other.n
        delta = other.mean - self.mean
        self.m2 += other.m2 + (self.n * (other.n / n) * delta)[:, None] * delta
        self.mean += delta * (other.n / n)
        self.n = n


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, off-diagonal, q) with a = q t q' by Householder's reflections, ``t`` tridiagonal."""
    a, n = a.astype(float).copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        size = np.linalg.norm(x)
        if not np.linalg.norm(x[1:]):
            continue
        x[0] += np.copysign(size, x[0])
        v = x / np.linalg.norm(x)
        a[k + 1 :] -= 2 * np.outer(v, v @ a[k + 1 :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def symmetric_eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues from large to small, unit eigenvectors as columns) of a symmetric matrix, by implicit QR steps with Wilkinson's shift."""
    d, e, q = tridiagonal((a + a.T) / 2)
    tiny, hi = np.finfo(float).eps, len(d) - 1
    while hi > 0:
        for k in range(hi):
            if abs(e[k]) <= tiny * (abs(d[k]) + abs(d[k + 1])):
                e[k] = 0.0
        if not e[hi - 1]:
            hi -= 1
            continue
        lo = hi - 1
        while lo and e[lo - 1]:
            lo -= 1
        half = (d[hi - 1] - d[hi]) / 2
        shift = d[hi] - e[hi - 1] ** 2 / (half + np.copysign(np.hypot(half, e[hi - 1]), half))
        x, z = d[lo] - shift, e[lo]
        for k in range(lo, hi):  # a rotation of rows and columns k and k + 1 chases the bulge down
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > lo:
                e[k - 1] = r
            dk, dn, ek = d[k], d[k + 1], e[k]
            d[k] = c * c * dk + 2 * c * s * ek + s * s * dn
            d[k + 1] = s * s * dk - 2 * c * s * ek + c * c * dn
            e[k] = (c * c - s * s) * ek + c * s * (dn - dk)
            x = e[k]
            if k < hi - 1:
                z = s * e[k + 1]
                e[k + 1] *= c
            left, right = q[:, k].copy(), q[:, k + 1]
            q[:, k] = c * left + s * right
            q[:, k + 1] = c * right - s * left
    order = np.argsort(-d, kind="stable")
    return d[order], q[:, order]


def _grid(batch: pa.RecordBatch, d: int) -> np.ndarray:
    """The batch's vectors as whole numbers, a row each."""
    values = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    return np.clip(np.floor(SCALE * values), -LIMIT, LIMIT).astype(np.int64) + ORIGIN


def _summed(vectors: DataFrame, d: int, seen: Callable[[np.ndarray], np.ndarray]) -> tuple[Moments, list[int]]:
    """Moments of what ``seen`` makes of all vectors on the grid, and exact sums of the grid's entries."""
    width = len(seen(np.zeros((1, d), np.int64))[0])

    def one_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        state, sums = Moments(width), [0] * d
        for batch in batches:
            if not len(batch):
                continue
            x = _grid(batch, d)
            # No sum of a batch passes a long: entries are below 2 ** 51, and a batch has fewer than 4096 rows to add at a time.
            for at in range(0, len(x), 4095):
                sums = [a + b for a, b in zip(sums, x[at : at + 4095].sum(axis=0).tolist(), strict=True)]
            for row in seen(x):
                state.add(row)
        yield _state_batch([(TaskContext.get().partitionId(), state, sums)] if state.n else [])
        release_memory()

    def merged(table: pa.Table) -> pa.Table:
        part, state, sums = _merge(table)
        return pa.Table.from_batches([_state_batch([(part // FAN_IN, state, sums)])])

    states = stash(vectors.select("vector").mapInArrow(one_partition, STATE), "moments")
    while (last := states.agg(F.max("part")).first()[0]) is not None and last >= FAN_IN:
        states = stash(states.groupBy(F.floor(F.col("part") / FAN_IN).alias("slot")).applyInArrow(merged, STATE), "moments")
    held = states.toArrow()
    if not len(held):
        return Moments(width), [0] * d
    _, state, sums = _merge(held)
    return state, sums


def _state_batch(states: list[tuple[int, Moments, list[int]]]) -> pa.RecordBatch:
    import decimal

    exact = pa.list_(pa.decimal128(38, 0))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([p for p, _, _ in states], pa.int64()),
            pa.array([s.n for _, s, _ in states], pa.int64()),
            pa.array([[decimal.Decimal(x) for x in sums] for _, _, sums in states], exact),
            pa.array([s.mean.tolist() for _, s, _ in states], pa.list_(pa.float64())),
            pa.array([s.m2.ravel().tolist() for _, s, _ in states], pa.list_(pa.float64())),
        ],
        ["part", "n", "sums", "mean", "moments"],
    )


def _merge(table: pa.Table) -> tuple[int, Moments, list[int]]:
    """States of a table as one, by the order of their parts, so that the result doesn't depend on who was first."""
    rows = sorted(table.to_pylist(), key=lambda r: r["part"])
    total, sums = Moments(len(rows[0]["mean"])), [0] * len(rows[0]["sums"])
    for r in rows:
        state = Moments(len(r["mean"]))
        state.n, state.mean, state.m2 = r["n"], np.array(r["mean"]), np.array(r["moments"]).reshape(len(r["mean"]), -1)
        total.merge(state)
        sums = [a + int(b) for a, b in zip(sums, r["sums"], strict=True)]
    return rows[0]["part"], total, sums


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sums over dimensions of (n * x - sum) ** 2, in whole numbers of any size."""
    reach = max((max(abs(n * lo - s), abs(n * hi - s)) for lo, hi, s in zip(x.min(axis=0).tolist(), x.max(axis=0).tolist(), sums, strict=True)), default=0)
    if reach < 1 << 31 and reach * reach * len(sums) < 1 << 63 and n * int(np.abs(x).max()) < 1 << 62:
        return ((n * x - np.array(sums)) ** 2).sum(axis=1).tolist()
    exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in exact]


def whiten(table: DataFrame, components: int = 32, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for each vector that counts and component up to ``components``."""
    vector = F.transform(F.col(f"`{vector_col}`"), lambda c: c.cast("double"))
    good = F.forall("vector", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), F.lit(False)))
    vectors = table.select(F.col(f"`{id_col}`").alias("id"), vector.alias("vector")).filter(F.col("vector").isNotNull() & (F.size("vector") > 0) & good)
    kind = T.StructField(id_col, table.schema[id_col].dataType)
    schema = T.StructType([kind, T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()), T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType())])
    lengths = vectors.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return table.sparkSession.createDataFrame([], schema)
    d = lengths["d"]
    vectors = vectors.filter(F.size("vector") == d)
    state, sums = _summed(vectors, d, lambda x: (x - ORIGIN).astype(float))
    n = state.n
    values, basis = symmetric_eigen(state.m2 / n)
    k = min(components, d)
    spread = values[:k] > d * np.finfo(float).eps * max(values[0], 0)
    # Sums are exact, so what lies between a vector and the mean is taken in whole numbers first.
    whole, rest = np.array([s // n for s in sums]), np.array([s % n / n for s in sums])
    directions = np.where(spread, basis[:, :k] / np.sqrt(np.where(spread, values[:k], 1.0)), 0.0)
    explained = (values[:k] / values.sum()).tolist() if values.sum() > 0 else [None] * k

    def white(x: np.ndarray) -> np.ndarray:
        return ((x - whole) - rest) @ directions

    check, _ = _summed(vectors, d, white)
    error = float(np.abs((check.m2 / n - np.eye(k))[np.ix_(spread, spread)]).max(initial=0.0))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), max(1, BATCH_ROWS // k)):
                part = batch.slice(at, max(1, BATCH_ROWS // k))
                x = _grid(part, d)
                m = len(part)
                owner = pa.array(np.repeat(np.arange(m), k))
                deviation = pa.array(_deviations(x, n, sums), pa.int64())
                whitened = pa.array(white(x).ravel(), pa.float64(), mask=np.tile(~spread, m))
                constant = lambda v, t: pa.array(v * m, t)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(owner), constant(list(range(1, k + 1)), pa.int32()), constant([n] * k, pa.int64()), deviation.take(owner), whitened, constant(explained, pa.float64()), constant([error] * k, pa.float64())],
                    schema.names,
                )
        release_memory()

    return vectors.mapInArrow(rows, schema)

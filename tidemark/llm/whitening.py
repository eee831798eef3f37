"""Whitening of embeddings by eigenvectors refined in higher precision (operator 12)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table

#: Vectors of one Arrow batch and entries of one block of the covariance; both bound a task's memory.
ROWS = 4096
#: x = floor(SCALE * entry) + SHIFT, whole numbers whose sums are exact.
SCALE, SHIFT = 1024.0, 100_000
#: Largest dimension for which the driver holds and solves the matrix (some minutes, 1 GB).
LARGEST = 2048
HIGH = np.longdouble


def slices(a: np.ndarray, axis: int, bits: int) -> list[np.ndarray]:
    """a as a sum of three double matrices of so many leading bits each, counted from the largest entry along axis."""
    parts = []
    for _ in range(3):
        top = np.abs(a).max(axis=axis, keepdims=True)
        unit = np.exp2(bits - np.ceil(np.log2(np.where(top > 0, top, 1))))
        parts.append((np.rint(a * unit) / unit).astype(np.float64))
        a = a - parts[-1]
    return parts


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a b in extended precision at the speed of double products: those of slices are exact, only their sum is rounded."""
    bits = (52 - int(np.ceil(np.log2(a.shape[1])))) // 2 if a.shape[1] > 1 else 26
    left, right = slices(a, 1, bits), slices(b, 0, bits)
    pairs = sorted(((i, j) for i in range(3) for j in range(3) if i + j < 4), key=sum, reverse=True)
    return sum((left[i] @ right[j] for i, j in pairs), start=np.zeros((a.shape[0], b.shape[1]), HIGH))


def refined(a: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, to double precision.

    float32 eigenvectors are corrected by Ogita and Aishima's iteration, matrix products in extended precision:
    with X the vectors, R = I - X'X and S = X'AX say how far X is from orthogonal and from diagonalising, and X(I + E) squares
    both errors. Where eigenvalues are too close for the first-order correction E = (S + lambda R) / (lambda_j - lambda_i),
    only orthogonality is restored, and the cluster's own small matrix, shifted by its mean and so free of the large common
    part, is solved for the rotation inside it. Equal eigenvalues have no vectors of their own; any basis is theirs. Each
    vector's largest entry is positive."""
    a = np.asarray(a, HIGH)
    d = len(a)
    size = np.abs(a).sum(axis=1).max(initial=0)
    if not size:
        return np.zeros(d), np.eye(d)
    a = a / size  # so float32 holds any matrix
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(HIGH)
    eye, floor = np.eye(d, dtype=HIGH), HIGH(np.finfo(np.float64).eps) / 8
    for _ in range(rounds):
        r, s = eye - product(x.T, x), product(x.T, product(a, x))
        value = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(value)
        near = 2 * (np.linalg.norm(off.astype(float)) + np.linalg.norm(r.astype(float)))
        gap = value[None, :] - value[:, None]
        apart = np.abs(gap) > max(near, floor)
        e = np.where(apart, (s + value[None, :] * r) / np.where(apart, gap, 1), r / 2)
        x = x + product(x, e)
        for members in clusters(value, max(near, floor)):
            x[:, members] = x[:, members] @ rotation(a, x[:, members])
        if np.abs(e).max() < floor:
            break
    for _ in range(2):  # rounding over a tiny gap can turn close vectors towards each other
        x = x + product(x, eye - product(x.T, x)) / 2
    value = (x * product(a, x)).sum(axis=0)
    order = np.argsort(-value, kind="stable")
    x, value = x[:, order], value[order]
    x = x * np.where(x[np.abs(x).argmax(axis=0), np.arange(d)] < 0, -1, 1)
    return (value * size).astype(float), x.astype(float)


def clusters(value: np.ndarray, near: float) -> list[np.ndarray]:
    """Groups of two or more eigenvalues each at most near from the next."""
    order = np.argsort(value)
    parts = np.split(order, np.flatnonzero(np.diff(value[order]) > near) + 1)
    return [p for p in parts if len(p) > 1]


def rotation(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Eigenvectors of a cluster's own matrix x'(A - mean)x, scaled up so that what tells its eigenvalues apart is not lost
    in what they share."""
    image = product(a, x)
    mean = (x * image).sum() / x.shape[1]
    own = product(x.T, image - mean * x)
    own = (own + own.T) / 2
    scale = np.abs(own).max()
    if not scale:
        return np.eye(x.shape[1], dtype=HIGH)
    return np.linalg.eigh((own / scale).astype(float))[1].astype(HIGH)


@dataclass
class Whitening:
    """What whitened() needs: rows n, exact sums of x by dimension, eigenvalues and components of x's covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray

    def scales(self, k: int) -> np.ndarray:
        """1 / sqrt(eigenvalue) of the first k components; nan where a component has no variance beyond rounding."""
        e = self.values[:k]
        floor = len(self.values) * np.finfo(float).eps * max(self.values[0], 0) if len(e) else 0
        with np.errstate(all="ignore"):
            return np.where(e > floor, 1 / np.sqrt(np.abs(e)), np.nan)

    def explained(self, k: int) -> list[float | None]:
        total = self.values.sum()
        return [float(e / total) if total > 0 else None for e in self.values[:k]]


def whole_vectors(df: DataFrame, vector: str = "embedding", out: str = "x") -> DataFrame:
    """Rows whose vector is there and has only finite entries, with out, its entries as whole numbers. Where lengths differ,
    the commonest one counts (of two alike the longer), and other rows are dropped too, as are empty vectors. Entries too
    large for a long (from 9e15 on) count as not finite. Other columns stay; one named out is replaced."""
    # try_add: Spark may work entries out before it has dropped rows with a too large one
    entry = lambda v: F.try_add(F.floor(v.cast("double") * SCALE), F.lit(SHIFT))
    # nan is greater than any number here, so it fails the comparison as infinities and nulls do
    good = df.where(F.col(vector).isNotNull()).where(F.forall(vector, lambda v: F.coalesce(F.abs(v.cast("double")) < 9e15, F.lit(False)))).where(F.size(vector) > 0)
    found = good.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return good.where(F.size(vector) == (found[0].d if found else 0)).withColumn(out, F.transform(vector, entry))


def _matrix(batch: pa.RecordBatch, x: str) -> np.ndarray:
    lists = batch.column(x)
    return lists.flatten().to_numpy().reshape(len(lists), -1)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - sums / n: less the mean's whole part exactly, then less its fraction."""
    return (x - np.array([s // n for s in sums], np.int64)) - np.array([s % n / n for s in sums])


def _products(vectors: DataFrame, x: str, n: int, sums: list[int], project: np.ndarray | None = None) -> np.ndarray:
    """Sum of z z' over all rows, z the centred vector or its projection: each task adds its own up and gives the upper
    triangle's cells, which Spark sums. The result has as many cells as dimensions squared, whatever the rows."""
    d = len(sums) if project is None else project.shape[1]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros((d, d)), False
        for batch in batches:
            if batch.num_rows:
                z = _centred(_matrix(batch, x), n, sums)
                z = z if project is None else z @ project
                total, some = total + z.T @ z, True
        if some:
            i, j = np.triu_indices(d)
            for at in range(0, len(i), ROWS):
                part = slice(at, at + ROWS)
                yield pa.record_batch({"i": pa.array(i[part], pa.int32()), "j": pa.array(j[part], pa.int32()), "v": pa.array(total[i[part], j[part]])})

    out = np.zeros((d, d))
    for row in vectors.select(x).mapInArrow(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[row.i, row.j] = out[row.j, row.i] = row.v
    return out


def fit(vectors: DataFrame, x: str = "x") -> Whitening | None:
    """The whitening of a column of whole_vectors, over all rows; None for an empty table. Two passes: exact sums by
    dimension, then products of centred vectors."""
    small_batches(vectors.sparkSession, ROWS)
    sums = vectors.select(F.posexplode(x).alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).collect()
    if not sums:
        return None
    if len(sums) > LARGEST:
        raise ValueError(f"{len(sums)} dimensions; the matrix is solved for at most {LARGEST}")
    n, by_dim = sums[0].n, [int(r.s) for r in sorted(sums, key=lambda r: r.i)]
    values, components = refined(_products(vectors, x, n, by_dim) / n)
    return Whitening(n, by_dim, values, components)


def whitened(vectors: DataFrame, model: Whitening, k: int = 8, x: str = "x", out: str = "whitened", deviation: str | None = None) -> DataFrame:
    """vectors with out, the k first components' coordinates of variance 1 (null for one without variance), and, if named,
    deviation: the exact sum over dimensions of (n x - S)^2, null where that is too large for a long. Other columns stay."""
    n, sums = model.n, model.sums
    project = model.components[:, :k] * model.scales(k)

    @F.arrow_udf("array<double>")
    def coordinates(batch: pa.Array) -> pa.Array:
        z = _centred(batch.flatten().to_numpy().reshape(len(batch), -1), n, sums) @ project
        ends = np.arange(len(z) + 1, dtype=np.int32) * project.shape[1]
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(z.ravel(), mask=np.isnan(z.ravel())))

    @F.arrow_udf("long")
    def spread(batch: pa.Array) -> pa.Array:
        rows = batch.flatten().to_numpy().reshape(len(batch), -1)
        top = max(abs(int(rows.max(initial=0))), abs(int(rows.min(initial=0))))
        if n * top < 2**62:
            y = n * rows - np.array(sums, np.int64)
            if len(sums) * int(np.abs(y).max(initial=0)) ** 2 < 2**63:
                return pa.array((y * y).sum(axis=1))
        exact = [sum((n * v - t) ** 2 for v, t in zip(row, sums, strict=True)) for row in rows.tolist()]
        return pa.array([v if v < 2**63 else None for v in exact], pa.int64())

    small_batches(vectors.sparkSession, ROWS)
    columns = {out: coordinates(F.col(x))} | ({deviation: spread(F.col(x))} if deviation else {})
    return vectors.withColumns(columns)


def identity_error(vectors: DataFrame, model: Whitening, k: int = 8, x: str = "x") -> float | None:
    """How far the covariance of all rows' whitened coordinates is from the identity: the largest absolute entry of the
    difference, over components with variance; None if there are none. One more pass over the rows."""
    scales = model.scales(k)
    project = (model.components[:, :k] * scales)[:, ~np.isnan(scales)]
    if not project.shape[1]:
        return None
    # the mean of the coordinates is that of x - S/n, projected: nothing but rounding, as S is exact
    return float(np.abs(_products(vectors, x, model.n, model.sums, project) / model.n - np.eye(project.shape[1])).max())


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    """A row per usable vector and component up to 8."""
    k = 8
    source = table(spark, sf_dir, "embeddings")
    vectors = whole_vectors(source.select("vec_id", "embedding")).select("vec_id", "x")
    model = fit(vectors)
    if model is None:
        empty = {"component": "int", "n": "long", "deviation": "long", "whitened": "double", "explained": "double", "identity_error": "double"}
        return vectors.where("false").select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in empty.items()])
    error, shares = identity_error(vectors, model, k), F.array(*[F.lit(v).cast("double") for v in model.explained(k)])
    rows = whitened(vectors, model, k, deviation="deviation").select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))

"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

The centred rows X stay on the executors. A step needs the products Xq and
Xᵀ(Xq); both come from one pass, because a row contributes its own entry of Xq
and that entry times itself to Xᵀ(Xq). The left vectors u are as long as the table,
so none is formed: the inner products that full reorthogonalisation needs are those
of the right vectors with Xᵀu.
What reaches the driver is one vector per part, of at most ``PARTS`` parts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxarbor.session import Rounds

STEP, SHIFT = 64, 1_000_000
#: Parts of the fit list, and so rows that a pass returns to the driver.
PARTS = 4096
#: Vectors in one packed row.
BLOCK = 4096
#: Entries are held within this range, so that sums over 2^22 rows and more stay whole numbers of 64 bits.
REACH = float(1 << 40)
#: Components whose variance is a smaller share of the largest one are rounding, not directions of the data.
NOISE = 1e-12
#: Left vectors shorter than this share of the longest are rounding.
LOST = 1e-8


@dataclass(frozen=True)
class Whitening:
    """What the fit gives: bounded by dimensions times components."""

    n: int
    sums: np.ndarray
    components: np.ndarray  # one column each
    variances: np.ndarray
    explained: np.ndarray
    identity_error: float


def whole_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key`` and ``x``, the vector on a grid of 1/64 shifted by 1,000,000, for rows whose vector has only finite entries."""
    c = F.col("vector")
    entry = lambda e: F.floor(F.greatest(F.least(e.cast("double") * STEP, F.lit(REACH)), F.lit(-REACH))) + F.lit(SHIFT)
    bad = lambda e: e.isNull() | F.isnan(e) | (F.abs(e.cast("double")) == float("inf"))
    return df.select(F.col(key).alias("key"), F.col(vector).alias("vector")).where(
        c.isNotNull() & (F.size(c) > 0) & ~F.exists(c, bad)).select("key", F.transform(c, entry).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _packed(batches):
    """Vectors as blocks of their distance from the shift, in the narrowest whole numbers that hold them."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            block = _matrix(batch.column(0).slice(at, BLOCK)) - SHIFT
            low, high = int(block.min()), int(block.max())
            kind = next(k for k in ("int8", "int16", "int32", "int64") if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
            yield pa.RecordBatch.from_pydict({"kind": [kind], "data": [block.astype(kind).tobytes()]})


def _blocks(batches, size: int):
    for batch in batches:
        for kind, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            yield np.frombuffer(data.as_buffer(), kind).reshape(-1, size)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """Rows less their mean: the difference is taken in whole numbers and divided once."""
    return (x.astype(np.int64) * n - sums) / n


def _over_parts(blocks: DataFrame, size: int, zero: np.ndarray, add) -> np.ndarray:
    """Sum of ``add(block)`` over all blocks: one vector per part is returned and added up."""
    kind = "bigint" if zero.dtype == np.int64 else "double"

    def part(batches):
        total = zero.copy()
        for block in _blocks(batches, size):
            total += add(block)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.from_numpy_dtype(zero.dtype)))], ["total"])

    rows = blocks.coalesce(PARTS).mapInArrow(part, f"total array<{kind}>").toArrow().column("total").to_pylist()
    return np.sum([np.asarray(r, zero.dtype) for r in rows], axis=0) if rows else zero


def _orthogonal(v: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    """``v`` less its part in the span of the basis, twice for full precision."""
    if basis:
        q = np.array(basis)
        for _ in range(2):
            v = v - q.T @ (q @ v)
    return v


def bidiagonalise(product, size: int, wanted: int, seed: int = 42):
    """Right singular vectors (columns) and singular values of X, largest first.

    ``product(v)`` returns Xᵀ(Xv) and the squared length of Xv. The inner products
    of Xv with the earlier left vectors u are those of v with Xᵀu, so u itself is
    never formed. Runs until the wanted triplets have residuals of rounding size or
    the space is used up; a direction without further coupling is replaced by a new
    one, so repeated values are found as often as they occur. A left vector shorter
    than ``LOST`` of the largest is rounding and counts as zero. What rounding left
    between the singular vectors is removed by one rotation of the small projected product.
    """
    rng = np.random.default_rng(seed)
    v = rng.standard_normal(size)
    right, images, products = [v / np.linalg.norm(v)], [], []  # v_k, Xᵀu_k and XᵀXv_k
    alphas, betas = [], []
    while True:
        z, square = product(right[-1])
        products.append(z)
        image = z
        if images:  # full reorthogonalisation of the left vector
            s = np.array(images)
            h = s @ right[-1]
            image, square = z - s.T @ h, square - h @ h
        alpha = float(np.sqrt(max(square, 0.0)))
        largest = max([alpha, *alphas])
        if alpha <= LOST * largest:
            alpha = 0.0
        alphas.append(alpha)
        images.append(image / alpha if alpha else np.zeros(size))
        r = _orthogonal(images[-1] - alpha * right[-1], right)
        beta = float(np.linalg.norm(r))
        if len(right) == size:
            beta = 0.0
        elif beta <= LOST * largest or not alpha:
            beta, r = 0.0, _orthogonal(rng.standard_normal(size), right)
        left, values, turned = np.linalg.svd(np.diag(alphas) + np.diag(betas, 1))
        done = len(values) > wanted and beta > 0 and np.all(beta * np.abs(left[-1, :wanted]) <= 1e-15 * values[0])
        if done or len(right) == size:
            break
        betas.append(beta)
        right.append(r / np.linalg.norm(r))
    vectors = np.array(right).T @ turned.T
    small = turned @ (np.array(right) @ np.array(products).T) @ turned.T
    squares, last = np.linalg.eigh((small + small.T) / 2)
    return vectors @ last[:, ::-1], np.sqrt(np.maximum(squares[::-1], 0.0))


def fit(vectors: DataFrame, components: int = 16) -> Whitening | None:
    """Whitening of ``whole_vectors``: mean and components over each distinct vector once.

    Vectors of another length than the commonest one (of several the longest)
    take no part. None if there is no vector; no components if all are equal.
    The distinct vectors are written once, packed, and each pass reads that table.
    """
    first = vectors.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if first is None:
        return None
    size = first["size"]
    rounds = Rounds(vectors.sparkSession, "whitening")
    blocks, _ = rounds.save(vectors.where(F.size("x") == size).select("x").distinct().mapInArrow(
        _packed, "kind string, data binary"))
    shifted = _over_parts(blocks, size, np.zeros(size + 1, np.int64),
                          lambda b: np.append(b.sum(axis=0, dtype=np.int64), len(b)))
    n, sums = int(shifted[-1]), shifted[:-1]
    spread = 0.0

    def product(q):
        nonlocal spread

        def add(block):
            x = _centred(block, n, sums)
            w = x @ q
            return np.append(w @ x, (w @ w, np.vdot(x, x)))

        out = _over_parts(blocks, size, np.zeros(size + 2), add)
        spread = float(out[-1])
        return out[:-2], float(out[-2])

    right, values = bidiagonalise(product, size, components)
    variances = values**2 / n
    keep = int(np.sum(variances[:components] > NOISE * max(variances[0], 0.0)))
    right, variances = right[:, :keep], variances[:keep]
    right = right * np.where(right[np.abs(right).argmax(axis=0), np.arange(keep)] < 0, -1.0, 1.0)
    error = 0.0
    if keep:
        scale = right / np.sqrt(variances)

        def moments(block):
            w = _centred(block, n, sums) @ scale
            return (w.T @ w).ravel()

        second = _over_parts(blocks, size, np.zeros(keep * keep), moments).reshape(keep, keep) / n
        error = float(np.abs(second - np.eye(keep)).max())
    rounds.retire(blocks)
    return Whitening(n, sums + SHIFT * n, right, variances, variances * n / spread if keep else variances, error)


def _deviations(distance: np.ndarray) -> list[int | None]:
    """Exact sums of squares of whole numbers; None beyond 64 bits."""
    wide = float(np.abs(distance).max(initial=0)) ** 2 * max(distance.shape[1], 1)
    if wide < 2.0**62:
        return (distance * distance).sum(axis=1).tolist()
    sums = [sum(int(e) ** 2 for e in row) for row in distance]
    return [s if s < 1 << 63 else None for s in sums]


def whiten(vectors: DataFrame, fitted: Whitening | None, key: str = "vec_id") -> DataFrame:
    """A row for each vector and component: ``key, component, n, deviation, whitened, explained, identity_error``.

    Every row of ``whole_vectors`` is kept, repeated ones too; vectors of another
    length than the fit's have no rows. ``deviation`` is null where it does not fit 64 bits.
    """
    kind = dict(vectors.dtypes)["key"]
    schema = f"`{key}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if fitted is None or not len(fitted.variances):
        return vectors.sparkSession.createDataFrame([], schema)
    n, sums, k = fitted.n, fitted.sums, len(fitted.variances)
    scale = fitted.components / np.sqrt(fitted.variances)
    explained, error = fitted.explained, fitted.identity_error

    def rows(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(at, BLOCK)
                m = piece.num_rows
                distance = _matrix(piece.column("x")) * n - sums
                each = np.repeat(np.arange(m), k)
                yield pa.RecordBatch.from_arrays([
                    piece.column("key").take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n, np.int64)),
                    pa.array(_deviations(distance), pa.int64()).take(pa.array(each)),
                    pa.array(((distance / n) @ scale).ravel()),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, error)),
                ], [key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.where(F.size("x") == len(sums)).mapInArrow(rows, schema)

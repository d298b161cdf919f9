"""Whitening of embeddings by matrix-free block Lanczos.

Entries c become whole numbers x = floor(1024 c) + 100000. No covariance matrix is made: every step is one distributed pass
that centres the rows and multiplies, Y = X'(X Q) / n for a block Q of vectors. Tasks emit one small sum each and these are
added by entry before a d x b block reaches the driver.

* Each product is orthogonalised twice against all vectors so far (full reorthogonalisation). Directions that vanish (a
  breakdown: the space is invariant) are replaced by random ones orthogonal to all, so that multiple eigenvalues are found.
* Ritz pairs come from the whole basis; the iteration ends when the residuals of the wanted ones are under ``TOLERANCE``
  of the largest eigenvalue, or when the basis spans all dimensions, where they are exact. A basis of ``MOST`` vectors is
  compressed to its leading Ritz vectors (a thick restart).
* The trace of the covariance is the sum of the rows' exact deviations over n**3, so explained shares need no spectrum.

Rows with a null vector or null or non-finite entries are dropped, as are empty vectors and those whose length is not the
table's most common one (of several, the largest). Entries beyond +-2**40 after scaling count as that. A deviation beyond a
long is null. Null ids are kept; repeated rows count each; other columns are left aside. Components whose eigenvalue is
within rounding of 0 can't be scaled and give no rows, so equal vectors, or a single one, give none. Equal eigenvalues: any
orthonormal vectors of their space. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batch, materialize, read

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Residual over the largest eigenvalue at which a pair is taken, least eigenvalue over it, most vectors of a basis.
TOLERANCE, LEAST, MOST = 1e-13, 1e-12, 512
#: Residual that counts as converged where rounding allows no better: so many steps without gain.
ROUNDED, STALE = 1e-10, 4
_LIMIT = float(1 << 40)
#: Rows that are multiplied at a time.
_ROWS = 4096

_CLEAN = pa.schema([("vec_id", pa.int64()), ("dims", pa.int32()), ("x", pa.list_(pa.int64()))])
_CLEAN_DDL = "vec_id long, dims int, x array<long>"
_SUM = pa.schema([("at", pa.int32()), ("value", pa.float64())])
_OUT = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])
_OUT_DDL = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of finite vectors in whole numbers."""
    for batch in batches:
        batch = batch.filter(pc.fill_null(pc.greater(pc.list_value_length(batch.column(1)), 0), False))
        vectors = batch.column(1)
        flat = pc.list_flatten(vectors).cast(pa.float64())
        size = pc.list_value_length(vectors).to_numpy()
        c = flat.to_numpy(zero_copy_only=False)  # null: nan
        row = np.repeat(np.arange(len(size)), size)
        good = np.ones(len(size), dtype=bool)
        good[row[~np.isfinite(c)]] = False
        x = np.clip(np.floor(SCALE * c[good[row]]), -_LIMIT, _LIMIT).astype(np.int64) + SHIFT
        ends = np.concatenate([[0], np.cumsum(size[good])]).astype(np.int32)
        yield arrow_batch(_CLEAN, [batch.column(0).filter(pa.array(good)), size[good].astype(np.int32), pa.ListArray.from_arrays(ends, x)])


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, x) of the rows that count, written once."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    clean = materialize(rows.mapInArrow(_whole, _CLEAN_DDL), "whitening-rows")
    top = clean.groupBy("dims").count().orderBy(F.col("count").desc(), F.col("dims").desc()).first()
    return clean.where(F.col("dims") == (top["dims"] if top else 0)).select("vec_id", "x")


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and rows, a bounded number at a time."""
    for batch in batches:
        for at in range(0, len(batch), _ROWS):
            part = batch.slice(at, _ROWS)
            x = pc.list_flatten(part.column("x")).to_numpy()
            yield part.column("vec_id"), x.reshape(len(part), -1)


def _summed(rows: DataFrame, shape: tuple[int, ...], add: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all blocks of rows of add(block), an array of a small fixed shape: added in tasks, then by entry."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _matrices(batches):
            total = add(x) if total is None else total + add(x)
        if total is not None:
            yield arrow_batch(_SUM, [np.arange(total.size, dtype=np.int32), total.ravel()])

    out = np.zeros(int(np.prod(shape)))
    for r in rows.mapInArrow(scan, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
        out[r["at"]] = r["value"]
    return out.reshape(shape)


def _exact_sums(rows: DataFrame) -> tuple[int, np.ndarray]:
    """n and the exact sum of each dimension, as Python integers."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x in _matrices(batches):
            # 2**12 rows of entries under 2**41
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, x.shape[1]), type=pa.int32()), pa.array([len(x), *x.sum(axis=0).tolist()], type=pa.int64())], names=["at", "value"])

    total = rows.mapInArrow(scan, "at int, value long").groupBy("at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    by = {r["at"]: int(r["value"]) for r in total}
    return by.pop(-1, 0), np.array([by[i] for i in range(len(by))], dtype=object)


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int]:
    """The sum over dimensions of (n x - S)**2 of each row, exact."""
    most = max(abs(n * int(x.max()) - min(sums)), abs(n * int(x.min()) - max(sums)), 1)
    if most * most * x.shape[1] < 1 << 63 and max(map(abs, sums)) < 1 << 63:
        off = n * x - sums.astype(np.int64)
        return (off * off).sum(axis=1).tolist()
    return [int(sum(v * v for v in row)) for row in n * x.astype(object) - sums]


def _all_deviations(rows: DataFrame, n: int, sums: np.ndarray) -> int:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for _, x in _matrices(batches):
            total += sum(deviations(x, n, sums))
        # digits of 32 bits, the last one open
        digits = [total >> 32 * i & 0xFFFFFFFF for i in range(8)]
        yield pa.RecordBatch.from_arrays([pa.array(range(8), type=pa.int32()), pa.array(digits, type=pa.int64())], names=["at", "value"])

    parts = rows.mapInArrow(scan, "at int, value long").groupBy("at").agg(F.sum("value").alias("value")).collect()
    return sum(r["value"] << 32 * r["at"] for r in parts)


def block_lanczos(multiply: Callable[[np.ndarray], np.ndarray], dims: int, wanted: int, most: int = MOST, tolerance: float = TOLERANCE, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and unit eigenvectors (as columns) of the symmetric positive operator
    ``multiply``, which takes and gives blocks of vectors."""
    rng = np.random.default_rng(seed)
    wanted = min(wanted, dims)
    width = min(dims, wanted + 2)
    basis, image = np.zeros((dims, 0)), np.zeros((dims, 0))

    def orthonormal(block: np.ndarray, size: float) -> np.ndarray:
        """The block without what the basis spans; vectors that vanish against ``size`` are drawn anew."""
        out = basis
        for v in block.T[: dims - basis.shape[1]]:
            least = 1e-10 * size
            while True:
                for _ in range(2):
                    v = v - out @ (out.T @ v)
                if (norm := np.linalg.norm(v)) > least:
                    # what rounding left in a short remainder
                    v = v / norm
                    v = v - out @ (out.T @ v)
                    out = np.column_stack([out, v / np.linalg.norm(v)])
                    break
                v, least = rng.standard_normal(dims), 1e-6
        return out[:, basis.shape[1] :]

    block, scale, best, stale = rng.standard_normal((dims, width)), 1.0, np.inf, 0
    while True:
        block = orthonormal(block, scale)
        basis, image = np.column_stack([basis, block]), np.column_stack([image, multiply(block)])
        inner = basis.T @ image
        values, vectors = np.linalg.eigh((inner + inner.T) / 2)
        values, vectors = values[::-1], vectors[:, ::-1]
        scale = max(abs(values[0]), np.finfo(float).tiny)
        ritz = basis @ vectors[:, :wanted]
        residual = np.linalg.norm(image @ vectors[:, :wanted] - ritz * values[:wanted], axis=0).max()
        best, stale = (residual, 0) if residual < best / 2 else (best, stale + 1)
        close = residual <= tolerance * scale or (stale >= STALE and residual <= ROUNDED * scale)
        if basis.shape[1] == dims or (basis.shape[1] > wanted and close):
            return values[:wanted], ritz / np.linalg.norm(ritz, axis=0)
        block = image[:, -block.shape[1] :]
        if basis.shape[1] + width > most:
            stay = vectors[:, : 2 * width]
            basis, image = basis @ stay, image @ stay
            block = image[:, :width] - basis[:, :width] * values[:width]


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each row that counts and each component."""
    spark = vectors.sparkSession
    rows = whole_vectors(vectors)
    n, sums = _exact_sums(rows)
    if not n:
        return spark.createDataFrame([], _OUT_DDL)
    dims, total = len(sums), _all_deviations(rows, n, sums)
    mean = np.array([s // n for s in sums], dtype=np.int64), np.array([(s % n) / n for s in sums])
    centred = lambda x: (x - mean[0]).astype(np.float64) - mean[1]
    trace = total / n**3

    def multiply(block: np.ndarray) -> np.ndarray:
        def add(x: np.ndarray) -> np.ndarray:
            y = centred(x)
            return y.T @ (y @ block)

        return _summed(rows, block.shape, add) / n

    if not total:
        return spark.createDataFrame([], _OUT_DDL)
    values, axes = block_lanczos(multiply, dims, components)
    stays = values > LEAST * values[0]
    values, axes = values[stays], axes[:, stays]
    turn = axes / np.sqrt(values)

    def square(x: np.ndarray) -> np.ndarray:
        w = centred(x) @ turn
        return np.vstack([w.T @ w, w.sum(axis=0)])

    k = len(values)
    moments = _summed(rows, (k + 1, k), square) / n
    error = float(np.abs(moments[:k] - np.outer(moments[k], moments[k]) - np.eye(k)).max())
    explained = values / trace

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _matrices(batches):
            off = [v if v < 1 << 63 else None for v in deviations(x, n, sums)]
            take = np.repeat(np.arange(len(x)), k)
            w = (centred(x) @ turn).ravel()
            yield arrow_batch(_OUT, [ids.take(pa.array(take)), np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)), np.full(len(w), n), pa.array(off, type=pa.int64()).take(pa.array(take)), w, np.tile(explained, len(x)), np.full(len(w), error)])

    return rows.mapInArrow(told, _OUT_DDL)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read(spark, sf_dir, "embeddings"))

"""Whitening of embeddings by a matrix-free block Lanczos method.

The covariance is never formed. It is met only in distributed passes over the distinct vectors, each of which gives the sum
of x (x . B) over the centred vectors x for a block B of a few columns. The blocks are orthogonalised against all that came
before, twice; a block that loses rank is filled up with new random directions, so that the space grows until the leading
pairs' residuals are at the level of rounding or until it is the whole space. What reaches the driver, and what is sent with a
pass, is a few columns as long as a vector. Sums and deviations are exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillbook.llm.common import cut, fresh, scratch, table

#: Components, columns of a block, and the residual, as a share of the largest eigenvalue, at which a pair has converged.
COMPONENTS, BLOCK, RESIDUAL = 4, 4, 1e-14
SCALE = 256
#: Eigenvalues below this share of the trace are rounding: the vectors have no extent in that direction.
LEAST_SHARE = 1e-13
#: Partial sums of tasks meet in so many tasks before they reach the driver.
FOLD = 32
_WIDTHS = (np.dtype("<i2"), np.dtype("<i4"), np.dtype("<i8"))
#: Vectors that are in a task's memory as doubles at once.
_ROWS = 4096


def quantised(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows of a list column hold `dims` finite entries, floor(256 * c) of these rows as longs). Beyond the range of a
    long, the nearest long."""
    lengths = np.diff(column.offsets.to_numpy())
    good = np.asarray(column.is_valid()) & (lengths == dims)
    taken = column.filter(pa.array(good))
    flat = taken.flatten()
    known = np.asarray(flat.is_valid()).reshape(-1, dims)
    entries = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    finite = (known & np.isfinite(entries)).all(axis=1)
    good[np.flatnonzero(good)] = finite
    with np.errstate(over="ignore"):
        low = np.floor(entries[finite] * SCALE)
    edge = 2.0**63
    x = np.where(np.abs(low) < edge, low, 0).astype(np.int64)
    x[low >= edge], x[low < -edge] = np.iinfo(np.int64).max, np.iinfo(np.int64).min
    return good, x


def packed(x: np.ndarray) -> list[bytes]:
    """Each vector in the narrowest integers that hold it, so equal vectors are equal bytes."""
    most = np.maximum(x.max(axis=1, initial=0), -1 - x.min(axis=1, initial=0))
    width = np.searchsorted([(1 << 15) - 1, (1 << 31) - 1], most)
    return [row.astype(_WIDTHS[w]).tobytes() for row, w in zip(x, width.tolist(), strict=True)]


def unpacked(rows: list[bytes], dims: int) -> np.ndarray:
    out = np.empty((len(rows), dims), dtype=np.int64)
    sizes = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows)) // max(dims, 1)
    for w in _WIDTHS:
        at = np.flatnonzero(sizes == w.itemsize)
        if len(at):
            out[at] = np.frombuffer(b"".join(rows[i] for i in at), dtype=w).reshape(-1, dims)
    return out


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[np.ndarray]:
    for batch in batches:
        rows = batch.column(0).to_pylist()
        for lo in range(0, len(rows), _ROWS):
            yield unpacked(rows[lo : lo + _ROWS], dims)


def _folded(parts: DataFrame, names: list[str]) -> list:
    """The sums of arrays over all rows, by way of FOLD tasks: at most FOLD rows reach the driver."""
    size = F.spark_partition_id() % FOLD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list = [None] * len(names)
        for batch in batches:
            for k in range(len(names)):
                for v in batch.column(k).to_pylist():
                    v = np.array(v, dtype=object if names[k].startswith("exact") else np.float64)
                    total[k] = v if total[k] is None else total[k] + v
        if total[0] is not None:
            yield pa.record_batch([pa.array([list(t)], parts_schema.field(k).type) for k, t in enumerate(total)], names=names)

    kinds = {"exact": ("array<decimal(38,0)>", pa.list_(pa.decimal128(38, 0))), "sum": ("array<double>", pa.list_(pa.float64()))}
    parts_schema = pa.schema([(n, kinds[n.split("_")[0]][1]) for n in names])
    folded = parts.withColumn("to", size).repartition(FOLD, "to").drop("to").mapInArrow(run, ", ".join(f"{n} {kinds[n.split('_')[0]][0]}" for n in names))
    rows = sorted(folded.collect(), key=str)  # one order, so one rounding
    return [sum(np.array([int(x) for x in r[n]] if n.startswith("exact") else r[n], dtype=object if n.startswith("exact") else np.float64) for r in rows) if rows else None for n in names]


def exact_sums(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """(rows, sums of each dimension) of packed vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dims, dtype=object), np.zeros(dims, dtype=object)
        for x in _blocks(batches, dims):
            n += len(x)
            # halves of 32 bits: the sums of a block of them can't overflow
            high += (x >> 32).sum(axis=0).astype(object)
            low += (x & 0xFFFFFFFF).sum(axis=0).astype(object)
        yield pa.record_batch([pa.array([[n, *(high * (1 << 32) + low)]], pa.list_(pa.decimal128(38, 0)))], names=["exact"])

    (total,) = _folded(fit.mapInArrow(run, "exact array<decimal(38,0)>"), ["exact"])
    return (0, [0] * dims) if total is None else (total[0], list(total[1:]))


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """The sum over dimensions of (n * x - S)^2 of each row, exactly."""
    most = n * max(int(x.max(initial=0)), -int(x.min(initial=0))) + max((abs(s) for s in sums), default=0)
    if most * most * max(len(sums), 1) < 1 << 63:
        return ((n * x - np.array(sums, dtype=np.int64)) ** 2).sum(axis=1).tolist()
    return ((n * x.astype(object) - np.array(sums, dtype=object)) ** 2).sum(axis=1).tolist()


def _mean(n: int, sums: list[int]) -> np.ndarray:
    from fractions import Fraction

    return np.array([float(Fraction(s, n)) for s in sums])


def _product(fit: DataFrame, mean: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The sum over all rows of (x - mean) ((x - mean) . block): one pass."""
    dims = len(mean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(block.shape)
        for x in _blocks(batches, dims):
            centred = x - mean
            total += centred.T @ (centred @ block)
        yield pa.record_batch([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["sum"])

    (total,) = _folded(fit.mapInArrow(run, "sum array<double>"), ["sum"])
    return total.astype(np.float64).reshape(block.shape)


def _orthonormal(new: np.ndarray, basis: np.ndarray, rng: np.random.Generator, scale: float) -> np.ndarray:
    """Columns orthogonal to the basis and to each other: what is left of the columns of new, and where nothing is left of
    one (less than rounding), a random direction instead. Fewer columns if the space is full."""
    dims, out = len(new), np.empty((len(new), 0))
    for column in new.T:
        for start in (column, rng.standard_normal(dims), rng.standard_normal(dims)):
            if basis.shape[1] + out.shape[1] == dims:
                return out
            least = 1e-13 * scale if start is column else 1e-8 * np.linalg.norm(start)
            v = start
            for _ in range(3):
                v = v - basis @ (basis.T @ v)
                v = v - out @ (out.T @ v)
            if np.linalg.norm(v) > least:
                v = v / np.linalg.norm(v)
                v = v - basis @ (basis.T @ v)
                v = v - out @ (out.T @ v)
                out = np.column_stack([out, v / np.linalg.norm(v)])
                break
    return out


def block_lanczos(product, dims: int, wanted: int, block: int = BLOCK, residual: float = RESIDUAL) -> tuple[np.ndarray, np.ndarray]:
    """The `wanted` largest eigenvalues (falling) and unit eigenvectors (columns) of the symmetric operator that
    product(columns) applies. It stops when the residuals of all of them are below `residual` of the largest eigenvalue,
    after a block in which none of them changed, or with a basis of the whole space."""
    rng = np.random.default_rng(11)
    wanted, block = min(wanted, dims), min(max(block, wanted), dims)
    basis, image = np.empty((dims, 0)), np.empty((dims, 0))
    new = _orthonormal(rng.standard_normal((dims, block)), basis, rng, 0.0)
    calm = 0
    while True:
        basis, image = np.column_stack([basis, new]), np.column_stack([image, product(new)])
        projected = basis.T @ image
        values, vectors = np.linalg.eigh((projected + projected.T) / 2)
        values, vectors = values[::-1], vectors[:, ::-1]
        ritz = basis @ vectors[:, :wanted]
        left = np.linalg.norm(image @ vectors[:, :wanted] - ritz * values[:wanted], axis=0)
        scale = max(abs(values[0]), np.finfo(float).tiny)
        # residuals of eigenvalues that lie close together bound the space, not the vectors, so two calm rounds are asked for
        calm = calm + 1 if basis.shape[1] >= wanted and (left <= residual * scale).all() else 0
        if basis.shape[1] == dims or calm == 2:
            return values[:wanted], ritz / np.linalg.norm(ritz, axis=0)
        new = _orthonormal(image[:, -new.shape[1] :], basis, rng, scale)


class Whitening:
    """What a fit found: n and sums of the distinct vectors, components (columns), their eigenvalues and shares of the trace,
    and how far the covariance of what it whitens is from the identity."""

    def __init__(self, n: int, sums: list[int], components: np.ndarray, eigenvalues: np.ndarray, explained: list[float], identity_error: float):
        self.n, self.sums, self.components, self.eigenvalues, self.explained, self.identity_error = n, sums, components, eigenvalues, explained, identity_error


def dimensions(vectors: DataFrame, vector_col: str) -> int:
    """The length that most vectors have, the greatest of several such; 0 without vectors."""
    sizes = vectors.where(F.col(vector_col).isNotNull()).groupBy(F.size(vector_col).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    first = sizes.where("d > 0").orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    return first[0].d if first else 0


def distinct_vectors(vectors: DataFrame, vector_col: str, dims: int) -> DataFrame:
    """Each distinct quantised vector once, packed in the column x. Copies meet as partial aggregates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array(packed(quantised(_list(batch.column(0)), dims)[1]), pa.binary())], names=["x"])

    return vectors.select(vector_col).mapInArrow(run, "x binary").distinct()


def _list(column: pa.Array) -> pa.Array:
    return column if pa.types.is_list(column.type) else column.cast(pa.list_(column.type.value_type))


def fit(vectors: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS) -> tuple[Whitening, int]:
    """(the whitening that the table's distinct vectors give, their length)."""
    dims = dimensions(vectors, vector_col)
    if not dims:
        return Whitening(0, [], np.empty((0, 0)), np.empty(0), [], 0.0), 0
    with scratch(vectors.sparkSession):
        rows = cut(distinct_vectors(vectors, vector_col, dims), "vectors")
        n, sums = exact_sums(rows, dims)
        if not n:
            return Whitening(0, sums, np.empty((dims, 0)), np.empty(0), [], 0.0), dims
        mean = _mean(n, sums)
        trace = _trace(rows, n, sums, dims)
        values, columns = block_lanczos(lambda b: _product(rows, mean, b) / n, dims, components) if trace else (np.empty(0), np.empty((dims, 0)))
        real = values > LEAST_SHARE * trace
        values, columns = values[real], columns[:, real]
        error = _identity_error(rows, n, mean, columns, values) if len(values) else 0.0
        return Whitening(n, sums, columns, values, [float(v / trace) for v in values], error), dims


def _trace(rows: DataFrame, n: int, sums: list[int], dims: int) -> float:
    """The covariance's trace: the sum of all deviations, exact, over n^3."""
    from fractions import Fraction

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(sum(deviations(x, n, sums)) for x in _blocks(batches, dims))
        yield pa.record_batch([pa.array([_digits(total)], pa.list_(pa.decimal128(38, 0)))], names=["exact"])

    (total,) = _folded(rows.mapInArrow(run, "exact array<decimal(38,0)>"), ["exact"])
    return float(Fraction(sum(int(v) << (64 * k) for k, v in enumerate(total)), n**3))


def _digits(value: int) -> list[int]:
    """A long number as six of 64 bits, the least first, whose sums don't pass 38 digits."""
    return [(value >> (64 * k)) & ((1 << 64) - 1) for k in range(6)]


def _identity_error(rows: DataFrame, n: int, mean: np.ndarray, columns: np.ndarray, values: np.ndarray) -> float:
    """The largest entry of the whitened vectors' covariance (centred first) minus the identity."""
    dims, k = len(mean), len(values)
    project = columns / np.sqrt(values)

    def pass_over(centre: np.ndarray) -> list:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, square = np.zeros(k), np.zeros((k, k))
            for x in _blocks(batches, dims):
                z = (x - mean) @ project - centre
                total += z.sum(axis=0)
                square += z.T @ z
            yield pa.record_batch([pa.array([total.tolist()], pa.list_(pa.float64())), pa.array([square.ravel().tolist()], pa.list_(pa.float64()))], names=["sum_z", "sum_zz"])

        return _folded(rows.mapInArrow(run, "sum_z array<double>, sum_zz array<double>"), ["sum_z", "sum_zz"])

    centre = pass_over(np.zeros(k))[0].astype(np.float64) / n
    covariance = pass_over(centre)[1].astype(np.float64).reshape(k, k) / n
    return float(np.abs(covariance - np.eye(k)).max())


def whitened(vectors: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """The rows of vectors, but for vector_col, once for each component: component, n, deviation, whitened, explained,
    identity_error. Existing columns of these names give way.

    Rows go whose vector is null or empty, holds null or non-finite entries, or has another length than most. Entries are
    floored to 1/256. The fit takes each distinct vector once, however often it is there; all rows that remain are whitened. A
    deviation beyond a long is null. There are as many components as directions in which the vectors extend, at most
    `components`: none, and no row, for an empty table or where all vectors are equal. Eigenvectors have either sign, and
    those of equal eigenvalues are any of their space.
    """
    added = StructType.fromDDL("component int, n long, deviation long, whitened double, explained double, identity_error double")
    kept = [c for c in vectors.columns if c != vector_col and c.lower() not in added.names]
    side = vectors.select(*kept, F.col(vector_col).alias(fresh(vectors.select(*kept), "vector_")))
    found, dims = fit(vectors, vector_col, components)
    schema = StructType([*vectors.select(*kept).schema, *added])
    k = len(found.eigenvalues)
    if not k:
        return vectors.sparkSession.createDataFrame([], schema)
    mean, project = _mean(found.n, found.sums), found.components / np.sqrt(found.eigenvalues)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, x = quantised(_list(batch.column(batch.num_columns - 1)), dims)
            rows = np.repeat(np.flatnonzero(good), k)
            far = [d if d < 1 << 63 else None for d in deviations(x, found.n, found.sums)]
            yield pa.record_batch([
                *(batch.column(i).take(pa.array(rows)) for i in range(len(kept))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)), pa.int32()), pa.array(np.full(len(rows), found.n), pa.int64()),
                pa.array([d for d in far for _ in range(k)], pa.int64()), pa.array(((x - mean) @ project).ravel(), pa.float64()),
                pa.array(np.tile(found.explained, len(x)), pa.float64()), pa.array(np.full(len(rows), found.identity_error), pa.float64()),
            ], names=schema.names)

    return side.mapInArrow(run, schema)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))

"""Embedding whitening from a two-pass covariance.

Entries become whole numbers x = floor(scale * c), and the covariance is that of the fit
list: each distinct vector x once. Vectors are packed in the fewest bytes an entry that
hold them, so equal vectors are equal bytes; distinct ones are found by a hash aggregate,
which combines copies before the shuffle, and written once. The first pass sums their
entries as whole numbers, in two halves so that no sum can overflow: the mean is exact. The
second pass centres blocks of rows and sums their outer products, a matrix product a
block. Both end in one partial sum a partition, which ``treeAggregate`` merges, so the
driver gets a few of them, whose size follows the dimensions alone. Eigenvectors of the
covariance (LAPACK, symmetric) are broadcast with the mean, and every row is projected
where it is. A last pass measures the covariance of the projected fit list.

Defined results: rows whose vector is null, or has an entry that is null, not finite, or
beyond a long once scaled, are left out, as are vectors of another length than most
distinct vectors have (the shorter of equally frequent lengths counts). Components are
those whose eigenvalue exceeds the rounding error of the largest; vectors that are all
alike have none and give no rows, nor do no rows. The sign of a component makes its
largest entry positive. Copies share their values, null and repeated ids stay, further
columns are never read. A deviation beyond a long is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, release

SCALE, COMPONENTS = 256, 4
#: Rows of a block of a matrix product.
BLOCK = 4096
_LARGEST = 2**63 - 1
_WIDTHS = (1, 2, 4, 8)


@dataclass(frozen=True)
class Whitening:
    """n and sums of the fit list, eigenvalues and unit eigenvectors (a column each), the
    trace of the covariance, and how far the whitened covariance is from the identity."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float
    scale: int = SCALE

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def projection(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def _scaled(column: pa.Array, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and whole numbers of a column of lists, by length of the lists."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    valid = np.asarray(column.is_valid())
    lengths = np.diff(np.asarray(column.offsets))
    starts = np.asarray(column.offsets)[:-1]
    values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
    for d in np.unique(lengths[valid]).tolist():
        rows = np.flatnonzero(valid & (lengths == d))
        if d:
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(values[starts[rows][:, None] + np.arange(d)] * scale)
                fits = (np.abs(x) < 2.0**63).all(axis=1)  # false for NaN and infinities
            yield rows[fits], x[fits].astype(np.int64)


def _packed(x: np.ndarray) -> list[bytes]:
    """Each row in the fewest bytes an entry, behind that number."""
    least, most = x.min(axis=1), x.max(axis=1)
    width = np.full(len(x), 8)
    for w in reversed(_WIDTHS[:-1]):
        width[(least >= -(1 << 8 * w - 1)) & (most < 1 << 8 * w - 1)] = w
    out: list = [None] * len(x)
    for w in _WIDTHS:
        at = np.flatnonzero(width == w)
        for i, row in zip(at.tolist(), x[at].astype(f"<i{w}"), strict=True):
            out[i] = bytes([w]) + row.tobytes()
    return out


def _unpacked(column: pa.Array, d: int) -> np.ndarray:
    """Whole numbers of packed rows of ``d`` entries."""
    blob = b"".join(column.to_pylist())
    out, at, data = np.empty((len(column), d), np.int64), 0, np.frombuffer(blob, np.uint8)
    sizes = np.asarray(pa.compute.binary_length(column), np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    for w in _WIDTHS:
        at = np.flatnonzero(sizes == 1 + w * d)
        if len(at):
            out[at] = np.ascontiguousarray(data[starts[at][:, None] + 1 + np.arange(w * d)]).view(f"<i{w}")
    return out


def fit_list(vectors: DataFrame, vector_col: str, scale: int = SCALE) -> DataFrame:
    """x (packed) and dims of each distinct vector."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in _scaled(batch.column(0), scale):
                if len(x):
                    yield pa.record_batch([pa.array(_packed(x), pa.binary()), pa.array(np.full(len(x), x.shape[1], np.int32))], names=["x", "dims"])
        release()

    return vectors.select(F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(pack, "x binary, dims int").dropDuplicates(["x", "dims"])


def _summed(fits: DataFrame, d: int, shape: tuple[int, ...], whole: bool, of) -> np.ndarray:
    """The sum over blocks of the fit list of what ``of`` makes of their rows.

    Whole numbers are summed in halves and merged as numbers of any size.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, object if whole else float)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                total = total + of(_unpacked(batch.column(0).slice(at, BLOCK), d))
        parts = [str(v) for v in total.ravel()] if whole else None
        yield pa.record_batch(
            [pa.array([parts], pa.list_(pa.string())), pa.array([b"" if whole else total.tobytes()], pa.binary())], names=["numbers", "bytes"]
        )
        release()

    def read(row) -> np.ndarray:
        return (np.array([int(v) for v in row["numbers"]], object) if whole else np.frombuffer(row["bytes"])).reshape(shape)

    zero = np.zeros(shape, object if whole else float)
    return fits.select("x").mapInArrow(partial, "numbers array<string>, bytes binary").rdd.treeAggregate(zero, lambda a, r: a + read(r), lambda a, b: a + b)


def fit(vectors: DataFrame, vector_col: str = "embedding", components: int | None = COMPONENTS, scale: int = SCALE) -> Whitening | None:
    """The whitening of a table of vectors; None if no component can be told from rounding."""
    fits = materialise(fit_list(vectors, vector_col, scale), "vectors")
    lengths = sorted((-r["n"], r["dims"]) for r in fits.groupBy("dims").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dims").limit(1).collect())
    if not lengths:
        discard(fits)
        return None
    n, d = -lengths[0][0], lengths[0][1]
    own = fits.filter(F.col("dims") == d)

    def sums(x: np.ndarray) -> np.ndarray:
        low, high = (x & 0xFFFFFFFF).sum(axis=0), (x >> 32).sum(axis=0)
        return low.astype(object) + high.astype(object) * (1 << 32)

    total = _summed(own, d, (d,), True, sums).tolist()
    mean = np.array([s / n for s in total])

    def outer(x: np.ndarray) -> np.ndarray:
        centred = x - mean
        return centred.T @ centred

    covariance = _summed(own, d, (d, d), False, outer) / n
    values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[: components or d]
    order = order[values[order] > d * np.finfo(float).eps * max(values[-1], 0.0)]
    if not len(order):
        discard(fits)
        return None
    axes = axes[:, order]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(len(order))])
    onto = axes / np.sqrt(values[order])

    def whitened(x: np.ndarray) -> np.ndarray:
        w = (x - mean) @ onto  # whose mean is 0
        return w.T @ w

    error = np.abs(_summed(own, d, (len(order), len(order)), False, whitened) / n - np.eye(len(order))).max()
    discard(fits)
    return Whitening(n, tuple(total), values[order], axes, float(np.trace(covariance)), float(error), scale)


def transform(vectors: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row per row that has a vector: id, n, deviation (the sum of squares of n * x - sums)
    and the whitened coordinates."""
    shared = vectors.sparkSession.sparkContext.broadcast(model)  # of the size of the vectors' dimensions

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        d, k, mean, onto = len(m.sums), len(m.values), m.mean, m.projection
        for batch in batches:
            for rows, x in _scaled(batch.column(1), m.scale):
                if x.shape[1] != d or not len(x):
                    continue
                far = m.n * int(np.abs(x.astype(float)).max() + 1) + max(map(abs, m.sums))
                if far * far * d <= _LARGEST:
                    deviation = ((m.n * x - np.array(m.sums, np.int64)) ** 2).sum(axis=1).tolist()
                else:  # numbers of any size
                    deviation = [v if v <= _LARGEST else None for v in ((m.n * x.astype(object) - np.array(m.sums, object)) ** 2).sum(axis=1)]
                whitened = pa.FixedSizeListArray.from_arrays(pa.array(((x - mean) @ onto).ravel()), k).cast(pa.list_(pa.float64()))
                yield pa.record_batch(
                    [batch.column(0).take(pa.array(rows)), pa.array(np.full(len(x), m.n)), pa.array(deviation, pa.int64()), whitened],
                    names=["id", "n", "deviation", "whitened"]
                )
        release()

    narrow = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return narrow.mapInArrow(project, "id long, n long, deviation long, whitened array<double>")


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int | None = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """A row per row that has a vector and per component: id, component (from 1, by falling
    eigenvalue), n, deviation, whitened, explained, identity_error."""
    model = fit(vectors, vector_col, components, scale)
    kind = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return vectors.sparkSession.createDataFrame([], kind)
    shares = F.array(*[F.lit(float(v / model.trace)) for v in model.values])
    rows = transform(vectors, model, id_col, vector_col).select("id", "n", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        "id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"),
        F.lit(model.identity_error).alias("identity_error")
    )

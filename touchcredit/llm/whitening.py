"""Whitening of embeddings by an incremental eigendecomposition.

Every partition keeps the eigendecomposition of the centred scatter of the vectors that it has read and updates it by rank
one for each further vector: the new eigenvalues are the roots of a secular equation, after deflation of directions that the
vector does not touch and of equal eigenvalues. Two spectra are combined by as many successive rank-one updates as one of
them has directions, and one more for the distance of their means. All of this fits the directions only; a last pass over
all vectors, centred by their exact sums, projects the covariance on them (Rayleigh-Ritz), which makes eigenvalues and
vectors exact to double precision. Vectors are integers, so that sums and deviations are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import settled

#: Fixed values of the query: how a component becomes an integer.
SCALE, SHIFT = 1024, 100_000
#: Components whose eigenvalue is below this share of the trace are taken for none: the vectors do not vary along them.
NOTHING = 1e-13
#: Rows of a partition that are projected at a time, and spectra that a task combines in one round.
ROWS, FAN = 4096, 8
EPS = np.finfo(float).eps

SPECTRUM = "n bigint, mean array<double>, values array<double>, vectors array<double>"


def secular_update(values: np.ndarray, vectors: np.ndarray, update: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, ascending, and eigenvectors (columns) of V diag(values) V' + weight * update update', weight > 0.

    The roots of 1 + weight * sum(z_i^2 / (d_i - x)) = 0 lie between successive eigenvalues. Directions that `update`
    hardly touches keep their pair; of (nearly) equal eigenvalues a rotation leaves one that it touches. The roots are
    found as distances from the nearer pole, by rational interpolation between the poles (Li's middle way) kept within
    brackets, and z is then recomputed from
    the roots, so that the new vectors are orthogonal whatever the roots' last digits are (Gu and Eisenstat).
    """
    z = vectors.T @ update
    d = values.copy()
    length = float(z @ z)
    if not weight * length > 0:
        return values, vectors
    size = max(abs(d[-1]), abs(d[0]), weight * length)
    small = 8 * EPS * size
    vectors = vectors.copy()
    # Deflation of equal eigenvalues: rotate each close pair so that only its second direction is touched.
    for i in np.flatnonzero(np.diff(d) <= small):
        r = np.hypot(z[i], z[i + 1])
        if r > 0:
            c, s = z[i + 1] / r, z[i] / r
            one, other = vectors[:, i].copy(), vectors[:, i + 1].copy()
            vectors[:, i], vectors[:, i + 1] = c * one - s * other, s * one + c * other
            z[i], z[i + 1] = 0.0, r
    touched = np.flatnonzero(weight * np.abs(z) * np.sqrt(length) > small)
    if not len(touched):
        return values, vectors
    poles, w = d[touched], weight * z[touched] ** 2
    n = len(touched)
    gaps = np.append(np.diff(poles), w.sum())
    # f rises between poles from -inf to +inf. Its sign in the middle says which pole is the nearer one.
    middle = poles + gaps / 2
    at_middle = 1 + (w / (poles[None, :] - middle[:, None])).sum(axis=1)
    upper = (at_middle < 0) & (np.arange(n) < n - 1)
    origin = np.where(upper, np.append(poles[1:], poles[-1]), poles)
    away = poles[None, :] - origin[:, None]
    low = np.where(upper, -gaps / 2, np.where(at_middle < 0, gaps / 2, 0.0))
    high = np.where(upper, 0.0, np.where(at_middle < 0, gaps, gaps / 2))
    root = (low + high) / 2
    # The next pole of each root; the last has none, and any point beyond it gives the same steps.
    own, following = np.diagonal(away), np.append(np.diagonal(away, 1), away[-1, -1] + 2 * gaps[-1])
    below, done = np.tri(n), np.zeros(n, bool)
    for _ in range(80):
        from_root = away - root[:, None]
        part = w / from_root
        f = 1 + part.sum(axis=1)
        slope = part / from_root
        left = (slope * below).sum(axis=1)
        right = slope.sum(axis=1) - left
        # Where the value is rounding only, the root is as good as it can be and stays.
        done |= np.abs(f) <= 4 * EPS * (1 + np.abs(part).sum(axis=1))
        if done.all():
            break
        low, high = np.where(f < 0, root, low), np.where(f < 0, high, root)
        x, y = own - root, following - root
        c, b, a = f - x * left - y * right, x * y * f, (x + y) * f - x * y * (left + right)
        span = np.sqrt(np.maximum(a * a - 4 * b * c, 0.0))
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.where(a <= 0, (a - span) / (2 * c), 2 * b / (a + span))
        new = root + step
        new = np.where((new > low) & (new < high), new, (low + high) / 2)
        new = np.where(done, root, new)
        done |= np.abs(new - root) <= 2 * EPS * np.abs(new)
        root = new
    # distance[i, k] = root_i - pole_k, from the offsets, without cancellation.
    distance = root[:, None] - away
    ratio = distance / np.where(np.eye(n, dtype=bool), 1.0, poles[:, None] - poles[None, :]).T
    better = np.sqrt(np.abs(np.prod(np.where(np.eye(n, dtype=bool), distance, ratio), axis=0)))
    better = np.copysign(better, z[touched])
    parts = better[None, :] / -distance
    parts /= np.linalg.norm(parts, axis=1, keepdims=True)
    d[touched] = origin + root
    vectors[:, touched] = vectors[:, touched] @ parts.T
    order = np.argsort(d, kind="stable")
    return d[order], vectors[:, order]


class Spectrum:
    """The number, mean, and eigendecomposition of the centred scatter of the vectors seen so far."""

    def __init__(self, size: int):
        self.n, self.mean, self.values, self.vectors = 0, np.zeros(size), np.zeros(size), np.eye(size)

    def add(self, x: np.ndarray, times: int = 1) -> None:
        """A vector that occurs `times` times: one centred rank-one update."""
        apart = x - self.mean
        if self.n:
            self.values, self.vectors = secular_update(self.values, self.vectors, apart, self.n * times / (self.n + times))
        self.n += times
        self.mean = self.mean + apart * (times / self.n)

    def merge(self, other: Spectrum) -> None:
        if not self.n:
            self.n, self.mean, self.values, self.vectors = other.n, other.mean, other.values, other.vectors
            return
        for value, direction in zip(other.values, other.vectors.T, strict=True):
            if value > 0:
                self.values, self.vectors = secular_update(self.values, self.vectors, direction, value)
        apart, total = other.mean - self.mean, self.n + other.n
        self.values, self.vectors = secular_update(self.values, self.vectors, apart, self.n * other.n / total)
        self.mean, self.n = self.mean + apart * (other.n / total), total

    def row(self) -> dict:
        return {"n": self.n, "mean": self.mean.tolist(), "values": self.values.tolist(), "vectors": self.vectors.ravel().tolist()}

    @staticmethod
    def of(row: dict) -> Spectrum:
        size = len(row["mean"])
        made = Spectrum(size)
        made.n, made.mean, made.values = row["n"], np.array(row["mean"]), np.array(row["values"])
        made.vectors = np.array(row["vectors"]).reshape(size, size)
        return made


def integer_vectors(embeddings: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, x) with x = floor(SCALE * c) + SHIFT as longs, of the vectors without null or non-finite entries.

    Entries whose x would not be exact as a double (beyond 2 ** 53) count as non-finite.
    """
    c = F.col(column)
    sound = c.isNotNull() & ~F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) >= float(1 << 42)))
    return embeddings.where(sound).select("vec_id", F.transform(c, lambda v: F.floor(v.cast("double") * SCALE) + SHIFT).alias("x"))


def _matrices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of up to ROWS rows with their vectors as a matrix of int64."""
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            part = batch.slice(i, ROWS)
            if part.num_rows:
                yield part, part.column(column).flatten().to_numpy().reshape(part.num_rows, -1)


def _spectra(distinct: DataFrame, size: int) -> DataFrame:
    """One spectrum for each partition of the distinct vectors (x, times)."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Spectrum(size)
        for part, x in _matrices(batches, "x"):
            for row, times in zip(x.astype(float), part.column("times").to_pylist(), strict=True):
                seen.add(row, times)
        if seen.n:
            yield pa.RecordBatch.from_pylist([seen.row()], schema)

    schema = pa.schema([("n", pa.int64()), *((c, pa.list_(pa.float64())) for c in ("mean", "values", "vectors"))])
    return distinct.mapInArrow(fit, SPECTRUM)


def combined(spectra: DataFrame) -> Spectrum | None:
    """The spectrum of all, by rounds in which a task combines up to FAN of them; one spectrum reaches the driver."""
    spectra = settled(spectra)
    schema = pa.schema([("n", pa.int64()), *((c, pa.list_(pa.float64())) for c in ("mean", "values", "vectors"))])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for row in batch.to_pylist():
                if total is None:
                    total = Spectrum(len(row["mean"]))
                total.merge(Spectrum.of(row))
        if total is not None:
            yield pa.RecordBatch.from_pylist([total.row()], schema)

    while (left := spectra.count()) > 1:
        spectra = settled(spectra.repartition(-(-left // FAN)).mapInArrow(merge, SPECTRUM))
    last = spectra.first()
    return Spectrum.of(last.asDict()) if last else None


def _moments(vectors: DataFrame, n: int, sums: np.ndarray, directions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The mean and the second moments (divisor n) of the exactly centred vectors' projections on `directions` (columns)."""
    width = directions.shape[1]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(width), np.zeros((width, width))
        for part, x in _matrices(batches, "x"):
            y = centred(x, n, sums) @ directions
            times = part.column("times").to_numpy().astype(float)[:, None]
            first += (y * times).sum(axis=0)
            second += y.T @ (y * times)
        values = np.concatenate((first, second.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], names=["i", "v"])

    total = np.zeros(width + width * width)
    for i, v in vectors.mapInArrow(project, "i bigint, v double").groupBy("i").agg(F.sum("v")).collect():
        total[i] = v
    return total[:width] / n, total[width:].reshape(width, width) / n


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - sums / n. The whole part of the means is taken off as an integer, so that nothing is lost by their size."""
    whole = sums // n
    return (x - whole) - (sums - whole * n) / n


class Whitener:
    """Components of the integer vectors: means as exact sums, directions (columns), eigenvalues and the trace."""

    def __init__(self, n: int, sums: np.ndarray, directions: np.ndarray, values: np.ndarray, trace: float):
        self.n, self.sums, self.directions, self.values, self.trace = n, sums, directions, values, trace


def fit(vectors: DataFrame, components: int = 8) -> Whitener | None:
    """The first `components` components of (x, times); None without vectors.

    Components along which the vectors do not vary are left out. Signs: each direction's largest entry is positive.
    """
    totals = vectors.select(F.posexplode("x").alias("i", "v"), "times").groupBy("i").agg(F.sum(F.col("v") * F.col("times")).alias("s"), F.sum("times").alias("n"))
    rows = totals.orderBy("i").collect()
    if not rows:
        return None
    n, sums = rows[0].n, np.array([r.s for r in rows], dtype=np.int64)
    spectrum = combined(_spectra(vectors, len(sums)))
    basis, _ = np.linalg.qr(spectrum.vectors)
    _, projected = _moments(vectors, n, sums, basis)
    values, turn = np.linalg.eigh((projected + projected.T) / 2)
    order = np.argsort(values)[::-1][:components]
    order = order[values[order] > NOTHING * max(values.sum(), 0.0)]
    directions = basis @ turn[:, order]
    largest = np.abs(directions).argmax(axis=0)
    directions = directions * np.sign(directions[largest, np.arange(len(order))])
    return Whitener(n, sums, directions, values[order], float(np.trace(projected)))


def whitened(embeddings: DataFrame, components: int = 8, column: str = "embedding") -> DataFrame:
    """Whitened coordinates: vec_id, component (from 1), n, deviation, whitened, explained, identity_error for every row and
    component.

    Rows whose vector is null, is empty, or holds null or non-finite entries are left out, as are vectors that have not the
    commonest number of entries (of equally common ones the smallest). Components along which the vectors do not vary
    (all of them for a single row or equal rows) give no rows. Repeated rows count, and are returned, as often as they
    occur; an empty table gives an empty result. deviation is null where it passes 64 bits. Other columns are not read.
    """
    rows = settled(integer_vectors(embeddings, column).where(F.size("x") > 0))
    spark = embeddings.sparkSession
    fields = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    empty = spark.createDataFrame([], T.StructType([embeddings.schema["vec_id"], *T.StructType.fromDDL(fields).fields[1:]]))
    size = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if size is None:
        return empty
    rows = rows.where(F.size("x") == size.size)
    vectors = settled(rows.groupBy("x").agg(F.count(F.lit(1)).alias("times")))
    whitener = fit(vectors, components)
    if whitener is None or not len(whitener.values):
        return empty
    n, sums, values = whitener.n, whitener.sums, whitener.values
    scaled = whitener.directions / np.sqrt(values)
    mean, second = _moments(vectors, n, sums, scaled)
    error = float(np.abs(second - np.outer(mean, mean) - np.eye(len(values))).max())
    explained, names = values / whitener.trace, empty.columns

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(values)
        for part, x in _matrices(batches, "x"):
            deviations = [exact_deviation(row, n, sums) for row in x]
            made = centred(x, n, sums) @ scaled
            m = part.num_rows
            each = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("vec_id").take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n, np.int64)),
                    pa.array(deviations, pa.int64()).take(pa.array(each)),
                    pa.array(made.ravel()),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, error)),
                ],
                names=names,
            )

    return rows.mapInArrow(project, empty.schema)


def exact_deviation(x: np.ndarray, n: int, sums: np.ndarray) -> int | None:
    """The sum of (n * x - sums) ** 2, or None if it passes 64 bits."""
    rough = x.astype(float) * n - sums
    if float(rough @ rough) < 2.0**62 and float(np.abs(x).max()) * n < 2.0**62:
        apart = n * x - sums
        return int(apart @ apart)
    total = sum((n * int(v) - int(s)) ** 2 for v, s in zip(x, sums, strict=True))
    return total if total < 1 << 63 else None

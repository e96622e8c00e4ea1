"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

The covariance V is never formed. One pass over the table gives V Q for a block Q of a few columns: every task sums
(x - m)((x - m)' Q) over its rows and Spark adds the sums. A Chebyshev polynomial of V, by its three-term recurrence of
such passes, damps the unwanted part of the spectrum; then QR and Rayleigh-Ritz give estimates whose residuals certify
them. The driver holds (dimensions x columns) numbers only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import stored

#: An entry c becomes the whole number floor(SCALE * c) + SHIFT, so sums are exact in any order.
SCALE, SHIFT = 1024, 100_000
GUARD = 24  # columns beyond the wanted components: a pass costs little more, and fewer are needed
DEGREE = 8  # passes of one filter
#: Certified: residuals |V q - e q| of the wanted components below this share of the largest eigenvalue.
TOLERANCE = 1e-13
MAX_FILTERS = 60
#: Components of less than this share of the trace are rounding, not directions.
NOTHING = 1e-12


@dataclass
class Whitening:
    """Sums over the fit list and its leading components (columns of ``vectors``), all that ``apply`` needs."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    residual: float = 0.0
    passes: int = 0

    @property
    def mean(self) -> np.ndarray:
        return np.array([total / self.n for total in self.sums])


def usable(frame: DataFrame, vector: str = "embedding") -> DataFrame:
    """The rows whose vector has entries, all of them finite numbers, and the most frequent length (ties: the longest)."""
    bad = F.exists(F.col(vector), lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    held = frame.where((F.size(F.col(vector)) > 0) & ~bad)
    length = held.groupBy(F.size(F.col(vector)).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return held.where(F.size(F.col(vector)) == (length["size"] if length else 0))


def whole_numbers(frame: DataFrame, vector: str = "embedding", out: str = "x") -> DataFrame:
    """The vector as array<bigint>: floor(SCALE * c) + SHIFT of every entry as double."""
    return frame.withColumn(out, F.transform(
        F.col(vector), lambda c: F.floor(c.cast("double") * SCALE).cast("long") + F.lit(SHIFT).cast("long")))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The lists of a batch as a matrix, one row each, without a copy of the numbers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def _total(frame: DataFrame, partial: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum over all rows of frame(x array<double or bigint>) of ``partial(matrix of a batch)``, a matrix of ``shape``."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                total += partial(_matrix(batch.column(0)))
        flat = pa.FixedSizeListArray.from_arrays(pa.array(total.ravel()), shape[1]).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(shape[0], dtype=np.int32)), flat], ["row", "part"])

    parts = frame.select("x").mapInArrow(sums, "row int, part array<double>")
    summed = parts.groupBy("row").agg(*[F.sum(F.get("part", F.lit(i))).alias(f"c{i}") for i in range(shape[1])])
    out = np.zeros(shape)
    for row in summed.collect():  # shape[0] rows
        out[row["row"]] = row[1:]
    return out


def fit(frame: DataFrame, components: int = 8, tolerance: float = TOLERANCE, seed: int = 7) -> Whitening:
    """The leading eigenvectors of the covariance of frame(x array<bigint>), all of one length; divisor n, centred first.

    Fewer components come back where the covariance has a smaller rank; none for an empty table or equal rows. Ends when
    the residual of every component is below ``tolerance`` times the largest eigenvalue, or rounding keeps the residuals
    from falling further; ``residual`` tells which share was reached. Read once per pass, so ``frame`` should be stored.
    """
    counted = frame.select(F.posexplode("x")).groupBy("pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n"))
    sums = sorted((row["pos"], int(row["s"]), row["n"]) for row in counted.collect())  # one row per dimension
    if not sums:
        return Whitening(0, [], 0.0, np.zeros(0), np.zeros((0, 0)))
    n, d = sums[0][2], len(sums)
    model = Whitening(n, [total for _, total, _ in sums], 0.0, np.zeros(0), np.zeros((d, 0)))
    mean = model.mean

    def times(q: np.ndarray) -> np.ndarray:
        model.passes += 1
        return _total(frame, lambda x: (c := x - mean).T @ (c @ q), q.shape) / n

    model.trace = float(_total(frame, lambda x: ((x - mean) ** 2).sum(axis=0)[:, None], (d, 1)).sum() / n)
    if model.trace <= 0:
        return model
    width, wanted = min(d, components + GUARD), min(d, components)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, width)))[0]
    values, vectors, images = _ritz(q, times(q))
    best = None
    for _ in range(MAX_FILTERS):
        residual = np.linalg.norm(images - vectors * values, axis=0)[:wanted].max() / values[0]
        if best is None or residual < best[0]:
            best = (residual, values, vectors)
        elif residual < 1e-10:  # at the level of rounding, further passes do not help
            break
        if residual <= tolerance or width == d:
            break
        # The block's smallest Ritz value bounds the unwanted spectrum from above, 0 bounds it from below.
        filtered = _filter(times, vectors, values, images)
        q = np.linalg.qr(filtered)[0]
        values, vectors, images = _ritz(q, times(q))
    model.residual, values, vectors = best
    keep = values[:wanted] > NOTHING * model.trace
    model.values, model.vectors = values[:wanted][keep], vectors[:, :wanted][:, keep]
    return model


def _ritz(q: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rayleigh-Ritz in the span of q: values in falling order, vectors, and V times the vectors."""
    small = q.T @ image
    values, turn = np.linalg.eigh((small + small.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    return values, q @ turn, image @ turn


def _filter(times, block: np.ndarray, values: np.ndarray, image: np.ndarray) -> np.ndarray:
    """A Chebyshev polynomial of V, small on [0, values[-1]] and 1 at values[0], times the block (V block is known)."""
    half = max(values[-1] / 2, values[0] * 1e-9)
    sigma = first = half / (values[0] - half) if values[0] > half else 1.0
    before, now = block, (image - half * block) * (sigma / half)
    for _ in range(DEGREE - 1):
        after = 1 / (2 / first - sigma)
        before, now = now, (times(now) - half * now) * (2 * after / half) - before * (sigma * after)
        sigma = after
    return now


def deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Exact sums over the dimensions of (n x - S)^2; whole numbers of any size."""
    low, high = int(x.min(initial=0)), int(x.max(initial=0))
    if n * max(abs(low), abs(high)) < 2**62 and max(abs(s) for s in sums) < 2**62:
        apart = n * x - np.array(sums, dtype=np.int64)
        if int(np.abs(apart).max(initial=0)) ** 2 * len(sums) < 2**63:
            return (apart**2).sum(axis=1).tolist()
    return [sum((n * value - total) ** 2 for value, total in zip(row, sums)) for row in x.tolist()]


def project(frame: DataFrame, model: Whitening, out: str = "white") -> DataFrame:
    """All columns of frame(x array<bigint>, ...) and the struct ``out``: deviation long, values array<double>.

    A deviation beyond a long is null.
    """
    n, sums, mean = model.n, model.sums, model.mean if model.n else np.zeros(0)
    turn = model.vectors / np.sqrt(model.values) if model.n else np.zeros((0, 0))

    @F.pandas_udf("deviation long, values array<double>")
    def white(x: pd.Series) -> pd.DataFrame:
        if x.empty:
            return pd.DataFrame({"deviation": pd.Series([], dtype="Int64"), "values": []})
        rows = np.stack(x.to_numpy())
        exact = [value if value < 2**63 else None for value in deviation(rows, n, sums)]
        return pd.DataFrame({"deviation": pd.Series(exact, dtype="Int64"), "values": list((rows - mean) @ turn)})

    return frame.withColumn(out, white("x"))


def identity_error(frame: DataFrame, k: int, n: int) -> float:
    """The largest absolute entry of the covariance of frame(x array<double>), k entries a row, minus the identity."""
    if not k or not n:
        return 0.0
    mean = _total(frame, lambda x: x.sum(axis=0)[:, None], (k, 1))[:, 0] / n
    covariance = _total(frame, lambda x: (c := x - mean).T @ c, (k, k)) / n
    return float(np.abs(covariance - np.eye(k)).max())


def whiten(frame: DataFrame, vector: str = "embedding", components: int = 8, out: str = "white") -> DataFrame:
    """The usable rows of ``frame`` with the struct ``out``: n, deviation, values, explained and identity_error.

    values holds the whitened coordinates, explained the share of the trace of each component; both have at most
    ``components`` entries, fewer where the covariance has a smaller rank. A row whose vector is null, empty or of another
    length than most, or holds null or numbers that are not finite, goes. Repeated rows count as often as they occur. An
    empty table gives an empty table. Input columns may have any name; one named like ``out`` is replaced.
    """
    names = [name for name in frame.columns if name != out]
    held = stored(whole_numbers(usable(frame, vector), vector, "__x").select(F.struct(*names).alias("row"), F.col("__x").alias("x")))
    model = fit(held.select("x"), components)
    projected = stored(project(held, model).drop("x"))
    error = identity_error(projected.select(F.col("white.values").alias("x")), len(model.values), model.n)
    explained = F.array(*[F.lit(float(value / model.trace)) for value in model.values]).cast("array<double>")
    return projected.select("row.*", F.struct(
        F.lit(model.n).cast("long").alias("n"), "white.deviation", "white.values", explained.alias("explained"),
        F.lit(error).alias("identity_error")).alias(out))

"""Whitening of vectors by eigenvectors of their covariance, refined from single to double precision.

Vectors are put on an integer grid, so that counts, sums and deviations are exact. The covariance of
the distinct grid vectors is summed in tasks: every partition centres its vectors before it multiplies
and gives one row of its partial product per dimension; partial rows are summed in two rounds, in the
order of their partitions. Only the covariance, dimensions squared, reaches the driver.

Its eigenvectors are found in float32 and then corrected by the iteration of Ogita and Aishima, matrix
multiplications in float64 that square the error where eigenvalues are apart. Eigenvalues that are too
close for the present error form a cluster: their vectors only stay orthogonal in a step, and a
sub-solve turns them by the eigenvectors, in float32 again, of the covariance inside the cluster minus
the cluster's centre. The error inside a cluster shrinks with its width, so clusters fall apart until
what remains together is so narrow that the sub-solve itself is exact to double precision.

Edge cases: vectors that are null or empty or hold a null, a non-finite entry or one beyond 2 ** 46
take no part; neither do vectors of another length than most (of the longer one in a tie). Rows that
repeat, null ids and shared ids give rows of their own. A direction without variance cannot be
whitened: its ``whitened`` is null, and it is left out of ``identity_error``. A deviation too large for a
long is null. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flipside.session import materialize

SCALE, SHIFT = 64, 1_000_000
LARGEST = 2.0**46
LOW_BITS = 26
# Steps of the refinement; from float32, three or four do where no eigenvalues cluster.
MAX_STEPS = 40
TOO_CLOSE = np.sqrt(np.finfo(np.float64).eps)

RESULT = (
    "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
)


def grid_vectors(embeddings: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """Rows ``(vec_id, x)`` of all usable vectors, ``x = floor(64 * c) + 1000000``."""
    vector = F.col(vector_column)
    sound = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < LARGEST))
    usable = embeddings.filter((F.size(vector) > 0) & F.coalesce(sound, F.lit(False)))
    x = F.transform(vector, lambda c: F.floor(SCALE * c.cast("double")).cast("bigint") + SHIFT)
    rows = usable.select(F.col(id_column).cast("bigint").alias("vec_id"), x.alias("x"))
    # One row per length that occurs.
    lengths = rows.groupBy(F.size("x").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).limit(1)
    return rows.join(F.broadcast(lengths.select("length")), F.size("x") == F.col("length"), "left_semi")


def matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def exact_sums(fit: DataFrame) -> tuple[int, list[int]]:
    """How many vectors there are, and the sum of each dimension, in whole numbers."""

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("x"))
                high, low = (x >> LOW_BITS).sum(axis=0), (x & ((1 << LOW_BITS) - 1)).sum(axis=0)
                places = np.arange(x.shape[1], dtype=np.int32)
                counts = np.full(x.shape[1], len(x))
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (places, counts, high, low)], ["place", "n", "high", "low"])

    parts = fit.mapInArrow(partial, "place int, n bigint, high bigint, low bigint")
    wide = [F.sum(F.col(name).cast("decimal(38,0)")).alias(name) for name in ("high", "low")]
    # One row per dimension.
    rows = parts.groupBy("place").agg(F.sum("n").alias("n"), *wide).orderBy("place").collect()
    return (rows[0].n if rows else 0), [(int(row.high) << LOW_BITS) + int(row.low) for row in rows]


@dataclass(frozen=True)
class Centre:
    """The mean ``sums / n``, as whole numbers near it and the rest."""

    n: int
    sums: tuple[int, ...]

    @property
    def near(self) -> np.ndarray:
        return np.array([round(s / self.n) for s in self.sums], np.int64)

    @property
    def left(self) -> list[int]:
        """``sums - n * near``, exact."""
        return [s - self.n * int(c) for s, c in zip(self.sums, self.near, strict=True)]

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.near).astype(np.float64) - np.array([rest / self.n for rest in self.left])

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Sum over dimensions of ``(n * x - sums) ** 2``, exact; null if too large for a long."""
        apart, left = x - self.near, self.left
        reach = max([self.n * int(np.abs(apart).max(initial=0)) + abs(rest) for rest in left], default=0)
        if len(left) * reach * reach < 2**63:
            scaled = self.n * apart - np.array(left, np.int64)
            return pa.array((scaled * scaled).sum(axis=1))
        exact = [sum((self.n * a - rest) ** 2 for a, rest in zip(row, left, strict=True)) for row in apart.tolist()]
        return pa.array([value if value < 2**63 else None for value in exact], pa.int64())


def summed_products(fit: DataFrame, vectors: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """``sum of v v'`` over the ``vectors(x)`` of all rows, added in the order of the partitions."""

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                v = vectors(matrix(batch.column("x")))
                total = v.T @ v if total is None else total + v.T @ v
        if total is not None:
            rows = pa.array(list(total), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), rows], ["place", "row"])

    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        total = matrix(table.column("row")).sum(axis=0)
        first = table.slice(0, 1)
        return first.set_column(first.schema.get_field_index("row"), "row", pa.array([total], pa.list_(pa.float64())))

    parts = fit.mapInArrow(partial, "place int, row array<double>").withColumn("part", F.spark_partition_id())
    parts = materialize(parts, "partial-products")
    # As many groups of parts as parts in a group, so that neither round holds many.
    width = int(np.ceil(np.sqrt((parts.agg(F.max("part")).first()[0] or 0) + 1)))
    kinds = "place int, row array<double>, part int"
    first = parts.withColumn("run", F.floor(F.col("part") / width)).groupBy("place", "run")
    once = first.applyInArrow(lambda table: add(table).drop_columns(["run"]), kinds)
    rows = once.groupBy("place").applyInArrow(add, kinds).orderBy("place").select("row").collect()
    return np.array([row.row for row in rows])


def _correct(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """One step of Ogita and Aishima: new vectors, eigenvalues, and how far the old vectors were off, as
    the gap that eigenvalues must have to be told apart.

    Closer than ``TOO_CLOSE`` of the norm, rounding alone would turn a pair by more than a step can
    repair, so such pairs are left to the sub-solves whatever the gap.
    """
    r = np.eye(len(a)) - x.T @ x
    s = x.T @ (a @ x)
    # Symmetric to the last digit, so that a step turns the basis and does not shear it.
    r, s = (r + r.T) / 2, (s + s.T) / 2
    values = np.diag(s) / (1 - np.diag(r))
    norm = np.linalg.norm(a)
    gap = 2 * (np.linalg.norm(s - np.diag(values)) + norm * np.linalg.norm(r))
    apart = values[None, :] - values[:, None]
    near = np.abs(apart) <= max(gap, TOO_CLOSE * norm)
    mean = (values[None, :] + values[:, None]) / 2
    turn = np.where(near, 0.0, (s + mean * r) / np.where(near, 1.0, apart))
    return x + x @ (turn + r / 2), values, gap


def _clusters(values: np.ndarray, gap: float) -> list[np.ndarray]:
    """Places of eigenvalues that follow one another within ``gap``, two at least."""
    order = np.argsort(values, kind="stable")
    cuts = np.flatnonzero(np.diff(values[order]) > gap) + 1
    return [run for run in np.split(order, cuts) if len(run) > 1]


def _single_vectors(a: np.ndarray) -> np.ndarray:
    """Eigenvectors of a symmetric matrix in float32."""
    size = np.abs(a).max(initial=0.0)
    if size == 0:
        return np.eye(len(a))
    return np.linalg.eigh((a / size).astype(np.float32))[1].astype(np.float64)


def refined_eigen(a: np.ndarray, max_steps: int = MAX_STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, to double precision."""
    norm = np.linalg.norm(a)
    x = _single_vectors(a)
    for _ in range(max_steps):
        better, values, gap = _correct(a, x)
        if gap <= 4 * len(a) * np.finfo(np.float64).eps * norm:
            break
        x = better
        for cluster in _clusters(values, max(gap, TOO_CLOSE * norm)):
            basis = x[:, cluster]
            inside = basis.T @ (a @ basis - values[cluster].mean() * basis)
            # Made orthogonal in double precision, so that the turn leaves the basis as orthogonal as it was.
            x[:, cluster] = basis @ np.linalg.qr(_single_vectors((inside + inside.T) / 2))[0]
    r = 1 - (x * x).sum(axis=0)
    values = (x * (a @ x)).sum(axis=0) / (1 - r)
    order = np.argsort(-values, kind="stable")
    return values[order], x[:, order] / np.sqrt(1 - r[order])


@dataclass(frozen=True)
class Whitening:
    """The components of a fit; ``scaled`` holds eigenvectors over the root of their eigenvalue."""

    centre: Centre
    scaled: np.ndarray
    defined: np.ndarray
    explained: np.ndarray
    identity_error: float

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centre.centred(x) @ self.scaled


def fit_whitening(rows: DataFrame, components: int) -> Whitening | None:
    """Fit on each distinct ``x`` of the rows once; None without rows."""
    fit = materialize(rows.select("x").distinct(), "fit-vectors")
    n, sums = exact_sums(fit)
    if not n:
        return None
    centre = Centre(n, tuple(sums))
    covariance = summed_products(fit, centre.centred) / n
    values, vectors = refined_eigen(covariance)
    values, vectors = values[:components], vectors[:, :components]
    defined = values > np.finfo(np.float64).eps * len(covariance) * max(values[0], 0.0)
    scaled = vectors / np.sqrt(np.where(defined, values, 1.0))
    total = np.trace(covariance)
    explained = values / total if total > 0 else np.zeros(len(values))
    model = Whitening(centre, scaled, defined, explained, 0.0)
    spread = summed_products(fit, model.project) / n
    error = np.abs((spread - np.eye(len(values)))[np.ix_(defined, defined)]).max(initial=0.0)
    return Whitening(centre, scaled, defined, explained, float(error))


def whiten(
    embeddings: DataFrame, components: int = 16, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """One row per usable vector and component, the largest eigenvalue first."""
    rows = grid_vectors(embeddings, id_column, vector_column)
    model = fit_whitening(rows, components)
    if model is None:
        return embeddings.sparkSession.createDataFrame([], RESULT)

    def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("x"))
            k, each = len(model.defined), np.repeat(np.arange(len(x)), len(model.defined))
            arrays = [
                batch.column("vec_id").take(pa.array(each)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(each), model.centre.n)),
                model.centre.deviations(x).take(pa.array(each)),
                pa.array(model.project(x).ravel(), mask=np.tile(~model.defined, len(x))),
                pa.array(np.tile(model.explained, len(x))),
                pa.array(np.full(len(each), model.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(arrays, [part.split()[0] for part in RESULT.split(", ")])

    return rows.mapInArrow(project, RESULT)

"""Quality classifier: regularised quadratic discriminant over document statistics.

Every document becomes a short vector of transformed statistics in one pass over its text. Class
means and covariances are sums over the labelled training rows, added up by Spark; covariances
are shrunk towards their diagonal and by a ridge, and their Cholesky factors are computed once and
sent along with the scoring function. A score is the logistic of the difference of Mahalanobis
log-densities, divided by a temperature that leaves the decision as it is.

Edge cases: a null or empty text has the statistics of an empty text and is scored like any
other; labels other than 0 and 1 are not learned from; without training rows of both classes
every score is 0.5; rows that share an id are scored each for itself (and learned from once per matching label); an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flipside.llm.common import byte_strings, lean, texts
from flipside.session import materialize

SHRINKAGE = 0.1
RIDGE = 1e-3
TEMPERATURE = 4.0

# Byte classes: 0 other, then as named below.
UPPER, DIGIT, LINE, STOP, SHOUT, SYMBOL, FOREIGN = range(1, 8)


def byte_classes() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for name, members in (
        (UPPER, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        (DIGIT, b"0123456789"),
        (LINE, b"\n"),
        (STOP, b".,;:?'\"-()"),
        (SHOUT, b"!"),
        (SYMBOL, b"#$%&*+/<=>@[\\]^_`{|}~"),
        (FOREIGN, range(128, 256)),
    ):
        table[list(members)] = name
    return table


BYTE_CLASSES = byte_classes()
STATISTICS = (
    "log_bytes", "log_word_length", "upper", "digit", "line", "stop", "shout", "symbol", "foreign",
    "distinct_words", "repeated_next", "top_word", "distinct_lines", "log_compressed", "marked_words",
    "log_longest_word",
)


def statistics(text: bytes) -> list[float]:
    """Transformed statistics of a UTF-8 text, in the order of ``STATISTICS``."""
    size = max(len(text), 1)
    shares = np.bincount(BYTE_CLASSES[np.frombuffer(text, np.uint8)], minlength=8)[1:] / size
    words = text.split()
    n_words = max(len(words), 1)
    counts = Counter(words)
    repeated = sum(map(bytes.__eq__, words, words[1:]))
    lines = [line for line in text.split(b"\n") if line]
    marked = sum(not word[-1:].isalnum() and word[-1] < 128 for word in words)
    return [
        np.log1p(len(text)),
        np.log1p(size / n_words),
        *np.sqrt(shares),
        np.log1p(len(counts)) / np.log1p(n_words),
        (repeated / n_words) ** 0.5,
        (max(counts.values(), default=0) / n_words) ** 0.5,
        len(set(lines)) / max(len(lines), 1),
        np.log(len(zlib.compress(text, 1)) / (size + 32)),
        (marked / n_words) ** 0.5,
        np.log1p(max(map(len, counts), default=0)),
    ]


def statistics_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = [statistics(text) for text in byte_strings(batch.column("text"))]
        carried = [name for name in batch.schema.names if name != "text"]
        arrays = [*[batch.column(name) for name in carried], pa.array(values, pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(arrays, names=[*carried, "x"])


def document_statistics(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", number: str | None = None
) -> DataFrame:
    """``(id, x)``, and the column ``number`` if one is named, a bigint."""
    more = [] if number is None else [F.col(number)]
    kinds = "id bigint, " + ("" if number is None else f"`{number}` bigint, ") + "x array<double>"
    return texts(documents, id_column, text_column, *more).mapInArrow(lean(statistics_batches), kinds)


def rows_of(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def moment_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of ``(1, x)`` times its transpose per class, one row per cell."""
    for batch in batches:
        x = np.concatenate([np.ones((batch.num_rows, 1)), rows_of(batch.column("x"))], 1) if batch.num_rows else None
        label = batch.column("label").to_numpy(zero_copy_only=False)
        for cls in np.unique(label) if x is not None else ():
            own = x[label == cls]
            sums = own.T @ own
            cells = np.arange(sums.size, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(sums.size, cls, np.int32)), pa.array(cells), pa.array(sums.ravel())],
                names=["label", "cell", "value"],
            )


@dataclass
class Discriminant:
    """Means, Cholesky factors of the shrunk covariances, and log normalisers of both classes."""

    means: list[np.ndarray]
    factors: list[np.ndarray]
    offsets: list[float]
    temperature: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not self.means:
            return np.full(len(x), 0.5)
        density = []
        for mean, factor, offset in zip(self.means, self.factors, self.offsets, strict=True):
            scaled = np.linalg.solve(factor, (x - mean).T)
            density.append(offset - 0.5 * (scaled**2).sum(0))
        return 1 / (1 + np.exp(-np.clip((density[1] - density[0]) / self.temperature, -700, 700)))


def fit_discriminant(
    labelled: DataFrame,
    shrinkage: float = SHRINKAGE,
    ridge: float = RIDGE,
    temperature: float = TEMPERATURE,
) -> Discriminant:
    """Fit on rows ``(x, label)``; what reaches the driver is two matrices of sums."""
    sums = labelled.select("x", F.col("label").cast("int").alias("label")).mapInArrow(
        moment_batches, "label int, cell int, value double"
    )
    size = len(STATISTICS) + 1
    moments = {cls: np.zeros(size * size) for cls in (0, 1)}
    for label, cell, value in sums.groupBy("label", "cell").agg(F.sum("value")).collect():
        moments[label][cell] = value
    moments = {cls: values.reshape(size, size) for cls, values in moments.items()}
    counts = {cls: values[0, 0] for cls, values in moments.items()}
    if min(counts.values()) < 1:
        return Discriminant([], [], [], temperature)
    means, factors, offsets = [], [], []
    for cls in (0, 1):
        mean = moments[cls][0, 1:] / counts[cls]
        covariance = moments[cls][1:, 1:] / counts[cls] - np.outer(mean, mean)
        diagonal = np.diag(np.maximum(np.diag(covariance), 0))
        shrunk = (1 - shrinkage) * covariance + shrinkage * diagonal + ridge * np.eye(size - 1)
        factor = np.linalg.cholesky(shrunk)
        means.append(mean)
        factors.append(factor)
        offsets.append(float(np.log(counts[cls] / sum(counts.values())) - np.log(np.diag(factor)).sum()))
    return Discriminant(means, factors, offsets, temperature)


def fit_quality(
    vectors: DataFrame, labels: DataFrame, is_training: Column, label_column: str = "quality", id_column: str = "doc_id"
) -> Discriminant:
    """Learn from the rows of ``vectors (id, x)`` whose label meets ``is_training``, a condition on ``id``."""
    known = labels.select(F.col(id_column).cast("bigint").alias("id"), F.col(label_column).alias("label"))
    known = known.filter(F.col("label").isin(0, 1) & is_training)
    return fit_discriminant(vectors.join(known, "id"))


def score_quality(
    documents: DataFrame,
    labels: DataFrame,
    is_training: Column,
    label_column: str = "quality",
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``(doc_id, score)`` of every document; learned from labelled rows that meet ``is_training``,
    a condition on the column ``id``."""
    vectors = materialize(document_statistics(documents, id_column, text_column), "statistics")
    return score_vectors(fit_quality(vectors, labels, is_training, label_column, id_column), vectors)


def score_vectors(model: Discriminant, vectors: DataFrame) -> DataFrame:
    """``(doc_id, score)`` of ``vectors (id, x)``."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                scores = pa.array(model.probability(rows_of(batch.column("x"))))
                yield pa.RecordBatch.from_arrays([batch.column("id"), scores], names=["doc_id", "score"])

    return vectors.mapInArrow(score, "doc_id bigint, score double")

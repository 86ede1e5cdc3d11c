import math

import numpy as np
import pytest

from flipside.llm import whitening
from flipside.llm.queries import QUERIES, read_table

SCHEMA = "vec_id bigint, embedding array<float>, n bigint, x string"


def orthogonal(random, d):
    return np.linalg.qr(random.normal(size=(d, d)))[0]


@pytest.mark.parametrize(
    "values",
    [
        np.linspace(1, 50, 40),
        np.r_[np.full(10, 3.0), np.full(10, 3.0 + 1e-9), np.linspace(4, 9, 20)],
        3.0 + np.arange(30) * 1e-8,
        np.r_[1.0, 1.0, 1.0, 2.0, 2.0, 5.0],
        np.r_[np.zeros(5), 1e-12, 1e-6, 1.0, 1e6],
        np.array([7.0]),
        np.zeros(4),
    ],
    ids=["apart", "two clusters", "one dense cluster", "multiple", "graded", "one", "zero"],
)
def test_refinement_reaches_double_precision(values):
    random = np.random.default_rng(5)
    q = orthogonal(random, len(values))
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    found, vectors = whitening.refined_eigen(a)
    scale = max(np.abs(values).max(), 1e-300)
    assert np.abs(found - np.sort(values)[::-1]).max() <= 1e-13 * scale
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() <= 1e-13
    assert np.abs(a @ vectors - vectors * found).max() <= 1e-13 * scale


def test_single_precision_alone_would_not_do():
    random = np.random.default_rng(5)
    q = orthogonal(random, 40)
    a = (q * np.linspace(1, 50, 40)) @ q.T
    vectors = whitening._single_vectors(a)
    assert np.abs(a @ vectors - vectors * np.diag(vectors.T @ a @ vectors)).max() > 1e-7
    want = np.linalg.eigh(a)[1][:, ::-1]
    got = whitening.refined_eigen(a)[1]
    assert np.abs(np.abs((want * got).sum(axis=0)) - 1).max() < 1e-13


def plain(rows, components):
    """The definition over rows (vec_id, vector), eigenvectors by numpy in double precision."""
    usable = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in usable}))
    n, sums = len(fit), [sum(int(v) for v in column) for column in fit.T]
    centred = fit - fit.mean(axis=0)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    found = []
    for i, x in usable:
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        for k in range(min(components, len(values))):
            found.append((i, k + 1, n, deviation, float((x - fit.mean(axis=0)) @ vectors[:, k] / math.sqrt(values[k])), values[k] / values.sum()))
    return sorted(found, key=lambda row: (str(row[0]), row[3], row[1]))


def check(got, want):
    got = sorted(got, key=lambda row: (str(row.vec_id), row.deviation, row.component))
    assert [tuple(row)[:4] for row in got] == [row[:4] for row in want]
    ours, theirs = (np.array([row[4] for row in rows]).reshape(-1, max(r[1] for r in want)) for rows in (got, want))
    ours = ours * np.sign((ours * theirs).sum(axis=0))
    assert np.abs(ours - theirs).max() < 1e-8
    assert np.allclose([row.explained for row in got], [row[5] for row in want], rtol=1e-10)
    assert {row.identity_error for row in got} == {got[0].identity_error} and got[0].identity_error < 1e-10


def test_whole_table(spark, folder):
    rows = [(r.vec_id, r.embedding) for r in read_table(spark, folder, "embeddings").collect()]
    check(QUERIES["op12_refined_whitening"](spark, folder).collect(), plain(rows, 16))


def test_awkward_vectors(spark):
    random = np.random.default_rng(2)
    rows = [(i, random.normal(size=5).round(3).tolist()) for i in range(60)]
    rows += [(None, rows[3][1]), (3, rows[3][1]), (3, rows[4][1])] + [(100 + i, rows[0][1]) for i in range(40)]
    bad = [(200, None), (201, []), (202, [1.0, None, 1.0, 1.0, 1.0]), (203, [1.0, float("nan"), 1.0, 1.0, 1.0])]
    bad += [(204, [float("inf")] * 5), (205, [1e30] * 5), (206, [1.0, 2.0])]
    frame = spark.createDataFrame([(i, v, 1, "y") for i, v in rows + bad], SCHEMA).repartition(7)
    check(whitening.whiten(frame, components=16).collect(), plain(rows, 16))
    assert whitening.whiten(frame.limit(0)).count() == 0
    assert whitening.whiten(frame.filter("vec_id between 200 and 205")).count() == 0


def test_directions_without_variance_are_null(spark):
    rows = [(i, [float(i), 1.0, float(2 * i)], 0, "") for i in range(9)] + [(20, [3.0, 1.0, 6.0], 0, "")]
    found = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.component, r.whitened is None) for r in found} == {(1, False), (2, True), (3, True)}
    assert {r.n for r in found} == {9} and found[0].identity_error < 1e-12
    one = whitening.whiten(spark.createDataFrame(rows[:1], SCHEMA)).collect()
    assert [(r.deviation, r.whitened, r.explained) for r in one] == [(0, None, 0.0)] * 3


def test_deviations_are_exact():
    centre = whitening.Centre(10**7, (10**13 + 3, 5))
    x = np.array([[10**6 + 7, 0], [2**52, -(2**52)]])
    want = [sum((centre.n * int(a) - s) ** 2 for a, s in zip(row, centre.sums)) for row in x]
    assert centre.deviations(x[:1]).to_pylist() == want[:1]
    assert centre.deviations(x).to_pylist() == [want[0], None]

import numpy as np
import pytest
from pyspark.sql import functions as F

from flipside.llm import cover_tree

SCHEMA = "vec_id bigint, embedding array<float>, row string, dims int, id string"


def plain_search(rows, k, scale=64):
    usable = [(vec_id, np.floor(scale * np.array(vector, np.float32).astype(float)).astype(int)) for vec_id, vector in rows]
    found = []
    for place, (query_id, query) in enumerate(usable):
        if query_id is not None and query_id % 20 == 0:
            others = [(-int(query @ vector), vec_id is None, vec_id or 0) for other, (vec_id, vector) in enumerate(usable) if other != place and len(vector) == len(query)]
            found += [(query_id, rank, None if gone else vec_id, -score) for rank, (score, gone, vec_id) in enumerate(sorted(others)[:k], 1)]
    return sorted(found, key=str)


@pytest.mark.parametrize("kind", ["random", "clustered", "equal", "few"])
def test_search_equals_brute_force(spark, kind):
    rng = np.random.default_rng(11)
    size = 12 if kind == "few" else 700
    vectors = rng.normal(0, 1, (size, 8)).astype(np.float32)
    if kind == "clustered":
        vectors = (rng.normal(0, 3, (6, 8))[rng.integers(0, 6, size)] + 0.05 * vectors).astype(np.float32)
    if kind == "equal":
        vectors[:] = vectors[0]
        vectors[::7] *= -1
    rows = [(vec_id, vector.tolist()) for vec_id, vector in enumerate(vectors)]
    rows += [(40, rows[3][1]), (0, rows[0][1])]  # repeated ids are rows of their own
    broken = [(1000, None), (1020, [None] * 8), (1040, [float("nan")] * 8), (1060, [float("inf")] * 8), (1080, [])]
    rows += [(None, rows[place % size][1]) for place in (1, 20, 40)]  # candidates, never queries
    frame = spark.createDataFrame([(*row, "r", 1, "i") for row in rows + broken], SCHEMA)
    found = cover_tree.top_inner_products(frame, F.col("id") % 20 == 0, k=20, block_rows=256)
    expected = plain_search(rows, 20)
    assert sorted(map(tuple, found.collect()), key=str) == expected
    assert kind == "equal" or any(row[2] is None for row in expected)


def test_no_vectors(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert cover_tree.top_inner_products(frame, F.col("id") % 20 == 0).count() == 0


def test_unequal_lengths_do_not_meet(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0]), (2, [3.0, 1.0])]
    frame = spark.createDataFrame([(*row, "r", 1, "i") for row in rows], SCHEMA)
    found = cover_tree.top_inner_products(frame, F.col("id") % 20 == 0)
    assert list(map(tuple, found.collect())) == [(0, 1, 2, 64 * 64 * 5)]


@pytest.mark.parametrize("spread", [0.0, 1.0, 100.0])
def test_nodes_cover_their_points(spread):
    points = np.random.default_rng(4).normal(0, spread, (900, 5))
    points[:300] = points[0]
    tree = cover_tree.cover_tree(points, leaf_rows=16)
    assert sorted(tree.rows.tolist()) == list(range(900))
    inner = np.flatnonzero(tree.n_children)
    assert (tree.scales[inner] > 0).all() == (spread > 0 or not len(inner))
    for node in range(len(tree.radii)):
        leaves = cover_tree.below(tree, node)
        rows = np.concatenate([tree.rows[tree.first_row[leaf] : tree.first_row[leaf] + tree.n_rows[leaf]] for leaf in leaves])
        assert len(rows) == tree.n_rows[node]
        assert np.sqrt(((points[rows] - tree.centers[node]) ** 2).sum(1)).max() <= tree.radii[node] + 1e-9


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(9)
    data = np.floor(64 * (rng.normal(0, 4, (5, 6))[rng.integers(0, 5, 2000)] + 0.02 * rng.normal(0, 1, (2000, 6)))).astype(np.int64)
    queries = data[:50]
    queries_tree, tree = cover_tree.cover_tree(queries), cover_tree.cover_tree(data)
    for node in range(len(tree.radii)):
        rows = np.concatenate([tree.rows[tree.first_row[leaf] : tree.first_row[leaf] + tree.n_rows[leaf]] for leaf in cover_tree.below(tree, node)])
        assert (queries @ data[rows].T).max() <= cover_tree.bounds(queries_tree, 0, tree, np.array([node]))[0]


@pytest.mark.parametrize("dimensions", [2, 64])
def test_covers_are_within_scale_and_centers_apart(dimensions):
    """Also where all distances are nearly equal; small covers share leaves."""
    points = np.random.default_rng(6).normal(0, 1, (1500, dimensions))
    distance = np.sqrt(((points - points[0]) ** 2).sum(1))
    for share in cover_tree.SHARES:
        scale = share * distance.max()
        owner, centers = cover_tree.cover(points, distance, scale, len(points))
        assert np.sqrt(((points - points[np.array(centers)[owner]]) ** 2).sum(1)).max() <= scale
        between = np.sqrt(((points[centers][:, None] - points[centers]) ** 2).sum(2)) + np.eye(len(centers)) * 1e9
        assert between.min() > scale
    tree = cover_tree.cover_tree(points)
    assert (tree.scales[tree.n_children > 0] > 0).all() and (tree.n_rows[tree.n_children == 0] <= cover_tree.LEAF_ROWS).all()


def test_node_pairs_are_pruned(monkeypatch):
    """On clustered vectors most pairs of leaves are never opened."""
    rng = np.random.default_rng(9)
    centers = rng.normal(0, 400, (40, 6))
    data = np.floor(centers[rng.integers(0, 40, 4000)] + rng.normal(0, 2, (4000, 6))).astype(np.int64)
    opened = []
    merge = cover_tree.merge_best
    monkeypatch.setattr(cover_tree, "merge_best", lambda scores, ids, k: opened.append(len(scores)) or merge(scores, ids, k))
    rows = np.arange(4000)
    scores, _ = cover_tree.dual_search(data[:200], rows[:200], data, rows, rows, 5)
    tree, query_tree = cover_tree.cover_tree(data), cover_tree.cover_tree(data[:200])
    pairs = np.count_nonzero(tree.n_children == 0) * np.count_nonzero(query_tree.n_children == 0)
    assert len(opened) < pairs / 3
    products = data[:200] @ data.T
    products[rows[:200], rows[:200]] = cover_tree.LOWEST
    assert (scores == -np.sort(-products, 1)[:, :5]).all()

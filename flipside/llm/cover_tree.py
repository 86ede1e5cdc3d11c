"""Exact top-k inner products by a dual search over cover trees.

Vectors are dealt at random to blocks of bounded size; every block of queries meets every block
of data, as a stated query set does, and each meeting is one small task. There both sides are
indexed by cover trees: a node is covered from one of its points; the nodes below it belong to points more than a
smaller scale apart that cover it within that scale. The scale is half the node's radius where a few points can cover it
so, a larger share where they cannot (vectors of many dimensions lie at nearly equal distances), and at the largest
share a level takes as many points as it needs. Small covers share a leaf. For the bounds a node keeps the tight ball
around the mean of its points. A pair of nodes is left out when no pair of points below them
can beat the worst kth score of its query group so far:

    <q, p> <= <cq, cp> + |cq| rp + |cp| rq + rq rp

where ``c`` are centers and ``r`` radii. Pairs with the largest bounds are opened first. The best
``k`` of each meeting are merged by rank. Integer scores are exact; a bound is compared with room
for rounding.

Edge cases: vectors that are null, empty, or hold null or non-finite components take no part; a row with a
null id is a candidate, after all others of its score; vectors of unequal length have no inner product and are matched only within their
length; equal scores are ranked by id, and rows that share an id are candidates and queries of their own; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flipside.llm.common import pieces_for
from flipside.session import materialize

BLOCK_ROWS = 8192
LEAF_ROWS = 64
# Points that may cover a node at a smaller share of its radius, and the shares, smallest first.
MAX_CENTERS = 32
SHARES = (0.5, 0.65, 0.8, 0.9, 0.95)
LOWEST = -(1 << 62)

FOUND_SCHEMA = "query_id bigint, query_row bigint, vec_id bigint, score bigint"


@dataclass
class Tree:
    """Nodes as arrays, the root first; children follow each other, leaves are slices of ``rows``.

    ``scales`` is the distance within which a node's children cover it, 0 for a leaf.
    """

    centers: np.ndarray
    radii: np.ndarray
    norms: np.ndarray
    first_child: np.ndarray
    n_children: np.ndarray
    first_row: np.ndarray
    n_rows: np.ndarray
    scales: np.ndarray
    rows: np.ndarray


def cover(points: np.ndarray, distance: np.ndarray, scale: float, most: int) -> tuple[np.ndarray, list[int]] | None:
    """For each point the nearest of greedy centers within ``scale`` and the centers, which lie further
    apart than that; none if it takes more than ``most``. The first point is a center, ``distance`` those from it."""
    owner = np.where(distance <= scale, 0, -1)
    nearest = np.where(distance <= scale, distance, np.inf)
    centers = [0]
    while len(left := np.flatnonzero(owner < 0)):
        if len(centers) == most:
            return None
        center = int(left[0])
        far = np.sqrt(((points - points[center]) ** 2).sum(1))
        closer = (far <= scale) & (far < nearest)
        owner[closer], nearest[closer] = len(centers), far[closer]
        centers.append(center)
    return owner, centers


def split(points: np.ndarray, rows: np.ndarray, leaf_rows: int) -> tuple[float, list[np.ndarray]]:
    """Scale and covers of ``rows``, each headed by its center; none if they are one place."""
    held = points[rows]
    distance = np.sqrt(((held - held[0]) ** 2).sum(1))
    radius = float(distance.max())
    if not radius:
        return 0.0, []
    for share in SHARES:
        most = MAX_CENTERS if share < SHARES[-1] else len(rows)
        if found := cover(held, distance, share * radius, most):
            break
    owner, centers = found
    ranked = np.argsort(owner, kind="stable")
    covers = np.split(rows[ranked], np.cumsum(np.bincount(owner, minlength=len(centers)))[:-1])
    # Centers come first in their covers, since earlier points of a cover may be nearer to another.
    covers = [np.concatenate(([rows[center]], part[part != rows[center]])) for center, part in zip(centers, covers, strict=True)]
    parts = [part for part in covers if len(part) > leaf_rows]
    shared: list[np.ndarray] = []
    for part in sorted((part for part in covers if len(part) <= leaf_rows), key=len, reverse=True):
        if shared and sum(map(len, shared)) + len(part) > leaf_rows:
            parts.append(np.concatenate(shared))
            shared = []
        shared.append(part)
    if shared:
        parts.append(np.concatenate(shared))
    return share * radius, parts


def cover_tree(points: np.ndarray, leaf_rows: int = LEAF_ROWS) -> Tree:
    """Split nodes by covers until they hold ``leaf_rows`` points or one place."""
    points = points.astype(np.float64)
    nodes: list[list] = []
    queue = [np.arange(len(points))]
    order: list[np.ndarray] = []
    placed = 0
    while len(nodes) < len(queue):
        rows = queue[len(nodes)]
        queue[len(nodes)] = None
        center = points[rows].mean(0)
        radius = float(np.sqrt(((points[rows] - center) ** 2).sum(1)).max())
        scale, parts = split(points, rows, leaf_rows) if len(rows) > leaf_rows else (0.0, [])
        if parts:
            nodes.append([center, radius, len(queue), len(parts), 0, len(rows), scale])
            queue.extend(parts)
        else:
            nodes.append([center, radius, 0, 0, placed, len(rows), scale])
            order.append(rows)
            placed += len(rows)
    columns = list(zip(*nodes, strict=True))
    centers = np.array(columns[0])
    return Tree(
        centers,
        np.array(columns[1]),
        np.sqrt((centers**2).sum(1)),
        *(np.array(column, np.int64) for column in columns[2:6]),
        np.array(columns[6]),
        np.concatenate(order),
    )


def bounds(queries: Tree, group: int, data: Tree, nodes: np.ndarray) -> np.ndarray:
    """Upper bounds of inner products between a query group and data nodes."""
    radius, norm = queries.radii[group], queries.norms[group]
    exact = data.centers[nodes] @ queries.centers[group]
    bound = exact + norm * data.radii[nodes] + data.norms[nodes] * radius + radius * data.radii[nodes]
    return bound + 1e-9 * (1 + np.abs(bound))


def row_bounds(queries: np.ndarray, data: Tree, nodes: np.ndarray) -> np.ndarray:
    """Upper bounds of inner products between single queries and data nodes."""
    queries, nodes = queries.astype(np.float64), nodes.astype(np.int64)
    norms = np.sqrt((queries**2).sum(1))[:, None]
    bound = queries @ data.centers[nodes].T + norms * data.radii[nodes]
    return bound + 1e-9 * (1 + norms * (data.norms[nodes] + data.radii[nodes]))


def below(tree: Tree, node: int) -> np.ndarray:
    """Leaves under a node."""
    open_nodes, leaves = [node], []
    while open_nodes:
        node = open_nodes.pop()
        if tree.n_children[node]:
            open_nodes.extend(range(tree.first_child[node], tree.first_child[node] + tree.n_children[node]))
        else:
            leaves.append(node)
    return np.array(leaves)


def merge_best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per line the ``k`` highest scores, ties to smaller ids."""
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def dual_search(
    queries: np.ndarray, query_rows: np.ndarray, data: np.ndarray, data_rows: np.ndarray, data_ids: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray]:
    """Best ``k`` of ``data`` for each query as ``(scores, ids)``; missing ones score ``LOWEST``.

    Walks the query tree down to its leaves, handing the surviving data nodes from group to
    subgroup; a leaf group opens nodes in order of their bounds for single rows, those that may hold
    more for at least one of its rows, until the bound falls below the worst kth score of the group. A row is no candidate for itself.
    """
    query_tree, data_tree = cover_tree(queries), cover_tree(data)
    best = np.full((len(queries), k), LOWEST)
    best_ids = np.full((len(queries), k), np.iinfo(np.int64).max)
    ordered, ordered_ids = data[data_tree.rows].astype(np.float64), data_ids[data_tree.rows]
    ordered_rows = data_rows[data_tree.rows]
    work = [(0, np.array([0]))]
    while work:
        group, nodes = work.pop()
        rows = query_tree.rows
        leaves = below(query_tree, group)
        members = np.concatenate([rows[query_tree.first_row[leaf] : query_tree.first_row[leaf] + query_tree.n_rows[leaf]] for leaf in leaves])
        worst = best[members, -1].min()
        nodes = nodes[bounds(query_tree, group, data_tree, nodes) >= worst]
        inner = nodes[data_tree.n_children[nodes] > 0]
        if query_tree.n_children[group]:
            opened = [np.arange(data_tree.first_child[node], data_tree.first_child[node] + data_tree.n_children[node]) for node in inner]
            nodes = np.concatenate([nodes[data_tree.n_children[nodes] == 0], *opened])
            first = query_tree.first_child[group]
            work.extend((child, nodes) for child in range(first, first + query_tree.n_children[group]))
            continue
        leaves = np.concatenate([below(data_tree, node) for node in nodes]) if len(nodes) else nodes
        ceilings = row_bounds(queries[members], data_tree, leaves)
        ceiling = ceilings.max(0)
        for place in np.argsort(-ceiling, kind="stable"):
            worst = best[members, -1]
            if ceiling[place] < worst.min():
                break
            if (ceilings[:, place] < worst).all():
                continue
            start = data_tree.first_row[leaves[place]]
            stop = start + data_tree.n_rows[leaves[place]]
            scores = np.rint(queries[members].astype(np.float64) @ ordered[start:stop].T).astype(np.int64)
            ids = np.broadcast_to(ordered_ids[start:stop], scores.shape).copy()
            own = ordered_rows[start:stop] == query_rows[members][:, None]
            scores[own], ids[own] = LOWEST, np.iinfo(np.int64).max
            best[members], best_ids[members] = merge_best(
                np.concatenate([best[members], scores], 1), np.concatenate([best_ids[members], ids], 1), k
            )
    return best, best_ids


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    values = column.combine_chunks()
    return values.flatten().to_numpy().reshape(len(values), -1)


def block_search(k: int):
    def search(queries: pa.Table, data: pa.Table) -> pa.Table:
        if queries.num_rows and data.num_rows:
            query_ids, data_ids = queries.column("id"), data.column("id")
            # Ids are searched by their rank, null behind all others.
            by_id = pa.compute.sort_indices(data_ids, null_placement="at_end").to_numpy()
            ranks = np.empty(len(by_id), np.int64)
            ranks[by_id] = np.arange(len(by_id))
            query_rows, data_rows = queries.column("row").to_numpy(), data.column("row").to_numpy()
            asked, offered = matrix(queries.column("vector")), matrix(data.column("vector"))
            scores, found_ranks = dual_search(asked, query_rows, offered, data_rows, ranks, k)
            line, place = np.nonzero(scores > LOWEST)
            found = [query_ids.take(line), query_rows[line], data_ids.take(by_id[found_ranks[line, place]]), scores[line, place]]
        else:
            found = [pa.array([], pa.int64())] * 4
        return pa.table(dict(zip(("query_id", "query_row", "vec_id", "score"), found, strict=True)))

    return search


def usable_vectors(vectors: DataFrame, id_column: str, vector_column: str, scale: int) -> DataFrame:
    """``(id, vector)`` in whole numbers ``floor(scale * x)``, without unusable rows."""
    numbers = F.col(vector_column).cast("array<double>")
    whole = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col(vector_column).isNotNull() & (F.size(numbers) > 0) & F.coalesce(whole, F.lit(False))
    return vectors.filter(usable).select(
        F.col(id_column).cast("bigint").alias("id"),
        F.transform(numbers, lambda x: F.floor(x * scale).cast("bigint")).alias("vector"),
    )


def top_inner_products(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    scale: int = 64,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The ``k`` highest integer inner products of each query among all other rows.

    ``is_query`` is a condition on the column ``id``. Exact as long as scores stay below 2^53.
    """
    rows = usable_vectors(vectors, id_column, vector_column, scale).withColumn("dims", F.size("vector"))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    n_data, n_queries = rows.agg(F.count("*"), F.count_if(is_query)).first()
    data_blocks, query_blocks = pieces_for(n_data, block_rows), pieces_for(n_queries, block_rows // 8)
    # Every block of one side is sent to every block of the other.
    to_all = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    data = rows.withColumn("data_block", F.pmod(F.xxhash64("row"), F.lit(data_blocks)).cast("int"))
    data = data.withColumn("query_block", to_all(query_blocks))
    asked = rows.filter(is_query).withColumn("query_block", F.pmod(F.xxhash64("row"), F.lit(query_blocks)).cast("int"))
    asked = asked.withColumn("data_block", to_all(data_blocks))
    meeting = ["dims", "data_block", "query_block"]
    found = asked.groupBy(*meeting).cogroup(data.groupBy(*meeting)).applyInArrow(block_search(k), FOUND_SCHEMA)
    rank = F.row_number().over(Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    ranked = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")

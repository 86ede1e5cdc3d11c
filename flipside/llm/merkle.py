"""Merkle manifest of a table: a content-addressed graph of digests, and proofs by descent in it.

Every row is a leaf, the digest of its fields. The leaves of a group (a source), ascending by id, are
joined three by three until one node remains, the group's subroot; the subroots, ordered by group, are
joined likewise to the root.

The graph is stored as digest-to-children records. Those of a stretch of ``SEGMENT_LEVELS`` levels are
kept together under the digest at their top, so that raising a tree and descending it take one shuffle
per stretch and not one per level. A request knows its rank: the base-3 digits name the child to take
at each node. The children that are not taken are collected on the way down; reversed, they are the
proof from the leaf up. Stretches are resolved from the root down, each once for all requests below
it, and a leaf's request takes over the path of its own stretch's top.

Edge cases: a null field is ``-``, an empty one ``0:``; null is a group of its own and comes first;
null ids come first in their group; rows that share an id are ordered by their leaf, so rows alike in
all fields are interchangeable; a request for a rank that does not exist has a null path; an empty
table gives no rows; columns other than those named are not read. A hot group is ranked in ranges,
and no task holds more than 3 ** SEGMENT_LEVELS nodes of a group and the records above them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flipside.operators.joins import lookup_join
from flipside.operators.ranking import with_places
from flipside.session import materialize

FANOUT = 3
SEGMENT_LEVELS = 7
SEGMENT = FANOUT**SEGMENT_LEVELS

NODES = "array<struct<digest: binary, children: array<binary>>>"
SHAPE = ("group", "segment", "segments", "height")
RAISED = f"group string, segment bigint, segments bigint, top binary, height int, nodes {NODES}"
PATH = "array<struct<place: int, siblings: array<binary>>>"
_RECORD = pa.struct([("digest", pa.binary()), ("children", pa.list_(pa.binary()))])
_RAISED = pa.schema(
    [
        ("group", pa.string()), ("segment", pa.int64()), ("segments", pa.int64()), ("top", pa.binary()),
        ("height", pa.int32()), ("nodes", pa.list_(_RECORD)),
    ]
)
_STEP = pa.struct([("place", pa.int32()), ("siblings", pa.list_(pa.binary()))])


def leaf_digest(fields: Sequence[Column]) -> Column:
    """sha256 of the fields in order: ``-`` for null, else the length in bytes, a colon, and the value."""
    shown = []
    for value in fields:
        text = value.cast("string")
        shown.append(F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.unhex(F.sha2(F.concat(*shown), 256))


def group_key(value: Column) -> Column:
    """The group's name with null apart from any text, and first."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def hexed(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def joined(children: Sequence[bytes]) -> bytes:
    """The digest of digests, hashed as lowercase hex text."""
    return sha256("".join([child.hex() for child in children]).encode()).digest()


def _raise_segment(key: tuple, table: pa.Table) -> pa.Table:
    """Join the nodes of one segment up to its top, and keep the records on the way."""
    order = np.argsort(table.column("rank").to_numpy())
    level = table.column("digest").take(pa.array(order)).to_pylist()
    n = table.column("n")[0].as_py()
    records: dict[bytes, list[bytes]] = {}
    height = 0
    # A group of one segment ends when one node remains; else every segment has the same height.
    while len(level) > 1 if n <= SEGMENT else height < SEGMENT_LEVELS:
        groups = [level[start : start + FANOUT] for start in range(0, len(level), FANOUT)]
        level = [joined(children) for children in groups]
        records.update(zip(level, groups, strict=True))
        height += 1
    group, segment = (value.as_py() for value in key)
    nodes = [{"digest": name, "children": children} for name, children in records.items()]
    row = (group, segment, -(-n // SEGMENT), level[0], height, nodes)
    return pa.table([pa.array([value], field.type) for value, field in zip(row, _RAISED, strict=True)], schema=_RAISED)


def in_segments(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("segment", F.floor(F.col("rank") / SEGMENT).cast("bigint"))


def raise_trees(nodes: DataFrame, name: str) -> tuple[DataFrame, list[DataFrame]]:
    """Join every group's ``nodes (group, rank, n, digest)``, ranks from 0, up to one node.

    Gives ``(group, digest)`` and the written rounds of segments, lowest first. A round leaves
    1 / 3 ** SEGMENT_LEVELS of the nodes of each group that is not done.
    """
    rounds, done = [], []
    while True:
        raised = in_segments(nodes).groupBy("group", "segment").applyInArrow(_raise_segment, RAISED)
        rounds.append(materialize(raised, f"{name}-{len(rounds)}"))
        tops = rounds[-1].select("group", F.col("segment").alias("rank"), F.col("segments").alias("n"), F.col("top").alias("digest"))
        done.append(tops.filter("n = 1").select("group", "digest"))
        nodes = tops.filter("n > 1")
        if not nodes.take(1):
            break
    ends = done[0]
    for more in done[1:]:
        ends = ends.unionByName(more)
    return ends, rounds


def _descend(requests: pa.Table, above: pa.Table) -> pa.Table:
    """Walk all requests of a segment down from its top by the digits of their rank."""
    requests = requests.drop_columns(["segment"])
    n = requests.num_rows
    if not above.num_rows:
        reached, path = pa.nulls(n, pa.binary()), pa.nulls(n, pa.list_(_STEP))
        return requests.append_column("digest", reached).append_column("path", path)
    top, height, nodes, upper = (above.column(name)[0].as_py() for name in ("top", "height", "nodes", "path"))
    names = {top: 0}
    for record in nodes:
        for digest in (record["digest"], *record["children"]):
            names.setdefault(digest, len(names))
    kids = np.full((len(names), FANOUT), -1, np.int64)
    for record in nodes:
        children = [names[child] for child in record["children"]]
        kids[names[record["digest"]], : len(children)] = children
    offset = requests.column("rank").to_numpy() % SEGMENT
    at = np.zeros(n, np.int64)
    steps = height + len(upper)
    place = np.zeros((n, steps), np.int32)
    siblings = np.full((n, steps, FANOUT - 1), -1, np.int64)
    known = np.ones(n, bool)
    for level in reversed(range(height)):
        digit = offset // FANOUT**level % FANOUT
        children = kids[at]
        others = np.arange(FANOUT)[None, :] != digit[:, None]
        place[:, level] = digit
        siblings[:, level, :] = children[others].reshape(n, FANOUT - 1)
        at = children[np.arange(n), digit]
        known &= at >= 0
        at = np.maximum(at, 0)
    known &= offset < FANOUT**height
    for level, step in enumerate(upper, height):
        place[:, level] = step["place"]
        for slot, digest in enumerate(step["siblings"]):
            siblings[:, level, slot] = names.setdefault(digest, len(names))
    digests = pa.array(list(names), pa.binary())
    held = siblings >= 0
    inner = np.concatenate([[0], np.cumsum(held.sum(axis=2).ravel())]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(inner), digests.take(pa.array(siblings[held])))
    items = pa.StructArray.from_arrays([pa.array(place.ravel()), lists], fields=list(_STEP))
    # A null in the offsets marks a null path.
    outer = pa.array(np.arange(n + 1, dtype=np.int32) * steps, mask=np.append(~known, False))
    path = pa.ListArray.from_arrays(outer, items).cast(pa.list_(_STEP))
    reached = digests.take(pa.array(at, mask=~known))
    return requests.append_column("digest", reached).append_column("path", path)


def descend(requests: DataFrame, above: DataFrame) -> DataFrame:
    """Add ``digest`` and ``path`` to ``requests (group, rank, ...)``, by the resolved segments
    ``above (group, segment, top, height, nodes, path)`` they fall into."""
    kinds = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in requests.schema)
    left = in_segments(requests).groupBy("group", "segment")
    return left.cogroup(above.groupBy("group", "segment")).applyInArrow(_descend, f"{kinds}, digest binary, path {PATH}")


def resolve(shape: Sequence[DataFrame], ends: DataFrame, records: DataFrame, name: str) -> DataFrame:
    """The segments of the lowest round with their records and the path above them.

    ``shape`` lists the rounds' ``(group, segment, segments, height)``, ``ends`` are the resolved tops of
    all groups, ``(group, digest, path)``. The records of a segment are looked up by the digest that the
    descent has arrived at.
    """
    known = None
    for place in reversed(range(len(shape))):
        here = shape[place]
        asked = here.filter("segments = 1").join(ends, "group").select("group", "segment", "height", "digest", "path")
        if known is not None:
            wanted = here.filter("segments > 1").select("group", F.col("segment").alias("rank"), "height")
            found = descend(wanted, known).withColumnRenamed("rank", "segment")
            asked = asked.unionByName(found.select("group", "segment", "height", "digest", "path"))
        asked = materialize(asked.withColumnRenamed("digest", "top"), f"{name}-{place}")
        known = asked.join(records, ["top", "height"]).select("group", "segment", "top", "height", "nodes", "path")
    return known


def write_manifest(leaves: DataFrame, path: str) -> None:
    """Write the manifest of ``leaves (id, group, leaf, ...)``: the ranked ``leaves`` with all their columns,
    the ``groups`` with their subroots, the ``root``, the ``records`` by digest, one row per distinct
    segment, and the ``shape`` of the trees, which says where a rank's digits are cut into segments."""
    spark = leaves.sparkSession

    def ranked(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
        placed = with_places(rows, group, order, "rank", "n").withColumn("rank", F.col("rank") - 1)
        placed.write.parquet(f"{path}/{name}")
        return spark.read.schema(placed.schema).parquet(f"{path}/{name}")

    placed = ranked(leaves, ["group"], ["id", "leaf"], "leaves")
    ends, rounds = raise_trees(placed.select("group", "rank", "n", F.col("leaf").alias("digest")), "merkle-rows")
    groups = ranked(ends.select(F.lit("").alias("tree"), "group", F.col("digest").alias("subroot")), ["tree"], ["group"], "groups")
    tops = groups.select(F.col("tree").alias("group"), "rank", "n", F.col("subroot").alias("digest"))
    root, upper = raise_trees(tops, "merkle-groups")
    root.select(F.col("digest").alias("root")).write.parquet(f"{path}/root")
    layers = [(kind, place, layer) for kind, found in (("rows", rounds), ("groups", upper)) for place, layer in enumerate(found)]
    records = [layer.select("top", "height", "nodes") for _, _, layer in layers]
    reduce(DataFrame.unionByName, records).dropDuplicates(["top", "height"]).write.parquet(f"{path}/records")
    shapes = [layer.select(*SHAPE, F.lit(kind).alias("kind"), F.lit(place).alias("round")) for kind, place, layer in layers]
    reduce(DataFrame.unionByName, shapes).write.parquet(f"{path}/shape")


def prove(spark: SparkSession, path: str, requests: DataFrame) -> DataFrame:
    """Answer ``requests (group, rank, ...)`` from a written manifest: all their columns, and ``digest``
    (the leaf arrived at), ``path`` (from the leaf up: its place and siblings), ``subroot``, ``root``."""
    written = spark.read.parquet(f"{path}/shape")
    # One row per round of either kind.
    rounds = {row.kind: row.last for row in written.groupBy("kind").agg(F.max("round").alias("last")).collect()}

    def shape(kind: str) -> list[DataFrame]:
        own = written.filter(F.col("kind") == kind)
        return [own.filter(F.col("round") == place).select(*SHAPE) for place in range(rounds.get(kind, 0) + 1)]

    records = spark.read.parquet(f"{path}/records")
    groups = spark.read.parquet(f"{path}/groups")
    root = spark.read.parquet(f"{path}/root")
    start = root.select(F.lit("").alias("group"), F.col("root").alias("digest"), F.array().cast(PATH).alias("path"))
    wanted = groups.select(F.col("tree").alias("group"), "rank", F.col("group").alias("of"))
    found = descend(wanted, resolve(shape("groups"), start, records, "merkle-groups"))
    ends = materialize(found.select(F.col("of").alias("group"), "digest", "path"), "merkle-ends")
    proved = descend(requests, resolve(shape("rows"), ends, records, "merkle-rows"))
    subroots = groups.select("group", "subroot")
    counts = spark.read.parquet(f"{path}/leaves").groupBy("group").agg(F.count("*").alias("n"))
    known = lookup_join(proved, subroots, ["group"], counts, F.col("rank"), "left")
    # The root is a single row.
    return known.join(F.broadcast(root), how="left")


def proof_digest(path: Column) -> Column:
    """sha256 of all siblings, from the leaf up, left to right, as hex text."""
    siblings = F.flatten(F.transform(path, lambda step: F.transform(step["siblings"], hexed)))
    return F.sha2(F.array_join(siblings, ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give, as hex text."""

    def raised(node: Column, step: Column) -> Column:
        text = F.transform(step["siblings"], hexed)
        left = F.array_join(F.slice(text, F.lit(1), step["place"]), "")
        right = F.array_join(F.slice(text, step["place"] + 1, F.lit(FANOUT)), "")
        return F.sha2(F.concat(left, node, right), 256)

    return F.aggregate(path, hexed(leaf), raised)

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from flipside.llm import merkle
from flipside.llm.queries import QUERIES, read_table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, rank int, `group` string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(digests):
    """All levels, the leaves first."""
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][at : at + 3]) for at in range(0, len(levels[-1]), 3)])
    return levels


def path(levels, rank):
    steps = []
    for level in levels[:-1]:
        run = level[rank // 3 * 3 : rank // 3 * 3 + 3]
        steps.append((run[: rank % 3], run[rank % 3 + 1 :]))
        rank //= 3
    return steps


def plain(rows):
    sources = {}
    for row in rows:
        sources.setdefault(row[1], []).append(row)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for source in order:
        sources[source].sort(key=lambda row: (row[0] is not None, row[0] or 0, leaf_of(row)))
        trees[source] = tree([leaf_of(row) for row in sources[source]])
    top = tree([trees[source][-1][0] for source in order])
    found = []
    for place, source in enumerate(order):
        for rank, row in enumerate(sources[source]):
            steps = path(trees[source], rank) + path(top, place)
            even = zlib.crc32(("" if row[0] is None else str(row[0])).encode()) % 2 == 0
            shown = (*row[:4], row[4].replace("\n", "") if even and row[4] is not None else row[4])
            node = leaf_of(shown)
            for left, right in steps:
                node = h(*left, node, *right)
            proof = h(*[digest for left, right in steps for digest in (*left, *right)])
            found.append((row[0], leaf_of(row), trees[source][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(found, key=str)


def awkward_rows():
    rows = [(i, "big", "en", i, f"text {i}\nline" if i % 2 else f"text {i}") for i in range(700)]
    rows += [(i, f"s{i % 40}", None, None, None) for i in range(200)] + [(5, None, "fr", 3, "a\n"), (None, None, None, None, "")]
    rows += [(9, "", "", 0, "\n\n"), (9, "", "", 0, "\n\n"), (9, "", "", 0, "other"), (1, "é-", None, 1, "日本\n語"), (None, "big", None, None, None)]
    return rows + [(7, "hot", "x", 1, "same")] * 350


def query_rows(spark, tmp_path, rows):
    frame = spark.createDataFrame([(*row, 0, "g") for row in rows], SCHEMA).repartition(5)
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    return sorted(map(tuple, QUERIES["op13_merkle_manifest"](spark, str(tmp_path)).collect()), key=str)


def test_manifest_follows_the_definition(spark, tmp_path):
    assert query_rows(spark, tmp_path, awkward_rows()) == plain(awkward_rows())


@pytest.mark.parametrize("rows", [[], [(1, "s", None, None, "a\nb")], [(i, None, None, i, "t") for i in range(4)]], ids=["empty", "one", "one source"])
def test_small_tables(spark, tmp_path, rows):
    assert query_rows(spark, tmp_path, rows) == plain(rows)


def levels_by_spark(spark, tmp_path, rows):
    leaves = spark.createDataFrame([(*row, 0, "g") for row in rows], SCHEMA).select(
        F.col("doc_id").alias("id"), merkle.group_key(F.col("source")).alias("group"),
        merkle.leaf_digest([F.col(name) for name in FIELDS]).alias("leaf"),
    )
    merkle.write_manifest(leaves, str(tmp_path / "m"))
    return spark.read.parquet(str(tmp_path / "m/leaves"))


def test_trees_of_several_segments(spark, tmp_path):
    rows = [(i, f"s{i % 11}", None, i, "t") for i in range(300)] + [(i, "big", None, i, "u") for i in range(2500)]
    leaves = levels_by_spark(spark, tmp_path, rows)
    proved = merkle.prove(spark, str(tmp_path / "m"), leaves).select(
        "id", merkle.hexed(F.col("leaf")), merkle.hexed(F.col("digest")).alias("reached"), merkle.hexed(F.col("root")).alias("root"),
        merkle.folded(F.col("leaf"), F.col("path")).alias("folded"), merkle.proof_digest(F.col("path")).alias("proof"),
    )
    want = {row[1]: row for row in plain(rows)}
    found = proved.collect()
    assert len(found) == len(rows)
    for row in found:
        assert row[1] == row.reached
        assert (row.root, row.proof) == want[row[1]][3:5] and row.folded == row.root
    # 2500 leaves are more than a segment.
    assert spark.read.parquet(str(tmp_path / "m/shape")).filter("kind = 'rows'").agg(F.max("round")).first()[0] == 1


def test_requests_beyond_the_leaves(spark, tmp_path):
    levels_by_spark(spark, tmp_path, [(i, "s", None, i, "t") for i in range(5)])
    asked = spark.createDataFrame([("=s", 4), ("=s", 5), ("=s", 9), ("=s", 10**9), ("=none", 0)], "`group` string, rank bigint")
    found = {(r.group, r.rank): r.path is not None and r.digest is not None for r in merkle.prove(spark, str(tmp_path / "m"), asked).collect()}
    assert found == {("=s", 4): True, ("=s", 5): False, ("=s", 9): False, ("=s", 10**9): False, ("=none", 0): False}


def test_equal_segments_are_stored_once(spark, tmp_path):
    levels_by_spark(spark, tmp_path, [(1, "s", None, 1, "t")] * (merkle.SEGMENT * 4))
    records = spark.read.parquet(str(tmp_path / "m/records"))
    # Four segments of equal leaves, the three nodes that join them, and nothing above the single source.
    assert sorted((r.height, len(r.nodes)) for r in records.collect()) == [(0, 0), (2, 3), (merkle.SEGMENT_LEVELS, merkle.SEGMENT_LEVELS)]


def test_given_documents(spark, folder):
    rows = [tuple(r) for r in read_table(spark, folder, "documents").select(*FIELDS).collect()]
    found = sorted(map(tuple, QUERIES["op13_merkle_manifest"](spark, folder).collect()), key=str)
    assert found == plain(rows)
    assert 0 < sum(not row[-1] for row in found) < len(found)

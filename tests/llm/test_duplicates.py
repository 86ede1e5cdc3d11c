import random

import duckdb
import pytest
from pyspark.sql import functions as F

from flipside.llm import exact_dedup, ngram_join, queries
from flipside.llm.common import ROW, numbered, unnumbered, without_rows
from flipside.llm.oracles import ORACLES
from tests.llm.conftest import document_rows


def plain_set(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[place : place + 5]) for place in range(len(words) - 4)}


def plain_components(rows):
    """Brute force over all pairs; rows that share an id are one node."""
    rows = [(doc_id, plain_set(text)) for doc_id, text in rows]
    parent = {doc_id: doc_id for doc_id, _ in rows}

    def root(node):
        while parent[node] != node:
            node = parent[node]
        return node

    named = [(doc_id, own) for doc_id, own in rows if doc_id is not None and own]
    for here, (a, left) in enumerate(named):
        for b, right in named[:here]:
            small, large = sorted((len(left), len(right)))
            if 100 * small >= 75 * large and root(a) != root(b):
                both = len(left & right)
                if 100 * both >= 75 * (len(left) + len(right) - both):
                    low, high = sorted((root(a), root(b)))
                    parent[high] = low
    return sorted(((doc_id, len(own), None if doc_id is None else root(doc_id)) for doc_id, own in rows), key=str)


def test_components_equal_brute_force(awkward, no_documents):
    found = ngram_join.near_duplicates(awkward).collect()
    assert sorted(map(tuple, found), key=str) == plain_components(document_rows())
    assert ngram_join.near_duplicates(no_documents).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_chains_bands_and_common_passages(spark, seed, monkeypatch):
    """Drifting chains, growing texts over many size bands, boilerplate in most texts, small tiles."""
    monkeypatch.setattr(ngram_join, "TILE", 4)
    monkeypatch.setattr(ngram_join, "COMMON_LEAST", 6)
    random.seed(seed)
    words = [f"w{number}" for number in range(400)]
    passage = random.choices(words, k=60)
    rows, chain = [], random.choices(words, k=80)
    for doc_id in range(60):
        rows.append((doc_id, " ".join(chain)))
        for _ in range(2):
            chain[random.randrange(len(chain))] = random.choice(words)
    growing = random.choices(words, k=12)
    for doc_id in range(60, 110):
        rows.append((doc_id, " ".join(growing)))
        growing += random.choices(words, k=max(1, len(growing) // random.choice((6, 9, 20, 40))))
        growing = growing[:300]
    for doc_id in range(110, 180):
        rows.append((doc_id, " ".join(passage + random.choices(words, k=random.randrange(0, 30)))))
    random.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    found = ngram_join.near_duplicates(frame).collect()
    assert sorted(map(tuple, found), key=str) == plain_components(rows)


def test_threshold_is_met_exactly(spark):
    """Three of four shingles shared is a link, a little less is none."""
    def text(shared, own, tag):
        return " ".join([*(f"s{n}" for n in range(shared + 4)), *(f"{tag}{n}" for n in range(own))])

    # 75 shared of 100 in the union, and 74 of 100.
    rows = [(1, text(75, 12, "a")), (2, text(75, 13, "b")), (3, "x " + text(74, 13, "c")), (4, "y " + text(74, 12, "d"))]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(map(tuple, ngram_join.near_duplicates(frame).collect()), key=str) == plain_components(rows)


def test_component_contraction(spark):
    links = [(a, a + 1) for a in range(0, 40)] + [(100, b) for b in range(101, 140)] + [(140, 120), (500, 499), (7, 7)]
    frame = spark.createDataFrame(links, "a bigint, b bigint")
    found = {row.id: row.component for row in ngram_join.connected_components(frame).collect()}
    assert {found.get(node, node) for node in range(0, 41)} == {0}
    assert {found.get(node, node) for node in range(100, 141)} == {100}
    assert found[500] == 499


def test_near_copies_keep_one_of_each_component(awkward):
    kept = ngram_join.drop_near_copies(awkward)
    assert kept.columns == awkward.columns
    wanted = {a for a, _, component in plain_components(document_rows()) if a == component}
    assert {row.doc_id for row in kept.collect()} == wanted


@pytest.mark.parametrize(("keep", "best"), [("largest", max), ("smallest", min)])
def test_exact_groups(awkward, no_documents, keep, best):
    rows = document_rows()
    expected, seen = [], set()
    for doc_id, text in rows:
        group = [other for other, same in rows if (same or "") == (text or "")]
        stays = best((other for other in group if other is not None), default=None)
        # One row of each text, also where rows repeat or have no id.
        kept = doc_id == stays and (text or "") not in seen
        seen |= {text or ""} if kept else set()
        expected.append((doc_id, stays, len(group), kept))
    found = exact_dedup.exact_groups(awkward, keep=keep)
    assert sorted((tuple(row)[:4] for row in found.collect()), key=str) == sorted(expected, key=str)
    assert exact_dedup.exact_groups(no_documents).count() == 0


def test_exact_groups_match_sql_on_repeated_rows(spark, tmp_path):
    rows = [(5, "a"), (5, "a"), (3, "a"), (None, "n"), (None, "n"), (7, None), (7, ""), (None, ""), (9, "own"), (None, "alone")]
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.QUERIES["op6_exact_dedup"](spark, str(tmp_path))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = duck.execute(ORACLES["op6_exact_dedup"])
    columns = [c[0] for c in want.description]
    assert sorted((tuple(row[c] for c in columns) for row in found.collect()), key=str) == sorted(want.fetchall(), key=str)
    assert found.filter("kept").count() == 5


def test_rows_are_numbered_by_their_place_in_files(spark, tmp_path):
    """A scan is not written again; numbers are distinct, and the same at each reading and in any split of the files."""
    docs = spark.range(500).select(F.col("id"), F.lit("x").alias("__row")).repartition(7)
    docs.write.parquet(str(tmp_path / "docs"))
    read = spark.read.parquet(str(tmp_path / "docs"))
    rows = numbered(read, "test-rows")
    first = {row[ROW]: row.id for row in rows.collect()}
    assert len(first) == 500 and first == {row[ROW]: row.id for row in rows.repartition(3).collect()}
    assert "test-rows-files" not in "".join(read.inputFiles())
    back = unnumbered(rows, read.columns)
    assert back.columns == ["id", "__row"] and {row["__row"] for row in back.collect()} == {"x"}
    kept = without_rows(rows, rows.filter("id % 5 = 0").select(ROW))
    assert {row.id for row in kept.collect()} == {i for i in range(500) if i % 5}
    assert numbered(read.limit(0), "test-rows").count() == 0


def test_exact_groups_split_hot_groups_and_hash_collisions(spark, monkeypatch):
    """With a useless hash and tiny pieces the bytes still decide."""
    from pyspark.sql import functions as F

    from flipside.operators import joins

    monkeypatch.setattr(joins.salted_join, "__defaults__", ("inner", 7))
    monkeypatch.setattr(exact_dedup.F, "md5", lambda column: F.lit("00" * 16))
    rows = [(number, "hot" if number % 3 else f"text {number % 50}") for number in range(300)]
    found = exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), keep="largest").collect()
    by_text = {}
    for number, text in rows:
        by_text.setdefault(text, []).append(number)
    assert len(found) == 300
    assert all(row.keep_id == max(by_text[dict(rows)[row.doc_id]]) for row in found)


def test_exact_dedup_runs_no_python(spark, folder):
    plan = queries.QUERIES["op6_exact_dedup"](spark, folder)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_drop_exact_copies(awkward):
    kept = exact_dedup.drop_exact_copies(awkward)
    assert kept.columns == awkward.columns
    assert {row.doc_id for row in kept.collect()} >= {1, 4, 10, 11}
    assert 12 not in {row.doc_id for row in kept.collect()}


def test_sets_of_many_texts_are_those_of_each_text():
    """Texts hashed together share no shingle across their borders, and words keep no memory."""
    texts = [b"", b"one", b"a b c d", b"A b  C\nd e", b"a b c d e", b"a b c d e a b c d e", "x\u00a0y \u00e9 \x1c z w".encode(), b" \t "]
    together = [own.tolist() for own in ngram_join.shingle_sets(texts)]
    assert together == [next(ngram_join.shingle_sets([text])).tolist() for text in texts]
    assert [len(own) for own in together] == [0, 1, 1, 1, 1, 5, 1, 0]
    assert together[3] == together[4] and set(together[4]) <= set(together[5])
    assert all(own == sorted(set(own)) for own in together) and together[1] != together[2]
    assert list(ngram_join.shingle_sets([])) == []

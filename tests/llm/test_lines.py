import random
import string

import pytest
from pyspark.sql import functions as F

from flipside.llm import line_runs
from tests.llm.conftest import document_rows

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def plain(rows, min_documents, min_length):
    """The definition, over rows (doc_id, text)."""
    holders = {}
    parts = [(doc, (text or "").split("\n")) for doc, text in rows]
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    for doc, lines in parts:
        for one in {key(line) for line in lines}:
            holders.setdefault(one, []).append(doc)
    keep = {
        one: max((doc for doc in docs if doc is not None), default=None)
        for one, docs in holders.items()
        if len(one) >= min_length and len(docs) >= min_documents
    }
    found = []
    for doc, lines in parts:
        left = [line for line in lines if key(line) not in keep or keep[key(line)] == doc]
        found.append((doc, "\n".join(left), len(lines), len(lines) - len(left)))
    return sorted(found, key=str)


def lined_rows():
    random.seed(3)
    common = [f"Line {number} is shared by a good many documentsé" for number in range(12)]
    rows = [(None, None), (1, ""), (2, "\n"), (2, "\n\n"), (3, "x" * 39), (4, "é" * 40)]
    for doc in range(10, 260):
        lines = random.choices(common, k=random.randrange(4)) + [f"own {random.random()}" for _ in range(random.randrange(3))]
        lines = [random.choice(["", " ", "\t", " "]) + (line.upper() if random.random() < 0.3 else line) for line in lines]
        random.shuffle(lines)
        rows.append((doc if doc % 17 else None, "\n".join(lines)))
    rows += [(doc, "A line of the rows without any id, which all of them keep") for doc in [None] * 6]
    rows += [(77, common[0] + "\n" + common[0] + "\r"), (900, common[1] + "\n" + common[1]), (900, common[1])]
    # One hot line, in a third of all rows.
    return rows + [(doc, "the very same line in a third of all of the rows\n" + str(doc)) for doc in range(1000, 1130)]


def dropped(frame):
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in frame.collect()), key=str)


@pytest.mark.parametrize(("batches", "fanout"), [(1, 4), (7, 2), (9, 3)])
def test_lines_follow_the_definition(spark, batches, fanout):
    rows = lined_rows()
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    found = line_runs.drop_repeated_lines(frame, min_documents=5, min_length=40, batches=batches, fanout=fanout)
    expected = plain(rows, 5, 40)
    assert dropped(found) == expected
    assert sum(n for *_, n in expected) > 100


def test_awkward_and_empty_documents(spark, awkward, no_documents):
    found = line_runs.drop_repeated_lines(awkward, min_documents=2, min_length=3)
    assert dropped(found) == plain(document_rows(), 2, 3)
    assert dropped(line_runs.drop_repeated_lines(no_documents)) == []


def test_runs_are_levelled_and_settled_lines_stay_out(spark):
    def batch(*records):
        return spark.createDataFrame([(bytes([h]), n, keep) for h, n, keep in records], "hash binary, n bigint, keep bigint")

    with line_runs.line_runs(spark, min_documents=5, buckets=4, fanout=3) as store:
        sizes = []
        for number in range(10):
            store.add(batch((1, 5, 100 - number), (2, 1, 50 - number), (10 + number, 1, number)))
            sizes.append([len(level) for level in store.levels])
        assert sizes == [[1], [2], [0, 1], [1, 1], [2, 1], [0, 2], [1, 2], [2, 2], [0, 0, 1], [1, 0, 1]]
        # The first run settled line 1, so no later run holds it. Line 2 is in two compactions of three batches, and
        # settled by neither; the first of nine batches settles it, and the tenth leaves it out.
        merged = {row.hash[0]: (row.n, row.keep) for row in store.merged(store.runs()).collect()}
        assert merged[1] == (5, 100) and merged[2] == (9, 50)
        assert {row.hash[0] for row in store.repeated().collect()} == {1, 2}
        plan = store.unsettled(batch((1, 1, 1)))._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan
        tables = [name for level in store.levels for name in level]
    assert not any(spark.catalog.tableExists(name) for name in tables)


def test_runs_are_read_without_a_shuffle(spark):
    with line_runs.line_runs(spark, min_documents=5, buckets=8) as store:
        frame = spark.range(1000).select(F.unhex(F.md5(F.col("id").cast("string"))).alias("hash"), F.lit(1).cast("bigint").alias("n"), F.col("id").alias("keep"))
        store.add(frame)
        plan = store.unsettled(frame.repartition(8, "hash"))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1

import random

import pytest

SCHEMA = "doc_id bigint, text string, id string, n int, kind string, block string, `group` int, row string"


def document_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows and near copies."""
    random.seed(7)
    words = [a + b for a in ("ba", "lo", "mi", "Té", "ñu", "x") for b in ("ra", "ko", "s", "èn", ",", ".")]

    def text(n):
        return " ".join(random.choices(words, k=n))

    base = text(120).split()
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one two three"), (6, "one  two\nthree"), (7, "ONE two Three")]
    rows += [(None, "no id here at all today"), (None, None), (8, text(60_000)), (9, "日本語 😀😀 <|endoftext|> ▁x \x00 a\x1cb")]
    rows += [(10, text(200)), (10, text(200)), (11, " ".join(base)), (11, " ".join(base)), (12, " ".join(base))]
    for copy in range(13, 60):
        changed = list(base)
        for _ in range(copy % 4):
            changed[random.randrange(len(changed))] = random.choice(words)
        rows.append((copy, " ".join(changed)))
    rows += [(doc, text(random.randrange(1, 400))) for doc in range(60, 160)]
    rows += [(doc, text(30) + " " + " ".join(base[:60])) for doc in range(160, 180)]
    return rows


@pytest.fixture(scope="session")
def awkward(spark):
    """The rows with further columns whose names the operators use inside."""
    rows = [(doc_id, text, "q", None, "k", None, 3, "r") for doc_id, text in document_rows()]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)

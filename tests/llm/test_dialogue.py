import duckdb

from flipside.llm import perspective

SCHEMA = "conv_id bigint, turn bigint, role string, text string, run int, size string"


def turns():
    rows = [(1, 0, "ann", "hi"), (1, 1, "bob", None), (1, 2, "ann", "x"), (1, 2, "ann", "x"), (1, None, None, "first")]
    rows += [(2, number, f"p{number % 3}", "w" * (number % 7)) for number in range(1000)]
    rows += [(None, 1, "ann", "lost"), (3, 5, "solo", ""), (4, 1, "b", "tie"), (4, 1, "a", "tie")]
    return [(*row, 1, "s") for row in rows]


def test_rotation_equals_sql(spark):
    frame = spark.createDataFrame(turns(), SCHEMA)
    found = perspective.rotate_perspectives(frame)
    connection = duckdb.connect()
    conversations = frame.toPandas().astype({"turn": "Int64", "conv_id": "Int64"})
    connection.register("conversations", conversations)
    expected = connection.sql(perspective.ORACLE_SQL)
    names = [column[0] for column in expected.description]
    wanted = sorted(map(str, expected.fetchall()))
    assert wanted == sorted(str(tuple(row[name] for name in names)) for row in found.collect())


def test_whole_dialogues(spark):
    frame = spark.createDataFrame(turns(), SCHEMA)
    rendered = {(row.conv_id, row.perspective): row for row in perspective.dialogue(perspective.rotate_perspectives(frame)).collect()}
    assert set(rendered) >= {(1, "ann"), (1, "bob"), (1, "unknown"), (2, "p0"), (3, "solo"), (4, "a"), (4, "b")}
    ann = rendered[1, "ann"]
    assert ann.text == (
        "<|user|>unknown: first<|end|>\n<|assistant|>hi<|end|>\n<|user|>bob: <|end|>\n<|assistant|>x<|end|>\n<|assistant|>x<|end|>\n"
    )
    assert [ann.text[start:stop] for start, stop in ann.masks] == ["hi<|end|>", "x<|end|>", "x<|end|>"]
    assert all(
        row.text[start - 13 : start] == "<|assistant|>" for row in rendered.values() for start, _ in row.masks
    )


def test_no_turns(spark):
    assert perspective.rotate_perspectives(spark.createDataFrame([], SCHEMA)).count() == 0

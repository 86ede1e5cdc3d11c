import numpy as np
import pytest
from pyspark.sql import functions as F

from flipside.llm import pattern_grammar, quadratic, queries
from flipside.llm.common import fold
from tests.llm.conftest import document_rows



def accuracy(spark, folder, name, label):
    rows = queries.QUERIES[name](spark, folder).filter("held_out")
    return rows.join(queries.read_table(spark, folder, "labels"), "doc_id").agg(
        F.avg((F.col("predicted") == F.col(label)).cast("int"))
    ).first()[0]


@pytest.mark.parametrize(
    ("name", "label", "least"),
    [("op9_quadratic_discriminant", "quality", 0.97), ("op4_pattern_grammar", "toxic", 0.97)],
)
def test_held_out_accuracy(spark, name, label, least):
    assert accuracy(spark, "/root/testdata/sf0.1", name, label) >= least


@pytest.mark.parametrize("score", [quadratic.score_quality, pattern_grammar.score_toxicity])
def test_every_row_is_scored(spark, awkward, no_documents, score):
    labels = spark.createDataFrame(
        [(doc_id, number % 2, (number // 2) % 2) for number, (doc_id, _) in enumerate(document_rows())] + [(4, None, 7), (9999, 1, 1)],
        "doc_id bigint, quality int, toxic int",
    )
    training = fold(F.col("id"), 3) != 1
    found = score(awkward, labels, training).collect()
    assert sorted(str(row.doc_id) for row in found) == sorted(str(doc_id) for doc_id, _ in document_rows())
    assert all(0 <= row.score <= 1 for row in found)
    assert score(no_documents, labels, training).count() == 0
    unlearned = score(awkward, labels.limit(0), training).collect()
    assert len(unlearned) == len(found) and all(0 <= row.score <= 1 for row in unlearned)


def test_discriminant_equals_the_densities(spark):
    """Against densities computed from the same shrunk covariances by plain inversion."""
    rng = np.random.default_rng(5)
    size = len(quadratic.STATISTICS)
    x = np.concatenate([rng.normal(0, 1, (60, size)), rng.normal(0.5, 2, (90, size))])
    label = [0] * 60 + [1] * 90
    frame = spark.createDataFrame([(row.tolist(), cls) for row, cls in zip(x, label, strict=True)], "x array<double>, label int")
    model = quadratic.fit_discriminant(frame)
    density = []
    for cls, prior in ((0, 60 / 150), (1, 90 / 150)):
        own = x[np.array(label) == cls]
        covariance = np.cov(own.T, bias=True)
        shrunk = 0.9 * covariance + 0.1 * np.diag(np.diag(covariance)) + quadratic.RIDGE * np.eye(size)
        far = x - own.mean(0)
        distance = np.einsum("ij,jk,ik->i", far, np.linalg.inv(shrunk), far)
        density.append(np.log(prior) - 0.5 * np.linalg.slogdet(shrunk)[1] - 0.5 * distance)
    expected = 1 / (1 + np.exp(-(density[1] - density[0]) / quadratic.TEMPERATURE))
    assert model.probability(x) == pytest.approx(expected, rel=1e-6, abs=1e-9)


def test_statistics_of_a_small_text():
    values = dict(zip(quadratic.STATISTICS, quadratic.statistics(b"AB AB cd!\n1$"), strict=True))
    assert values["upper"] == pytest.approx((4 / 12) ** 0.5) and values["digit"] == pytest.approx((1 / 12) ** 0.5)
    assert values["shout"] == values["line"] == values["symbol"] == pytest.approx((1 / 12) ** 0.5)
    assert values["repeated_next"] == pytest.approx((1 / 4) ** 0.5) and values["distinct_lines"] == 1
    assert len(quadratic.statistics(b"")) == len(quadratic.STATISTICS)


GRAMMAR = pattern_grammar.ToxicGrammar(pattern_grammar.Lexicon({"idiot$": 4.0, "kill$": 3.0, "zork": 2.0}))


@pytest.mark.parametrize(
    ("text", "scores"),
    [
        ("", []),
        ("a calm sentence.", []),
        ("what an idiot.", [4.0]),
        ("you idiot!", [6.0]),
        ("you are not an idiot.", [4.0 * 1.5 * 0.2]),
        ("she said he is an idiot.", [4.0 * 1.5 * 0.5]),
        ("no, fine. idiot", []),
        ("idiot", []),
        ("you. idiot. you", []),
        ("no, fine. an idiot", [4.0]),
        ("zorkian zorks; kill", [4.0]),
        ("zorkian zorks; to kill", [4.0, 3.0 * 0.5]),
        ("you kill", [3.0 * 1.5 * 0.5]),
        ("i will kill you", [3.0 * 1.5]),
        ("i will kill. you see", [3.0 * 0.5]),
        ("kill one two three you", [3.0 * 0.5]),
        ("i will not kill you", [3.0 * 0.2 * 1.5]),
        ("not one two three four idiot", [4.0]),
    ],
)
def test_clauses(text, scores):
    assert GRAMMAR.clauses(text.encode()) == pytest.approx(scores)


def plain_score(text, weights, factors, slope, intercept):
    """The rules word by word: what stands before a harm or behind a verb in its own clause."""
    symbols = pattern_grammar.Lexicon(weights)
    read = [symbols.read(token) for token in text.split()]
    clauses, held = [], []
    for token in read:
        held.append(token)
        if token[2]:
            clauses, held = [*clauses, held], []
    total = 0.0
    for clause in [*clauses, held]:
        kinds = [token[0] for token in clause]
        near = lambda kind, place, reach: kind in kinds[max(0, place - reach) : place]
        if len(clause) < 2:
            continue
        for place, (kind, weight, _) in enumerate(clause):
            if kind not in (pattern_grammar.INSULT, pattern_grammar.THREAT):
                continue
            weight *= 0.5 if near(pattern_grammar.REPORT, place, 8) else 1.0
            weight *= 0.2 if near(pattern_grammar.NEGATION, place, 3) else 1.0
            weight *= 1.5 if near(pattern_grammar.TARGET, place, 4) else 1.0
            if kind == pattern_grammar.INSULT:
                form = pattern_grammar.SAID_INSULT if near(pattern_grammar.TARGET, place, 8) else pattern_grammar.INSULT
            else:
                behind = kinds[place + 1 : place + 4]
                seen = [other for other in behind if other in (pattern_grammar.TARGET, pattern_grammar.THREAT)]
                form = pattern_grammar.AIMED_THREAT if seen[:1] == [pattern_grammar.TARGET] else pattern_grammar.THREAT
            total += weight * factors[pattern_grammar.FORMS.index(form)]
    return 1 / (1 + np.exp(-(slope * np.log1p(total) + intercept)))


def test_scores_equal_the_plain_rules(spark):
    """Every row of a table of sentences, with learned weights, factors and curve."""
    rng = np.random.default_rng(3)
    words = "idiot kill you he not said zork a b c d. e! destroy them nobody wrote".split()
    rows = [(doc_id, " ".join(rng.choice(words, rng.integers(0, 40)))) for doc_id in range(400)]
    marked = [(doc_id, int("zork" in text or "kill you" in text)) for doc_id, text in rows]
    documents = spark.createDataFrame(rows, "id bigint, text string")
    model = pattern_grammar.fit_grammar(documents, spark.createDataFrame(marked, "doc_id bigint, toxic int"), F.lit(True))
    assert model.factors != pattern_grammar.FACTORS
    found = {row.doc_id: row.score for row in pattern_grammar.score_texts(model, documents).collect()}
    for doc_id, text in rows:
        expected = plain_score(text.encode(), model.lexicon.weights, model.factors, model.slope, model.intercept)
        assert found[doc_id] == pytest.approx(expected, rel=1e-9)


def test_insults_and_threats_are_not_alike():
    weights = {"idiot$": 3.0, "kill$": 3.0}
    model = pattern_grammar.ToxicGrammar(pattern_grammar.Lexicon(weights))
    for insult, threat in ((b"you idiot there", b"you kill there"), (b"the idiot you", b"the kill you")):
        assert model.clauses(insult) != model.clauses(threat)


def test_factors_follow_the_documents_that_hold_a_form():
    label = np.repeat([1.0, 0.0], 100)
    held = np.zeros((200, 4), bool)
    held[:80, 0], held[100:130, 0] = True, True
    held[:40, 2] = True
    factors = pattern_grammar.fit_factors(held, label)
    assert factors[0] == pytest.approx(1.0) and factors[2] > 1.0
    assert factors[1] == pattern_grammar.FACTORS[1] and factors[3] == pattern_grammar.FACTORS[3]


def test_composition_equals_running_the_machines_in_turn():
    first = pattern_grammar.window(pattern_grammar.REPORT, 8, 0.5)
    second = pattern_grammar.window(pattern_grammar.NEGATION, 3, 0.2)
    both = pattern_grammar.compose(first, second)
    rng = np.random.default_rng(2)
    state, left, right = both.start, first.start, second.start
    for symbol in rng.integers(0, 7, 500).tolist():
        left, written, one = first.step(left, symbol)
        right, result, other = second.step(right, written)
        state, found, factor = both.step(state, symbol)
        assert (found, factor, state) == (result, pytest.approx(one * other), (left, right))


def test_lexicon_counts_copies_once(spark):
    """A word of one copied toxic document is no evidence, a word of many toxic documents is."""
    rows = [(number, "common words of one copied text marker", 1) for number in range(40)]
    rows += [(100 + number, f"word{number} grumblet other{number}", 1) for number in range(40)]
    rows += [(200 + number, f"common words of calm texts {number}", 0) for number in range(80)]
    sample = spark.createDataFrame(rows, "id bigint, text string, label int")
    weights = pattern_grammar.learn_lexicon(sample).weights
    assert weights["grumblet$"] > 1 and weights["grum"] > 1
    assert "marker$" not in weights and "common$" not in weights


def test_training_sample_is_bounded(spark):
    rows = spark.range(100).selectExpr("id", "'x' AS text")
    labels = spark.range(100).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS toxic")
    sample = pattern_grammar.training_sample(rows, labels, F.lit(True), "toxic", "doc_id", 10)
    assert sorted(row["count"] for row in sample.groupBy("label").count().collect()) == [10, 10]
    shared = spark.range(100).selectExpr("5L AS id", "concat('x', id) AS text")
    sample = pattern_grammar.training_sample(shared, labels, F.lit(True), "toxic", "doc_id", 60)
    assert [tuple(row) for row in sample.select("id", "text").collect()] == [(5, "x0")]

"""Toxicity by a weighted finite-state pattern grammar.

A lexical transducer rewrites tokens as symbols (insult, threat, target, negation, reported speech,
clause end) with weights; five clause transducers, composed into one machine, then read the symbols.
The insult transducer marks insults that are said of a target named before them, the threat
transducer threats whose verb is followed by a target; the reported-speech, negation and target
transducers scale what lies in their reach. So every harm has one of four forms, each with a factor
of its own. A clause is matched if it holds a harm and at least one more word; a word alone between
two clause ends is not. The sum over matched clauses goes through a fitted logistic curve.

Weights, the factors of the forms and the curve are learned. From at most ``CLASS_ROWS`` labelled documents per class, word stems (whole
words and prefixes) are kept that occur in toxic documents far more often than chance allows,
weighted by their smoothed log odds. Occurrences in toxic documents count once per preceding word,
so that copies of one document are one piece of evidence. Seed words carry a weight until the
sample speaks for or against them. The factor of a form is the log odds of documents that hold it,
relative to those of documents that hold any harm; forms that few documents hold keep theirs.

Edge cases: a null or empty text matches no clause and gets the score of a text without harm;
labels other than 0 and 1 are not learned from; without training rows of both classes the seeds
and a default curve are used; rows that share an id are scored each for itself, and the least of
their texts is learned from; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flipside.llm.common import byte_strings, lean, Memo, texts
from flipside.session import materialize

# Most labelled documents of a class that the lexicon and the curve are fitted on.
CLASS_ROWS = 10_000
PREFIXES = range(4, 9)
# Least log-likelihood ratio and log odds of a stem.
EVIDENCE = 14.0
LEAST_WEIGHT = 2.5
SEED_WEIGHT = 2.0

OTHER, TARGET, NEGATION, REPORT, END, INSULT, THREAT, SAID_INSULT, AIMED_THREAT = range(9)
SYMBOLS = range(9)
# What a harm can be when all transducers have read it, and its factor until the sample speaks.
FORMS = (INSULT, THREAT, SAID_INSULT, AIMED_THREAT)
FACTORS = (1.0, 0.5, 1.0, 1.5)
# Documents that must hold a form before its factor is learned, and the range of learned factors.
FORM_DOCUMENTS = 20
LEAST_FACTOR, MOST_FACTOR = 0.25, 4.0

SEEDS = {
    INSULT: "idiot moron stupid loser trash scum worthless pathetic disgusting clown fool imbecile dumb "
    "idiota imbécil estúpido basura trottel dummkopf abschaum crétin imbécile ordure",
    THREAT: "kill hurt destroy punch murder burn töten umbringen tuer frapper matar golpear",
    TARGET: "you your you're he she they them him her du dich ihr sie tu vous toi tú usted ustedes vosotros",
    NEGATION: "not never no isn't aren't don't nobody nicht kein keine nie pas jamais aucun nunca jamás tampoco",
    REPORT: "said says called wrote quoted claimed told sagte schrieb dit écrit dijo escribió",
}
WORD_EDGES = re.compile(r"^[^\w]+|[^\w]+$")
CLAUSE_ENDS = (".", "!", "?", ";", ":")


@dataclass
class Transducer:
    """Deterministic and weighted: ``arcs[state, symbol]`` is the next state, the symbol written
    and the factor; a missing arc copies the symbol and leads to ``otherwise[state]``."""

    start: object
    arcs: dict
    otherwise: dict

    def step(self, state: object, symbol: int) -> tuple[object, int, float]:
        return self.arcs.get((state, symbol), (self.otherwise[state], symbol, 1.0))


def window(opener: int, length: int, factor: float) -> Transducer:
    """Scales harms within ``length`` symbols after ``opener``, up to the end of the clause."""
    arcs, otherwise = {}, {0: 0}
    for left in range(1, length + 1):
        otherwise[left] = left - 1
        arcs[left, END] = (0, END, 1.0)
        for harm in FORMS:
            arcs[left, harm] = (left - 1, harm, factor)
    for left in range(length + 1):
        arcs[left, opener] = (length, opener, 1.0)
    return Transducer(0, arcs, otherwise)


def insult_clause(reach: int) -> Transducer:
    """Marks insults at most ``reach`` symbols after a target of the same clause: said of it."""
    arcs, otherwise = {(0, TARGET): (reach, TARGET, 1.0)}, {0: 0}
    for left in range(1, reach + 1):
        otherwise[left] = left - 1
        arcs[left, END] = (0, END, 1.0)
        arcs[left, TARGET] = (reach, TARGET, 1.0)
        arcs[left, INSULT] = (left - 1, SAID_INSULT, 1.0)
    return Transducer(0, arcs, otherwise)


def threat_clause(reach: int) -> Transducer:
    """Completes a threat: a target at most ``reach`` symbols after the verb, in the same clause."""
    arcs, otherwise = {(0, THREAT): (reach, THREAT, 1.0)}, {0: 0}
    for left in range(1, reach + 1):
        otherwise[left] = left - 1
        arcs[left, END] = (0, END, 1.0)
        arcs[left, THREAT] = (reach, THREAT, 1.0)
        arcs[left, TARGET] = (0, AIMED_THREAT, 1.0)
    return Transducer(0, arcs, otherwise)


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The machine that hands what ``first`` writes to ``second``, with factors multiplied."""
    arcs, states, todo = {}, set(), [(first.start, second.start)]
    while todo:
        state = todo.pop()
        if state in states:
            continue
        states.add(state)
        for symbol in SYMBOLS:
            left, written, one = first.step(state[0], symbol)
            right, result, other = second.step(state[1], written)
            arcs[state, symbol] = ((left, right), result, one * other)
            todo.append((left, right))
    return Transducer((first.start, second.start), arcs, {state: state for state in states})


def grammar() -> Transducer:
    """Reported speech, negation and target windows, then insult and threat clauses, composed.

    The windows come first, since a completed threat takes the place of its target.
    """
    reported = window(REPORT, 8, 0.5)
    negated = window(NEGATION, 3, 0.2)
    targeted = window(TARGET, 4, 1.5)
    windows = compose(compose(reported, negated), targeted)
    return compose(compose(windows, insult_clause(8)), threat_clause(3))


GRAMMAR = grammar()


def plain_word(token: str) -> str:
    return WORD_EDGES.sub("", token.lower())


def stems(word: str) -> list[str]:
    """The word itself, marked by a closing ``$``, and its prefixes."""
    return [word + "$", *(word[:size] for size in PREFIXES if size <= len(word))]


@dataclass
class Lexicon:
    """Weights of harmful stems and symbols of function words; ``read`` is the lexical transducer."""

    weights: dict[str, float]

    def __post_init__(self):
        self.symbols = {word: symbol for symbol, words in SEEDS.items() for word in words.split()}

    def read(self, token: bytes) -> tuple[int, float, bool]:
        """Symbol and weight of a token, and whether the clause ends behind it."""
        text = token.decode("utf-8", "replace")
        word = plain_word(text)
        weight = max((self.weights.get(stem, 0.0) for stem in stems(word)), default=0.0) if word else 0.0
        symbol = self.symbols.get(word, OTHER)
        if weight > 0:
            symbol = THREAT if symbol == THREAT else INSULT
        elif symbol in (INSULT, THREAT):
            symbol = OTHER
        return symbol, weight, text.endswith(CLAUSE_ENDS)


@dataclass
class ToxicGrammar:
    lexicon: Lexicon
    slope: float = 2.0
    intercept: float = -3.0
    factors: tuple[float, ...] = FACTORS

    def __post_init__(self):
        self.tokens = Memo(self.lexicon.read)

    def forms(self, text: bytes) -> list[list[float]]:
        """Per matched clause the weight of its harms in each of the ``FORMS``."""
        tokens = list(map(self.tokens.__getitem__, text.split()))
        self.tokens.trim()
        if not any(token[1] for token in tokens):
            return []
        matched, state = [], GRAMMAR.start
        sums, words, verb = [0.0] * len(FORMS), 0, 0.0
        for symbol, weight, ends in [*tokens, (END, 0.0, True)]:
            state, written, factor = GRAMMAR.arcs[state, symbol]
            words += symbol != END
            if written == AIMED_THREAT:
                sums[FORMS.index(THREAT)] -= verb
                sums[FORMS.index(AIMED_THREAT)] += verb
            elif written in FORMS:
                sums[FORMS.index(written)] += weight * factor
                verb = weight * factor if written == THREAT else verb
            if ends:
                state, _, _ = GRAMMAR.arcs[state, END]
                if any(sums):
                    if words > 1:
                        matched.append(sums)
                    sums = [0.0] * len(FORMS)
                words = 0
        return matched

    def clauses(self, text: bytes) -> list[float]:
        """Scores of the clauses that match."""
        return [sum(map(float.__mul__, sums, self.factors)) for sums in self.forms(text)]

    def harm(self, clauses: list[float]) -> float:
        return float(np.log1p(sum(clauses)))

    def probability(self, harm: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * harm + self.intercept, -700, 700)))


def evidence_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct ``(word, preceding word)`` of toxic documents, and occurrences of words in clean ones."""
    for batch in batches:
        toxic: set[tuple[str, str]] = set()
        clean: Counter[str] = Counter()
        for label, text in zip(batch.column("label").to_pylist(), byte_strings(batch.column("text")), strict=True):
            words = [plain_word(token) for token in text.decode("utf-8", "replace").split()]
            if label:
                toxic.update(zip(words, ["", *words[:-1]], strict=True))
            else:
                clean.update(words)
        rows = [(1, word, before, 1) for word, before in toxic if word]
        rows += [(0, word, "", count) for word, count in clean.items() if word]
        if rows:
            arrays = [pa.array(column) for column in zip(*rows, strict=True)]
            arrays[0], arrays[3] = arrays[0].cast(pa.int32()), arrays[3].cast(pa.int64())
            yield pa.RecordBatch.from_arrays(arrays, names=["label", "word", "before", "n"])


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """Stems of ``sample``, rows ``(id, text, label)`` of bounded number, that mark toxic documents."""
    seen = sample.mapInArrow(evidence_batches, "label int, word string, before string, n bigint")
    contexts = seen.filter("label = 1").dropDuplicates(["word", "before"])
    words = (
        contexts.unionByName(seen.filter("label = 0"))
        .groupBy("word")
        .agg(
            F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("toxic"),
            F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("clean"),
        )
    )
    words = materialize(words, "toxic-words")
    pieces = [F.concat("word", F.lit("$"))]
    pieces += [F.when(F.length("word") >= size, F.substring("word", 1, size)) for size in PREFIXES]
    by_stem = (
        words.withColumn("stem", F.explode(F.array_compact(F.array(*pieces))))
        .groupBy("stem")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    )
    all_toxic, all_clean = words.agg(F.sum("toxic"), F.sum("clean")).first()
    weights = {word + "$": SEED_WEIGHT for kind in (INSULT, THREAT) for word in SEEDS[kind].split()}
    if not all_toxic or not all_clean:
        return Lexicon(weights)
    share = all_toxic / (all_toxic + all_clean)
    toxic, clean = F.col("toxic"), F.col("clean")
    both = toxic + clean
    ratio = toxic * F.log(F.greatest(toxic, F.lit(1)) / (both * share)) + clean * F.log(
        F.greatest(clean, F.lit(1)) / (both * (1 - share))
    )
    odds = F.log((toxic + 0.5) / all_toxic) - F.log((clean + 0.5) / all_clean)
    seeds = F.col("stem").isin(*weights)
    marked = by_stem.select("stem", odds.alias("odds"), ((ratio >= EVIDENCE) & (odds >= LEAST_WEIGHT)).alias("marks"))
    for stem, weight, marks in marked.filter(F.col("marks") | seeds).collect():
        if marks or weight <= 0:
            weights[stem] = max(weight, 0.0)
    return Lexicon(weights)


def fit_curve(harm: np.ndarray, label: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and intercept of a ridged logistic regression, by Newton's method."""
    x = np.stack([harm, np.ones(len(harm))], 1)
    beta = np.array([1.0, -2.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (p - label) / len(x) + ridge * beta
        hessian = (x * (p * (1 - p))[:, None]).T @ x / len(x) + ridge * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta = beta - step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def fit_factors(held: np.ndarray, label: np.ndarray) -> tuple[float, ...]:
    """Factors of the forms; ``held`` has a line per document, which forms it holds."""

    def odds(holds: np.ndarray) -> float:
        toxic, clean = (np.count_nonzero(holds[label == cls]) for cls in (1, 0))
        return float(np.log((toxic + 0.5) / (np.count_nonzero(label == 1) + 1)) - np.log((clean + 0.5) / (np.count_nonzero(label == 0) + 1)))

    usual = odds(held.any(1))
    if usual <= 0:
        return FACTORS
    return tuple(
        float(np.clip(odds(holds) / usual, LEAST_FACTOR, MOST_FACTOR)) if np.count_nonzero(holds) >= FORM_DOCUMENTS else factor
        for holds, factor in zip(held.T, FACTORS, strict=True)
    )


def training_sample(
    documents: DataFrame, labels: DataFrame, is_training: Column, label_column: str, id_column: str, class_rows: int
) -> DataFrame:
    """Texts of at most ``class_rows`` labelled documents per class, those of least hashed id;
    rows that share an id count as the one of least text."""
    known = labels.select(F.col(id_column).cast("bigint").alias("id"), F.col(label_column).cast("int").alias("label"))
    known = known.filter(F.col("label").isin(0, 1) & F.col("id").isNotNull() & is_training).distinct()
    order = F.xxhash64("id"), F.col("id")
    chosen = [known.filter(F.col("label") == cls).orderBy(*order).limit(class_rows) for cls in (0, 1)]
    found = documents.join(F.broadcast(chosen[0].unionByName(chosen[1])), "id")
    return found.groupBy("id", "label").agg(F.min("text").alias("text"))


def fit_grammar(
    documents: DataFrame,
    labels: DataFrame,
    is_training: Column,
    label_column: str = "toxic",
    id_column: str = "doc_id",
    class_rows: int = CLASS_ROWS,
) -> ToxicGrammar:
    """Learn lexicon, factors and curve; ``documents`` holds ``(id, text)``. The sample is bounded, and so
    is what is learned from it."""
    sample = training_sample(documents, labels, is_training, label_column, id_column, class_rows)
    model = ToxicGrammar(learn_lexicon(sample))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.array(model.forms(text)).reshape(-1, len(FORMS)).sum(0) for text in byte_strings(batch.column("text"))]
            sums = pa.array([sums.tolist() for sums in found], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("label"), sums], names=["label", "forms"])

    measured = sample.select("label", "text").mapInArrow(measure, "label int, forms array<double>").toPandas()
    if measured["label"].nunique() == 2:
        label = measured["label"].to_numpy(np.float64)
        sums = np.stack(measured["forms"].to_numpy())
        model.factors = fit_factors(sums > 0, label)
        model.slope, model.intercept = fit_curve(np.log1p(sums @ np.array(model.factors)), label)
    return model


def score_toxicity(
    documents: DataFrame,
    labels: DataFrame,
    is_training: Column,
    label_column: str = "toxic",
    id_column: str = "doc_id",
    text_column: str = "text",
    class_rows: int = CLASS_ROWS,
) -> DataFrame:
    """``(doc_id, score, n_clauses)`` of every document; ``is_training`` is a condition on the
    column ``id`` of the labelled rows."""
    rows = texts(documents, id_column, text_column)
    return score_texts(fit_grammar(rows, labels, is_training, label_column, id_column, class_rows), rows)


def score_texts(model: ToxicGrammar, rows: DataFrame) -> DataFrame:
    """``(doc_id, score, n_clauses)`` of ``rows (id, text)``."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clauses = [model.clauses(text) for text in byte_strings(batch.column("text"))]
            harm = np.array([model.harm(found) for found in clauses], np.float64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(model.probability(harm)), pa.array([len(found) for found in clauses], pa.int32())],
                names=["doc_id", "score", "n_clauses"],
            )

    return rows.mapInArrow(lean(score), "doc_id bigint, score double, n_clauses int")

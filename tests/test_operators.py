"""Splits, joins, metrics, comparisons, audits and ledgers on small literal tables."""

import collections
import hashlib
import json
import re

import pytest
from pyspark.sql import functions as F

from flipside.functions.terms import tokens
from flipside.operators import audit as A
from flipside.operators import compare as C
from flipside.operators import features as X
from flipside.operators import joins
from flipside.operators import metrics as M
from flipside.operators import ranking
from flipside.operators import splits as SP
from flipside.sources import corpus as R
from flipside.sources import ledger as L


def rows_of(frame, *columns):
    return sorted(tuple(r[c] for c in columns or frame.columns) for r in frame.collect())


# --- splits -----------------------------------------------------------------------------------


def test_split_counts_at_documented_class_sizes(spark):
    rows = spark.range(7613).select("id", (F.col("id") < 3271).cast("int").alias("target"))
    split = SP.stratified_split(rows).cache()
    assert rows_of(SP.split_balance(split).select("split", "n_positive", "n_negative")) == [
        ("dev", 654, 868), ("heldout", 655, 869), ("train", 1962, 2605),
    ]
    by_hash = sorted(range(3271), key=lambda i: hashlib.md5(f"3102:{i}".encode()).hexdigest())
    train = {r.id for r in split.filter("split = 'train' AND target = 1").collect()}
    assert train == set(by_hash[:1962])
    again = SP.stratified_split(rows.repartition(5))
    assert again.select("id", "split").exceptAll(split.select("id", "split")).isEmpty()


def test_split_of_tiny_classes(spark):
    rows = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "id long, target int")
    assert SP.stratified_split(rows).filter("target = 0").first().split == "heldout"


def test_split_lists(spark, tmp_path):
    path = tmp_path / "split.json"
    path.write_text(json.dumps({"train_ids": [3, 1], "dev_ids": [2], "heldout_ids": [9]}))
    splits = R.read_splits(spark, str(path))
    corpus = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id long")
    assert rows_of(SP.select_split(corpus, splits, "train"), "pos", "id") == [(0, 3), (1, 1)]
    with pytest.raises(SP.SplitError):
        SP.select_split(corpus, splits, "heldout")
    found = SP.split_coverage(corpus, splits.unionByName(splits.filter("id = 2"))).first()
    assert found.asDict() == {"n_rows": 4, "n_unassigned": 1, "n_listed_twice": 1, "n_unknown": 1}
    with pytest.raises(SP.SplitError):
        SP.require_coverage(corpus, splits)


def test_heldout_needs_a_frozen_decision(spark):
    rows = spark.createDataFrame([(1, "dev"), (2, "heldout")], "id long, split string")
    with pytest.raises(SP.SplitError):
        SP.open_splits(rows, ["heldout"])
    frozen = SP.FrozenDecision("t", "m", "d", "r")
    assert SP.open_splits(rows, ["heldout"], frozen).first().id == 2
    assert SP.open_splits(rows, ["dev", "heldout"], diagnostic=True).count() == 2


# --- joins and features -----------------------------------------------------------------------


def test_salted_join_splits_hot_keys_and_loses_nothing(spark):
    facts = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("key")
    )
    counts = facts.groupBy("key").agg(F.count("*").alias("n"))
    lookup = counts.filter("key <> 'k7'").withColumn("value", F.length("key"))
    salted = joins.salted_join(facts, lookup, ["key"], counts, F.col("id"), "left", target_rows=50)
    plain = facts.join(lookup, "key", "left")
    assert rows_of(salted.select("id", "key", "value").fillna(-1)) == rows_of(
        plain.select("id", "key", "value").fillna(-1)
    )


@pytest.mark.parametrize("rows", [4000, 16000])
def test_hot_pieces_stay_at_the_target(spark, rows):
    """A key with a fifth of the rows is cut into pieces as large at either size of the data."""
    facts = spark.range(rows).select("id", F.when(F.col("id") % 5 == 0, -1).otherwise(F.col("id")).alias("key"))
    counts = facts.groupBy("key").agg(F.count("*").alias("n"))
    pieces = joins.hot_pieces(counts, ["key"], 100).collect()
    assert [(p.key, p["__pieces"]) for p in pieces] == [(-1, rows // 500)]
    piece = F.pmod(F.xxhash64("id"), F.lit(pieces[0]["__pieces"]))
    assert facts.filter("key = -1").groupBy(piece).count().agg(F.max("count")).first()[0] < 160


def test_shuffle_and_broadcast_lookups_agree(spark, monkeypatch):
    documents = spark.createDataFrame(
        [(1, 1, "train", "aa bb aa"), (2, 0, "train", "bb cc"), (3, 0, "dev", "aa zz"), (4, 1, "dev", "?")],
        "id long, target int, split string, text string",
    )
    tf = X.term_frequencies(documents, tokens(F.col("text")), keep_empty=True)
    terms = X.fit_terms(tf)

    def vectors():
        made = X.text_vectors(tf, terms, documents)
        return {r.id: (r.size, [round(v, 9) for v in r["values"]]) for r in made.collect()}

    small = vectors()
    monkeypatch.setattr(joins, "BROADCAST_BYTES", -1)
    assert vectors() == small
    assert set(small) == {1, 2, 3, 4}
    assert small[4] == (3, [])
    assert small[3] == (3, [1.0])


def test_index_is_dense_per_feature_set(spark):
    rows = spark.range(5000).select((F.col("id") % 2).alias("kind"), F.col("id").cast("string").alias("term"))
    indexed = X.with_index(rows, ["kind"]).groupBy("kind").agg(
        F.countDistinct("idx").alias("d"), F.min("idx").alias("low"), F.max("idx").alias("high"), F.max("size").alias("size")
    )
    assert rows_of(indexed) == [(0, 2500, 0, 2499, 2500), (1, 2500, 0, 2499, 2500)]


def test_one_hot_missing_and_unseen(spark):
    rows = spark.createDataFrame(
        [(1, "train", None), (2, "train", "a"), (3, "dev", "b"), (4, "dev", None)],
        "id long, split string, keyword string",
    )
    assert rows_of(X.one_hot(rows), "id", "level") == [(1, "__missing__"), (2, "a"), (4, "__missing__")]


# --- metrics and comparison -------------------------------------------------------------------


def test_sweep_matches_counting_at_each_threshold(spark):
    data = [(i, i % 3 == 0, (i * 37 % 100) / 100) for i in range(200)]
    scores = spark.createDataFrame([(i, int(y), s) for i, y, s in data], "id long, y_true int, score double")
    swept = M.threshold_sweep(scores).orderBy("position").collect()
    assert [r.threshold for r in swept] == [k / 100 for k in range(20, 71, 5)]
    for r in swept:
        tp = sum(y and s >= r.threshold for _, y, s in data)
        fp = sum(not y and s >= r.threshold for _, y, s in data)
        fn = sum(y and s < r.threshold for _, y, s in data)
        assert (r.tp, r.fp, r.fn) == (tp, fp, fn)
        p, c = r.precision_target_1, r.recall_target_1
        assert r.f1_target_1 == pytest.approx(2 * p * c / (p + c) if p + c else 0)
    recalls = [r.recall_target_1 for r in swept]
    assert recalls == sorted(recalls, reverse=True)


def test_no_positive_predictions_score_zero(spark):
    counts = spark.createDataFrame([(0, 0, 5, 3)], "tp long, fp long, fn long, tn long")
    assert tuple(M.prf(counts).first())[:3] == (0.0, 0.0, 0.0)


def test_best_row_takes_the_first_of_rounded_ties(spark):
    table = spark.createDataFrame([(0, 0.70001), (1, 0.70004), (2, 0.5)], "position int, f1 double")
    assert M.best_row(table, "f1").first().position == 0
    assert M.best_row(table, "f1", digits=None).first().position == 1


def test_flips(spark):
    base = spark.createDataFrame([(i, p) for i, p in enumerate([1, 0, 0, 1, 1, 0])], "id long, y_pred int")
    new = spark.createDataFrame(
        list(zip(range(6), [0, 1, 0, 1, 1, 0], [0, 1, 1, 0, 1, 0])), "id long, y_true int, y_pred int"
    )
    flipped = C.flips(base, new)
    assert C.flip_counts(flipped).first().asDict() == {
        "fixed_fp": 1, "fixed_fn": 1, "new_fp": 1, "new_fn": 1, "net_flips": 0,
    }
    one = C.flip_examples(flipped.withColumn("v", F.lit("x")), ["v"], ["id"], 1)
    assert rows_of(one, "flip_type", "id") == [("fixed_fn", 1), ("fixed_fp", 0), ("new_fn", 3), ("new_fp", 2)]


def test_gap_flag_uses_the_unrounded_gap(spark, tmp_path):
    path = tmp_path / "contract.json"
    path.write_text(json.dumps({"metric": "f1", "reference_baseline_f1": 0.75, "tolerance": 0.001}))
    results = spark.createDataFrame([(0, 0.75104), (1, 0.7491)], "position int, heldout_f1_target_1 double")
    gaps = C.contract_gap(results, R.read_contract(spark, str(path)))
    assert rows_of(gaps, "position", "heldout_gap_vs_reference", "within_tolerance") == [
        (0, 0.001, False), (1, -0.0009, True),
    ]
    assert C.closest_to_contract(gaps).first().position == 1
    assert [r.position for r in C.in_tolerance(gaps).collect()] == [1]


# --- audit ------------------------------------------------------------------------------------

COPIES = [
    (1, "Tie here", 1, "train"), (2, " tie  HERE", 0, "heldout"),
    (3, "three to one", 1, "train"), (4, "three to one", 1, "dev"),
    (5, "three to one", 1, "heldout"), (6, "three to one", 0, "train"),
    (7, "alone", 1, "train"), (8, "same", 0, "train"), (9, "same", 0, "dev"),
]


@pytest.fixture(scope="module")
def copies(spark):
    return spark.createDataFrame(COPIES, "id long, text string, target int, split string")


def test_duplicate_conflicts(copies):
    found = {r.id: r for r in A.duplicate_conflicts(A.conflict_members(A.text_groups(copies))).collect()}
    verdicts = {i: (r.disposition, r.proposed_label, r.confidence) for i, r in found.items()}
    assert verdicts == {
        1: ("ambiguous", None, "low"), 2: ("keep_but_flag", None, "low"),
        3: ("fix", 1, "high"), 4: ("fix", 1, "high"),
        5: ("keep_but_flag", None, "high"), 6: ("fix", 1, "high"),
    }
    assert found[1].evidence == found[2].evidence
    assert found[2].evidence.endswith(" rows=2 positives=1 text='tie here'")
    members = rows_of(A.group_members(A.conflict_members(A.text_groups(copies))), "id", "label", "place")
    assert members == [(1, 1, 1), (2, 0, 2), (3, 1, 1), (4, 1, 2), (5, 1, 3), (6, 0, 4)]


def test_places_in_a_group_of_a_third_of_all_rows(spark):
    """Null groups, ties and rows alike in every column; no range holds much more than its target."""
    rows = [("hot" if i % 3 == 0 else None if i % 3 == 1 else f"g{i % 500}", i // 4 if i % 5 else None) for i in range(9000)]
    frame = spark.createDataFrame([*rows, *[("same", 1)] * 3000], "g string, id long")
    placed = ranking.with_places(frame, ["g"], ["id"], target_rows=500).collect()
    groups = collections.defaultdict(list)
    for row in placed:
        groups[row.g].append((row.place, row.id, row.size))
    assert len(placed) == 12000
    for found in groups.values():
        found.sort()
        assert [place for place, _, _ in found] == list(range(1, len(found) + 1))
        assert {size for _, _, size in found} == {len(found)}
        ids = [-1 if i is None else i for _, i, _ in found]
        assert ids == sorted(ids)
    ranges = ranking.dealt_by_range(frame, ["g", "id"], 500).groupBy("__range").count().collect()
    assert len(ranges) >= 20 and max(r["count"] for r in ranges) <= 1000
    assert ranking.with_places(frame.limit(0), ["g"], ["id"]).count() == 0


@pytest.mark.parametrize("broadcast", [joins.BROADCAST_BYTES, -1])
def test_groups_of_any_size_have_one_form(spark, broadcast, monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_BYTES", broadcast)
    rows = [(i, "large group", int(i % 5 == 0), "train") for i in range(5000)] + [(5000, "pair", 0, "dev"), (5001, "pair", 1, "dev")]
    frame = spark.createDataFrame(rows, "id long, text string, target int, split string")
    found = A.duplicate_conflicts(A.conflict_members(A.text_groups(frame))).collect()
    assert len(found) == 5002
    assert {re.sub("key=[0-9A-F]{64} ", "", r.evidence) for r in found} == {
        "dup group rows=5000 positives=1000 text='large group'", "dup group rows=2 positives=1 text='pair'",
    }
    assert max(len(r.evidence) for r in found) < 150


def test_error_floor_and_relabel(copies):
    grouped = A.text_groups(copies)
    assert A.error_floor(grouped).first().asDict() == {"n_groups": 2, "n_rows": 6, "error_floor": 2}
    relabelled = A.relabel_overlay(copies, A.duplicate_conflicts(A.conflict_members(grouped)))
    assert rows_of(relabelled.filter("original_label <> target"), "id", "target") == [(6, 1)]


def test_reviews(spark):
    scores = spark.createDataFrame(
        [(1, 0, "dev", 0.97, None), (2, 1, "train", 0.07, "fire"), (3, 0, "heldout", 0.99, "x"), (4, 0, "dev", 0.9, "x")],
        "id long, y_true int, split string, score double, keyword string",
    )
    audit = A.likely_mislabels(scores)
    assert rows_of(audit, "id", "confidence") == [(1, "high"), (2, "medium")]
    assert audit.filter("id = 1").first().evidence == (
        "LR(C=3) label=0 but p(target=1)=0.9700 > 0.9, keyword=(none), split=dev"
    )
    reviews = spark.createDataFrame(
        [(1, "reject_false_positive", None), (2, "fix", 0), (8, "fix", 1)], "id long, verdict string, new_label int"
    )
    assert rows_of(A.review_overlay(audit, reviews), "id", "issue_type", "disposition", "original_label") == [
        (1, "reject_false_positive", "reject_false_positive", 0), (2, "likely_mislabel", "fix", 1),
    ]
    assert A.review_overlay(audit, reviews).filter("id = 2").first().proposed_label == 0
    assert rows_of(A.review_coverage(audit, reviews)) == [(8, "no_such_finding")]
    with pytest.raises(ValueError, match="without a finding"):
        A.require_reviews_match(audit, reviews)
    twice = reviews.filter("id = 2").unionByName(reviews.filter("id = 2").withColumn("verdict", F.lit("ambiguous")))
    with pytest.raises(ValueError, match="more than one verdict"):
        A.require_reviews_match(audit, twice)
    with pytest.raises(Exception, match="more than one verdict"):
        A.review_overlay(audit, twice).collect()


# --- sinks ------------------------------------------------------------------------------------


def test_ledger_replaces_only_its_own_ticket(spark, tmp_path):
    path = str(tmp_path / "ledger")

    def block(ticket, label):
        return spark.createDataFrame([(1, 1, label, 0.5, "m", ticket)], L.PREDICTIONS_SCHEMA)

    L.replace_in_ledger(block("t1", 0), path, "t1")
    L.replace_in_ledger(block("t2", 0), path, "t2")
    for _ in range(2):
        L.replace_in_ledger(block("t1", 1), path, "t1")
    assert rows_of(L.read_ledger(spark, path, L.PREDICTIONS_SCHEMA), "ticket", "y_pred") == [("t1", 1), ("t2", 0)]


def test_ledger_drift(spark):
    stored = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "id long, y_pred int")
    now = spark.createDataFrame([(1, 0), (2, 0), (4, 1)], "id long, y_pred int")
    assert tuple(L.ledger_drift(stored, now).first()) == (1, 1, 1, 1)


def test_csv_corpus_round_trip(spark, tmp_path):
    path = str(tmp_path / "corpus.csv")
    rows = [(1, "a", None, ' two\nlines, "quoted" ', 1), (2, "NA", "", "", 0)]
    L.write_table(spark.createDataFrame(rows, R.CORPUS_SCHEMA), path)
    got = {r.id: tuple(r) for r in R.read_corpus(spark, path).collect()}
    assert got == {1: rows[0], 2: (2, None, None, "", 0)}


# --- plans ------------------------------------------------------------------------------------


def test_no_python_in_the_text_path(spark, folder, capsys):
    from flipside.queries import QUERIES

    names = ("surface_profile", "token_counts", "norm_unescape_known", "norm_unescape_html", "norm_all", "tfidf_l2")
    for name in (*names, "dup_label_conflicts", "flip_counts", "normalization_sweep"):
        QUERIES[name](spark, folder).explain()
        plan = capsys.readouterr().out
        assert "EvalPython" not in plan and "CartesianProduct" not in plan, name


def test_filters_and_columns_reach_the_scan(spark, folder, capsys):
    from flipside.queries import split_table

    split_table(spark, folder).explain()
    plan = capsys.readouterr().out
    assert "text" not in plan.split("ReadSchema")[-1]

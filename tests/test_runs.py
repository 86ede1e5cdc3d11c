"""All steps over corpus and split files, in order, with a re-run that must not change a ledger."""

import json
from types import SimpleNamespace

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flipside import __main__ as command
from flipside.operators.splits import FrozenDecision, SplitError
from flipside.plans import runs
from flipside.queries import corpus
from flipside.session import scratch_path
from flipside.sources import ledger as L
from flipside.sources.corpus import CORPUS_SCHEMA


def test_steps_from_files(spark, folder, tmp_path, monkeypatch):
    # The whole grid is a query of its own.
    monkeypatch.setattr(runs.probes, "grid_settings", lambda settings=runs.probes.grid_settings(): settings[::12])
    rows = corpus(spark, folder).cache()
    path, splits, contract = str(tmp_path / "train.csv"), tmp_path / "split.json", tmp_path / "contract.json"
    L.write_table(rows.select(*CORPUS_SCHEMA.names), path)
    ids = {n: [r.id for r in rows.filter(F.col("split") == n).orderBy("pos").collect()] for n in ("train", "dev", "heldout")}
    splits.write_text(json.dumps({f"{n}_ids": v for n, v in ids.items()}))
    contract.write_text(json.dumps({"metric": "f1", "reference_baseline_f1": 0.5, "tolerance": 0.1}))
    work = runs.Workspace(spark, path, str(splits), str(tmp_path / "out"), str(contract), "csv")

    for step in ("baseline", "probe", "profile", "normalization", "punctuation", "freeze", "shortcuts", "decision"):
        runs.STEPS[step](work)
    first = sorted(map(tuple, L.read_ledger(spark, work.summary, L.SUMMARY_SCHEMA).collect()))
    assert [r[0] for r in first] == sorted(t for t, _ in runs.TICKETS.values())
    runs.run_freeze(work)
    assert sorted(map(tuple, L.read_ledger(spark, work.summary, L.SUMMARY_SCHEMA).collect())) == first
    blocks = L.read_ledger(spark, work.predictions, L.PREDICTIONS_SCHEMA).groupBy("ticket").count().collect()
    assert {r["count"] for r in blocks} == {len(ids["heldout"])}
    drift = spark.read.csv(work.path("baseline_drift"), header=True).first()
    assert (drift.n_same, drift.n_changed) == (str(len(ids["heldout"])), "0")

    sweep = spark.read.csv(work.path("ticket2_dev"), header=True).filter("variant = 'strip_urls'").first()
    summary = {row[0]: row for row in first}
    assert summary["ticket-2-normalization"][2] == float(sweep.dev_f1_target_1)
    probed = spark.read.csv(work.path("ticket1_probe"), header=True)
    close = spark.read.csv(work.path("ticket1_in_tolerance"), header=True)
    assert close.count() == probed.filter("within_tolerance = 'true'").count()
    assert spark.read.csv(work.path("ticket1_closest"), header=True).count() == 1
    for table in ("ticket2_profile", "ticket2_examples", "ticket2_punct_probe", "ticket3_shortcuts"):
        assert spark.read.csv(work.path(table), header=True).columns

    reviews = tmp_path / "reviews.csv"
    reviews.write_text("id,verdict,new_label\n")
    runs.run_audit(work, str(reviews))
    assert spark.read.csv(work.path("relabelled"), header=True).count() == rows.count()


def test_command_line(folder, tmp_path, spark, monkeypatch):
    rows = corpus(spark, folder)
    rows.select(*CORPUS_SCHEMA.names).write.parquet(str(tmp_path / "rows"))
    rows.select("id", "split", F.row_number().over(W.partitionBy("split").orderBy("pos")).cast("bigint").alias("pos")).write.parquet(
        str(tmp_path / "splits")
    )
    options = {"corpus": "rows", "splits": "splits", "out": "out"}
    arguments = [part for name, path in options.items() for part in (f"--{name}", str(tmp_path / path))]
    monkeypatch.setattr("sys.argv", ["flipside", "profile", *arguments])
    command.main()
    assert spark.read.parquet(str(tmp_path / "out" / "ticket2_profile")).count() > 0


def test_an_empty_rerun_leaves_no_row_of_its_ticket(spark, tmp_path):
    path = str(tmp_path / "ledger")
    block = spark.createDataFrame([(1, 1, 0, 0.5, "m", "a")], L.PREDICTIONS_SCHEMA)
    other = spark.createDataFrame([(2, 0, 0, 0.1, "m", "b")], L.PREDICTIONS_SCHEMA)
    L.replace_in_ledger(block, path, "a")
    L.replace_in_ledger(other, path, "b")
    L.replace_in_ledger(block.limit(0), path, "a")
    assert [row.id for row in L.read_ledger(spark, path, L.PREDICTIONS_SCHEMA).collect()] == [2]
    with pytest.raises(Exception, match="another ticket"):
        L.replace_in_ledger(block, path, "b")


def test_a_run_that_breaks_off_leaves_the_earlier_block(spark, tmp_path):
    path = str(tmp_path / "ledger")
    block = lambda label: spark.createDataFrame([(1, 1, label, 0.5, "m", "a")], L.PREDICTIONS_SCHEMA)
    L.write_version(block(0), path, "a")
    assert L.read_ledger(spark, path, L.PREDICTIONS_SCHEMA).count() == 0
    L.replace_in_ledger(block(0), path, "a")
    version = L.write_version(block(1), path, "a")
    assert [row.y_pred for row in L.read_ledger(spark, path, L.PREDICTIONS_SCHEMA, "a").collect()] == [0]
    L.commit_version(spark, path, "a", version)
    assert [row.y_pred for row in L.read_ledger(spark, path, L.PREDICTIONS_SCHEMA, "a").collect()] == [1]
    # A write that fails half way is never committed.
    bad = block(2).withColumn("y_pred", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        L.replace_in_ledger(bad, path, "a")
    assert [row.y_pred for row in L.read_ledger(spark, path, L.PREDICTIONS_SCHEMA, "a").collect()] == [1]


def test_held_out_rows_are_scored_under_one_decision(spark, tmp_path):
    path = str(tmp_path / "ledger")
    first = FrozenDecision("t", "m", "adopt", "because", 0.45)
    assert L.record_decision(spark, path, first) == first
    L.record_decision(spark, path, FrozenDecision("t", "m", "adopt", "said otherwise", 0.45))
    L.record_decision(spark, path, FrozenDecision("other", "m", "adopt", "", None))
    for second in (FrozenDecision("t", "m", "adopt", "because", 0.5), FrozenDecision("t", "n", "adopt", "because", 0.45)):
        with pytest.raises(SplitError, match="scored once"):
            L.record_decision(spark, path, second)


def test_a_stored_metric_needs_one_row(spark):
    table = spark.createDataFrame([("a", 0.5), ("b", 0.25), ("b", 0.75)], "variant string, f1 double")
    assert L.stored_metric(table, "f1", variant="a").first().f1 == 0.5
    for variant in ("b", "c"):
        with pytest.raises(Exception, match="not one row"):
            L.stored_metric(table, "f1", variant=variant).collect()


def test_a_session_without_a_shared_folder_fails():
    with pytest.raises(ValueError, match="shared by all executors"):
        scratch_path(SimpleNamespace(conf={}), "x")

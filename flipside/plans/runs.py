"""The investigations end to end: corpus and split files in, result tables and ledgers out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flipside.functions.surface import LENGTH_EDGES
from flipside.operators import audit as A
from flipside.operators.compare import closest_to_contract, in_tolerance
from flipside.operators.features import text_vectors
from flipside.operators.metrics import confusion, f1, threshold_sweep
from flipside.operators.profile import surface_profile
from flipside.operators.splits import FrozenDecision, open_splits, require_coverage, split_balance, tag_split
from flipside.plans import decision, normalization, probes, quality, shortcuts
from flipside.plans.scoring import logistic_scorer, variant_terms
from flipside.plans.variants import BASELINE, NORMALIZATION_VARIANTS, STRIP_URLS
from flipside.session import materialize
from flipside.sources import ledger as L
from flipside.sources.corpus import read_contract, read_corpus, read_splits

TICKETS = {
    "baseline": ("ticket-1-baseline", "tfidf_logreg_baseline"),
    "freeze": ("ticket-2-normalization", "tfidf_logreg_stripurls"),
    "decision": ("ticket-4-decision", "tfidf_logreg_stripurls_c3_tuned"),
}

REVIEW_SCHEMA = "id bigint, verdict string, new_label int"


@dataclass(frozen=True)
class Workspace:
    """Where an investigation reads and writes. Tables are parquet unless ``table_format`` is
    "csv"; the two ledgers are parquet, partitioned by ticket."""

    spark: SparkSession
    corpus_path: str
    splits_path: str
    output: str
    contract_path: str | None = None
    table_format: str = "parquet"

    def documents(self) -> DataFrame:
        rows = read_corpus(self.spark, self.corpus_path)
        splits = read_splits(self.spark, self.splits_path)
        require_coverage(rows, splits)
        return tag_split(rows, splits)

    def path(self, table: str) -> str:
        return f"{self.output}/{table}" + (".csv" if self.table_format == "csv" else "")

    def save(self, frame: DataFrame, table: str) -> None:
        L.write_table(frame, self.path(table))

    @property
    def predictions(self) -> str:
        return f"{self.output}/heldout_predictions"

    @property
    def summary(self) -> str:
        return f"{self.output}/summary"

    def load(self, table: str, schema: T.StructType | str) -> DataFrame:
        """A result table that an earlier step saved."""
        return L.read_table(self.spark, self.path(table), schema)

    def stored_block(self, step: str) -> DataFrame | None:
        """A ticket's predictions, or None when it has not been frozen here yet."""
        try:
            block = L.read_ledger(self.spark, self.predictions, L.PREDICTIONS_SCHEMA, TICKETS[step][0])
            return None if block.isEmpty() else block
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def freeze(self, frozen: FrozenDecision) -> FrozenDecision:
        """Record a decision, before anything is scored under it."""
        return L.record_decision(self.spark, self.summary, frozen)

    def record(
        self, block: DataFrame, baseline: DataFrame | None, dev_f1: DataFrame, frozen: FrozenDecision
    ) -> None:
        """Write both ledgers, replacing this ticket's earlier rows."""
        L.replace_in_ledger(block, self.predictions, frozen.ticket)
        written = L.read_ledger(self.spark, self.predictions, L.PREDICTIONS_SCHEMA, frozen.ticket)
        row = normalization.summary_row(written, baseline, dev_f1, frozen)
        L.replace_in_ledger(row, self.summary, frozen.ticket)


def _dev_f1(scores: DataFrame) -> DataFrame:
    return confusion(open_splits(scores, ["dev"])).select(f1().alias("dev_f1_target_1"))


def run_baseline(work: Workspace) -> None:
    documents = work.documents()
    work.save(split_balance(documents), "split_balance")
    scores, _ = logistic_scorer()(documents, [BASELINE])
    frozen = work.freeze(FrozenDecision(*TICKETS["baseline"], "adopt_plain_default", "plain default kept"))
    work.record(normalization.predictions_block(scores, frozen), None, _dev_f1(scores), frozen)


def run_probe(work: Workspace) -> None:
    if work.contract_path is None:
        raise ValueError("the probe compares with a contract file")
    settings = [*probes.ONE_FACTOR, *probes.grid_settings()]
    contract = read_contract(work.spark, work.contract_path)
    probed = materialize(probes.probe(work.documents(), settings, contract), "probe")
    work.save(probed, "ticket1_probe")
    work.save(in_tolerance(probed), "ticket1_in_tolerance")
    work.save(closest_to_contract(probed), "ticket1_closest")


def run_profile(work: Workspace) -> None:
    work.save(surface_profile(work.documents(), LENGTH_EDGES), "ticket2_profile")


def run_normalization(work: Workspace) -> None:
    documents = work.documents()
    scores, _ = logistic_scorer()(documents, NORMALIZATION_VARIANTS)
    reuse = lambda *_: (scores, None)
    work.save(normalization.normalization_sweep(documents, reuse), "ticket2_dev")
    work.save(normalization.normalization_examples(documents, reuse), "ticket2_examples")


def run_punctuation(work: Workspace) -> None:
    work.save(normalization.tokenizer_probe(work.documents(), logistic_scorer()), "ticket2_punct_probe")


def run_freeze(work: Workspace) -> None:
    """Adopt URL stripping: score held-out once, with the drift of the stored baseline block. The dev
    metric is the one the decision was made on, read back from the stored sweep."""
    documents = work.documents()
    scores, _ = logistic_scorer()(documents, [BASELINE, STRIP_URLS])
    frozen = work.freeze(FrozenDecision(*TICKETS["freeze"], "adopt_strip_urls", "strips URLs; chosen on dev"))
    plain = scores.filter(F.col("variant") == BASELINE.label)
    stripped = scores.filter(F.col("variant") == STRIP_URLS.label)
    baseline = open_splits(plain, ["heldout"], frozen)
    stored = work.stored_block("baseline")
    if stored is not None:
        work.save(L.ledger_drift(stored, baseline), "baseline_drift")
    dev_f1 = L.stored_metric(
        work.load("ticket2_dev", normalization.SWEEP_SCHEMA), "dev_f1_target_1", variant=STRIP_URLS.label
    )
    work.record(normalization.predictions_block(stripped, frozen), baseline, dev_f1, frozen)


def run_shortcuts(work: Workspace) -> None:
    documents = work.documents()
    tf, terms = variant_terms(documents, [BASELINE])
    text = text_vectors(tf, terms, documents, ["variant"])
    table, levels = shortcuts.shortcut_models(documents, text)
    work.save(table, "ticket3_shortcuts")
    work.save(levels, "ticket3_keyword_levels")


def run_decision(work: Workspace) -> None:
    """Candidates on dev, then the best strength with the best threshold on held-out, once."""
    documents = work.documents()
    fitted = (*decision.C_SWEEP, decision.BALANCED, decision.LINEAR_SVC, decision.SGD_LOGISTIC)
    linear = decision.linear_scores(documents, fitted)
    ticket, model_name = TICKETS["decision"]
    swept = decision.rounded(threshold_sweep(open_splits(linear.filter("label = 'C=1'"), ["dev"])))
    columns = ("threshold", "precision_target_1", "recall_target_1", "f1_target_1")
    work.save(swept.select(F.lit(ticket).alias("ticket"), *columns), "threshold_sweep")
    table, combo = decision.candidate_table(linear, decision.naive_bayes_scores(documents))
    table = materialize(table, "candidates")
    work.save(table, "ticket4_dev")
    frozen = work.freeze(decision.freeze_combo(ticket, model_name, table, combo))
    block = normalization.predictions_block(combo, frozen)
    dev_f1 = table.filter("group = 'combo'").select("dev_f1_target_1")
    work.record(block, work.stored_block("freeze"), dev_f1, frozen)


def run_audit(work: Workspace, reviews_path: str | None = None) -> None:
    """The unreviewed findings, and with a review table the reviewed ones and what it missed."""
    documents = work.documents()
    work.save(quality.audit(documents).orderBy("issue_type", "id"), "data_quality_audit")
    work.save(A.error_floor(A.text_groups(documents)), "error_floor")
    if reviews_path is None:
        return
    audit = work.load("data_quality_audit", A.AUDIT_SCHEMA)
    reviews = work.spark.read.schema(REVIEW_SCHEMA).csv(reviews_path, header=True)
    A.require_reviews_match(audit, reviews)
    reviewed = A.review_overlay(audit, reviews)
    work.save(reviewed, "data_quality_audit_reviewed")
    work.save(A.review_coverage(audit, reviews), "review_coverage")
    work.save(A.audit_summary(reviewed), "audit_summary")
    work.save(A.relabel_overlay(documents, reviewed), "relabelled")


STEPS = {
    "baseline": run_baseline,
    "probe": run_probe,
    "profile": run_profile,
    "normalization": run_normalization,
    "punctuation": run_punctuation,
    "freeze": run_freeze,
    "shortcuts": run_shortcuts,
    "decision": run_decision,
    "audit": run_audit,
}

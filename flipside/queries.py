"""Named queries over the fixture tables, one per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flipside.functions import normalize as N
from flipside.functions import patterns as P
from flipside.functions import surface as S
from flipside.functions.terms import term_counts, tokens, with_bigrams
from flipside.operators import audit as A
from flipside.operators import bayes as B
from flipside.operators import compare as C
from flipside.operators import features as X
from flipside.operators import hashing as H
from flipside.operators import metrics as M
from flipside.operators import profile
from flipside.operators import splits as SP
from flipside.plans import decision, normalization, probes, quality, shortcuts
from flipside.plans.scoring import bayes_scorer, logistic_scorer, out_of_fold_scores, variant_terms
from flipside.plans.variants import (
    BASELINE,
    NGRAM_VARIANTS,
    NORMALIZATION_VARIANTS,
    STRIP_URLS,
    TOKENIZER_VARIANTS,
)
from flipside.session import materialize, scratch_path, spread
from flipside.sources import corpus as R
from flipside.sources import ledger as L

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Parameters the fixtures need: their scores lie between 0.15 and 0.72.
CUT = 0.30
LOW_SCORE, HIGH_SCORE = 0.25, 0.30
# Ticket names as published.
TICKETS = ("ticket-1-baseline", "ticket-2-normalization")
WIDE_EDGES = (0, 500, 1000, 2000, 4000)
FIXTURE_ENTITIES = {"&copy;": "©", "&middot;": "·", "&quot;": '"', "&amp;": "&"}
VOCABULARY_VARIANTS = (BASELINE, STRIP_URLS, TOKENIZER_VARIANTS[1], NORMALIZATION_VARIANTS[6], NGRAM_VARIANTS[1])
CASE_VARIANT = NORMALIZATION_VARIANTS[6]


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    documents = R.labelled_documents(spark, folder)
    return SP.fit_split(documents).assign(documents)


def web_corpus(spark: SparkSession, folder: str) -> DataFrame:
    rule = SP.fit_split(R.labelled_documents(spark, folder))
    return rule.assign(R.labelled_web_documents(spark, folder))


def split_table(spark: SparkSession, folder: str) -> DataFrame:
    return corpus(spark, folder).select("id", "split", "pos")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/documents.parquet")
    return spread(rows, rows, "doc_id")


def pages(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/pages.parquet")
    return spread(rows, rows, "page_id")


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its page, labelled or not."""
    page = pages(spark, folder).select(
        F.col("page_id").alias("doc_id"), F.concat_ws(" ", "url", "html").alias("page")
    )
    joined = documents(spark, folder).join(page, "doc_id", "left")
    return joined.select(
        F.col("doc_id").alias("id"),
        F.concat_ws(" ", "text", "page").alias("text"),
        F.col("source").alias("location"),
    )


def scores(spark: SparkSession, folder: str) -> DataFrame:
    return bayes_scorer(CUT)(corpus(spark, folder), [BASELINE])[0].drop("variant")


def shown(column: str) -> Column:
    return F.round(column, 6).alias(column)


def contract_from(table: DataFrame, f1: Column) -> DataFrame:
    """A contract file whose F1 is taken from a one-row result table, read back."""
    path = scratch_path(table.sparkSession, "contract")
    table.select(
        F.lit("heldout_f1_target_1").alias("metric"),
        F.lit(0.0).alias("reference_floor_f1"),
        f1.alias("reference_baseline_f1"),
        F.lit(0.05).alias("tolerance"),
        F.lit("dev F1 of the untouched text").alias("notes"),
    ).coalesce(1).write.json(path)
    return R.read_contract(table.sparkSession, path)


# --- sources, sinks and ledgers ---------------------------------------------------------------


@query
def corpus_scan(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "corpus") + ".csv"
    rows = R.labelled_documents(spark, folder)
    L.write_table(rows.withColumn("keyword", F.when(F.col("keyword") == "es", "NA").otherwise(F.col("keyword"))), path)
    return R.read_corpus(spark, path)


def _blocks(spark: SparkSession, folder: str) -> tuple[str, DataFrame]:
    """A ledger with two tickets' held-out blocks, cut at 0.30 and 0.25, and the scores."""
    scored = scores(spark, folder)
    path = scratch_path(spark, "ledger")
    for ticket, cut in zip(TICKETS, (0.30, 0.25)):
        L.replace_in_ledger(_block(scored, ticket, cut), path, ticket)
    return path, scored


def _block(scored: DataFrame, ticket: str, cut: float) -> DataFrame:
    frozen = SP.FrozenDecision(ticket, f"bayes_{cut:g}", "fixture", "fixture", cut)
    return normalization.predictions_block(B.predict_at(scored, cut), frozen)


@query
def predictions_block(spark: SparkSession, folder: str) -> DataFrame:
    return _block(scores(spark, folder), TICKETS[0], CUT).withColumn("score", shown("score"))


@query
def ledger_replace(spark: SparkSession, folder: str) -> DataFrame:
    path, scored = _blocks(spark, folder)
    L.replace_in_ledger(_block(scored, TICKETS[0], 0.35), path, TICKETS[0])
    return L.read_ledger(spark, path, L.PREDICTIONS_SCHEMA).withColumn("score", shown("score"))


@query
def ledger_drift(spark: SparkSession, folder: str) -> DataFrame:
    path, scored = _blocks(spark, folder)
    stored = L.read_ledger(spark, path, L.PREDICTIONS_SCHEMA, TICKETS[0])
    return L.ledger_drift(stored, _block(scored, TICKETS[0], 0.35))


@query
def freeze_summary(spark: SparkSession, folder: str) -> DataFrame:
    variants = [BASELINE, CASE_VARIANT]
    scored, _ = bayes_scorer(CUT)(web_corpus(spark, folder), variants)
    path = scratch_path(spark, "ledger")
    first = SP.FrozenDecision(TICKETS[0], "bayes", "adopt_plain_default", "fixture", CUT)
    plain = scored.filter(F.col("variant") == BASELINE.label)
    L.replace_in_ledger(normalization.predictions_block(plain, first), path, TICKETS[0])

    second = SP.FrozenDecision(TICKETS[1], "bayes_case", "adopt_preserve_case", "best dev threshold")
    cased = scored.filter(F.col("variant") == CASE_VARIANT.label)
    best = M.best_row(M.threshold_sweep(SP.open_splits(cased, ["dev"])), "f1_target_1")
    tuned = normalization.predictions_block(decision.best_threshold_predictions(cased), second)
    L.replace_in_ledger(tuned, path, TICKETS[1])
    block = L.read_ledger(spark, path, L.PREDICTIONS_SCHEMA, TICKETS[1])
    stored = L.read_ledger(spark, path, L.PREDICTIONS_SCHEMA, TICKETS[0])
    dev_f1 = best.select(F.col("f1_target_1").alias("dev_f1_target_1"))
    return normalization.summary_row(block, stored, dev_f1, second)


@query
def stored_metric(spark: SparkSession, folder: str) -> DataFrame:
    """A freeze's dev metric, read back from the sweep that was stored when it was decided."""
    path = scratch_path(spark, "sweep")
    L.write_table(normalization.normalization_sweep(web_corpus(spark, folder), bayes_scorer(CUT, ["dev"])), path)
    stored = L.read_table(spark, path, normalization.SWEEP_SCHEMA)
    return L.stored_metric(stored, "dev_f1_target_1", variant=STRIP_URLS.label)


# --- splits -----------------------------------------------------------------------------------


@query
def stratified_split(spark: SparkSession, folder: str) -> DataFrame:
    return SP.stratified_split(R.labelled_documents(spark, folder)).select("id", "target", "pos", "split")


@query
def split_select(spark: SparkSession, folder: str) -> DataFrame:
    return SP.select_split(R.labelled_documents(spark, folder), split_table(spark, folder), "dev").select(
        "id", "split", "pos", "keyword", "location", "target"
    )


@query
def split_coverage(spark: SparkSession, folder: str) -> DataFrame:
    every = documents(spark, folder).select(F.col("doc_id").alias("id"))
    return SP.split_coverage(every, split_table(spark, folder))


@query
def split_balance(spark: SparkSession, folder: str) -> DataFrame:
    tagged = SP.tag_split(R.labelled_documents(spark, folder), split_table(spark, folder))
    return SP.split_balance(tagged)


# --- normalization ----------------------------------------------------------------------------


def _html(spark: SparkSession, folder: str, *steps: str) -> DataFrame:
    return pages(spark, folder).select("page_id", N.normalize(F.col("html"), *steps).alias("text"))


@query
def norm_strip_urls(spark: SparkSession, folder: str) -> DataFrame:
    return _html(spark, folder, "strip_urls")


@query
def norm_strip_mentions(spark: SparkSession, folder: str) -> DataFrame:
    return _html(spark, folder, "strip_mentions")


@query
def norm_strip_hashtag(spark: SparkSession, folder: str) -> DataFrame:
    text = N.normalize(F.col("url"), "strip_hashtag_symbol")
    return pages(spark, folder).select("page_id", text.alias("text"))


@query
def norm_unescape_html(spark: SparkSession, folder: str) -> DataFrame:
    return _html(spark, folder, "unescape_html")


@query
def norm_unescape_known(spark: SparkSession, folder: str) -> DataFrame:
    text = N.collapse_space(N.unescape_entities(F.col("html"), FIXTURE_ENTITIES))
    return pages(spark, folder).select("page_id", text.alias("text"))


@query
def norm_strip_emoji(spark: SparkSession, folder: str) -> DataFrame:
    with_emoji = F.replace(
        F.replace(F.col("text"), F.lit("qu"), F.lit("\U0001f600\U0001f680")), F.lit(","), F.lit("\u2600\u2764\u24c2")
    )
    return documents(spark, folder).select("doc_id", N.normalize(with_emoji, "strip_emoji").alias("text"))


@query
def norm_whitespace(spark: SparkSession, folder: str) -> DataFrame:
    odd_spaces = F.replace(
        F.replace(F.col("text"), F.lit(","), F.lit("\u00a0\u2003")), F.lit("."), F.lit("\x85 \x1c")
    )
    return documents(spark, folder).select("doc_id", N.collapse_space(odd_spaces).alias("text"))


@query
def norm_all(spark: SparkSession, folder: str) -> DataFrame:
    return _html(spark, folder, *N.STEP_ORDER)


@query
def norm_preserve_case_vocab(spark: SparkSession, folder: str) -> DataFrame:
    _, terms = variant_terms(corpus(spark, folder), [BASELINE, CASE_VARIANT])
    return X.vocabulary(terms).select("variant", "term", "df")


@query
def dedup_key(spark: SparkSession, folder: str) -> DataFrame:
    conversations = spark.read.parquet(f"{folder}/conversations.parquet")
    return conversations.select("conv_id", "turn", N.dedup_key(F.col("text")).alias("dedup_key"))


# --- surface features -------------------------------------------------------------------------


@query
def surface_flags(spark: SparkSession, folder: str) -> DataFrame:
    flags = S.surface_flags(F.col("text"))
    return texts(spark, folder).select("id", *[flag.alias(name) for name, flag in flags.items()])


@query
def length_bins(spark: SparkSession, folder: str) -> DataFrame:
    length = F.length("text")
    return documents(spark, folder).select(
        "doc_id",
        length.alias("char_len"),
        S.length_bin(length).alias("short_bin"),
        S.length_bin(length, WIDE_EDGES).alias("wide_bin"),
    )


@query
def shortcut_features(spark: SparkSession, folder: str) -> DataFrame:
    columns = S.shortcut_columns(F.col("text"), F.col("location"))
    columns["frac_upper"] = F.round(columns["frac_upper"], 6)
    return texts(spark, folder).select("id", *[c.alias(name) for name, c in columns.items()])


@query
def onehot_keyword(spark: SparkSession, folder: str) -> DataFrame:
    finer = corpus(spark, folder).withColumn("keyword", F.concat_ws("-", "keyword", "location"))
    return X.one_hot(finer).select("id", "split", "level")


@query
def surface_profile(spark: SparkSession, folder: str) -> DataFrame:
    return profile.surface_profile(web_corpus(spark, folder), S.LENGTH_EDGES)


@query
def surface_contrast(spark: SparkSession, folder: str) -> DataFrame:
    return profile.surface_contrast(surface_profile(spark, folder))


# --- terms and weights ------------------------------------------------------------------------


def _counts(spark: SparkSession, folder: str, words: Column) -> DataFrame:
    counted = documents(spark, folder).select("doc_id", F.inline_outer(term_counts(words)))
    return counted.filter(F.col("term").isNotNull())


@query
def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _counts(spark, folder, tokens(F.col("text")))


@query
def token_counts_punct(spark: SparkSession, folder: str) -> DataFrame:
    return _counts(spark, folder, tokens(F.col("text"), P.TOKEN_OR_PUNCTUATION))


@query
def ngram_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _counts(spark, folder, with_bigrams(tokens(F.col("text"))))


def _fitted(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = corpus(spark, folder)
    tf = X.term_frequencies(rows, tokens(F.col("text")))
    return rows, tf, X.fit_terms(tf)


@query
def vocab_min_df(spark: SparkSession, folder: str) -> DataFrame:
    return X.vocabulary(_fitted(spark, folder)[2], min_df=2).select("term", "df")


@query
def idf_table(spark: SparkSession, folder: str) -> DataFrame:
    rows, _, terms = _fitted(spark, folder)
    return X.idf_table(terms, rows).withColumn("idf", shown("idf"))


def _tfidf(spark: SparkSession, folder: str, split: str, sublinear: bool) -> DataFrame:
    rows, tf, terms = _fitted(spark, folder)
    weights = X.tfidf(tf.filter(F.col("split") == split), X.idf_table(terms, rows), terms, sublinear=sublinear)
    return weights.select("id", "term", "tf", shown("weight"))


@query
def tfidf_l2(spark: SparkSession, folder: str) -> DataFrame:
    return _tfidf(spark, folder, "train", False)


@query
def tfidf_sublinear(spark: SparkSession, folder: str) -> DataFrame:
    return _tfidf(spark, folder, "train", True)


@query
def tfidf_transform_dev(spark: SparkSession, folder: str) -> DataFrame:
    return _tfidf(spark, folder, "dev", False)


@query
def hashed_tfidf(spark: SparkSession, folder: str) -> DataFrame:
    cells = H.hashed_cells(corpus(spark, folder), tokens(F.col("text")))
    return H.hashed_tfidf(cells, H.bucket_idf(cells)).select("id", "split", "bucket", "tf", shown("weight"))


@query
def hash_collisions(spark: SparkSession, folder: str) -> DataFrame:
    return H.collisions(_fitted(spark, folder)[2])


@query
def vocab_size_by_variant(spark: SparkSession, folder: str) -> DataFrame:
    _, terms = variant_terms(web_corpus(spark, folder), VOCABULARY_VARIANTS)
    return normalization.vocabulary_sizes(terms)


# --- classifiers ------------------------------------------------------------------------------


@query
def nb_scores(spark: SparkSession, folder: str) -> DataFrame:
    return decision.naive_bayes_scores(corpus(spark, folder), BASELINE).withColumn("score", shown("score"))


@query
def balanced_weights(spark: SparkSession, folder: str) -> DataFrame:
    weights = B.balanced_weights(corpus(spark, folder))
    return weights.select("id", "target", shown("class_weight"))


@query
def majority_floor(spark: SparkSession, folder: str) -> DataFrame:
    return B.majority_floor(corpus(spark, folder))


@query
def top_weighted_terms(spark: SparkSession, folder: str) -> DataFrame:
    terms = _fitted(spark, folder)[2]
    return B.top_terms(B.token_log_odds(terms), "log_odds").withColumn("log_odds", shown("log_odds"))


@query
def lr_scores(spark: SparkSession, folder: str) -> DataFrame:
    return logistic_scorer()(corpus(spark, folder), [BASELINE])[0]


def _certified(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The strength sweep's models by their certificates, and the classes these vouch for."""
    return decision.certified_scores(corpus(spark, folder), decision.C_SWEEP, BASELINE)


@query
def lr_classes(spark: SparkSession, folder: str) -> DataFrame:
    return _certified(spark, folder)[1].select("label", "id", "split", "y_true", "y_pred", "certified")


@query
def fit_certificate(spark: SparkSession, folder: str) -> DataFrame:
    proofs, classes = _certified(spark, folder)
    return decision.certificate_table(proofs, classes).drop("epsilon", "delta")


@query
def c_sweep(spark: SparkSession, folder: str) -> DataFrame:
    scored = decision.linear_scores(corpus(spark, folder), decision.C_SWEEP, BASELINE)
    return decision.rounded(decision.candidate_quality(scored))


@query
def alt_classifiers(spark: SparkSession, folder: str) -> DataFrame:
    candidates = (decision.BALANCED, decision.LINEAR_SVC, decision.SGD_LOGISTIC)
    return decision.rounded(
        decision.candidate_quality(decision.linear_scores(corpus(spark, folder), candidates, BASELINE))
    )


@query
def shortcut_models(spark: SparkSession, folder: str) -> DataFrame:
    return _shortcuts(spark, folder)[0]


@query
def keyword_coefficients(spark: SparkSession, folder: str) -> DataFrame:
    return _shortcuts(spark, folder)[1]


def _shortcuts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = web_corpus(spark, folder)
    tf, terms = variant_terms(rows, [BASELINE])
    return shortcuts.shortcut_models(rows, X.text_vectors(tf, terms, rows, ["variant"]))


# --- metrics and comparison -------------------------------------------------------------------


@query
def confusion(spark: SparkSession, folder: str) -> DataFrame:
    return M.confusion(scores(spark, folder), ["split"])


@query
def prf_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return decision.rounded(M.prf(M.confusion(scores(spark, folder), ["split"]), ["split"]))


@query
def threshold_sweep(spark: SparkSession, folder: str) -> DataFrame:
    dev = SP.open_splits(scores(spark, folder), ["dev"])
    swept = decision.rounded(M.threshold_sweep(dev))
    return swept.select("threshold", "precision_target_1", "recall_target_1", "f1_target_1")


@query
def best_threshold(spark: SparkSession, folder: str) -> DataFrame:
    dev = SP.open_splits(scores(spark, folder), ["dev"])
    best = M.best_row(M.threshold_sweep(dev), "f1_target_1")
    return decision.rounded(best).select("threshold", "tp", "fp", "fn", "tn", "f1_target_1")


def _variant_flips(spark: SparkSession, folder: str) -> DataFrame:
    scored, _ = bayes_scorer(CUT)(web_corpus(spark, folder), NORMALIZATION_VARIANTS)
    return normalization.against_first(scored, BASELINE.label)


@query
def flip_counts(spark: SparkSession, folder: str) -> DataFrame:
    return C.flip_counts(_variant_flips(spark, folder), ["variant", "split"])


@query
def flip_examples(spark: SparkSession, folder: str) -> DataFrame:
    return normalization.normalization_examples(web_corpus(spark, folder), bayes_scorer(CUT, ["dev"]))


@query
def normalization_sweep(spark: SparkSession, folder: str) -> DataFrame:
    return normalization.normalization_sweep(web_corpus(spark, folder), bayes_scorer(CUT, ["dev"]))


@query
def normalization_sweep_lr(spark: SparkSession, folder: str) -> DataFrame:
    return normalization.normalization_sweep(web_corpus(spark, folder), logistic_scorer())


@query
def tokenizer_probe(spark: SparkSession, folder: str) -> DataFrame:
    return normalization.tokenizer_probe(web_corpus(spark, folder), bayes_scorer(CUT, ["dev"]))


@query
def param_grid(spark: SparkSession, folder: str) -> DataFrame:
    """The grid with what each combination means on this corpus: vocabulary size and penalty."""
    rows = corpus(spark, folder)
    _, terms = variant_terms(rows, NGRAM_VARIANTS)
    grid = C.param_grid(spark, probes.GRID_AXES)
    sizes = (
        terms.withColumnRenamed("variant", "ngrams")
        .join(F.broadcast(grid.select("ngrams", "min_df").distinct()), "ngrams")
        .groupBy("ngrams", "min_df")
        .agg(F.count_if(F.col("df") >= F.col("min_df")).alias("vocab_size"))
    )
    return (
        grid.join(F.broadcast(sizes), ["ngrams", "min_df"])
        .crossJoin(F.broadcast(X.train_size(rows)))
        .select(
            "position", F.col("min_df").cast("bigint").alias("min_df"), "sublinear_tf", "ngrams", "c", "vocab_size",
            F.round(1 / (F.col("c") * F.col("n_train")), 8).alias("reg_param"),
        )
    )


def _gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Held-out F1 of every normalization variant against the baseline's dev F1."""
    scored, _ = bayes_scorer(CUT, ["dev", "heldout"])(web_corpus(spark, folder), NORMALIZATION_VARIANTS)
    judged = SP.open_splits(scored, ["dev", "heldout"], diagnostic=True)
    quality_table = M.prf(M.confusion(judged, ["variant", "split"]), ["variant", "split"])
    heldout = quality_table.filter("split = 'heldout'").select(
        F.col("variant").alias("label"), F.col("f1_target_1").alias("heldout_f1_target_1")
    )
    reference = quality_table.filter((F.col("split") == "dev") & (F.col("variant") == BASELINE.label))
    contract = contract_from(reference, F.col("f1_target_1"))
    order = [(i, v.label) for i, v in enumerate(NORMALIZATION_VARIANTS)]
    placed = heldout.join(spark.createDataFrame(order, "position bigint, label string"), "label")
    gaps = C.contract_gap(placed, contract)
    return gaps.withColumn("heldout_f1_target_1", F.round("heldout_f1_target_1", 4))


@query
def contract_gap(spark: SparkSession, folder: str) -> DataFrame:
    return _gaps(spark, folder)


@query
def in_tolerance(spark: SparkSession, folder: str) -> DataFrame:
    return C.in_tolerance(_gaps(spark, folder))


@query
def contract_closest(spark: SparkSession, folder: str) -> DataFrame:
    return C.closest_to_contract(_gaps(spark, folder))


def _contract(rows: DataFrame) -> DataFrame:
    """A contract for the fitted probes: the share of positives among held-out rows."""
    heldout = rows.filter("split = 'heldout'").agg(F.avg("target").alias("rate"))
    return contract_from(heldout, F.col("rate"))


@query
def one_factor_probe(spark: SparkSession, folder: str) -> DataFrame:
    rows = corpus(spark, folder)
    return probes.probe(rows, probes.ONE_FACTOR, _contract(rows))


@query
def grid_probe(spark: SparkSession, folder: str) -> DataFrame:
    rows = corpus(spark, folder)
    return probes.probe(rows, probes.grid_settings(), _contract(rows))


def _candidates(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = web_corpus(spark, folder)
    fitted = (*decision.C_SWEEP, decision.BALANCED, decision.LINEAR_SVC, decision.SGD_LOGISTIC)
    linear = decision.linear_scores(rows, fitted)
    bayes = materialize(decision.naive_bayes_scores(rows), "scores")
    return linear, *decision.candidate_table(linear, bayes)


@query
def candidate_table(spark: SparkSession, folder: str) -> DataFrame:
    return _candidates(spark, folder)[1]


@query
def freeze_combo(spark: SparkSession, folder: str) -> DataFrame:
    linear, table, combo = _candidates(spark, folder)
    frozen = decision.freeze_combo("ticket-4-decision", "tfidf_logreg_stripurls_tuned", table, combo)
    stored = SP.FrozenDecision(TICKETS[1], "tfidf_logreg_stripurls", "adopt_strip_urls", "fixture")
    baseline = normalization.predictions_block(linear.filter("label = 'C=1'"), stored)
    block = normalization.predictions_block(combo, frozen)
    dev_f1 = table.filter("group = 'combo'").select("dev_f1_target_1")
    return normalization.summary_row(block, baseline, dev_f1, frozen)


# --- label quality ----------------------------------------------------------------------------


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return quality.document_lines(corpus(spark, folder))


def _mislabels(spark: SparkSession, folder: str) -> DataFrame:
    rows = corpus(spark, folder)
    scored = quality.with_keyword(bayes_scorer(CUT)(rows, [BASELINE])[0], rows)
    return A.likely_mislabels(scored, LOW_SCORE, HIGH_SCORE, 0.20, 0.40, "NB")


def _conflicts(spark: SparkSession, folder: str) -> DataFrame:
    return A.conflict_members(_lines(spark, folder))


def _audit(spark: SparkSession, folder: str) -> DataFrame:
    return A.audit_table(A.duplicate_conflicts(_conflicts(spark, folder)), _mislabels(spark, folder))


def _reviews(spark: SparkSession, folder: str) -> DataFrame:
    """A verdict by language for every labelled document that is not Spanish."""
    verdict = F.when(F.col("keyword") == "en", "fix").when(F.col("keyword") == "fr", "ambiguous")
    return (
        R.labelled_documents(spark, folder)
        .filter(F.col("keyword") != "es")
        .select("id", verdict.otherwise("reject_false_positive").alias("verdict"), (1 - F.col("target")).alias("new_label"))
    )


@query
def dup_label_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    return A.duplicate_conflicts(_conflicts(spark, folder))


@query
def dup_group_members(spark: SparkSession, folder: str) -> DataFrame:
    return A.group_members(_conflicts(spark, folder))


@query
def likely_mislabels(spark: SparkSession, folder: str) -> DataFrame:
    return _mislabels(spark, folder)


@query
def likely_mislabels_lr(spark: SparkSession, folder: str) -> DataFrame:
    return quality.audit(web_corpus(spark, folder))


@query
def likely_mislabels_oof(spark: SparkSession, folder: str) -> DataFrame:
    rows = corpus(spark, folder)
    scored = quality.with_keyword(out_of_fold_scores(rows, BASELINE, CUT), rows)
    return A.likely_mislabels(scored, LOW_SCORE, HIGH_SCORE, 0.20, 0.40, "NB out of fold")


@query
def oof_scores(spark: SparkSession, folder: str) -> DataFrame:
    return out_of_fold_scores(corpus(spark, folder), BASELINE, CUT).withColumn("score", shown("score"))


@query
def oof_classes(spark: SparkSession, folder: str) -> DataFrame:
    scored = decision.out_of_fold_classes(corpus(spark, folder), quality.AUDIT_MODEL, BASELINE)
    return scored.select("fold", "id", "split", "y_true", "y_pred", "certified")


@query
def audit_table(spark: SparkSession, folder: str) -> DataFrame:
    return _audit(spark, folder)


@query
def audit_summary(spark: SparkSession, folder: str) -> DataFrame:
    return A.audit_summary(_audit(spark, folder))


@query
def review_overlay(spark: SparkSession, folder: str) -> DataFrame:
    return A.review_overlay(_audit(spark, folder), _reviews(spark, folder))


@query
def review_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return A.review_coverage(_mislabels(spark, folder), _reviews(spark, folder))


@query
def label_error_floor(spark: SparkSession, folder: str) -> DataFrame:
    return A.error_floor(_lines(spark, folder))


@query
def relabel_overlay(spark: SparkSession, folder: str) -> DataFrame:
    return A.relabel_overlay(corpus(spark, folder), A.duplicate_conflicts(_conflicts(spark, folder)))

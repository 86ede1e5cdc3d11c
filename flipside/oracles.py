"""DuckDB SQL for the named queries, written from the operators' definitions.

Of the queries fitted by an iterative optimizer, those have an entry whose results are the same for any solver
that comes close enough: the classes that a certificate vouches for.
"""

from __future__ import annotations

W = r"[\p{L}\p{N}_]"
SPACE = r"[\t-\r\x1c-\x1f\x{85}\p{Z}]"
NOT_SPACE = r"[^\t-\r\x1c-\x1f\x{85}\p{Z}]"
URL = f"https?://{NOT_SPACE}+|www\\.{NOT_SPACE}+"
EMOJI = (
    r"[\x{1F300}-\x{1F5FF}\x{1F600}-\x{1F64F}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}"
    r"\x{1F900}-\x{1F9FF}\x{1FA70}-\x{1FAFF}\x{2600}-\x{26FF}\x{2700}-\x{27BF}]"
)
UPPER = r"[\p{Lu}\x{2160}-\x{216F}\x{24B6}-\x{24CF}\x{1F130}-\x{1F149}\x{1F150}-\x{1F169}\x{1F170}-\x{1F189}]"
CUT = "0.3"


def urls(t: str) -> str:
    return f"regexp_replace({t}, '{URL}', ' ', 'g')"


def mentions(t: str) -> str:
    return f"regexp_replace({t}, '@{W}+', ' ', 'g')"


def hashtags(t: str) -> str:
    return f"regexp_replace({t}, '#({W}+)', '\\1', 'g')"


def emoji(t: str) -> str:
    return f"regexp_replace({t}, '{EMOJI}+', ' ', 'g')"


def entities(t: str) -> str:
    return (
        f"replace(replace(replace(replace({t}, '&copy;', '©'), '&middot;', '·'), "
        f"'&quot;', '\"'), '&amp;', '&')"
    )


def collapse(t: str) -> str:
    return f"trim(regexp_replace({t}, '{SPACE}+', ' ', 'g'))"


def words(t: str, pattern: str = f"{W}{{2,}}") -> str:
    return f"regexp_extract_all({t}, '{pattern}')"


LABELLED = """
labelled AS (
  SELECT d.doc_id AS id, d.lang AS keyword, d.source AS location, d.text AS text,
         CAST(1 - l.quality AS INTEGER) AS target
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id
)"""

WEB_LABELLED = """
labelled AS (
  SELECT d.doc_id AS id, d.lang AS keyword, d.source AS location,
         concat_ws(' ', d.text, p.url, p.html) AS text,
         CAST(1 - l.quality AS INTEGER) AS target
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id LEFT JOIN pages p ON p.page_id = d.doc_id
)"""

SPLIT = """,
ranked AS (
  SELECT *, md5('3102:' || CAST(id AS VARCHAR)) AS pos,
         row_number() OVER (PARTITION BY target ORDER BY md5('3102:' || CAST(id AS VARCHAR)), id) AS rn,
         count(*) OVER (PARTITION BY target) AS n_class
  FROM labelled
),
docs AS (
  SELECT id, keyword, location, text, target, pos,
         CASE WHEN rn * 10 <= n_class * 6 THEN 'train'
              WHEN rn * 10 <= n_class * 8 THEN 'dev' ELSE 'heldout' END AS split
  FROM ranked
)"""

DOCS = "WITH " + LABELLED + SPLIT
WEB_DOCS = "WITH " + WEB_LABELLED + SPLIT

PLAIN = {"baseline_no_cleaning": words("lower(text)")}
NORMALIZED = {
    "baseline_no_cleaning": words("lower(text)"),
    "strip_urls": words(f"lower({collapse(urls('text'))})"),
    "strip_mentions": words(f"lower({collapse(mentions('text'))})"),
    "strip_hashtag_symbol": words(f"lower({collapse(hashtags('text'))})"),
    "unescape_html": words(f"lower({collapse(entities('text'))})"),
    "strip_emoji": words(f"lower({collapse(emoji('text'))})"),
    "preserve_case": words("text"),
}
CASED = {k: NORMALIZED[k] for k in ("baseline_no_cleaning", "preserve_case")}
PUNCTUATED = words(f"lower({collapse(urls('text'))})", f"{W}{{2,}}|[!?]")
TOKENIZERS = {"default_tokenizer": NORMALIZED["strip_urls"], "punct_preserving_tokenizer": PUNCTUATED}
NGRAMS = {
    "1-1": words("lower(text)"),
    "1-2": f"list_concat({words('lower(text)')}, list_transform(range(1, len({words('lower(text)')})), "
    f"lambda i: {words('lower(text)')}[i] || ' ' || {words('lower(text)')}[i + 1]))",
}


def token_rows(variants: dict[str, str], source: str = "docs") -> str:
    parts = [
        f"SELECT '{label}' AS variant, id, target, split, unnest({expression}) AS term FROM {source}"
        for label, expression in variants.items()
    ]
    return ",\ntf AS (SELECT variant, id, target, split, term, count(*) AS tf FROM (\n" + "\nUNION ALL\n".join(
        parts
    ) + "\n) GROUP BY ALL)"


def odds() -> str:
    return """,
mass AS (
  SELECT variant, term, sum(CASE WHEN target = 1 THEN tf ELSE 0 END) AS c1,
         sum(CASE WHEN target = 0 THEN tf ELSE 0 END) AS c0
  FROM tf WHERE split = 'train' GROUP BY ALL
),
totals AS (SELECT variant, sum(c1) AS n1, sum(c0) AS n0, count(*) AS v FROM mass GROUP BY ALL),
odds AS (
  SELECT variant, term, ln((c1 + 1.0::DOUBLE) / (n1 + v)) - ln((c0 + 1.0::DOUBLE) / (n0 + v)) AS lo
  FROM mass JOIN totals USING (variant)
)"""


def scored(variants: dict[str, str], web: bool = False) -> str:
    labels = ", ".join(f"'{v}'" for v in variants)
    return (
        (WEB_DOCS if web else DOCS)
        + token_rows(variants)
        + odds()
        + f""",
means AS (
  SELECT variant, id, sum(tf * lo) / sum(tf) AS m FROM tf JOIN odds USING (variant, term) GROUP BY ALL
),
scores AS (
  SELECT v.variant, d.id, d.split, d.pos, d.keyword, d.target AS y_true,
         1 / (1 + exp(-coalesce(m.m, 0))) AS score,
         CAST(1 / (1 + exp(-coalesce(m.m, 0))) >= {CUT} AS INTEGER) AS y_pred
  FROM docs d CROSS JOIN (SELECT unnest([{labels}]) AS variant) v
  LEFT JOIN means m ON m.variant = v.variant AND m.id = d.id
)"""
    )


CONFUSION = """count(*) FILTER (WHERE y_true = 1 AND y_pred = 1) AS tp, count(*) FILTER (WHERE y_true = 0 AND y_pred = 1) AS fp,
  count(*) FILTER (WHERE y_true = 1 AND y_pred = 0) AS fn, count(*) FILTER (WHERE y_true = 0 AND y_pred = 0) AS tn"""
PRECISION = "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END"
RECALL = "CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END"
F1 = "CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END"
ACCURACY = "(tp + tn) / (tp + fp + fn + tn)"

SWEEP = f""",
grid AS (SELECT k / 100 AS threshold FROM range(20, 71, 5) r(k)),
swept AS (
  SELECT threshold, {CONFUSION.replace('y_pred = 1', 'score >= threshold').replace('y_pred = 0', 'score < threshold')}
  FROM chosen CROSS JOIN grid GROUP BY threshold
),
best AS (SELECT *, round({F1}, 4) AS f1 FROM swept ORDER BY round({F1}, 4) DESC, threshold LIMIT 1)"""

FLIPPED = """,
flipped AS (
  SELECT s.variant, s.split, s.id, s.pos, s.y_true, b.y_pred AS baseline_pred, s.y_pred AS variant_pred,
         CASE WHEN b.y_pred = s.y_pred THEN NULL
              WHEN s.y_true = 0 AND s.y_pred = 0 THEN 'fixed_fp' WHEN s.y_true = 1 AND s.y_pred = 1 THEN 'fixed_fn'
              WHEN s.y_true = 0 THEN 'new_fp' ELSE 'new_fn' END AS flip_type
  FROM scores s JOIN scores b ON b.id = s.id AND b.variant = '%s'
)"""
FLIP_COUNTS = """count(*) FILTER (WHERE flip_type = 'fixed_fp') AS fixed_fp, count(*) FILTER (WHERE flip_type = 'fixed_fn') AS fixed_fn,
  count(*) FILTER (WHERE flip_type = 'new_fp') AS new_fp, count(*) FILTER (WHERE flip_type = 'new_fn') AS new_fn"""
NET = """count(*) FILTER (WHERE flip_type IN ('fixed_fp', 'fixed_fn')) - count(*) FILTER (WHERE flip_type IN ('new_fp', 'new_fn')) AS net_flips"""


def variant_rows(variants: dict[str, tuple[str, bool]]) -> str:
    rows = ", ".join(f"({i}, '{v}', '{s}', {str(c).lower()})" for i, (v, (s, c)) in enumerate(variants.items()))
    return f"(VALUES {rows}) v(position, variant, normalize_steps, preserve_case)"


STEPS = {v: ("" if v in ("baseline_no_cleaning", "preserve_case") else v, v == "preserve_case") for v in NORMALIZED}

LINES = f""",
lines AS (
  SELECT DISTINCT id, target, split, {collapse('lower(line)')} AS k
  FROM (SELECT id, target, split, unnest(string_split(text, chr(10))) AS line FROM docs)
),
conflicts AS (
  SELECT k, count(*) AS n, count(*) FILTER (WHERE target = 1) AS n_pos, count(*) FILTER (WHERE target = 0) AS n_neg,
         'dup group key=' || upper(sha256(k)) || ' rows=' || count(*) || ' positives=' || count(*) FILTER (WHERE target = 1)
           || ' text=''' || substr(k, 1, 80) || CASE WHEN length(k) > 80 THEN '...' ELSE '' END || '''' AS evidence
  FROM lines WHERE k <> '' GROUP BY k HAVING min(target) <> max(target)
),
dups AS (
  SELECT l.id, 'duplicate_label_conflict' AS issue_type, evidence,
         l.target AS original_label,
         CASE WHEN l.split = 'heldout' OR n_pos = n_neg THEN NULL ELSE CAST(n_pos > n_neg AS INTEGER) END AS proposed_label,
         CASE WHEN l.split = 'heldout' THEN 'keep_but_flag' WHEN n_pos = n_neg THEN 'ambiguous' ELSE 'fix' END AS disposition,
         CASE WHEN n_pos = n_neg THEN 'low' ELSE 'high' END AS confidence
  FROM lines l JOIN conflicts USING (k)
)"""

MISLABELS = """,
mislabels AS (
  SELECT id, 'likely_mislabel' AS issue_type,
         printf('NB label=%d but p(target=1)=%.4f %s, keyword=%s, split=%s', y_true, score,
                CASE WHEN y_true = 0 THEN '> 0.3' ELSE '< 0.25' END, coalesce(keyword, '(none)'), split) AS evidence,
         y_true AS original_label, CAST(NULL AS INTEGER) AS proposed_label, 'keep_but_flag' AS disposition,
         CASE WHEN score > 0.4 OR score < 0.2 THEN 'high' ELSE 'medium' END AS confidence
  FROM scores WHERE split <> 'heldout' AND ((y_true = 0 AND score > 0.3) OR (y_true = 1 AND score < 0.25))
)"""
AUDIT = scored(PLAIN) + LINES + MISLABELS + ",\naudit AS (SELECT * FROM dups UNION ALL SELECT * FROM mislabels)"
REVIEWS = """,
reviews AS (
  SELECT id, CASE keyword WHEN 'en' THEN 'fix' WHEN 'fr' THEN 'ambiguous' ELSE 'reject_false_positive' END AS verdict,
         1 - target AS new_label
  FROM labelled WHERE keyword <> 'es'
)"""

TEXTS = """WITH texts AS (
  SELECT d.doc_id AS id, concat_ws(' ', d.text, p.url, p.html) AS text, d.source AS location
  FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id
)"""

FLAGS = {
    "has_url": f"regexp_matches(text, '{URL}')",
    "has_mention": f"regexp_matches(text, '@{W}+')",
    "has_hashtag": f"regexp_matches(text, '#{W}+')",
    "has_emoji": f"regexp_matches(text, '{EMOJI}')",
    "has_exclamation": "contains(text, '!')",
    "has_allcaps_word": r"regexp_matches(text, '(^|[^\p{L}\p{N}_])[A-Z]{2,}($|[^\p{L}\p{N}_])')",
    "has_digit": r"regexp_matches(text, '\p{Nd}')",
}
FLAG_COLUMNS = ", ".join(f"{expression} AS {name}" for name, expression in FLAGS.items())
SHORT_BIN = """CASE WHEN length(text) <= 40 THEN '0-40' WHEN length(text) <= 80 THEN '41-80'
  WHEN length(text) <= 120 THEN '81-120' WHEN length(text) <= 160 THEN '121-160' END"""
WIDE_BIN = """CASE WHEN length(text) <= 500 THEN '0-500' WHEN length(text) <= 1000 THEN '501-1000'
  WHEN length(text) <= 2000 THEN '1001-2000' WHEN length(text) <= 4000 THEN '2001-4000' END"""

PROFILE = (
    WEB_DOCS
    + f""",
flags AS (SELECT target, {FLAG_COLUMNS}, {SHORT_BIN} AS bin FROM docs),
members AS (
  SELECT 'overall' AS feature, 'all' AS "group", target FROM flags
"""
    + "".join(
        f"  UNION ALL SELECT '{name}', CASE WHEN {name} THEN 'present' ELSE 'absent' END, target FROM flags\n"
        for name in FLAGS
    )
    + """  UNION ALL SELECT 'char_len_bin', bin, target FROM flags WHERE bin IS NOT NULL
),
slots AS (
  SELECT 'overall' AS feature, 'all' AS "group"
"""
    + "".join(
        f"  UNION ALL SELECT '{name}', 'present' UNION ALL SELECT '{name}', 'absent'\n" for name in FLAGS
    )
    + """  UNION ALL SELECT 'char_len_bin', unnest(['0-40', '41-80', '81-120', '121-160'])
),
counted AS (SELECT feature, "group", count(*) AS n, avg(target) AS rate FROM members GROUP BY ALL),
whole AS (SELECT count(*) AS n_all, avg(target) AS rate_all FROM flags),
profile AS (
  SELECT feature, "group", coalesce(n, 0) AS n, round(100.0 * coalesce(n, 0) / n_all, 2) AS pct_of_total,
         round(rate, 4) AS pos_rate, round(rate - rate_all, 4) AS pos_rate_vs_overall
  FROM slots LEFT JOIN counted USING (feature, "group") CROSS JOIN whole
)"""
)

COUNTED_TERMS = """SELECT doc_id, term, count(*) AS tf FROM (
  SELECT doc_id, unnest({words}) AS term FROM documents) GROUP BY ALL"""

WEIGHTS = (
    DOCS
    + token_rows(PLAIN)
    + """,
size AS (SELECT count(*) AS n FROM docs WHERE split = 'train'),
idf AS (
  SELECT term, count(*) AS df, ln((1 + any_value(n)) / (1 + count(*))) + 1 AS idf
  FROM tf CROSS JOIN size WHERE split = 'train' GROUP BY term
),
raw AS (SELECT id, target, split, term, tf, %s * idf AS x FROM tf JOIN idf USING (term)),
weights AS (SELECT id, target, split, term, tf, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS weight FROM raw)"""
)


def weights(split: str, sublinear: bool = False) -> str:
    value = "(1 + ln(tf))" if sublinear else "tf"
    return WEIGHTS % value + (
        f" SELECT id, term, tf, round(weight, 6) AS weight FROM weights WHERE split = '{split}'"
    )


def hashed(source: str) -> str:
    """Bucket and sign of the terms of ``source``, by the digits of their md5."""
    return f"""hashed AS (
  SELECT *, CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) % 65536 AS bucket,
         CASE WHEN contains('13579bdf', substr(md5(term), 9, 1)) THEN 1 ELSE 0 END AS negative
  FROM {source}
)"""


HASHED_WEIGHTS = (
    DOCS
    + token_rows(PLAIN)
    + ",\n"
    + hashed("tf")
    + """,
cells AS (
  SELECT id, split, bucket, CAST(sum(CASE WHEN negative = 1 THEN -tf ELSE tf END) AS BIGINT) AS tf
  FROM hashed GROUP BY ALL HAVING sum(CASE WHEN negative = 1 THEN -tf ELSE tf END) <> 0
),
size AS (SELECT count(*) AS n FROM docs WHERE split = 'train'),
idf AS (
  SELECT bucket, ln((1 + any_value(n)) / (1 + count(*))) + 1 AS idf
  FROM cells CROSS JOIN size WHERE split = 'train' GROUP BY bucket
)
SELECT id, split, bucket, tf, round(tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY id)), 6) AS weight
FROM cells JOIN idf USING (bucket)"""
)


def block(ticket: str, cut: str) -> str:
    return f"""SELECT id, y_true, CAST(score >= {cut} AS INTEGER) AS y_pred, round(score, 6) AS score,
  'bayes_{cut}' AS model_name, '{ticket}' AS ticket FROM scores WHERE split = 'heldout'"""


def sweep_rows(variants: dict, baseline: str) -> str:
    return (
        FLIPPED % baseline
        + f""",
quality AS (
  SELECT variant, round({F1}, 4) AS dev_f1_target_1
  FROM (SELECT variant, {CONFUSION} FROM scores WHERE split = 'dev' GROUP BY variant)
),
changed AS (SELECT variant, {FLIP_COUNTS}, {NET} FROM flipped WHERE split = 'dev' GROUP BY variant)"""
    )


GAPS = (
    scored(NORMALIZED, web=True)
    + f""",
quality AS (
  SELECT variant, split, {F1} AS f1 FROM (SELECT variant, split, {CONFUSION} FROM scores GROUP BY ALL)
),
gaps AS (
  SELECT v.position, h.variant AS label, round(h.f1, 4) AS heldout_f1_target_1,
         round(h.f1 - b.f1, 4) AS heldout_gap_vs_reference, abs(h.f1 - b.f1) <= 0.05 AS within_tolerance
  FROM quality h JOIN {variant_rows(STEPS)} USING (variant)
  CROSS JOIN (SELECT f1 FROM quality WHERE variant = 'baseline_no_cleaning' AND split = 'dev') b
  WHERE h.split = 'heldout'
)"""
)

# The optimum of each regularised logistic regression, found without pyspark.ml: accelerated gradient steps in the
# space spanned by the training rows, on their inner products. Steps are safe for rows of unit length.
OPTIMA = (
    WEIGHTS % "tf"
    + """,
train AS (SELECT id, target, row_number() OVER (ORDER BY id) AS i FROM docs WHERE split = 'train'),
pairs AS (
  SELECT a.id, t.i, sum(a.weight * b.weight) AS k
  FROM weights a JOIN weights b USING (term) JOIN train t ON t.id = b.id GROUP BY a.id, t.i
),
kernel AS (
  SELECT d.id, list(coalesce(k, 0.0::DOUBLE) ORDER BY t.i) AS k
  FROM docs d CROSS JOIN train t LEFT JOIN pairs p ON p.id = d.id AND p.i = t.i GROUP BY d.id
),
settings AS (
  SELECT position, label, 1 / (c * n) AS ridge, n, 1.9::DOUBLE AS eta
  FROM (VALUES (0, 'C=0.3', 0.3::DOUBLE), (1, 'C=1', 1.0), (2, 'C=3', 3.0), (3, 'C=10', 10.0), (4, 'C=30', 30.0)) v(position, label, c)
  CROSS JOIN (SELECT count(*) AS n FROM train)
),
solve AS (
  SELECT label, ridge, eta, n, (1 - sqrt(ridge * eta)) / (1 + sqrt(ridge * eta)) AS beta, 0 AS step,
         list_transform(range(n), lambda j: 0.0::DOUBLE) AS a0, list_transform(range(n), lambda j: 0.0::DOUBLE) AS a,
         0.0::DOUBLE AS b0, 0.0::DOUBLE AS b
  FROM settings
  UNION ALL
  SELECT label, ridge, eta, n, beta, step + 1, any_value(a), list(y[i] - eta * (miss / n + ridge * y[i]) ORDER BY i),
         any_value(b), any_value(yb) - any_value(eta) * avg(miss)
  FROM (
    SELECT s.*, t.i, 1 / (1 + exp(-(list_dot_product(k.k, s.y) + s.yb))) - t.target AS miss
    FROM (
      SELECT *, list_transform(list_zip(a, a0), lambda p: p[1] + beta * (p[1] - p[2])) AS y, b + beta * (b - b0) AS yb
      FROM solve WHERE step < 1500
    ) s CROSS JOIN train t JOIN kernel k ON k.id = t.id
  )
  GROUP BY label, ridge, eta, n, beta, step
),
classes AS (
  SELECT s.label, d.id, d.split, d.target AS y_true, CAST(list_dot_product(k.k, s.a) + s.b > 0 AS INTEGER) AS y_pred
  FROM solve s CROSS JOIN docs d JOIN kernel k ON k.id = d.id WHERE s.step = 1500
)"""
).replace("WITH", "WITH RECURSIVE", 1)

FOLD = "CAST(CAST('0x' || substr(md5('fold:' || CAST(id AS VARCHAR)), 1, 6) AS BIGINT) % 5 AS INTEGER)"
FOLD_DOCS = f""",
folded AS (SELECT *, CASE WHEN split = 'train' THEN {FOLD} ELSE -1 END AS fold FROM docs)"""

# Each fold's model is counted anew from the rows of train outside the fold.
OUT_OF_FOLD = (
    DOCS
    + token_rows(PLAIN)
    + FOLD_DOCS
    + """,
mass AS (
  SELECT m.fold, term, sum(CASE WHEN tf.target = 1 THEN tf ELSE 0 END) AS c1, sum(CASE WHEN tf.target = 0 THEN tf ELSE 0 END) AS c0
  FROM tf JOIN folded f USING (id) JOIN (SELECT DISTINCT fold FROM folded) m ON m.fold <> f.fold
  WHERE f.split = 'train' GROUP BY m.fold, term
),
totals AS (SELECT fold, sum(c1) AS n1, sum(c0) AS n0, count(*) AS v FROM mass GROUP BY fold),
odds AS (
  SELECT fold, term, ln((c1 + 1.0::DOUBLE) / (n1 + v)) - ln((c0 + 1.0::DOUBLE) / (n0 + v)) AS lo FROM mass JOIN totals USING (fold)
),
means AS (
  SELECT f.id, sum(tf * lo) / sum(tf) AS m FROM folded f JOIN tf ON tf.id = f.id JOIN odds o ON o.fold = f.fold AND o.term = tf.term GROUP BY f.id
),
scores AS (
  SELECT f.fold, f.id, f.split, f.keyword, f.target AS y_true, 1 / (1 + exp(-coalesce(m, 0))) AS score
  FROM folded f LEFT JOIN means USING (id)
)"""
)
# One setting per model: that of all folds, and that without each fold.
FOLD_OPTIMA = (
    OPTIMA.replace(
        "train AS (SELECT id, target, row_number() OVER (ORDER BY id) AS i FROM docs WHERE split = 'train')",
        FOLD_DOCS.lstrip(",") + ",\ntrain AS (SELECT id, target, fold, row_number() OVER (ORDER BY id) AS i FROM folded WHERE split = 'train')",
    )
    .replace(OPTIMA[OPTIMA.index("  SELECT position, label, 1 / (c * n)") : OPTIMA.index("),\nsolve AS")], """  SELECT m.fold AS label, 1 / (3.0::DOUBLE * count(*)) AS ridge, count(*) AS n, 1.9::DOUBLE AS eta, (SELECT count(*) FROM train) AS size
  FROM (SELECT DISTINCT fold FROM folded) m JOIN train t ON t.fold <> m.fold GROUP BY m.fold
""")
    .replace("SELECT label, ridge, eta, n,", "SELECT label, ridge, eta, n, size,")
    .replace("range(n)", "range(size)")
    .replace("GROUP BY label, ridge, eta, n,", "GROUP BY label, ridge, eta, n, size,")
    .replace("any_value(eta) * avg(miss)", "any_value(eta) * sum(miss) / n")
    .replace("1 / (1 + exp(-(list_dot_product(k.k, s.y) + s.yb))) - t.target AS miss", "CASE WHEN t.fold = s.label THEN 0 ELSE 1 / (1 + exp(-(list_dot_product(k.k, s.y) + s.yb))) - t.target END AS miss")
    .replace("FROM solve s CROSS JOIN docs d JOIN", "FROM solve s JOIN folded d ON d.fold = s.label JOIN")
)

ORACLES: dict[str, str] = {
    "corpus_scan": "WITH " + LABELLED + " SELECT id, nullif(keyword, 'es') AS keyword, location, text, target FROM labelled",
    "predictions_block": scored(PLAIN) + block("ticket-1-baseline", "0.3"),
    "ledger_replace": scored(PLAIN)
    + block("ticket-1-baseline", "0.35")
    + " UNION ALL "
    + block("ticket-2-normalization", "0.25"),
    "ledger_drift": scored(PLAIN)
    + """ SELECT count(*) FILTER (WHERE (score >= 0.3) = (score >= 0.35)) AS n_same, count(*) FILTER (WHERE (score >= 0.3) <> (score >= 0.35)) AS n_changed,
  0::BIGINT AS n_only_stored, 0::BIGINT AS n_only_current FROM scores WHERE split = 'heldout'""",
    "freeze_summary": scored(CASED, web=True)
    + ", chosen AS (SELECT * FROM scores WHERE variant = 'preserve_case' AND split = 'dev')"
    + SWEEP
    + f""",
pairs AS (
  SELECT a.y_true, b.y_pred AS was, CAST(a.score >= best.threshold AS INTEGER) AS y_pred
  FROM scores a JOIN scores b ON a.id = b.id AND a.variant = 'preserve_case' AND b.variant = 'baseline_no_cleaning'
  CROSS JOIN best WHERE a.split = 'heldout'
),
counted AS (
  SELECT {CONFUSION}, count(*) FILTER (WHERE was = 1 AND y_true = 0 AND y_pred = 0) AS fixed_fp,
         count(*) FILTER (WHERE was = 0 AND y_true = 1 AND y_pred = 1) AS fixed_fn,
         count(*) FILTER (WHERE was = 0 AND y_true = 0 AND y_pred = 1) AS new_fp,
         count(*) FILTER (WHERE was = 1 AND y_true = 1 AND y_pred = 0) AS new_fn
  FROM pairs
)
SELECT 'ticket-2-normalization' AS ticket, 'bayes_case' AS model_name,
       (SELECT f1 FROM best) AS dev_f1_target_1,
       round({F1}, 4) AS heldout_f1_target_1, round({ACCURACY}, 4) AS heldout_accuracy,
       fixed_fp, fixed_fn, new_fp, new_fn, 'adopt_preserve_case' AS decision, 'best dev threshold' AS decision_reason
FROM counted""",
    "stratified_split": DOCS + " SELECT id, target, pos, split FROM docs",
    "split_select": DOCS + " SELECT id, split, pos, keyword, location, target FROM docs WHERE split = 'dev'",
    "split_coverage": DOCS
    + """ SELECT (SELECT count(*) FROM documents) AS n_rows,
  (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT id FROM docs)) AS n_unassigned,
  (SELECT count(*) FROM (SELECT id FROM docs GROUP BY id HAVING count(*) > 1)) AS n_listed_twice,
  (SELECT count(*) FROM docs WHERE id NOT IN (SELECT doc_id FROM documents)) AS n_unknown""",
    "split_balance": DOCS
    + """ SELECT split, count(*) AS n_rows, count(*) FILTER (WHERE target = 1) AS n_positive, count(*) FILTER (WHERE target = 0) AS n_negative
  FROM docs GROUP BY split""",
    "norm_strip_urls": f"SELECT page_id, {collapse(urls('html'))} AS text FROM pages",
    "norm_strip_mentions": f"SELECT page_id, {collapse(mentions('html'))} AS text FROM pages",
    "norm_strip_hashtag": f"SELECT page_id, {collapse(hashtags('url'))} AS text FROM pages",
    "norm_unescape_html": f"SELECT page_id, {collapse(entities('html'))} AS text FROM pages",
    "norm_unescape_known": f"SELECT page_id, {collapse(entities('html'))} AS text FROM pages",
    "norm_strip_emoji": "SELECT doc_id, "
    + collapse(emoji("replace(replace(text, 'qu', '\U0001f600\U0001f680'), ',', '☀❤Ⓜ')"))
    + " AS text FROM documents",
    "norm_whitespace": "SELECT doc_id, "
    + collapse("replace(replace(text, ',', chr(160) || chr(8195)), '.', chr(133) || ' ' || chr(28))")
    + " AS text FROM documents",
    "norm_all": f"SELECT page_id, {collapse(emoji(hashtags(mentions(urls(entities('html'))))))} AS text FROM pages",
    "norm_preserve_case_vocab": DOCS
    + token_rows(CASED)
    + " SELECT variant, term, count(*) AS df FROM tf WHERE split = 'train' GROUP BY ALL",
    "dedup_key": f"SELECT conv_id, turn, {collapse('lower(text)')} AS dedup_key FROM conversations",
    "surface_flags": TEXTS + f" SELECT id, {FLAG_COLUMNS} FROM texts",
    "length_bins": f"""SELECT doc_id, CAST(length(text) AS INTEGER) AS char_len, {SHORT_BIN} AS short_bin,
  {WIDE_BIN} AS wide_bin FROM documents""",
    "shortcut_features": TEXTS
    + f""", counted AS (
  SELECT id, location, text, len(regexp_extract_all(text, '{UPPER}')) AS upper,
         len(regexp_extract_all(text, '\\p{{L}}')) AS letters FROM texts
)
SELECT id, CAST(length(text) AS INTEGER) AS char_len, CAST(contains(lower(text), 'http') AS INTEGER) AS has_http,
       CAST(len(regexp_extract_all(text, '#{W}+')) AS INTEGER) AS n_hashtags,
       round(CASE WHEN letters > 0 THEN upper / letters ELSE 0.0 END, 6) AS frac_upper,
       CAST(coalesce({collapse('location')} <> '', false) AS INTEGER) AS has_location
FROM counted""",
    "onehot_keyword": DOCS
    + """, levels AS (SELECT id, split, keyword || '-' || location AS level FROM docs)
SELECT id, split, level FROM levels WHERE level IN (SELECT level FROM levels WHERE split = 'train')""",
    "surface_profile": PROFILE + " SELECT * FROM profile",
    "surface_contrast": PROFILE
    + """ SELECT feature, max(CASE WHEN "group" = 'present' THEN pos_rate END) AS present_rate,
  max(CASE WHEN "group" = 'absent' THEN pos_rate END) AS absent_rate,
  round(max(CASE WHEN "group" = 'present' THEN pos_rate END) - max(CASE WHEN "group" = 'absent' THEN pos_rate END), 4) AS contrast
FROM profile WHERE "group" IN ('present', 'absent') GROUP BY feature""",
    "token_counts": COUNTED_TERMS.format(words=words("lower(text)")),
    "token_counts_punct": COUNTED_TERMS.format(words=words("lower(text)", f"{W}{{2,}}|[!?]")),
    "ngram_counts": f"""WITH worded AS (SELECT doc_id, {words('lower(text)')} AS w FROM documents),
unigrams AS (SELECT doc_id, unnest(w) AS term, unnest(range(1, len(w) + 1)) AS i FROM worded),
terms AS (
  SELECT doc_id, term FROM unigrams
  UNION ALL SELECT a.doc_id, a.term || ' ' || b.term FROM unigrams a JOIN unigrams b ON a.doc_id = b.doc_id AND b.i = a.i + 1
)
SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL""",
    "vocab_min_df": DOCS
    + token_rows(PLAIN)
    + " SELECT term, count(*) AS df FROM tf WHERE split = 'train' GROUP BY term HAVING count(*) >= 2",
    "idf_table": WEIGHTS % "tf" + " SELECT term, df, round(idf, 6) AS idf FROM idf",
    "tfidf_l2": weights("train"),
    "tfidf_sublinear": weights("train", sublinear=True),
    "tfidf_transform_dev": weights("dev"),
    "hashed_tfidf": HASHED_WEIGHTS,
    "hash_collisions": DOCS
    + token_rows(PLAIN)
    + ", df AS (SELECT term, count(*) AS df FROM tf WHERE split = 'train' GROUP BY term), "
    + hashed("df")
    + """
SELECT bucket, count(*) AS n_terms, CAST(sum(negative) AS BIGINT) AS n_negative, max(df) AS most_df, CAST(sum(df) AS BIGINT) AS sum_df
FROM hashed GROUP BY bucket HAVING count(*) > 1""",
    "vocab_size_by_variant": WEB_DOCS
    + token_rows(
        {
            "baseline_no_cleaning": NORMALIZED["baseline_no_cleaning"],
            "strip_urls": NORMALIZED["strip_urls"],
            "punct_preserving_tokenizer": PUNCTUATED,
            "preserve_case": NORMALIZED["preserve_case"],
        }
    )
    + f""",
seq AS (SELECT id, split, unnest(w) AS term, unnest(range(1, len(w) + 1)) AS i FROM (SELECT id, split, {words('lower(text)')} AS w FROM docs)),
sizes AS (
  SELECT variant, term FROM tf WHERE split = 'train'
  UNION SELECT '1-2', term FROM seq WHERE split = 'train'
  UNION SELECT '1-2', a.term || ' ' || b.term FROM seq a JOIN seq b ON a.id = b.id AND b.i = a.i + 1 WHERE a.split = 'train'
)
SELECT variant, count(DISTINCT term) AS vocab_size FROM sizes GROUP BY variant""",
    "nb_scores": WEIGHTS % "tf"
    + """,
mass AS (
  SELECT term, sum(CASE WHEN target = 1 THEN weight ELSE 0 END) AS m1, sum(CASE WHEN target = 0 THEN weight ELSE 0 END) AS m0
  FROM weights WHERE split = 'train' GROUP BY term
),
totals AS (SELECT sum(m1) AS n1, sum(m0) AS n0, count(*) AS v FROM mass),
odds AS (SELECT term, ln((m1 + 1) / (n1 + v)) - ln((m0 + 1) / (n0 + v)) AS lo FROM mass CROSS JOIN totals),
prior AS (SELECT ln(count(*) FILTER (WHERE target = 1) / count(*) FILTER (WHERE target = 0)) AS p FROM docs WHERE split = 'train'),
evidence AS (SELECT id, sum(weight * lo) AS e FROM weights JOIN odds USING (term) GROUP BY id)
SELECT d.id, d.target AS y_true, d.split, round(1 / (1 + exp(-(coalesce(e, 0) + p))), 6) AS score,
       CAST(coalesce(e, 0) + p > 0 AS INTEGER) AS y_pred
FROM docs d CROSS JOIN prior LEFT JOIN evidence USING (id)""",
    "lr_classes": OPTIMA + " SELECT label, id, split, y_true, y_pred, true AS certified FROM classes",
    "fit_certificate": OPTIMA
    + """ SELECT label, (SELECT count(*) FROM train) AS n_fit, true AS converged, count(*) AS n_scored,
  CAST(sum(y_pred) AS BIGINT) AS n_positive, 0::BIGINT AS n_uncertified FROM classes GROUP BY label""",
    "c_sweep": OPTIMA
    + f""" SELECT position, 'C_sweep' AS group, label, round({PRECISION}, 4) AS dev_precision_target_1,
  round({RECALL}, 4) AS dev_recall_target_1, round({F1}, 4) AS dev_f1_target_1
FROM (SELECT label, {CONFUSION} FROM classes WHERE split = 'dev' GROUP BY label) JOIN settings USING (label)""",
    "balanced_weights": DOCS
    + """ SELECT id, target, round(count(*) OVER () / (2 * count(*) OVER (PARTITION BY target)), 6) AS class_weight
  FROM docs WHERE split = 'train'""",
    "majority_floor": DOCS
    + """ SELECT id, target AS y_true, split,
  (SELECT CAST(count(*) FILTER (WHERE target = 1) > count(*) FILTER (WHERE target = 0) AS INTEGER) FROM docs WHERE split = 'train') AS y_pred FROM docs""",
    "top_weighted_terms": DOCS
    + token_rows(PLAIN)
    + odds()
    + """,
sided AS (
  SELECT 'positive' AS side, CAST(row_number() OVER (ORDER BY lo DESC, term) AS INTEGER) AS rank, term, lo FROM odds
  UNION ALL SELECT 'negative', CAST(row_number() OVER (ORDER BY lo, term) AS INTEGER), term, lo FROM odds
)
SELECT side, rank, term, round(lo, 6) AS log_odds FROM sided WHERE rank <= 15""",
    "confusion": scored(PLAIN) + f" SELECT split, {CONFUSION} FROM scores GROUP BY split",
    "prf_metrics": scored(PLAIN)
    + f""" SELECT split, round({PRECISION}, 4) AS precision_target_1, round({RECALL}, 4) AS recall_target_1,
  round({F1}, 4) AS f1_target_1, round({ACCURACY}, 4) AS accuracy
FROM (SELECT split, {CONFUSION} FROM scores GROUP BY split)""",
    "threshold_sweep": scored(PLAIN)
    + ", chosen AS (SELECT * FROM scores WHERE split = 'dev')"
    + SWEEP
    + f""" SELECT threshold, round({PRECISION}, 4) AS precision_target_1, round({RECALL}, 4) AS recall_target_1,
  round({F1}, 4) AS f1_target_1 FROM swept""",
    "best_threshold": scored(PLAIN)
    + ", chosen AS (SELECT * FROM scores WHERE split = 'dev')"
    + SWEEP
    + " SELECT threshold, tp, fp, fn, tn, f1 AS f1_target_1 FROM best",
    "flip_counts": scored(NORMALIZED, web=True)
    + FLIPPED % "baseline_no_cleaning"
    + f" SELECT variant, split, {FLIP_COUNTS}, {NET} FROM flipped GROUP BY variant, split",
    "flip_examples": scored(NORMALIZED, web=True)
    + FLIPPED % "baseline_no_cleaning"
    + """,
first AS (
  SELECT *, row_number() OVER (PARTITION BY variant, flip_type ORDER BY pos, id) AS r
  FROM flipped WHERE split = 'dev' AND flip_type IS NOT NULL
)
SELECT variant, flip_type, id, text, y_true, baseline_pred, variant_pred
FROM first JOIN (SELECT id, text FROM docs) USING (id) WHERE r <= 5""",
    "normalization_sweep": scored(NORMALIZED, web=True)
    + sweep_rows(NORMALIZED, "baseline_no_cleaning")
    + f""" SELECT variant, CAST(position AS BIGINT) AS position, normalize_steps, preserve_case, dev_f1_target_1,
  fixed_fp, fixed_fn, new_fp, new_fn, net_flips
FROM {variant_rows(STEPS)} JOIN quality USING (variant) JOIN changed USING (variant)""",
    "tokenizer_probe": scored(TOKENIZERS, web=True)
    + sweep_rows(TOKENIZERS, "default_tokenizer")
    + f""" SELECT CAST(position AS BIGINT) AS position, variant, token_pattern, vocab_size, dev_f1_target_1,
  fixed_fp, fixed_fn, new_fp, new_fn
FROM (VALUES (0, 'default_tokenizer', '{W}{{2,}}+'), (1, 'punct_preserving_tokenizer', '{W}{{2,}}+|[!?]')) v(position, variant, token_pattern)
JOIN (SELECT variant, count(*) AS vocab_size FROM mass GROUP BY variant) USING (variant)
JOIN quality USING (variant) JOIN changed USING (variant)""",
    "param_grid": DOCS
    + token_rows({"1-1": NGRAMS["1-1"]})
    + f""",
seq AS (SELECT id, split, unnest(w) AS term, unnest(range(1, len(w) + 1)) AS i FROM (SELECT id, split, {words('lower(text)')} AS w FROM docs)),
occurs AS (
  SELECT DISTINCT id, term FROM seq WHERE split = 'train'
  UNION ALL SELECT DISTINCT a.id, a.term || ' ' || b.term FROM seq a JOIN seq b ON a.id = b.id AND b.i = a.i + 1 WHERE a.split = 'train'
),
df AS (
  SELECT '1-1' AS ngrams, term, count(*) AS df FROM tf WHERE split = 'train' GROUP BY term
  UNION ALL SELECT '1-2', term, count(*) FROM occurs GROUP BY term
),
grid AS (
  SELECT a.i * 16 + b.i * 8 + g.i * 4 + c.i AS position, min_df, sublinear_tf, ngrams, c
  FROM (VALUES (0, 2), (1, 3), (2, 5)) a(i, min_df) CROSS JOIN (VALUES (0, true), (1, false)) b(i, sublinear_tf)
  CROSS JOIN (VALUES (0, '1-1'), (1, '1-2')) g(i, ngrams)
  CROSS JOIN (VALUES (0, 1.0::DOUBLE), (1, 2.0), (2, 4.0), (3, 10.0)) c(i, c)
)
SELECT CAST(position AS BIGINT) AS position, CAST(min_df AS BIGINT) AS min_df, sublinear_tf, ngrams, c,
       (SELECT count(*) FROM df WHERE df.ngrams = grid.ngrams AND df.df >= grid.min_df) AS vocab_size,
       round(1 / (c * (SELECT count(*) FROM docs WHERE split = 'train')), 8) AS reg_param
FROM grid""",
    "contract_gap": GAPS
    + " SELECT label, heldout_f1_target_1, CAST(position AS BIGINT) AS position, heldout_gap_vs_reference, within_tolerance FROM gaps",
    "in_tolerance": GAPS
    + """ SELECT label, heldout_f1_target_1, CAST(position AS BIGINT) AS position, heldout_gap_vs_reference, within_tolerance
FROM gaps WHERE within_tolerance""",
    "stored_metric": scored(NORMALIZED, web=True)
    + sweep_rows(NORMALIZED, "baseline_no_cleaning")
    + " SELECT dev_f1_target_1 FROM quality WHERE variant = 'strip_urls'",
    "contract_closest": GAPS
    + """ SELECT label, heldout_f1_target_1, CAST(position AS BIGINT) AS position, heldout_gap_vs_reference, within_tolerance
FROM gaps ORDER BY abs(heldout_gap_vs_reference), position LIMIT 1""",
    "dup_label_conflicts": DOCS + LINES + " SELECT * FROM dups",
    "dup_group_members": DOCS
    + LINES
    + """ SELECT upper(sha256(k)) AS group_key, row_number() OVER (PARTITION BY k ORDER BY id, target) AS place,
  id, target AS label FROM lines JOIN conflicts USING (k)""",
    "likely_mislabels": scored(PLAIN) + MISLABELS + " SELECT * FROM mislabels",
    "oof_scores": OUT_OF_FOLD
    + f""" SELECT fold, id, split, y_true, round(score, 6) AS score, CAST(score >= {CUT} AS INTEGER) AS y_pred FROM scores""",
    "oof_classes": FOLD_OPTIMA + " SELECT label AS fold, id, split, y_true, y_pred, true AS certified FROM classes",
    "likely_mislabels_oof": OUT_OF_FOLD + MISLABELS.replace("'NB ", "'NB out of fold ") + " SELECT * FROM mislabels",
    "audit_table": AUDIT + " SELECT * FROM audit",
    "audit_summary": AUDIT + " SELECT issue_type, disposition, count(*) AS n FROM audit GROUP BY ALL",
    "review_overlay": AUDIT
    + REVIEWS
    + """ SELECT a.id, CASE WHEN v = 'reject_false_positive' THEN v ELSE issue_type END AS issue_type, evidence, original_label,
  CASE WHEN v IS NULL THEN proposed_label WHEN v = 'fix' THEN new_label END AS proposed_label,
  coalesce(v, disposition) AS disposition, confidence
FROM (SELECT audit.*, CASE WHEN issue_type = 'likely_mislabel' THEN verdict END AS v, new_label
      FROM audit LEFT JOIN reviews USING (id)) a""",
    "review_coverage": AUDIT
    + REVIEWS
    + """ SELECT id, 'no_such_finding' AS problem FROM reviews WHERE id NOT IN (SELECT id FROM mislabels)
UNION ALL SELECT id, 'not_reviewed' FROM mislabels WHERE id NOT IN (SELECT id FROM reviews)""",
    "label_error_floor": DOCS
    + LINES
    + """ SELECT count(*) AS n_groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_rows,
  CAST(coalesce(sum(least(n_pos, n_neg)), 0) AS BIGINT) AS error_floor FROM conflicts""",
    "relabel_overlay": DOCS
    + LINES
    + """,
proposals AS (
  SELECT id, CASE WHEN min(proposed_label) = max(proposed_label) THEN min(proposed_label) END AS p
  FROM dups WHERE proposed_label IS NOT NULL GROUP BY id
)
SELECT d.id, d.split, d.target AS original_label, CASE WHEN d.split <> 'heldout' THEN p END AS proposed_label,
       coalesce(CASE WHEN d.split <> 'heldout' THEN p END, d.target) AS target
FROM docs d LEFT JOIN proposals USING (id)""",
}
